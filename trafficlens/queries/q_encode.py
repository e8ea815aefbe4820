"""F1-F19 over the http stand-in, orders, lineitem, documents and embeddings."""

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from trafficlens.functions.scalars import none_text
from trafficlens.operators import encode as en
from trafficlens.sources import standins as si
from trafficlens.sources.tables import read
from trafficlens.sqltwins import AUTH, HTTP, with_

from . import register
from .q_aggregates import _act_counts_sql


def _hb(x, n):
    return f"CAST(('0x' || substring(md5(CAST({x} AS VARCHAR)), 1, 8)) AS BIGINT) % {n}"


@register("q_f1_hash_bucket", with_(HTTP) + f"SELECT ROW_ID, {_hb('operation', 100)} AS operation, "
          f"{_hb('userAgent_t', 1000)} AS userAgent, {_hb('browserId', 10000)} AS browserId FROM "
          "(SELECT *, COALESCE(userAgent, 'None') AS userAgent_t FROM http) t")
def q_f1(spark, d):
    h = si.http(spark, d).select("ROW_ID", "operation", none_text("userAgent").alias("userAgent"), "browserId")
    return en.hash_columns(h, {"operation": 100, "userAgent": 1000, "browserId": 10000})


@register("q_f2_sorted_codes", "SELECT o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) "
          "AS code FROM (SELECT DISTINCT o_orderpriority FROM orders) t")
def q_f2(spark, d):
    return en.sorted_codes(read(spark, d, "orders", ["o_orderpriority"]), "o_orderpriority")


@register("q_f2_encode_rows", "SELECT o_orderkey, o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 "
          "AS BIGINT) AS o_orderpriority_code FROM orders")
def q_f2r(spark, d):
    o = read(spark, d, "orders", ["o_orderkey", "o_orderpriority"])
    return en.encode_with(o, "o_orderpriority", en.sorted_codes(o, "o_orderpriority"))


@register("q_f3_first_seen_codes", with_(HTTP) + "SELECT operation, CAST(row_number() OVER (ORDER BY min(ROW_ID)) - 1 "
          "AS BIGINT) AS code FROM http GROUP BY operation")
def q_f3(spark, d):
    return en.first_seen_codes(si.http(spark, d), "operation", "ROW_ID")


_F4_COLS = ["operation", "requestType", "method", "slot"]


@register("q_f4_shared_codes", with_(HTTP, "h AS (SELECT *, 'r' || CAST(browserId % 5 AS VARCHAR) AS slot FROM http)",
          "long AS (" + " UNION ALL ".join(f"SELECT {i} AS colno, CAST({c} AS VARCHAR) AS value, min(ROW_ID) AS first "
                                            f"FROM h GROUP BY 2" for i, c in enumerate(_F4_COLS)) + ")",
          "coded AS (SELECT colno, value, row_number() OVER (ORDER BY colno, first) - 1 AS code FROM long)") +
          "SELECT value, CAST(arg_max(code, colno) AS BIGINT) AS code FROM coded GROUP BY value")
def q_f4(spark, d):
    h = si.http(spark, d).withColumn("slot", F.concat(F.lit("r"), (F.col("browserId") % 5).cast("string")))
    return en.shared_codes(h, _F4_COLS, "ROW_ID")


@register("q_f5_unknown_class", """WITH e AS (SELECT event_id, CAST(CAST(regexp_extract(props, '"k":\\s*(\\d+)', 1) AS BIGINT)
  AS VARCHAR) AS b, CAST(regexp_extract(props, '"k":\\s*(\\d+)', 1) AS BIGINT) AS k FROM events),
d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT b AS v FROM e WHERE k < 50
  UNION SELECT 'unknown') t)
SELECT e.event_id, e.b, CAST(COALESCE(d.code, (SELECT code FROM d WHERE v = 'unknown')) AS BIGINT) AS code
FROM e LEFT JOIN d ON e.b = d.v""")
def q_f5(spark, d):
    e = read(spark, d, "events", ["event_id", "props"]).select("event_id", si.k_col().cast("string").alias("b"),
                                                                si.k_col().alias("k"))
    codes = en.codes_with_unknown(e.where(F.col("k") < 50), "b")
    return en.encode_unknown(e.select("event_id", "b"), "b", codes)


_F6_SQL = with_(HTTP, "h AS (SELECT ROW_ID, userId, COALESCE(userAgent, 'None') AS ua FROM http)",
                "d AS (SELECT ua, row_number() OVER (ORDER BY ua) - 1 AS code FROM (SELECT DISTINCT ua FROM h "
                "WHERE userId % 2 = 0) t)")


@register("q_f6_one_hot_unseen", _F6_SQL + "SELECT h.ROW_ID, CAST(COALESCE(d.code, -1) AS INTEGER) AS hot, "
          "CAST((SELECT count(*) FROM d) AS INTEGER) AS size FROM h LEFT JOIN d ON h.ua = d.ua")
def q_f6(spark, d):
    h = si.http(spark, d).select("ROW_ID", "userId", none_text("userAgent").alias("ua"))
    codes = en.one_hot_codes(h.where(F.col("userId") % 2 == 0), ["ua"])
    out = en.one_hot_sparse(h, "ROW_ID", ["ua"], codes)
    return out.select("ROW_ID", F.coalesce(F.get("indices", F.lit(0)), F.lit(-1)).cast("int").alias("hot"), F.col("size").cast("int").alias("size"))


_BLOCKS = with_(HTTP, """v AS (SELECT DISTINCT 0 AS c, operation AS value FROM http UNION SELECT DISTINCT 1, method FROM http
  UNION SELECT DISTINCT 2, requestType FROM http)""", "s AS (SELECT c, value, row_number() OVER (ORDER BY c, value) - 1 AS slot FROM v)")
_BLOCK_ROWS = """SELECT ROW_ID, (SELECT count(*) FROM s) AS size, a.slot || ',' || b.slot || ',' || c.slot AS indices FROM http
  JOIN s a ON a.c = 0 AND a.value = operation JOIN s b ON b.c = 1 AND b.value = method JOIN s c ON c.c = 2 AND c.value = requestType"""


@register("q_f7_stacked_one_hot", _BLOCKS + _BLOCK_ROWS)
def q_f7(spark, d):
    """The sparse form: the hot slots of each row, as text."""
    h = si.http(spark, d).select("ROW_ID", "operation", "method", "requestType")
    cols = ["operation", "method", "requestType"]
    out = en.one_hot_sparse(h, "ROW_ID", cols, en.one_hot_codes(h, cols))
    return out.select("ROW_ID", "size", F.array_join("indices", ",").alias("indices"))


@register("q_f7_stacked_one_hot_vectors", _BLOCKS + _BLOCK_ROWS)
def q_f7v(spark, d):
    """The same through the pyspark.ml stages that learners use."""
    h = si.http(spark, d).select("ROW_ID", "operation", "method", "requestType")
    model = en.one_hot_fit(h, ["operation", "method", "requestType"])
    v = model.transform(h).select("ROW_ID", en.sparse("features").alias("v"))
    return v.select("ROW_ID", F.col("v.size").cast("long").alias("size"), F.array_join("v.indices", ",").alias("indices"))


@register("q_f8_prefixed_one_hot", with_(HTTP, "t AS (SELECT ROW_ID, unnest(['operation;' || operation, 'method;' || method, "
          "'requestType;' || requestType]) AS token FROM http)",
          "s AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS slot FROM (SELECT DISTINCT token FROM t) u)") +
          "SELECT ROW_ID, (SELECT count(*) FROM s) AS size, string_agg(CAST(slot AS VARCHAR), ',' ORDER BY slot) AS indices "
          "FROM t JOIN s USING (token) GROUP BY 1")
def q_f8(spark, d):
    h = si.http(spark, d).select("ROW_ID", "operation", "method", "requestType")
    out = en.prefixed_one_hot(h, "ROW_ID", ["operation", "method", "requestType"])
    return out.select("ROW_ID", "size", F.array_join("indices", ",").alias("indices"))


_TOK_SQL = ("SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), "
            "'[\\p{L}\\p{N}_]{2,}')) AS token FROM documents) t GROUP BY 1, 2")


@register("q_f9_bag_of_words", _TOK_SQL)
def q_f9(spark, d):
    return en.word_tokens(read(spark, d, "documents", ["doc_id", "text"]), "text", "doc_id")


@register("q_f9_count_vectors", "WITH tok AS (" + _TOK_SQL + "), s AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS code "
          "FROM (SELECT DISTINCT token FROM tok) t), v AS (SELECT doc_id, string_agg(code || ':' || n, ',' ORDER BY code) AS entries, "
          "sum(n) AS n_tokens FROM tok JOIN s USING (token) GROUP BY 1) SELECT d.doc_id, (SELECT count(*) FROM s) AS size, "
          "md5(coalesce(entries, '')) AS entries_md5, CAST(coalesce(n_tokens, 0) AS BIGINT) AS n_tokens FROM documents d LEFT JOIN v USING (doc_id)")
def q_f9v(spark, d):
    """Sparse count vectors over all tokens of the corpus; the entries as a digest of 'slot:count'."""
    out = en.word_vectors(read(spark, d, "documents", ["doc_id", "text"]), "text", "doc_id")
    entries = F.array_join(F.zip_with("indices", "counts", lambda i, n: F.concat_ws(":", i, n)), ",")
    return out.select("doc_id", "size", F.md5(entries).alias("entries_md5"),
                      F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"))


@register("q_f10_token_counts", "SELECT doc_id, CAST(len(list_filter(string_split_regex(lower(text), '\\W'), "
          "lambda x: x <> '')) AS INTEGER) AS n_regex_tokens FROM documents")
def q_f10(spark, d):
    docs = read(spark, d, "documents", ["doc_id", "text"])
    out = Pipeline(stages=en.tokenizers("text")).fit(docs).transform(docs)
    return out.select("doc_id", F.size("regex_words").alias("n_regex_tokens"))


# Java's split keeps empty pieces but those at the end; an empty text is one empty piece.
_WS = "[ \\t\\n\\x0B\\f\\r]"
_N_WHITE = (f"CASE WHEN text = '' THEN 1 WHEN regexp_replace(text, '{_WS}+$', '') = '' THEN 0 "
            f"ELSE len(string_split_regex(regexp_replace(lower(text), '{_WS}+$', ''), '{_WS}')) END")


@register("q_f10_whitespace_tokens", f"SELECT doc_id, CAST({_N_WHITE} AS INTEGER) AS n_tokens FROM documents")
def q_f10w(spark, d):
    docs = read(spark, d, "documents", ["doc_id", "text"])
    out = Pipeline(stages=en.tokenizers("text")).fit(docs).transform(docs)
    return out.select("doc_id", F.size("words").alias("n_tokens"))


def _total(v):
    return F.aggregate(v["values"], F.lit(0.0), lambda a, x: a + x)


@register("q_f11_hashed_tf", f"SELECT doc_id, 20 AS size20, CAST({_N_WHITE} AS DOUBLE) AS tokens20, 1000 AS size1000, "
          f"CAST({_N_WHITE} AS DOUBLE) AS tokens1000 FROM documents")
def q_f11(spark, d):
    """Both bucket counts; the vectors as size and sum (every token is in one bucket)."""
    docs = read(spark, d, "documents", ["doc_id", "text"])
    stages = [en.tokenizers("text")[0], en.hashed_tf("words", 20, "tf20"), en.hashed_tf("words", 1000, "tf1000")]
    out = Pipeline(stages=stages).fit(docs).transform(docs).select("doc_id", en.sparse("tf20").alias("a"), en.sparse("tf1000").alias("b"))
    return out.select("doc_id", F.col("a.size").alias("size20"), _total(F.col("a")).alias("tokens20"),
                      F.col("b.size").alias("size1000"), _total(F.col("b")).alias("tokens1000"))


@register("q_f12_tf_idf", "WITH tok AS (" + _TOK_SQL + "), m AS (SELECT count(*) AS m FROM documents), "
          "df AS (SELECT token, count(*) AS dfreq FROM tok GROUP BY 1) SELECT tok.doc_id, tok.token, tok.n, "
          "round(tok.n * ln((m + 1.0) / (dfreq + 1.0)), 9) AS tfidf FROM tok JOIN df USING (token), m")
def q_f12(spark, d):
    out = en.tf_idf_long(read(spark, d, "documents", ["doc_id", "text"]), "text", "doc_id")
    # Reported at 1e-9: the JVM's and C's logarithms differ by an ulp on some inputs.
    return out.withColumn("tfidf", F.round("tfidf", 9))


@register("q_f12_idf_stage", "SELECT doc_id, 1000 AS size, TRUE AS weighted FROM documents")
def q_f12s(spark, d):
    docs = read(spark, d, "documents", ["doc_id", "text"])
    stages = [en.tokenizers("text")[0], en.hashed_tf("words", 1000, "tf"), en.idf_stage("tf")]
    out = Pipeline(stages=stages).fit(docs).transform(docs).select("doc_id", en.sparse("tf").alias("t"), en.sparse("tfidf").alias("v"))
    # The same slots as the counts, none of them weighted below zero.
    weighted = (F.col("v.indices") == F.col("t.indices")) & F.forall("v.values", lambda x: x >= 0)
    return out.select("doc_id", "v.size", weighted.alias("weighted"))


_ACT_COLS = ["COUNT_ACT_WEEK"] + [f"COUNT_ACT_{i}" for i in range(1, 7)]


@register("q_f13_assemble", with_(AUTH) + f"SELECT IP, slot, CAST(value AS DOUBLE) AS value FROM (SELECT IP, "
          f"unnest(range(7))::INTEGER AS slot, unnest([{', '.join(_ACT_COLS)}]) AS value FROM (SELECT IP, count(TIMESTAMP) AS COUNT_ACT_WEEK, "
          f"{_act_counts_sql()} FROM auth GROUP BY IP) a) t")
def q_f13(spark, d):
    from trafficlens.functions.timebuckets import half_day_bounds
    from trafficlens.operators.aggregates import activity_counts
    a = activity_counts(si.auth(spark, d), half_day_bounds(si.AUTH_WEEK_START))
    return en.assemble(_ACT_COLS).transform(a).select("IP", F.posexplode(en.to_array("features")).alias("slot", "value"))


@register("q_f14_label_index", """SELECT o_orderkey, o_orderpriority, CAST(i.idx AS DOUBLE) AS indexedLabel,
  o_orderpriority AS predictedLabel FROM orders JOIN (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY count(*) DESC,
  o_orderpriority) - 1 AS idx FROM orders GROUP BY 1) i ON o_orderpriority = i.v""")
def q_f14(spark, d):
    o = read(spark, d, "orders", ["o_orderkey", "o_orderpriority"])
    idx = en.label_index("o_orderpriority").fit(o)
    out = idx.transform(o)
    return en.label_back(idx, "indexedLabel").transform(out)


@register("q_f15_categorical_slots", "SELECT * FROM (VALUES (0, 'l_linenumber'), (1, 'l_discount'), (2, 'l_tax'), "
          "(3, 'l_quantity')) s(slot, name) WHERE CASE slot WHEN 0 THEN (SELECT count(DISTINCT l_linenumber) FROM lineitem) "
          "WHEN 1 THEN (SELECT count(DISTINCT l_discount) FROM lineitem) WHEN 2 THEN (SELECT count(DISTINCT l_tax) "
          "FROM lineitem) ELSE (SELECT count(DISTINCT l_quantity) FROM lineitem) END <= 10")
def q_f15(spark, d):
    cols = ["l_linenumber", "l_discount", "l_tax", "l_quantity"]
    li = read(spark, d, "lineitem", cols)
    v = en.assemble(cols).transform(li)
    _, maps = en.categorical_slots(v, "features", 10)
    names = spark.createDataFrame(list(enumerate(cols)), "slot int, name string")
    return maps.select("slot").distinct().join(names, "slot")


@register("q_f16_standard_scale", """WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim,
  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
s AS (SELECT dim, avg(v) AS mu, stddev_samp(v) AS sd FROM x GROUP BY 1)
SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(CASE WHEN sd <> 0 THEN (v - mu) / sd ELSE 0.0 END, 9) AS z
FROM x JOIN s USING (dim)""")
def q_f16(spark, d):
    from pyspark.ml.functions import array_to_vector
    e = si.vectors(spark, d).select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    out = en.standard_scale(e, "v").transform(e)
    # Reported at 1e-9: Spark's streaming moments and a two-pass standard
    # deviation differ in the last bits.
    return out.select("vec_id", F.posexplode(en.to_array("scaled")).alias("dim", "z")).select(
        "vec_id", F.col("dim").cast("int").alias("dim"), F.round("z", 9).alias("z"))


@register("q_f17_pca_2d")
def q_f17(spark, d):
    from pyspark.ml.functions import array_to_vector
    e = si.vectors(spark, d).select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    _, out = en.pca_2d(e, "v")
    arr = en.to_array("pca")
    return out.select("vec_id", "label", arr[0].alias("x"), arr[1].alias("y"))


@register("q_f17_pca_per_feature")
def q_f17f(spark, d):
    """Each feature hashed, one-hot coded and projected by itself, with the class of every row."""
    h = si.http(spark, d).select("ROW_ID", "isBot", "operation", none_text("userAgent").alias("userAgent"))
    return en.pca_by_feature(h, {"operation": 100, "userAgent": 100}, ["ROW_ID", "isBot"])


@register("q_f18_feature_hasher", with_(HTTP) + "SELECT ROW_ID, 64 AS size, 3.0::DOUBLE AS total FROM http")
def q_f18(spark, d):
    """Each column adds one to a bucket; the vectors as size and sum."""
    h = si.http(spark, d).select("ROW_ID", "operation", "method", "requestType")
    v = en.feature_hasher(["operation", "method", "requestType"], 64).transform(h).select("ROW_ID", en.sparse("hashed").alias("v"))
    return v.select("ROW_ID", "v.size", _total(F.col("v")).alias("total"))


@register("q_f19_slot_names", with_(HTTP) + """SELECT CAST(row_number() OVER (ORDER BY c, value) - 1 AS INTEGER) AS slot,
  CASE c WHEN 0 THEN 'operation' ELSE 'method' END AS "column", value
  FROM (SELECT DISTINCT 0 AS c, operation AS value FROM http UNION SELECT DISTINCT 1, method FROM http) t""")
def q_f19(spark, d):
    h = si.http(spark, d).select("operation", "method")
    cols = ["operation", "method"]
    return en.slot_names(en.one_hot_fit(h, cols).transform(h), cols)
