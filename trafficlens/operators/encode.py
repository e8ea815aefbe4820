"""Feature encoding.

Dictionaries (value -> code) are DataFrames built by distributed aggregates
and numbered with the partitioned row index, never collected; they join back
to the facts (AQE broadcasts them when their measured size is small, and splits
the side of a value that very many rows have).  One-hot and count vectors built
on them are sparse (size, indices, counts) and have no limit on the vocabulary.
The ``pyspark.ml`` stages, for learners, hold their vocabulary in the driver:
they are for columns of few values.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import (IDF, FeatureHasher, HashingTF, IndexToString, OneHotEncoder, PCA, RegexTokenizer,
                                StandardScaler, StringIndexer, Tokenizer, VectorAssembler, VectorIndexer)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.scalars import hash_bucket, prefixed
from trafficlens.operators.ordering import with_row_index
from trafficlens.session import cut_lineage

# Fixed value: tokens of the bag of words are runs of two or more Unicode letters,
# digits and '_': split on runs of other characters, keep pieces of two or more.
NON_WORD = r"[^\p{L}\p{N}_]+"


def hash_columns(df: DataFrame, cols: dict[str, int], method: str = "md5") -> DataFrame:
    """replace each column by its hash bucket (n per column)."""
    return df.withColumns({c: hash_bucket(c, n, method) for c, n in cols.items()})


def sorted_codes(df: DataFrame, col: str, code: str = "code") -> DataFrame:
    """dictionary value -> rank in sorted order (0-based), distributed."""
    vals = df.where(F.col(col).isNotNull()).select(col).distinct()
    return with_row_index(vals, [col], code)


def first_seen_codes(df: DataFrame, col: str, order: str, code: str = "code") -> DataFrame:
    """dictionary value -> 0, 1, .. in order of first appearance."""
    firsts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(order).alias("_first"))
    return with_row_index(firsts, ["_first"], code).drop("_first")


def shared_codes(df: DataFrame, cols: list[str], order: str, code: str = "code") -> DataFrame:
    """one running code over all columns' values (column by column, first
    appearance within a column); a value in several columns keeps the code of
    the last one, as the reference's dictionary overwrite does."""
    parts = [df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value"))
             .agg(F.min(order).alias("_first")).withColumn("_colno", F.lit(i)) for i, c in enumerate(cols)]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    coded = with_row_index(long, ["_colno", "_first"], code)
    return coded.groupBy("value").agg(F.max_by(F.col(code), F.col("_colno")).alias(code))


def encode_with(df: DataFrame, col: str, codes: DataFrame, code: str = "code", out: str | None = None) -> DataFrame:
    """Join a dictionary back; unknown values get null."""
    d = codes.select(F.col(codes.columns[0]).alias("_v"), F.col(code).alias(out or f"{col}_code"))
    return df.join(d, F.col(col) == F.col("_v"), "left").drop("_v")


def codes_with_unknown(fit: DataFrame, col: str, unknown: str = "unknown", code: str = "code") -> DataFrame:
    """sorted dictionary of the fitted values plus the 'unknown' class."""
    vals = fit.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias(col)).distinct()
    extra = fit.sparkSession.range(1).select(F.lit(unknown).alias(col))
    return with_row_index(vals.unionByName(extra).distinct(), [col], code)


def encode_unknown(df: DataFrame, col: str, codes: DataFrame, unknown: str = "unknown",
                   code: str = "code", out: str = "code") -> DataFrame:
    """unseen values map to the 'unknown' class code."""
    unk = codes.where(F.col(col) == unknown).select(code).scalar()
    d = codes.select(F.col(col).alias("_v"), F.col(code).alias("_c"))
    j = df.join(d, F.col(col).cast("string") == F.col("_v"), "left")
    return j.withColumn(out, F.coalesce(F.col("_c"), unk)).drop("_v", "_c")


def one_hot_codes(fit: DataFrame, cols: list[str]) -> DataFrame:
    """F6 + F7: (column, value, slot): the columns' sorted values, block after block."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                for i, c in enumerate(cols)]))
    values = fit.select(pairs.alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()
    return with_row_index(values, ["no", "value"], "slot").drop("no")


def one_hot_sparse(df: DataFrame, key: str, cols: list[str], codes: DataFrame) -> DataFrame:
    """F6 + F7: (key, size, indices): the hot slots of each row; an unseen value has none."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    long = df.select(key, pairs.alias("p")).select(key, "p.*").join(codes, ["column", "value"], "left")
    size = codes.select(F.count(F.lit(1))).scalar()
    # At most len(cols) slots a key.
    return long.groupBy(key).agg(F.array_sort(F.collect_list("slot")).alias("indices")).select(key, size.alias("size"), "indices")


def one_hot_stages(cols: list[str], order: str = "alphabetAsc") -> list:
    """F6 for learners: the indexer keeps unseen as an extra index; the encoder drops that last
    slot, so an unseen value becomes an all-zero vector."""
    stages = []
    for c in cols:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep", stringOrderType=order))
        stages.append(OneHotEncoder(inputCol=f"{c}_idx", outputCol=f"{c}_vec", dropLast=True, handleInvalid="error"))
    return stages


def one_hot_fit(fit: DataFrame, cols: list[str]):
    """F6 + F7 for learners: fitted one-hot per column and the stacked block vector."""
    stages = one_hot_stages(cols) + [VectorAssembler(inputCols=[f"{c}_vec" for c in cols], outputCol="features")]
    return Pipeline(stages=stages).fit(fit)


def prefixed_one_hot(df: DataFrame, key: str, cols: list[str], fit: DataFrame | None = None) -> DataFrame:
    """F8: (key, size, indices) over one sorted dictionary of the 'name;value' tokens of all columns."""
    tokens = F.array(*[prefixed(c) for c in cols])
    codes = sorted_codes((df if fit is None else fit).select(F.explode(tokens).alias("token")), "token", "slot")
    long = df.select(key, F.explode(tokens).alias("token")).join(codes, "token", "left")
    size = codes.select(F.count(F.lit(1))).scalar()
    return long.groupBy(key).agg(F.array_sort(F.collect_set("slot")).alias("indices")).select(key, size.alias("size"), "indices")


def word_tokens(df: DataFrame, text: str, key: str) -> DataFrame:
    """F9 long form: (key, token, n), lower-cased tokens of two or more word characters."""
    toks = df.select(key, F.explode(F.split(F.lower(F.col(text)), NON_WORD)).alias("token"))
    return toks.where(F.length("token") >= 2).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def word_vectors(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, size, indices, counts) over the sorted dictionary of all tokens; every row of ``df`` has one.

    The token counts are written once and read for the dictionary and the rows.
    A row's entries are bounded by its own text.
    """
    tokens = cut_lineage(word_tokens(df, text, key))
    codes = sorted_codes(tokens, "token")
    size = codes.select(F.count(F.lit(1))).scalar()
    entries = F.array_sort(F.collect_list(F.struct("code", "n")))
    rows = tokens.join(codes, "token").groupBy(key).agg(entries.alias("_e"))
    none = F.array().cast("array<bigint>")
    out = df.select(key).join(rows, key, "left")
    return out.select(key, size.alias("size"), F.coalesce(F.col("_e.code"), none).alias("indices"),
                      F.coalesce(F.col("_e.n"), none).alias("counts"))


def tokenizers(text: str = "text") -> list:
    """whitespace tokens and \\W-split tokens."""
    return [Tokenizer(inputCol=text, outputCol="words"),
            RegexTokenizer(inputCol=text, outputCol="regex_words", pattern="\\W")]


def hashed_tf(words: str, n: int, out: str = "tf") -> HashingTF:
    """F11."""
    return HashingTF(inputCol=words, outputCol=out, numFeatures=n)


def tf_idf_long(df: DataFrame, text: str, key: str) -> DataFrame:
    """F12 long form: (key, token, n, tfidf) with tf x ln((m+1)/(df+1)), m = all documents (Spark's rule).

    The corpus is tokenised once: the counts are written and read for the
    document frequencies and the rows.  The frequencies are combined before the
    join, which Spark splits at the tokens that most documents have.
    """
    tokens = cut_lineage(word_tokens(df, text, key))
    m = df.select(F.count(F.lit(1))).scalar()
    dfreq = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    return tokens.join(dfreq, "token").withColumn(
        "tfidf", F.col("n") * F.log((m + F.lit(1.0)) / (F.col("_df") + F.lit(1.0)))).drop("_df")


def idf_stage(tf: str, out: str = "tfidf") -> IDF:
    """F12."""
    return IDF(inputCol=tf, outputCol=out)


def assemble(cols: list[str], out: str = "features") -> VectorAssembler:
    """F13."""
    return VectorAssembler(inputCols=cols, outputCol=out)


def label_index(label: str, out: str = "indexedLabel") -> StringIndexer:
    """most frequent label = 0, ties by name."""
    return StringIndexer(inputCol=label, outputCol=out, stringOrderType="frequencyDesc")


def label_back(indexer_model, col: str = "prediction", out: str = "predictedLabel") -> IndexToString:
    """index back to the label text."""
    return IndexToString(inputCol=col, outputCol=out, labels=indexer_model.labels)


def categorical_slots(df: DataFrame, features: str, max_categories: int):
    """fit a VectorIndexer; its category maps as a DataFrame (slot, value, index).

    The maps hold at most max_categories values per slot: a bounded table.
    """
    model = VectorIndexer(inputCol=features, outputCol="indexed", maxCategories=max_categories).fit(df)
    rows = [(int(s), float(v), int(i)) for s, m in model.categoryMaps.items() for v, i in m.items()]
    maps = df.sparkSession.createDataFrame(rows, "slot int, value double, index int")
    return model, maps


def standard_scale(df: DataFrame, vec: str, out: str = "scaled", with_mean: bool = True, with_std: bool = True):
    """F16: zero mean, unit (sample) variance per slot."""
    return StandardScaler(inputCol=vec, outputCol=out, withMean=with_mean, withStd=with_std).fit(df)


def pca_2d(df: DataFrame, vec: str, k: int = 2):
    """centre (Spark's PCA does not), then project on k components."""
    centred = standard_scale(df, vec, "_centred", with_mean=True, with_std=False).transform(df)
    model = PCA(k=k, inputCol="_centred", outputCol="pca").fit(centred)
    return model, model.transform(centred).drop("_centred")


def pca_by_feature(df: DataFrame, cols: dict[str, int], keep: list[str], k: int = 2) -> DataFrame:
    """F17 per feature: hash each column into its buckets, one-hot the buckets, project on k components.

    One row a row and feature: ``keep`` columns, feature, x, y, ...; the buckets
    of a feature, a parameter, bound its vector.
    """
    parts = []
    for c, buckets in cols.items():
        rows = df.select(*keep, hash_bucket(c, buckets).cast("string").alias("_b"))
        encoded = one_hot_fit(rows, ["_b"]).transform(rows)
        _, out = pca_2d(encoded, "features", k)
        point = vector_to_array(F.col("pca"))
        parts.append(out.select(*keep, F.lit(c).alias("feature"), *[point[i].alias("xyzuvw"[i]) for i in range(k)]))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def feature_hasher(cols: list[str], n: int, out: str = "hashed") -> FeatureHasher:
    """F18."""
    return FeatureHasher(inputCols=cols, outputCol=out, numFeatures=n)


def slot_names(encoded: DataFrame, cols: list[str], features: str = "features") -> DataFrame:
    """vector slot -> column, value of stacked one-hot blocks, read from the vector's own metadata."""
    found = encoded.schema[features].metadata["ml_attr"]
    attrs = [a for group in found["attrs"].values() for a in group]
    rows = []
    for a in sorted(attrs, key=lambda a: a["idx"]):
        column = next(c for c in cols if a["name"].startswith(f"{c}_vec_"))
        rows.append((a["idx"], column, a["name"][len(column) + len("_vec_"):]))
    if [r[0] for r in rows] != list(range(found["num_attrs"])):
        raise ValueError(f"{features}: {len(rows)} of {found['num_attrs']} slots have a name")
    return encoded.sparkSession.createDataFrame(rows, "slot int, column string, value string")


def sparse(vec: str) -> Column:
    """A vector column as a struct with size, indices and values (a dense one has no indices)."""
    return F.unwrap_udt(F.col(vec))


def to_array(vec: str | Column) -> Column:
    return vector_to_array(F.col(vec) if isinstance(vec, str) else vec)
