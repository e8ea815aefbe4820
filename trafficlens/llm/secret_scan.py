"""Secret scan with corpus-wide ownership frequency.

Candidates come from regular expressions over each whole text, with code-point
spans.  The hash of each candidate's secret is counted over the corpus by
distinct repositories and distinct owners: a value that ``EXAMPLE_OWNERS`` or
more owners hold, or that stands in ``EXAMPLE_REPOSITORIES`` or more repositories (an
owner's template, say), is a widely copied example; a value of fewer of
both that looks random is an owner-specific live-looking credential.

Base kinds (assign, access, hex) are reported whatever their class.  Of the
``vendor`` kind, which the method adds (provider prefixes, bearer tokens,
private-key headers), only owner-specific live-looking ones are.

Scale: one pass over the texts writes a table without texts (id, row key, spans);
all counting and joining is on that table.  Counts combine before the shuffle,
and the join of candidates with their counts is a plain equi-join that Spark
splits where one value has a third of the candidates.

Defined results: null or empty text: no spans.  Repeated rows are reported
each.  Null source is an owner of its own.  Spans of one row are gathered in
one array, which the row's own text bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, row_key, stored

# The base kinds in their order, then the kind that the method adds.
KINDS = ("assign", "access", "hex", "vendor")
ASSIGN = (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
VENDOR = (r"(?:ghp_|gho_|glpat-|xoxb-|xoxp-|sk_live_|rk_live_|AIza)[A-Za-z0-9_-]{16,}"
          r"|[Bb]earer\x20+[A-Za-z0-9._~+/-]{16,}|-----BEGIN [A-Z ]*PRIVATE KEY-----")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|dummy|your[_-]|x{4}|0{8}|12345"
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 6
LEAST_DISTINCT = 6  # distinct characters of a live-looking value

SPAN = "array<struct<start:int,kind:int,stop:int,secret:string>>"


def _spans(text: Column, kind: int, regex: str, secret=None, keep=None) -> Column:
    """Leftmost non-overlapping matches with code-point spans, from the matches and the pieces between them."""
    none = F.array().cast(SPAN)

    def placed(found: Column) -> Column:
        def walk(pieces: Column) -> Column:
            zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

            def step(acc: Column, i: Column) -> Column:
                start = acc["at"] + F.length(pieces[i])
                stop = start + F.length(found[i])
                span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"),
                                (secret(found[i]) if secret else found[i]).alias("secret"))
                return F.struct(stop.alias("at"), F.array_append(acc["out"], span).alias("out"))
            out = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step, lambda acc: acc["out"])
            return F.filter(out, keep) if keep else out
        return F.when(F.size(found) == 0, none).otherwise(let(F.split(text, regex, -1), walk))
    return let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), placed)


def candidates(text: Column) -> Column:
    """All spans of a text by (start, kind); ``secret`` is what is hashed.

    A run of hex digits or of an access key is maximal, so asking for its least
    length in the pattern finds the same runs as dropping short ones after; an
    assignment's least length is tested after, as a failing match uses up its text.
    """
    value = lambda m: F.regexp_extract(m, ASSIGN, 2)
    parts = [
        _spans(text, 0, ASSIGN, value, lambda s: F.length(s["secret"]) >= ASSIGN_LEAST),
        _spans(text, 1, rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}"),
        _spans(text, 2, rf"[0-9a-f]{{{HEX_LEAST},}}"),
        _spans(text, 3, VENDOR),
    ]
    return F.array_sort(F.concat(*parts))


def live_looking(secret: Column) -> Column:
    """Not a placeholder, and enough distinct characters."""
    return ~F.rlike(secret, F.lit(PLACEHOLDER)) & (F.size(F.array_distinct(F.split(secret, ""))) >= LEAST_DISTINCT)


def scan(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One row a row of ``docs``: doc_id, spans (start, kind, stop, sha256, n_repositories, n_owners, verdict).

    ``verdict``: ``example`` (widely copied), ``live`` (owner-specific and
    live-looking) or ``weak``.  Vendor spans that are not live are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("key"), F.coalesce(repository, F.lit("")).alias("repository"),
                       F.coalesce(owner, F.lit("")).alias("owner"), candidates(text).alias("spans"))
    hashed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"),
                                                     F.sha2(s["secret"], 256).alias("sha256"), live_looking(s["secret"]).alias("live")))
    rows = stored(rows.withColumn("spans", hashed), "secret-spans")
    found = rows.select("doc_id", "key", "repository", "owner", F.explode("spans").alias("s"))
    counts = found.select(F.col("s.sha256").alias("sha256"), "repository", "owner").distinct() \
        .groupBy("sha256").agg(F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"))
    known = found.select("doc_id", "key", "s.*").join(counts, "sha256")
    copied = (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repositories") >= EXAMPLE_REPOSITORIES)
    verdict = F.when(copied, "example").when(F.col("live"), "live").otherwise("weak")
    known = known.withColumn("verdict", verdict).where((F.col("kind") < 3) | (F.col("verdict") == "live"))
    # A set, as repeated rows bring the same spans again.
    gathered = known.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct(
        "start", "kind", "stop", "sha256", "n_repositories", "n_owners", "verdict"))).alias("spans"))
    gathered = gathered.select(F.col("doc_id").alias("g_id"), F.col("key").alias("g_key"), "spans")
    same = F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("key") == F.col("g_key"))
    empty = F.array().cast(gathered.schema["spans"].dataType)
    return rows.drop("spans").join(gathered, same, "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """The contract's digest, with ``source`` as owner and (source, lang) as repository; the last two columns are the most
    owners and repositories that share one of the row's secrets (0 without spans)."""
    out = scan(docs, F.concat_ws("/", "source", "lang"), F.col("source"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    of = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    most = lambda c: F.coalesce(F.array_max(F.transform("spans", lambda s: s[c])), F.lit(0)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                      F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
                      of("live").alias("n_live"), of("example").alias("n_example"), most("n_owners").alias("most_owners"),
                      most("n_repositories").alias("most_repositories"))
