"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a token target: its weight's share of all tokens, at most
``max_epochs`` times its own size, the excess reshared by weight.  A source's
documents form a token stream in a seedless hash order, repeated until the
target is met; the last pass ends inside one document.  The source's weight
schedule m(t) over training time [0, 1] is integrated to a cumulative demand
D(t) = target * (integral of m to t) / (integral of m to 1); a document copy
that starts at token c of its stream is trained at the time t with D(t) = c.
``training_order`` range-sorts the copies by that time.

Scale: only (key, source, size) rows move for the plan.  A source's stream is
cut by the hash into ``BUCKETS`` stretches; their offsets are prefix sums of a
table of at most BUCKETS rows a source, and the running sum inside a stretch
is a window on (source, stretch), so a source with a third of all rows is
spread over BUCKETS groups.  The sources themselves are a catalogue with a
weight each; its water level is one window over one row a source.

Defined results: null text has size 0; a document of size 0 takes 0; null
source is a source of its own, last in order; repeated rows are documents of
their own; null doc_id is allowed; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, let, stored, word_count

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Schedules by weight class: (time, multiplier) knots, linear between them.  The light
#: sources fade out, the heavy ones fade in.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
HEX_DIGITS = 3  # 16 ** 3 stretches a source
BUCKETS = 16 ** HEX_DIGITS


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with __llm_size, __llm_key (order key, 32 hex digits) and __llm_source (never null)."""
    return docs.withColumns({
        "__llm_size": word_count(F.col("text")),
        "__llm_key": F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                                       F.md5(F.coalesce(F.col("text"), F.lit(""))))),
        "__llm_source": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")),
    })


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(__llm_source, source, source_size) -> with rank, weight and target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ws = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ws = ws.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    ws = ws.withColumn("cap", F.col("source_size") * max_epochs)
    ws = ws.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "rank")
    all_rows = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ws = ws.withColumn("level", (F.sum("source_size").over(all_rows) - capped).cast("double") / rest)
    # The lowest ratio that its own level does not exceed: everything before it is capped.
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(all_rows)
    ws = ws.withColumn("target", F.least(level * F.col("weight"), F.col("cap").cast("double")))
    return ws.select("__llm_source", "source_size", "rank", "weight", "target")


def _segments(knots) -> list[tuple]:
    """(demand at start, at end, time, multiplier at start, slope, total) of each linear piece; demand in 0..1."""
    areas = [(t1 - t0) * (m0 + m1) / 2 for (t0, m0), (t1, m1) in zip(knots, knots[1:], strict=False)]
    total, done, out = sum(areas), 0.0, []
    for ((t0, m0), (t1, m1)), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        out.append((done / total, (done + area) / total, t0, m0, (m1 - m0) / (t1 - t0), total))
        done += area
    return out


def training_time(share: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """Inverse of the integrated schedule of the source's class at ``share`` (0..1) of its demand."""
    names = ("q0", "q1", "t", "m", "slope", "total")
    tables = F.array(*[F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(names, s, strict=True)])
                                 for s in _segments(knots)]) for knots in schedules])
    pieces = F.element_at(tables, (rank % len(schedules) + 1).cast("int"))

    def solve(q: Column) -> Column:
        piece = F.coalesce(F.get(F.filter(pieces, lambda s: s["q1"] >= q), F.lit(0)), F.element_at(pieces, -1))

        def inside(s: Column) -> Column:
            area = F.greatest((q - s["q0"]) * s["total"], F.lit(0.0))
            root = s["m"] + F.sqrt(F.greatest(s["m"] * s["m"] + 2 * s["slope"] * area, F.lit(0.0)))
            return s["t"] + F.when(root > 0, 2 * area / root).otherwise(0.0)
        return let(piece, inside)
    return let(share, solve)


def mix_plan(rows: DataFrame, light: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
             schedules=SCHEDULES) -> DataFrame:
    """``rows`` (from ``sized``) with size, source_size, target, taken, n_copies and positions.

    ``light`` holds the __llm_ columns and source of the same rows, stored, so
    that sizes are counted once.  ``taken`` counts words over all copies; copy
    k of a document is trained at ``positions[k]``; the last one may be cut.
    """
    def cut(df: DataFrame) -> DataFrame:
        return df.withColumn("__llm_bucket", F.substring("__llm_key", 1, HEX_DIGITS))

    buckets = cut(light).groupBy("__llm_source", "__llm_bucket") \
        .agg(F.sum("__llm_size").alias("n"), F.first("source").alias("source"))
    buckets = stored(buckets, "mix-buckets")
    sizes = buckets.groupBy("__llm_source").agg(F.sum("n").alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(sizes, weights, max_epochs)
    before = Window.partitionBy("__llm_source").orderBy("__llm_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("__llm_source", "__llm_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    offsets = stored(offsets.join(targets, "__llm_source"), "mix-offsets")

    joined = cut(rows).join(offsets.select("__llm_source", "__llm_bucket", *[F.col(c).alias(f"__llm_{c}") for c in (
        "offset", "source_size", "rank", "target")]), ["__llm_source", "__llm_bucket"])
    inside = Window.partitionBy("__llm_source", "__llm_bucket").orderBy("__llm_key", "__llm_size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    size, total, target = F.col("__llm_size"), F.col("__llm_source_size"), F.col("__llm_target")
    start = F.col("__llm_offset") + F.coalesce(F.sum("__llm_size").over(inside), F.lit(0))
    joined = joined.withColumn("__llm_start", start)
    demand = F.round(target).cast("long")
    whole = F.when(total > 0, F.floor(demand / total)).otherwise(0)
    part = F.least(F.greatest(demand - whole * total - F.col("__llm_start"), F.lit(0)), size)
    joined = joined.withColumns({"__llm_whole": F.when(size > 0, whole).otherwise(0), "__llm_part": part})
    copies = (F.col("__llm_whole") + F.when(F.col("__llm_part") > 0, 1).otherwise(0)).cast("int")
    share = lambda k: (k * total + F.col("__llm_start")) / target
    positions = F.when(copies > 0, F.transform(
        F.sequence(F.lit(0), copies - 1), lambda k: training_time(share(k), F.col("__llm_rank"), schedules))) \
        .otherwise(F.array().cast("array<double>"))
    return joined.withColumns({"__llm_taken": (F.col("__llm_whole") * size + F.col("__llm_part")).cast("long"),
                               "__llm_copies": copies, "__llm_positions": positions})


def light_rows(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, source, size, key) rows of ``docs``: no text."""
    return stored(sized(docs.select("doc_id", "text", "source")).drop("text"), "mix-light")


def mix_report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, n_copies, position; sorted by position
    (the time of its first copy; null, last, where nothing is taken)."""
    light = light_rows(docs)
    plan = mix_plan(light, light)
    out = plan.select("doc_id", F.col("__llm_size").alias("size"), F.col("__llm_source_size").alias("source_size"),
                      F.col("__llm_target").alias("target"), F.col("__llm_taken").alias("taken"),
                      F.col("__llm_copies").alias("n_copies"), F.get("__llm_positions", F.lit(0)).alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def training_order(docs: DataFrame) -> DataFrame:
    """The mix itself: one row a copy with the columns of ``docs``, range-sorted by training time.

    The one copy of a source that its target cuts keeps its first words,
    space-joined; n_chars, if there, follows the text.
    """
    plan = mix_plan(sized(docs), light_rows(docs))
    rows = plan.select(*docs.columns, "__llm_whole", "__llm_part", "__llm_key", "__llm_size",
                       F.posexplode("__llm_positions").alias("__llm_copy", "__llm_time"))
    cut = (F.col("__llm_copy") == F.col("__llm_whole")) & (F.col("__llm_part") < F.col("__llm_size"))
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("__llm_part").cast("int")), " ")
    text = F.when(cut, head).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return rows.orderBy("__llm_time", "__llm_key", "__llm_copy").select(*docs.columns)
