"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit set where over half of the document's shingle hashes
have it.  The 64 bits are two segments of 32; within each, the Hamming ball
around the fingerprint is enumerated with the other segment as it is.  The
table is keyed by the ball's points, and what one cell holds is verified by
its complete distance.

Two prints at most k bits apart share a point that is within ceil(k / 2) of one
and floor(k / 2) of the other, so no link is lost; for k = 2 a cell's prints are
all within two bits of each other, there are 65 at most, and each
links with the cell's smallest.  So there is no pair list that grows with the
square of a group, copies share one print before anything is enumerated,
and cells are bounded by the ball.  (With 2 bits the joint key does what two
per-segment tables do, but a segment value that many prints share is no group.)

Defined results: null or empty text, or only white space: fingerprint zero,
linked like any other.  Repeated rows and null ids are kept; component_id is
the smallest non-null doc_id of the component (null if it has none).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import append_columns, row_key, stored
from .components import connected

SHINGLE_WORDS, MAX_BITS, SEED = 3, 2, 42
SEGMENTS = ((0, 32), (32, 64))
PRINT = "__llm_print long"


def _fingerprint(text: str | None, width: int) -> int:
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and the contract's white space only
    if not words:
        return 0
    shingles = max(1, len(words) - width + 1)
    ones, blank = np.zeros(64, dtype=np.int64), b" "
    for at in range(0, shingles, 1 << 16):
        last = min(shingles, at + (1 << 16))
        hashes = [xxh64_intdigest(blank.join(words[i:i + width]), SEED) for i in range(at, last)]
        raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > shingles, bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with __llm_print, the fingerprint as a signed long."""
    return append_columns(docs, PRINT, lambda texts: [(_fingerprint(t, width),) for t in texts], "text")


def _ball(radius: int) -> list[int]:
    """Masks of up to ``radius`` bits, segment by segment; those over both segments follow from radius 2 on."""
    near = [tuple(c) for n in range(radius + 1) for lo, hi in SEGMENTS for c in combinations(range(lo, hi), n)]
    across = [c for n in range(2, radius + 1) for c in combinations(range(64), n)]
    masks = {sum(1 << b for b in c) for c in near + across}
    return sorted(m - (1 << 64) if m >> 63 else m for m in masks)


def components_of_prints(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(print, root) for every distinct value of ``print``: prints linked, over any chain, by at most ``max_bits`` bits."""
    near, far = max_bits // 2, (max_bits + 1) // 2
    own = prints.select("print").distinct()
    points = own.select("print", F.explode(F.array(*map(F.lit, _ball(far)))).alias("mask"))
    points = points.select("print", F.col("print").bitwiseXOR(F.col("mask")).alias("point"), F.bit_count("mask").alias("away"))
    hub = F.min(F.when(F.col("away") <= near, F.col("print"))).over(Window.partitionBy("point"))
    met = points.withColumn("hub", hub).where("hub <> print")
    links = met.where(F.bit_count(F.col("print").bitwiseXOR(F.col("hub"))) <= max_bits)
    roots = connected(links.select("print", "hub"), "print", "hub")
    return own.join(roots, own["print"] == roots["node"], "left").select("print", F.coalesce("root", "print").alias("root"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row a row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    light = stored(with_fingerprints(docs.select("doc_id", "text"), width).select("doc_id", F.col("__llm_print").alias("print")), "prints")
    groups = light.groupBy("print").agg(F.min("doc_id").alias("least"))
    rooted = stored(groups.join(components_of_prints(groups, max_bits), "print"), "print-roots")
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(first, "root").select("print", "component_id")
    return light.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: the one of smallest doc_id (null last), then smallest row key."""
    keyed = docs.withColumn("__llm_key", row_key("doc_id", "text"))
    light = with_fingerprints(keyed.select("doc_id", "__llm_key", "text"), width).select(
        "doc_id", F.col("__llm_key").alias("key"), F.col("__llm_print").alias("print"))
    light = stored(light, "prints")
    # Null ids last: a struct sorts null first, so its first field says null or not.
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    groups = light.groupBy("print").agg(F.min(order).alias("least"))
    rooted = stored(groups.join(components_of_prints(groups, max_bits), "print"), "print-roots")
    kept = rooted.groupBy("root").agg(F.min("least").alias("k")) \
        .select(F.col("k.doc_id").alias("k_id"), F.col("k.key").alias("k_key"))
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("__llm_key") == F.col("k_key"))
    # Repeated rows share id and key; one of them stays.
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__llm_key"]).select(*docs.columns)
