"""Quality by compression: one zstandard dictionary of good and one of bad text.

A text is cut into blocks of ``BLOCK`` bytes, all of them are compressed with
either dictionary, and the normalised difference (bad - good) / (bad + good) of
the summed sizes is calibrated to a score.  What a difference means depends on
how well the text compresses at all (repetitive text is small either way) and on its
length (a few words say little), so the calibration is a logistic surface of
second order over the difference, the log of the compressed share and the log
of the length, set to the classes' shares among the labelled rows.

Fitting uses a bounded sample of labelled rows, picked by a hash of the id:
at most ``SAMPLE_BLOCKS`` blocks a class (from ``SAMPLE_DOCS`` documents a
class) for the dictionaries and, from other documents, ``SAMPLE_DOCS`` rows a
class for the surface.  Scoring covers every row and all of its text, without a
shuffle.

Defined results: null or empty text has difference, log share and length 0; without labels of both
classes the score is the smoothed share of label 1 (0.5 without any); labels
of null id or quality are left out; a document with contradicting labels
counts for both; a null doc_id is not held out.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns

BLOCK = 2048
SAMPLE_DOCS = 4000
SAMPLE_BLOCKS = 2000
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
RIDGES = (0.01, 0.1, 0.3, 1.0, 3.0)


class Model(NamedTuple):
    good: bytes
    bad: bytes
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    offset: float


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _dictionary(blocks: list[bytes]) -> bytes:
    import zstandard as z

    try:
        return z.train_dictionary(DICTIONARY_BYTES, blocks, k=256, d=8).as_bytes()
    except z.ZstdError:  # too few samples to train on: their text itself is the dictionary
        return b"".join(blocks)[-DICTIONARY_BYTES:]


def _sizer(dictionary: bytes):
    import zstandard as z

    if not dictionary:
        c = z.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
    else:
        data = z.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=LEVEL)
        c = z.ZstdCompressor(dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)
    return lambda block: len(c.compress(block))


def _measures(good: bytes, bad: bytes):
    """texts -> (normalised size difference, log of the compressed share, log of the length) of each; the compressors
    are made once a task."""
    made: list = []

    def run(texts: list) -> list[tuple[float, float, float]]:
        if not made:
            made.extend((_sizer(good), _sizer(bad)))
        by_good, by_bad = made
        out = []
        for text in texts:
            data = (text or "").encode("utf-8", "replace")
            blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
            g, b = sum(map(by_good, blocks)), sum(map(by_bad, blocks))
            out.append(((b - g) / (b + g), math.log(g / len(data)), math.log(len(data))) if blocks else (0.0, 0.0, 0.0))
        return out
    return run


def _terms(m: tuple[float, float, float]) -> list[float]:
    """All terms of first and second order."""
    return [*m, *(m[i] * m[j] for i in range(3) for j in range(i, 3))]


def _newton(a, y, ridge: float):
    """Weights of a ridge logistic regression; a step that goes too far is halved."""
    import numpy as np
    w = np.zeros(a.shape[1])

    def loss(w):
        z = a @ w
        return np.logaddexp(0, z).sum() - y @ z + ridge * (w @ w) / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step, now = np.linalg.solve(h, a.T @ (p - y) + ridge * w), loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _surface(rows: list[tuple], ys: list[int], shares: dict[int, int]) -> tuple:
    """Ridge logistic regression of the terms: (means, scales, weights, offset); the ridge with the least loss over
    five parts of the sample.

    The sample holds the classes in other shares than the labelled rows do
    (``shares``: rows of each class); the offset is moved by the difference.
    """
    import numpy as np
    counts = {y: ys.count(y) for y in (0, 1)}
    if not (counts[0] and counts[1]):
        p = (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
        return (), (), (), math.log(p / (1 - p))
    x, y = np.array([_terms(r) for r in rows]), np.array(ys, dtype=float)
    means, scales = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    a, part = np.column_stack([(x - means) / scales, np.ones(len(x))]), np.arange(len(x)) % 5

    def left_out(ridge):
        z = np.concatenate([a[part == k] @ _newton(a[part != k], y[part != k], ridge) for k in range(5)])
        t = np.concatenate([y[part == k] for k in range(5)])
        return np.logaddexp(0, z).sum() - t @ z
    w = _newton(a, y, min(RIDGES, key=left_out))
    moved = math.log(shares[1] / shares[0]) - math.log(counts[1] / counts[0])
    return tuple(means.tolist()), tuple(scales.tolist()), tuple(w[:-1].tolist()), float(w[-1] + moved)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Dictionaries from labelled rows of fold 0, the surface from fold 2; fold 1 is never read."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    known = known.select("doc_id", F.col("quality").cast("int").alias("y"), fold(F.col("doc_id")).alias("fold")).where("fold <> 1").distinct()
    counts = {(r.fold, r.y): r["count"] for r in known.groupBy("fold", "y").count().collect()}

    def pick(f: int, y: int) -> DataFrame:
        """The class's first ``SAMPLE_DOCS`` ids by hash; a uniform cut first, so that not every partition brings as many."""
        share = min(1.0, 1.2 * SAMPLE_DOCS / max(1, counts.get((f, y), 0)))
        few = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30)))
        return known.where((F.col("fold") == f) & (F.col("y") == y) & few).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    ids = pick(0, 0).union(pick(0, 1)).union(pick(2, 0)).union(pick(2, 1))
    # At most 4 * SAMPLE_DOCS ids, whatever the input.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text <> ''") \
        .select("y", "fold", "text", F.xxhash64("doc_id", "text").alias("h"))

    def blocks_of(y: int) -> list[bytes]:
        at = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / BLOCK).cast("int")))
        cut = rows.where((F.col("fold") == 0) & (F.col("y") == y)).select("h", "text", at.alias("i"))
        cut = cut.select("h", "i", F.substring("text", F.col("i") * BLOCK + 1, F.lit(BLOCK)).alias("b"))
        top = cut.orderBy(F.xxhash64("h", "i"), "h", "i").limit(SAMPLE_BLOCKS)
        return [r.b.encode("utf-8", "replace") for r in top.collect()]

    good, bad = _dictionary(blocks_of(1)), _dictionary(blocks_of(0))
    measure = _measures(good, bad)
    names = ("__llm_x", "__llm_r", "__llm_n")
    held = append_columns(rows.where("fold = 2"), ", ".join(f"{n} double" for n in names), measure, "text")
    sample = [held.where(F.col("y") == y).orderBy("h").limit(SAMPLE_DOCS).select(*names, "y") for y in (0, 1)]
    got = sample[0].union(sample[1]).collect()
    shares = {y: counts.get((2, y), 0) for y in (0, 1)}
    return Model(good, bad, *_surface([tuple(r)[:3] for r in got], [r.y for r in got], shares))


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with __llm_score in 0..1."""
    measure = _measures(model.good, model.bad)

    def score(texts):
        out = []
        for m in measure(texts):
            terms = zip(_terms(m), model.means, model.scales, model.weights, strict=False)  # none without both classes
            z = model.offset + sum((t - mean) / scale * w for t, mean, scale, w in terms)
            out.append((1 / (1 + math.exp(-max(-30.0, min(30.0, z)))),))
        return out
    return append_columns(docs, "__llm_score double", score, "text")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
                         F.col("__llm_score").alias("score"), (F.col("__llm_score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects (score under 0.5)."""
    return with_scores(docs, fit(docs, labels)).where("__llm_score >= 0.5").select(*docs.columns)
