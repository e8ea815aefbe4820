"""op3 against brute force over all windows."""

import hashlib
import random

from pyspark.sql import functions as F

from trafficlens.llm import repeats
from trafficlens.llm.queries import op3
from trafficlens.session import scratch_path
from tests.conftest import SMOKE


def brute(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha) by windows in document order (null ids last, then table order)."""
    seen, out = set(), {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        data = (rows[i][1] or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s:s + length]
            if w in seen:
                gone[s:s + length] = b"\x01" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (rows[i][0], len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted(out.values(), key=str)


def check(spark, rows, parts):
    """Compare on a stored table of several scan partitions."""
    path = scratch_path(spark, "repeat-test")
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, doc_id long, text string") \
        .repartitionById(parts, (F.col("n") * parts / len(rows)).cast("int")) \
        .sortWithinPartitions("n").drop("n").write.parquet(path)
    docs = spark.read.parquet(path)
    table = [tuple(r) for r in docs.collect()]
    assert sorted(table, key=str) == sorted(rows, key=str)
    got = sorted((tuple(r) for r in repeats.report(docs).collect()), key=str)
    assert got == brute(table)
    return got


def test_query_on_whole_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op3(spark, SMOKE).collect()), key=str)
    assert got == brute(rows)
    assert sum(g[2] for g in got) > 0


def test_shared_passages_runs_and_near_copies(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 3000)
    monkeypatch.setattr(repeats, "PIECE", 700)
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdefgh é\n") for _ in range(n))
    passages = [text(n) for n in (99, 100, 101, 130, 250, 900)]
    base = text(2500)
    rows = []
    for i in range(60):
        t = text(rnd.randint(0, 300))
        for _ in range(rnd.randint(0, 4)):
            t += rnd.choice(passages)[rnd.randint(0, 20):] + text(rnd.randint(0, 60))
        if i % 5 == 0:  # near copies
            at = rnd.randint(0, len(base))
            t = base[:at] + "X" + base[at:]
        rows.append((rnd.choice([i, i, 7, None]), t))
    rows += [(70, "a" * 700), (71, "ab" * 300), (72, "a" * 99), (73, "a" * 100), (3, "a" * 150), (80, None), (81, ""), (82, base), (82, base), (None, base)]
    rnd.shuffle(rows)
    got = check(spark, rows, 7)
    assert sum(g[3] > 1 for g in got) > 5


def test_one_partition_and_empty(spark):
    rnd = random.Random(2)
    t = "".join(rnd.choice("xyz") for _ in range(400))
    check(spark, [(2, t), (1, t[50:] + t), (3, "short")], 1)
    docs = spark.createDataFrame([], "doc_id long, text string, __llm string")
    assert repeats.report(docs).count() == 0
    kept = repeats.remove_repeats(spark.createDataFrame([(1, t, "x")], "doc_id long, text string, n_bytes string").coalesce(1))
    assert bytes(kept.first()["__llm_kept"]).decode() == t and kept.columns[:3] == ["doc_id", "text", "n_bytes"]
