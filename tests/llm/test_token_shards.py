"""op4: the permutation is one, shards read back to the very documents, and reruns agree."""

import base64
import zlib

import numpy as np
import pytest
import tiktoken

from trafficlens.llm import token_shards as ts
from trafficlens.llm.queries import op4
from trafficlens.session import scratch_path
from tests.conftest import SMOKE


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    slots = ts.slots_of(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert ts.slots_of(slots, n, inverse=True).tolist() == list(range(n))
    if n > 100:
        assert slots.tolist() != ts.slots_of(np.arange(n), n, key=1).tolist() and abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.2


def decoded(rows, length):
    """Texts in stream order from (slot, tokens) rows."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ts.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=ts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    n = len(rows)
    by_seq = dict(zip(ts.slots_of([r.slot for r in rows], n, inverse=True).tolist(), (bytes(r.tokens) for r in rows), strict=True))
    stream = np.frombuffer(b"".join(by_seq[i] for i in range(n)), dtype="<u2")
    ends = np.flatnonzero(stream == ts.END_MARK)
    return [enc.decode(part[part != ts.END_MARK].tolist()) for part in np.split(stream, ends + 1)]


def test_round_trip(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text")
    folder = scratch_path(spark, "shards")
    made = ts.write_shards(docs, folder, length=256, per_shard=100)
    n = made.count()
    rows = ts.read_slots(spark, folder, 0, n, length=256, per_shard=100).collect()
    assert sorted(r.slot for r in rows) == list(range(n))
    texts = decoded(rows, 256)
    want = [r.text or "" for r in docs.collect()]
    assert texts[:len(want)] == want and not any(texts[len(want):])
    some = ts.read_slots(spark, folder, 150, 270, length=256, per_shard=100).collect()
    assert {r.slot: bytes(r.tokens) for r in some} == {r.slot: bytes(r.tokens) for r in rows if 150 <= r.slot < 270}
    again = ts.write_shards(docs, folder, length=256, per_shard=100)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, made.collect()), key=str)
    ids = {i for r in made.collect() for i in r.doc_ids}
    assert ids == {r.doc_id for r in docs.collect()}


def test_query(spark):
    rows = op4(spark, SMOKE).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) == sorted(r.seq for r in rows)
    assert all(r.byte_offset == r.slot % ts.SHARD_SEQUENCES * ts.SEQUENCE_TOKENS * 2 for r in rows)
    for r in rows[:20]:
        with open(r.file.removeprefix("file:"), "rb") as f:
            f.seek(r.byte_offset)
            assert zlib.crc32(f.read(r.n_tokens * ts.ID_BYTES)) == r.crc32


def test_edge_rows(spark):
    rows = [(1, None, 1), (None, "", 2), (3, "same", 3), (3, "same", 3), (4, "long text " * 60000, 4), (5, "<|endoftext|> é \U0001f600", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot long").repartition(3, "doc_id")
    docs.write.parquet(path := scratch_path(spark, "edge"))
    docs = spark.read.parquet(path)
    folder = scratch_path(spark, "shards")
    made = ts.write_shards(docs, folder, length=64, per_shard=50)
    got = decoded(ts.read_slots(spark, folder, 0, made.count(), length=64, per_shard=50).collect(), 64)
    assert got[:len(rows)] == [r.text or "" for r in docs.collect()]
    assert None in {i for r in made.collect() for i in r.doc_ids}
    assert ts.write_shards(docs.limit(0), folder).count() == 0


@pytest.mark.parametrize("chars", ["a 's", "ab \n\t", " \n\u00a0\u2003x1.", "é ß,.;\U0001f600 '", "0 12aé\r\n", "ab\x1c\x85\u200b "])
def test_both_patterns_encode_alike(chars):
    rng = np.random.default_rng(7)
    ranks = open(ts.VOCABULARY, "rb").read()
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    whole = tiktoken.Encoding("t", pat_str=ts.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    encode = ts._encoder(ranks)
    for _ in range(1500):
        text = "".join(rng.choice(list(chars), size=rng.integers(0, 25)))
        assert encode(text) == whole(text), repr(text)


def test_tasks_write_several_shards(spark):
    """Small shards are more than there are tasks: the same slots, in more files."""
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text")
    few, many = scratch_path(spark, "shards"), scratch_path(spark, "shards")
    n = ts.write_shards(docs, few, length=256, per_shard=1000).count()
    made = ts.write_shards(docs, many, length=256, per_shard=7)
    assert made.select("shard").distinct().count() == -(-n // 7) > 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = lambda folder, per: {r.slot: bytes(r.tokens) for r in ts.read_slots(spark, folder, 0, n, length=256, per_shard=per).collect()}
    assert slots(few, 1000) == slots(many, 7) and len(slots(many, 7)) == n
