"""Token ids in training order: fixed-stride binary shards behind a keyed permutation.

All documents, each closed by an end mark, form one token stream in the order
of the table's partitions; it is cut into sequences of ``length`` tokens, the
last one filled up with end marks.  A keyed Feistel network over the next
even number of bits, walked along its cycle until it falls below the number of
sequences, gives sequence i its slot: a permutation without any table, that a
reader can invert.  Shard k holds the slots [k * per_shard, (k + 1) * per_shard),
each as ``length`` little-endian ids of ``ID_BYTES`` bytes, so slot s lies at
byte (s mod per_shard) * stride of its shard, and a reader resumes anywhere.

Scale: a first pass counts the tokens of each partition (three numbers a
partition come to the driver); a second tokenises again and sends each
sequence straight to the task that writes its shard, so tokens are shuffled once
and never stored beside the shards.  A task writes a range of shards, one file
after the other, so there are as many tasks as the session shuffles into, or
as shards if those are fewer.  No row count, key or group decides where a
sequence goes.  A shard's file appears under its name when it is whole, and
its bytes depend on nothing but the input and the key: a task that runs again,
after an executor is lost, puts the same file there.  ``docs`` must be a scan (or
anything else whose partitions come out alike twice); the second pass checks
its counts against the first.

Defined results: null or empty text is an end mark alone; null ids are kept
as null in doc_ids; repeated rows are documents of their own; an empty table
gives no sequence and no shard.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.session import scratch_path

from .common import arrow_schema, map_batches, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's byte-level BPE cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where no two white space characters stand together the pattern's look-ahead never matters, and
#: without it the cutting needs no backtracking.
SINGLE_SPACED = PATTERN.replace(r"\s+(?!\S)|\s+", r"\s")
END_MARK = 50256
ID_BYTES = 2
SEQUENCE_TOKENS = 2048
SHARD_SEQUENCES = 4096  # 16 MiB a shard
KEY = 0x5EED
ROUNDS = 6
GROUP_TOKENS = 1 << 19  # tokens that a task holds at once, or one document's
MASK = (1 << 64) - 1
SEQUENCE = "slot long, seq long, at int, tokens binary, doc_ids array<long>"
MANIFEST = "slot long, seq long, shard long, byte_offset long, n_tokens int, crc32 long, doc_ids array<long>"


# --- the permutation -------------------------------------------------------

def _mix(x, key: int):
    """64 bits in, 64 well-mixed bits out (numpy, wrapping)."""
    import numpy as np
    with np.errstate(over="ignore"):
        x = x + np.uint64(key & MASK)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _feistel(x, half: int, keys: list[int]):
    """A permutation of 2 * half bits; with the keys in the other order and the halves swapped, its inverse."""
    import numpy as np
    low = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & low
    for k in keys:
        left, right = right, left ^ (_mix(right, k) & low)
    return (left << np.uint64(half)) | right


def _round_keys(key: int) -> list[int]:
    return [(key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1) & MASK for r in range(ROUNDS)]


def slots_of(seq, n: int, key: int = KEY, inverse: bool = False):
    """Slots of the sequence numbers ``seq`` among ``n`` (or, inverted, the numbers of slots)."""
    import numpy as np
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    keys = _round_keys(key)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def step(x):
        if not inverse:
            return _feistel(x, half, keys)
        y = _feistel(((x & low) << shift) | (x >> shift), half, keys[::-1])
        return ((y & low) << shift) | (y >> shift)
    x = step(np.asarray(seq, dtype=np.uint64))
    while (out := x >= n).any():  # cycle-walking: four tries each on average at most
        x[out] = step(x[out])
    return x.astype(np.int64)


# --- tokens ----------------------------------------------------------------

@lru_cache(maxsize=1)
def _encoder(ranks: bytes) -> Callable[[str], list[int]]:
    """text -> token ids; one encoder a Python worker."""
    import base64

    import tiktoken
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    whole, single = (tiktoken.Encoding(name, pat_str=p, mergeable_ranks=table, special_tokens={}).encode_ordinary
                     for name, p in (("whole", PATTERN), ("single", SINGLE_SPACED)))
    spaces = re.compile(r"\s\s").search
    return lambda text: whole(text) if spaces(text) else single(text)


def _token_groups(batches, ranks: bytes) -> Iterator[tuple[list, list, object]]:
    """(ids, tokens of each with its end mark, all their tokens) of groups of about ``GROUP_TOKENS`` tokens."""
    import numpy as np
    encode = _encoder(ranks)
    ids, sizes, stream = [], [], array("H")
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            value = text.as_py()
            before = len(stream)
            if value:
                stream.extend(encode(value))
            stream.append(END_MARK)
            ids.append(doc_id.as_py())
            sizes.append(len(stream) - before)
            if len(stream) >= GROUP_TOKENS:
                yield ids, sizes, np.array(stream).astype("<u2")
                ids, sizes, stream = [], [], array("H")
    if ids:
        yield ids, sizes, np.array(stream).astype("<u2")


def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{path}: {len(data)} bytes are too many for a vocabulary that every task gets")
    return data


def _counts(docs: DataFrame, ranks) -> dict[int, tuple[int, int]]:
    """partition -> (documents, tokens); one row a partition reaches the driver."""
    def count(batches):
        import pyarrow as pa
        n = tokens = 0
        encode = _encoder(ranks.value)
        for batch in batches:
            n += len(batch)
            for text in batch.column(1):
                value = text.as_py()
                tokens += len(encode(value)) + 1 if value else 1
        yield pa.RecordBatch.from_pydict({"pid": pa.array([TaskContext.get().partitionId()], pa.int64()),
                                          "docs": pa.array([n], pa.int64()), "tokens": pa.array([tokens], pa.int64())})
    return {r.pid: (r.docs, r.tokens) for r in map_batches(docs, count, "pid long, docs long, tokens long").collect()}


def _pieces(docs: DataFrame, ranks, places, total: int, length: int, key: int) -> DataFrame:
    """Rows of ``SEQUENCE``: a sequence, or the piece of it that one batch of documents holds from token ``at`` on.
    ``places`` (broadcast): partition -> (tokens before it, its tokens)."""
    n, schema = -(-total // length), arrow_schema(SEQUENCE)

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        pid = TaskContext.get().partitionId()
        first, expected = places.value.get(pid, (0, 0))
        at = first
        for ids, sizes, stream in _token_groups(batches, ranks.value):
            starts = at + np.concatenate([[0], np.cumsum(sizes)])
            stop = int(starts[-1])
            if stop == total:  # the very end
                stream = np.concatenate([stream, np.full(-total % length, END_MARK, dtype="<u2")])
            end = at + len(stream)
            seqs = np.arange(at // length, (end - 1) // length + 1)
            lo, hi = np.maximum(seqs * length, at), np.minimum((seqs + 1) * length, end)
            d0 = np.searchsorted(starts, lo, side="right") - 1
            d1 = np.searchsorted(starts[:-1], np.minimum(hi, stop), side="left")
            columns = [slots_of(seqs, n, key), seqs, (lo - seqs * length).astype(np.int32),
                       [stream[a:b].tobytes() for a, b in zip(lo - at, hi - at, strict=True)],
                       [ids[a:b] for a, b in zip(d0, d1, strict=True)]]
            for i in range(0, len(seqs), 2048):
                yield pa.RecordBatch.from_arrays([pa.array(c[i:i + 2048], f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            at = stop
        if at - first != expected:
            raise RuntimeError(f"partition {pid} gave {at - first} tokens and {expected} before: docs must be a repeatable scan")
    return map_batches(docs, cut, SEQUENCE)


# --- shards ----------------------------------------------------------------

def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _write(folder: str, length: int, per_shard: int):
    schema = arrow_schema(MANIFEST)

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        stride, ctx = length * ID_BYTES, TaskContext.get()
        out = shard = None
        begun: list | None = None  # slot, seq, bytes so far, doc ids
        temp = f"{base}/.{ctx.stageId()}-{ctx.partitionId()}-{ctx.taskAttemptId()}"  # a file at a time
        rows: list = []

        def end_sequence():
            slot, seq, data, ids = begun
            if len(data) != stride:
                raise RuntimeError(f"slot {slot} has {len(data)} bytes, not {stride}")
            out.write(data)
            rows.append((slot, seq, shard, slot % per_shard * stride, length, zlib.crc32(data), ids))

        def end_shard():
            out.close()
            store.move(temp, f"{base}/{shard_name(shard)}")

        def table():
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return got
        try:
            for batch in batches:
                for slot, seq, data, ids in zip(*[batch.column(c).to_pylist() for c in ("slot", "seq", "tokens", "doc_ids")], strict=True):
                    if begun and begun[0] == slot:
                        begun[2] += data
                        begun[3] += ids[1:] if begun[3] and ids and begun[3][-1] == ids[0] else ids
                        continue
                    if begun:
                        end_sequence()
                    wanted = begun[0] + 1 if begun else slot // per_shard * per_shard
                    if slot != wanted:
                        raise RuntimeError(f"slot {slot} follows where {wanted} should")
                    if slot % per_shard == 0:
                        if out is not None:
                            end_shard()
                        shard, out = slot // per_shard, store.open_output_stream(temp)
                    begun = [slot, seq, data, ids]
                if rows:
                    yield table()
            if begun:
                end_sequence()
                end_shard()
                yield table()
        finally:
            if out is not None and not out.closed:
                out.close()
    return write


def write_shards(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, length: int = SEQUENCE_TOKENS,
                 per_shard: int = SHARD_SEQUENCES, key: int = KEY) -> DataFrame:
    """Write the shards of ``docs`` (doc_id, text) under ``folder`` (seen by all executors) and return the stored
    manifest: slot, seq, shard, byte_offset, n_tokens, crc32, doc_ids (documents with tokens in the sequence)."""
    from pyarrow import fs
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(_vocabulary(vocabulary))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = _counts(rows, ranks)
    places, total = {}, 0
    for pid in sorted(counts):
        places[pid] = total, counts[pid][1]
        total += counts[pid][1]
    if not total:
        return spark.createDataFrame([], MANIFEST)
    store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    store.create_dir(base, recursive=True)
    pieces = _pieces(rows, ranks, spark.sparkContext.broadcast(places), total, length, key)
    shards = -(-(-(-total // length)) // per_shard)
    tasks = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    task = F.floor(F.floor(F.col("slot") / per_shard) * tasks / shards).cast("int")
    placed = pieces.repartitionById(tasks, task).sortWithinPartitions("slot", "at")
    return stored(map_batches(placed, _write(folder, length, per_shard), MANIFEST), "shard-manifest")


def read_slots(spark: SparkSession, folder: str, first: int, last: int, length: int = SEQUENCE_TOKENS,
               per_shard: int = SHARD_SEQUENCES) -> DataFrame:
    """(slot, tokens) of the slots ``first`` to ``last`` (exclusive), from only the shards that hold them."""
    names = [f"{folder}/{shard_name(s)}" for s in range(first // per_shard, -(-last // per_shard))]
    stride = length * ID_BYTES
    files = spark.read.format("binaryFile").load(names).select(
        F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("long").alias("shard"), "content")
    at = F.explode(F.sequence(F.lit(0), (F.octet_length("content") / stride).cast("int") - 1))
    slots = files.select("shard", "content", at.alias("i"))
    return slots.select((F.col("shard") * per_shard + F.col("i")).alias("slot"), F.expr(f"substring(content, i * {stride} + 1, {stride})").alias("tokens")) \
        .where((F.col("slot") >= first) & (F.col("slot") < last))


def report(docs: DataFrame) -> DataFrame:
    """Shards of the whole table in the shared folder; the manifest, one row a slot, with each slot's file."""
    folder = scratch_path(docs.sparkSession, "token-shards")
    name = F.concat(F.lit(f"{folder}/shard-"), F.lpad(F.col("shard").cast("string"), 8, "0"), F.lit(".bin"))
    return write_shards(docs, folder).withColumn("file", name)
