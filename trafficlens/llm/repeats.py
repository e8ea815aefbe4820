"""Exact removal of repeated byte strings by bucket-pointer refinement.

A byte goes if a window of ``LENGTH`` bytes around it also starts earlier, in a
document of smaller doc_id (null last, then by place in the table) or in the
same one.  The windows are not sorted one by one: buckets of them are refined,
and what stands alone in its bucket leaves early.

1. *Initial buckets.*  Of each window's q-grams the one of least hash (leftmost
   of equals) is its anchor; equal windows have equal anchors at equal offsets.
   A run of windows with one anchor is a region, about 39 windows, and its
   bucket is the anchor's q-gram.  Regions alone in their bucket leave.
2. *Whole regions.*  In what is left, regions of equal bytes and offsets are
   one class; all but its first are late from end to end.
3. *Refinement by later offsets.*  The first ones are cut at fixed offsets from
   the anchor into parts of ``STEP`` windows; a part's bucket is what all its
   windows share, ``LENGTH - STEP + 1`` bytes, read off the same prefix sums
   at later offsets.  Parts alone in their bucket leave.
4. *Windows.*  The other parts' windows are bucketed by all their bytes; all
   but the first of each bucket are late.

Bucket identifiers are polynomial hashes of byte ranges: 64 bits where a clash
only costs work (1, 3), 128 bits where it decides (2, 4).

Scale: texts are never shuffled.  Every step scans the documents where they lie
and sends fixed-size rows (identifier, place); a scan partition sends a
bucket once, so a bucket that a third of the rows share has as many rows as
there are partitions.  What came out is written by scan partition into the
shared folder, where the next scan of that partition reads its own part.  So
``docs`` must be a scan (or anything whose partitions come out alike each time);
each scan checks its number of regions against the first.  Any task can run
again on another executor.

Defined results: null or empty text, or text under LENGTH bytes: nothing goes.
Repeated rows are documents of their own, the earlier in the table first.
Long texts are read in pieces of ``PIECE`` windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trafficlens.session import scratch_path

from .common import arrow_schema, map_batches

LENGTH, GRAM, STEP = 100, 24, 20
PIECE, SEGMENT, PLACE_BITS = 1 << 20, 1 << 17, 21
PARTITION_SHIFT = 41  # a place is partition, number and one bit in a long
NUMBERED = "k1 long, k2 long, no_id boolean, doc_id long, at long"
RESULT = "__llm_spans array<struct<start:long,stop:long>>, __llm_kept binary"


# --- hashing ---------------------------------------------------------------

@lru_cache(maxsize=1)
def _tables():
    """Byte values, powers and inverse powers of two polynomial hashes modulo 2 ** 64."""
    import numpy as np
    rng = np.random.default_rng(20240229)
    size, out = PIECE + SEGMENT + 2 * LENGTH, []
    for base in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95):
        values = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        row = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            row.append(np.cumprod(steps))
        out.append((values, *row))
    return out


def _mix(x):
    import numpy as np
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Segment:
    """Pieces of documents side by side, with the regions of their windows."""

    def __init__(self, data, rows, offsets, sizes):
        """``rows``: row number of each piece; ``offsets``: where it starts in its document; ``sizes``: its bytes."""
        import numpy as np
        self.data, self._sums = data, {}
        n, width = len(data), LENGTH - GRAM + 1
        values, powers, inverse = _tables()[0]
        sums = self._prefix(0)
        grams = _mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:n - GRAM + 1])
        low = np.uint64((1 << PLACE_BITS) - 1)
        keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        least = self._sliding(keys, width)
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        count = sizes - (LENGTH - 1)
        piece = np.repeat(np.arange(len(sizes)), count)
        starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[piece]
        anchors = (least[starts] & low).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (piece[1:] != piece[:-1])]))
        ends = np.concatenate([new[1:], [len(starts)]]) - 1
        self.first, self.last, self.anchor = starts[new], starts[ends], anchors[new]  # first and last window start
        of = piece[new]
        self.row, self.shift = rows[of], offsets[of] - begin[of]  # + shift: place in the document
        self.bucket = grams[self.anchor]

    @staticmethod
    def _sliding(keys, width: int):
        """Minimum of every ``width`` keys, by minima from either end of blocks."""
        import numpy as np
        n = len(keys)
        padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[:n] = keys
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(behind[:n - width + 1], ahead[width - 1:n])

    def _prefix(self, which: int):
        import numpy as np
        if which not in self._sums:
            values, powers, _ = _tables()[which]
            sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(values[self.data] * powers[:len(self.data)], out=sums[1:])
            self._sums[which] = sums
        return self._sums[which]

    def name(self, start, stop, salt, which: int = 0):
        """Identifier of the bytes [start, stop) and ``salt``."""
        import numpy as np
        sums, inverse = self._prefix(which), _tables()[which][2]
        return _mix(_mix((sums[stop] - sums[start]) * inverse[start]) + salt.astype(np.uint64)).view(np.int64)


def _segments(texts, row0: int) -> Iterator[Segment]:
    """Segments of an Arrow string column; rows are numbered from ``row0``."""
    import numpy as np
    data, offsets = _bytes_of(texts)
    held, size = [], 0

    def made():
        rows, offs, parts = zip(*held, strict=True)
        return Segment(np.concatenate(parts), np.array(rows), np.array(offs), np.array([len(p) for p in parts]))
    for i in range(len(texts)):
        windows = int(offsets[i + 1] - offsets[i]) - LENGTH + 1
        for at in range(0, windows, PIECE):
            part = data[offsets[i] + at:offsets[i] + at + min(PIECE, windows - at) + LENGTH - 1]
            held.append((row0 + i, at, part))
            size += len(part)
            if size >= SEGMENT:
                yield made()
                held, size = [], 0
    if held:
        yield made()


def _bytes_of(texts):
    """(bytes, offsets) of an Arrow string column, nulls as empty."""
    import numpy as np
    import pyarrow as pa
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


# --- what earlier steps found, by scan partition ---------------------------

class Sides(NamedTuple):
    """Folders of the steps' results: shared regions, late regions, shared parts, late windows."""
    shared: str = ""
    late: str = ""
    parts: str = ""
    windows: str = ""


def _read_side(folder: str, pid: int):
    """The numbers that a step left for partition ``pid``, sorted."""
    import numpy as np
    import pyarrow.dataset as ds
    from pyarrow import fs
    store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    path = f"{base}/pid={pid}"
    if not folder or store.get_file_info(path).type == fs.FileType.NotFound:
        return np.zeros(0, dtype=np.int64)
    return np.sort(ds.dataset(path, filesystem=store, format="parquet").to_table(columns=["number"])["number"].to_numpy())


def _write_side(found: DataFrame, name: str) -> str:
    """Places -> one folder a scan partition, with the numbers."""
    folder = scratch_path(found.sparkSession, name)
    rows = found.select(F.shiftright("at", PARTITION_SHIFT).cast("int").alias("pid"),
                        F.shiftright(F.col("at").bitwiseAND((1 << PARTITION_SHIFT) - 1), 1).alias("number"))
    rows.repartition("pid").write.partitionBy("pid").parquet(folder)
    return folder


def _has(numbers, side):
    """Which of the (any) ``numbers`` are in the sorted ``side``."""
    import numpy as np
    if not len(side):
        return np.zeros(len(numbers), dtype=bool)
    return side[np.minimum(np.searchsorted(side, numbers), len(side) - 1)] == numbers


class Scan:
    """One scan of a partition: its segments, with the numbers of their regions."""

    def __init__(self, sides: Sides):
        self.pid = TaskContext.get().partitionId()
        self.shared, self.late, self.parts, self.windows = (_read_side(s, self.pid) for s in sides)
        self.regions = self.rows = 0

    def segments(self, texts) -> Iterator[tuple[Segment, object]]:
        import numpy as np
        with np.errstate(over="ignore"):
            for seg in _segments(texts, self.rows):
                numbers = np.arange(self.regions, self.regions + len(seg.first))
                self.regions += len(numbers)
                yield seg, numbers
        self.rows += len(texts)

    def heads(self, seg: Segment, numbers):
        """Indexes in the segment of shared regions that are not late."""
        import numpy as np
        return np.flatnonzero(_has(numbers, self.shared) & ~_has(numbers, self.late))

    def end(self) -> None:
        if len(self.shared) and self.shared[-1] != self.regions:  # the first scan leaves its number of regions there
            raise RuntimeError(f"partition {self.pid}: {self.regions} regions, {self.shared[-1]} before: docs must be a repeatable scan")

    def place(self, numbers, known=0):
        import numpy as np
        return (np.int64(self.pid) << np.int64(PARTITION_SHIFT)) | (np.asarray(numbers, dtype=np.int64) << 1) | known


def _parts_of(seg: Segment, heads):
    """(index, part number, least and greatest offset of its windows) of the heads' parts."""
    import numpy as np
    least, most = (seg.anchor - seg.last)[heads], (seg.anchor - seg.first)[heads]
    count = most // STEP - least // STEP + 1
    of = np.repeat(np.arange(len(heads)), count)
    j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + (least // STEP)[of]
    return heads[of], j, np.maximum(least[of], j * STEP), np.minimum(most[of], j * STEP + STEP - 1)


def _own_keys(places):
    """Keys for rows that must meet no other: their place, mixed."""
    import numpy as np
    return _mix(places.astype(np.uint64)).view(np.int64)


def _batches(columns: list, schema) -> Iterator:
    import pyarrow as pa
    for i in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[i:i + (1 << 16)], f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# --- steps -----------------------------------------------------------------

def _shared(docs: DataFrame, sides: Sides, keys_of, first: bool) -> DataFrame:
    """Places whose bucket has more than one.  ``keys_of(scan, segment, numbers)`` -> (keys, numbers)."""
    schema = arrow_schema("k1 long, at long")

    def run(batches):
        import numpy as np
        scan, keys, numbers = Scan(sides), [], []
        for batch in batches:
            for seg, own in scan.segments(batch.column(1)):
                k, n = keys_of(scan, seg, own)
                keys.append(k)
                numbers.append(n)
        scan.end()
        k = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        n = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        # A bucket's first place speaks for the partition; more than one are known to be shared.
        _, at, group, size = np.unique(k, return_index=True, return_inverse=True, return_counts=True)
        places = scan.place(n, (size > 1)[group] if len(k) else 0)
        k = np.where(np.isin(np.arange(len(k)), at), k, _own_keys(places))
        if first:
            k, places = np.append(k, _own_keys(scan.place([scan.regions]))), np.append(places, scan.place([scan.regions], 1))
        yield from _batches([k, places], schema)
    rows = map_batches(docs, run, "k1 long, at long")
    # A bucket has a row a scan partition at most.
    n = F.count(F.lit(1)).over(Window.partitionBy("k1"))
    return rows.withColumn("n", n).where((F.col("n") > 1) | (F.col("at").bitwiseAND(1) == 1)).select("at")


def _late(docs: DataFrame, sides: Sides, keys_of) -> DataFrame:
    """Places that are not the first of their bucket.  ``keys_of(scan, segment, numbers)`` ->
    (first keys, second keys, numbers, row of each, place in the document of each)."""
    schema = arrow_schema(NUMBERED)

    def run(batches):
        import numpy as np
        scan, got, ids = Scan(sides), [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            got += [keys_of(scan, seg, own) for seg, own in scan.segments(batch.column(1))]
        scan.end()
        if not got:
            return
        k1, k2, numbers, row, where = (np.concatenate(c) for c in zip(*got, strict=True))
        no_id = np.array([i is None for i in ids])
        doc = np.array([0 if i is None else i for i in ids], dtype=np.int64)
        rank = np.empty(len(ids), dtype=np.int64)
        rank[np.lexsort((np.arange(len(ids)), doc, no_id))] = np.arange(len(ids))
        order = np.lexsort((where, rank[row], k2, k1))
        k1, k2, numbers, row = k1[order], k2[order], numbers[order], row[order]
        lead = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]) if len(k1) else np.zeros(0, bool)
        places = scan.place(numbers, (~lead).astype(np.int64))
        k1 = np.where(lead, k1, _own_keys(places))
        yield from _batches([k1, k2, no_id[row], doc[row], places], schema)
    rows = map_batches(docs, run, NUMBERED)
    own = F.struct("no_id", "doc_id", "at")
    # Again a row a scan partition at most; the others are known to be late.
    rows = rows.withColumn("first", F.min(own).over(Window.partitionBy("k1", "k2")))
    return rows.where((F.col("at").bitwiseAND(1) == 1) | (own != F.col("first"))).select("at")


def _region_keys(scan: Scan, seg: Segment, numbers):
    import numpy as np
    at = np.flatnonzero(_has(numbers, scan.shared))
    first, last = seg.first[at], seg.last[at]
    salt = (seg.anchor[at] - first) * 128 + (last - first)
    return (seg.name(first, last + LENGTH, salt), seg.name(first, last + LENGTH, salt, 1), numbers[at], seg.row[at], first + seg.shift[at])


def _part_keys(scan: Scan, seg: Segment, numbers):
    at, j, _, _ = _parts_of(seg, scan.heads(seg, numbers))
    start = seg.anchor[at] - j * STEP
    return seg.name(start, start + LENGTH - STEP + 1, j), numbers[at] * 4 + j


def _windows_of(scan: Scan, seg: Segment, numbers):
    """(index, offset) of the windows of the heads' shared parts."""
    import numpy as np
    at, j, least, most = _parts_of(seg, scan.heads(seg, numbers))
    kept = _has(numbers[at] * 4 + j, scan.parts)
    at, least, count = at[kept], least[kept], (most - least + 1)[kept]
    of = np.repeat(np.arange(len(at)), count)
    return at[of], least[of] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _window_keys(scan: Scan, seg: Segment, numbers):
    at, offset = _windows_of(scan, seg, numbers)
    start = seg.anchor[at] - offset
    return (seg.name(start, start + LENGTH, offset * 0), seg.name(start, start + LENGTH, offset * 0, 1), numbers[at] * 128 + offset,
            seg.row[at], start + seg.shift[at])


def _late_ranges(scan: Scan, seg: Segment, numbers):
    """(row, start, stop) in documents of late regions and late windows."""
    import numpy as np
    whole = np.flatnonzero(_has(numbers, scan.late))
    at, offset = _windows_of(scan, seg, numbers)
    gone = _has(numbers[at] * 128 + offset, scan.windows)
    at, offset = at[gone], offset[gone]
    start = np.concatenate([seg.first[whole], seg.anchor[at] - offset])
    stop = np.concatenate([seg.last[whole], seg.anchor[at] - offset]) + LENGTH
    at = np.concatenate([whole, at])
    return seg.row[at], start + seg.shift[at], stop + seg.shift[at]


def _merged(row, start, stop):
    """The ranges joined where they overlap or touch, by row and start."""
    import numpy as np
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    # Rows are set apart, so that one running maximum serves all.
    apart = row * (int(stop.max()) + 2 if len(stop) else 1)
    reach = np.maximum.accumulate(stop + apart) if len(stop) else stop
    new = np.concatenate([[True], (start + apart)[1:] > reach[:-1]])[:len(row)]
    ends = np.append(np.flatnonzero(new)[1:], len(row)) - 1 if len(row) else np.zeros(0, np.int64)
    return row[new], start[new], (reach - apart)[ends]


def _cut(sides: Sides, column: str, schema):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        scan = Scan(sides)
        for batch in batches:
            texts, row0 = batch.column(column), scan.rows
            found = [_late_ranges(scan, seg, own) for seg, own in scan.segments(texts)]
            data, at = _bytes_of(texts)
            if found:
                row, start, stop = _merged(*(np.concatenate(c) for c in zip(*found, strict=True)))
            else:
                row = start = stop = np.zeros(0, np.int64)
            lo = np.searchsorted(row, np.arange(row0, row0 + len(texts) + 1))
            spans, kept = [], []
            for i in range(len(texts)):
                body = data[at[i]:at[i + 1]]
                own = list(zip(start[lo[i]:lo[i + 1]].tolist(), stop[lo[i]:lo[i + 1]].tolist(), strict=True))
                cuts = [0, *(x for span in own for x in span), len(body)]
                kept.append(b"".join(body[a:b].tobytes() for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
                spans.append([{"start": a, "stop": b} for a, b in own])
            added = [pa.array(c, f.type) for c, f in zip((spans, kept), schema, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *schema.names])
        scan.end()
    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, any more) with __llm_spans, the removed byte ranges, and __llm_kept, the bytes left."""
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bucket = lambda scan, seg, numbers: (seg.bucket.view("int64"), numbers)
    sides = Sides()
    sides = sides._replace(shared=_write_side(_shared(light, sides, bucket, True), "repeat-regions"))
    sides = sides._replace(late=_write_side(_late(light, sides, _region_keys), "repeat-late"))
    sides = sides._replace(parts=_write_side(_shared(light, sides, _part_keys, False), "repeat-parts"))
    sides = sides._replace(windows=_write_side(_late(light, sides, _window_keys), "repeat-windows"))
    schema = StructType(docs.schema.fields + StructType.fromDDL(RESULT).fields)
    return map_batches(docs, _cut(sides, "text", arrow_schema(RESULT)), schema)


def report(docs: DataFrame) -> DataFrame:
    """The contract's digest of every document."""
    cut = remove_repeats(docs.select("doc_id", "text"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return cut.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("__llm_kept")).alias("n_removed"),
                      F.size("__llm_spans").cast("long").alias("n_spans"), F.sha2("__llm_kept", 256).alias("kept_sha256"))
