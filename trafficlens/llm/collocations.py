"""Phrase collocations by relational mining (SETM): occurrence relations, merge-joined, counted, semi-joined.

R_k holds every place where a frequent phrase of k words starts: (piece,
position, phrase).  It is persisted sorted, in blocks of whole documents, each
a row: positions count the words of a block and skip one at the end of each
piece, so phrases that stand next to each other in a piece, and no others, are
one apart.  A level

1. merge-joins R_k with itself at position and position + 1: two frequent
   phrases that overlap in all but a word make a phrase of k + 1 words;
2. counts the groups: first within a block, so that a block sends each pair
   once, then over all blocks, where the blocks' rows of a pair meet;
3. semi-joins: rows of frequent groups go back to their blocks, with the group's
   number, and the places they stand for become R_k+1.

Groups below the least count are gone before the next length is tried, and a
phrase that is frequent has only frequent parts, so nothing is lost; all
counts are exact.  A group carries the counts of its heads and tails, so every
cut of a phrase is scored without another join.

Scale: what is shuffled is at most one row a block and different phrase (a
word or pair that makes up a third of the text is one row a block), and the
blocks themselves, packed, once a level.  A group's number is the least of its
rows', so counting and the semi-join share one shuffle; only the frequent groups are
joined, for their texts and counts, as Spark chooses.  A task holds a block at
a time (``BLOCK_WORDS`` words, or one document), or what one Arrow batch holds of
packed blocks.  Each level is written to the shared folder.  ``docs`` must be a scan, or anything
else that gives the same rows in the same partitions when a task runs again.

Defined results: null text is empty, null ``lang`` is ``und``; an empty text, or
one of separators only, has no words; repeated rows count each; ties of a
score go to the larger count, then to the phrase that is less in UTF-8 bytes;
ties of cuts to the shorter first part; an empty table gives no rows.  Other
columns than lang and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, discard, map_batches, ship_package, stored

LEAST_COUNT, MAX_WORDS, TOP, COVER = 30, 4, 2000, 80
#: Fixed values of the contract: what ends a piece; white space parts words.
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
NO_LANG = "und"
#: Not a byte of UTF-8, so no word.
PIECE_END = b"\xff"
BLOCK_WORDS = 1 << 20
#: A row of a block is numbered block << ROW_BITS | row, a block partition << BLOCK_BITS | block.
ROW_BITS, BLOCK_BITS = 27, 14
TEXT_BLOCK = "block long, lang string, words array<string>, counts array<long>, n_words long, codes binary"
BLOCK = "block long, phrases array<long>, at binary, codes binary"
PAIR = "l long, r long, n long, row long"


def _packed(numbers) -> bytes:
    import zstandard
    return zstandard.compress(numbers.astype("<u4").tobytes(), 3)


def _unpacked(blob: bytes):
    import numpy as np
    import zstandard
    return np.frombuffer(zstandard.decompress(blob), "<u4").astype(np.int64)


# --- the first relation ------------------------------------------------------------

def text_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The words of ``docs`` in blocks of whole documents of one language: the block's different words with their
    counts, and its words as codes (0 ends a piece)."""
    kinds = arrow_schema(TEXT_BLOCK)
    ends = bytes(10 if c in SEPARATORS else c + 32 if 65 <= c <= 90 else c for c in range(256))

    def run(batches):
        from array import array
        from collections import defaultdict

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        made, open_blocks, held = TaskContext.get().partitionId() << BLOCK_BITS, {}, 0

        def started():
            code_of = defaultdict()
            code_of.default_factory = code_of.__len__
            return code_of, array("i", [code_of[PIECE_END]])

        def flushed(lang):
            nonlocal made, held
            code_of, codes = open_blocks.pop(lang)
            codes = np.array(codes)
            counts = np.bincount(codes)[1:]
            row = {"block": made, "lang": lang, "words": [w.decode() for w in list(code_of)[1:]], "counts": counts.tolist(),
                   "n_words": int(counts.sum()), "codes": _packed(codes)}
            made, held = made + 1, held - len(codes)
            if not made & (1 << BLOCK_BITS) - 1 or len(counts) >> ROW_BITS:
                raise ValueError("too many blocks in a partition, or words in a block, for their numbers")
            return pa.RecordBatch.from_pylist([row], schema=kinds)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode("utf-8").translate(ends).replace(b"\n", b" \xff ").split()
                lang = NO_LANG if lang is None else lang
                code_of, codes = open_blocks.get(lang) or open_blocks.setdefault(lang, started())
                codes.extend(map(code_of.__getitem__, words))
                codes.append(0)
                held += len(words) + 1
                if len(codes) >= block_words:
                    yield flushed(lang)
                elif held >= 4 * block_words:  # many languages, none with a full block
                    yield from map(flushed, list(open_blocks))
        yield from map(flushed, list(open_blocks))
    return map_batches(docs.select("lang", "text"), run, TEXT_BLOCK)


def _block_rows(kept: DataFrame) -> DataFrame:
    row = F.col("row")
    return kept.select(F.shiftright(row, ROW_BITS).alias("of"), row.bitwiseAND((1 << ROW_BITS) - 1).alias("at_row"), "id")


def _frequent(rows: DataFrame, key: list[str], least: int, name: str) -> DataFrame:
    """The blocks' rows (key, n, row) of the groups that have ``least`` places or more: row, the group's number id, and
    in the one row a group that gives it its number also the key and the count a.  A group has at most one row a block."""
    group = Window.partitionBy(*key)
    counted = rows.select(*key, "row", F.sum("n").over(group).alias("a"), F.min("row").over(group).alias("id")).where(F.col("a") >= least)
    return stored(counted.select("row", "id", *[F.when(F.col("row") == F.col("id"), F.col(c)).alias(c) for c in (*key, "a")]), name)


def _replaced(df: DataFrame, name: str, *before: DataFrame) -> DataFrame:
    """``df`` stored; the stored tables it came from, which nothing else reads, go once it is whole."""
    df = stored(df, name)
    discard(*before)
    return df


def _groups(kept: DataFrame) -> DataFrame:
    return kept.where("row = id").drop("row")


def _first_relation(blocks: DataFrame, kept: DataFrame) -> DataFrame:
    """R_1: the places of frequent words."""
    kinds = arrow_schema(BLOCK)

    def fill(left, right):
        import numpy as np
        import pyarrow as pa
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        row, words, ids = left.to_pylist()[0], right["at_row"].to_numpy(), right["id"].to_numpy()
        phrases, codes = np.sort(ids), _unpacked(row["codes"])
        code_of = np.full(int(codes.max()) + 1, -1)
        code_of[words + 1] = np.searchsorted(phrases, ids)
        codes = code_of[codes]
        at = np.flatnonzero(codes >= 0)
        return pa.Table.from_pylist([{"block": row["block"], "phrases": phrases, "at": _packed(np.diff(at, prepend=0)), "codes": _packed(codes[at])}], schema=kinds)
    return _per_block(blocks.select("block", "codes"), kept, fill)


def _per_block(blocks: DataFrame, kept: DataFrame, fill) -> DataFrame:
    ship_package(blocks.sparkSession)
    return blocks.groupBy("block").cogroup(_block_rows(kept).groupBy("of")).applyInArrow(fill, BLOCK)


# --- a level -----------------------------------------------------------------------

def _adjacent(at: bytes, codes: bytes, phrases: int):
    """The merge-join of a block with itself: (positions, pairs of codes as one number) where a phrase starts one
    after another."""
    import numpy as np
    at, codes = np.cumsum(_unpacked(at)), _unpacked(codes)
    i = np.flatnonzero(np.diff(at) == 1)
    return at[i], codes[i] * phrases + codes[i + 1]


def pair_counts(relation: DataFrame) -> DataFrame:
    """(l, r, n, row) per block: how often phrase r starts one after phrase l, and the row's number; a block's rows
    are in the order of its pairs of codes."""
    kinds = arrow_schema(PAIR)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for i in range(batch.num_rows):
                block, at, codes = (batch.column(c)[i].as_py() for c in ("block", "at", "codes"))
                phrases = batch.column("phrases")[i].values.to_numpy()
                pairs, n = np.unique(_adjacent(at, codes, len(phrases))[1], return_counts=True)
                if len(pairs) >> ROW_BITS:
                    raise ValueError("too many pairs in a block for their numbers")
                l, r = np.divmod(pairs, max(1, len(phrases)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
                    (phrases[l], phrases[r], n, (block << ROW_BITS) + np.arange(len(n))), kinds, strict=True)], names=kinds.names)
    return map_batches(relation, run, PAIR)


def _next_relation(relation: DataFrame, kept: DataFrame) -> DataFrame:
    """R_k+1: the places of R_k's pairs that are frequent."""
    kinds = arrow_schema(BLOCK)

    def fill(left, right):
        import numpy as np
        import pyarrow as pa
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        block, at, codes = (left[c][0].as_py() for c in ("block", "at", "codes"))
        rows, ids = right["at_row"].to_numpy(), right["id"].to_numpy()
        at, pairs = _adjacent(at, codes, len(left["phrases"][0].values))
        pairs, row = np.unique(pairs, return_inverse=True)
        phrases, code_of = np.sort(ids), np.full(len(pairs), -1)
        code_of[rows] = np.searchsorted(phrases, ids)
        codes = code_of[row]
        return pa.Table.from_pylist([{"block": block, "phrases": phrases, "at": _packed(np.diff(at[codes >= 0], prepend=0)),
                                      "codes": _packed(codes[codes >= 0])}], schema=kinds)
    return _per_block(relation, kept, fill)


def _named(groups: DataFrame, shorter: DataFrame) -> DataFrame:
    """Groups (id, l, r, a) with language, phrase, last word, and the counts of heads and tails from those a word shorter."""
    first = shorter.select(F.col("id").alias("l"), "lang", F.col("phrase").alias("head"), F.concat("heads", F.array("a")).alias("heads"))
    rest = shorter.select(F.col("id").alias("r"), "last", F.concat("tails", F.array("a")).alias("tails"))
    return groups.join(first, "l").join(rest, "r").select("id", "l", "r", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "a", "heads", "tails")


# --- the report ----------------------------------------------------------------------

def frequent_phrases(docs: DataFrame, least: int = LEAST_COUNT, max_words: int = MAX_WORDS, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """(words a language: lang, n; frequent groups by length, from 1): id, l, r, lang, phrase, a, heads, tails.
    ``max_words`` is 2 or more."""
    blocks = stored(text_blocks(docs, block_words), "text-blocks")
    totals = stored(blocks.groupBy("lang").agg(F.sum("n_words").alias("n")), "totals")
    words = blocks.select("lang", F.shiftleft("block", ROW_BITS).alias("first"), F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")) \
        .select("lang", F.col("w.words").alias("phrase"), F.col("w.counts").alias("n"), (F.col("first") + F.col("place")).alias("row"))
    kept = _frequent(words, ["lang", "phrase"], least, "frequent-1")
    none, unknown = F.array().cast("array<long>"), F.lit(None).cast("long")
    levels = [stored(_groups(kept).select("id", unknown.alias("l"), unknown.alias("r"), "lang", "phrase", F.col("phrase").alias("last"), "a",
                                          none.alias("heads"), none.alias("tails")), "groups-1")]
    relation = _replaced(_first_relation(blocks, kept), "occurrences-1", blocks, kept)
    for k in range(2, max_words):
        kept = _frequent(pair_counts(relation), ["l", "r"], least, f"frequent-{k}")
        levels.append(stored(_named(_groups(kept), levels[-1]), f"groups-{k}"))
        relation = _replaced(_next_relation(relation, kept), f"occurrences-{k}", relation, kept)
    # Nothing extends the longest phrases, so their places need not be known, only how many there are.
    groups = pair_counts(relation).groupBy("l", "r").agg(F.sum("n").alias("a"), F.min("row").alias("id")).where(F.col("a") >= least)
    levels.append(_replaced(_named(groups, levels[-1]), f"groups-{max_words}", relation))
    return totals, levels


def _scored(group: DataFrame, words: int) -> DataFrame:
    """The lowest-scoring cut of each phrase of ``words`` words."""
    cuts = []
    for k in range(1, words):
        l, r = f"heads[{k - 1}]", f"tails[{words - 1 - k}]"
        score = F.expr(f"CAST(a AS DECIMAL(20, 0)) * 2000000 DIV (CAST({l} AS DECIMAL(20, 0)) + {r})").cast("long")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.expr(l).alias("l"), F.expr(r).alias("r")))
    return group.withColumn("cut", F.array_min(F.array(*cuts)) if len(cuts) > 1 else cuts[0]) \
        .select("id", "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST_COUNT, max_words: int = MAX_WORDS, top: int = TOP, cover: int = COVER,
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    totals, levels = frequent_phrases(docs, least, max_words, block_words)
    kept = []
    for words, group in enumerate(levels[1:], 2):
        phrases = _scored(group, words)
        if words < max_words:
            # A phrase two words longer is no more frequent than the one between, so the next length decides.
            covers = levels[words].select(F.explode(F.array("l", "r")).alias("id"), F.col("a").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            covered = F.expr(f"CAST(longer AS DECIMAL(20, 0)) * 100 >= CAST(a AS DECIMAL(20, 0)) * {cover}")
            phrases = phrases.join(covers, "id", "left").where(~F.coalesce(covered, F.lit(False))).drop("longer")
        kept.append(phrases.drop("id"))
    candidates = kept[0]
    for more in kept[1:]:
        candidates = candidates.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = candidates.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
