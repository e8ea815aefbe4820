"""Repair of conversations: the cheapest edits that make a legal order of roles, by a suffix-shared DAWG.

A turn is reduced to a symbol: the class of its role's initial and its first
fault (blank, duplicate and truncated).  A conversation's symbols are its
signature.  Distinct signatures of all conversations are sorted by their
reversal and read in that order: then two neighbours share the longest suffix
that either shares with any other, so the automaton that is minimised from the
end is a path of which only the part above the shared suffix is replaced.  A
node stands for one suffix; for each grammar state it holds the cost to go and
the first letter of the best audit from there, computed once when the node
is made, however many conversations run through it.  (A partition of the sort
makes the few nodes again that its first signature shares with the partition
before.)

Grammar of the repaired roles' initials: ``(s?(ua)+)?``.  Edits: Keep 0,
Rerole to user or assistant 2, Delete 3 (blank and duplicate turns must go),
Insert a user or assistant turn of empty text 2; a truncated turn that stays
adds 1.  From a state a letter leads to one state only, so the least letter
among the cheapest at every step gives the audit that is least in ASCII.

Scale: turns are shuffled twice by conversation, once as digests and flags and
once with their text; either way a conversation's turns run through a task one
by one, sorted by Spark, and what is held of one is its signature, its audit
(values of one row of the result) and 32 bytes a distinct turn.  A conversation's
hash is one sequential hash over its turns, so its turns do go through one
task.  Signatures are distinct before anything is computed, their join back is
Spark's choice.

Defined results: a null role or text is one space; null ids are one
conversation; null turns come first; turns of one number come by role, then by
the SHA-256 of their text; repeated rows are turns (the later ones duplicates);
a role or text may be empty or very long; an empty table gives no rows.
Columns other than conv_id, turn, role and text are not looked at.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_batches, stored

#: Fixed values of the contract.
SPACES = " \t\n\x0b\x0c\r"
SENTENCE_ENDS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Grammar states: nothing yet, after the system turn, a user turn came last, an assistant turn came last.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEPS = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("a", USER): ASSISTANT, ("u", ASSISTANT): USER}
#: The state, and the role, that an inserted or reroled turn leads to.
TURNS_TO = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
MUST_GO, NEVER = "-", 1 << 40
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"


# --- the automaton -------------------------------------------------------------

class SuffixAutomaton:
    """The path of one signature through the automaton, from the end: per node and state the cost to go, the letter
    to write and the state after it."""

    def __init__(self):
        self.symbols: list[str] = []  # from the last turn to the first
        self.costs, self.letters, self.after = array("q"), bytearray(), bytearray()
        self._push([(0, "", START), (NEVER, "", SYSTEM), (NEVER, "", USER), (0, "", ASSISTANT)])
        self.made = 0

    def _push(self, base: list[tuple[int, str, int]]) -> None:
        # An insertion stays at the node; no best audit inserts a whole pair, so the two states after one see no other insertion.
        best = [min(base[s], (INSERT + base[TURNS_TO[s]][0], "I", TURNS_TO[s])) for s in (USER, ASSISTANT)]
        best = [min(base[s], (INSERT + best[0][0], "I", USER)) for s in (START, SYSTEM)] + best
        self.costs.extend(c for c, _, _ in best)
        self.letters.extend(ord(x) if x else 0 for _, x, _ in best)
        self.after.extend(s for _, _, s in best)

    def _add(self, symbol: str) -> None:
        """A new first turn before the present suffix."""
        go, base = self.costs[-4:], []
        for s in range(4):
            options = [(DELETE + go[s], "D", s)]
            if symbol != MUST_GO:
                role, late = symbol.lower(), TRUNCATED if symbol.isupper() else 0
                options.append((REROLE + late + go[TURNS_TO[s]], "R", TURNS_TO[s]))
                if (kept := KEEPS.get((role, s))) is not None:
                    options.append((late + go[kept], "K", kept))
            base.append(min(options))
        self._push(base)
        self.symbols.append(symbol)
        self.made += 1

    def follow(self, from_end: str) -> tuple[int, str]:
        """(cost, audit) of a reversed signature; nodes of the suffix it shares with the last one are used again."""
        shared, old = 0, self.symbols
        for a, b in zip(old, from_end):  # noqa: B905 - up to the shorter one
            if a != b:
                break
            shared += 1
        del old[shared:], self.costs[4 * shared + 4:], self.letters[4 * shared + 4:], self.after[4 * shared + 4:]
        for symbol in from_end[shared:]:
            self._add(symbol)
        at, state, audit = 4 * len(from_end), START, bytearray()
        cost = self.costs[at]
        while letter := self.letters[at + state]:
            audit.append(letter)
            state, at = self.after[at + state], at - (0 if letter == 73 else 4)  # 73: an insertion
        return cost, audit.decode()


def audits(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) for every distinct value of ``signature``."""
    from_end = signatures.select("signature").distinct().select(F.reverse("signature").alias("from_end"))
    ordered = from_end.repartitionByRange("from_end").sortWithinPartitions("from_end")
    schema = "signature string, cost long, audit string"
    kinds = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa
        automaton = SuffixAutomaton()
        for batch in batches:
            given = batch.column(0).to_pylist()
            found = [automaton.follow(s) for s in given]
            yield pa.RecordBatch.from_arrays([pa.array([s[::-1] for s in given], pa.string()), pa.array([c for c, _ in found], pa.int64()),
                                              pa.array([a for _, a in found], pa.string())], names=kinds.names)
    return map_batches(ordered, run, schema)


# --- signatures ------------------------------------------------------------------

def _filled(rows: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage by crc32(conv_id:turn) % 20: 0 drops a turn, 1 empties it, 2 takes its sentence ends,
    3 repeats it, 4 makes it the user's."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind, rows = F.col("__llm_kind"), _filled(rows).withColumn("__llm_kind", F.crc32(key) % 20).where("__llm_kind <> 0")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", SENTENCE_ENDS, "")).otherwise(F.col("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("__llm_copy")) \
        .drop("__llm_copy")


def _conversations(batches, n_columns: int) -> Iterator[tuple]:
    """(conv_id, iterator of its rows) over sorted batches; the rows must be read before the next conversation."""
    from itertools import groupby

    def rows():
        for batch in batches:
            yield from zip(*[batch.column(i).to_pylist() for i in range(n_columns)], strict=True)
    return groupby(rows(), key=lambda r: r[0])


def _signed(turns: Iterator[tuple]) -> tuple:
    """(signature, counts) of one conversation's rows (conv_id, turn, role, text digest, blank, truncated)."""
    symbols, seen = [], set()
    low = high = last = None
    distinct = blanks = repeats = cut = illegal = 0
    for _, turn, role, digest, blank, truncated in turns:
        if digest is None:  # only says that the conversation exists
            continue
        if turn is not None and turn != high:
            low, high, distinct = turn if low is None else low, turn, distinct + 1
        initial = role[:1]
        if last is not None and last + initial not in LEGAL_PAIRS:
            illegal += 1
        last = initial
        known = hashlib.sha256(digest + role.encode("utf-8")).digest()
        duplicate = known in seen
        seen.add(known)
        symbol = initial if initial in ("s", "u", "a") else "o"
        if blank or duplicate:
            symbol = MUST_GO
        elif truncated:
            symbol = symbol.upper()
        blanks, repeats, cut = blanks + blank, repeats + (duplicate and not blank), cut + (truncated and not duplicate and not blank)
        symbols.append(symbol)
    return "".join(symbols), 0 if low is None else high - low + 1 - distinct, blanks, repeats, cut, illegal


def signatures(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, signature, and the counts gaps, blank, duplicate, truncated, illegal) a conversation of ``rows``, and of
    ``conversations``, whose ids count as conversations even without rows."""
    kept = F.rtrim(F.col("text"), F.lit(SPACES))
    light = _filled(rows).select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (kept == "").alias("blank"),
                                 (~F.right(kept, F.lit(1)).isin(*SENTENCE_ENDS)).alias("truncated"))
    if conversations is not None:
        light = light.unionByName(conversations.select("conv_id").distinct(), allowMissingColumns=True)
    ordered = light.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, signature string, {COUNTS}"
    kinds = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa
        out = []

        def flushed():
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], names=kinds.names)
        for conv_id, turns in _conversations(batches, 6):
            out.append((conv_id, *_signed(turns)))
            if len(out) == 1000:
                yield flushed()
                out = []
        if out:
            yield flushed()
    return map_batches(ordered, run, schema)


# --- the repaired conversations ------------------------------------------------------

def _repaired(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The (role, text) turns that the audit's edits make of ``turns``."""
    state = START
    for letter in audit:
        role, text = (ROLES[TURNS_TO[state]], "") if letter == "I" else next(turns)
        if letter == "D":
            continue
        if letter == "R":
            role = ROLES[TURNS_TO[state]]
        state = KEEPS[role[:1], state]
        yield role, text


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Per conversation its row of ``found``, then its turns in order, in one sorted partition."""
    filled = _filled(rows).withColumn("digest", F.unhex(F.sha2("text", 256)))
    heads = found.select("conv_id", F.struct(*[c for c in found.columns if c != "conv_id"]).alias("head"))
    both = heads.unionByName(filled, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").isNull(), "turn", "role", "digest") \
        .select("conv_id", "role", "text", "head")


def _found(rows: DataFrame, conversations: DataFrame | None) -> DataFrame:
    signed = stored(signatures(rows, conversations), "signatures")
    return signed.join(stored(audits(signed), "audits"), "signature").drop("signature")


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row a conversation: conv_id, the counts, cost, audit and repaired_sha256 (of its repaired ``role:text``
    turns, joined by newlines)."""
    found = _found(rows, conversations)
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {COUNTS}, cost long, audit string, repaired_sha256 string"
    kinds = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa
        out = []

        def flushed():
            return pa.RecordBatch.from_pylist(out, schema=kinds)
        for conv_id, group in _conversations(batches, 4):
            head, digest, first = next(group)[3], hashlib.sha256(), True
            for role, text in _repaired(head["audit"], ((r[1], r[2]) for r in group)):
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8"))
                first = False
            out.append({"conv_id": conv_id, **head, "repaired_sha256": digest.hexdigest()})
            if len(out) == 1000:
                yield flushed()
                out = []
        if out:
            yield flushed()
    return map_batches(_with_audits(rows, found), run, schema)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, at (from 0), role, text."""
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, at long, role string, text string"
    kinds = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa
        out, held = [], 0
        for conv_id, group in _conversations(batches, 4):
            head = next(group)[3]
            for at, (role, text) in enumerate(_repaired(head["audit"], ((r[1], r[2]) for r in group))):
                out.append({"conv_id": conv_id, "at": at, "role": role, "text": text})
                held += len(text) + 100
                if held > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)
    return map_batches(_with_audits(rows, _found(rows, None)), run, schema)


def report(rows: DataFrame) -> DataFrame:
    """The contract's digest: ``rows`` damaged, then repaired; a conversation that lost all its turns has an empty result."""
    return repair(damage(rows), conversations=rows)
