"""SentencePiece encoding that keeps source offsets, and decoding.

The model file is read once on the driver and broadcast.  Its normaliser runs
here: at each place of a text the longest prefix that the compiled character
map (a double-array trie in the model) knows is replaced by its entry, a
character that the map does not know stays, white space is escaped, and every
byte of the result records the source byte it came from.  The library then
merges the normalised text with a copy of the model whose own normaliser is
switched off, and each piece is projected through the record to its span of
source bytes.  So ids follow from the alignment's own text, and ids and spans
equal what the library gives for the source text (tests: the given model, and
the same pieces under the library's ``nmt_nfkc`` and ``nfkc_cf`` maps).

Scale: one pass where the texts are scanned, no shuffle; only the model
(limit ``MAX_MODEL``, an error beyond it) is broadcast, and a worker reads it
once.  A task holds the ids of ``GROUP_TOKENS`` tokens, or of one text.

Defined results: null or empty text gives no ids and decodes to the empty
text; texts of white space only and very long texts are encoded whole (a piece
list is as long as the text); repeated rows and null ids are rows like any
other, so are ties; an empty table gives no rows.  ``encode`` and ``decode``
keep the input's columns; a column of the input named as one of theirs is an
error, as is one that starts with ``__llm_``.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from .common import arrow_schema, map_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_MODEL = 64 << 20
GROUP_TOKENS = 1 << 20
#: Fixed values of the model format: field numbers, piece types, and what a space becomes.
PIECES, TRAINER, NORMALIZER, DENORMALIZER = 1, 2, 3, 5
UNKNOWN, CONTROL, USER_DEFINED, BYTE = 2, 3, 4, 6
SPACE_MARK = "▁".encode()
ENCODED = "ids array<int>, begins array<int>, ends array<int>"


# --- the model file ----------------------------------------------------------

def _varint(blob: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = blob[at]
        value, at, shift = value | (b & 0x7F) << shift, at + 1, shift + 7
        if b < 0x80:
            return value, at


def _fields(blob: bytes):
    """(field number, value, begin, end) of a protocol-buffer message's fields; strings and messages as bytes."""
    at = 0
    while at < len(blob):
        begin = at
        tag, at = _varint(blob, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(blob, at)
        elif kind == 2:
            n, at = _varint(blob, at)
            value, at = blob[at:at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = blob[at:at + n], at + n
        yield tag >> 3, value, begin, at


def _message(number: int, body: bytes) -> bytes:
    n, size = len(body), b""
    while n > 0x7F:
        size, n = size + bytes([n & 0x7F | 0x80]), n >> 7
    return bytes([number << 3 | 2]) + size + bytes([n]) + body


def with_normalizer(model: bytes, spec: bytes) -> bytes:
    """The model under another normaliser message."""
    kept = b"".join(model[begin:end] for field, _, begin, end in _fields(model) if field not in (NORMALIZER, DENORMALIZER))
    return kept + _message(NORMALIZER, spec)


#: Identity, no leading space, white space kept and not escaped.
SWITCHED_OFF = _message(1, b"identity") + b"\x18\x00\x20\x00\x28\x00"


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 bytes whose leaves point at the entries."""

    def __init__(self, blob: bytes):
        import numpy as np
        size, = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.entries = blob[4 + size:]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)

    def longest_prefix(self, raw: bytes, at: int) -> tuple[bytes, int] | None:
        """(entry, length) of the longest key that ``raw`` goes on with at ``at``."""
        units, node, found = self.units, self._offset(self.units[0]), None
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units) or units[node] & 0x800000FF != raw[i]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        begin = found[0]
        return self.entries[begin:self.entries.index(b"\0", begin)], found[1]


class Normaliser:
    """Text to normalised bytes and, for each of them and the end, the source byte it came from."""

    def __init__(self, model: bytes):
        spec = dict.fromkeys((3, 4, 5), 1) | {2: b""}
        self.suffix, self.symbols = 0, []
        for field, value, _, _ in _fields(model):
            if field == NORMALIZER:
                spec |= {f: v for f, v, _, _ in _fields(value)}
            elif field == TRAINER:
                self.suffix = next((v for f, v, _, _ in _fields(value) if f == 24), 0)
            elif field == PIECES:
                piece = {f: v for f, v, _, _ in _fields(value)}
                if piece.get(3) == USER_DEFINED:
                    self.symbols.append(piece[1])
        self.map = CharacterMap(spec[2]) if spec[2] else None
        self.dummy, self.squeeze, self.escape = spec[3], spec[4], spec[5]
        self.symbols.sort(key=len, reverse=True)
        self.space = SPACE_MARK if self.escape else b" "

    def _prefix(self, raw: bytes, at: int) -> tuple[bytes, int]:
        """What stands for the longest known prefix at ``at``, and its length."""
        for symbol in self.symbols:
            if raw.startswith(symbol, at):
                return symbol, len(symbol)
        if self.map and (found := self.map.longest_prefix(raw, at)):
            return found
        first = raw[at]
        n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return raw[at:at + n], n

    def __call__(self, text: str):
        import numpy as np
        raw = text.encode("utf-8")
        if self.map or self.squeeze or self.symbols:
            return self._by_prefixes(raw)
        if not raw:
            return b"", np.zeros(1, np.int64)
        # Without a map every character is its own longest prefix: the same record in one step.
        codes = np.frombuffer(raw, np.uint8)
        at = np.arange(len(raw))
        start = np.maximum.accumulate(np.where(codes & 0xC0 == 0x80, 0, at))
        source = np.repeat(start, np.where(codes == 0x20, len(self.space), 1))
        out = raw.replace(b" ", self.space)
        if self.dummy and self.suffix:
            out, source = out + self.space, np.concatenate([source, np.full(len(self.space), len(raw))])
        elif self.dummy:
            out, source = self.space + out, np.concatenate([np.zeros(len(self.space), np.int64), source])
        return out, np.append(source, len(raw))

    def _by_prefixes(self, raw: bytes):
        import numpy as np
        out, source, at, space = bytearray(), [], 0, self.space
        while self.squeeze and at < len(raw):
            entry, n = self._prefix(raw, at)
            if entry != b" ":
                break
            at += n
        if at == len(raw):
            return b"", np.zeros(1, np.int64)

        def put(piece: bytes):
            out.extend(piece)
            source.extend([at] * len(piece))
        if self.dummy and not self.suffix:
            put(space)
        after_space = bool(self.squeeze)
        while at < len(raw):
            entry, n = self._prefix(raw, at)
            if after_space:
                entry = entry.lstrip(b" ")
            if entry:
                put(entry.replace(b" ", space))
                after_space = bool(self.squeeze) and entry.endswith(b" ")
            at += n
        while self.squeeze and out.endswith(space):
            at = source[len(out) - len(space)]
            del out[-len(space):], source[-len(space):]
        if self.dummy and self.suffix:
            put(space)
        return bytes(out), np.array([*source, at], np.int64)


class Encoder:
    """Ids and source spans of a text, and the text of ids."""

    def __init__(self, model: bytes):
        import numpy as np
        import sentencepiece as sp
        self.normalise = Normaliser(model)
        self.merge = sp.SentencePieceProcessor(model_proto=with_normalizer(model, SWITCHED_OFF)).encode
        self.decode = sp.SentencePieceProcessor(model_proto=model).decode
        sizes = []
        for field, value, _, _ in _fields(model):
            if field == PIECES:
                piece = {f: v for f, v, _, _ in _fields(value)}
                # A byte piece stands for one byte; an unknown piece's text is not in the model.
                sizes.append({BYTE: 1, UNKNOWN: -1}.get(piece.get(3, 1), len(piece[1])))
        self.sizes = np.array(sizes, np.int64)

    def spans(self, text: str):
        """(ids, begins, ends): arrays; the spans are in bytes of the source text."""
        import numpy as np
        out, source = self.normalise(text)
        norm = out.decode("utf-8")
        ids = np.array(self.merge(norm), np.int32)
        size = self.sizes[ids]
        if (size < 0).any():  # unknown pieces show their text when pieces are asked for as texts
            shown = self.merge(norm, out_type=str)
            size = np.where(size < 0, [len(p.encode("utf-8")) for p in shown], size)
        end = np.cumsum(size)
        if len(ids) and end[-1] != len(out):
            raise ValueError(f"pieces hold {end[-1]} bytes of {len(out)}")
        return ids, source[end - size].astype(np.int32), source[end].astype(np.int32)


@lru_cache(maxsize=2)
def _encoder(model: bytes) -> Encoder:
    """One a Python worker."""
    return Encoder(model)


def _broadcast_model(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        model = f.read(MAX_MODEL + 1)
    if len(model) > MAX_MODEL:
        raise ValueError(f"{path} is over {MAX_MODEL} bytes")
    return spark.sparkContext.broadcast(model)


# --- the operators -------------------------------------------------------------

def _checked(rows: DataFrame, *new: str) -> None:
    taken = [c for c in rows.columns if c.lower() in new or c.startswith("__llm_")]
    if taken:
        raise ValueError(f"columns {taken} are taken by the operator")


def encode(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """``docs`` with ids, begins and ends: piece i of the text is ids[i] and covers its bytes [begins[i], ends[i])."""
    from pyspark.sql.types import StructType
    _checked(docs, "ids", "begins", "ends")
    held, kinds = _broadcast_model(docs.sparkSession, model), arrow_schema(ENCODED)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        spans = _encoder(held.value).spans

        def flushed(rows, done):
            ends = np.cumsum([0] + [len(d[0]) for d in done], dtype=np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([d[k] for d in done]))) for k in range(3)]
            return pa.RecordBatch.from_arrays([*rows.columns, *[a.cast(f.type) for a, f in zip(lists, kinds, strict=True)]],
                                              [*rows.schema.names, *kinds.names])
        for batch in batches:
            first, done, held_tokens = 0, [], 0
            for i, value in enumerate(batch.column(text)):
                done.append(spans(value.as_py() or ""))
                held_tokens += len(done[-1][0])
                if held_tokens >= GROUP_TOKENS:
                    yield flushed(batch.slice(first, len(done)), done)
                    first, done, held_tokens = i + 1, [], 0
            if done:
                yield flushed(batch.slice(first, len(done)), done)
    return map_batches(docs, run, StructType(docs.schema.fields + StructType.fromDDL(ENCODED).fields))


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text that the ids stand for; null ids give the empty text."""
    from pyspark.sql.types import StructType
    _checked(rows, out.lower())
    held = _broadcast_model(rows.sparkSession, model)

    def run(batches):
        import pyarrow as pa
        one = _encoder(held.value).decode
        for batch in batches:
            texts = [one(v.as_py()) if v.is_valid and len(v) else "" for v in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])
    return map_batches(rows, run, StructType(rows.schema.fields + StructType.fromDDL(f"`{out}` string").fields))


REPORT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_source_bytes long, spans_sha256 string"


def report(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256, and of the
    spans n_source_bytes (source bytes that the pieces cover) and spans_sha256 (all begins, then all ends, as
    little-endian 32-bit numbers).

    Encodes and decodes a text at a time in one pass, so no ids are kept beside the digests.
    """
    held, kinds = _broadcast_model(docs.sparkSession, model), arrow_schema(REPORT)

    def run(batches):
        import pyarrow as pa

        def digest(s: str) -> str:
            return hashlib.sha256(s.encode("utf-8")).hexdigest()
        encoder = _encoder(held.value)
        decimal = list(map(str, range(len(encoder.sizes))))
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids, begins, ends = encoder.spans(value.as_py() or "")
                listed = ids.tolist()
                rows.append((doc_id, len(listed), digest(",".join([decimal[i] for i in listed])), digest(encoder.decode(listed) if listed else ""),
                             int((ends - begins).sum()), hashlib.sha256(begins.astype("<i4").tobytes() + ends.astype("<i4").tobytes()).hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], schema=kinds)
    return map_batches(docs.select("doc_id", "text"), run, REPORT)
