"""op12: ids, spans and texts as the library gives them, under the given model and under the library's own maps."""

import hashlib

import pytest
import sentencepiece as sp
from pyspark.sql import functions as F

from tests.conftest import SMOKE
from trafficlens.llm import pieces
from trafficlens.llm.queries import op12

MODEL = open(pieces.MODEL, "rb").read()
TEXTS = ["", " ", "   ", "a", "hello  world ", "ﬁ Ａ  ①x", "é😀漢字́ \n\t x", "▁ ▁▁a", "<s> </s> <unk>", "\u0000a　b  c", "   lead and trail   ",
         "﻿​ a", "ｶﾞ ガ Å é", "①② ㍿", "déjà vu", "x" * 3000 + " " * 500, "word " * 2000]
MAPS = [(rule, extra) for rule in ("nmt_nfkc", "nfkc_cf", "identity")
        for extra in ({}, {"remove_extra_whitespaces": False}, {"add_dummy_prefix": False, "escape_whitespaces": True})]


def agrees(model):
    library, own = sp.SentencePieceProcessor(model_proto=model), pieces.Encoder(model)
    for text in TEXTS:
        ids, begins, ends = own.spans(text)
        want = library.encode(text, return_type="proto").pieces
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True)) == [(p.id, p.begin, p.end) for p in want], text


def test_the_given_model():
    agrees(MODEL)


@pytest.mark.parametrize("rule,extra", MAPS, ids=str)
def test_compiled_maps(rule, extra):
    spec = next(v for f, v, _, _ in pieces._fields(sp.SentencePieceNormalizer(rule_name=rule, **extra).serialized_model_proto()) if f == 3)
    agrees(pieces.with_normalizer(MODEL, spec))


def test_the_map_decides():
    """Under the map full-width letters are the plain ones, and their spans are still the source's bytes."""
    spec = next(v for f, v, _, _ in pieces._fields(sp.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()) if f == 3)
    mapped, plain = pieces.Encoder(pieces.with_normalizer(MODEL, spec)), pieces.Encoder(MODEL)
    wide = "ｈｅｌｌｏ　ｗｏｒｌｄ"
    assert mapped.spans(wide)[0].tolist() == mapped.spans("hello world")[0].tolist() != plain.spans(wide)[0].tolist()
    _, begins, ends = mapped.spans(wide)
    assert wide.encode()[begins[0]:ends[0]].decode() == "ｈｅｌｌ" and ends[-1] == len(wide.encode())


def test_query_against_the_library(spark):
    library = sp.SentencePieceProcessor(model_file=pieces.MODEL)

    def digest(s):
        return hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "")
        want.add((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids) if ids else ""), len((r.text or "").encode())))
    got = op12(spark, SMOKE).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_source_bytes").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_encode_and_decode(spark, monkeypatch):
    monkeypatch.setattr(pieces, "GROUP_TOKENS", 50)
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 2), (3, None, "x", 1), (4, "hello  world ", "x", 1), (4, "hello  world ", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded_sha256 string, n_tokens int").coalesce(1)
    out = pieces.decode(pieces.encode(docs)).collect()
    assert len(out) == len(rows)
    library = sp.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in out:
        text = r.text or ""
        assert r.ids == library.encode(text) and r.decoded == (library.decode(r.ids) if r.ids else "") and r.decoded_sha256 == "x"
        raw = text.encode()
        assert b"".join(raw[b:e] for b, e in zip(r.begins, r.ends, strict=True)) == raw
    made = pieces.report(docs).select("n_tokens", "n_source_bytes").collect()
    assert sorted(map(tuple, made)) == sorted((len(r.ids), len((r.text or "").encode())) for r in out)
    empty = docs.where("false")
    assert pieces.report(empty).count() == 0 and pieces.decode(pieces.encode(empty)).count() == 0
    assert pieces.decode(docs.select("doc_id", F.lit(None).cast("array<int>").alias("ids")).limit(1)).first().decoded == ""


def test_taken_names_are_errors(spark):
    docs = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, ids int")
    with pytest.raises(ValueError, match="ids"):
        pieces.encode(docs)
    with pytest.raises(ValueError, match="__llm_x"):
        pieces.encode(docs.drop("ids").withColumn("__llm_x", F.lit(1)))
