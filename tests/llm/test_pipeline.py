"""The pipeline's stages against plain versions on whole small tables."""

from collections import Counter

import corpus_pipeline as cp
from tests.conftest import SF, SMOKE
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_simhash import brute_print, roots
from tests.llm.test_token_shards import decoded
from trafficlens.llm import mixing, quality, token_shards
from trafficlens.llm.common import stored


def test_each_stage_on_what_its_predecessor_kept(spark):
    first = docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns

    def step(k):
        out = stored(cp.STAGES[k][1](spark, docs, SF), f"stage-{k}")
        assert out.columns == columns
        return out, [r.asDict() for r in out.collect()]
    before = [r.asDict() for r in docs.collect()]
    good = {r.doc_id for r in quality.report(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    docs, rows = step(0)
    assert sorted(map(str, rows)) == sorted(str(r) for r in before if r["doc_id"] in good) and 0 < len(rows) < len(before)

    group = roots([brute_print(r["text"]) for r in rows], 2)
    least = {}
    for r, g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    want = sorted(str(r) for r in rows if r["doc_id"] in set(least.values()))
    before = rows
    docs, rows = step(1)
    assert sorted(map(str, rows)) == want and len(rows) < len(before)

    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d, *_, hit in leaks([(r["doc_id"], r["text"]) for r in rows], items) if not hit}
    want = sorted(str(r) for r in rows if r["doc_id"] in clean)
    before = rows
    docs, rows = step(2)
    assert sorted(map(str, rows)) == want and len(rows) < len(before)

    plan = {r.doc_id: r for r in mixing.mix_report(docs).collect()}
    old = {r["doc_id"]: r for r in rows}
    docs, rows = step(3)
    words = lambda t: len((t or "").encode().split())
    taken, copies = Counter(), Counter()
    for r in rows:
        taken[r["doc_id"]] += words(r["text"])
        copies[r["doc_id"]] += 1
        whole = old[r["doc_id"]]
        assert r == whole or (" ".join(whole["text"].split()).startswith(r["text"]) and r["n_chars"] == len(r["text"]))
    assert {i: n for i, n in taken.items() if n} == {i: p.taken for i, p in plan.items() if p.taken}
    assert dict(copies) == {i: p.n_copies for i, p in plan.items() if p.n_copies}

    shards = stored(cp.write_tokens(spark, docs, SF), "stage-4")
    assert {i for r in shards.collect() for i in r.doc_ids} == set(copies)
    assert first.count() > docs.count() - sum(copies.values()) + len(copies)


def test_run_and_its_shards(spark, monkeypatch):
    folders = []
    write = token_shards.write_shards
    monkeypatch.setattr(token_shards, "write_shards", lambda docs, folder, *a, **b: folders.append((docs, folder)) or write(docs, folder, *a, **b))
    slots = cp.run(spark, SMOKE)
    n = slots.count()
    docs, folder = folders[0]
    texts = decoded(token_shards.read_slots(spark, folder, 0, n).collect(), token_shards.SEQUENCE_TOKENS)
    want = [r.text or "" for r in docs.collect()]
    assert n > 0 and texts[:len(want)] == want


def test_stages_on_edge_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "word " * 30000, "en", "a", 150000), (3, "same text here", "en", None, 14),
            (3, "same text here", "en", None, 14), (4, " \n ", None, "b", 3)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size string, score int")
    for some in (docs, docs.limit(0)):
        some = stored(some, "edge")
        for _, stage in cp.STAGES[:-1]:
            some = stored(stage(spark, some, SMOKE), "edge")
            assert some.columns == docs.columns
        cp.write_tokens(spark, some, SMOKE).collect()
