"""op5 against brute force over word windows."""

import hashlib
import random
import re

from trafficlens.llm import decontaminate as dc
from trafficlens.llm.queries import op5
from tests.conftest import SMOKE

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({u: u + 32 for u in range(65, 91)}))


def brute(docs, items, window=10):
    table = {}
    for name, text in items:
        ws = words(text)
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1 if ws else 0):
            table.setdefault(tuple(ws[i:i + n]), set()).add(name)
    sizes = sorted({len(w) for w in table})
    for doc_id, text in docs:
        ws = words(text)
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if found := table.get(tuple(ws[i:i + n])):
                    hit |= set(range(i, i + n))
                    names |= found
        yield doc_id, len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


def test_query_on_whole_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").collect()]
    items = [(str(r[0]), r[1]) for r in spark.read.parquet(f"{SMOKE}/benchmark.parquet").collect()]
    want = sorted(brute(docs, items))
    assert rows_of(op5(spark, SMOKE)) == want
    assert any(w[-1] for w in want)


def test_random_small_alphabet(spark, monkeypatch):
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice("abc") for _ in range(n))
    items = [(i, text(rnd.choice([1, 3, 4, 5, 6, 8, 12]) + (i > 1) * 3)) for i in range(25)] + [(98, ""), (99, None), (3, "zz yy")]
    docs = [(i, text(rnd.randint(0, 60)) + rnd.choice(["", " zz-YY ", " é "]) + text(9)) for i in range(60)] + [(100, None), (101, ""), (0, "zz YY")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(docs, [(str(i), t) for i, t in items], 6))
    for block, per_pass in ((100_000, 1_000_000), (20, 40)):  # one pass, and several passes of several blocks
        monkeypatch.setattr(dc, "BLOCK_WORDS", block)
        monkeypatch.setattr(dc, "PASS_WORDS", per_pass)
        monkeypatch.setattr(dc, "WINDOW", 6)
        hits = dc.with_hits(d, b, 6)
        got = sorted((r[0], r["__llm_words"], sum(s.stop - s.start for s in r["__llm_spans"]), len(r["__llm_items"]),
                      hashlib.sha256(",".join(r["__llm_items"]).encode()).hexdigest(), bool(r["__llm_spans"])) for r in hits.collect())
        assert got == want


def test_removal_and_edge_rows(spark):
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, f"Clean start, {leak.upper()}; clean end é.", 3, "x"), (2, leak, 1, "x"), (3, None, None, None), (4, "fine", 4, "x"),
                                  (4, "fine", 4, "x")], "doc_id long, text string, n_chars long, n_words string")
    bench = spark.createDataFrame([(1, leak), (None, "eta theta"), (2, "")], "item_id long, text string")
    cut = {(r.doc_id, r.text) for r in dc.remove_leaks(docs, bench, max_coverage=0.8).collect()}
    assert cut == {(1, "Clean start, ; clean end é."), (3, None), (4, "fine")}
    assert [r.n_chars for r in dc.remove_leaks(docs, bench, max_coverage=0.8).collect() if r.doc_id == 1] == [27]
    assert sorted(r.doc_id for r in dc.remove_leaks(docs, bench).collect()) == [3, 4, 4]
    assert dc.report(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in dc.report(docs, bench.limit(0)).collect())
