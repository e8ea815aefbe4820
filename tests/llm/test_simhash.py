"""op7 against brute force: xxHash over shingles, all pairs of prints, union-find."""

import random
import re

import pytest
import xxhash

from trafficlens.llm import simhash
from trafficlens.llm.queries import op7
from tests.conftest import SMOKE


def brute_print(text, width=3):
    low = (text or "").translate({u: u + 32 for u in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i:i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(prints, bits):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_query_on_whole_documents(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in docs]
    groups = {}
    for r, root in zip(docs, roots(prints, 2), strict=True):
        groups.setdefault(root, []).append(r.doc_id)
    want = {}
    for ids in groups.values():
        want |= {i: min(ids) for i in ids}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op7(spark, SMOKE).collect()}
    assert got == {r.doc_id: (f"{p:016x}", want[r.doc_id]) for r, p in zip(docs, prints, strict=True)}
    assert len(set(want.values())) < len(docs)


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_components_of_close_prints(spark, bits):
    rnd = random.Random(bits)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        at = rnd.getrandbits(64)
        for _ in range(8):
            prints.add(at)
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                at ^= 1 << b
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    rows = simhash.components_of_prints(spark.createDataFrame([(p,) for p in signed], "print long"), bits).collect()
    want = roots([p % (1 << 64) for p in signed], bits)
    assert {r["print"]: r["root"] for r in rows} == {p: signed[w] for p, w in zip(signed, want, strict=True)}


def test_edge_rows(spark):
    rows = [(5, None, "a"), (3, "", "b"), (4, " \t\n", "c"), (9, "one", "d"), (8, "ONE", "e"), (8, "ONE", "e"), (None, "one", "f"),
            (None, "other words here now", "g"), (7, "x " * 70000, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert len(got) == len(rows)
    zero = {g[0] for g in got if g[1] == "0" * 16}
    assert {3, 4, 5} <= zero
    assert {g[2] for g in got if g[0] in (3, 4, 5)} == {3}
    assert {g[2] for g in got if g[0] in (8, 9)} == {8}
    kept = simhash.drop_near_duplicates(docs).collect()
    assert [r.doc_id for r in kept].count(8) == 1 and 9 not in [r.doc_id for r in kept] and len(kept) == 4
    assert kept[0].asDict().keys() == {"doc_id", "text", "fingerprint"}
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0
