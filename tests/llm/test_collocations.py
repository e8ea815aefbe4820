"""op11: against a plain count of all phrases, at block sizes that cut the table anyhow."""

import random
import re
from collections import Counter

import pytest

from trafficlens.llm import collocations as co


def plain(docs, least, top, cover=80, longest=4):
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = tuple(re.findall("[^ \t]+", piece))
            totals[lang] += len(words)
            counts.update((lang, words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    rows = {}
    for (lang, words), a in found.items():
        inside = any(of == lang and len(longer) > len(words) and 100 * b >= cover * a and
                     any(longer[i:i + len(words)] == words for i in range(len(longer))) for (of, longer), b in found.items())
        if not inside:
            cuts = [(2000000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            rows.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return sorted((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score)
                  for lang, best in rows.items() for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    words = ["a", "B", "b", "é", "Éa", " ", "x\x1cy", "\U0001f600", "ab", "�"]
    out = [(None, None), ("en", ""), ("en", " .,;: \t\n"), ("fr", "a b a b a b"), (None, "a b c. A b c"), ("en", "a b " * 500)]
    for _ in range(150):
        text = "".join(rng.choices(words, [9, 5, 4, 3, 2, 1, 1, 1, 3, 1])[0] + rng.choice([" ", " ", " ", "  ", "\t", ".", ", ", "\r\n"]) for _ in range(rng.randrange(60)))
        out.append((rng.choice(["en", "en", "fr", None, "und"]), text))
    return out + out[40:60]


@pytest.mark.parametrize("block_words,least,top", [(1 << 18, 3, 1000), (40, 3, 1000), (300, 8, 7)])
def test_against_plain_counts(spark, docs, block_words, least, top):
    rows = spark.createDataFrame([(*d, "clash", 1) for d in docs], "lang string, text string, phrase string, block int").repartition(3)
    got = co.collocations(rows, least=least, top=top, block_words=block_words).collect()
    want = plain(docs, least, top)
    assert sorted(map(tuple, got)) == want and len({len(r[2].split(" ")) for r in want}) > 1


def test_empty(spark):
    rows = spark.createDataFrame([], "lang string, text string")
    assert co.collocations(rows).count() == 0
    assert co.collocations(spark.createDataFrame([("en", None)], rows.schema)).count() == 0


def test_semi_join_leaves_only_frequent_places(spark, docs, monkeypatch):
    """Each relation holds the places of its frequent groups, every one and no other."""
    rows, least, relations = spark.createDataFrame(docs, "lang string, text string").coalesce(2), 20, {}
    write = co.stored

    def watched(df, name):
        relations[name] = write(df, name)
        return relations[name]
    monkeypatch.setattr(co, "stored", watched)
    monkeypatch.setattr(co, "discard", lambda *tables: None)
    _, levels = co.frequent_phrases(rows, least=least, max_words=4, block_words=100)
    for k, group in enumerate(levels[:3], 1):
        places = sum(len(co._unpacked(r.codes)) for r in relations[f"occurrences-{k}"].collect())
        assert places == group.agg({"a": "sum"}).first()[0] and group.agg({"a": "min"}).first()[0] >= least
    assert relations["text-blocks"].count() > 10


def test_exact_beyond_64_bits(spark):
    a, big = 4 * 10**15, 9 * 10**15
    row = spark.createDataFrame([(1, "en", "x y", a, [big], [big])], "id long, lang string, phrase string, a long, heads array<long>, tails array<long>")
    assert co._scored(row, 2).first().score == 2000000 * a // (2 * big)
