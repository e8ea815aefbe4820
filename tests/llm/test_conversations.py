"""op13: the automaton against an enumeration of all edits, the counts and turns against a plain version."""

import hashlib
import itertools
import random
import re
import zlib


from tests.conftest import SF
from trafficlens.llm import conversations as cv
from trafficlens.llm.queries import op13

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def cheapest(signature):
    """(cost, audit): every sequence of edits with up to two insertions more than turns, tried out."""
    best = (10**9, "")

    def go(i, made, cost, audit, inserts):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(signature) and LEGAL.match(made):
            best = min(best, (cost, audit))
        if inserts:
            for role in "ua":
                go(i, made + role, cost + 2, audit + "I", inserts - 1)
        if i < len(signature):
            symbol = signature[i]
            go(i + 1, made, cost + 3, audit + "D", inserts)
            if symbol != "-":
                late = int(symbol.isupper())
                go(i + 1, made + symbol.lower(), cost + late, audit + "K", inserts)
                for role in "ua":
                    go(i + 1, made + role, cost + late + 2, audit + "R", inserts)
    go(0, "", 0, "", len(signature) + 2)
    return best


def test_automaton_against_all_edits():
    automaton = cv.SuffixAutomaton()
    signatures = ["".join(s) for n in range(4) for s in itertools.product("suaoSUA-", repeat=n)] + ["uuaa", "ssua", "auau", "oo-U"]
    random.Random(3).shuffle(signatures)
    for s in signatures:
        assert automaton.follow(s[::-1]) == cheapest(s), s


def test_nodes_are_made_once():
    """Sorted by their ends, conversations make one node for every different suffix, whatever their number."""
    rng = random.Random(5)
    signatures = {"".join(rng.choice("uaUA-") for _ in range(rng.randrange(1, 9))) for _ in range(3000)}
    automaton = cv.SuffixAutomaton()
    for s in sorted(s[::-1] for s in signatures):
        automaton.follow(s)
    assert automaton.made == len({s[i:] for s in signatures for i in range(len(s))}) < sum(map(len, signatures)) / 2


def plain(rows):
    """The contract, conversation by conversation."""
    out = {}
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0]):
        turns = []
        for _, turn, role, text in sorted(group, key=lambda r: r[1]):
            kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            turns += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        signature, seen, counts = "", set(), [0, 0, 0, 0, 0]
        if turns:
            counts[0] = turns[-1][0] - turns[0][0] + 1 - len({t[0] for t in turns})
        for i, (_, role, text) in enumerate(turns):
            words = text.strip(" \t\n\x0b\x0c\r")
            fault = 1 if not words else 2 if (role, text) in seen else 3 if words[-1] not in ".!?" else 0
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            counts[4] += bool(i) and turns[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
            signature += "-" if fault in (1, 2) else role[0].upper() if fault == 3 else role[0]
        cost, audit = cheapest(signature)
        made, rest = [], iter(turns)
        for letter in audit:
            expected = "assistant" if made and made[-1][0] == "u" else "user"
            if letter == "I":
                made.append(f"{expected}:")
                continue
            _, role, text = next(rest)
            if letter != "D":
                made.append(f"{expected if letter == 'R' else role}:{text}")
        out[conv] = (*counts, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def test_query_against_the_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    short = {c for c, g in itertools.groupby(sorted(r[0] for r in rows)) if len(list(g)) <= 5}  # the plain version tries all edits
    want = plain([r for r in rows if r[0] in short])
    got = {r[0]: tuple(r)[1:] for r in op13(spark, SF).collect()}
    assert set(got) == {r[0] for r in rows} and {c: got[c] for c in short} == want


def test_turns_are_legal_and_hash(spark):
    rows = spark.createDataFrame([(c, t, r, x, 1) for c, t, r, x in [
        (1, 0, "assistant", "a."), (1, 1, "user", "b"), (1, 1, "user", "b"), (2, 0, "tool", ""), (3, 0, "system", "s."), (3, None, "user", "u."), (None, 1, "user", "n?")]],
        "conv_id long, turn long, role string, text string, at int")
    turns = {}
    for r in sorted(cv.repaired_turns(rows).collect(), key=lambda r: r.at):
        turns.setdefault(r.conv_id, []).append(r)
    found = {r.conv_id: r for r in cv.repair(rows).collect()}
    for conv, r in found.items():
        made = turns.get(conv, [])
        assert LEGAL.match("".join(t.role[0] for t in made))
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in made).encode()).hexdigest()
    assert found[2].audit == "D" and found[2].blank == 1 and found[1].duplicate == 1 and found[1].cost == cheapest("aU-")[0]
    assert cv.repair(rows.where("false")).count() == 0 and cv.repaired_turns(rows.where("false")).count() == 0


def test_the_automaton_decides(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    assert cv.repair(rows).first().audit == "KI"
    monkeypatch.setattr(cv, "audits", lambda s: s.selectExpr("signature", "0L as cost", "'D' as audit").distinct())
    assert cv.repair(rows).first().repaired_sha256 == hashlib.sha256(b"").hexdigest()
