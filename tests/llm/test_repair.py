"""The search against an exhaustive one, the operator against a plain version, whole and in segments."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from tracegauge.llm import repair

KIND = "conv_id long, turn long, role string, text string, pos string, group string"


def all_ways(turns, deepest=3):
    """The least (cost, audit) of all edits with up to three insertions before each turn and at the end."""
    best = None
    for letters, added in product(product("DKR", repeat=len(turns)), product(range(deepest), repeat=len(turns) + 1)):
        if any(t[1] and x != "D" for t, x in zip(turns, letters, strict=True)):
            continue
        cost, audit, roles = 0, "", ""
        next_ = lambda roles: "a" if roles[-1:] == "u" else "u"
        for k, n in enumerate(added):
            for _ in range(n):
                roles, cost, audit = roles + next_(roles), cost + 2, audit + "I"
            if k < len(turns):
                audit += letters[k]
                if letters[k] == "D":
                    cost += 3
                else:
                    cost += turns[k][2] + 2 * (letters[k] == "R")
                    roles += turns[k][0] if letters[k] == "K" else next_(roles)
        if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
            best = (cost, audit)
    return best


def test_search_against_all_edits():
    rnd = random.Random(5)
    for n in range(5):
        for _ in range(40 if n < 4 else 12):
            turns = [(rnd.choice("suat"), rnd.random() < 0.2, int(rnd.random() < 0.3)) for _ in range(n)]
            assert repair.search(turns) == all_ways(turns, 2 if n > 3 else 3), turns


@pytest.mark.parametrize("pattern", ["s", "u", "a", "t", "su", "ssu", "suat", "uua"])
def test_search_of_a_whole_segment_ends_soon(pattern):
    turns = [(pattern[i % len(pattern)], False, i % 2) for i in range(repair.SEGMENT)]
    cost, audit = repair.search(turns)
    kept = repair.repaired([(t[0], "x") for t in turns], audit)
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in kept))
    assert cost == sum({"K": 0, "R": 2, "D": 3, "I": 2}[x] for x in audit) + sum(t[2] for t, x in zip(turns, audit.replace("I", ""), strict=True) if x != "D")


def brute(rows):
    """The digests of each conversation of (conv_id, turn, role, text), by one dictionary a turn."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            chance = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if chance:
                text = "" if chance == 1 else re.sub("[.!?]", "", text) if chance == 2 else text
                turns += [(turn, "user" if chance == 4 else role, text)] * (2 if chance == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        wrong, seen = [], []
        for _, role, text in turns:
            bare = text.strip(" \t\n\v\f\r")
            wrong.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.append((role, text))
        # the least by state, turn by turn
        now = {"": (0, "", [])}

        def insert(now):
            for _ in range(2):
                for state, (cost, audit, said) in list(now.items()):
                    want = "a" if state == "u" else "u"
                    new = (cost + 2, audit + "I", [*said, ("user:" if want == "u" else "assistant:")])
                    if want not in now or new[:2] < now[want][:2]:
                        now[want] = new

        for (_, role, text), fault in zip(turns, wrong, strict=True):
            insert(now)
            then = {}
            for state, (cost, audit, said) in now.items():
                want, stay = "a" if state == "u" else "u", fault == "truncated"
                new = [(state, cost + 3, audit + "D", said)]
                if fault not in ("blank", "duplicate"):
                    new.append((want, cost + 2 + stay, audit + "R", [*said, ("user:" if want == "u" else "assistant:") + text]))
                    if role[:1] == want or (role[:1] == "s" and state == ""):
                        new.append((role[:1], cost + stay, audit + "K", [*said, f"{role}:{text}"]))
                for s, *rest in new:
                    if s not in then or rest[:2] < list(then[s][:2]):
                        then[s] = tuple(rest)
            now = then
        insert(now)
        cost, audit, said = min(now[s] for s in ("", "a") if s in now)
        known = {t[0] for t in turns} - {None}
        ini = [t[1][:1] for t in turns]
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:], strict=False))
        out[conv] = (gaps, wrong.count("blank"), wrong.count("duplicate"), wrong.count("truncated"), bad, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def made(rnd, conv, n):
    return [(conv, rnd.choice([None, *range(n)]) if rnd.random() < 0.1 else i + (i > 4), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rnd.choice(["Yes.", "No", " ", "", None, f"Text {i}.", f"Text {i}"])) for i in range(n)]


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], KIND)
    found = repair.repair(repair.damaged(df)).collect()
    assert len(found) == len({r.conv_id for r in found})
    return {r.conv_id: tuple(r)[1:] for r in found}


@pytest.mark.parametrize("segment", [128, 4])
def test_operator_against_a_plain_version(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rnd = random.Random(9)
    rows = [r for conv in range(60) for r in made(rnd, conv, rnd.randrange(1, 13))]
    rows += [r for conv, n in ((100, 300), (101, 131)) for r in made(rnd, conv, n)]
    rows += [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (200, 1, "user", "x" * 200_000 + "."), (201, -(1 << 63), "user", "a."), (201, (1 << 63) - 1, "assistant", "b.")]
    found, want = got(spark, rows), brute(rows)
    for conv in want:
        if conv == 201:  # the gap is too large for a long and wraps
            assert found[conv][1:] == want[conv][1:]
        else:
            assert found[conv] == want[conv], conv


def test_many_long_conversations_are_found_by_salted_keys(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [r for conv in range(12) for r in made(rnd, conv, rnd.randrange(1, 9))]
    monkeypatch.setattr(repair, "SEGMENT", 4)
    want = got(spark, rows)
    monkeypatch.setattr(repair, "BROADCAST_ROWS", 0)
    assert got(spark, rows) == want == brute(rows)


def test_conversation_whose_turns_are_all_gone(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert got(spark, [(7, turn, "user", "a.")]) == {7: (0, 0, 0, 0, 0, 0, "", empty)}
    assert got(spark, []) == {}


@pytest.mark.parametrize("segment", [128, 3])
def test_repaired_turns_have_the_digest_of_the_repair(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rnd = random.Random(4)
    rows = repair.damaged(spark.createDataFrame([(*r, "x", "y") for conv in range(20) for r in made(rnd, conv, 8)], KIND))
    lines = {}
    for r in sorted(repair.repaired_turns(rows).collect(), key=lambda r: (r.conv_id, r.segment, r.place)):
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
    for r in repair.repair(rows).collect():
        turns = lines.get(r.conv_id, [])
        assert repair.digest(turns) == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0][0] for t in turns))
