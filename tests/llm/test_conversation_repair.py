"""Conversation repair: tables against every list of edits, whole results against plain Python and SQL, over nulls, ties, long conversations."""

import hashlib
import random
import re
import zlib

import pytest

from isofield.llm import op12_conversation_repair as op


def plain(symbols):
    """(cost, letters) by carrying the cheapest and least list of edits of every state."""

    def spread(best):
        for _ in range(3):
            for s, (cost, letters) in list(best.items()):
                to, new = op.next_role(s)[1], (cost + op.INSERT, letters + "I")
                best[to] = min(best.get(to, new), new)
        return best

    best = {0: (0, "")}
    for y in symbols:
        after = {}
        for s, (cost, letters) in spread(dict(best)).items():
            for letter, more, to in op.edits(y, s):
                new = (cost + more, letters + letter)
                after[to] = min(after.get(to, new), new)
        best = after
    best = spread(dict(best))
    return min(best[s] for s in (0, 3) if s in best)


def test_tables_against_every_edit():
    r = random.Random(5)
    for _ in range(4000):
        symbols = bytes(r.choices(range(op.SYMBOLS), k=r.randint(0, 17)))
        assert op.cheapest(symbols) == plain(symbols)


def test_edits_of_a_turn():
    # system, user, assistant kept; a renamed or dropped turn; a turn that must go
    assert op.cheapest(bytes([0, 1, 2])) == (0, "KKK") and op.cheapest(b"") == (0, "")
    assert op.cheapest(bytes([1])) == (2, "D") and op.cheapest(bytes([1, 1])) == (1, "KR") and op.cheapest(bytes([8])) == (2, "D")
    # equal costs: the least letters
    assert op.cheapest(bytes([0])) == (2, "D") and op.cheapest(bytes([1, 6])) == (4, "DD")


def test_inserts_where_they_are_cheap(monkeypatch):
    monkeypatch.setattr(op, "INSERT", 1)
    monkeypatch.setattr(op, "LAST", op.with_inserts([0, 1 << 20, 1 << 20, 0]))
    monkeypatch.setattr(op, "tables", lambda made=[]: made[0] if made else made.append(op.Tables()) or made[0])
    r, letters = random.Random(6), set()
    for _ in range(2000):
        symbols = bytes(r.choices(range(op.SYMBOLS), k=r.randint(0, 13)))
        found = op.cheapest(symbols)
        assert found == plain(symbols)
        letters |= set(found[1])
    assert letters == set("DIKR")


def repaired(rows):
    """The contract in plain Python; rows: (conv, turn, role, text)."""
    out = {}
    for c in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == c):
            role, text = (" " if x is None else x for x in (role, text))
            h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            same = hashlib.md5(f"{len((role if h != 4 else 'user').encode())}:{'user' if h == 4 else role}{text}".encode()).hexdigest()
            turns += [(turn is not None, turn or 0, "user" if h == 4 else role, same, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3]))
        seen, faults = set(), []
        for _, _, role, _, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        kinds = ["sua".index(t[2][0]) if t[2][:1] in ("s", "u", "a") else 3 for t in turns]
        cost, audit = plain([8 if f in ("blank", "duplicate") else k + 4 * (f == "truncated") for k, f in zip(kinds, faults)])
        said, at, state = [], 0, 0
        for letter in audit:
            _, _, role, _, text = turns[at] if letter != "I" else (0, 0, "", "", "")
            at += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                role, state = op.next_role(state)
            else:
                state = "sua".index(role[0]) + 1
            said.append((letter, role, text))
        numbers = [t[1] for t in turns if t[0]]
        out[c] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum("sua?"[a] + "sua?"[b] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:])),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in said).encode()).hexdigest(), said,
        )
    return out


@pytest.fixture(scope="module")
def talks(spark):
    r = random.Random(3)
    texts = ["Yes.", "No", "yes! ", " \t", "", None, "Why?\n", "été ß.", "a.\x85", "x. \x0b"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "usurper", "User"]
    rows = [(c, None if r.random() < 0.03 else t + (t > 5), r.choice(roles), r.choice(texts)) for c in range(400) for t in range(r.randint(1, 9))]
    rows += [(None, t, r.choice(roles), r.choice(texts)) for t in range(9)] + [(500, 1, "user", "Tie."), (500, 1, "assistant", "Tie."), (500, 1, "user", "Tie.")]
    rows += [(501, t, "user" if t % 2 else "system", f"turn {t}.") for t in range(9000)] + [(502, 0, "user", "long " * 300_000 + "."), (502, 1, "assistant", "ok.")]
    return spark.createDataFrame([(*x, 7) for x in rows], "conv_id bigint, turn bigint, role string, text string, conv int").repartition(5), rows


def test_against_plain_python(talks):
    df, rows = talks
    want = repaired(rows)
    got = op.judged(op.damaged(df), df)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = {r[0]: tuple(r[1:]) for r in got.collect()}
    assert found == {c: w[:-1] for c, w in want.items()}
    # two deletions cost less than an insert, so none is ever cheapest here
    assert any(w[6] == "" for w in want.values()) and {x for w in want.values() for x in w[6]} == set("DKR")


def test_repaired_turns(talks):
    df, rows = talks
    found = {}
    for r in op.repaired(op.damaged(df)).orderBy("conv_id", "place").collect():
        found.setdefault(r["conv_id"], []).append((r["edit"], r["role"], r["text"]))
    assert found == {c: w[-1] for c, w in repaired(rows).items() if w[-1]}


def test_against_sql(spark, talks, duck, same):
    df = talks[0].where("conv_id is null or conv_id < 501")
    same(op.judged(op.damaged(df), df).toPandas(), duck(op.ORACLE, conversations=df.toArrow()))


def test_empty_and_other_ids(spark, talks):
    none = talks[0].limit(0)
    assert op.judged(op.damaged(none), none).count() == 0 and op.repaired(none).count() == 0
    named = spark.createDataFrame([("x", 0, "user", "Hi."), ("x", 1, "assistant", "Yes.")], "conv_id string, turn int, role string, text string")
    got = op.judged(named).collect()
    assert [(r["conv_id"], r["cost"], r["audit"]) for r in got] == [("x", 0, "KK")]
    assert got[0]["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()
