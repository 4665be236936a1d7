"""Cheapest repair of conversations by Four-Russians block tables.

A turn is one symbol: the initial of its role (s, u, a or another) and its fault. What the rest of a conversation will cost from each state
(nothing said, after s, after u, after a) is a vector of four numbers; less its least number it is one of a few dozen vectors. A table
holds, for every vector and every block of ``BLOCK`` symbols, the vector before the block and what the block adds. A
conversation is read block by block from its end, one lookup a block. Then it is traced from its start: a block is expanded backward into the vectors between
its turns, and the least letter that stays cheapest is taken turn by turn, so equal costs give the ASCII-least list of edits.

Spark does the rest. Only digests are sorted and joined to find faults, so a conversation with very many turns is split over tasks there. It becomes one
string of a byte a turn, which is as large as the list of edits that it must return. Texts cross the network once, to be
streamed in order beside that list; a hash over a whole conversation can't be cut, but no task holds more of it than a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, pick

#: Symbols of a block.
BLOCK = 4
#: Turns that are joined to one string before conversations are.
SEGMENT = 4096
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: States: nothing said, after system, after user, after assistant. Where the letter of each role leads; a conversation may end in states 0 and 3.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Classes of role initials and kinds of faults; a code is class + 4 * fault.
CLASSES, FAULTS = ["s", "u", "a", "o"], ["", "blank", "duplicate", "truncated"]
#: A symbol is the code of the class, + 4 if truncated; 8: must go.
SYMBOLS, GONE = 9, 8
#: The symbol of each code.
SYMBOL = bytes([c if f == 0 else c + 4 if f == 3 else GONE for f in range(4) for c in range(4)])
EMPTY = hashlib.sha256(b"").hexdigest()
SPACES = r"\x20\x09-\x0D"


def next_role(state: int) -> tuple[str, int]:
    """The role that an inserted or renamed turn must have in ``state``, and the state after it."""
    return ("assistant", ASSISTANT) if state == USER else ("user", USER)


def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of each edit of a turn; a letter's order is its ASCII order."""
    found = [("D", DELETE, state)]
    if symbol != GONE:
        more = TRUNCATED if symbol >= 4 else 0
        kept = AFTER.get(CLASSES[symbol % 4], {}).get(state)
        if kept is not None:
            found.append(("K", more, kept))
        found.append(("R", REROLE + more, next_role(state)[1]))
    return found


def with_inserts(v: list[int]) -> tuple[int, ...]:
    """Costs by state where turns may be inserted first."""
    u, a = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return min(v[START], INSERT + u), min(v[SYSTEM], INSERT + u), u, a


def before_turn(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs by state before a turn, from those after it."""
    return with_inserts([min(cost + after[to] for _, cost, to in edits(symbol, s)) for s in range(4)])


#: What the end of a conversation costs by state: inserts until it may end.
LAST = with_inserts([0, 1 << 20, 1 << 20, 0])


class Tables:
    """All normalised vectors, and for each vector and block (its first symbol counts most) the vector before the block and the cost it adds."""

    def __init__(self) -> None:
        ids, self.vectors, steps = {LAST: 0}, [LAST], []
        for v in self.vectors:  # grows while it is read, until no vector is new
            row = []
            for symbol in range(SYMBOLS):
                u = before_turn(symbol, v)
                low = min(u)
                u = tuple(x - low for x in u)
                if u not in ids:
                    ids[u] = len(ids)
                    self.vectors.append(u)
                row.append((ids[u], low))
            steps.append(row)
        step = np.array(steps, np.int32)
        to, add = np.arange(len(ids), dtype=np.int32)[:, None], np.zeros((len(ids), 1), np.int32)
        for _ in range(BLOCK):  # one more symbol in front of every shorter block
            to, add = (np.concatenate([step[to, s, i] + (add if i else 0) for s in range(SYMBOLS)], axis=1) for i in (0, 1))
        self.step, self.to, self.add = step, to.tolist(), add.tolist()
        self.traced: dict = {}

    def expand(self, block: bytes, vector: int, state: int) -> tuple[str, int]:
        """Letters of the edits of ``block`` from ``state``, and the state after, given the vector behind the block."""
        found = self.traced.get((block, vector, state))
        if found is None:
            behind = [self.vectors[vector]]
            for symbol in reversed(block):
                behind.append(before_turn(symbol, behind[-1]))
            letters, to = "", state
            for symbol, here, after in zip(block, behind[:0:-1], behind[-2::-1], strict=True):
                letter = ""
                while letter in ("", "I"):
                    options = [*edits(symbol, to)]
                    role_state = next_role(to)[1]
                    cheapest = [(k, s) for k, cost, s in options if cost + after[s] == here[to]]
                    if INSERT + here[role_state] == here[to]:
                        cheapest.append(("I", role_state))
                    letter, to = min(cheapest)
                    letters += letter
            found = self.traced[block, vector, state] = letters, to
        return found


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def cheapest(symbols: bytes) -> tuple[int, str]:
    """(cost, letters of the edits) of a conversation, one lookup for every ``BLOCK`` symbols each way."""
    t = tables()
    head = len(symbols) % BLOCK
    codes = (np.frombuffer(symbols, np.uint8)[head:].reshape(-1, BLOCK).astype(np.int64) @ SYMBOLS ** np.arange(BLOCK)[::-1]).tolist()
    vector, cost, behind = 0, 0, []
    for code in reversed(codes):
        behind.append(vector)
        cost += t.add[vector][code]
        vector = t.to[vector][code]
    behind.append(vector)
    first = t.vectors[vector]
    for symbol in reversed(symbols[:head]):
        first = before_turn(symbol, first)
    cost += first[START]
    pieces, state = [], START
    for block, v in zip([symbols[:head], *(symbols[i : i + BLOCK] for i in range(head, len(symbols), BLOCK))], reversed(behind), strict=True):
        piece, state = t.expand(block, v, state)
        pieces.append(piece)
    while state not in (START, ASSISTANT):
        pieces.append("I")
        state = next_role(state)[1]
    return cost, "".join(pieces)


FOUND = "blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _judged(codes: pd.Series) -> pd.DataFrame:
    """Counts, cost and edits of conversations; a code is a letter from A."""
    out, legal = [], np.zeros(16, bool)
    legal[[0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]] = True  # su, ua, au
    for text in codes:
        code = np.frombuffer((text or "").encode(), np.uint8) - 65
        faults = np.bincount(code >> 2, minlength=4)
        kind = (code & 3).astype(np.int64)
        out.append((*faults[1:].tolist(), int((~legal[kind[:-1] * 4 + kind[1:]]).sum()), *cheapest(bytes(code).translate(SYMBOL + bytes(240)))))
    return pd.DataFrame(out, columns=["blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def _turns(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text without nulls (one space each; turn keeps its nulls) and same: a digest of role and text."""
    own = pick(rows, conv_id="string", turn="bigint", role="string", text="string")
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    own = own.select(space("conv_id").alias("conv"), "turn", space("role").alias("role"), space("text").alias("text"))
    return own.withColumn("same", F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))


def _code(role: Column, fault: Column) -> Column:
    """The code of a turn as a letter from A."""
    initial = F.substring(role, 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.char(F.lit(65) + kind + 4 * fault)


def _judgements(turns: DataFrame) -> DataFrame:
    """(conv, gaps and the fields of ``FOUND``) of each conversation in ``turns``."""
    blank = ~F.col("text").rlike(f"[^{SPACES}]")
    ended = F.col("text").rlike(rf"[.!?][{SPACES}]*\z")
    light = turns.select("conv", "turn", "role", "same", blank.alias("blank"), ended.alias("ended"))
    at = numbered(light, ["conv", "turn", "role", "same"], name="turns")
    first = at.groupBy("conv", "same").agg(F.min("before").alias("first"))
    fault = F.when(F.col("blank"), 1).when(F.col("before") > F.col("first"), 2).when(~F.col("ended"), 3).otherwise(0)
    coded = at.join(first, ["conv", "same"]).select("conv", "turn", "before", _code(F.col("role"), fault).alias("code"))
    # a segment's turns come by number; a conversation's segments follow one another
    part = coded.groupBy("conv", F.expr(f"before div {SEGMENT}").alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct("before", "code"))).alias("t"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).alias("distinct")
    )
    part = part.select("conv", F.struct("segment", F.array_join(F.expr("transform(t, x -> x.code)"), "").alias("codes"), "low", "high", "distinct").alias("part"))
    whole = part.groupBy("conv").agg(F.array_sort(F.collect_list("part")).alias("p"), F.min("part.low").alias("low"), F.max("part.high").alias("high"), F.sum("part.distinct").alias("distinct"))
    # a turn number on both sides of a border was counted twice
    twice = F.expr("size(filter(transform(p, (x, i) -> i > 0 and x.low = get(p, i - 1).high), x -> x))")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - (F.col("distinct") - twice), F.lit(0)).cast("bigint")
    return whole.select("conv", gaps.alias("gaps"), F.pandas_udf(_judged, FOUND)(F.array_join(F.expr("transform(p, x -> x.codes)"), "")).alias("f")).select("conv", "gaps", "f.*")


def _streams(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Every conversation's judgement, then its turns in order; a conversation lies in one partition."""
    head = found.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("same"), F.lit("").alias("text"), F.struct(*found.columns).alias("found"))
    body = turns.select("conv", F.lit(1).alias("kind"), "turn", "role", "same", "text", F.lit(None).cast(head.schema["found"].dataType).alias("found"))
    return head.unionByName(body).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "same").select("kind", "role", "text", "found")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator | None]]:
    """(judgement, (edit, role, text) of its next repaired turns) in order; (judgement, None) where a conversation ends."""
    found, at, state = None, 0, START

    def inserted() -> Iterator:
        nonlocal at, state
        while at < len(found["audit"]) and found["audit"][at] == "I":
            at += 1
            role, state = next_role(state)
            yield "I", role, ""

    for batch in batches:
        kinds, roles, texts, heads = (c.to_pylist() for c in batch.columns)
        for kind, role, text, head in zip(kinds, roles, texts, heads, strict=True):
            if kind == 0:
                if found is not None:
                    yield found, inserted()
                    yield found, None
                found, at, state = head, 0, START
                continue
            yield found, inserted()
            letter = found["audit"][at]
            at += 1
            if letter == "K":
                state = AFTER[role[0]][state]
                yield found, iter([("K", role, text)])
            elif letter == "R":
                role, state = next_role(state)
                yield found, iter([("R", role, text)])
    if found is not None:
        yield found, inserted()
        yield found, None


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, sha, some = [], hashlib.sha256(), False
    for found, turns in _repaired(batches):
        if turns is None:
            out.append(found | {"repaired_sha256": sha.hexdigest()})
            sha, some = hashlib.sha256(), False
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, schema=_schema())
                out = []
            continue
        for _, role, text in turns:
            sha.update(f"{chr(10) if some else ''}{role}:{text}".encode())
            some = True
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_schema())


def _schema() -> pa.Schema:
    longs = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return pa.schema([("conv", pa.string()), *longs, ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, place = [], 0
    schema = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    for found, turns in _repaired(batches):
        if turns is None:
            place = 0
            continue
        for edit, role, text in turns:
            out.append((found["conv"], place, edit, role, text))
            place += 1
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)


def judged(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns are taken by turn (nulls first), equal ones by role and a digest of role and text. A null conv_id, role or text counts as one space, so
    null ids are one conversation (and a text id of one space is the same). A turn without any character but ASCII white space is blank;
    else, with role and text as an earlier turn, duplicate; else, with no ``.!?`` at its end, truncated. gaps, illegal, cost and audit as
    the module says; repaired_sha256 is of ``role:text`` of the repaired turns, joined by newlines.

    ``conversations``: ids that get a row even without turns (zeros, an empty audit, the hash of nothing). An empty table gives an
    empty result. Other columns are ignored; conv_id keeps its type. Each conversation is streamed through one task, in batches.
    """
    kind = (conversations if conversations is not None else rows).schema["conv_id"].dataType
    turns = _turns(rows)
    found = _judgements(turns)
    if conversations is not None:
        ids = pick(conversations, conv_id="string").select(F.coalesce("conv_id", F.lit(" ")).alias("conv")).distinct()
        found = ids.join(found, "conv", "left").fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna("", ["audit"])
    longs = ", ".join(f"{n} long" for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    out = _streams(turns, found).mapInArrow(_hashed, f"conv string, {longs}, audit string, repaired_sha256 string")
    return out.select(F.when(F.col("conv") != " ", F.col("conv")).cast(kind).alias("conv_id"), *out.columns[1:])


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired turns of ``rows``: conv_id, place (from 0), edit (K kept, R with another role, I inserted), role, text; rules as in ``judged``."""
    turns = _turns(rows)
    out = _streams(turns, _judgements(turns)).mapInArrow(_listed, "conv string, place long, edit string, role string, text string")
    return out.select(F.when(F.col("conv") != " ", F.col("conv")).cast(rows.schema["conv_id"].dataType).alias("conv_id"), *out.columns[1:])


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with the faults that crc32 of ``conv_id:turn`` modulo 20 names: 0 dropped, 1 emptied, 2 without ``.!?``,
    3 twice, 4 said by the user. Nulls count as one space, in the key too."""
    own = pick(rows, conv_id=rows.schema["conv_id"].dataType.simpleString(), turn="bigint", role="string", text="string")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    hit = own.withColumn("f", fault).where("f != 0")
    hit = hit.select("conv_id", "turn", F.when(F.col("f") == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.expr("explode(CASE WHEN f = 3 THEN array(0, 1) ELSE array(0) END) AS copy"))
    return hit.drop("copy")


ORACLE = r"""
WITH RECURSIVE k AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes
  FROM conversations),
m AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda crc, b:
        list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)),
        4294967295::BIGINT) % 20 AS h FROM k),
d AS (SELECT c, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM m WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(strlen(role)::VARCHAR || ':' || role || text)) AS i FROM d),
f AS (SELECT c, i, turn, role, text, substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS p,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
             WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
             WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
-- states: 0 nothing said, 1 after system, 2 after user, 3 after assistant; what may be inserted before a turn
ins(f, t, cost, audit, said) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 5, 'I', E'\nuser:'), (1, 2, 5, 'I', E'\nuser:'), (3, 2, 5, 'I', E'\nuser:'), (2, 3, 5, 'I', E'\nassistant:'),
  (0, 3, 10, 'II', E'\nuser:\nassistant:'), (1, 3, 10, 'II', E'\nuser:\nassistant:'), (3, 3, 10, 'II', E'\nuser:\nassistant:'),
  (2, 2, 10, 'II', E'\nassistant:\nuser:')),
says(f, t, r, name) AS (VALUES (0, 1, 's', NULL), (0, 2, 'u', 'user'), (1, 2, 'u', 'user'), (3, 2, 'u', 'user'), (2, 3, 'a', 'assistant')),
edits AS (
  SELECT c, i, s AS f, s AS t, 2 AS cost, 'D' AS audit, '' AS said FROM f, range(4) x(s)
  UNION ALL
  SELECT c, i, says.f, says.t, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'K', E'\n' || role || ':' || text
  FROM f JOIN says ON says.r = f.r WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT c, i, says.f, says.t, CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END, 'R', E'\n' || name || ':' || text
  FROM f JOIN says ON name IS NOT NULL WHERE fault NOT IN ('blank', 'duplicate')),
dp(c, i, t, best) AS (
  SELECT DISTINCT c, 0::BIGINT, 0, {'cost': 0, 'audit': '', 'said': ''} FROM k
  UNION ALL
  SELECT dp.c, e.i, e.t, min({'cost': best.cost + ins.cost + e.cost, 'audit': best.audit || ins.audit || e.audit, 'said': best.said || ins.said || e.said})
  FROM dp JOIN ins ON ins.f = dp.t JOIN edits e ON e.c = dp.c AND e.i = dp.i + 1 AND e.f = ins.t
  GROUP BY dp.c, e.i, e.t),
n AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (p IS NOT NULL AND p || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c),
e AS (SELECT dp.c, min({'cost': best.cost + ins.cost, 'audit': best.audit || ins.audit, 'said': best.said || ins.said}) AS best
      FROM dp LEFT JOIN n ON n.c = dp.c JOIN ins ON ins.f = dp.t AND ins.t IN (0, 3) WHERE dp.i = coalesce(n.n, 0) GROUP BY dp.c)
SELECT nullif(e.c, ' ')::BIGINT AS conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0)::BIGINT AS blank,
       coalesce(n.duplicate, 0)::BIGINT AS duplicate, coalesce(n.truncated, 0)::BIGINT AS truncated, coalesce(n.illegal, 0)::BIGINT AS illegal,
       best.cost::BIGINT AS cost, best.audit AS audit, sha256(substr(best.said, 2)) AS repaired_sha256
FROM e LEFT JOIN n ON n.c = e.c
"""
