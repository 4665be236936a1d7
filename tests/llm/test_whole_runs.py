"""Line runs by the whole definition: any run of enough words that begins earlier, extended as far as it is the same."""

import random
from collections import defaultdict

import pytest

from isofield.llm.op1_line_dedup import deduplicated, whole_oracle


def whole(texts, least):
    """Lines left of each text, every earlier occurrence of a line tried."""
    seen, out, lines = defaultdict(list), [], [t.split("\n") for t in texts]
    for k, own in enumerate(lines):
        gone = set()
        for i, line in enumerate(own):
            for a, b in seen[line]:
                n = 0
                while i + n < len(own) and b + n < len(lines[a]) and own[i + n] == lines[a][b + n]:
                    n += 1
                if sum(len(x.split()) for x in own[i : i + n]) >= least:
                    gone.update(range(i, i + n))
            seen[line].append((k, i))
        out.append([x for i, x in enumerate(own) if i not in gone])
    return out


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def left(spark, texts, least):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: (r["text"], r["n_lines"] - r["n_removed"]) for r in deduplicated(d, least, whole=True).collect()}


def test_short_last_lines_go_too(spark):
    copied = "\n".join(words(n, k) for n, k in (("a", 60), ("b", 5), ("c", 40)))
    got = left(spark, [copied + "\n" + words("d", 70), copied + "\n" + words("e", 70)], 50)
    assert got[1] == (words("e", 70), 1) and got[0][1] == 4


@pytest.mark.parametrize("least", [3, 9])
def test_against_the_definition(spark, least):
    rng = random.Random(least)
    texts = ["\n".join(words(rng.choice("ab"), rng.choice((0, 1, 2, 7))) for _ in range(rng.randint(1, 14))) for _ in range(40)]
    got = left(spark, texts, least)
    for i, x in enumerate(whole(texts, least)):
        assert got[i] == ("\n".join(x), len(x))


def test_sql_of_whole_runs(spark, docs, duck, same):
    for least in (1, 4, 50):
        same(deduplicated(docs, least, whole=True).toPandas(), duck(whole_oracle(least), documents=docs.toArrow()))
