"""Long inputs end in time that grows with their length, and results equal brute force."""

import time

import numpy as np
import pytest

from isofield.llm import op2_toxicity as tox
from isofield.llm import op3_extraction as page
from isofield.llm import op4_hyperminhash as near
from isofield.llm import op10_language as lang
from isofield.llm.op1_line_dedup import deduplicated

TEXT = "A sentence, with commas, that goes on for long enough to count as the text of a page. "


def seconds(f, *args):
    began = time.time()
    f(*args)
    return time.time() - began


def test_a_million_alternating_tokens():
    assert seconds(tox.segments, [1.0, -2.0] * 500_000) < 10 and len(tox.segments([1.0, -0.5] * 1000)) == 1


@pytest.mark.parametrize("opened", ["<div>", "<blockquote>a, b ", "<ul><li>x", "<span>", "<header>", "<p><td><blockquote>", "</x>", '<div class="sidebar x">t, u'])
def test_fifty_thousand_nested_elements(opened):
    assert seconds(page.main_text, opened * 50_000 + TEXT) < 15


def slow_points(root):
    """Points by the definition: every paragraph, every ancestor."""
    sizes, nodes, out = page._sizes(root), list(page._walk(root)), {}
    weight = lambda n: page.SHARES[n] if n < len(page.SHARES) else page.SHARES[-1] * page.FADE ** (n - len(page.SHARES) + 1)
    for n in nodes:
        direct = n.name in ("div", "section", "article", "main") and any(isinstance(p, str) and p.strip() for p in n.parts)
        if n.name not in page.PARAGRAPH and not direct:
            continue
        own = " ".join(p for p in n.parts if isinstance(p, str)) if direct else page.text_of(n)
        if not own.strip() or sizes[id(n)][1] > 0.6 * max(1, sizes[id(n)][0]):
            continue
        for level, up in enumerate([n, *page._up(n)] if direct else page._up(n)):
            out[id(up)] = out.get(id(up), 0.0) + page._points(own.count(","), len(own)) * weight(level)
    return out


def test_scores_of_small_trees():
    rng = np.random.default_rng(8)
    for _ in range(300):
        parts = []
        for _ in range(rng.integers(1, 25)):
            name = rng.choice(["div", "p", "blockquote", "span", "a", "li", "td", "section"])
            parts.append(rng.choice([f"<{name}>", f"</{name}>", "word ", " a, b,", "x" * 120, " "]))
        root = page.parse("".join(parts))
        sizes = page._sizes(root)
        got, want = page._scores(list(page._walk(root)), lambda n, s=sizes: s[id(n)][1] / max(1, s[id(n)][0])), slow_points(root)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("marks", ["content has-sidebar", "layout-no-sidebar", "post search-result", "entry meta", "main with-comments", "sidebar", "newsletter"])
def test_whole_article_under_a_class_name(marks):
    assert page.main_text(f'<div class="{marks}"><p>{TEXT}</p><p>{TEXT}</p></div>') == (TEXT + TEXT).strip()


def test_pages_with_nulls_and_clashing_columns(spark):
    rows = [(1, "u", f"<p>{TEXT}", "t", 1), (1, "u", f"<p>{TEXT}", "t", 1), (None, None, None, None, None), (2, "v", "", "", 0), (3, "w", "<div>" * 3000, "x", 2)]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted(tuple(r) for r in page.extract(d).na.fill(-1, ["page_id"]).na.fill("-", ["url"]).collect())
    assert got == [(-1, "-", "", 0), (1, "u", TEXT.strip(), len(TEXT) - 1), (1, "u", TEXT.strip(), len(TEXT) - 1), (2, "v", "", 0), (3, "w", "", 0)]
    assert page.extract(d.limit(0)).count() == 0


def test_paths_of_two_to_six_languages():
    rng = np.random.default_rng(9)
    for _ in range(5000):
        k, switch = rng.integers(2, 7), 5.0
        s = rng.normal(0, rng.choice([1, 3, 6]), (rng.integers(1, 9), k))
        path, v = lang.best_path(s, switch), s[0].copy()
        for row in s[1:]:
            v = np.maximum(v, v.max() - switch) + row
        assert abs(s[np.arange(len(s)), path].sum() - switch * (np.diff(path) != 0).sum() - v.max()) < 1e-9


def test_two_gains_for_one_switch():
    assert lang.best_path(np.array([[10.0, -20, 0], [-20, 10, 0]]), 12.0).tolist() == [0, 1]


def test_sample_of_any_size(spark):
    d = spark.createDataFrame([(i, f"{w} text number {i}", w) for w in ("alpha", "beta") for i in range(3000)], "doc_id bigint, text string, lang string")
    assert lang.fit(d, 1500).langs == lang.fit(d, 10).langs == ["alpha", "beta"]
    assert lang.language(d.limit(0)).count() == 0


def test_a_repeated_document_of_many_blank_lines(spark):
    text = "\n" * 20_000 + " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(1, text), (2, text), (None, None), (3, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in deduplicated(d).collect()}
    assert got[2] == (20_001, 20_001) and got[1] == (20_001, 0) and got[None] == (0, 0) and got[3] == (1, 0)


@pytest.mark.parametrize("block", [7, 1000])
def test_groups_against_brute_force(spark, monkeypatch, block):
    """Families of texts whose members are near, nearly near, and chained."""
    monkeypatch.setattr(near, "BLOCK", block)
    rng, texts = np.random.default_rng(10), []
    for f in range(12):
        base = [f"f{f}w{i}" for i in range(40)]
        for _ in range(12):
            w = list(base)
            for i in rng.choice(40, rng.integers(0, 4), replace=False):
                w[i] = f"x{rng.integers(1000)}"
            texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(37)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in near.near_duplicates(d, 4).collect()} == {i: find(i) for i in range(len(texts))}


def test_pipeline_run(spark, sf):
    """Every stage in turn; the records hold exactly what the mixing stage kept."""
    import corpus_pipeline as p

    from isofield.llm import op9_training_order as order

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = out.persist()
    ids = sum(len(order.Tokeniser(order.read_ranks(order.VOCABULARY)).ids(r["text"] or "")) + 1 for r in docs.select("text").collect())
    assert p.run(spark, sf).selectExpr("aggregate(n_tokens, 0L, (s, x) -> s + x) AS n").groupBy().sum().first()[0] == ids
