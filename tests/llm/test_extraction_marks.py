"""Class and id names against the text they stand on, and what lies beside the best container."""

import pytest

from isofield.llm.op3_extraction import main_text

TEXT = "A sentence, with commas, that goes on for long enough to count as the text of a page, and not as a caption. " * 2


@pytest.mark.parametrize("marks", ['class="content has-sidebar"', 'id="page" class="no-comments"', 'class="layout with-header"', 'class="layout hasSidebar"', 'class="sidebar-right"', 'class="post-content tags"'])
def test_wrappers_named_for_what_they_hold(marks):
    assert main_text(f"<div {marks}><p>{TEXT}</p></div>") == TEXT.strip()


def test_a_main_element_lets_its_wrapper_in():
    assert main_text(f'<div class="legal-wrap"><main><p>{TEXT}</p></main><div class="sidebar"><p>Other, things.</p></div></div>') == TEXT.strip()


@pytest.mark.parametrize("marks", ["class=comments", "class=post-comments", "class=cookie-notice", "role=complementary", "class=sidebar hidden"])
def test_what_stays_out(marks):
    assert main_text(f"<div id=main><p>{TEXT}</p></div><div {marks}><p>{TEXT * 3}</p></div>") == TEXT.strip()


def test_a_short_sidebar_stays_out():
    assert main_text(f"<div><p>{TEXT}</p></div><div class=sidebar><p>Other, things.</p></div>") == TEXT.strip()


def test_siblings_of_any_name():
    beside = "<ul><li>one<li>two</ul><blockquote>Said so</blockquote><pre>code</pre><table><tr><td>cell</table><h3>Head</h3><p>no stop</p>"
    got = main_text(f"<section><div><p>{TEXT}</p><p>{TEXT}</p></div>{beside}<section><p>{TEXT * 5}</p><p>{TEXT * 2}</p></section><ul><li><a href=x>Link, far</a></ul></section>")
    for part in ("one two", "Said so", "code", "cell", "Head", "no stop"):
        assert part in got
    assert got.count("A sentence") == 18 and "Link" not in got
