"""Extraction keeps every section of an article, however it is wrapped, and nothing of what is around it."""

import html
import re

import pytest

from isofield.llm.op3_extraction import main_text

P = "A sentence of the text, with some words, and a comma. "
LONG = f"<p>{P * 3}</p>"
END = "End words here. " * 40


def page(body):
    return f"<html><head><title>t</title></head><body><nav><a href=/>Home</a> <a href=/x>News</a></nav>{body}<footer>Copyright</footer></body></html>"


def words(body):
    return html.unescape(re.sub(r"<[^>]+>", " ", body)).split()


WHOLE = {
    "two sections": f"<div><section><p>{P * 5}</p></section><section><p>{'Second part, ' * 18}</p></section></div>",
    "short second section": f"<div><section>{LONG * 4}</section><section><p>It is as short as this one here.</p></section></div>",
    "conclusion": f"<div id=x><section>{LONG * 10}</section><section><h2>Conclusion</h2><p>{END}</p></section></div>",
    "conclusion in divs": f"<div class=content><div>{LONG * 10}</div><div><h2>Conclusion</h2><p>{END}</p></div></div>",
    "lead": f"<div><div class=lead>{'Lead words here. ' * 25}</div><div class=body>{LONG * 8}</div></div>",
    "table rows": f"<table><tr><td>{LONG * 4}</td></tr><tr><td>{'Row words here. ' * 13}</td></tr></table>",
    "loose text": f"<div>Loose text of the container, <b>bold</b> and <a href=/y>a link</a> in it. <div>{LONG * 8}</div> Closing loose words.</div>",
    "form around a main": f"<form id=aspnet><main><article>{LONG * 4}</article></main></form>",
    "form around all": f"<form><input name=a><div class=page>{LONG * 4}</div></form>",
    "fieldset": f"<fieldset><div>{LONG * 4}</div></fieldset>",
    "dialog": f"<dialog open><div>{LONG * 4}</div></dialog>",
    "roles": f"<div role='search main'>{LONG * 4}</div>",
    "label": "<article><p>Words <label>inside a label</label> stay, as they must, in the text.</p></article>",
}


@pytest.mark.parametrize("name", WHOLE)
def test_whole(name):
    assert main_text(page(WHOLE[name])).split() == words(WHOLE[name])


@pytest.mark.parametrize(
    "around",
    [
        f"<div class=comments><p>{P * 30}</p></div>",
        "<form><label>Name</label><input><p>Write us, please, a letter.</p></form>",
        "<form class=login><p>Please log in, friend.</p></form>",
        "<div role=navigation><p>Somewhere, there, beyond.</p></div>",
        "<dialog><p>We use cookies, as all do.</p></dialog>",
        "<ul><li><a href=/1>One other story of the day</a></li><li><a href=/2>Another one, still older</a></li></ul>",
        "<a href=/a>Archive of all</a> <a href=/b>Stories</a>",
    ],
)
@pytest.mark.parametrize("text", [f"<article>{LONG * 2}</article>", f"<div>{LONG * 3}</div>"])
def test_around(around, text):
    assert main_text(page(text + around)).split() == words(text) == main_text(page(around + text)).split()


def test_many_siblings_in_linear_time():
    import time

    body = "<div>" + "<section><p>Some words, of a section.</p></section>loose " * 20_000 + "</div>"
    began = time.time()
    assert len(main_text(body).split()) == 20_000 * 6 and time.time() - began < 20


def test_pages_without_text_stay_empty():
    assert main_text(page("<form><label>User</label><input></form>")) in ("", "User") and main_text("<form><p>Log in.</p></form>") == ""
