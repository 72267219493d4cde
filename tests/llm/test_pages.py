"""Page extraction: hostile pages, unmarked layouts, the chain against enumeration."""

import itertools
import random
import re
import time

import pytest

from twinproof.llm import html_extract, html_pages


@pytest.fixture(scope="module")
def model():
    return html_extract.Extractor(html_extract.fit())


BODY = "".join(f"<p>This is paragraph number {i} of a longer article, which says something about it.</p>" for i in range(9))
MENU = '<ul class="menu"><li><a href="/">Home</a></li><li><a href="/x">More of it</a></li></ul>'


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><div id=wrapper><h1>A heading of it</h1>{BODY}</div></body></html>",
        f"<html><body><h1>A heading of it</h1>{BODY}</body></html>",
        f"<html><body><div class=page>{MENU}<h1>A heading of it</h1>{BODY}</div><footer>&copy; 2020 Someone</footer></body></html>",
        f"<table><tr><td><h1>A heading of it</h1>{BODY}</td></tr></table>",
    ],
)
def test_articles_without_a_container_are_kept(model, page):
    text = model.text(page).split("\n")
    assert text[0] == "A heading of it" and len(text) == 10 and text[-1].startswith("This is paragraph number 8")


def test_pages_without_tags_or_without_an_article(model):
    assert model.text("Just some text without tags. It has two sentences.") == "Just some text without tags. It has two sentences."
    assert model.text(f"<nav>{MENU}</nav><footer>&copy; 2020 Someone. All rights reserved.</footer>") == ""
    assert model.text("<form><label>Your name</label><p>Please fill in all the fields below, thank you.</p></form>") == ""
    assert model.text("") == model.text(None) == model.text("<p> </p>") == ""


def test_labels_of_layouts_not_seen(model):
    right = wrong = lost = 0
    for pieces in html_pages.labelled(200, seed=77):
        page = "".join(re.sub(r">(?=[^<\s])", f">{label}", piece) for piece, label in pieces)
        found = html_extract.blocks(page)
        gold = []
        for text, *_ in found:
            gold.append(int(text[text.index("") + 1]) if "" in text else (gold[-1] if gold else 0))
        clean = [(re.sub("[01]", "", t) or "-", *rest) for t, *rest in found]
        for y, g in zip(model.labels(clean), gold):
            right, wrong, lost = right + (y and g), wrong + (y and not g), lost + (g and not y)
    assert right / (right + wrong) > 0.98 and right / (right + lost) > 0.98


def test_viterbi_by_enumeration():
    rng = random.Random(3)
    for n in (1, 2, 5, 9):
        for _ in range(20):
            scores = [rng.gauss(0, 2) for _ in range(n)]
            trans, first = [[rng.gauss(0, 1) for _ in range(2)] for _ in range(2)], [rng.gauss(0, 1) for _ in range(2)]

            def value(y):
                return first[y[0]] + sum(s for s, k in zip(scores, y) if k) + sum(trans[a][b] for a, b in zip(y, y[1:]))

            assert value(html_extract.viterbi(scores, trans, first)) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=n))))


@pytest.mark.parametrize(
    "piece", ["<a '", "<a '>", "<b></i>", "<div>", "<!", "<!--", "<", "<b><hr>x", "<p><b>x", "<ul><li>", "<a \"'>", "&", "<script>", "</p>", "<i></b>", "<td>", '<a b="">x']
)
def test_a_hostile_page_takes_time_that_grows_with_it(piece):
    html_extract.blocks(piece * 1000)
    start = time.process_time()
    html_extract.blocks(piece * (1_000_000 // len(piece)))
    assert time.process_time() - start < 8


def test_quotes_and_comments_hide_what_looks_like_an_end():
    found = html_extract.blocks("""<p title="a > b" class='x>y'>one<!-- > <p>no --> two</p><!DOCTYPE x><p a="unclosed>three</p><p>four</p>""")
    assert [b[0] for b in found] == ["one two", "three", "four"]
    assert html_extract.blocks("1 < 2 and <3")[0][0] == "1 < 2 and <3"
