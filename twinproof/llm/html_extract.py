"""Main text of web pages: a linear-chain CRF over the leaf blocks of the DOM.

A page is cut into leaf blocks: runs of text between block-level tags, with the
open tags above them. Each block has features of its ancestors (tags, words in
class and id), its own tag and its text (length, share of link text, signs).
A two-label chain with learned transitions scores a page's blocks, and Viterbi
finds the best labelling. The weights are learned by gradient descent on the
labelled pages of ``html_pages``, on the driver, and sent to the tasks; pages are
independent, so extraction is one pass without a shuffle.

Pages are cut in time that grows with their length, whatever they hold. Where the chain keeps
no block at all, the run of blocks with most text outside of menus and the like is taken.

Defined results: null and empty pages have empty text; text in scripts, styles,
titles, templates and form fields is never a block; open tags that are never closed
end with the page; repeated rows give repeated rows, extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from twinproof.llm.html_pages import labelled
from twinproof.llm.tables import table

TRAIN_PAGES = 400
STEPS = 150
PENALTY = 1e-4

NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
QUOTED = 64  # quoted values looked for in a tag; beyond them it ends at the next >
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile("[a-z]+")
SKIPPED = frozenset("script style title textarea template svg math iframe object audio video canvas select option datalist noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
# A new block of these ends an open one (up to the container).
ENDS = {"li": ("li", ("ul", "ol", "menu")), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tr": ("tr", ("table",)), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",))}
# Words in class, id and role, by what they hint at.
HINTS = {
    "ad": "ad ads advert adverts advertisement sponsored sponsor promo promotion",
    "menu": "menu nav navbar navigation topnav breadcrumb breadcrumbs pagination pager toc",
    "side": "sidebar side aside related widget recommended more",
    "foot": "footer foot copyright colophon",
    "head": "header masthead topbar branding",
    "notice": "cookie cookies notice consent popup modal alert banner newsletter subscribe dialog gdpr",
    "talk": "comment comments discussion responses replies respondents disqus",
    "share": "share social tags byline follow",
    "form": "form login signup search",
    "main": "article content post entry story main text body prose",
}
HINT = {w: k for k, ws in HINTS.items() for w in ws.split()}
SAYS = re.compile(r"cookie|subscribe|sign up|newsletter|advert|sponsored|all rights reserved|privacy policy|log ?in\b", re.I)


class Scanner:
    """Finds tags in time that grows with the page, whatever it holds: what does not
    occur any more is not looked for again, and a tag of endless quotes ends at its first ``>``."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">'\""}

    def find(self, c: str, at: int) -> int:
        return self.page.find(c, at) if at <= self.last[c] else -1

    def end(self, at: int) -> int:
        """Behind the ``>`` that ends a tag whose name ends at ``at``; quoted ones do not. 0: none."""
        close = self.find(">", at)
        now = at
        for _ in range(QUOTED):
            stop = self.find(">", now)
            if stop < 0:
                break
            quotes = [q for c in "'\"" if 0 <= (q := self.page.find(c, now, stop))]
            if not quotes:
                return stop + 1
            now = self.find(self.page[min(quotes)], min(quotes) + 1) + 1
            if not now:
                break
        return close + 1

    def tags(self):
        """(start, end, name, attributes); the name is empty for comments and declarations, and starts with / in end tags."""
        page, at = self.page, 0
        while True:
            start = page.find("<", at)
            if start < 0 or start > self.last[">"] and not page.startswith("<!--", start):
                return
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(page)
                yield start, at, "", ""
            elif page.startswith(("<!", "<?"), start):
                end = self.find(">", start + 2)
                if end < 0:
                    return
                at = end + 1
                yield start, at, "", ""
            elif m := NAME.match(page, start + 1):
                end = self.end(m.end())
                if not end:
                    return
                skip = yield start, end, m[0].lower(), page[m.end() : end - 1]
                at = max(end, skip or 0)
                if skip is not None:
                    yield
            else:
                at = start + 1


class Open:
    """The open tags: (name, features, nearest block's place), and where each name is open."""

    def __init__(self):
        self.stack: list[tuple[str, frozenset, int]] = [("", frozenset(), 0)]
        self.places: dict[str, list[int]] = {}

    def push(self, name: str, above: frozenset) -> None:
        place = len(self.stack)
        self.stack.append((name, above, place if name in BLOCKS else self.stack[-1][2]))
        self.places.setdefault(name, []).append(place)

    def cut(self, depth: int) -> int:
        """Close everything from ``depth`` on; how many links were among it."""
        links = 0
        while len(self.stack) > depth:
            name = self.stack.pop()[0]
            self.places[name].pop()
            links += name == "a"
        return links

    def place(self, *names: str) -> int:
        """The innermost open one of these names; 0: none."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)


def blocks(page: str) -> list[tuple[str, str, frozenset, float]]:
    """(text, tag, features of the ancestors, share of link text) of each leaf block in page order."""
    out: list = []
    open_ = Open()
    stack = open_.stack
    parts: list[str] = []
    linked = links = at = 0

    def flush():
        nonlocal linked
        if parts:
            text = "".join(parts)
            parts.clear()
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                out.append((text, stack[stack[-1][2]][0], stack[-1][1], min(1.0, linked / len(text))))
        linked = 0

    def take(text):
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text.strip())

    tags = Scanner(page).tags()
    for start, end, name, attributes in tags:
        take(page[at:start])
        at = end
        if not name:
            continue
        if name[0] == "/":
            name = name[1:]
            depth = open_.place(name)
            if name in BLOCKS:
                flush()
            # an inline end tag does not close blocks
            if depth and (name in BLOCKS or stack[-1][2] < depth):
                links -= open_.cut(depth)
            continue
        if name in SKIPPED:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            tags.send(at)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
            ended, inside = ENDS.get(name, ("", ()))
            depth = open_.place("p", *ended.split())
            if depth > open_.place(*inside):
                links -= open_.cut(depth)
        if name not in VOID:
            hints = {h for _, v in ATTRIBUTE.findall(attributes) for w in WORD.findall(v.lower()) if (h := HINT.get(w))} if attributes else ()
            above = stack[-1][1]
            mine = above.union([f"in:{name}"] if name in BLOCKS and name not in ("html", "body", "head") else (), (f"hint:{h}" for h in hints))
            open_.push(name, above if mine == above else mine)
            links += name == "a"
    if at < len(page):
        take(page[at:])
    flush()
    return out


def own_features(text: str, tag: str, link_share: float) -> list[str]:
    n = len(text)
    out = ["bias", f"tag:{tag}", "len:" + ("0" if n < 15 else "1" if n < 40 else "2" if n < 120 else "3")]
    if link_share > 0:
        out.append("links:" + ("some" if link_share < 0.5 else "most"))
    if text[-1] in ".!?":
        out.append("sentence")
    if "©" in text or SAYS.search(text):
        out.append("says")
    return out


def ancestor_features(above: frozenset) -> list[str]:
    """The ancestors themselves, and pairs that change a meaning."""
    out = list(above)
    body = "in:article" in above or "in:main" in above or "hint:main" in above
    out += [f"body+{x}" for x in above if x.startswith("hint:") or x in ("in:header", "in:ul", "in:ol", "in:li", "in:aside", "in:section", "in:footer", "in:nav", "in:form", "in:article")] if body else ["outside"]
    return out


def fit(pages: int = TRAIN_PAGES, steps: int = STEPS, seed: int = 11) -> dict:
    """Weights by feature, the chain's transitions and first-label scores: maximum likelihood with a penalty."""
    names: dict[str, int] = {}
    rows, labels = [], []
    for pieces in labelled(pages, seed):
        page, marked = "", []
        for i, (piece, label) in enumerate(pieces):
            # a mark before each piece's texts tells where a block came from
            page += re.sub(r">(?=[^<\s])", f">\ue000{label}", piece)
        seen = [(t, tag, above, share) for t, tag, above, share in blocks(page)]
        x, y = [], []
        for text, tag, above, share in seen:
            y.append(int(text[text.index("\ue000") + 1]) if "\ue000" in text else (y[-1] if y else 0))
            text = re.sub("\ue000[01]", "", text) or "-"
            x.append([names.setdefault(f, len(names)) for f in own_features(text, tag, share) + ancestor_features(above)])
        if x:
            rows.append(x), labels.append(y)
    longest = max(map(len, rows))
    data = np.zeros((len(rows), longest, len(names)), np.float32)
    gold, there = np.zeros((len(rows), longest), int), np.zeros((len(rows), longest), bool)
    for i, (x, y) in enumerate(zip(rows, labels)):
        for t, f in enumerate(x):
            data[i, t, f] = 1
        gold[i, : len(y)], there[i, : len(y)] = y, True
    w, trans, first = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, trans, first)]
    total = there.sum()
    pairs = np.zeros((2, 2))
    both = there[:, 1:]
    np.add.at(pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    for step in range(1, steps + 1):
        score = np.zeros((len(rows), longest, 2))
        score[..., 1] = data @ w.astype(np.float32)
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0] + first
        for t in range(1, longest):
            go = np.logaddexp.reduce(ahead[:, t - 1, :, None] + trans, axis=1) + score[:, t]
            ahead[:, t] = np.where(there[:, t, None], go, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            go = np.logaddexp.reduce(trans + (score[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where(there[:, t + 1, None], go, 0)
        z = np.logaddexp.reduce(ahead[:, -1], axis=1)
        p = np.exp(ahead + back - z[:, None, None]) * there[..., None]
        joint = np.exp(ahead[:, :-1, :, None] + trans + (score[:, 1:] + back[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
        grads = (
            np.tensordot((p[..., 1] - gold * there).astype(np.float32), data, 2) / total + PENALTY * w,
            (joint.sum(axis=(0, 1)) - pairs) / total + PENALTY * trans,
            (p[:, 0] - np.eye(2)[gold[:, 0]]).sum(axis=0) / total + PENALTY * first,
        )
        for param, g, (m, s) in zip((w, trans, first), grads, state):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            param -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return {"weights": dict(zip(names, w.tolist())), "trans": trans.tolist(), "first": first.tolist()}


def viterbi(scores: list[float], trans: list, first: list) -> list[int]:
    """Best labels of a chain whose label 1 scores ``scores`` and label 0 scores 0."""
    (t00, t01), (t10, t11) = trans
    a, b = first[0], first[1] + scores[0]
    came = []
    for s in scores[1:]:
        to0, to1 = b + t10 > a + t00, b + t11 > a + t01
        came.append((to0, to1))
        a, b = (b + t10 if to0 else a + t00), (b + t11 if to1 else a + t01) + s
    out = [int(b > a)]
    for step in reversed(came):
        out.append(int(step[out[-1]]))
    return out[::-1]


# Ancestors under which text is no main text, even where nothing else is found.
ASIDE = frozenset([*(f"in:{t}" for t in ("nav", "aside", "footer", "form", "menu", "button", "dialog")), *(f"hint:{h}" for h in HINTS if h != "main")])
SPOKEN = 25  # characters of a sentence that a run must have


def best_run(found: list, scores: list[float]) -> list[int]:
    """Labels where the chain kept nothing: the run of blocks outside of menus, side
    boxes and the like with most text, weighed by the blocks' scores; none without a sentence."""
    best, run, mine = (0.0, 0, 0), 0, 0.0
    spoken = False
    for i, ((text, _, above, _), s) in enumerate(zip(found, scores)):
        if ASIDE & above:
            run, mine, spoken = i + 1, 0.0, False
            continue
        mine += len(text) / (1 + math.exp(min(50.0, -s)))
        spoken = spoken or (len(text) >= SPOKEN and text[-1] in ".!?") or len(text) >= 4 * SPOKEN
        if spoken and mine > best[0]:
            best = (mine, run, i + 1)
    return [int(best[1] <= i < best[2]) for i in range(len(found))]


class Extractor:
    def __init__(self, model: dict):
        self.model, self.seen = model, {}

    def labels(self, found: list) -> list[int]:
        weight = self.model["weights"].get
        scores = []
        for text, tag, above, share in found:
            base = self.seen.get(above)
            if base is None:
                base = self.seen[above] = sum(weight(f, 0.0) for f in ancestor_features(above))
            scores.append(base + sum(weight(f, 0.0) for f in own_features(text, tag, share)))
        out = viterbi(scores, self.model["trans"], self.model["first"]) if scores else []
        return out if any(out) else best_run(found, scores)

    def text(self, page: str | None) -> str:
        found = blocks(page) if page else []
        return "\n".join(b[0] for b, y in zip(found, self.labels(found)) if y)


def _extract(sent):
    def run(batches):
        own = Extractor(sent.value)
        for batch in batches:
            texts = [own.text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    sent = pages.sparkSession.sparkContext.broadcast(model or fit())
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(_extract(sent), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def op5_main_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
