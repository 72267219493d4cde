"""Pseudonyms, pages, URLs, chats and the whole pipeline on small fixtures."""

import hashlib
import html
import random
import re

import pytest

import corpus_pipeline
from twinproof.llm import html_extract, pii, quote_links, url_rules
from twinproof.llm.html_pages import labelled


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def feistel(text, alphabets, kind, key=pii.KEY):
    """The string permutation, spelled out."""

    def shift(half, digest):
        out = []
        for i, c in enumerate(half):
            step = int(digest[i % 32 * 2 : i % 32 * 2 + 2], 16)
            out.append(next((a[(a.index(c) + step) % len(a)] for a in alphabets if c in a), c))
        return "".join(out)

    a, b = text[: len(text) // 2], text[len(text) // 2 :]
    for r in range(pii.ROUNDS):
        digest = lambda x: hashlib.sha256(f"{key}|{kind}|{r}|{x}".encode()).hexdigest()  # noqa: B023, E731
        if r % 2:
            b = shift(b, digest(a))
        elif a:
            a = shift(a, digest(b))
    return a + b


TEXTS = [
    "mail jo.Smith+1@mail7.example.com now", "ip 10.0.0.255, not 300.1.1.1 or 1.2.3.4.5", "card 4111 1111 1111 1111 and 4111111111111112 and 378282246310005", "call +1 (974) 555-3436 or +49 30 123456",
    "born 1999-12-31, 31.12.1999, 12/31/1999, 3/4/2020, not 2021-02-30 or 31.02.2001", "iban DE89 3704 0044 0532 0130 00 or GB29NWBK60161331926819, not DE00370400440532013000", "ssn 123-45-6789, not 666-45-6789", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" but b44e15e09fd311c3cf3163b66d5a9875b883d8ce',
    "version 4.0. and 2.0.", "", None, "again 4111111111111111!!", "4111111111111111 97.51.17.173", "x" * 50_000 + " 10.0.0.1",
]


def replaced(spark, texts, key=pii.KEY):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, pii_kinds string")
    done, finds = pii.with_finds(frame, key)
    assert done.columns == ["doc_id", "text", "pii_kinds", finds]
    return {r["doc_id"]: (r["text"], list(r[finds])) for r in done.collect()}


def test_pseudonyms(spark):
    got = replaced(spark, TEXTS)
    assert [got[i][1] for i in range(12)] == [["email"], ["ipv4"], ["card", "card"], ["phone", "phone"], ["date"] * 4, ["iban", "iban"], ["ssn"], ["secret"], [], [], [], ["card"]]
    mail = feistel("jo.smith+1", (pii.LOWER, pii.DIGITS, pii.LATIN), "email")
    assert got[0][0] == "mail " + mail[:3] + mail[3].upper() + mail[4:] + "@mail7.example.com now"
    body = feistel("411111111111111", (pii.DIGITS,), "card")
    card = next(body + str(d) for d in range(10) if luhn(body + str(d)))
    assert got[2][0].startswith("card " + " ".join(card[i : i + 4] for i in range(0, 16, 4)) + " and 4111111111111112 and ")
    assert luhn(got[2][0].rsplit(" ", 1)[1]) and got[11][0] == f"again {card}!!" and got[12][0].startswith(card + " ") and "97.51.17.173" not in got[12][0]
    assert re.fullmatch(r"ip (\d{1,3}\.){3}\d{1,3}, not 300.1.1.1 or 1.2.3.4.5", got[1][0]) and "10.0.0.255" not in got[1][0]
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} or \+49 \d\d \d{6}", got[3][0])
    d = re.findall(r"\d+[-./]\d+[-./]\d+", got[4][0])
    y, m, day = d[0].split("-")
    assert d[1] == f"{day}.{m}.{y}" and d[2] == f"{m}/{day}/{y}" and d[4:] == ["2021-02-30", "31.02.2001"]
    for iban in re.findall(r"(DE[\d ]+|GB\d\d[A-Z0-9]+)", got[5][0])[:2]:
        s = iban.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    assert "DE00370400440532013000" in got[5][0] and got[6][0].endswith("not 666-45-6789") and "123-45-6789" not in got[6][0]
    secret = feistel("b44e15e09fd311c3cf3163b66d5a9875b883d8ce", ("0123456789abcdef",), "secret")
    assert got[7][0] == f'token = "{secret}" but b44e15e09fd311c3cf3163b66d5a9875b883d8ce'
    assert [got[i][0] for i in (8, 9, 10)] == [TEXTS[8], "", None] and got[13][1] == ["ipv4"]
    assert replaced(spark, TEXTS[:1], "other")[0] != got[0]


def test_spellings_of_one_value_stay_linked(spark):
    same = [
        ["+49 30 123456", "+4930123456", "+49-30-123456"], ["+1 (974) 555-3436", "+19745553436", "(974) 555-3436", "(974)555-3436"], ["+353 12 34567", "+3531234567"],
        ["Jo.Smith@x.org", "jo.smith@x.org", "JO.SMITH@x.org"], ["12/25/2001", "25/12/2001"], ["1999-12-31", "31.12.1999"],
    ]
    flat = [f"see {v} there" for group in same for v in group]
    got = replaced(spark, flat)
    assert all(len(k) == 1 for _, k in got.values())

    def plain(text, kind):
        text = text[4:-6]
        if kind == "phone":
            d = re.sub(r"\D", "", text)
            return d[-10:] if len(d) == 10 or d.startswith("1") else d
        if kind == "date":
            p = list(map(int, re.split(r"[-./]", text)))
            return tuple(p if p[0] > 31 else (p[2], p[1], p[0]) if "." in text else (p[2], p[0], p[1]))
        return text.lower()

    at = 0
    for group in same:
        made = {plain(*[(t, k[0]) for t, k in [got[at + i]]][0]) for i in range(len(group))}
        assert len(made) == 1 and not any(v in got[at + i][0] for i, v in enumerate(group)), group
        at += len(group)
    odd = replaced(spark, ["ü@x.de", "ñandú@x.es", "Élan@x.fr", "a@b.cd", "(555) 123-4567"])
    assert all(odd[i][1] == ["email"] and not odd[i][0].startswith(t) for i, t in enumerate(["ü@", "ñandú@", "Élan@", "a@"]))
    assert odd[0][0][0] in pii.LATIN and odd[2][0][0].isupper()
    assert odd[4][1] == ["phone"] and re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", odd[4][0])


def test_slash_dates_of_different_days_differ(spark):
    days = [f"{a}/{b}/2001" for a in range(1, 32) for b in range(1, 32)]
    got = replaced(spark, days)

    def day(i):
        a, b = i // 31 + 1, i % 31 + 1
        m, d = (a, b) if a <= 12 else (b, a)
        return (m, d) if m <= 12 and d <= (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1] else None

    made = {}
    for i, (text, kinds) in got.items():
        assert bool(kinds) == (day(i) is not None)
        if kinds:
            made.setdefault(tuple(map(int, text.split("/"))), set()).add(day(i))
    assert all(len(v) == 1 for v in made.values()) and len(made) == 365


def test_pseudonyms_are_one_to_one(spark):
    ips = replaced(spark, [f"10.{i}.{j}.7" for i in range(30) for j in range(30)])
    assert len({t for t, _ in ips.values()}) == 900
    days = replaced(spark, [f"{y}-{m:02d}-{d:02d}" for y in (1900, 1999, 2000, 2099) for m in range(1, 13) for d in range(1, 32)])
    valid = [t for t, k in days.values() if k]
    assert len(set(valid)) == len(valid) == 1461


def brute_main(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub("</?b>", "", p))).split()) for p in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(p for p in parts if p)


def test_main_text_of_given_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == brute_main(r["html"]) and got[r["page_id"]]["n_chars"] == len(brute_main(r["html"]))


def test_block_labels_of_pages_not_learned_from():
    own, wrong, total = html_extract.Extractor(html_extract.fit()), 0, 0
    for pieces in labelled(150, seed=99):
        page = "".join(re.sub(r">(?=[^<\s])", f">{y}", x) for x, y in pieces)
        found = html_extract.blocks(page)
        gold = [int(b[0][b[0].index("") + 1]) if "" in b[0] else None for b in found]
        made = own.labels([(re.sub("[01]", "", b[0]) or "-", *b[1:]) for b in found])
        total += len(gold)
        wrong += sum(g is not None and g != m for g, m in zip(gold, made))
    assert wrong < 0.02 * total


def test_odd_pages(spark):
    page = "<body><nav><a href=x>Menu here</a></nav><article><h1>A &amp; B</h1><p>First\n  line&nbsp;of <b>bold</b> text<br>goes on here.<p>Second &#233;.<script>var a='</p>';</script><!-- no --><div class=\"ad\">Buy this now.</div></article><footer>&copy; us"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<<<>"), (1, "u", page), (5, "u", "<script>never closed")]
    got = html_extract.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, text string")).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 6 and texts[1] == "A & B\nFirst line of bold text goes on here.\nSecond é." and texts[2] == texts[3] == texts[5] == ""
    assert html_extract.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_urls(spark):
    urls = ["https://a.example.org/es/x", "https://example.org/en/12?q", "https://EXAMPLE.org/en/2", "http://org", "http://x.com/fr/", "http://x.com/de/#f", "http://notexample.org/es/", "nothing", None, "http://com/xx", "//x.org/", "http://example.org:80/es/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h")], "page_id bigint, url string, rule string")
    got = url_rules.judge(pages, url_rules.rule_frame(spark)).collect()
    made = {r["page_id"]: (r["rule"], r["verdict"]) for r in got}
    assert len(got) == 13
    assert made[0] == ("example.org/es/", "block") and made[1] == ("example.org/en/1", "block") and made[2] == ("org/", "allow") and made[3] == (None, "allow")
    assert made[4] == ("com/fr/", "allow") and made[5] == ("com/de/", "block") and made[6] == ("org/", "allow") and made[7] == made[8] == made[9] == made[10] == made[11] == (None, "allow")
    tie = spark.createDataFrame([("b.org", "/", "allow"), ("org", "/ab", "block"), ("b.org", "/", "block")], "host string, path string, verdict string")
    one = spark.createDataFrame([(1, "http://a.b.org/abc")], "page_id bigint, url string")
    assert url_rules.judge(one, tie).first()["verdict"] == "block"
    assert url_rules.judge(pages, tie.limit(0)).where("verdict = 'allow'").count() == 13
    assert url_rules.judge(pages.limit(0), tie).count() == 0
    with pytest.raises(ValueError):
        url_rules.judge(pages, spark.createDataFrame([("a", "b", "allow")], tie.schema))


def test_urls_whose_hash_prefixes_meet(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "PREFIX", 1)  # sixteen keys: nearly every expression meets foreign rules
    rules = [(f"h{i}.org", f"/{'p' * (i % 4)}", "block" if i % 2 else "allow") for i in range(60)]
    urls = [f"http://{'a.' * (i % 3)}h{i % 70}.org/{'p' * (i % 5)}{'x' * (i % 2)}" for i in range(200)] + ["http://h1.org/" + "p" * 50_000]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"), "block").collect()}
    for i, url in enumerate(urls):
        host, _, path = url[7:].partition("/")
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and f"/{path}".startswith(p)]
        assert got[i] == (max(fits)[1:] if fits else (None, "block"))


def test_quotes(spark):
    rows = [
        (1, 0, "user", "How are you?\nI ask for a friend."),
        (1, 1, "assistant", "On Monday, user wrote:\n> how are you?\n\nFine, thanks."),
        (1, 2, "user", "> Fine, thanks\n>> How are you?\n> > I ask for a friend.\nGood to hear."),
        (1, 3, "user", "> never said\nHm."), (1, 4, "user", "> Good to\n> hear.\nYes."), (1, 4, "user", "> Good to\n> hear.\nYes."),
        (2, 0, "user", "> how are you?"), (2, 1, None, None), (None, None, "user", "x"), (3, 0, "user", ""),
    ]
    got = quote_links.linked(spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, parent_turn int")).collect()
    made = {(r["conv_id"], r["turn"]): (r["text"], r["parent_turn"], r["root_turn"], r["reply_depth"], r["quote_level"], r["n_quoted"], r["n_linked"]) for r in got}
    assert len(got) == len(rows)
    assert made[(1, 0)] == ("How are you?\nI ask for a friend.", None, 0, 0, 0, 0, 0)
    assert made[(1, 1)] == ("Fine, thanks.", 0, 0, 1, 1, 1, 1)
    assert made[(1, 2)] == ("Good to hear.", 1, 0, 2, 2, 3, 3)
    assert made[(1, 3)] == ("Hm.", None, 3, 0, 1, 1, 0) and made[(1, 4)] == ("Yes.", 2, 0, 3, 1, 2, 2)  # wrapped anew, found as a whole
    assert made[(2, 0)] == ("", None, 0, 0, 1, 1, 0) and made[(2, 1)][0] is None and made[(None, None)][0] == "x" and made[(3, 0)][0] == ""
    assert quote_links.linked(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_parts_that_were_wrapped_anew(spark):
    rng = random.Random(5)
    said = [" ".join(f"w{rng.randint(0, 999)}" for _ in range(60)) for _ in range(4)]
    rows = [
        (1, 0, "u", f"{said[0]}\n\n{said[1]}"), (1, 1, "u", f"{said[2]}"),
        # the second of two paragraphs, in lines of five words
        (1, 2, "u", "\n".join("> " + " ".join(said[1].split()[i : i + 5]) for i in range(0, 60, 5)) + "\nAgreed."),
        # twenty words out of the middle of a paragraph
        (1, 3, "u", "\n".join("> " + " ".join(said[2].split()[i : i + 4]) for i in range(17, 37, 4)) + "\nNo."),
        # two passages of equal length: the later origin is the parent
        (1, 4, "u", "> Agreed.\nHm.\n> No.\nWell."),
        (1, 5, "u", "> five words of no one here at all or so it seems\nOdd."), (2, 0, "u", said[0]), (2, 1, "u", "> " + said[1]),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quote_links.linked(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)).collect()}
    parents = {k: (r["parent_turn"], r["n_linked"], r["n_quoted"]) for k, r in got.items()}
    assert parents[(1, 2)] == (0, 12, 12) and parents[(1, 3)] == (1, 5, 5) and parents[(1, 4)] == (3, 2, 2) and parents[(1, 5)] == (None, 0, 1) and parents[(2, 1)] == (None, 0, 1)
    assert [got[1, t]["place"] for t in range(6)] == [0, 2, 1, 3, 4, 5] and got[1, 4]["reply_depth"] == 2
    assert [got[2, t]["place"] for t in range(2)] == [0, 1]


def test_places_are_those_of_one_window(spark):
    rows = [(c, t, "u", f"> line {c} {t // 2}\nline {c} {t}", ) for c in range(5) for t in range(1 + 30 * (c == 3) + c)] + [(3, 4, "u", "again"), (None, 1, "u", "x"), (9, None, "u", "y")]
    out = quote_links.linked(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)).collect()
    for c in range(5):
        own = sorted((r for r in out if r["conv_id"] == c), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(own)))
        assert [(r["root_turn"], r["reply_depth"], r["turn"]) for r in own] == sorted((r["root_turn"], r["reply_depth"], r["turn"]) for r in own)
    assert all(r["place"] is None for r in out if r["conv_id"] in (None, 9))


def brute_links(rows):
    """Parents by trying every earlier message of a conversation for every quoted line."""

    def norm(t):
        return " ".join(re.findall(r"[^\W_]+", t.lower()))

    out = {}
    for conv, turn, _, text in rows:
        quotes = [m[1] for line in text.split("\n") if (m := re.match(r"> ?([^>].*)?$", line)) and m[1]]
        # a line is its first sayer's
        taken = {}
        for q in quotes:
            first = min((t for c, t, _, other in rows if c == conv and t < turn and norm(q) in {norm(x) for x in other.split("\n") if not x.startswith(">")}), default=None)
            if first is not None:
                taken[first] = taken.get(first, 0) + 1
        out[conv, turn] = max(((n, t) for t, n in taken.items()), default=(0, None))[1]
    return out


def test_lines_link_as_by_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(10):
            own = [f"sentence {rng.randint(0, 400)} of {conv}" for _ in range(rng.randint(1, 4))]
            quotes = [f"> {rng.choice(said)}" for _ in range(rng.randint(0, 3))] if said else []
            rows.append((conv, turn, "u", "\n".join([*quotes, *own])))
            said += own
    got = {(r["conv_id"], r["turn"]): r["parent_turn"] for r in quote_links.linked(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got == brute_links(rows)


def test_long_reply_chains(spark):
    rows = [(1, 0, "u", "message 0")] + [(1, i, "u", f"> message {i - 1}\nmessage {i}") for i in range(1, 20)]
    got = {r["turn"]: r for r in quote_links.linked(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert all(got[i]["reply_depth"] == i and got[i]["root_turn"] == 0 for i in range(20))
    ordered = quote_links.linked(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy(*quote_links.reply_order()).collect()
    assert [r["turn"] for r in ordered] == list(range(20))


def test_pipeline_keeps_clean_and_drops_the_rest(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, at, data)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        after.write.parquet(path)
        at = spark.read.parquet(path)
        seen[name] = {r["doc_id"]: r["text"] for r in at.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(seen["language"]) == {i for i, t in texts.items() if t and any(map(str.isalpha, t))}

    def shingles(t):
        w = t.encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 5 else frozenset([tuple(w)])

    from tests.llm.test_pairs import roots_of
    from tests.llm.test_text_operators import brute_hits

    ids = sorted(seen["language"])
    sets = [shingles(texts[i]) for i in ids]
    links = [(i, j) for i in range(len(ids)) for j in range(i + 1, len(ids)) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert set(seen["near_duplicates"]) == {ids[r] for r in roots_of(len(ids), links)}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert set(seen["decontaminate"]) == {i for i in seen["near_duplicates"] if not brute_hits(texts[i], items)[1]}
    assert set(seen["pseudonyms"]) == set(seen["decontaminate"]) and set(seen["mix"]) <= set(seen["pseudonyms"])
    assert not any(re.search(r"\+1 \(\d{3}\) 555-\d{4}", t) and t == texts[i] for i, t in seen["pseudonyms"].items())


def test_stages_on_odd_rows(spark, data):
    from tests.llm.test_text_operators import ODD, docs_of

    docs = docs_of(spark, ODD)
    for _, stage in corpus_pipeline.STAGES:
        for frame in (docs, docs.limit(0)):
            made = stage(spark, frame, data)
            made.collect()
            assert made.columns[: len(docs.columns)] == docs.columns
