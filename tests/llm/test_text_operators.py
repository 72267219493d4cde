"""Mixing, decontamination, language ID and language-model scores on small fixtures."""

import collections
import glob
import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tools.check import plain
from twinproof.llm import attention, decontamination, langid, lm_scoring, mixing
from twinproof.llm.queries import ORACLES, QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, copy int, row string, cut_text string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None, 1, "x", "y") for i, t, lang, s in rows], DOCS)


ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one two  three\nfour", "en", "b"), (4, "one two  three\nfour", "en", "b"), (None, "Été à la mer", "fr", "é"), (5, "12 34 !!", None, "b"), (6, "w " * 30_000, "en", "c")]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, data, name):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = QUERIES[name](spark, data).toPandas(), con.execute(ORACLES[name]).df()
    assert plain(got).equals(plain(want))


def test_mix_takes_near_targets_and_keeps_columns(spark):
    rows = [(i, "a b c d" if i % 2 else "a", "en", ("big", "big", "small", None)[i % 4]) for i in range(2000)]
    docs = docs_of(spark, rows)
    plan = {r["source"]: r for r in mixing.rates(docs.select("source", mixing.word_count("text").alias("size"))).collect()}
    total = sum(r["source_size"] for r in plan.values())
    assert sum(r["target"] for r in plan.values()) == pytest.approx(total)
    assert all(r["target"] <= 3 * r["source_size"] + 1e-9 for r in plan.values())
    mixed = mixing.mix(docs)
    assert mixed.columns[: len(docs.columns)] == docs.columns and mixed.columns[-1] == "copy_"
    taken = collections.Counter()
    for r in mixed.collect():
        taken[r["source"]] += len(r["text"].split())
    assert all(abs(taken[s] - r["target"]) < 0.1 * r["target"] for s, r in plan.items())
    assert sorted(map(tuple, mixed.collect()), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)


def test_mix_of_odd_rows_and_nothing(spark):
    rows = {(r["doc_id"], r["size"]): r for r in mixing.mixed_sizes(docs_of(spark, ODD)).collect()}
    assert rows[(1, 0)]["target"] == 0 and rows[(1, 0)]["taken"] == 0 and rows[(4, 4)]["taken"] <= 12
    assert mixing.mix(docs_of(spark, ODD)).where("text is null").count() == 0
    assert mixing.mixed_sizes(docs_of(spark, [])).count() == 0


def brute_hits(text, items, n=10):
    def fold(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    own, hit, who = fold(text), set(), set()
    for item, t in items:
        w = fold(t)
        k = min(n, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(own) - k + 1):
            if tuple(own[i : i + k]) in windows:
                hit.update(range(i, i + k))
                who.add(item)
    return len(own), len(hit), sorted(str(x) for x in who if x is not None)


def test_decontamination_by_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = ["ab", "Cd", "é", "x1", "zz"]
    items = [(i, " ".join(rng.choice(vocab, rng.integers(0, 14)))) for i in range(12)] + [(3, "ab ab"), (None, "only here now"), (99, None), (98, "--")]
    docs = [(i, ", ".join(rng.choice(vocab, rng.integers(0, 60))), "en", "s") for i in range(40)] + [(100, "say only HERE-now twice: only here now", "en", "s"), *ODD]
    frame, book = docs_of(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")
    for block in (2_000_000, 20):
        got = sorted((str(r["row"]["doc_id"]), r["n_words"], r["n_hit"], ",".join(r["items"])) for r in decontamination.scan(frame, book, block_words=block).collect())
        want = sorted((str(i), *b[:2], ",".join(b[2])) for i, t, _, _ in docs for b in [brute_hits(t, items)])
        assert got == want
    kept = decontamination.decontaminate(frame, book)
    assert kept.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, t, _, _ in docs if not brute_hits(t, items)[1])
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(frame, book, "spans").collect()}
    assert cut[100] == "say  twice: " and cut[1] is None
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.scan(frame, empty).where("n_hit > 0").count() == 0
    assert decontamination.scan(docs_of(spark, []), book).count() == 0
    none = decontamination.scan(frame, empty).select(decontamination.digest("items")).first()[0]
    assert none == hashlib.sha256(b"").hexdigest()


def test_language_of_held_out_rows(spark, data):
    got = QUERIES["op10_language"](spark, data).toPandas()
    lang = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(lang, on="doc_id")
    assert len(got) == len(lang) and got.score.between(0, 1).all()
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95


def test_more_than_64_languages(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(80):
        own = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(6)]
        rows += [(100 * k + i, " ".join(rng.choice(own, 12)), f"l{k}", "s") for i in range(12 if k < 70 else 6)]
    docs = docs_of(spark, rows)
    model = langid.fit(docs)
    assert sorted(model["langs"]) == sorted({r[2] for r in rows})
    got = langid.identify(docs, model).selectExpr("row.lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(rows)


def test_what_the_language_fit_and_the_sketch_send_to_the_driver_is_small():
    import pyarrow as pa

    from twinproof.llm import shingle_join

    texts = ["le chat où été " * 9, "the thing of the ", "a b", "the cat " * 400]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["fr", "en", "en", "en"])], names=["text", "lang"])
    (made,) = langid._presence([batch])
    rows = made.column(1).to_pylist()
    marked = []
    for text in texts:
        c = langid.letters(text)
        for part in (c, c[max(0, len(c) // 2 - langid.PASSAGE) :][: langid.PASSAGE]):
            marked.append(np.zeros(1 << langid.BITS, np.uint8))
            langid.mark(part, marked[-1])
    assert [len(r) for r in rows] == [2 * int(m.sum()) for m in marked]
    assert (langid._dense(rows) == np.array(marked)).all()
    packed = [np.packbits(m).tobytes() for m in marked]  # rows keep the order of their packed bits
    assert sorted(range(8), key=lambda i: rows[i]) == sorted(range(8), key=lambda i: packed[i])

    docs = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts])], names=["text"])
    parts = [p.column(1)[0].as_py() for p in shingle_join._add_cells(shingle_join._count_cells(2)([docs]))]
    assert parts and max(map(len, parts)) < (1 << shingle_join.SKETCH_BITS) // shingle_join.SEGMENTS // 50


def test_language_of_odd_rows(spark):
    taught = [(i, w * 6, lang, "s") for i in range(40) for w, lang in (("the thing of the ", "en"), ("le chat où été ", "fr"))]
    docs = docs_of(spark, taught + ODD)
    got = langid.identify(docs, langid.fit(docs)).collect()
    und = [r for r in got if r["lang_pred"] == "und"]
    assert sorted(str(r["row"]["doc_id"]) for r in und) == ["1", "2", "3", "5"] and all(r["score"] == 0 for r in und)
    assert {r["lang_pred"] for r in got} == {"en", "fr", "und"} and all("x" == r["row"]["row"] for r in got)
    blank = docs_of(spark, [(i, "text", None, "s") for i in range(5)])
    assert langid.fit(blank) is None
    assert {r["lang_pred"] for r in langid.identify(blank, None).collect()} == {"und"}
    assert langid.identify(docs_of(spark, []), None).count() == 0


def test_pipeline_keeps_unlabelled_documents(spark, data, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"{w:x}q" for w in rng.integers(0, 10**9, 12)), None, "s") for i in range(40)] + [(90, None, None, "s"), (91, "12 34 !!", None, "s")]
    docs_of(spark, rows).drop("row", "cut_text", "copy").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    first = corpus_pipeline.language(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r["doc_id"] for r in first.collect()) == list(range(40))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(range(40)) and {r["lang"] for r in out} == {None}


def test_attention_is_a_distribution_and_its_gradients_hold():
    rng = np.random.default_rng(5)
    counts = np.append(rng.integers(0, 50, 1500), 9).astype(float)
    words = attention.vocabulary(counts)
    w = {k: v.astype(np.float64) for k, v in attention.fresh(words).items()}
    text = rng.integers(0, 1500, 40).astype(np.int32)
    inputs, targets, owner = attention.windows([text, text[:0]], words)
    assert (targets >= 0).sum() == 42 and list(owner) == [0, 0, 1]
    # all ids after one context sum to one
    some = np.repeat(inputs[:1], len(counts), axis=0)
    after = np.full((len(counts), attention.CHUNK), -1)
    after[:, 7] = np.arange(len(counts))
    assert np.exp(attention.log_probs(w, words, some, after)[:, 7]).sum() == pytest.approx(1, abs=1e-6)
    # a later token does not change an earlier prediction
    later = text.copy()
    later[20:] = 3
    a, b = (attention.log_probs(w, words, *attention.windows([t], words)[:2]).ravel()[:20] for t in (text, later))
    assert np.allclose(a, b)
    grads = attention.gradients(w, words, inputs, targets)
    loss = lambda v: -attention.log_probs(v, words, inputs, targets).sum() / (targets >= 0).sum()
    for k, v in w.items():
        at = tuple(int(x) for x in rng.integers(0, v.shape))
        up, down = ({**w, k: v.copy()} for _ in "ud")
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert (loss(up) - loss(down)) / 2e-5 == pytest.approx(grads[k][at], abs=1e-6)


def test_lm_scores_by_brute_force(spark):
    rng = np.random.default_rng(8)
    vocab = ["the", "Of", "a", "été", "wörd", "x" * 400] + [f"w{i}" for i in range(60)]
    rows = [(1000 + i, " ".join(rng.choice(vocab, rng.integers(0, 50))), "en", "s") for i in range(120)] + ODD
    got = lm_scoring.score(docs_of(spark, rows)).collect()
    count = collections.Counter()
    own = lambda t: (t or "").encode().lower().split() + [b" "]
    for i, t, _, _ in rows:
        if zlib.crc32((str(i) if i is not None else "").encode()) % 5 != 1:
            count.update(own(t))
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), len(own(t)), sum(count[w] > 0 for w in own(t)), round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own(t)), 6)) for i, t, _, _ in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    # single precision depends a little on what else is in a batch
    assert len({round(r["score"], 3) for r in got if r["doc_id"] == 4}) == 1
    assert lm_scoring.score(docs_of(spark, [])).count() == 0


def test_rare_words_meet_their_counts_in_the_join(spark, monkeypatch):
    rows = [(i, "often often " + f"rare{i % 7} once{i}", "en", "s") for i in range(60)]
    whole = {r["doc_id"]: r["base_score"] for r in lm_scoring.score(docs_of(spark, rows)).collect()}
    monkeypatch.setattr(lm_scoring, "HOT_MOST", 4)
    split = {r["doc_id"]: r["base_score"] for r in lm_scoring.score(docs_of(spark, rows)).collect()}
    assert all(split[k] == pytest.approx(v) for k, v in whole.items())


def test_model_learns(spark, data):
    got = QUERIES["op1_lm_score"](spark, data).toPandas()
    held = got[got.held_out]
    per_word = held.score.sum() / held.n_tokens.sum()
    # far better than what a model that knows only id frequencies reaches
    assert per_word > 1.15 * held.base_score.sum() / held.n_tokens.sum()


def test_model_is_taught_every_training_document_once(spark, monkeypatch):
    rows = [(i, f"some words here w{i}", "en", "s") for i in range(300)]
    docs, ranks = docs_of(spark, rows), lm_scoring.read_tokenizer(lm_scoring.TOKENIZER)
    sent = spark.sparkContext.broadcast(ranks)
    taught, real = spark.sparkContext.accumulator(0), lm_scoring._train

    def counted(*args):
        def run(batches):
            def seen():
                for b in batches:
                    taught.add(b.num_rows)
                    yield b

            yield from real(*args)(seen())

        return run

    monkeypatch.setattr(lm_scoring, "_train", counted)
    lm_scoring.learn(docs, sent)
    assert taught.value == len(rows)


def test_model_is_as_good_as_the_base(spark):
    docs = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(docs):
        pytest.skip("test tables are not here")
    got = lm_scoring.score(spark.read.parquet(docs)).where("held_out").selectExpr("sum(score) / sum(base_score) as worse").first()
    assert got["worse"] <= 1


def test_subword_ids_do_not_depend_on_the_cache(monkeypatch):
    ranks, pattern = lm_scoring.read_tokenizer(lm_scoring.TOKENIZER)
    texts = [lm_scoring.words_of(t.encode()) for t in ("The mer  été", "x y z ", "", "日本 語")]
    one = lm_scoring.Ids(ranks, pattern)
    want = [one.encoding.encode_to_numpy("".join(" " + w.decode() for w in t)).tolist() for t in texts]
    assert [x.tolist() for x in one.of(texts)] == want
    monkeypatch.setattr(lm_scoring, "CACHE", 2)
    again = lm_scoring.Ids(ranks, pattern)
    assert [x.tolist() for t in texts for x in again.of([t])] == want
