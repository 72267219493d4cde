"""Token alignment, centroid clustering and SentencePiece encoding against brute force."""

import collections
import hashlib
import itertools
import re

import numpy as np
import pytest

from twinproof.llm import centroid_clusters, piece_encoding, token_alignment

DOCS = "doc_id bigint, text string, ids string, n_a int, run bigint"
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b ", "a\n  b\t c", "\n", "\n ", " \n x", "x \n", "it's  we'll 's 12 345  6", "<|endoftext|> <s>x</s><unk> <0x0A>",
    "été œuvre 日本語　テキスト ﬁ   x​ y", "a▁b", "▁", "😀 👩‍👧 z\x00q", "w " * 3000, "x" * 5000, "x" * 5000 + " tail", "é ﻿ q", "one two", "one two",
]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], DOCS)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_pieces(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_encoding.model_path())
    return [(ids := model.encode(t or ""), model.decode(ids) if ids else "") for t in texts]


def brute_alignment(texts):
    """Overlaps by comparing all byte ranges of a text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(token_alignment.byte_bpe_path()), sentencepiece.SentencePieceProcessor(model_file=piece_encoding.model_path())
    a.encode_special_tokens = True
    letters = token_alignment.byte_letters()

    def spans(parts):
        ends = list(itertools.accumulate(map(len, parts)))
        return list(zip([0, *ends], ends))

    rows, held, docs = [], [], collections.Counter()
    for text in texts:
        ours, theirs, whole = [], [], (" " + (text or "")).encode()
        if text:
            ours, theirs = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            left = [bytes(letters[c] for c in a.id_to_token(i)) for i in ours]
            right = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, theirs)]
            if b"".join(left) != whole or b"".join(right) != whole:
                ours, theirs = [], []
        if not ours:
            rows.append((0, 0, 0, ""))
            held.append([])
            continue
        sa, sb = spans(left), spans(right)
        links, j = [], 0
        for (s, e), x in zip(sa, ours):
            while sb[j][1] <= s:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < e:
                links.append((x, theirs[k]))
                k += 1
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(x) for (s, e), x in zip(spans_, ids) if low <= s and e <= cut) for spans_, ids in ((sa, ours), (sb, theirs))) if len(ours) < 900 else None)
            low = cut
        rows.append((len(ours), len(theirs), len(cuts), ";".join(groups) if None not in groups else None))
        held.append(links)
        docs.update(set(links))
    top = collections.Counter()
    for (x, _), n in docs.items():
        top[x] = max(top[x], n)
    return [(*r[:3], len(own), sum(docs[p] == top[p[0]] for p in own), sum(docs[p] for p in own), r[3]) for r, own in zip(rows, held)], docs


def corpus(data, n=None):
    import pyarrow.parquet as pq

    return pq.read_table(f"{data}/documents.parquet", columns=["text"]).column(0).to_pylist()[:n]


def test_pieces_are_those_of_the_library(spark, data):
    texts = ODD + corpus(data)
    for limits in ({}, {"entries": 50, "size": 400}):
        got = {r["doc_id"]: r for r in piece_encoding.encode(docs_of(spark, texts).repartition(5), **limits).collect()}
        for i, (ids, text) in enumerate(brute_pieces(texts)):
            assert list(got[i]["ids"]) == ids and got[i]["decoded"] == text


def test_pieces_query_and_bytes_that_are_not_text(spark, data):
    got = {r["doc_id"]: r for r in piece_encoding.op13_pieces(spark, data).collect()}
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r, (ids, text) in zip(rows, brute_pieces([r["text"] for r in rows])):
        assert got[r["doc_id"]][1:] == (len(ids), digest(",".join(map(str, ids))), digest(text))
    bad = spark.sql("select 'k' as doc_id, cast(x'6120ff62e296' as string) as text union all select null, null")
    found = {r["doc_id"]: r for r in piece_encoding.encode(bad).collect()}
    assert found[None]["ids"] == [] and found["k"]["decoded"].startswith("a �")
    assert piece_encoding.encode(docs_of(spark, [])).count() == 0


def test_model_with_pieces_across_markers_is_not_cut():
    pieces = piece_encoding.Pieces(piece_encoding.read(piece_encoding.model_path()))
    assert pieces.separable and pieces.chunks("a  b") == [" a", "  b"]
    pieces.separable = False
    assert pieces.chunks("a  b") == [" a  b"]


@pytest.mark.parametrize("sizes", [{}, {"radix": 3, "run_docs": 7, "run_links": 300, "fan": 3}])
def test_alignment_by_brute_force(spark, data, sizes):
    texts = ODD + corpus(data, 60)
    want, docs = brute_alignment(texts)
    got = {r["doc_id"]: r for r in token_alignment.align(docs_of(spark, texts).repartition(3), **sizes).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        row = tuple(got[i])[1:]
        assert row[:6] == w[:6] and (w[6] is None or row[6] == w[6]), (i, texts[i][:40], row, w)


def test_pair_counts_and_order_of_runs(spark, data):
    texts = ODD + corpus(data, 40)
    _, docs = brute_alignment(texts)
    written = token_alignment.runs(docs_of(spark, texts).repartition(2), radix=5, run_docs=4)
    book = token_alignment.book(written, written.where("radix < 0").count(), fan=4)
    counts = {(r["a"], r["b"]): (r["documents"], r["best"]) for r in token_alignment.pair_counts(book).collect()}
    assert {p: n for p, (n, _) in counts.items()} == dict(docs)
    top = collections.Counter()
    for (a, _), n in docs.items():
        top[a] = max(top[a], n)
    assert all(best == (n == top[a]) for (a, _), (n, best) in counts.items())


def test_merge_reads_blocks(monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK", 3)
    rng = np.random.default_rng(1)
    runs, total = [], collections.Counter()
    for size in (0, 1, 2, 40, 41, 200):
        pairs = np.unique(rng.integers(0, 6, size) << token_alignment.BITS | rng.integers(0, 50, size))
        docs = rng.integers(1, 9, len(pairs)).astype(np.int32)
        total.update(dict(zip(pairs.tolist(), docs.tolist())))
        runs.append(token_alignment.Reader(token_alignment._pack(np.diff(pairs, prepend=0)), token_alignment._pack(docs), np.int32))
    out = [np.concatenate(x) for x in zip(*token_alignment.maxima(token_alignment.merge(runs)))]
    assert out[0].tolist() == sorted(total) and out[1].tolist() == [total[p] for p in sorted(total)]
    side = out[0] >> token_alignment.BITS
    assert all(best == (n == out[1][side == s].max()) for s, n, best in zip(side, out[1], out[2]))


def test_alignment_query_of_nothing_and_text_ids(spark, data):
    assert token_alignment.align(docs_of(spark, [])).count() == 0
    odd = spark.createDataFrame([(None, "a b"), ("k", "a b"), ("k", None)], "doc_id string, text string")
    rows = sorted(map(tuple, token_alignment.align(odd).collect()), key=str)
    assert [r[0] for r in rows].count("k") == 2 and sum(r[6] for r in rows) == 2 * 2 * rows[1][4]
    full = token_alignment.op11_alignment(spark, data)
    assert full.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    first = full.where("doc_id = 0 or doc_id = 1").collect()[0]
    text = spark.read.parquet(f"{data}/documents.parquet").where(f"doc_id = {first['doc_id']}").first()["text"]
    alone = token_alignment.align(docs_of(spark, [text])).first()
    assert first["groups_sha256"] == digest(alone["groups"]) and first["n_links"] == alone["n_links"]


VECTORS = "vec_id bigint, embedding array<float>, label int, cluster string, distance string"


def brute_clusters(rows, k, rounds, seed=2):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], list(map(float, v))) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (digest(f"{seed}:{'' if r[0] is None else r[0]}"), r[2]))
    centres = [list(r[1]) for r in order[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centres)) for _, v, _ in kept]

    for _ in range(rounds):
        near = assign()
        for n in range(len(centres)):
            own = [v for (_, v, _), (_, c) in zip(kept, near) if c == n]
            if own:
                centres[n] = [sum(col) // len(own) for col in zip(*own)]
    near = assign()
    inertia = collections.Counter()
    for s, c in near:
        inertia[c] += s
    return sorted(((i, c, s, inertia[c], sum(inertia.values()), digest(",".join(map(str, centres[c])))) for (i, _, _), (s, c) in zip(kept, near)), key=str)


@pytest.mark.parametrize("block", [8, 5, 64])
def test_clusters_by_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=64) * 0.3 + 2 * (i % 3)).round(1).tolist()) for i in range(60)]
    rows += [(60 + i, rows[0][1]) for i in range(40)]  # copies
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [1.0] * 63), (205, [float("nan")] * 64), (206, [float("-inf")] + [0.0] * 63)]
    frame = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], VECTORS).repartition(3)
    want = brute_clusters([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows], 6, 3)
    got, centres = centroid_clusters.cluster(frame, k=6, rounds=3, block=block)
    assert sorted(map(tuple, got.collect()), key=str) == want and centres.shape == (6, 64)


def test_clusters_of_few_rows_ties_and_limits(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], VECTORS)
    assert centroid_clusters.cluster(make([]))[0].count() == 0
    assert centroid_clusters.cluster(make([(1, None)]))[0].count() == 0
    same = [(i, [0.5] * 64) for i in range(5)]
    got = centroid_clusters.cluster(make(same))[0].collect()
    assert {r["cluster"] for r in got} == {0} and {r["distance"] for r in got} == {0}  # equal distances: the smaller number
    one = centroid_clusters.cluster(make([(1, [-0.001] * 64)]))[0].first()
    assert one["centroid_sha256"] == digest(",".join(["-1"] * 64))
    with pytest.raises(Exception, match="scaled component"):
        centroid_clusters.cluster(make([(1, [1e9] * 64)]))


def test_threshold_on_hashes_is_raised_for_repeated_ids(spark):
    rows = [(i % 12, [float(i % 12)] * 64, 1, "x", "y") for i in range(2400)]
    frame = spark.createDataFrame(rows, VECTORS)
    found = centroid_clusters.first_centroids(frame, 2400, k=40)
    order = sorted(range(12), key=lambda i: digest(f"2:{i}"))
    assert len(found) == 40 and [v[0] for v in found] == [float(order[0])] * 40
    assert len(centroid_clusters.first_centroids(frame, 10**9, k=3)) == 3


def test_dictionaries_hold_each_subvector_once():
    x = np.repeat(np.arange(6).reshape(3, 2), 4, axis=0).astype(np.int64)
    books, codes = centroid_clusters._books(np.hstack([x, x]), 2)
    assert [len(b) for b in books] == [3, 3] and np.array_equal(books[0][codes[0]], x)
