"""Near duplicates of texts and vectors, and components, against all pairs."""

import math

import numpy as np
import pytest

from twinproof.llm import components as cc
from twinproof.llm import shingle_join, vector_dedup


def roots_of(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (200, 200)]
    got = {r["id"]: r["root"] for r in cc.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and got[202] == 200
    assert cc.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def near_texts(rng):
    vocab = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(vocab, n)) for n in (4, 30, 60, 120, 120)]
    out = ["", None, "one", "One", "two words", "  two\nWORDS ", " ", *map(" ".join, base)]
    for b in base:
        for _ in range(14):
            t = list(b)
            for _ in range(rng.integers(0, 3)):
                t[rng.integers(0, len(t))] = "changed" + str(rng.integers(0, 9))
            out.append(" ".join(t))
    out += [out[9]] * 12 + [" ".join(rng.choice(vocab, 40)) for _ in range(30)]
    return out


@pytest.mark.parametrize("words,percent,tile,few", [(3, 90, 1024, 16), (3, 90, 4, 2), (5, 80, 8, 0), (1, 60, 5, 3)])
def test_shingle_join_by_brute_force(spark, monkeypatch, words, percent, tile, few):
    monkeypatch.setattr(shingle_join, "TILE", tile)
    monkeypatch.setattr(shingle_join, "FEW", few)
    texts = near_texts(np.random.default_rng(2))
    rows = [(1000 - i, t, "x", i) for i, t in enumerate(texts)] + [(None, texts[8], "x", 0), (3, "alone again", "x", 0), (3, "alone again", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n string, uid int")
    sets = []
    for _, t, _, _ in rows:
        w = (t or "").lower().split()
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    links = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = roots_of(len(rows), links)
    names = {}
    for i, r in enumerate(root):
        names[r] = min(names.get(r, math.inf), rows[i][0] if rows[i][0] is not None else math.inf)
    want = sorted((str(rows[i][0]), len(s), str(rows[i][0] if not s else names[root[i]])) for i, s in enumerate(sets))
    got = shingle_join.near_duplicates(docs, words, percent).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want
    kept = shingle_join.without_near_duplicates(docs, words, percent)
    assert kept.columns == docs.columns
    assert kept.count() == len({r for r, s in zip(root, sets) if s}) + sum(not s for s in sets)


def test_shingle_join_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert shingle_join.near_duplicates(none).count() == 0 and shingle_join.without_near_duplicates(none).count() == 0


def test_long_text_and_tile_arrays_agree():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 3000).astype(np.uint64)
    rows = []
    for i in range(40):
        own = np.unique(np.concatenate([base[: 2000 + 20 * i], rng.integers(0, 2**63, 30).astype(np.uint64)]))
        rows.append((0, 0, 0, 2, i, len(own), shingle_join.bitmap(own), i % 7))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=list("kijsunbr"))
    many = {r["uid"] for b in shingle_join._tiles(90)(iter([batch])) for r in b.to_pylist()}
    few = {(i, j) for i in range(40) for j in range(i + 1, 40) if i % 7 != j % 7 and shingle_join.may_link(rows[i][5], rows[j][5], int.from_bytes(rows[i][6], "little"), 8 * len(rows[i][6]), int.from_bytes(rows[j][6], "little"), 8 * len(rows[j][6]), 90)}
    assert many == {x for p in few for x in p} and few


@pytest.mark.parametrize("postings", [5, 1 << 22])
def test_tiles_decide_exactly_and_emit_what_spans(monkeypatch, postings):
    import pyarrow as pa

    monkeypatch.setattr(shingle_join, "POSTINGS", postings)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(150, 300), replace=False), rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)])) for _ in range(60)]
    for sides, tile in (([2] * 60, (1, 0, 0)), ([k % 2 for k in range(60)], (1, 0, 1))):
        rows = [(*tile, side, u, len(x), u if u % 9 else 0, x.tobytes()) for u, (x, side) in enumerate(zip(sets, sides))]
        batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=list("kijsunre"))
        got = [tuple(r.values()) for b in shingle_join._decide(60)(iter([batch.slice(0, 25), batch.slice(25)])) for r in b.to_pylist()]
        both = lambda x, y: len(np.intersect1d(sets[x], sets[y]))
        true = {(x, y) for x in range(60) for y in range(x + 1, 60) if (sides[x] == 2 or sides[x] != sides[y]) and 100 * both(x, y) >= 60 * (len(sets[x]) + len(sets[y]) - both(x, y))}
        known = [(0, u) for u in range(0, 60, 9)]
        assert set(got) <= true and len(got) < 60
        assert roots_of(60, known + got) == roots_of(60, known + list(true))


def vectors_fixture():
    rng = np.random.default_rng(6)
    rows = []
    for label in (1, 2):
        centre = rng.standard_normal(16)
        for i in range(150):
            rows.append((centre + rng.standard_normal(16), label))
        for i in range(0, 60, 3):  # planted near pairs
            rows.append((rows[-150 + i][0] + 0.05 * rng.standard_normal(16), label))
    family = rng.standard_normal(16)
    rows += [(family + 0.1 * rng.standard_normal(16), 1) for _ in range(70)]
    rows += [(family, 2)] * 25 + [(rows[0][0], 2), (rows[0][0] * 3, 1)]
    rows = [([float(x) for x in v], label) for v, label in rows]
    rows += [(None, 1), ([], 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([None] * 16, 1), ([float("inf")] + [1.0] * 15, 1), (rows[5][0], None), (rows[5][0][:8], 1)]
    return [(3 * i + 1, v, label, "x") for i, (v, label) in enumerate(rows)] + [(7, rows[2][0], 1, "again")]


def test_vectors_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "TILE", 16)
    rows = vectors_fixture()
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, g string")
    usable = [i for i, (_, v, label, _) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    links = [(i, j) for x, i in enumerate(usable) for j in usable[x + 1 :] if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and cos(rows[i][1], rows[j][1]) >= 0.93]
    root = roots_of(len(rows), links)
    n = np.zeros(len(rows), int)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    first = {}
    for i, r in enumerate(root):
        first[r] = min(first.get(r, math.inf), rows[i][0])
    got = vector_dedup.near_duplicates(frame)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect())
    want = sorted((rows[i][0], int(n[i]), first[root[i]]) for i in range(len(rows)))
    found = sum(g[1] for g in got)
    assert found >= 0.9 * n.sum() and all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g == w for g, w in zip(got, want)) >= 0.97 * len(rows)
    assert vector_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_audit_sees_lost_pairs_beside_a_large_family(spark):
    """A family counted exactly does not hide that all pairs are missed."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(32)
    rows = [centre + 0.02 * rng.standard_normal(32) for _ in range(200)]
    for _ in range(60):
        x = rng.standard_normal(32)
        rows += [x, x + 0.02 * rng.standard_normal(32)]
    nodes = spark.createDataFrame([(i, "a", i, i, 1, bytearray(x.tobytes())) for i, x in enumerate(rows)], "u bigint, g string, d1 bigint, d2 bigint, n bigint, vec binary")
    family, pairs = [(i, 199) for i in range(200)], [(i, 1) for i in range(200, 320)]
    of = lambda x: spark.createDataFrame(x, "u bigint, links bigint")
    exact, tells = vector_dedup.sampled(nodes)
    assert tells and vector_dedup.recall(exact, of(family)) < vector_dedup.RECALL
    assert vector_dedup.recall(exact, of(family + pairs)) == 1


def test_sparse_links_are_audited_by_planted_neighbours(spark, monkeypatch):
    """Few links among many vectors: the sample cannot tell, the planted neighbours do, and no tile of all pairs is made."""
    monkeypatch.setattr(vector_dedup, "AUDIT_MOST", 512)
    monkeypatch.setattr(vector_dedup, "_exact", lambda *_: pytest.fail("all pairs"))
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 48))
    near = x[:20] + 0.1 * rng.standard_normal((20, 48))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.vstack([x, near]))]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    out = {r["vec_id"]: r for r in vector_dedup.near_duplicates(frame).collect()}
    assert len(out) == 3020 and sum(r["n_links"] for r in out.values()) >= 38
    assert all(out[3000 + i]["component_id"] == i for i in range(20) if out[3000 + i]["n_links"])


def test_planted_neighbours_are_just_above_the_threshold(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 24))
    nodes = spark.createDataFrame([(i, "a", i + 1, i, 1, bytearray(v.tobytes())) for i, v in enumerate(x)], "u bigint, g string, d1 bigint, d2 bigint, n bigint, vec binary")
    made = vector_dedup.planted(nodes, 300, 0.93).collect()
    assert 100 < len(made) < 200
    for r in made:
        v, own = np.frombuffer(r["vec"]), x[-r["u"] - 1]
        assert 0.93 < v @ own / np.sqrt((v @ v) * (own @ own)) < 0.9801
    edges = [(r["u"], -r["u"] - 1, 0.95) for r in made[:-20]]
    assert vector_dedup.planted_found(spark.createDataFrame(edges, "u bigint, v bigint, sim float"), 0.93) == len(made) - 20


def test_vectors_that_the_search_misses_meet_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "TILE", 16)
    monkeypatch.setattr(vector_dedup, "_start", lambda nodes, seed: spark.createDataFrame([], "u bigint, v bigint, sim float"))
    rng = np.random.default_rng(4)
    rows = []
    for size in (1, 2, 3, 40):
        x = rng.standard_normal(16)
        rows += [(len(rows) + i, (x + 0.01 * rng.standard_normal(16)).tolist(), 1, size) for i in range(size)]
    frame = spark.createDataFrame([r[:3] for r in rows], "vec_id bigint, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vector_dedup.near_duplicates(frame).collect())
    first = {size: min(r[0] for r in rows if r[3] == size) for size in (1, 2, 3, 40)}
    assert got == [(i, size - 1, first[size]) for i, _, _, size in rows]
