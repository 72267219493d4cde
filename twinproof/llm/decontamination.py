"""Benchmark decontamination: runs of words that a test item also has.

Test items become windows of ``n`` consecutive normalised words. Their hashes are
broadcast in blocks of a fixed number of words. Of a benchmark of several blocks,
each makes a pass of its own over the documents: its hits (no texts) are written and
its broadcast is dropped before the next one is sent, so no task ever holds more than one
block, whatever the benchmark's size. A window is looked up by hash only
where all its words are words of the benchmark, and a hit is verified word by word.

Defined results: null or empty texts have no words and no hits; items without
words have no windows; repeated item rows count once; an item without an id
marks words, but counts and lists as no item; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.tables import free_name, located, table
from twinproof.session import settle

N = 10
BLOCK_WORDS = 2_000_000  # words of test items in one broadcast

# Bytes that end a word become spaces, A-Z become a-z; digits, a-z and all of UTF-8 beyond ASCII stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPANS = "array<struct<start:int,size:int>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def rolling(ids: np.ndarray) -> np.ndarray:
    """Hash of each row of word numbers."""
    h = np.zeros(len(ids), np.uint64)
    for j in range(ids.shape[1]):
        h = h * MULTIPLIER + ids[:, j].astype(np.uint64) + np.uint64(1)
    return h


def make_book(items: list[tuple[str | None, bytes | None]], n: int) -> dict:
    """Word numbers and, by window length, the windows sorted by hash with the items they stand in."""
    vocab: dict[bytes, int] = {}
    windows: dict[int, dict[tuple, set]] = {}
    for item, text in items:
        ids = [vocab.setdefault(w, len(vocab)) for w in words_of(text)]
        if not ids:
            continue
        size = min(n, len(ids))
        for i in range(len(ids) - size + 1):
            windows.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(item)
    book = {}
    for size, found in windows.items():
        rows = np.array(list(found), np.int32).reshape(-1, size)
        order = np.argsort(rolling(rows), kind="stable")
        owners = list(found.values())
        book[size] = (rolling(rows)[order], rows[order], [sorted(x for x in owners[k] if x is not None) for k in order])
    return {"vocab": vocab, "windows": book}


def find(ids: np.ndarray, book: dict) -> list[tuple[int, int, list]]:
    """(start, size, items) of all windows in a run of word numbers, where -1 is a foreign word."""
    out = []
    known = np.concatenate([[0], np.cumsum(ids < 0)])
    for size, (hashes, rows, owners) in book["windows"].items():
        if len(ids) < size:
            continue
        at = np.flatnonzero(known[size:] == known[:-size])
        if not len(at):
            continue
        seen = ids[at[:, None] + np.arange(size)]
        h = rolling(seen)
        k = np.searchsorted(hashes, h)
        # windows of one hash stand side by side: step until the hash ends
        while len(at):
            live = (k < len(hashes)) & (hashes[np.minimum(k, len(hashes) - 1)] == h)
            at, seen, h, k = at[live], seen[live], h[live], k[live]
            same = (rows[k] == seen).all(axis=1) if len(at) else np.zeros(0, bool)
            out += [(int(a), size, owners[x]) for a, x in zip(at[same], k[same])]
            k = k + 1
    return out


def _pass(books):
    """One pass over (row, text, spans, items) that adds what a block of items hits."""

    def scan(batches):
        book = books.value
        get = book["vocab"].get
        for batch in batches:
            texts, old_spans, old_items = (batch.column(c).to_pylist() for c in (1, 2, 3))
            ids, starts = [], [0]
            counts = []
            for text in texts:
                own = words_of(text)
                counts.append(len(own))
                # a foreign word between two texts keeps windows inside one text
                ids.append(np.fromiter(itertools.chain(map(get, own, itertools.repeat(-1)), (-1,)), np.int32, len(own) + 1))
                starts.append(starts[-1] + len(own) + 1)
            found = find(np.concatenate(ids), book) if ids else []
            spans = [[(s["start"], s["size"]) for s in x] for x in old_spans]
            items = [set(x) for x in old_items]
            for at, size, owners in found:
                d = int(np.searchsorted(starts, at, side="right")) - 1
                spans[d].append((at - starts[d], size))
                items[d].update(owners)
            hits = []
            for d, own in enumerate(spans):
                merged = []
                for s, size in sorted(own):
                    if merged and s <= merged[-1][0] + merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(merged[-1][1], s + size - merged[-1][0]))
                    else:
                        merged.append((s, size))
                spans[d] = [{"start": s, "size": z} for s, z in merged]
                hits.append(sum(z for _, z in merged))
            kind = batch.schema.field(2).type
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, kind), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(counts, pa.int64()), pa.array(hits, pa.int64())],
                names=["row", "text", "spans", "items", "n_words", "n_hit"],
            )

    return scan


def _found(batches):
    """Rows with hits only, without their texts."""
    for batch in batches:
        keep = pa.compute.greater(pa.compute.list_value_length(batch.column(2)), 0)
        yield batch.filter(keep).select([0, 2, 3])


def scan(docs: DataFrame, items: DataFrame, n: int = N, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(row: all columns of ``docs``, text as bytes, spans, items, n_words, n_hit)."""
    spark = docs.sparkSession
    own = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).where(F.col("text").isNotNull()).distinct()
    size = own.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * block_words)))  # a word and its end take two bytes at least

    def book(b: int) -> dict:
        rows = own.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        return make_book([(r[0], bytes(r[1])) for r in rows], n)

    def passed(rows: DataFrame, sent) -> DataFrame:
        kind = rows.schema["row"].dataType.simpleString()
        return rows.select("row", "text", "spans", "items").mapInArrow(_pass(sent), f"row {kind}, text binary, spans {SPANS}, items array<string>, n_words bigint, n_hit bigint")

    text = F.col("text").cast("binary").alias("text")
    nothing = [F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items")]
    if blocks == 1:
        return passed(docs.select(F.struct("*").alias("row"), text, *nothing), spark.sparkContext.broadcast(book(0)))

    # One pass a block: its hits are written and its broadcast goes before the next one is sent.
    columns = docs.columns
    placed, a, b = located(docs)
    place = F.struct(F.col(a).alias("a"), F.col(b).alias("b")).alias("row")
    hits = None
    for k in range(blocks):
        sent = spark.sparkContext.broadcast(book(k))
        rows = passed(placed.select(place, text, *nothing), sent).mapInArrow(_found, f"row struct<a:bigint,b:bigint>, spans {SPANS}, items array<string>")
        part = settle(rows, "benchmark-hits")
        sent.unpersist()
        hits = part if hits is None else hits.unionByName(part)
    both = hits.groupBy("row.a", "row.b").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    met = placed.join(both, (F.col(a) == both["a"]) & (F.col(b) == both["b"]), "left")
    whole = [F.coalesce(both["spans"], nothing[0]).alias("spans"), F.coalesce(both["items"], nothing[1]).alias("items")]
    # an empty book: spans that touch become one, words are counted
    return passed(met.select(F.struct(*[placed[f"`{c}`"] for c in columns]).alias("row"), placed["text"].cast("binary").alias("text"), *whole), spark.sparkContext.broadcast({"vocab": {}, "windows": {}}))


def _cut(batches):
    """Texts without the bytes of hit words; what stood around them stays."""
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if spans:
                flat, at, ends = text.translate(FOLD), 0, []
                for w in flat.split():
                    at = flat.index(w, at)
                    ends.append((at, at + len(w)))
                    at += len(w)
                kept, last = [], 0
                for s in spans:
                    kept.append(text[last : ends[s["start"]][0]])
                    last = ends[s["start"] + s["size"] - 1][1]
                text = b"".join([*kept, text[last:]])
            texts.append(None if text is None else text.decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])


def decontaminate(docs: DataFrame, items: DataFrame, mode: str = "documents", n: int = N) -> DataFrame:
    """``docs`` without contaminated documents, or (``mode='spans'``) without their hit words."""
    found = scan(docs, items, n)
    if mode == "documents":
        return found.where("n_hit = 0").select("row.*")
    if mode != "spans":
        raise ValueError("mode is documents or spans")
    row = found.schema["row"].dataType.simpleString()
    cut = free_name(docs, "cut_text")
    cleaned = found.select("row", "text", "spans").mapInArrow(_cut, f"row {row}, text string").select("row.*", F.col("text").alias(cut))
    return cleaned.select(*[F.col(cut).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def digest(items) -> F.Column:
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(items)), ",").cast("binary"), 256)


def op3_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark
), k AS (
  SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0
), g AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM k
), l AS (
  SELECT DISTINCT n FROM g
), o AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, l WHERE len(w) >= n
), h AS (
  SELECT o.r, o.i, o.n, g.item FROM o JOIN g ON g.n = o.n AND g.x = array_to_string(o.w[o.i:o.i + o.n - 1], ' ')
), p AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r
), t AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""
