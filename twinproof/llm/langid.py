"""Language identification with string kernels.

The kernel of two texts counts the character n-grams (n = 1..``SPECTRUM``) present
in both, over the square root of what each has: a blended-spectrum presence
kernel. ``LANDMARKS`` labelled texts give a Nyström map, kernel ridge regression
learns one score per language, and texts are scored by matrix products in batches.

The fit uses at most about ``FIT_ROWS`` labelled rows (or ``FIT_EACH`` per language,
where that is more), drawn by a hash with a share per language (a documented bound of
the classifier alone); every language with a label takes part. Each row gives its whole
text and one passage of it, as short texts have to be told apart too. Scoring
reads every whole text.

Defined results: ``und`` with score 0 where a text is null, empty or has no letter,
and everywhere if nothing labelled is there to learn from; rows with null labels
do not teach; repeated rows and extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.llm.tables import table

SPECTRUM = 3
BITS = 16  # n-grams are counted in so many hashed cells
LAST = (1 << BITS) - 1
FIT_ROWS = 3000
LANDMARKS = 256
FIT_EACH = 16  # rows that a language gives at least, where it has them
PASSAGE = 60  # characters
RIDGE = 0.01
SHARPNESS = 4.0
UNKNOWN = "und"
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))
BATCH = 64

_LETTERS: dict = {}


def letters(text: str | None) -> np.ndarray:
    """Code points in lower case with every run of other characters as one space."""
    if not _LETTERS:
        _LETTERS["table"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _LETTERS["table"][points]
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    c = np.where(is_letter, points, 32).astype(np.uint64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    return np.concatenate([[np.uint64(32)], c[keep], [np.uint64(32)]]).astype(np.uint64)


def _lettered(batches):
    """Whether each text has a letter, as ``letters`` sees it."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(letters(t)) > 0 for t in batch.column(1).to_pylist()], pa.bool_())], names=["row", "lettered"])


def with_letters(docs: DataFrame) -> DataFrame:
    """The rows whose text has a letter."""
    kept = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    return kept.mapInArrow(_lettered, f"row {kept.schema['row'].dataType.simpleString()}, lettered boolean").where("lettered").select("row.*")


def mark(c: np.ndarray, row: np.ndarray) -> None:
    """Sets the cells of all n-grams of ``c``."""
    h = np.zeros(len(c), np.uint64)
    for n in range(SPECTRUM):
        h = (h[: len(c) - n] + c[n:]) * MULTIPLIERS[n]
        row[(h >> np.uint64(64 - BITS)).astype(np.int32)] = 1
        h = h[:-1]


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows the classifier never learns from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _presence(batches):
    """Cells of the whole text and of one passage of it: two bytes a cell, highest number first,
    counted from the last cell, so that rows sort by these bytes as they would by their packed bits."""
    for batch in batches:
        langs, rows = [], []
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            c = letters(text)
            at = max(0, len(c) // 2 - PASSAGE)
            for part in (c, c[at : at + PASSAGE]):
                if len(part) >= SPECTRUM:
                    row = np.zeros(1 << BITS, np.uint8)
                    mark(part, row)
                    rows.append((LAST - np.flatnonzero(row)).astype(">u2").tobytes())
                    langs.append(lang)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], names=["lang", "cells"])


def _dense(rows: list[bytes]) -> np.ndarray:
    """Presence rows with one byte a cell, of the cells that ``_presence`` wrote."""
    out = np.zeros((len(rows), 1 << BITS), np.uint8)
    for row, cells in zip(out, rows):
        row[LAST - np.frombuffer(cells, ">u2").astype(np.int64)] = 1
    return out


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, landmarks: int = LANDMARKS) -> dict | None:
    """Learns from labelled rows outside ``held_out``; None without any."""
    taught = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = taught.groupBy("lang").count().collect()
    if not counts:
        return None
    each = max(fit_rows / len(counts), FIT_EACH)
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in counts], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / 1_000_003
    found = taught.select("text", "lang", draw.alias("draw")).join(F.broadcast(shares), "lang").where("draw < share").select("text", "lang").mapInArrow(_presence, "lang string, cells binary").toArrow()
    if not found.num_rows:
        return None
    found = found.take(pc.sort_indices(found, sort_keys=[("lang", "ascending"), ("cells", "ascending")]))
    rows, names = found["cells"].to_pylist(), np.array(found["lang"].to_pylist(), object)
    langs = sorted(set(names))
    y = np.where(names[:, None] == np.array(langs, object)[None], 1.0, -1.0)
    # landmarks spread evenly over the rows, which are in order of language
    at = np.unique(np.linspace(0, len(rows) - 1, min(max(landmarks, len(langs)), len(rows))).astype(int))
    base = _dense([rows[i] for i in at])
    cells = np.flatnonzero(base.any(axis=0))
    marks = (base[:, cells] / np.sqrt(base.sum(axis=1, dtype=np.int64))[:, None]).T.astype(np.float32)  # cells x landmarks
    kernel = np.empty((len(rows), len(at)))
    for s in range(0, len(rows), BATCH):
        part = _dense(rows[s : s + BATCH])
        kernel[s : s + BATCH] = part[:, cells].astype(np.float32) @ marks / np.sqrt(part.sum(axis=1, dtype=np.int64))[:, None]
    value, vector = np.linalg.eigh(kernel[at])
    root = vector / np.sqrt(np.maximum(value, 1e-6))  # the Nyström map: kernel rows times this
    phi = np.hstack([kernel @ root, np.ones((len(rows), 1))])
    weight = 1 / np.bincount(y.argmax(axis=1), minlength=len(langs))[y.argmax(axis=1)]  # languages count alike
    gram = phi.T @ (phi * weight[:, None])
    coef = np.linalg.solve(gram + RIDGE * np.trace(gram) / len(gram) * np.eye(len(gram)), phi.T @ (y * weight[:, None]))
    return {"langs": langs, "cells": cells.astype(np.int32), "marks": marks, "coef": root @ coef[:-1], "bias": coef[-1]}


def scores(texts: list, model: dict) -> tuple[list, list]:
    """Language and score of each text."""
    out_lang, out_score = [], []
    for s in range(0, len(texts), BATCH):
        part = [letters(t) for t in texts[s : s + BATCH]]
        rows = np.zeros((len(part), 1 << BITS), np.uint8)
        for row, c in zip(rows, part):
            if len(c):
                mark(c, row)
        size = np.sqrt(np.maximum(rows.sum(axis=1, dtype=np.int64), 1))
        kernel = rows[:, model["cells"]].astype(np.float32) @ model["marks"] / size[:, None]
        raw = SHARPNESS * (kernel @ model["coef"] + model["bias"])
        soft = np.exp(raw - raw.max(axis=1, keepdims=True))
        soft /= soft.sum(axis=1, keepdims=True)
        best = raw.argmax(axis=1)
        for c, b, p in zip(part, best, soft[np.arange(len(part)), best]):
            out_lang.append(model["langs"][b] if len(c) else UNKNOWN)
            out_score.append(float(p) if len(c) else 0.0)
    return out_lang, out_score


def _score(sent):
    def run(batches):
        model = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, score = scores(texts, model) if model else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """(row: all columns of ``docs``, lang_pred, score)."""
    kept = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return kept.mapInArrow(_score(sent), f"row {kept.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def op10_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")
