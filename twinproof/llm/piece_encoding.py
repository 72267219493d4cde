"""SentencePiece ids of whole texts by a table of distinct chunks, and their decoding.

A chunk is a run of white-space markers (a space, or U+2581 itself) with the
characters up to the next marker. Where no piece of the vocabulary continues past
a marker, merges never cross the cut before a marker, so the ids of a text are the
ids of its chunks one after the other. Each task keeps a table of the distinct
chunks it has met, bounded in entries and bytes: new ones are segmented once, all
of a batch in one call, and the ids are joined back by the chunks' positions. The
table stays in the task on purpose: a table of the whole corpus would ship every
chunk of every text over the network to save milliseconds of segmentation a task.
No shuffle, nothing settled: a lost executor repeats its own tasks only.

A vocabulary with pieces across markers, or a normaliser that does more than put
markers in place of spaces, has one chunk a text: the library encodes it whole.

Defined results: null and empty texts have no ids and decode to the empty text;
bytes that are not UTF-8 go to the library as they are; each input row gives one
row, repeated rows too; all columns but doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.tables import table

MARK = "▁"
ENTRIES, BYTES = 1 << 18, 1 << 25  # most chunks, and characters of chunks, a task remembers
SLICE = 1 << 20  # bytes of text handled at once, or a single longer text
CUT = re.compile(f"(?<=[^ {MARK}])(?=[ {MARK}])")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class ChunkTable:
    """What is known about each distinct chunk: ``learn`` gives one value for each
    new one, ``values(chunks)`` the values by position. Starts anew when full."""

    def __init__(self, learn: Callable[[list[str]], list], entries: int = ENTRIES, size: int = BYTES):
        self.learn, self.entries, self.size = learn, entries, size
        self.known: dict[str, object] = {}
        self.held = 0

    def values(self, texts: list[list[str]]) -> list[list]:
        new = set().union(*texts).difference(self.known)
        if self.known and (len(self.known) + len(new) > self.entries or self.held + sum(map(len, new)) > self.size):
            self.known, self.held = {}, 0
            new = set().union(*texts)
        if new:
            chunks = list(new)
            self.known.update(zip(chunks, self.learn(chunks)))
            self.held += sum(map(len, chunks))
        return [[self.known[c] for c in own] for own in texts]


class Pieces:
    """A SentencePiece model that encodes marked chunks."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = " a  b\tﬁ "
        self.separable = self.model.normalize(probe) == MARK + probe.replace(" ", MARK) and MARK in names and not any(CUT.search(n) for n in names)
        self.mark = self.model.piece_to_id(MARK)

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text, each with its first marker; the first one's is added, as the model does."""
        if not text:
            return []
        return CUT.split(" " + text) if self.separable else [" " + text]

    def learn(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk; the library puts the first marker back, but not before nothing."""
        return [ids or [self.mark] for ids in self.model.encode([c[1:] for c in chunks], num_threads=1)]


def slices(texts: list, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        own = len(t or b"")
        if i > start and size + own > most:
            yield start, i
            start, size = i, 0
        size += own
    if texts:
        yield start, len(texts)


def _encode(sent, entries, size):
    def run(batches):
        pieces = Pieces(sent.value)
        known = ChunkTable(pieces.learn, entries, size)
        for batch in batches:
            raw = batch.column(1).to_pylist()
            for start, stop in slices(raw):
                texts, odd = [], {}
                for i, t in enumerate(raw[start:stop]):
                    try:
                        texts.append((t or b"").decode())
                    except UnicodeDecodeError:
                        odd[i] = pieces.model.encode(t)
                        texts.append("")
                ids = [list(chain.from_iterable(own)) for own in known.values([pieces.chunks(t) for t in texts])]
                for i, own in odd.items():
                    ids[i] = own
                decoded = [pieces.model.decode(own) if own else "" for own in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    return run


def encode(docs: DataFrame, model: str | None = None, entries: int = ENTRIES, size: int = BYTES) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row of ``docs`` (doc_id, text).

    ``model`` is the path of a SentencePiece model on the driver, which sends it to the tasks."""
    sent = docs.sparkSession.sparkContext.broadcast(read(model or model_path()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_encode(sent, entries, size), f"doc_id {kind}, ids array<int>, decoded string")


def op13_pieces(spark, sf_dir):
    found = encode(table(spark, sf_dir, "documents"))
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
