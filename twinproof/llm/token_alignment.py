"""Tokens of two tokenizers aligned by bytes, and how often their ids meet in a corpus.

Two tokens are linked where their byte ranges overlap. An id pair counts the documents
that hold it linked; a link is best where its pair's count is the highest of its A id.

* ``runs``: tasks encode texts (each distinct chunk of a task once) and collect
  (pair, document, times) records. Every ``RUN_LINKS`` records, ``RUN_DOCS`` documents or
  ``RUN_TEXT`` characters of groups make a run: sorted side-major (by A id, then B id, then document), cut into ``RADIX``
  pieces by A id, compressed with zstd, and written once to the shared folder.
* ``book``: the pairs of a radix piece are merged over runs, ``FAN`` at a time, in a heap
  that reads each run block by block; documents of equal pairs add up. In the last merge
  all pairs of an A id stand together, so their highest count is known as they pass.
* Contributions stream back: a slice of at most about ``FAN`` runs meets the book of
  its radix piece once, each piece gives one sum per document, and a run's sums are
  added to what is known of its documents.

Nothing is keyed by a token or pair alone, so a frequent one is spread over all runs: a
task holds one radix piece of one slice, or the sums of one run. The records themselves
are never exploded into rows.

Defined results: null and empty texts, bytes that are not UTF-8, and texts whose A or B
bytes differ from space + text have no tokens: zeros and an empty ``groups``. Each input
row is a document of its own, repeated rows and ids too; ties count as best each; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from twinproof.llm.piece_encoding import MARK, Pieces, model_path, read, slices
from twinproof.llm.tables import table
from twinproof.session import settle

RADIX = 64  # pieces of a run
RUN_DOCS, RUN_LINKS = 1 << 12, 1 << 20  # documents and (about) records of a run
RUN_TEXT = 1 << 26  # characters of groups kept in a run's head
FAN = 64  # runs merged at once
BLOCK = 1 << 14  # pairs read from a run at a time
BITS = 28  # of an id in a key
LOW = (1 << 2 * BITS) - 1
ENTRIES, BYTES = 1 << 18, 1 << 24
# Between these, neither tokenizer joins what stands left and right of the cut.
SPACE = "\\s\\x1c-\\x1f\\x85\\u180e\\u200b\\u2060\\ufeff"
CUT = re.compile(f"(?<=[^{SPACE}])(?= )")
OPEN = re.compile(f"[{SPACE}]$|^[^ ]")  # what must not stand beside other chunks
PACK = 1024  # chunks encoded as one text
HEAD = "doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string"


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes: printable ones
    stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


def piece_bytes(piece: str) -> bytes:
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(MARK, " ").encode()


class Aligner:
    """Both tokenizers, and what a task knows of distinct chunks.

    A chunk's code is its place in arrays of its facts: how many A and B tokens
    and groups it has (-1 A tokens: its bytes are not those of the tokens), the text
    of its groups with ``;`` after each, and where its links stand in one flat array.
    """

    def __init__(self, a: str, b: bytes, entries: int = ENTRIES, size: int = BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        letters = byte_letters()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = Pieces(b)
        self.b_bytes = [piece_bytes(self.b.model.id_to_piece(i)) for i in range(self.b.model.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        # how an id is written where a comma, a bar or a semicolon follows it
        self.written = [f"{i}{mark}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in ",|;"]
        spec = json.loads(a)
        split = spec.get("pre_tokenizer") or {}
        # Cutting is right for words that a byte-level pattern splits before a single space, with nothing added or normalised.
        self.separable = self.b.separable and spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.entries, self.size = entries, size
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.held = 0
        self.groups: list[str] = []
        self.n_a = self.n_b = self.n_groups = self.links = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)

    def chunks(self, text: str) -> list[str]:
        return CUT.split(" " + text) if self.separable else [" " + text]

    def a_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A ids of all chunks in a row, and how many each has. Chunks that may stand
        side by side, as in a text, are encoded together and told apart by their bytes."""
        safe = [self.separable and OPEN.search(c) is None for c in chunks]
        together = [c for c, s in zip(chunks, safe) if s]
        packs = ["".join(together[i : i + PACK]) for i in range(0, len(together), PACK)]
        ids = np.concatenate([np.zeros(0, np.int64), *[np.array(e.ids, np.int64) for e in self.a.encode_batch_fast(packs, add_special_tokens=False)]])
        ends = np.cumsum([len(c.encode()) for c in together])
        upto = np.searchsorted(np.cumsum(self.a_size[ids]), ends, "right")
        sizes = np.zeros(len(chunks), np.int64)
        sizes[np.array(safe, bool)] = np.diff(upto, prepend=0)
        if len(together) < len(chunks):
            alone = [e.ids for e in self.a.encode_batch_fast([c for c, s in zip(chunks, safe) if not s], add_special_tokens=False)]
            sizes[~np.array(safe, bool)] = [len(x) for x in alone]
            parts, rest = iter(np.split(ids, upto[:-1]) if len(together) else []), iter(alone)
            ids = np.concatenate([np.zeros(0, np.int64), *[next(parts) if s else np.array(next(rest), np.int64) for s in safe]])
        return ids, sizes

    def learn(self, chunks: list[str]) -> None:
        raw = [c.encode() for c in chunks]
        a, a_sizes = self.a_ids(chunks)
        theirs = self.b.learn(chunks)
        b, b_sizes = np.fromiter(itertools.chain.from_iterable(theirs), np.int64), np.array([len(x) for x in theirs])
        whole = b"".join(raw)
        if b"".join([self.a_bytes[i] for i in a.tolist()]) != whole or b"".join([self.b_bytes[i] for i in b.tolist()]) != whole:
            a_parts, b_parts = (np.split(ids, np.cumsum(sizes)[:-1]) for ids, sizes in ((a, a_sizes), (b, b_sizes)))
            same = [b"".join([self.a_bytes[i] for i in x]) == r == b"".join([self.b_bytes[i] for i in y]) for x, y, r in zip(a_parts, b_parts, raw)]
            self.add([c for c, s in zip(chunks, same) if not s], None)
            kept = np.array(same, bool)
            chunks, raw = [c for c, s in zip(chunks, same) if s], [r for r, s in zip(raw, same) if s]
            a, b = a[np.repeat(kept, a_sizes)], b[np.repeat(kept, b_sizes)]
            a_sizes, b_sizes = a_sizes[kept], b_sizes[kept]
        if chunks:
            self.add(chunks, self.aligned(raw, a, a_sizes, b, b_sizes))

    def aligned(self, raw: list[bytes], a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray):
        """Facts of chunks that stand in a row: between two neighbouring token ends of
        either side lies exactly one link; where both sides end, a group does."""
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        cuts = np.union1d(a_ends, b_ends)
        links = a[np.searchsorted(a_ends, cuts)] << BITS | b[np.searchsorted(b_ends, cuts)]
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        chunk_ends = np.cumsum([len(r) for r in raw])
        n_links, n_groups = (np.diff(np.searchsorted(x, chunk_ends, "right"), prepend=0) for x in (cuts, both))
        # the text: tokens by group, A before B; a bar behind the last A, a semicolon behind the last B of a group
        group = np.concatenate([np.searchsorted(both, a_ends) * 2, np.searchsorted(both, b_ends) * 2 + 1])
        order = np.argsort(group, kind="stable")
        group, ids = group[order], np.concatenate([a, b])[order]
        last = np.append(np.diff(group) > 0, True)
        marks = np.where(last, 1 + group % 2, 0)
        parts = list(map(self.written.__getitem__, (ids * 3 + marks).tolist()))
        ends = np.cumsum(a_sizes + b_sizes).tolist()
        groups = ["".join(parts[i:j]) for i, j in zip([0, *ends], ends)]
        return a_sizes, b_sizes, n_groups, groups, links, n_links

    def add(self, chunks: list[str], facts) -> None:
        """Facts None: chunks without tokens."""
        none = np.zeros(len(chunks), np.int64)
        a_sizes, b_sizes, n_groups, groups, links, n_links = facts or (none - 1, none, none, [""] * len(chunks), none[:0], none)
        self.codes.update(zip(chunks, range(len(self.codes), len(self.codes) + len(chunks))))
        self.held += sum(map(len, chunks))
        self.groups += groups
        self.n_a, self.n_b = np.concatenate([self.n_a, a_sizes]), np.concatenate([self.n_b, b_sizes])
        self.n_groups = np.concatenate([self.n_groups, n_groups])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(n_links)])
        self.links = np.concatenate([self.links, links])

    def texts(self, raw: list[bytes | None]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """(A tokens, B tokens, groups, their text, links) of each text."""
        split = []
        for t in raw:
            try:
                split.append(self.chunks(t.decode()) if t else [])
            except UnicodeDecodeError:
                split.append([])
        new = set().union(*split).difference(self.codes)
        if self.codes and (len(self.codes) + len(new) > self.entries or self.held + sum(map(len, new)) > self.size):
            self.forget()
            new = set().union(*split)
        if new:
            self.learn(list(new))
        for own in split:
            places = list(map(self.codes.__getitem__, own))
            codes = np.array(places, np.int64)
            n_a = self.n_a[codes]
            if not len(codes) or n_a.min() < 0:
                yield 0, 0, 0, "", np.zeros(0, np.int64)
                continue
            start, size = self.first[codes], self.first[codes + 1] - self.first[codes]
            ends = np.cumsum(size)
            links = self.links[np.repeat(start - ends + size, size) + np.arange(ends[-1])]
            text = "".join(map(self.groups.__getitem__, places))[:-1]
            yield int(n_a.sum()), int(self.n_b[codes].sum()), int(self.n_groups[codes].sum()), text, links


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


class Writer:
    """Records of the documents of one run."""

    def __init__(self, radix: int):
        self.radix, self.runs = radix, 0
        self.clear()

    def clear(self):
        self.heads, self.keys, self.times, self.n, self.text = [], [], [], 0, 0

    def add(self, head: tuple, links: np.ndarray) -> None:
        keys, times = np.unique(links, return_counts=True)
        self.heads.append(head)
        self.keys.append(keys)
        self.times.append(times)
        self.n += len(keys)
        self.text += len(head[-1])

    def rows(self) -> list[dict]:
        """The head of the run, and its pieces in side-major order."""
        task = TaskContext.get()
        run = ((task.partitionId() if task else 0) << 32) + self.runs
        self.runs += 1
        names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")
        out = [{"run": run, "radix": -1, "heads": [dict(zip(names, h)) for h in self.heads]}]
        keys, times = np.concatenate([np.zeros(0, np.int64), *self.keys]), np.concatenate([np.zeros(0, np.int64), *self.times])
        docs = np.repeat(np.arange(len(self.keys)), [len(k) for k in self.keys])
        full = (keys >> BITS) % self.radix << 2 * BITS | keys
        order = np.argsort(full, kind="stable")  # documents stay in order within a pair
        full, docs, times = full[order], docs[order].astype(np.uint16), times[order].astype(np.int32)
        first = np.flatnonzero(np.diff(full, prepend=-1))
        bounds = np.searchsorted(full, np.arange(self.radix + 1) << 2 * BITS)
        at = np.searchsorted(first, bounds)
        sizes = np.diff(first, append=len(full)).astype(np.int32)
        for r in range(self.radix):
            own = slice(bounds[r], bounds[r + 1])
            if bounds[r] < bounds[r + 1]:
                pairs = full[first[at[r] : at[r + 1]]] & LOW
                out.append(
                    {"run": run, "radix": r, "pairs": _pack(np.diff(pairs, prepend=0)), "docs": _pack(sizes[at[r] : at[r + 1]]),
                     "members": _pack(np.diff(docs[own], prepend=docs[:0].dtype.type(0))), "times": _pack(times[own])}
                )
        self.clear()
        return out


def _schema(kind: str) -> str:
    return f"run bigint, radix int, pairs binary, docs binary, members binary, times binary, heads array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in HEAD.format(kind=kind).split(', '))}>>"


def _arrow_schema(doc_id: pa.DataType) -> pa.Schema:
    head = pa.struct([("doc_id", doc_id), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups", pa.string())])
    return pa.schema([("run", pa.int64()), ("radix", pa.int32()), *[(c, pa.binary()) for c in ("pairs", "docs", "members", "times")], ("heads", pa.list_(head))])


def _runs(sent, radix, run_docs, run_links, digest, doc_id):
    def run(batches):
        schema = _arrow_schema(doc_id)
        aligner, writer = Aligner(*sent.value), Writer(radix)

        def rows():
            made = writer.rows()
            for i in range(0, len(made), 8):
                yield pa.RecordBatch.from_pylist(made[i : i + 8], schema)

        for batch in batches:
            ids, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, stop in slices(raw):
                for doc, (n_a, n_b, n_groups, groups, links) in zip(ids[start:stop], aligner.texts(raw[start:stop])):
                    if digest and groups:
                        groups = hashlib.sha256(groups.encode()).hexdigest()
                    writer.add((doc, n_a, n_b, n_groups, len(links), groups), links)
                    if len(writer.heads) >= run_docs or writer.n >= run_links or writer.text >= RUN_TEXT:
                        yield from rows()
        if writer.heads:
            yield from rows()

    return run


def runs(docs: DataFrame, a: str | None = None, b: str | None = None, radix: int = RADIX, run_docs: int = RUN_DOCS, run_links: int = RUN_LINKS, digest: bool = False) -> DataFrame:
    """The written runs of ``docs``: a head row (radix -1) and up to ``radix`` pieces each."""
    from pyspark.sql.pandas.types import to_arrow_type

    if run_docs > 1 << 16:
        raise ValueError("a run numbers its documents in 16 bits")
    field = docs.schema["doc_id"].dataType
    sent = docs.sparkSession.sparkContext.broadcast((read(a or byte_bpe_path()).decode(), read(b or model_path())))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return settle(rows.mapInArrow(_runs(sent, radix, run_docs, run_links, digest, to_arrow_type(field)), _schema(field.simpleString())), "align-runs")


class Reader:
    """One sorted run of pairs, a block at a time."""

    def __init__(self, pairs: bytes, docs: bytes, kind):
        open_ = lambda data: zstandard.ZstdDecompressor().stream_reader(data)
        self.sources, self.kind, self.last = (open_(pairs), open_(docs)), kind, 0
        self.advance()

    def advance(self) -> bool:
        pairs, docs = (s.read(BLOCK * n) for s, n in zip(self.sources, (8, np.dtype(self.kind).itemsize)))
        self.pairs = np.cumsum(np.frombuffer(pairs, np.int64)) + self.last
        self.docs = np.frombuffer(docs, self.kind).astype(np.int64)
        if len(self.pairs):
            self.last = int(self.pairs[-1])
        return len(self.pairs) > 0

    def until(self, bound: int) -> tuple[np.ndarray, np.ndarray]:
        cut = np.searchsorted(self.pairs, bound, "right")
        out = self.pairs[:cut], self.docs[:cut]
        self.pairs, self.docs = self.pairs[cut:], self.docs[cut:]
        return out


def merge(sources: list[Reader]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (pairs, documents), pairs ascending and each once, of all sources. The
    heap holds the end of each source's block: up to the least end, nothing new can come."""
    heap = [(s.last, i) for i, s in enumerate(sources) if len(s.pairs)]
    heapq.heapify(heap)
    while heap:
        bound = heap[0][0]
        parts = [sources[i].until(bound) for _, i in heap]
        pairs, docs = (np.concatenate(p) for p in zip(*parts))
        order = np.argsort(pairs, kind="stable")
        pairs, docs = pairs[order], docs[order]
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        yield pairs[first], np.add.reduceat(docs, first)
        while heap and heap[0][0] == bound:
            i = heap[0][1]
            if sources[i].advance():
                heapq.heapreplace(heap, (sources[i].last, i))
            else:
                heapq.heappop(heap)


def maxima(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks with a third column: is the pair's count the highest of its A id? The last A
    id of a block waits for the next block."""
    held = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def marked(pairs, docs):
        side = pairs >> BITS
        first = np.flatnonzero(np.diff(side, prepend=-1))
        most = np.maximum.reduceat(docs, first)
        return pairs, docs, docs == np.repeat(most, np.diff(first, append=len(side)))

    for block in blocks:
        pairs, docs = (np.concatenate(p) for p in zip(held, block))
        cut = np.searchsorted(pairs, pairs[-1] >> BITS << BITS)
        held = pairs[cut:], docs[cut:]
        if cut:
            yield marked(pairs[:cut], docs[:cut])
    if len(held[0]):
        yield marked(*held)


def _rows(batches) -> Iterator[dict]:
    """Rows one by one: compressed columns of a batch never stand in Python all at once."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _by_key(batches, *names):
    """(key, rows) of neighbouring rows with one key; a row is a dictionary."""
    key, rows = None, []
    for row in _rows(batches):
        now = tuple(row[n] for n in names)
        if rows and now != key:
            yield key, rows
            rows = []
        key = now
        rows.append(row)
    if rows:
        yield key, rows


def _merge(last: bool):
    def run(batches):
        for (radix, part), rows in _by_key(batches, "radix", "part"):
            blocks = merge([Reader(r["pairs"], r["docs"], np.int64 if r["wide"] else np.int32) for r in rows])
            done = maxima(blocks) if last else ((p, d, np.zeros(0, bool)) for p, d in blocks)
            pairs, docs, best = (np.concatenate(x) for x in zip(*done))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([radix], pa.int32()), pa.array([_pack(np.diff(pairs, prepend=0))], pa.binary()), pa.array([_pack(docs)], pa.binary()), pa.array([_pack(best)], pa.binary())],
                names=["run", "radix", "pairs", "docs", "best"],
            )

    return run


MERGED = "run bigint, radix int, pairs binary, docs binary, best binary"


def book(pieces: DataFrame, n_runs: int, fan: int = FAN) -> DataFrame:
    """One row per radix piece: its pairs, their documents in the corpus, and whether they are best."""
    now = pieces.where("radix >= 0").select("run", "radix", "pairs", "docs", F.lit(False).alias("wide"))
    while True:
        n_runs = -(-n_runs // fan)
        part = F.pmod(F.xxhash64("run"), F.lit(max(1, n_runs)))
        dealt = now.withColumn("part", part).repartition("radix", "part").sortWithinPartitions("radix", "part", "run")
        now = settle(dealt.mapInArrow(_merge(n_runs <= 1), MERGED), "align-book")
        if n_runs <= 1:
            return now
        now = now.select("run", "radix", "pairs", "docs", F.lit(True).alias("wide"))


def pair_counts(book: DataFrame) -> DataFrame:
    """(a, b, documents, best) of every linked pair of ids."""

    def run(batches):
        for row in _rows(batches):
            pairs = np.cumsum(_unpack(row["pairs"], np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array((pairs >> BITS).astype(np.int32)), pa.array((pairs & (1 << BITS) - 1).astype(np.int32)), pa.array(_unpack(row["docs"], np.int64)), pa.array(_unpack(row["best"], bool))],
                names=["a", "b", "documents", "best"],
            )

    return book.mapInArrow(run, "a int, b int, documents bigint, best boolean")


def _back(batches):
    """Sums of each piece per document; the book of a slice comes before its pieces."""
    known = None
    for row in _rows(batches):
        if row["run"] < 0:
            known = np.cumsum(_unpack(row["pairs"], np.int64)), _unpack(row["docs"], np.int64), _unpack(row["best"], bool)
            continue
        pairs, sizes = np.cumsum(_unpack(row["pairs"], np.int64)), _unpack(row["docs"], np.int32)
        at = np.searchsorted(known[0], pairs)
        times = _unpack(row["times"], np.int32).astype(np.int64)
        docs = np.cumsum(_unpack(row["members"], np.uint16), dtype=np.uint16).astype(np.int64)
        own, place = np.unique(docs, return_inverse=True)
        counts, best = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        np.add.at(counts, place, times * np.repeat(known[1][at], sizes))
        np.add.at(best, place, times * np.repeat(known[2][at], sizes))
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["run"]], pa.int64()), pa.array([row["radix"]], pa.int32()), *[pa.array([_pack(x)], pa.binary()) for x in (own.astype(np.uint16), best, counts)]],
            names=["run", "radix", "own", "best", "counts"],
        )


def _finish(doc_id):
    def run(batches):
        head, best, counts = None, None, None

        def rows():
            heads = pa.array(head, pa.list_(_arrow_schema(doc_id).field("heads").type.value_type).value_type)
            fields = [heads.field(i) for i in range(heads.type.num_fields)]
            return pa.RecordBatch.from_arrays(
                [*fields[:5], pa.array(best), pa.array(counts), fields[5]], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
            )

        for row in _rows(batches):
            if row["radix"] < 0:
                if head:
                    yield rows()
                head = row["heads"]
                best, counts = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
            else:
                own = _unpack(row["own"], np.uint16)
                best[own] += _unpack(row["best"], np.int64)
                counts[own] += _unpack(row["counts"], np.int64)
        if head:
            yield rows()

    return run


def align(docs: DataFrame, a: str | None = None, b: str | None = None, digest: bool = False, fan: int = FAN, **sizes: int) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row of ``docs``.

    ``groups`` is the text ``a1,a2|b1;a3|b2,b3``, with ``digest`` its sha256. ``a`` and
    ``b`` are paths on the driver of a byte-level tokenizer and a SentencePiece model."""
    from pyspark.sql.pandas.types import to_arrow_type

    written = runs(docs, a, b, digest=digest, **sizes)
    n_runs = written.where("radix < 0").count()
    counted = book(written, n_runs, fan)
    n_slices = max(1, -(-n_runs // fan))
    nothing = F.lit(None).cast("binary")
    books = counted.select(F.lit(-1).cast("long").alias("run"), "radix", "pairs", "docs", nothing.alias("members"), nothing.alias("times"), "best")
    books = books.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_slices - 1).cast("long"))))
    pieces = written.where("radix >= 0").select("run", "radix", "pairs", "docs", "members", "times", nothing.alias("best")).withColumn("part", F.pmod(F.xxhash64("run"), F.lit(n_slices)))
    met = books.unionByName(pieces).repartition("radix", "part").sortWithinPartitions("radix", "part", "run")
    sums = met.mapInArrow(_back, "run bigint, radix int, own binary, best binary, counts binary")
    heads = written.where("radix < 0").select("run", "radix", *[nothing.alias(c) for c in ("own", "best", "counts")], "heads")
    none = F.lit(None).cast(heads.schema["heads"].dataType)
    together = heads.unionByName(sums.withColumn("heads", none)).repartition("run").sortWithinPartitions("run", "radix")
    field = docs.schema["doc_id"].dataType
    shape = HEAD.format(kind=field.simpleString()).replace(", groups", ", n_best bigint, count_sum bigint, groups")
    return together.mapInArrow(_finish(to_arrow_type(field)), shape)


def op11_alignment(spark, sf_dir):
    return align(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")
