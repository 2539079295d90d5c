"""Best-fit packing of documents into sequences of a fixed number of tokens.

Tokens: ids of a public byte-level BPE vocabulary, then id 0, document by document. Only documents over the
capacity are cut; their first piece takes what does not fill a whole sequence, so that all later pieces do.

Packing is bulk-synchronous best fit, longest first. A superstep takes all pieces of one length:
  1. documents are range-sorted by length and get a rank within it, without bringing a length together;
  2. gaps are kept sorted by size. A sweep finds the successor of the length, the smallest gap that holds it;
     gaps of one size are contiguous runs of sequence numbers, so the sweep matches a run of ranks to a run of
     gaps at once, and moves on to the next larger gap when a run ends;
  3. conflicts (several pieces that want the same gap) are resolved by rank: the j-th piece gets the j-th gap;
  4. matched gaps shrink by the length and go back to the sorted gaps; pieces without a gap open sequences;
  5. the next superstep has the next smaller length.
As both lengths and gaps are whole numbers up to the capacity, the state between supersteps is runs, of which
there are a few thousand whatever the number of documents. The sweeps themselves run over that bounded state, on
the driver; matching single pieces to single gaps, which grows with the data, is a search for a piece's rank among
the runs, in the tasks that hold the ranked pieces: no piece is moved for it, and however many pieces have one
length, each costs the same.

Texts are encoded once: the pieces, a few numbers each, are written down before they are sorted.

Defined cases: a null or empty text is the one token 0; repeated rows are packed as often as they occur; an
empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import materialise, ranked

CAPACITY = 2048

#: Distinct words whose ids one Python worker keeps; when they are so many, it begins anew.
CACHE_WORDS = 150_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder(dict):
    """Word -> its ids as little-endian unsigned 32-bit numbers. Words are encoded once and kept, up to a bound.

    The vocabulary's splitting pattern never lets a piece cross from a non-space into a space, so a text can be
    cut before any space or line end that follows a non-space, and the parts encoded alone.
    """

    _cut = re.compile(r"(?<=\S)(?=[ \n])")
    _blank_run = re.compile(r"\s[ \n]")

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self._encode.encode_ordinary(word))
        if sys.byteorder == "big":
            ids.byteswap()
        ids = ids.tobytes()
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if "\x00" in text or self._blank_run.search(text):
            parts = self._cut.split(text)
        else:
            parts = text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")
        return b"".join(map(self.__getitem__, parts))


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One for each worker process and vocabulary."""
    path = path or default_vocabulary()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    if tokens <= capacity:
        return [(0, tokens)]
    first = tokens % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, tokens, capacity)]


def _pieces(vocabulary: str | None, capacity: int, with_ids: bool):
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).ids
        for batch in rows:
            out: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + b"\0\0\0\0"
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc, piece, start, length, zlib.crc32(part), part), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row a piece; with_ids adds the token ids (little-endian unsigned 32-bit)."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_pieces(vocabulary, capacity, with_ids), PIECES + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """The supersteps: runs (length, first rank, pieces, first sequence, offset) for so many pieces of each length."""
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, sequences)
    sizes: list[int] = []  # gaps there are, sorted
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap == 0:
            return
        if gap not in gaps:
            insort(sizes, gap)
            gaps[gap] = []
        gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)  # the successor of the length among the gaps
            if at == len(sizes):
                per = capacity // length  # new sequences take as many of this length as they hold
                fresh = max(1, left // per)
                for k in range(min(per, left)):
                    runs.append((length, rank, fresh, opened, k * length))
                    rank, left = rank + fresh, left - fresh
                    if left < fresh:
                        break
                put(capacity - (k + 1) * length, opened, fresh)
                opened += fresh
                continue
            gap = sizes[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            take = min(n, left)
            runs.append((length, rank, take, first, capacity - gap))
            rank, left = rank + take, left - take
            put(gap - length, first, take)
            if take < n:
                put(gap, first + take, n - take)
    return runs


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _placed(runs):
    """runs: (first rank, sequence less rank, offset), sorted; they cover all ranks."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, shift, offset = (np.array(c, np.int64) for c in zip(*runs.value, strict=True))
        names = [c.split()[0] for c in PLACED.split(", ")]
        for batch in rows:
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(first, rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), batch.column("length").cast(pa.int64()), batch.column("ids_crc32"), pa.array(rank + shift[at]), pa.array(offset[at])], names=names)

    return run


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) a piece."""
    spark = df.sparkSession
    order = [F.col("length").desc(), F.col("ids_crc32"), F.col("doc_id"), F.col("piece"), F.col("start")]
    encoded = materialise(pieces(df, key, text, capacity, vocabulary), "pack-pieces")
    counts = dict(encoded.groupBy("length").count().collect())  # a row for each length up to the capacity
    if not counts:
        return spark.createDataFrame([], PLACED)
    before, starts = 0, {}
    for length in sorted(counts, reverse=True):
        starts[length] = before
        before += counts[length]
    runs = sorted((starts[length] + first, seq - (starts[length] + first), offset) for length, first, _, seq, offset in plan(counts, capacity))
    held = spark.sparkContext.broadcast(runs)  # a few for each length, so bounded by the capacity
    return ranked(encoded, order, "_rank", "pack").mapInArrow(_placed(held), PLACED)


SEQUENCE = "sequence_id long, tokens int, ids binary, doc_ids array<long>, offsets array<long>"


def assemble(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The sequences themselves: token ids, with the documents and offsets of their parts. Needs identifiers that are unique."""
    placed = materialise(pack(df, key, text, capacity, vocabulary), "packed")
    parts = placed.join(pieces(df, key, text, capacity, vocabulary, True).select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    # a sequence has at most `capacity` parts
    rows = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"), F.sum("length").cast("int").alias("tokens"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", "tokens", ids.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))
