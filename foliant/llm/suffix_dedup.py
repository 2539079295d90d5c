"""Removal of repeated substrings with a distributed suffix sort.

Every byte is removed that a string of `span` bytes covers which also starts anywhere else, the same document
included. All strings are judged on the input.

Suffixes. A suffix array over all positions is not needed for strings of a fixed least length. Positions are
sampled by content: of every window of span - core + 1 consecutive positions, those whose core (the next `core`
bytes) has the smallest hash. Two equal strings of `span` bytes sample the same places, so every repeated string
is seen at a sampled suffix that both occurrences share. A suffix is carried as far as a repeated string can
reach from a sampled place: `span` bytes to the right, span - core to the left.

1. Sampled cores are counted over all documents by fingerprint; places whose core occurs once are dropped.
2. Tasks sort the suffixes of what they read, (right context, then reversed left context), into runs, one a
   target partition, and write them front-coded: the length of the prefix shared with the entry before, and
   the rest. Equal suffixes of a task are one entry with several places.
3. Runs are exchanged by fingerprint, and each task merges its runs with a loser tree. A tree node keeps the
   length of the prefix that the loser shares with the winner that beat it; entries with different lengths are
   decided by them alone, and bytes are compared only beyond what is known to be equal. The merge yields each
   entry's common prefix with the one before for free.
4. In the merged order, suffixes that share r bytes to the right are a stretch between shorter common
   prefixes. Stretches are joined from the longest common prefix down; on joining, the smaller side's left
   contexts are looked up among the larger side's sorted ones, and two suffixes that share l bytes to the left
   and r to the right with l + r >= span repeat a string: l bytes before and r after are covered. Only
   neighbours in left order are looked at, so no stretch is compared pair by pair.
5. Covered stretches go back to their documents, which are cut.

A fingerprint's suffixes meet in one task. Copies cannot fill it, since equal suffixes are one entry a run; many
different contexts around one very common passage can, which the README states.

Bytes of hash values only select; all matches are decided by comparing bytes.

Defined cases: a null text is empty; texts shorter than `span` hold nothing; repeated rows and copies are
removed whole, as each starts elsewhere too; rows that repeat an identifier are told apart by a row number.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import _BASE_INV, materialise, mix, numbered, powers, prefix_sums, sized_join, text_bytes

SPAN, CORE = 400, 200

#: Bytes of text whose samples, and whose suffixes, one exchange partition gets on average, at most: a task holds a partition.
PART_BYTES = 256 << 20

#: Ends a context; no UTF-8 text holds this byte.
STOP = b"\xff"


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every `width` consecutive values: two running passes over blocks."""
    n = len(x) - width + 1
    fill = -len(x) % width
    blocks = np.concatenate([x, np.full(fill, x[-1], x.dtype)]).reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[width - 1 : width - 1 + n])


def samples(text: bytes, span: int = SPAN, core: int = CORE) -> tuple[np.ndarray, np.ndarray]:
    """Sampled places of a text and the fingerprints of their cores."""
    if len(text) < span:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    data = np.frombuffer(text, np.uint8)
    sums = prefix_sums(data)
    n = len(data) - core + 1
    hashes = mix((sums[core:] - sums[:-core]) * powers(_BASE_INV, n))
    width = span - core + 1
    least = _slide(hashes, width, np.minimum)
    # a place is sampled if it is the least of some window that holds it
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero(_slide(padded, width, np.maximum) == hashes)
    return at, hashes[at]


PLACES = "part int, data binary"


def _sampled(parts: int, span: int, core: int):
    """(part, blob of fingerprint, place) a document and part."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            prints, docs, places = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                at, h = samples(text, span, core)
                prints.append(h)
                places.append(at)
                docs.append(np.full(len(at), doc, np.int64))
            if not prints:
                continue
            prints, docs, places = map(np.concatenate, (prints, docs, places))
            part = (prints % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((prints, part))
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            out = [(p, order[edges[p] : edges[p + 1]]) for p in range(parts) if edges[p] < edges[p + 1]]
            blobs = [len(o).to_bytes(8, "little") + prints[o].tobytes() + zlib.compress(docs[o].tobytes() + places[o].tobytes(), 1) for _, o in out]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "data"])

    return run


def _by_part(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Blobs of each part of rows that come sorted by part."""
    part, blobs = None, []
    for batch in rows:
        for p, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if p != part and blobs:
                yield part, blobs
                blobs = []
            part = p
            blobs.append(data)
    if blobs:
        yield part, blobs


CANDIDATES = "doc long, places binary"


def _repeated(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places whose fingerprint occurs more than once, a blob a document."""
    for _, blobs in _by_part(rows):
        prints, docs, places = [], [], []
        for data in blobs:
            n = int.from_bytes(data[:8], "little")
            prints.append(np.frombuffer(data, np.uint64, n, 8))
            d, at = np.frombuffer(zlib.decompress(data[8 + 8 * n :]), np.int64).reshape(2, n)
            docs.append(d)
            places.append(at)
        prints, docs, places = map(np.concatenate, (prints, docs, places))
        order = np.argsort(prints, kind="stable")
        sorted_ = prints[order]
        same = sorted_[1:] == sorted_[:-1]
        often = np.zeros(len(order), bool)
        often[1:] |= same
        often[:-1] |= same
        keep = order[often]
        keep = keep[np.lexsort((places[keep], docs[keep]))]
        if not len(keep):
            continue
        d = docs[keep]
        starts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        for low in range(0, len(starts), 5000):
            s = starts[low : low + 5000]
            e = np.append(starts, len(d))[low + 1 : low + 1 + len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(d[s]), pa.array([places[keep[a:b]].astype("<i4").tobytes() for a, b in zip(s, e, strict=True)], pa.binary())], names=["doc", "places"])


# --- sorted runs ---------------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first `known` bytes are equal and are not looked at again."""
    n = min(len(a), len(b))
    low, step = known, 16
    while low < n:  # gallop, then halve
        high = min(n, low + step)
        if a[low:high] == b[low:high]:
            low, step = high, step * 2
            continue
        while high - low > 1:
            mid = (low + high) // 2
            if a[low:mid] == b[low:mid]:
                low = mid
            else:
                high = mid
        return low
    return n


def front_code(entries: list[tuple[bytes, bytes]]) -> bytes:
    """A sorted run of (key, payload) as shared prefix lengths and rests."""
    lengths, rests, before = [], [], b""
    for key, payload in entries:
        same = common_prefix(before, key)
        lengths += (same, len(key) - same, len(payload))
        rests += (key[same:], payload)
        before = key
    return len(entries).to_bytes(4, "little") + np.array(lengths, "<u4").tobytes() + b"".join(rests)


def read_run(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(prefix shared with the entry before, key, payload) of a front-coded run."""
    n = int.from_bytes(data[:4], "little")
    at, key = 4 + 12 * n, b""
    for same, rest, size in np.frombuffer(data, "<u4", 3 * n, 4).reshape(n, 3).tolist():
        key = key[:same] + data[at : at + rest]
        at += rest
        yield same, key, data[at : at + size]
        at += size


def merge(runs: list[Iterator[tuple[int, bytes, bytes]]]) -> Iterator[tuple[int, bytes, bytes]]:
    """Merge sorted runs with a loser tree over common prefixes. Yields (prefix shared with the entry before, key, payload)."""
    k = 1
    while k < len(runs):
        k *= 2
    # an entry: [shared prefix with the last winner it was compared to, key or None at the end, payload]
    heads: list = [list(next(r, (0, None, b""))) for r in runs] + [[0, None, b""] for _ in range(k - len(runs))]
    for h in heads:
        h[0] = 0  # nothing is known against the empty first winner
    tree = [0] * k  # losers; tree[0] is the winner

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); both prefixes are known against the same earlier key, which is not larger than either."""
        x, y = heads[a], heads[b]
        if y[1] is None:
            return a, b
        if x[1] is None:
            return b, a
        if x[0] != y[0]:  # the one that shares more with the earlier key is smaller; the loser's length stays true
            return (a, b) if x[0] > y[0] else (b, a)
        same = common_prefix(x[1], y[1], x[0])
        if x[1][same:] <= y[1][same:]:
            y[0] = same
            return a, b
        x[0] = same
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, loser = play(build(2 * node), build(2 * node + 1))
        tree[node] = loser
        return winner

    tree[0] = build(1) if k > 1 else 0
    while True:
        w = tree[0]
        shared, key, payload = heads[w]
        if key is None:
            return
        yield shared, key, payload
        # the next entry of the run knows its prefix with this winner from the front coding
        heads[w] = list(next(runs[w], (0, None, b""))) if w < len(runs) else [0, None, b""]
        node = (w + k) // 2
        while node:
            winner, tree[node] = play(w, tree[node])
            w, node = winner, node // 2
        tree[0] = w


RUNS = "part int, data binary"


def _runs(parts: int, span: int, core: int):
    """Front-coded sorted runs of the suffixes at a document's candidate places, a run a part and batch."""
    reach = span - core

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[dict[bytes, list]] = [{} for _ in range(parts)]
        size = 0
        for batch in rows:
            for doc, text, places in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                at = np.frombuffer(places, "<i4").astype(np.int64)
                sums = prefix_sums(np.frombuffer(text, np.uint8))
                prints = mix((sums[at + core] - sums[at]) * powers(_BASE_INV, len(sums))[at])
                for p, part in zip(at.tolist(), (prints % np.uint64(parts)).tolist(), strict=True):
                    key = text[p : p + span] + STOP + text[max(0, p - reach) : p][::-1] + STOP
                    held = entries[part].get(key)
                    if held is None:
                        entries[part][key] = [(doc, p)]
                        size += len(key) + 200
                    else:
                        held.append((doc, p))
                        size += 100
            if size > RUN_BYTES:
                yield _emit(entries)
                entries, size = [{} for _ in range(parts)], 0
        if size:
            yield _emit(entries)

    return run


#: A task's suffixes are written as runs when they hold so many bytes.
RUN_BYTES = 96 << 20


def _emit(entries: list[dict[bytes, list]]) -> pa.RecordBatch:
    out = [(p, zlib.compress(front_code([(k, np.array(held[k], "<i8").tobytes()) for k in sorted(held)]), 1)) for p, held in enumerate(entries) if held]
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary())], names=["part", "data"])


def cover(lefts: list[bytes], shared: list[int], counts: list[int], rights: list[int], span: int) -> list[tuple[int, int]]:
    """For suffixes in sorted order: bytes before and after the place that repeated strings cover, (0, 0) if none.
    lefts: reversed left contexts; shared[i]: right bytes that i shares with i - 1; rights: right lengths."""
    n = len(lefts)
    best = [(0, 0)] * n

    def note(i: int, l: int, r: int) -> None:
        if l + r >= span:
            a, b = best[i]
            best[i] = (max(a, l), max(b, r))

    for i in range(n):
        if counts[i] > 1:  # equal contexts
            note(i, len(lefts[i]), rights[i])
    owner = list(range(n))
    groups: dict[int, list[tuple[bytes, int]]] = {i: [(lefts[i], i)] for i in range(n)}

    def find(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    for r, i in sorted(((shared[i], i) for i in range(1, n)), key=lambda x: -x[0]):
        a, b = find(i - 1), find(i)
        if len(groups[a]) < len(groups[b]):
            a, b = b, a
        large, small = groups[a], groups.pop(b)
        at = [(bisect_left(large, x), x) for x in small]
        for where, (left, j) in at:
            for near in (where - 1, where):
                if 0 <= near < len(large):
                    other, k = large[near]
                    l = common_prefix(left, other)
                    note(j, l, r)
                    note(k, l, r)
        if len(small) * 8 > len(large):
            large += small
            large.sort()
        else:
            for x in small:
                insort(large, x)
        owner[b] = a
    return best


COVERED = "doc long, spans binary"


def _covered(span: int, core: int):
    def group(entries: list[tuple[int, bytes, bytes]]) -> Iterator[tuple[int, int, int]]:
        places = [np.frombuffer(p, "<i8").reshape(-1, 2) for *_, p in entries]
        if len(entries) == 1 and len(places[0]) == 1:
            return
        ends = [key.index(STOP) for _, key, _ in entries]
        lefts = [key[e + 1 : -1] for (_, key, _), e in zip(entries, ends, strict=True)]
        shared = [0] + [min(s, a, b) for (s, _, _), a, b in zip(entries[1:], ends[:-1], ends[1:], strict=True)]
        for (left, right), held in zip(cover(lefts, shared, [len(p) for p in places], ends, span), places, strict=True):
            if right:
                for doc, p in held.tolist():
                    yield doc, p - left, p + right

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_part(rows):
            found: dict[int, list] = {}
            held: list[tuple[int, bytes, bytes]] = []

            def close() -> None:
                for doc, a, b in group(held):  # noqa: B023
                    found.setdefault(doc, []).append((a, b))  # noqa: B023

            for shared, key, payload in merge([read_run(zlib.decompress(b)) for b in blobs]):
                if held and shared < core:
                    close()
                    held = []
                if held and held[-1][1] == key:  # the same suffix from another run
                    held[-1] = (held[-1][0], key, held[-1][2] + payload)
                else:
                    held.append((shared, key, payload))
            if held:
                close()
            docs = list(found)
            for low in range(0, len(docs), 5000):
                some = docs[low : low + 5000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([np.array(union(found[d]), "<i4").tobytes() for d in some], pa.binary())], names=["doc", "spans"])

    return run


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching stretches joined, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def spans_of(blobs: list[bytes] | None) -> list[tuple[int, int]]:
    return union([tuple(x) for b in blobs or [] for x in np.frombuffer(b, "<i4").reshape(-1, 2).tolist()])


def removed_spans(df: DataFrame, span: int = SPAN, core: int = CORE) -> DataFrame:
    """df: (doc long, text). Returns (doc, spans): the covered stretches of every document that has one, as blobs of
    32-bit (start, end) in bytes."""
    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // PART_BYTES))
    meet = lambda rows: rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    sampled = df.mapInArrow(_sampled(parts, span, core), PLACES)
    places = meet(sampled).mapInArrow(_repeated, CANDIDATES).groupBy("doc").agg(F.collect_list("places").alias("blobs"))
    places = materialise(places.select("doc", F.aggregate("blobs", F.lit(b""), lambda a, x: F.concat(a, x)).alias("places")), "suffix-places")
    candidates = sized_join(df, places, "doc", "inner").select("doc", "text", "places")
    runs = candidates.mapInArrow(_runs(parts, span, core), RUNS)
    return meet(runs).mapInArrow(_covered(span, core), COVERED).groupBy("doc").agg(F.collect_list("spans").alias("spans"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        out = []
        for doc, text, blobs in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            spans = spans_of(blobs)
            out.append((doc, len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(keep(text, spans)).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=_RESULT) if out else pa.RecordBatch.from_pylist([], _RESULT)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def keep(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of a text without its removed stretches."""
    at, out = 0, []
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, core: int = CORE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) a row of df."""
    rows = numbered(df, key, text)
    spans = removed_spans(rows.select("doc", "text"), span, core)
    spans = materialise(spans.select("doc", F.aggregate("spans", F.lit(b""), lambda a, x: F.concat(a, x)).alias("spans")), "suffix-spans")
    joined = sized_join(rows, spans, "doc", "left").select("doc_id", "text", F.when(F.col("spans").isNotNull(), F.array("spans")).alias("spans"))
    return joined.mapInArrow(_cut, RESULT)


def cleaned(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, core: int = CORE) -> DataFrame:
    """(doc_id, kept binary, spans): the remaining bytes themselves, with the stretches that were removed."""
    rows = numbered(df, key, text)
    spans = materialise(removed_spans(rows.select("doc", "text"), span, core), "suffix-spans")

    def cut(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            out = [(doc, keep(t, s := spans_of(b)), [x for ab in s for x in ab]) for doc, t, b in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.list_(pa.int64()))], names=["doc_id", "kept", "spans"])

    return rows.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, kept binary, spans array<long>")
