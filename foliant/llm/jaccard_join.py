"""Exact n-gram Jaccard self-join with set-relation skipping.

A document's set is its distinct 5-word shingles as 64-bit hashes. Two documents link when their sets' Jaccard
similarity reaches the threshold; the result is every document's component under links.

1. Equal sets are one node (a digest of 128 bits and the size), so copies never form pairs.
2. A cheap pass proposes likely links: nodes that agree in a pair of minimum hashes are sorted by their other
   minimum hashes, and each is proposed to a few neighbours of another component. Proposals are verified on whole
   sets, and verified links join components; a few turns leave large groups of near copies in one component. This
   only saves work: what it misses, the next step finds.
3. Exact pass. Tokens have one global order, from rare to frequent by a count sketch over all documents, so
   frequent lines and passages come last. Of two sets that link, the first common token in this order has all
   common tokens at or after its position in either set, so both sets hold at least the needed overlap from there
   on. Only positions at which that can be are indexed. An index list is kept in blocks by size class and position
   class; two blocks are compared only if some sizes and positions in their bounds can reach the overlap, all others
   are skipped whole, as is the probing set's own component inside a block. What is left are pairs whose exact
   positions reach it.
   As a component's sets are alike, a pair of sets counts as a pair of a set and the larger one's component: a set
   that meets thousands of near copies is one candidate, not thousands.
4. Answers are derived from answers. A component's sets are held as their differences from one of them, the hub. A
   probing set's overlap with the hub is computed once; for every other set y of the component it is that, plus the
   part of y - hub that the probe has, less the part of hub - y. The sizes of these differences decide most sets
   without a lookup, either way, for all of them at once; the differences of the others are looked up.

Links between nodes of one component change no component, so steps 2 to 4 look for links across components only. A
list is held by one task; the global order keeps lists short, and copies and likely links have been folded before.
Index partitions are as many as the indexed tokens need.

5. Every link lies within a final component. A component is cut into blocks by hash, and every pair of blocks is
   compared set by set in one task, which counts common tokens. links() returns the linked pairs of nodes, and
   near_duplicates() a document's number of links, summed without a row a pair.

Defined cases: null and empty texts, and texts without words, have an empty set and link with nothing; a text
with fewer words than a shingle has is one shingle; where identifiers are null or repeated, rows are told apart by a
written row number, so every row has its own text's links; extra columns do not matter, whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import LOWER, groups_of_texts, materialise, mix, numbered, ranked, sized_join, text_bytes, word_hashes
from foliant.llm.components import components

SHINGLE, THRESHOLD = 5, (80, 100)
SKETCH = 1 << 21
BANDS, ROWS = 10, 2

#: Turns of the proposing pass, with the neighbours that each node is proposed to in each band.
LAGS = (2, 4)

#: Pairs of one index list block that are held at once.
PAIRS = 2_000_000

#: Partners that one verification block holds.
BLOCK = 256

#: Tokens whose common use by a pair of blocks is counted at once.
TOKENS = 4096

NO_ID = -(1 << 63)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for run in groups_of_texts(texts):
        words, first = word_hashes([texts[i].translate(LOWER) for i in run])
        n = max(0, len(words) - size + 1)
        rolled = np.full(n, size, np.uint64)
        for i in range(size):
            rolled = mix(rolled ^ words[i : i + n]) if i == size - 1 else (rolled ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        for low, high in zip(first[:-1], first[1:], strict=True):
            if high - low >= size:
                out.append(np.unique(rolled[low : high - size + 1]))
            elif high > low:
                h = np.array([high - low], np.uint64)
                for w in words[low:high]:
                    h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
                out.append(mix(h))
            else:
                out.append(np.empty(0, np.uint64))
    return out


DIGEST = ["n", "d1", "d2"]
SUMMARY = "id long, n long, d1 long, d2 long, bands array<long>, sketch binary"


def _summaries(size: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
    odd = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_rows = np.zeros(SKETCH, np.int64), False
        for batch in rows:
            any_rows = True
            sets = shingle_sets(text_bytes(batch.column(1)), size)
            lengths = np.array([len(s) for s in sets], np.int64)
            everything = np.concatenate([*sets, np.empty(0, np.uint64)])
            counts += np.bincount((everything % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
            full = np.flatnonzero(lengths)
            starts = (np.cumsum(lengths) - lengths)[full]
            d1, d2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            bands: list = [None] * len(sets)
            if len(full):
                d1[full] = np.add.reduceat(everything, starts)
                d2[full] = np.bitwise_xor.reduceat(mix(everything), starts)
                least = np.stack([np.minimum.reduceat(everything * o, starts) for o in odd])
                band = np.stack([mix(least[ROWS * b] ^ mix(least[ROWS * b + 1] + np.uint64(b + 1))) for b in range(BANDS)]).view(np.int64)
                for k, i in enumerate(full):
                    bands[i] = band[:, k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.nulls(len(sets), pa.binary())], schema=schema)
        if any_rows:
            nothing = [pa.nulls(1, f.type) for f in list(schema)[:5]]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([zlib.compress(counts.tobytes(), 1)])], schema=schema)

    return run


def _sketch_sums(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SKETCH, np.int64)
    for batch in rows:
        for data in batch.column(0):
            total += np.frombuffer(zlib.decompress(data.as_py()), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["sketch"])


def _frequency_classes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sketch_sums(rows):
        total = np.frombuffer(zlib.decompress(batch.column(0)[0].as_py()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([np.minimum(255, np.floor(4 * np.log2(total + 1))).astype(np.uint8).tobytes()], pa.binary())], names=["classes"])


def _needed(n: np.ndarray, m: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """Least overlap of linked sets of sizes n and m: 100 i >= 80 (n + m - i)."""
    return -(-t[0] * (n + m) // (t[0] + t[1]))


def prefix(n, t: tuple[int, int] = THRESHOLD):
    """Tokens of a set of size n that are indexed: at a later position, fewer than the least overlap are left."""
    return n - -(-t[0] * n // t[1]) + 1


POSTINGS = "part int, data binary"
_ENTRY = np.dtype([("token", "<u4"), ("doc", "<u4"), ("pos", "<u4")])
_DOC = np.dtype([("id", "<i8"), ("comp", "<i8"), ("members", "<i8"), ("n", "<i8")])

#: Indexed tokens that an index partition holds, about.
PART_TOKENS = 400_000


def _postings(frequency, size: int, parts: int, t: tuple[int, int]):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(frequency.value, np.uint8)
        for batch in rows:
            ids, comps, members = (np.asarray(batch.column(i).to_pylist(), np.int64) for i in range(3))
            sets = shingle_sets(text_bytes(batch.column(3)), size)
            tokens, docs, positions = [], [], []
            for i, s in enumerate(sets):
                n = len(s)
                if not n:
                    continue
                k = int(prefix(n, t))
                order = np.lexsort((s, rank[(s % np.uint64(SKETCH)).astype(np.int64)]))[:k]
                tokens.append(s[order])
                docs.append(np.full(k, i, np.uint32))
                positions.append(np.arange(k, dtype=np.uint32))
            if not tokens:
                continue
            tokens, docs, positions = map(np.concatenate, (tokens, docs, positions))
            part = ((tokens >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            lengths = np.array([len(s) for s in sets], np.int64)
            out_part, out_data = [], []
            for p in range(parts):
                at = order[edges[p] : edges[p + 1]]
                if not len(at):
                    continue
                used, local = np.unique(docs[at], return_inverse=True)
                head = np.zeros(len(used), _DOC)
                head["id"], head["comp"], head["members"], head["n"] = ids[used], comps[used], members[used], lengths[used]
                body = np.zeros(len(at), _ENTRY)
                body["token"], body["doc"], body["pos"] = tokens[at].astype(np.uint32), local, positions[at]
                # columns of small numbers pack well
                packed = zlib.compress(b"".join(np.ascontiguousarray(x).tobytes() for x in (head["id"], head["comp"], head["members"], head["n"], body["doc"], body["pos"])), 1)
                out_part.append(p)
                out_data.append(np.array([len(used), len(at), len(packed)], "<i8").tobytes() + packed + body["token"].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_part, pa.int32()), pa.array(out_data, pa.binary())], names=["part", "data"])

    return run


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    """(token, id, comp, members, n, pos) of a blob."""
    d, e, p = np.frombuffer(data, "<i8", 3)
    raw = zlib.decompress(data[24 : 24 + p])
    ids, comps, members, ns = np.frombuffer(raw, "<i8", 4 * d).reshape(4, d)
    doc, pos = np.frombuffer(raw, "<u4", 2 * e, 32 * d).reshape(2, e)
    return np.frombuffer(data, "<u4", e, 24 + p), ids[doc], comps[doc], members[doc], ns[doc], pos.astype(np.int64)


CANDIDATES = "a long, ca long, cb long"

#: Size classes in the ratio of two linked sets' sizes, and position classes a set's length.
SIZES_A_RATIO, POSITIONS = 4, 32


def _spans(starts: np.ndarray, ends: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for every i and j in starts[i]..ends[i], at most about `most` at a time."""
    sizes = np.maximum(ends - starts, 0)
    sums = np.cumsum(sizes)
    low = 0
    while low < len(sizes):
        high = int(np.searchsorted(sums, (sums[low - 1] if low else 0) + most, side="right"))
        high = max(high, low + 1)
        n = sizes[low:high]
        if n.sum():
            i = np.repeat(np.arange(low, high), n)
            yield i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[low:high], n)
        low = high


def _reachable(ahead: int, x: int, y: int, t: tuple[int, int]) -> bool:
    """Whether a set of position class x can link with one that is `ahead` size classes larger, of position class y."""
    ratio, part = t[1] / t[0], t[0] / (t[0] + t[1])
    step = ratio ** (1 / SIZES_A_RATIO)
    high = min(ratio, step ** (ahead + 1), (1 - x / POSITIONS) / part - 1)  # of the second size to the first
    other = (1 - y / POSITIONS) / part - 1
    return other > 0 and max(step ** (ahead - 1), 1 / other) <= high + 1e-6


def _list_pairs(token, ids, comp, members, n, pos, t: tuple[int, int]) -> Iterator[np.ndarray]:
    """(a, ca, cb) that the lists of one partition leave, in pieces: sets and the components, as large as theirs at least, of
    sets that they may link with."""
    order = np.lexsort((comp, token))
    token, comp_ = token[order], comp[order]
    new = np.append(True, token[1:] != token[:-1])
    list_ = np.cumsum(new) - 1
    several = np.zeros(len(new) and list_[-1] + 1, bool)
    several[list_[1:][~new[1:] & (comp_[1:] != comp_[:-1])]] = True
    order, list_ = order[several[list_]], list_[several[list_]]
    if not len(order):
        return
    ids, comp, members, n, pos = (x[order] for x in (ids, comp, members, n, pos))
    size = np.floor(np.log(n) * SIZES_A_RATIO / np.log(t[1] / t[0]) + 1e-9).astype(np.int64)
    place = np.minimum(pos * POSITIONS // n, POSITIONS - 1)
    comps, group = np.unique(comp, return_inverse=True)
    sizes, groups = int(size.max()) + SIZES_A_RATIO + 2, len(comps)
    key = ((list_ * sizes + size) * POSITIONS + place) * groups + group  # lists in blocks, a block by component
    order = np.argsort(key, kind="stable")
    key, ids, comp, members, n, pos, place, group = (x[order] for x in (key, ids, comp, members, n, pos, place, group))
    classes = np.unique(place)
    for x in classes:
        src = np.flatnonzero(place == x)
        block = key[src] // groups
        for ahead in range(SIZES_A_RATIO + 2):
            for y in classes:
                if ahead == 0 and y < x or not _reachable(ahead, x, y, t):
                    continue
                first = (block + ahead * POSITIONS + (y - x)) * groups
                after, end = np.searchsorted(key, first + group[src] + 1), np.searchsorted(key, first + groups)
                ranges = [(after, end)]
                if ahead or x != y:
                    ranges.append((np.searchsorted(key, first), np.searchsorted(key, first + group[src])))
                for starts, ends in ranges:
                    for i, j in _spans(starts, ends, PAIRS):
                        i = src[i]
                        ok = _needed(n[i], n[j], t) <= np.minimum(n[i] - pos[i], n[j] - pos[j])
                        i, j = i[ok], j[ok]
                        if len(i):
                            small = (members[i] < members[j]) | ((members[i] == members[j]) & (comp[i] > comp[j]))
                            a, b = np.where(small, i, j), np.where(small, j, i)
                            yield np.stack([ids[a], comp[a], comp[b]])


def _fold(pieces: list[np.ndarray]) -> np.ndarray:
    """Equal candidates are one."""
    rows = np.concatenate(pieces, axis=1)
    rows = rows[:, np.lexsort((rows[2], rows[0]))]
    return rows[:, np.append(True, (rows[0, 1:] != rows[0, :-1]) | (rows[2, 1:] != rows[2, :-1]))]


def _candidates(t: tuple[int, int]):
    names = [c.split()[0] for c in CANDIDATES.split(", ")]

    def emit(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=names)

    def of(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for piece in _list_pairs(*(np.concatenate(c) for c in zip(*map(_unpack, blobs), strict=True)), t):
            held.append(piece)
            size += piece.shape[1]
            if size > 2 * PAIRS:
                held = [_fold(held)]
                size = held[0].shape[1]
                if size > PAIRS:
                    yield emit(held.pop())
                    size = 0
        if held:
            yield emit(_fold(held))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = None, []
        for batch in rows:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part and blobs:
                    yield from of(blobs)
                    blobs = []
                part = p
                blobs.append(data)
        if blobs:
            yield from of(blobs)

    return run


VERIFIED = "a long, b long, overlap long, n_a long, n_b long"


def _verify(size: int, t: tuple[int, int]):
    """Rows come sorted by probing set and block, its own text first, then partners by component."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own, last, known = None, None, None, 0
        for batch in rows:
            hubs, blocks, ids = (batch.column(i).to_pylist() for i in range(3))
            sets = shingle_sets(text_bytes(batch.column(3)), size)
            out: list[tuple] = []
            for h, block, i, s in zip(hubs, blocks, ids, sets, strict=True):
                if i == h:
                    hub, own, last = (h, block), s, None
                    continue
                assert hub == (h, block), "a probing set's text is missing"
                need = int(_needed(np.int64(len(s)), np.int64(len(own)), t))
                if need > min(len(s), len(own)):
                    continue
                if last is not None and abs(len(last) - len(s)) * 4 < len(s):
                    more, less = np.setdiff1d(s, last, True), np.setdiff1d(last, s, True)
                    if known + len(more) < need:  # decided without a lookup; `known` stays that of `last`
                        continue
                    overlap = known + int(np.isin(more, own, True).sum()) - int(np.isin(less, own, True).sum())
                else:
                    overlap = len(np.intersect1d(s, own, True))
                last, known = s, overlap
                if overlap >= need:
                    out.append((h, i, overlap, len(own), len(s)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[c.split()[0] for c in VERIFIED.split(", ")])

    return run


def verified(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE, t: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The pairs (a probes b; c groups b's) that link. texts: (id, text). A probing set with many partners is dealt over blocks."""
    spark = pairs.sparkSession
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(counts, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    probes = counts.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.col("a"), "block", F.col("a").alias("id"), F.lit(NO_ID).alias("c"))
    asked = materialise(dealt.select("a", "block", F.col("b").alias("id"), "c").unionByName(probes), "jaccard-asked")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sized_join(texts, asked, "id", "inner")
    rows = rows.repartition(parts, "a", "block").sortWithinPartitions("a", "block", (F.col("id") != F.col("a")).cast("int"), "c", "id")
    return rows.select("a", "block", "id", "text").mapInArrow(_verify(size, t), VERIFIED)


LINKED = "a long, comp long"


def _reaching(size: int, t: tuple[int, int]):
    """Rows (comp, block, role, id, text) come sorted: a block of a component's sets, then the sets that probe it."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, hub = None, [], None
        for batch in rows:
            comps, blocks, roles, ids = (batch.column(i).to_pylist() for i in range(4))
            sets = shingle_sets(text_bytes(batch.column(4)), size)
            out: list[tuple[int, int]] = []
            for c, block, role, i, s in zip(comps, blocks, roles, ids, sets, strict=True):
                if key != (c, block):
                    key, held, hub = (c, block), [], None
                if role == 0:
                    held.append(s)
                    continue
                if not held:
                    continue
                if hub is None:  # the first probe of a block
                    hub = held[0]
                    more, less = [np.setdiff1d(y, hub, True) for y in held], [np.setdiff1d(hub, y, True) for y in held]
                    n, n_more, n_less = (np.array([len(x) for x in xs], np.int64) for xs in (held, more, less))
                need = _needed(n, len(s), t)
                need[need > np.minimum(n, len(s))] = 1 << 60  # sizes that cannot link
                known = len(np.intersect1d(s, hub, True))
                if (known - n_less >= need).any():
                    out.append((i, c))
                    continue
                for k in np.flatnonzero(known + n_more >= need):
                    if known + np.isin(more[k], s, True).sum() - np.isin(less[k], s, True).sum() >= need[k]:
                        out.append((i, c))
                        break
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "comp"])

    return run


def reaching(asked: DataFrame, place: DataFrame, texts: DataFrame, size: int = SHINGLE, t: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(a, comp) of the candidates asked (a, cb) in which the set links with a set of the component. place: (id, comp, members);
    texts: (id, text). A component is dealt in blocks of sets, each of which meets all sets that probe the component."""
    spark = asked.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = asked.select(F.col("cb").alias("comp")).distinct()
    members = place.join(wanted, "comp", "left_semi").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sizes = members.groupBy("comp").agg(F.first("blocks").alias("blocks"))
    probes = asked.select(F.col("a").alias("id"), F.col("cb").alias("comp")).join(sizes, "comp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["id", "comp", "block"]
    both = members.select(*columns, F.lit(0).alias("role")).unionByName(probes.select(*columns, F.lit(1).alias("role")))
    rows = sized_join(texts, materialise(both, "jaccard-reaching"), "id", "inner").select("comp", "block", "role", "id", "text")
    return rows.repartition(parts, "comp", "block").sortWithinPartitions("comp", "block", "role", "id").mapInArrow(_reaching(size, t), LINKED).distinct()


WITHIN = {"pairs": VERIFIED, "sums": "id long, links long"}


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Common tokens of each two sets."""
    tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    uses = np.bincount(column, minlength=len(tokens))
    place = np.cumsum(uses > 1) - 1
    row, column = row[uses[column] > 1], place[column[uses[column] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, int((uses > 1).sum()), TOKENS):
        at = slice(*np.searchsorted(column, [low, low + TOKENS]))
        has = np.zeros((len(sets), TOKENS), np.float32)
        has[row[at], column[at] - low] = 1
        out += (has @ has.T).astype(np.int64)
    return out


def _within(size: int, t: tuple[int, int], kind: str):
    """Rows come sorted by component and pair of blocks; a pair of different blocks is compared across only."""
    names = [c.split()[0] for c in WITHIN[kind].split(", ")]

    def of(key: tuple, held: list[tuple]) -> pa.RecordBatch:
        ids, block, weight = (np.array([h[i] for h in held], np.int64) for i in range(3))
        n = np.array([len(h[3]) for h in held], np.int64)
        common = _overlaps([h[3] for h in held])
        linked = common >= _needed(n[:, None], n[None, :], t)
        linked &= (block[:, None] != block[None, :]) if key[1] != key[2] else ~np.eye(len(held), dtype=bool)
        if kind == "sums":
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array((linked * weight[None, :]).sum(1))], names=names)
        a, b = np.nonzero(linked & (ids[:, None] < ids[None, :]))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a], ids[b], common[a, b], n[a], n[b])], names=names)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in rows:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for *k, i, block, weight, s in zip(*columns, shingle_sets(text_bytes(batch.column(6)), size), strict=True):
                if held and k != key:
                    yield of(key, held)
                    held = []
                key = k
                if not held or held[-1][0] != i:  # a row that is repeated is one
                    held.append((i, block, weight, s))
        if held:
            yield of(key, held)

    return run


def _links(place: DataFrame, texts: DataFrame, kind: str, size: int, t: tuple[int, int]) -> DataFrame:
    """Links within components. place: (id, comp, weight), materialised; texts: (id, text)."""
    parts = int(place.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = place.groupBy("comp").agg(F.count("*").alias("m")).filter("m > 1").select("comp", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    members = place.join(counts, "comp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = sized_join(texts, materialise(members, "jaccard-members"), "id", "inner")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("comp", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "block", "weight", "text")
    rows = rows.repartition(parts, "comp", "x", "y").sortWithinPartitions("comp", "x", "y", "id")
    return rows.mapInArrow(_within(size, t, kind), WITHIN[kind])


def _proposals(nodes: DataFrame, turn: int, lags: int) -> DataFrame:
    """(a, b, ca, cb): nodes that agree in a band and are near each other when sorted by their other bands, which puts
    the most alike side by side; only nodes of different components."""
    key = F.concat(F.slice("bands", 1 + turn * BANDS // 2, BANDS), F.slice("bands", 1, BANDS))
    banded = nodes.select("node", "comp", key.alias("key"), F.posexplode("bands").alias("band", "hash"))
    shared_ = banded.groupBy("band", "hash").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high")
    banded = banded.join(shared_.select("band", "hash"), ["band", "hash"], "left_semi")
    at = ranked(banded, [F.col(c) for c in ("band", "hash", "key", "node")], "rank", "jaccard-banded")
    at = materialise(at.select("band", "hash", "node", "comp", "rank"), "jaccard-sorted")
    ahead = at.select("band", "hash", F.col("node").alias("other"), F.col("comp").alias("other_comp"), F.explode(F.sequence(F.col("rank") + 1, F.col("rank") + lags)).alias("rank"))
    near = at.join(ahead, ["band", "hash", "rank"]).filter("comp != other_comp")
    if turn == 0:  # and to the smallest of the band
        least = at.groupBy("band", "hash").agg(F.min(F.struct("node", "comp")).alias("m"))
        hubs = at.join(least, ["band", "hash"]).select("node", "comp", F.col("m.node").alias("other"), F.col("m.comp").alias("other_comp"))
        near = near.select(hubs.columns).unionByName(hubs).filter("comp != other_comp")
    first = F.col("node") < F.col("other")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return near.select(pick("node", "other").alias("a"), pick("other", "node").alias("b"), pick("comp", "other_comp").alias("ca"), pick("other_comp", "comp").alias("cb")).distinct()


def _merged(place: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """place (id, comp) after links (a, b) between components."""
    merged = components(links).select(F.col("id").alias("comp"), "component")
    return materialise(place.join(merged, "comp", "left").select("id", F.coalesce("component", "comp").alias("comp")), tag)


def _components(df: DataFrame, size: int, t: tuple[int, int]) -> tuple[DataFrame, ...]:
    """Summaries of df's rows (id, text), nodes, and the components (id, comp) of nodes under all links."""
    spark = df.sparkSession
    rows = df.select("id", "text")
    summary = materialise(rows.mapInArrow(_summaries(size), SUMMARY), "jaccard-summary")
    sketches = summary.filter("sketch is not null").select("sketch")
    # two levels of sums, each of one vector a task; the driver gets a byte a bucket
    added = sketches.repartition(16).mapInArrow(_sketch_sums, "sketch binary").repartition(1).mapInArrow(_frequency_classes, "classes binary")
    frequency = spark.sparkContext.broadcast(bytes(added.first()[0]))
    full = summary.filter("sketch is null and n > 0")
    nodes = full.groupBy(*DIGEST).agg(F.min("id").alias("node"), F.count("*").alias("weight"), F.first("bands").alias("bands"))
    nodes = materialise(nodes, "jaccard-nodes")

    # likely links, verified
    place = materialise(nodes.select(F.col("node").alias("id"), F.col("node").alias("comp")), "jaccard-place")
    for turn, lags in enumerate(LAGS):
        asked = materialise(_proposals(nodes.join(place, F.col("node") == F.col("id")), turn, lags), "jaccard-proposed")
        links = verified(asked.withColumn("c", F.col("a")), rows, size, t).select("a", "b")
        at = asked.join(links, ["a", "b"], "left_semi")
        place = _merged(place, at.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "jaccard-place")

    # every other link
    sizes = place.groupBy("comp").agg(F.count("*").alias("members"))
    sized = materialise(place.join(sizes, "comp").select("id", "comp", "members"), "jaccard-sized")
    least = F.ceil(F.lit(t[0]) * F.col("n") / F.lit(t[1]))
    total = nodes.agg(F.sum(F.col("n") - least + 1)).first()[0] or 0
    parts = max(2, -(-int(total) // PART_TOKENS))
    indexed = sized_join(rows, sized, "id", "inner").select("id", "comp", "members", "text")
    blobs = indexed.mapInArrow(_postings(frequency, size, parts, t), POSTINGS)
    found = blobs.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(_candidates(t), CANDIDATES)
    asked = materialise(found.distinct(), "jaccard-candidates")
    more = reaching(asked.select("a", "cb"), sized, rows, size, t).withColumnRenamed("comp", "cb")
    joined = asked.join(more, ["a", "cb"], "left_semi").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    return summary, nodes, _merged(place, joined, "jaccard-final")


def _weighted(place: DataFrame, nodes: DataFrame) -> DataFrame:
    return materialise(place.join(nodes.select(F.col("node").alias("id"), "weight"), "id"), "jaccard-weighted")


def _numbered(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, text, id)"""
    return numbered(df, key, text).withColumnRenamed("doc", "id")


def links(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, t: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(a, b, overlap, n_a, n_b): every link between different sets. a < b stand for their sets: the smallest identifiers,
    or row numbers where identifiers are null or repeated."""
    numbers = _numbered(df, key, text)
    _, nodes, place = _components(numbers, size, t)
    return _links(_weighted(place, nodes), numbers.select("id", "text"), "pairs", size, t)


def _classes(numbers: DataFrame, size: int, t: tuple[int, int], count_links: bool) -> DataFrame:
    """(id, n, comp, n_links) a row; comp is null for rows without words."""
    summary, nodes, place = _components(numbers, size, t)
    of_node = nodes.select(*DIGEST, "node", "weight").join(place.select(F.col("id").alias("node"), "comp"), "node").withColumn("n_links", F.lit(None).cast("long"))
    if count_links:
        sums = materialise(_links(_weighted(place, nodes), numbers.select("id", "text"), "sums", size, t).groupBy("id").agg(F.sum("links").alias("links")), "jaccard-links")
        of_node = of_node.join(sums.withColumnRenamed("id", "node"), "node", "left").withColumn("n_links", F.col("weight") - 1 + F.coalesce("links", F.lit(0)))
    columns = ["id", "n", "comp", "n_links"]
    linked = summary.filter("sketch is null and n > 0").select("id", *DIGEST).join(of_node, DIGEST).select(columns)
    empty = summary.filter("sketch is null and n = 0").select("id", "n", F.lit(None).cast("long").alias("comp"), F.lit(0).cast("long").alias("n_links"))
    return materialise(linked.unionByName(empty), "jaccard-classes")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, t: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) a row of df; n_links: other rows that its row links to, copies with them."""
    numbers = _numbered(df, key, text)
    rows = numbers.select("doc_id", "id").join(_classes(numbers, size, t, True), "id")
    least = materialise(rows.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id")), "jaccard-least")
    named = sized_join(rows, least, "comp", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "n_links")


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each component, one with the smallest identifier (null last); rows without words all stay."""
    numbers = numbered(df, key, text, whole=True).withColumnRenamed("doc", "id")
    rows = numbers.select("doc_id", "id").join(_classes(numbers, SHINGLE, THRESHOLD, False), "id")
    first = rows.filter("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id")).getField("id").alias("id"))
    kept = materialise(first.select("id").unionByName(rows.filter("comp is null").select("id")), "jaccard-kept")
    return sized_join(numbers, kept, "id", "inner").select("row.*")
