"""Exact deduplication by Patricia-trie owners.

1. Where a document is read, its normalised text (A-Z lower-cased, as UTF-8) goes into a local trie, one a batch;
   copies that meet there collapse to one row, which carries the text, the number of copies and the row that decides
   among them. So a text that makes up a third of all rows is sent once a batch, not once a row.
2. The local rows are dealt by length and content hash. The owner of a partition inserts full byte strings into one
   compressed radix trie: texts that begin alike share edges, and equality is that of all bytes, never of hashes. A
   terminal node holds the row that decides so far and the number of copies, and nothing else. When the trie holds more
   than its budget, its largest subtrees go to files in the shared folder, with all that follows for them, and
   are finished one by one at the end, each as a trie of its own that may spill again.
3. Documents take their class from their local row, by its number. No class gathers in one place: a local row's
   documents all come from one batch.

Of equal texts the row with the largest identifier stays (null last); of rows that repeat with their identifier, one.

Defined cases: null and empty texts are one class (both are empty); a repeated identifier counts as often as it
occurs; extra columns do not matter, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import LOWER, fresh_path, materialise, numbered, sized_join, text_bytes

NULL_ID = -(1 << 63)

#: Bytes of text that one trie holds before it spills subtrees.
TRIE_BYTES = 128 << 20


class _Node:
    """An edge label and what hangs below. A terminal node has a value: (identifier that decides, its row, copies). A spilled
    node has a file, which takes what belongs below it."""

    __slots__ = ("label", "children", "value", "file")

    def __init__(self, label: bytes):
        self.label, self.children, self.value, self.file = label, None, None, None


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def insert(root: _Node, key: bytes) -> tuple[_Node, bytes, int]:
    """The node of a whole byte string below root, made if need be; what is left of the string if a spilled node is in the way,
    else nothing; and the bytes that the trie grew by."""
    node = root
    while node.file is None:
        if not key:
            return node, b"", 0
        child = node.children.get(key[0]) if node.children else None
        if child is None:
            if node.children is None:
                node.children = {}
            node.children[key[0]] = child = _Node(key)
            return child, b"", len(key) + 200
        same = _common(child.label, key)
        if same < len(child.label):  # split the edge
            upper = _Node(child.label[:same])
            child.label = child.label[same:]
            upper.children = {child.label[0]: child}
            node.children[key[0]] = child = upper
        node, key = child, key[same:]
    return node, key, 0


def terminals(root: _Node, prefix: bytes = b"") -> Iterator[tuple[bytes, _Node]]:
    """Terminal nodes below root (spilled ones aside) with their strings from there."""
    stack = [(root, prefix)]
    while stack:
        node, text = stack.pop()
        if node.file is not None:
            continue
        if node.value is not None:
            yield text, node
        for child in (node.children or {}).values():
            stack.append((child, text + child.label))


def _deciding(a: tuple, b: tuple) -> tuple:
    """Of two values, the larger identifier (null is smaller than all), ties by the smaller row; copies are added."""
    order = lambda v: (v[0] is not None, v[0] or 0, -v[1])
    best = max(a, b, key=order)
    return best[0], best[1], a[2] + b[2]


class _Spill:
    """A file of records in the shared folder, written as its subtree gets them and read back once."""

    def __init__(self, folder: str):
        self.fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(path, recursive=True)
        self.path = f"{path}/{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.path)

    def put(self, record: tuple) -> None:
        self.out.write(pickle.dumps(record))

    def records(self) -> Iterator[tuple]:
        self.out.close()
        with self.fs.open_input_stream(self.path, buffer_size=1 << 20) as file:
            while True:
                try:
                    yield pickle.load(file)
                except EOFError:
                    break
        self.fs.delete_file(self.path)


class Owner:
    """One radix trie with a byte budget. Rows (rep, identifier, copies, text) go in; each comes out with its class."""

    def __init__(self, folder: str, budget: int = TRIE_BYTES):
        self.folder, self.budget = folder, budget
        self.root, self.held = _Node(b""), 0
        self.rows: list[tuple[int, int | None, int, _Node]] = []  # without texts
        self.spilled: list[_Node] = []

    def add(self, rep: int, identifier: int | None, copies: int, text: bytes) -> None:
        node, left, grown = insert(self.root, text)
        if node.file is not None:
            node.file.put((rep, identifier, copies, left))
            return
        value = (identifier, rep, copies)
        node.value = value if node.value is None else _deciding(node.value, value)
        self.rows.append((rep, identifier, copies, node))
        self.held += grown
        if self.held > self.budget:
            self._spill()

    def _sizes(self) -> tuple[dict[int, int], set[int]]:
        """Bytes in each node's subtree, by the node's identity, and the nodes above spilled ones; parents come before children
        in `order`."""
        order, sizes, above = [(self.root, None)], {}, set()
        for node, _ in order:
            order += [(c, node) for c in (node.children or {}).values()]
        for node, parent in reversed(order):
            sizes[id(node)] = sizes.get(id(node), 0) + len(node.label) + 200
            if parent is not None:
                sizes[id(parent)] = sizes.get(id(parent), 0) + sizes[id(node)]
                if node.file is not None or id(node) in above:
                    above.add(id(parent))
        return sizes, above

    def _spill(self) -> None:
        """The largest subtrees go until half the budget is free. A subtree that is nearly the whole trie is opened first, as
        texts that all begin alike hang below one edge; so is one with a spilled subtree in it."""
        (sizes, above), cut = self._sizes(), []
        open_ = [c for c in (self.root.children or {}).values() if c.file is None]
        while self.held > self.budget // 2 and open_:
            open_.sort(key=lambda n: sizes[id(n)])
            node = open_.pop()
            if (sizes[id(node)] > self.budget // 2 or id(node) in above) and node.children:
                open_ += [c for c in node.children.values() if c.file is None]
                continue
            cut.append(node)
            self.held -= sizes[id(node)]
        gone: dict[int, tuple[_Node, bytes]] = {}
        for node in cut:
            gone |= {id(x): (node, text) for text, x in terminals(node)}
        for node in cut:
            node.file = _Spill(self.folder)
        kept = []
        for row in self.rows:
            at = gone.get(id(row[3]))
            if at is None:
                kept.append(row)
            else:
                at[0].file.put((*row[:3], at[1]))
        self.rows = kept
        for node in cut:
            node.children = node.value = None
        self.spilled += cut

    def classes(self) -> Iterator[tuple[int, tuple]]:
        """(rep, value of its class) of every row."""
        for rep, _, _, node in self.rows:
            yield rep, node.value
        self.rows, self.root, self.held = [], _Node(b""), 0
        for node in self.spilled:
            below = Owner(self.folder, self.budget)
            for record in node.file.records():
                below.add(*record)
            yield from below.classes()
        self.spilled = []


LOCAL = "doc long, doc_id long, rep long, best long, n long, length long, hash long, sha string, text binary"


def _local(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collapse the copies that meet in one batch; the row that decides among them carries the text."""
    for batch in rows:
        docs, ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [t.translate(LOWER) for t in text_bytes(batch.column(2))]
        root, nodes = _Node(b""), []
        for doc, identifier, text in zip(docs, ids, texts, strict=True):
            node = insert(root, text)[0]  # the empty string ends at the root
            value = (identifier, doc, 1)
            node.value = value if node.value is None else _deciding(node.value, value)
            nodes.append(node)
        marks: dict[int, tuple[int, int, str]] = {}
        out: dict[str, list] = {k: [None] * len(ids) for k in ("rep", "best", "n", "length", "hash", "sha", "text")}
        for i, (doc, text, node) in enumerate(zip(docs, texts, nodes, strict=True)):
            best, rep, n = node.value
            if id(node) not in marks:
                marks[id(node)] = len(text), xxhash.xxh64_intdigest(text) - (1 << 63), hashlib.sha256(text).hexdigest()
            out["rep"][i] = rep
            out["length"][i], out["hash"][i], out["sha"][i] = marks[id(node)]
            if doc == rep:
                out["best"][i], out["n"][i], out["text"][i] = best, n, text
        kinds = {"sha": pa.string(), "text": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.int64()), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())], names=[c.split()[0] for c in LOCAL.split(", ")])


OWNED = "rep long, keep_id long, keep_row long, group_size long"


def _owners(folder: str, budget: int):
    names = [c.split()[0] for c in OWNED.split(", ")]

    def own(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = Owner(folder, budget)
        for batch in rows:
            for record in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                owner.add(*record)
        out: list[tuple] = []
        for rep, value in owner.classes():
            out.append((rep, *value))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return own


def _classes(numbers: DataFrame, trie_bytes: int) -> DataFrame:
    """(doc_id, doc, keep_id, keep_row, group_size, sha) a row of numbers (doc_id, text, doc); doc is unique."""
    spark = numbers.sparkSession
    local = materialise(numbers.select("doc", "doc_id", "text").mapInArrow(_local, LOCAL), "exact-local")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = local.filter("n is not null").select("rep", "best", "n", "text", "length", "hash").repartition(parts, "length", "hash")
    owned = dealt.select("rep", "best", "n", "text").mapInArrow(_owners(fresh_path(spark, "exact-spill"), trie_bytes), OWNED)
    return local.select("doc_id", "doc", "rep", "sha").join(owned, "rep").select("doc_id", "doc", "keep_id", "keep_row", "group_size", "sha")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) a row of df. Of equal texts the largest identifier stays."""
    out = _classes(numbered(df, key, text), trie_bytes)
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the rows that an equal text with a larger identifier replaces; of rows that repeat with their
    identifier too, one stays."""
    numbers = numbered(df, key, text, whole=True)
    kept = materialise(_classes(numbers, TRIE_BYTES).filter("doc = keep_row").select("doc"), "exact-kept")
    return sized_join(numbers, kept, "doc", "left_semi").select("row.*")
