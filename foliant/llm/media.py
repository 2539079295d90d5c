"""Media columns: content-addressed payloads in tar shards.

Every payload is stored as an 8-bit greyscale PNG (192 samples a line, filter 0, DEFLATE), so it is lossless.
Writers append payloads to tar shards in the shared folder; a shard is closed at a fixed size, so none grows
with a source or a group of copies. Within a shard a payload is stored once, under its digest; over all shards
the smallest (shard, offset) of a digest is its address, and every row points there. Rows carry digest,
offset and length. Readers never scan shards: metadata columns come from range reads of the 33 header bytes
at an offset, and whole payloads are range-read only where features ask for them.

A shard's name holds a fresh identifier for each attempt, so a task that is run again leaves at worst a shard
that no row names. The shared folder is reached through pyarrow's filesystems (file, hdfs, s3, gs).

Defined cases: a null or empty text is a payload of 192 spaces; equal texts have equal values; repeated rows
are rows of their own; an empty table writes no shard.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import fresh_path, materialise, text_bytes

WIDTH = 192

#: A tar shard is closed when it holds so many bytes.
SHARD_BYTES = 64 << 20

#: Bytes from a payload's start that hold the PNG signature and IHDR.
HEADER = 33

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(text: bytes, width: int = WIDTH) -> bytes:
    return text.ljust(max(width, -(-len(text) // width) * width), b" ")


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    lines = np.frombuffer(payload, np.uint8).reshape(-1, width)
    framed = np.zeros((len(lines), width + 1), np.uint8)  # a filter byte, 0, before each line
    framed[:, 1:] = lines
    head = struct.pack(">IIBBBBB", width, len(lines), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(framed.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """(width, height, bits, colour type) from the first 33 bytes."""
    if len(head) < HEADER or head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", head[16:26])


def decode_png(data: bytes) -> bytes:
    """Samples of a PNG as encode_png writes them."""
    width, height, bits, colour = png_header(data[:HEADER])
    if (bits, colour) != (8, 0):
        raise ValueError("only 8-bit greyscale is stored here")
    at, packed = HEADER, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed += data[at + 8 : at + 8 + size]
        at += size + 12
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not stored here")
    return lines[:, 1:].tobytes()


def feature(payload: bytes, width: int = WIDTH) -> str:
    """A 64-bit difference hash of the mean brightness on a grid of 8 x 9 cells, as hex."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    down, across = np.arange(len(image)) * 8 // len(image), np.arange(width) * 9 // width
    columns = image.astype(float) @ (across[:, None] == np.arange(9))
    sums = np.stack([columns[down == i].sum(0) for i in range(8)])
    means = sums / np.maximum(1, np.bincount(down, minlength=8)[:, None] * np.bincount(across, minlength=9)[None])
    bits = (means[:, 1:] > means[:, :-1]).ravel()
    return f"{int(''.join('01'[int(b)] for b in bits), 2):016x}"


class _Tar:
    """Appends members to a tar shard and knows where their bytes begin."""

    def __init__(self, fs: pyarrow.fs.FileSystem, folder: str):
        self.name = f"{uuid.uuid4().hex}.tar"
        self.out = fs.open_output_stream(f"{folder}/{self.name}")
        self.at, self.has = 0, {}

    def put(self, digest: str, data: bytes) -> tuple[int, int]:
        if digest not in self.has:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + data + b"\0" * (-len(data) % 512))
            self.has[digest] = (self.at + len(head), len(data))
            self.at += len(head) + len(data) + -len(data) % 512
        return self.has[digest]

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


STORED = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def _store(folder: str, width: int, shard_bytes: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        tar, known = None, {}
        try:
            for batch in rows:
                out = []
                for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                    payload = padded(text, width)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in known:
                        if tar is None or tar.at > shard_bytes:
                            if tar:
                                tar.close()
                            tar, known = _Tar(fs, path), {}
                        known[digest] = (tar.name, *tar.put(digest, encode_png(payload, width)))
                    out.append((doc, len(text), digest, *known[digest]))
                yield pa.RecordBatch.from_pylist([dict(zip(_names(STORED), x, strict=True)) for x in out], _arrow(STORED))
        finally:
            if tar:
                tar.close()

    return run


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def store(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, str]:
    """Write the shards. Returns (doc_id, n_bytes, digest, shard, offset, length) a row, and the shards' folder."""
    folder = fresh_path(df.sparkSession, "tar")
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    stored = materialise(rows.mapInArrow(_store(folder, width, shard_bytes), STORED), "media")
    return stored, folder


def addresses(stored: DataFrame) -> DataFrame:
    """(digest, shard, offset, length): one address a digest, pre-aggregated where rows are read."""
    one = stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("a"))
    return one.select("digest", "a.shard", "a.offset", "a.length")


META = "digest string, shard string, offset long, length long, width int, height int, bits int"
FEATURES = META + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"


def _ranges(fs: pyarrow.fs.FileSystem, path: str):
    """Reads so many bytes at an offset of a shard; the shard of the last read stays open."""
    name, file = None, None

    def read(shard: str, offset: int, size: int) -> bytes:
        nonlocal name, file
        if shard != name:
            if file:
                file.close()
            name, file = shard, fs.open_input_file(f"{path}/{shard}")
        file.seek(offset)
        return file.read(size)

    return read


def _described(read, batch: pa.RecordBatch) -> tuple[list, list[pa.Array]]:
    """What the first bytes of payloads say, by range reads of those bytes only; and as columns."""
    heads = [png_header(read(shard, offset, HEADER)) for shard, offset in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
    return heads, [pa.array([h[i] for h in heads], pa.int32()) for i in range(3)]


def _headers(folder: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _ranges(*pyarrow.fs.FileSystem.from_uri(folder))
        for batch in rows:
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *_described(read, batch)[1]], schema=_arrow(META))

    return run


def _payloads(folder: str):
    """Header columns first, as in _headers(); then features of whole payloads, as read back."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, schema = _ranges(*pyarrow.fs.FileSystem.from_uri(folder)), _arrow(FEATURES)
        for batch in rows:
            heads, described = _described(read, batch)
            out: list[tuple] = []
            for (width, height, *_), digest, shard, offset, length in zip(heads, *(c.to_pylist() for c in batch.columns[:4]), strict=True):
                data = read(shard, offset, length)
                payload = decode_png(data)
                sha = hashlib.sha256(payload).hexdigest()
                if sha != digest or len(payload) != width * height:
                    raise ValueError(f"{shard} at {offset}: the payload is not what its digest or header says")
                out.append((len(payload), sha, zlib.crc32(payload[-16:]), hashlib.sha256(data).hexdigest(), feature(payload, width)))
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *described, *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[7:], strict=True))], schema=schema)

    return run


def _by_shard(places: DataFrame) -> DataFrame:
    """Readers take stretches of shards in order of offset; a shard is of bounded size."""
    n = max(2, int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return places.repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset").select("digest", "shard", "offset", "length")


def metadata(places: DataFrame, folder: str) -> DataFrame:
    """Width, height and bits of each address by range reads of headers only."""
    return _by_shard(places).mapInArrow(_headers(folder), META)


def features(places: DataFrame, folder: str) -> DataFrame:
    """The same columns from headers, and features of the payloads as read back, in one worker."""
    return _by_shard(places).mapInArrow(_payloads(folder), FEATURES)


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text", with_features: bool = True) -> DataFrame:
    """Every row with its digest, address and media columns."""
    stored, folder = store(df, key, text)
    places = addresses(stored)
    columns = (features if with_features else metadata)(places, folder)
    return stored.select("doc_id", "n_bytes", "digest").join(columns, "digest")
