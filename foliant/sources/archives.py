"""Archives as tables: formats by name and first bytes, members of ZIP and TAR containers and of single compressed streams, with
bounds on what is looked at, and nested archives to a depth. Nothing is unpacked to disk."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Formats by suffix (the first that fits), and by first bytes.
SUFFIXES = {".tar.gz": "TAR_GZ", ".tgz": "TAR_GZ", ".tar.bz2": "TAR_BZ2", ".tbz2": "TAR_BZ2", ".tar.xz": "TAR_XZ", ".txz": "TAR_XZ", ".zip": "ZIP", ".tar": "TAR", ".gz": "GZ", ".bz2": "BZ2", ".xz": "XZ", ".7z": "SEVENZIP", ".rar": "RAR"}
MAGIC = {b"PK\x03\x04": "ZIP", b"PK\x05\x06": "ZIP", b"PK\x07\x08": "ZIP", b"7z\xbc\xaf\x27\x1c": "SEVENZIP", b"Rar!\x1a\x07": "RAR", b"\x1f\x8b": "GZ", b"BZh": "BZ2", b"\xfd7zXZ\x00": "XZ"}
#: What a stream's first bytes say may be a TAR inside, if the name says so.
INSIDE = {"GZ": "TAR_GZ", "BZ2": "TAR_BZ2", "XZ": "TAR_XZ"}


@dataclass(frozen=True)
class Limits:
    members: int = 10_000
    member_bytes: int = 256 << 20
    total_bytes: int = 2 << 30
    ratio: float = 200.0
    depth: int = 3


class Limit(Exception):
    """A bound was reached; the message is the status."""


def format_of(path: str, head: bytes) -> tuple[str, str | None]:
    """(format, status) from a name and the first bytes. TAR has no mark at its start; the others do, and a name that says
    otherwise than the bytes is a status, not an error."""
    named = next((f for s, f in SUFFIXES.items() if path.lower().endswith(s)), None)
    marked = next((f for m, f in MAGIC.items() if head.startswith(m)), None)
    if marked is None:
        return (named or "UNKNOWN"), ("NOT_ARCHIVE_FORMAT" if named not in (None, "TAR") else None)
    if named in (marked, INSIDE.get(marked)):
        return named, None
    return marked, ("EXTENSION_MISMATCH" if named else None)


def format_column(path: Column, head: Column) -> Column:
    """The same as a column (format, status), in the JVM. head: the first eight bytes."""
    low, shown = F.lower(path), F.hex(head)
    named, marked = F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix, f in reversed(SUFFIXES.items()):
        named = F.when(F.endswith(low, F.lit(suffix)), f).otherwise(named)
    for mark, f in reversed(MAGIC.items()):
        marked = F.when(F.startswith(shown, F.lit(mark.hex().upper())), f).otherwise(marked)
    inside = F.when(marked == "GZ", "TAR_GZ").when(marked == "BZ2", "TAR_BZ2").when(marked == "XZ", "TAR_XZ")
    fits = F.coalesce((named == marked) | (named == inside), F.lit(False))
    kind = F.when(marked.isNull(), F.coalesce(named, F.lit("UNKNOWN"))).when(fits, named).otherwise(marked)
    status = F.when(marked.isNull() & named.isNotNull() & (named != "TAR"), "NOT_ARCHIVE_FORMAT").when(marked.isNotNull() & named.isNotNull() & ~fits, "EXTENSION_MISMATCH")
    return F.struct(kind.alias("format"), status.alias("status"))


def safe_name(name: str) -> str | None:
    """A member's path inside its archive, or None if it could lead out of it."""
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
    bad = not name or "\0" in name or name[0] in "/\\" or (len(name) > 1 and name[1] == ":" and name[0].isalpha()) or ".." in parts
    return None if bad or not "/".join(parts).strip() else "/".join(parts)


class _Budget:
    """What one archive and all that is nested in it may hold."""

    def __init__(self, limits: Limits):
        self.limits, self.members, self.bytes = limits, 0, 0

    def count(self, size: int, packed: int) -> None:
        self.members += 1
        self.bytes += size
        over = (
            ("LIMIT_MEMBER_SIZE", size > self.limits.member_bytes), ("LIMIT_MEMBER_COUNT", self.members > self.limits.members), ("LIMIT_TOTAL_SIZE", self.bytes > self.limits.total_bytes),
            ("LIMIT_COMPRESSION_RATIO", packed > 0 and size > 1 << 20 and size / packed > self.limits.ratio),
        )
        for status, yes in over:
            if yes:
                raise Limit(status)


def _zip(data: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for i in z.infolist():
            folder, secret = i.is_dir(), bool(i.flag_bits & 1)
            read = (lambda i=i: z.open(i).read()) if not folder and not secret else None
            yield {"name": i.filename, "kind": "DIR" if folder else "FILE", "size": 0 if folder else i.file_size, "packed": 0 if folder else i.compress_size, "crc": f"{i.CRC:08x}" if i.CRC else None, "secret": secret, "read": read}


def _tar(data: bytes) -> Iterator[dict]:
    kinds = (("FILE", "isfile"), ("DIR", "isdir"), ("SYMLINK", "issym"), ("HARDLINK", "islnk"), ("FIFO", "isfifo"), ("DEVICE", "isdev"))
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for i in t:
            kind = next((k for k, test in kinds if getattr(i, test)()), "OTHER")
            read = (lambda i=i: t.extractfile(i).read()) if kind == "FILE" else None
            yield {"name": i.name, "kind": kind, "size": i.size if kind == "FILE" else 0, "packed": 0, "crc": None, "secret": False, "read": read}


_OPENERS = {"GZ": gzip.GzipFile, "BZ2": bz2.BZ2File, "XZ": lzma.LZMAFile}


def _stream(path: str, data: bytes, kind: str, limits: Limits) -> Iterator[dict]:
    """A single compressed file: its one member is named as the archive without the last suffix; read up to the bound."""
    name = path.rpartition("/")[2].rpartition("/")[2].rpartition(".")[0] or "content"
    with _OPENERS[kind](io.BytesIO(data)) as f:
        content = f.read(limits.member_bytes + 1)
    yield {"name": name, "kind": "FILE", "size": len(content), "packed": len(data), "crc": f"{zlib.crc32(content):08x}", "secret": False, "read": lambda: content}


def members(path: str, data: bytes, limits: Limits = Limits(), depth: int = 1, budget: _Budget | None = None, content: bool = False) -> tuple[list[dict], str]:
    """(members, status). Never raises: what is wrong is the status, with the members before it. Members with an archive's name are
    listed too, to the depth; their path follows `!/`. content: with the bytes of files."""
    kind, status = format_of(path, data[:8])
    if depth > limits.depth:
        return [], "LIMIT_DEPTH"
    if status or kind in ("UNKNOWN", "SEVENZIP", "RAR"):
        return [], status or ("UNSUPPORTED_FORMAT" if kind == "UNKNOWN" else "BACKEND_UNAVAILABLE")
    budget = budget or _Budget(limits)
    source = _zip(data) if kind == "ZIP" else _tar(data) if kind.startswith("TAR") else _stream(path, data, kind, limits)
    out: list[dict] = []
    try:
        for m in source:
            if (name := safe_name(m["name"])) is None:
                continue
            budget.count(m["size"], m["packed"])
            inner = m["read"] is not None and any(name.lower().endswith(s) for s in SUFFIXES)
            raw = m["read"]() if m["read"] is not None and (content or inner) else None
            out.append({"path": f"{path}!/{name}", "member": name, "kind": m["kind"], "size": m["size"], "packed": m["packed"], "crc": m["crc"], "encrypted": m["secret"], "depth": depth, "content": raw if content else None})
            if inner:
                below, said = members(f"{path}!/{name}", raw, limits, depth + 1, budget, content)
                out += below
                if said.startswith("LIMIT_") and said != "LIMIT_DEPTH":
                    return out, said
    except Limit as e:
        return out, str(e)
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, ValueError, zlib.error, lzma.LZMAError, NotImplementedError):
        return out, "CORRUPT_ARCHIVE"
    plain = [m for m in out if m["kind"] == "FILE"]
    return out, "PASSWORD_REQUIRED" if plain and all(m["encrypted"] for m in plain) else "OK"


MEMBERS = "archive string, status string, path string, member string, kind string, size long, packed long, crc string, encrypted boolean, depth int, content binary"


_SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[k]) for n, k in (c.split() for c in MEMBERS.split(", "))])


def list_archives(df: DataFrame, path: str = "path", data: str = "content", limits: Limits = Limits(), content: bool = False) -> DataFrame:
    """A row a member; an archive without members, or that cannot be listed, is a row with its status alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # an archive at a time is held
                found, status = members(p, raw.as_py() or b"", limits, content=content)
                yield pa.RecordBatch.from_pylist([{"archive": p, "status": status, **m} for m in found] or [{"archive": p, "status": status}], _SCHEMA)

    return df.select(path, data).mapInArrow(run, MEMBERS)


def indexed(archives: DataFrame, known: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Members of archives (path, content, fingerprint) whose fingerprint is not among the known ones (path, fingerprint)."""
    return list_archives(archives.join(known, ["path", "fingerprint"], "left_anti"), limits=limits)
