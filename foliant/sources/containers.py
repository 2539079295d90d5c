"""Text into containers: office documents, books, messages and archives, as bytes. The smallest files of each kind that programs
read; used for exports and to hold the readers against."""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile
from collections.abc import Sequence
from email.message import EmailMessage
from xml.sax.saxutils import escape

from foliant.sources.compound import SIGNATURE


_CONTROL = {c: " " for c in (*range(9), 11, 12, *range(14, 32))}


def xml(text: str) -> str:
    """Escaped, with control characters, which XML has no form for, as blanks."""
    return escape(text.translate(_CONTROL))


def zipped(entries: Sequence[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def tarred(entries: Sequence[tuple[str, bytes]], mode: str = "w") -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def docx(lines: Sequence[str]) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{xml(x)}</w:t></w:r></w:p>' for x in lines)
    return zipped([("word/document.xml", f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>'.encode())])


def xlsx(rows: Sequence[Sequence[str]], name: str = "Data") -> bytes:
    cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{xml(x)}</t></is></c>' for x in row) + "</row>" for row in rows)
    return zipped([("xl/workbook.xml", f'<workbook><sheets><sheet name="{xml(name)}"/></sheets></workbook>'.encode()), ("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{cells}</sheetData></worksheet>".encode())])


def pptx(slides: Sequence[str]) -> bytes:
    return zipped([(f"ppt/slides/slide{i}.xml", f'<p:sld xmlns:p="p" xmlns:a="a"><a:t>{xml(x)}</a:t></p:sld>'.encode()) for i, x in enumerate(slides, 1)])


def odt(lines: Sequence[str]) -> bytes:
    body = "".join(f"<text:p>{xml(x)}</text:p>" for x in lines)
    return zipped([("content.xml", f'<office:d xmlns:office="o" xmlns:text="t">{body}</office:d>'.encode())])


def epub(title: str, creator: str, chapters: Sequence[str]) -> bytes:
    package = f"<package><dc:title>{xml(title)}</dc:title><dc:creator>{xml(creator)}</dc:creator></package>"
    return zipped([("book.opf", package.encode()), *((f"c{i:04d}.xhtml", f"<html><body><p>{xml(x)}</p></body></html>".encode()) for i, x in enumerate(chapters))])


def message(subject: str, sender: str, body: str, attachments: Sequence[tuple[str, bytes]] = (), inner: bytes | None = None) -> bytes:
    out = EmailMessage()
    out["Subject"], out["From"] = subject, sender
    out.set_content(body, cte="base64")
    for name, data in attachments:
        out.add_attachment(data, "application", "octet-stream", filename=name)
    if inner is not None:
        import email
        import email.policy

        part = EmailMessage()
        part["Content-Type"] = "message/rfc822"
        part.set_payload([email.message_from_bytes(inner, policy=email.policy.default)])
        if out.get_content_subtype() != "mixed":
            out.make_mixed()
        out.attach(part)
    return out.as_bytes()


def compound(entries: Sequence[tuple[str, bytes]]) -> bytes:
    """A compound file of a few streams, each at least 4,096 bytes so that all lie in regular sectors; up to some sixty kilobytes."""
    sectors, names = [], [("Root Entry", 5, 0xFFFFFFFE, 0)]
    for name, data in entries:
        data = data.ljust(4096, b"\0")
        names.append((name, 2, len(sectors), len(data)))
        sectors += [data[i : i + 512] for i in range(0, len(data), 512)]
    directory = b""
    for i, (name, kind, start, size) in enumerate(names):
        raw = name.encode("utf-16-le")
        right = i + 1 if 0 < i < len(names) - 1 else 0xFFFFFFFF
        child = 1 if i == 0 and len(names) > 1 else 0xFFFFFFFF
        directory += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, 0xFFFFFFFF, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)
    directory = directory.ljust(-(-len(directory) // 512) * 512, b"\0")
    first = len(sectors)
    sectors += [directory[i : i + 512] for i in range(0, len(directory), 512)]
    follow = [0xFFFFFFFF] * 128
    for _, kind, start, size in names:
        if kind == 2:
            for k in range(size // 512):
                follow[start + k] = start + k + 1 if k < size // 512 - 1 else 0xFFFFFFFE
    for k in range(first, len(sectors)):
        follow[k] = k + 1 if k < len(sectors) - 1 else 0xFFFFFFFE
    fat = len(sectors)
    follow[fat] = 0xFFFFFFFD
    sectors.append(struct.pack("<128I", *follow))
    head = SIGNATURE + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, 1, first, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", fat, *[0xFFFFFFFF] * 108) + b"".join(sectors)
