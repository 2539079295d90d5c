"""Compound files, as older office programs write them: a bounded reader of the published container format, and the text
properties of messages kept in one."""

from __future__ import annotations

import struct

SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
END, FREE = 0xFFFFFFFE, 0xFFFFFFFF

#: Text properties of a message by their number, in the order in which they are shown.
PROPERTIES = {"0037": "Subject", "0C1A": "From", "0E04": "To", "0E03": "Cc", "1000": "Body"}


def streams(data: bytes, most_streams: int = 512, most_bytes: int = 8 << 20) -> dict[str, bytes]:
    """Streams of a compound file by path. ValueError if it is none, or is broken; beyond the bounds, streams are left out."""
    if len(data) < 512 or data[:8] != SIGNATURE:
        raise ValueError("not a compound file")
    sector, short = 1 << struct.unpack("<H", data[30:32])[0], 1 << struct.unpack("<H", data[32:34])[0]
    first_directory, cutoff, first_short, _, first_more = struct.unpack("<I4xIIII", data[48:72])
    table = lambda raw: struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])

    def block(n: int) -> bytes:
        raw = data[(n + 1) * sector : (n + 2) * sector]
        if not raw:
            raise ValueError("a sector lies beyond the file")
        return raw

    lists, more = list(table(data[76:512])), first_more
    for _ in range(len(data) // sector + 1):
        if more in (END, FREE):
            break
        *entries, more = table(block(more))
        lists += entries
    follow = [x for n in lists if n not in (END, FREE) for x in table(block(n))]

    def chain(n: int, after, read, size: int) -> bytes:
        out, steps = [], 0
        while n < END and size > sum(map(len, out)):
            steps += 1
            if n >= len(after) or steps > len(after):
                raise ValueError("a broken chain of sectors")
            out.append(read(n))
            n = after[n]
        return b"".join(out)[:size]

    whole = 1 << 62
    directory = chain(first_directory, follow, block, whole)
    entries = [directory[i : i + 128] for i in range(0, len(directory) - 127, 128)]
    if not entries:
        raise ValueError("no directory")
    root_start, root_size = struct.unpack("<II", entries[0][116:124])
    mini = chain(root_start, follow, block, root_size) if root_size else b""
    follow_short = table(chain(first_short, follow, block, whole)) if first_short < END else ()

    out: dict[str, bytes] = {}
    todo, seen, total = [(struct.unpack("<I", entries[0][76:80])[0], "")], set(), 0
    while todo and len(out) < most_streams:
        n, above = todo.pop()
        if n >= len(entries) or n in seen:
            continue
        seen.add(n)
        e = entries[n]
        left, right, child, start, size = struct.unpack("<III", e[68:80]) + struct.unpack("<II", e[116:124])
        name = above + e[: max(0, struct.unpack("<H", e[64:66])[0] - 2)].decode("utf-16-le", "replace")
        todo += [(left, above), (right, above)]
        if e[66] == 1:
            todo.append((child, name + "/"))
        elif e[66] == 2 and total + size <= most_bytes:
            total += size
            out[name] = chain(start, follow_short, lambda k: mini[k * short : (k + 1) * short], size) if size < cutoff else chain(start, follow, block, size)
    return out


def message_text(data: bytes) -> str:
    """Subject, sender, recipients and body of a message: Unicode properties, else 8-bit ones."""
    held = streams(data)
    lines = []
    for number, label in PROPERTIES.items():
        wide, narrow = held.get(f"__substg1.0_{number}001F"), held.get(f"__substg1.0_{number}001E")
        value = wide.decode("utf-16-le", "replace") if wide else narrow.decode("cp1252", "replace") if narrow else ""
        if value.strip("\0 \r\n"):
            lines.append(value.strip("\0") if label == "Body" else f"{label}: {value.strip(chr(0))}")
    return "\n".join(lines)
