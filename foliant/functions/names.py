"""Columns from file names, paths and extensions: types, priorities, skip rules, version stems and markers, slugs, sizes.
All stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types by extension, by the scan's rule, the quick scan's rule and the rule for archive members.
SCAN_TYPES = {
    "document": (".pdf", ".doc", ".docx", ".xlsx", ".xls", ".ppt", ".pptx", ".rtf", ".odt", ".txt"),
    "email": (".pst", ".ost", ".msg", ".eml", ".mbox"),
    "image": (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp", ".heic"),
    "video": (".mp4", ".avi", ".mov", ".wmv", ".mkv", ".flv", ".m4v"),
    "audio": (".mp3", ".wav", ".flac", ".aac", ".ogg", ".m4a"),
    "archive": (".zip", ".rar", ".7z", ".tar", ".gz", ".bz2"),
    "code": (".py", ".js", ".html", ".css", ".java", ".cpp", ".c", ".php", ".rb"),
}
QUICK_TYPES = {
    "document": (".pdf", ".doc", ".docx", ".rtf", ".txt", ".odt", ".xls", ".xlsx", ".csv", ".ppt", ".pptx"),
    "image": (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".tiff", ".webp"),
    "video": (".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm"),
    "audio": (".mp3", ".wav", ".flac", ".aac", ".ogg", ".wma"),
    "archive": (".zip", ".rar", ".7z", ".tar", ".gz", ".bz2"),
    "code": (".py", ".js", ".html", ".css", ".cpp", ".java", ".cs"),
}
MEMBER_TYPES = {
    "document": (".pdf", ".doc", ".docx", ".odt", ".rtf", ".txt", ".md", ".ods", ".xlsx", ".xls", ".csv", ".ppt", ".pptx", ".odp"),
    "image": (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp"),
    "archive": (".zip", ".7z", ".rar", ".tar", ".gz", ".tgz", ".bz2", ".xz"),
    "code": (".py", ".js", ".html", ".css", ".json", ".xml", ".yml", ".yaml", ".java", ".c", ".cpp", ".h", ".cs", ".php", ".rb", ".go", ".rs", ".ts"),
}

# Structural categories by extension.
STRUCTURE = {
    "document_pdf": (".pdf",),
    "document_office": (".doc", ".docx", ".odt", ".rtf", ".ods"),
    "spreadsheet": (".xls", ".xlsx", ".csv"),
    "presentation": (".ppt", ".pptx", ".odp"),
    "email": (".eml", ".msg", ".pst", ".ost"),
    "text": (".txt", ".md", ".rst"),
    "source_code": (".py", ".js", ".ts", ".java", ".c", ".cpp", ".h", ".cs", ".go", ".rs", ".rb", ".php", ".sql", ".sh"),
    "structured_data": (".json", ".xml", ".yaml", ".yml"),
    "archive": (".zip", ".rar", ".7z", ".tar", ".gz"),
    "image": (".jpg", ".jpeg", ".png", ".gif", ".tiff"),
    "audio": (".mp3", ".wav", ".flac", ".m4a"),
    "video": (".mp4", ".mkv", ".avi", ".mov"),
}

# Priorities by extension, words of file names that make them critical, and ranks of priorities.
PRIORITIES = {
    "critical": (".pdf", ".doc", ".docx", ".xlsx", ".xls", ".ppt", ".pptx", ".rtf", ".txt", ".odt", ".pst", ".ost", ".msg", ".eml"),
    "high": (".jpg", ".jpeg", ".png", ".tiff", ".bmp", ".mp4", ".avi", ".mov", ".wmv", ".zip", ".rar"),
}
CRITICAL_WORDS = ("contrat", "facture", "credit", "pret")
RANKS = {"critical": 0, "high": 1, "medium": 2, "low": 3}

# Extensions and folders that a scan leaves out.
SKIPPED_EXTENSIONS = (".dll", ".sys", ".exe", ".msi", ".tmp", ".log", ".cache", ".lock", ".pid", ".swp", ".~", ".lnk", ".bak", ".temp")
SKIPPED_FOLDERS = (
    "windows", "program files", "program files (x86)", "programdata", "$recycle.bin", "system volume information", "windows.old", "recovery",
    ".git", ".hg", ".svn", ".venv", "venv", "env", "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".nox",
    "dist", "build", "coverage", ".coverage", ".cache",
)

# Words that mark a version, in file names.
VERSION_WORDS = (
    "v", "ver", "version", "rev", "revision", "final", "finale", "copy", "copie", "old", "new", "backup", "sauvegarde", "draft", "brouillon", "updated",
    "modifie", "modifiée", "dernier", "last", "latest", "ancien", "origine", "original",
)
#: Those that a name may end in without a number.
END_WORDS = ("final", "finale", "copy", "copie", "old", "new", "backup", "sauvegarde", "draft", "brouillon", "updated", "modifie", "modifiée", "dernier", "last", "latest")

# Tags suggested for extensions and for words of the text, and parts of paths that are no tags.
TAG_TYPES = {
    "document": (".pdf", ".doc", ".docx"), "spreadsheet": (".xls", ".xlsx"), "presentation": (".ppt", ".pptx"), "image": (".jpg", ".png", ".gif"),
    "video": (".mp4", ".avi", ".mov"), "audio": (".mp3", ".wav"), "code": (".py", ".js", ".java"), "text": (".txt", ".md"), "archive": (".zip", ".rar"),
}
TAG_WORDS = ("report", "contract", "invoice", "receipt", "letter", "meeting", "project", "proposal", "budget", "financial", "technical", "specification", "manual", "guide", "tutorial")
NO_TAGS = ("documents", "files", "data", "src", "bin")


def by_extension(extension: Column, types: Mapping[str, Sequence[str]], other: str | None = "other") -> Column:
    low = F.lower(F.coalesce(extension, F.lit("")))
    return reduce(lambda out, kv: F.when(low.isin(*kv[1]), kv[0]).otherwise(out), reversed(types.items()), F.lit(other).cast("string"))


def by_extension_sql(extension: str, types: Mapping[str, Sequence[str]], other: str = "'other'") -> str:
    cases = " ".join(f"WHEN lower(coalesce({extension}, '')) IN ({', '.join(repr(x) for x in xs)}) THEN '{kind}'" for kind, xs in types.items())
    return f"CASE {cases} ELSE {other} END"


def priority(extension: Column, filename: Column) -> Column:
    """By extension, else critical if the file name holds a critical word, else medium."""
    named = reduce(lambda a, w: a | F.contains(F.lower(filename), F.lit(w)), CRITICAL_WORDS, F.lit(False))
    kind = by_extension(extension, PRIORITIES, None)
    return F.coalesce(kind, F.when(named, "critical").otherwise("medium"))


def priority_rank(value: Column) -> Column:
    return reduce(lambda out, kv: F.when(value == kv[0], kv[1]).otherwise(out), reversed(RANKS.items()), F.lit(4))


PRIORITY_SQL = f"coalesce({by_extension_sql('extension', PRIORITIES, 'NULL')}, CASE WHEN {' OR '.join(f'''contains(lower(filename), '{w}')''' for w in CRITICAL_WORDS)} THEN 'critical' ELSE 'medium' END)"
RANK_SQL = "CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """The last extension, lower case; empty for names without one and for those that only begin with a dot."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]+)$", 1))


def skipped_folder(path: Column) -> Column:
    """A part of the path is on the list, whatever its case, or the path is in the system's folder of temporary files."""
    parts = F.split(F.lower(path), "/")
    return F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_FOLDERS))) | F.contains(F.replace(F.lower(path), F.lit("/"), F.lit("\\")), F.lit("\\appdata\\local\\temp"))


def skipped_file(name: Column, system: bool = False) -> Column:
    hidden = F.lit(False) if system else name.startswith(".")
    return suffix(name).isin(*SKIPPED_EXTENSIONS) | hidden


def glob_pattern(pattern: str) -> str:
    """A file-name pattern as a regular expression: * and ? stop at no character."""
    out = {"*": ".*", "?": "."}
    return "^" + "".join(out.get(c, c if c.isalnum() or c == "_" else f"\\{c}") for c in pattern.lower()) + "$"


def excluded_by_user(folder: Column, patterns: Sequence[str]) -> Column:
    """A pattern without a separator holds for a folder's own name; one with a separator for the path or the subtree below it."""
    low, hit = F.lower(folder), F.lit(False)
    for p in patterns:
        if "/" in p:
            hit = hit | low.rlike(glob_pattern(p)) | (low == p.lower().rstrip("/")) | low.startswith(p.lower().rstrip("/") + "/")
        else:
            hit = hit | base_name(low).rlike(glob_pattern(p))
    return hit


def in_subtree(path: Column, root: str) -> Column:
    return (path == root) | path.startswith(root.rstrip("/") + "/")


def safe_member(name: Column) -> Column:
    """A member's path inside its archive, without empty parts and single dots; null if it is absolute, on a drive, goes up
    or holds a zero character."""
    parts = F.filter(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    bad = (name == "") | F.contains(name, F.lit("\0")) | name.rlike(r"^[/\\]") | name.rlike("^[A-Za-z]:") | F.array_contains(parts, "..") | (F.trim(F.array_join(parts, "/")) == "")
    return F.when(~bad, F.array_join(parts, "/"))


def virtual_path(parent: Column, member: Column) -> Column:
    return F.concat(parent, F.lit("!/"), member)


def crc_text(value: Column) -> Column:
    """A checksum as eight lower-case hexadecimal digits; null and zero have none."""
    return F.when(value.isNotNull() & (value != 0), F.lpad(F.lower(F.hex(value.bitwiseAND(0xFFFFFFFF))), 8, "0"))


# --- versions -------------------------------------------------------------------------------------------

_GAP, _GAP_IN, _GAP_OUT = r"[\s_\-.]*", r"[\s_\-.(\[{]*", r"[\s_\-.)\]}]*"
_YMD, _DMY = r"(20[0-9]{2})[-_.]?([0-9]{2})[-_.]?([0-9]{2})", r"([0-9]{2})[-_.]?([0-9]{2})[-_.]?(20[0-9]{2})"
_ENDINGS = (
    rf"{_GAP_IN}(?:v|ver|version|rev|revision)\.?\s*[0-9]{{1,4}}{_GAP_OUT}",
    rf"{_GAP_IN}\(\s*[0-9]{{1,4}}\s*\){_GAP_OUT}",
    rf"{_GAP_IN}(?:{'|'.join(END_WORDS)})\.?{_GAP_OUT}",
    rf"{_GAP}(?<![0-9]){_YMD}{_GAP}",
    rf"{_GAP}(?<![0-9]){_DMY}{_GAP}",
    rf"{_GAP_IN}[0-9]{{1,4}}{_GAP_OUT}",
)


def bare_name(name: Column) -> Column:
    """Without its extension; tar with a compressed ending counts as one extension."""
    return F.regexp_replace(name, r"(?i)(?:\.tar\.(?:gz|bz2|xz|zst)|\.[^.]*)$", "")


def version_stem(name: Column, rounds: int = 3) -> Column:
    """What is left of a name when version numbers, copy numbers, version words and dates at its end are taken off, again
    and again, as lower-case words. One pattern takes off any sequence of endings, each matched once (atomic groups keep long runs
    of digits linear); a few rounds take what that uncovers."""
    out = bare_name(name)
    for _ in range(rounds):
        out = F.regexp_replace(out, f"(?iu)(?>{'|'.join(_ENDINGS)})+$", "")
    return F.array_join(F.regexp_extract_all(F.lower(out), F.lit("([0-9a-zA-ZÀ-ÖØ-öø-ÿ]+)"), 1), " ")


def version_marker(name: Column) -> Column:
    """(kind, value, at): the first date by year, else the first by day, else the last number of one to four digits, else null.
    at orders markers of a kind."""
    def date(pattern: str, y: int, m: int, d: int) -> tuple[Column, Column]:
        part = lambda i: F.regexp_extract(name, f"(?<![0-9]){pattern}(?![0-9])", i)
        return part(1) != "", F.concat_ws("-", part(y), part(m), part(d))

    numbers = F.filter(F.regexp_extract_all(bare_name(name), F.lit("([0-9]+)"), 1), lambda x: F.length(x) <= 4)
    number = F.element_at(numbers, -1)
    shape = lambda kind, value, at: F.struct(F.lit(kind).alias("kind"), value.alias("value"), at.cast("long").alias("at"))
    out = F.when(F.size(numbers) > 0, shape("number", number, number))
    for has, value in (date(_DMY, 3, 2, 1), date(_YMD, 1, 2, 3)):
        out = F.when(has, shape("date", value, F.replace(value, F.lit("-"), F.lit("")))).otherwise(out)
    return out


def has_version_word(name: Column) -> Column:
    return F.lower(name).rlike(rf"(?:^|[\s_\-.(\[{{])(?:{'|'.join(VERSION_WORDS)})(?:[\s_\-.)\]}}]|$)")


def family_key(folder: Column, stem: Column) -> Column:
    return F.concat(F.lit("version:"), F.substring(F.sha1(F.concat_ws("|", F.coalesce(folder, F.lit("")), stem)), 1, 16))


def version_stem_sql(name: str, rounds: int = 4) -> str:
    """The same rules, one ending after the other, for an engine without lookbehind."""
    out = f"regexp_replace({name}, '(?i)(?:\\.tar\\.(?:gz|bz2|xz|zst)|\\.[^.]*)$', '')".replace("\\\\", "\\")
    no_digit_before = lambda date: rf"(?:[\s_\-.]+|^|([^0-9\s_\-.])){date}[\s_\-.]*$"
    for _ in range(rounds):
        for i, ending in enumerate(_ENDINGS):
            if i in (3, 4):
                plain = (_YMD, _DMY)[i - 3].replace("(20", "(?:20").replace("([0-9]", "(?:[0-9]")
                out = f"regexp_replace({out}, '{no_digit_before(plain)}', '\\1')".replace("\\\\", "\\")
            else:
                out = f"regexp_replace({out}, '(?i){ending}$', '')"
    return f"array_to_string(regexp_extract_all(lower({out}), '[0-9a-zA-ZÀ-ÖØ-öø-ÿ]+'), ' ')"


# --- names, sizes, paths, tags --------------------------------------------------------------------------


def slug(text: Column, fallback: str) -> Column:
    """Lower-case letters and digits with single hyphens, 40 at most."""
    out = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)
    return F.when(out == "", F.lit(fallback)).otherwise(out)


def human_size(size: Column) -> Column:
    """Bytes in the largest unit that leaves one at least, with one decimal beyond bytes."""
    units = ("KB", "MB", "GB", "TB", "PB")
    out = F.concat(size.cast("string"), F.lit(" B"))
    for i, unit in enumerate(units, 1):
        out = F.when(size >= 1024**i, F.concat(F.format_string("%.1f", F.bround(size / 1024.0**i, 1)), F.lit(f" {unit}"))).otherwise(out)
    return out


def size_class(size: Column) -> Column:
    """Bins in MB, open below and closed above; null at 0."""
    mb = size / 1048576
    return F.when(size <= 0, None).when(mb <= 1, "<1MB").when(mb <= 10, "1-10MB").when(mb <= 100, "10-100MB").when(mb <= 1000, "100MB-1GB").otherwise(">1GB")


def shown_path(path: Column, redact: bool) -> Column:
    """The path, or its last part only; null if there is none."""
    return F.when(path.isNotNull() & (path != ""), F.concat(F.lit("<redacted>/"), F.when(base_name(path) == "", path).otherwise(base_name(path))) if redact else path)


def suggested_tags(path: Column, text: Column, most: int = 10) -> Column:
    """Parts of the path, the kind of the extension, and words of the text that are known tags; sorted, so the cut is defined."""
    parts = F.filter(F.split(path, "/"), lambda p: (F.length(p) > 2) & ~p.startswith("."))
    clean = F.filter(F.transform(parts, lambda p: F.lower(F.replace(F.replace(p, F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" ")))), lambda p: ~p.isin(*NO_TAGS))
    kind = F.filter(F.array(by_extension(suffix(base_name(path)), TAG_TYPES, None)), lambda k: k.isNotNull())
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.array(*map(F.lit, TAG_WORDS)), lambda w: F.contains(low, w))
    return F.slice(F.array_sort(F.array_distinct(F.concat(clean, kind, words))), 1, most)


def citations(text: Column, pattern: str = r"\[([DEMVA][0-9]+)(?::p[0-9]+)?\]") -> Column:
    """Distinct citation marks in the order of their first use."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1))


def header_value(text: Column, name: str, lines: int = 40) -> Column:
    """Value of a header among the first lines, before the first blank one."""
    head = F.slice(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), 1, lines)
    blank = F.array_position(F.transform(head, lambda x: F.trim(x)), "")
    head = F.when(blank > 0, F.slice(head, F.lit(1), blank.cast("int") - 1)).otherwise(head)
    found = F.filter(head, lambda x: F.lower(x).startswith(name.lower() + ":"))
    return F.when(F.size(found) > 0, F.trim(F.substring(F.element_at(found, 1), len(name) + 2, 1 << 30)))
