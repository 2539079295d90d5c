"""Queries over files as bytes: every document is put into a container and read back by the source's reader."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.sources import archives, compound, containers, markup
from foliant.plans.queries import query, table


def stored(spark, d, suffix: str, make: Callable[[int, str], bytes], name: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, path, content): a file a row of a table."""

    @F.pandas_udf("binary")
    def pack(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([make(int(i), t if isinstance(t, str) else "") for i, t in zip(ids, texts, strict=True)], dtype=object)

    rows = table(spark, d, name).select(F.col(key).alias("id"), F.col(text).alias("t"))
    return rows.select("id", F.concat(F.lit("/f/"), F.col("id").cast("string"), F.lit(suffix)).alias("path"), pack("id", "t").alias("content"))


def read_back(files: DataFrame) -> DataFrame:
    """(id, text)"""
    return markup.extracted(files).select(F.regexp_extract("path", r"/f/([0-9]+)\.", 1).cast("long").alias("id"), "text")


def _lines(text: str) -> list[str]:
    return text.split("\n")


_LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')"


@query(f"SELECT doc_id AS id, array_to_string({_LINES}, chr(10)) AS text FROM documents")
def a12_docx_text(spark, d):
    """Paragraphs of word-processor files; a line of a document is one."""
    return read_back(stored(spark, d, ".docx", lambda i, t: containers.docx(_lines(t))))


@query(f"SELECT doc_id AS id, array_to_string(list_concat(['Sheet: Data'], list_filter(list_transform(({_LINES})[1:1000], lambda x: array_to_string(list_filter(string_split(x, ' '), lambda w: w <> '')[1:50], chr(9))), lambda x: x <> '')), chr(10)) AS text FROM documents WHERE length(text) < 20000")
def a14_sheet_text(spark, d):
    """Cells of sheets, a line a row and a word a cell: the first 1,000 rows and 50 columns. Texts of under 20,000 characters, as
    longer ones reach the bound on cells, which a test holds."""
    files = stored(spark, d, ".xlsx", lambda i, t: containers.xlsx([[w for w in x.split(" ") if w] for x in _lines(t) if x.strip(" \t\r")]))
    short = table(spark, d, "documents").filter(F.length("text") < 20000).select(F.col("doc_id").alias("id"))
    return read_back(files.join(short, "id", "left_semi"))


@query(f"SELECT doc_id AS id, array_to_string(list_transform({_LINES}, lambda x: 'Slide: ' || x), chr(10)) AS text FROM documents")
def a15_slide_text(spark, d):
    """Slides in the order of their numbers."""
    return read_back(stored(spark, d, ".pptx", lambda i, t: containers.pptx([x for x in _lines(t) if x.strip(" \t\r")])))


@query(f"SELECT doc_id AS id, array_to_string(list_transform({_LINES}, lambda x: trim(x, ' ' || chr(9) || chr(13))), chr(10)) AS text FROM documents")
def a16_odt_text(spark, d):
    return read_back(stored(spark, d, ".odt", lambda i, t: containers.odt(_lines(t))))


@query("SELECT page_id AS id, 'T' || page_id AS title, 'A' AS creator, 2 AS sections FROM pages")
def a17_book_parts(spark, d):
    """Title, creator and pages of books."""
    files = stored(spark, d, ".epub", lambda i, t: containers.epub(f"T{i}", "A", [f"one {i}", "two"]), "pages", "page_id", "url")

    @F.pandas_udf("title string, creator string, sections int")
    def parts(raw: pd.Series) -> pd.DataFrame:
        import io
        import zipfile

        found = [markup.epub_parts(zipfile.ZipFile(io.BytesIO(bytes(x)))) for x in raw]
        return pd.DataFrame([{k: f[k] for k in ("title", "creator", "sections")} for f in found], columns=["title", "creator", "sections"])

    return files.select("id", parts("content").alias("p")).select("id", "p.*")


@query("SELECT page_id AS id, 'Subject: S' || page_id || chr(10) || 'From: a@b.example' || chr(10) || chr(10) || url || chr(10) || chr(10) || 'inner' AS text, 1 AS attachments, 1 AS nested FROM pages")
def a21_message_parts(spark, d):
    """Headers, the body of every level, and attachments of messages, of which only name and size are read."""
    inner = containers.message("Inner", "c@d.example", "inner")
    files = stored(spark, d, ".eml", lambda i, t: containers.message(f"S{i}", "a@b.example", t, [("x.bin", b"0123")], inner), "pages", "page_id", "url")

    @F.pandas_udf("text string, attachments int, nested int")
    def parts(raw: pd.Series) -> pd.DataFrame:
        found = [markup.email_parts(bytes(x)) for x in raw]
        lines = ["\n".join(x.rstrip("\r") for x in f["text"].split("\n")).replace("\n\n\n", "\n\n") for f in found]
        return pd.DataFrame({"text": lines, "attachments": [len(f["attachments"]) for f in found], "nested": [f["nested"] for f in found]})

    return files.select("id", parts("content").alias("p")).select("id", "p.*")


@query("SELECT doc_id AS id, length(text) AS chars, CASE WHEN doc_id % 3 = 1 THEN 'latin-1' ELSE 'utf-8' END AS encoding FROM (SELECT doc_id, 'é' || coalesce(lang, '') AS text FROM documents)")
def a25_plain_text(spark, d):
    """Text by the first encoding that fits."""
    files = stored(spark, d, ".txt", lambda i, t: ("é" + t).encode("latin-1" if i % 3 == 1 else "utf-8"), text="lang")

    @F.pandas_udf("chars long, encoding string")
    def read(raw: pd.Series) -> pd.DataFrame:
        found = [markup.plain_text(bytes(x)) for x in raw]
        return pd.DataFrame({"chars": [len(t) for t, _ in found], "encoding": [e for _, e in found]})

    return files.select("id", read("content").alias("p")).select("id", "p.*")


@query("SELECT page_id AS id, 'id | url' || chr(10) || page_id || ' | ' || url AS text FROM pages")
def a27_csv_text(spark, d):
    return read_back(stored(spark, d, ".csv", lambda i, t: f"id;url\r\n{i};{t}\r\n;\r\n".encode(), "pages", "page_id", "url"))


@query("SELECT event_id AS id, 'id: ' || event_id || chr(10) || 'tags:' || chr(10) || '  [0]: a' || chr(10) || '  [1]:' || chr(10) || '    k: ' || (json_extract_string(props, '$.k')) AS text FROM events")
def a28_json_text(spark, d):
    """JSON as indented lines (a28, a29)."""
    return read_back(stored(spark, d, ".json", lambda i, t: json.dumps({"id": i, "tags": ["a", json.loads(t)]}).encode(), "events", "event_id", "props"))


@query(r"SELECT doc_id AS id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('# T' || doc_id || chr(10) || '**' || coalesce(lang, '') || '** `x` [l](http://e)', '(?s)```.*?```', '', 'g'), '`[^`]+`', '', 'g'), '#+\s*', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[*_]{1,2}([^*_]+)[*_]{1,2}', '\1', 'g'), ' ' || chr(10)) AS text FROM documents")
def a30_markdown_text(spark, d):
    return read_back(stored(spark, d, ".md", lambda i, t: f"# T{i}\n**{t}** `x` [l](http://e)".encode(), text="lang"))


_KINDS = {0: (".zip", "ZIP", None), 1: (".tar.gz", "TAR_GZ", None), 2: (".zip", "GZ", "EXTENSION_MISMATCH"), 3: (".7z", "SEVENZIP", "NOT_ARCHIVE_FORMAT"), 4: (".txt", "UNKNOWN", None), 5: (".tar", "TAR", None)}


def _archive(i: int, text: str) -> bytes:
    import gzip

    entries = [("folder/page.txt", text.encode()), ("../evil.txt", b"x"), (f"n{i}.txt", b"12345")]
    kind = i % 6
    if kind == 0:
        return containers.zipped([*entries, ("inner.zip", containers.zipped([("deep.txt", b"deep")]))])
    if kind in (1, 5):
        return containers.tarred(entries, "w:gz" if kind == 1 else "w")
    return gzip.compress(text.encode(), mtime=0) if kind == 2 else b"nothing known"


def _archives(spark, d) -> DataFrame:
    """Files of six kinds that are, or claim to be, archives."""
    rows = stored(spark, d, "", _archive, "pages", "page_id", "url")
    suffix = F.element_at(F.array(*[F.lit(s) for s, _, _ in _KINDS.values()]), (F.col("id") % 6 + 1).cast("int"))
    return rows.withColumn("path", F.concat("path", suffix))


def _pick(i: int) -> str:
    return "CASE page_id % 6 " + " ".join(f"WHEN {k} THEN {'NULL' if v[i] is None else repr(v[i])}" for k, v in _KINDS.items()) + " END"


@query(f"SELECT page_id AS id, {_pick(1)} AS format, {_pick(2)} AS status FROM pages")
def a38_archive_format(spark, d):
    """Format by name and first bytes, in the JVM."""
    rows = _archives(spark, d).select("id", archives.format_column(F.col("path"), F.substring("content", 1, 8)).alias("f"))
    return rows.select("id", "f.format", "f.status")


_MEMBERS = """members AS (SELECT page_id AS id, m AS member, CASE m WHEN 'folder/page.txt' THEN length(encode(url)) WHEN 'inner.zip' THEN -1 WHEN 'deep.txt' THEN 4 ELSE 5 END AS size, CASE WHEN m = 'deep.txt' THEN 2 ELSE 1 END AS depth, page_id % 6 AS k
  FROM (SELECT page_id, url, unnest(CASE WHEN page_id % 6 = 0 THEN ['folder/page.txt', 'n' || page_id || '.txt', 'inner.zip', 'deep.txt'] WHEN page_id % 6 IN (1, 5) THEN ['folder/page.txt', 'n' || page_id || '.txt'] ELSE [] END) AS m FROM pages))""".replace("length(encode(url))", "octet_length(encode(url))")


def _listed(spark, d, **options):
    rows = archives.list_archives(_archives(spark, d), **options)
    return rows.withColumn("id", F.regexp_extract("archive", r"/f/([0-9]+)\.", 1).cast("long"))


@query(f"WITH {_MEMBERS} SELECT id, member, CASE WHEN size >= 0 THEN size END AS size, depth FROM members")
def a39_archive_members(spark, d):
    """Members of ZIP and TAR containers, nested ones too; names that lead out of the archive are left out (a39 to a41, a49)."""
    rows = _listed(spark, d).filter("member is not null")
    return rows.select("id", "member", F.when(~F.endswith("member", F.lit(".zip")), F.col("size")).alias("size"), "depth")


@query("SELECT page_id AS id, CASE WHEN page_id % 6 IN (0, 1, 5) THEN 'OK' WHEN page_id % 6 = 2 THEN 'EXTENSION_MISMATCH' WHEN page_id % 6 = 3 THEN 'NOT_ARCHIVE_FORMAT' ELSE 'UNSUPPORTED_FORMAT' END AS status FROM pages")
def a40_archive_status(spark, d):
    """What became of listing each archive; never an error."""
    return _listed(spark, d).groupBy("id").agg(F.max("status").alias("status"))


@query(f"WITH {_MEMBERS} SELECT id, member, CASE WHEN member = 'folder/page.txt' THEN sha256(url) WHEN member = 'deep.txt' THEN sha256('deep') ELSE sha256('12345') END AS digest FROM members JOIN pages ON page_id = id WHERE member <> 'inner.zip'")
def a44_member_content(spark, d):
    """Members' bytes, within the bounds (a44), by their digest (j30 of members)."""
    rows = _listed(spark, d, content=True).filter("member is not null and kind = 'FILE' and not endswith(member, '.zip')")
    return rows.select("id", "member", F.sha2("content", 256).alias("digest"))


@query("SELECT page_id AS id, CASE WHEN page_id % 6 = 0 OR page_id % 6 IN (1, 5) THEN 'LIMIT_MEMBER_COUNT' WHEN page_id % 6 = 2 THEN 'EXTENSION_MISMATCH' WHEN page_id % 6 = 3 THEN 'NOT_ARCHIVE_FORMAT' ELSE 'UNSUPPORTED_FORMAT' END AS status FROM pages")
def a45_member_budget(spark, d):
    """Statuses under a bound of one member."""
    return _listed(spark, d, limits=archives.Limits(members=1)).groupBy("id").agg(F.max("status").alias("status"))


@query(f"WITH {_MEMBERS} SELECT id, count(*) AS members FROM members WHERE id % 4 <> 0 GROUP BY 1")
def a49_indexed_archives(spark, d):
    """Only archives whose fingerprint is new are listed; that of every fourth is known."""
    rows = _archives(spark, d).withColumn("fingerprint", F.concat_ws(":", F.octet_length("content").cast("string"), F.sha1("content")))
    found = archives.indexed(rows, rows.filter("id % 4 = 0").select("path", "fingerprint"))
    found = found.filter("member is not null").withColumn("id", F.regexp_extract("archive", r"/f/([0-9]+)\.", 1).cast("long"))
    return found.groupBy("id").agg(F.count("*").alias("members"))


@query(f"SELECT doc_id AS id, array_to_string(CASE WHEN doc_id % 2 = 0 THEN {_LINES} ELSE list_transform({_LINES}, lambda x: trim(x, ' ' || chr(9) || chr(13))) END, chr(10)) AS text FROM documents")
def a11_office_dispatch(spark, d):
    """Office files of two kinds, each by its reader."""
    files = stored(spark, d, ".x", lambda i, t: containers.odt(_lines(t)) if i % 2 else containers.docx(_lines(t)))
    return read_back(files.withColumn("path", F.concat(F.lit("/f/"), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, ".docx").otherwise(".odt"))))


@query("SELECT page_id AS id, 'one & ' || page_id || ' ' || url AS text FROM pages")
def a13_broken_docx(spark, d):
    """A body that does not parse is read by its text elements alone."""
    body = lambda i, t: f"<w:document><w:p><w:t>one &amp; {i}</w:t><w:t xml:space='x'>{containers.xml(t)}</w:t>".encode()
    return read_back(stored(spark, d, ".docx", lambda i, t: containers.zipped([("word/document.xml", body(i, t))]), "pages", "page_id", "url"))


@query("SELECT page_id AS id, 'Subject: S' || page_id || chr(10) || 'From: a' || chr(10) || url AS text FROM pages")
def a22_compound_messages(spark, d):
    """Messages in compound files (a20, a22, a23): Unicode properties, else 8-bit ones."""
    make = lambda i, t: containers.compound([("__substg1.0_0037001F", f"S{i}".encode("utf-16-le")), ("__substg1.0_0C1A001E", b"a"), ("__substg1.0_1000001F", t.encode("utf-16-le"))])
    return read_back(stored(spark, d, ".msg", make, "pages", "page_id", "url"))


@query("SELECT page_id AS id, page_id * 10 % 4000 AS size FROM pages")
def a23_compound_streams(spark, d):
    """Streams of compound files within bounds: what the one that fits holds."""

    @F.pandas_udf("long")
    def held(raw: pd.Series) -> pd.Series:
        return pd.Series([len(compound.streams(bytes(x), most_bytes=6000)["a"].rstrip(b"\0")) for x in raw], dtype="int64")

    files = stored(spark, d, ".bin", lambda i, t: containers.compound([("a", b"x" * (i * 10 % 4000)), ("b", b"y" * 4000)]), "pages", "page_id", "url")
    return files.select("id", held("content").alias("size"))


@query("SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN NULL ELSE 'a b' END AS text, CASE WHEN page_id % 3 = 1 THEN 'BadZipFile' END AS error FROM pages")
def a34_extraction(spark, d):
    """Files of several kinds by the reader of their extension (a26, a34); a broken one is a row with its error."""
    files = stored(spark, d, "", lambda i, t: t.encode() if i % 3 != 2 else b"<p>a <b>b</b></p>", "pages", "page_id", "url")
    end = F.when(F.col("id") % 3 == 0, ".txt").when(F.col("id") % 3 == 1, ".docx").otherwise(".html")
    found = markup.extracted(files.withColumn("path", F.concat("path", end)))
    return found.select(F.regexp_extract("path", r"/f/([0-9]+)\.", 1).cast("long").alias("id"), "text", "error")


@query("SELECT event_id AS id, '[0]:' || chr(10) || '  a:' || chr(10) || '    b: ' || event_id || chr(10) || '[1]: ' || event_type AS text FROM events")
def a29_nested_json(spark, d):
    return read_back(stored(spark, d, ".json", lambda i, t: json.dumps([{"a": {"b": i}}, t]).encode(), "events", "event_id", "event_type"))


@query("SELECT page_id AS id, unnest(['a.txt', 'b/c.txt']) AS member, unnest([octet_length(encode(url)), 3]) AS size FROM pages")
def a41_tar_members(spark, d):
    """Members of compressed TAR archives of three kinds."""
    make = lambda i, t: containers.tarred([("a.txt", t.encode()), ("b/c.txt", b"xyz"), ("/abs", b"no")], ("w:gz", "w:bz2", "w:xz")[i % 3])
    files = stored(spark, d, "", make, "pages", "page_id", "url")
    end = F.when(F.col("id") % 3 == 0, ".tar.gz").when(F.col("id") % 3 == 1, ".tbz2").otherwise(".tar.xz")
    found = archives.list_archives(files.withColumn("path", F.concat("path", end)))
    return found.select(F.regexp_extract("archive", r"/f/([0-9]+)\.", 1).cast("long").alias("id"), "member", "size")
