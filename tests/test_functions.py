import datetime
import hashlib
import io
import random
import time
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import names, scores
from foliant.functions import text as t
from foliant.operators import families, graph, relational, search, vectors
from foliant.plans.queries import QUERIES, SQL
from foliant.sources import archives, markup
from foliant.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


VERSIONS = [
    ("rapport_v2.txt", ("number", "2"), "rapport"), ("budget (1).xlsx", ("number", "1"), "budget"), ("rapport_final.doc", None, "rapport"), ("notes.txt", None, "notes"),
    ("plan 2023-05-07.pdf", ("date", "2023-05-07"), "plan"), ("07.05.2023 plan_v3.pdf", ("date", "2023-05-07"), "07 05 2023 plan"), ("plan_07-05-2023_v3.pdf", ("date", "2023-05-07"), "plan"),
    ("data.tar.gz", None, "data"), ("x final v2 (3) copy.md", ("number", "3"), "x"), ("12345.txt", None, ""), ("a" + "1234567890" * 6 + "b.txt", None, "a" + "1234567890" * 6 + "b"), ("Résumé REV. 12.docx", ("number", "12"), "résumé"),
]


@pytest.mark.parametrize(("name", "marker", "stem"), VERSIONS)
def test_versions(spark, name, marker, stem):
    found = one(spark, names.version_marker(F.lit(name)))
    assert (found and (found["kind"], found["value"])) == marker
    assert one(spark, names.version_stem(F.lit(name))) == stem


def test_names(spark):
    assert [one(spark, names.safe_member(F.lit(x))) for x in ("a/b", "./a//b", "a\\b", "/a", "C:x", "a/../b", "a\0", "", ".", " ")] == ["a/b", "a/b", "a/b", None, None, None, None, None, None, None]
    assert [archives.safe_name(x) for x in ("a/b", "./a//b", "a\\b", "/a", "C:x", "a/../b", "a\0", "", ".", " ")] == ["a/b", "a/b", "a/b", None, None, None, None, None, None, None]
    assert one(spark, names.suffix(F.lit("A.B.PDF"))) == ".pdf" and one(spark, names.suffix(F.lit(".bashrc"))) == ""
    assert one(spark, names.priority(F.lit(".zzz"), F.lit("ma Facture"))) == "critical"
    hit = lambda folder: one(spark, names.excluded_by_user(F.lit(folder), ["tmp*", "/data/raw", "*/keep?"]))
    assert [hit(x) for x in ("/x/TMP1", "/x/tmp1/y", "/data/raw/a", "/data/rawer", "/z/keep1", "/z/keep")] == [True, False, True, False, True, False]
    assert one(spark, names.header_value(F.lit("From: a\n\nTo: b"), "to")) is None
    assert one(spark, names.citations(F.lit("[D1] [E2:p4] [D1] [X3]"))) == ["D1", "E2"]


def test_personal_data(spark):
    assert one(spark, t.mask_email(F.lit("jane@x.org"))) == "j***@x.org"
    assert one(spark, t.mask_phone(F.lit("+33 6 12"))) == "***12"
    assert one(spark, t.mask_ip(F.lit("10.2.3.4"))) == "10.2.*.*"
    assert one(spark, t.iban_ok(F.lit("DE89 3704 0044 0532 0130 00")))
    assert not one(spark, t.iban_ok(F.lit("DE89 3704 0044 0532 0130 01")))
    assert one(spark, t.luhn_ok(F.lit("4111111111111111")))


def test_query_parser():
    q = search.parse_query('"exact phrase" word AND c')
    assert q.phrases == (("exact", "phrase"),) and q.prefixes == ("word", "and") and q.exact == ("c",)
    assert search.parse_query("  ") is None


def test_html_and_office():
    assert markup.html_to_text("<p>a<script>x</script></p><div> b&amp;c </div>") == "a\nb&c"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p></w:d>')
    assert markup.extract("x.docx", data.getvalue()) == ("one two", None)
    assert markup.extract("x.docx", b"no zip") == (None, "BadZipFile")
    assert "Subject: hi" in markup.extract("m.eml", b"Subject: hi\nFrom: a@b.c\n\nbody")[0]


def test_read_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.html").write_text("<p>x</p>")
    (tmp_path / "b.txt").write_bytes(b"caf\xe9")
    got = {r["path"].rpartition("/")[2]: r["text"] for r in markup.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.html": "x", "b.txt": "café"}


def test_components_and_pagerank(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (8, 9)], "a long, b long")
    assert {r[0]: r[1] for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    assert sum(r["rank"] for r in graph.pagerank(edges).collect()) == pytest.approx(1)


def test_upsert_and_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "id long, v string")
    assert sorted(map(tuple, relational.upsert(a, b, "id").collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert dict(map(tuple, relational.snapshot_diff(a, b, "id", ["v"]).collect())) == {1: "removed", 2: "changed", 3: "added"}


def test_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 10)
    rows = spark.createDataFrame([(at, "view", 1.0), (at, "view", 2.0)], "ts timestamp, event_type string, value double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.windowed_counts(events.event_stream(spark, str(tmp_path / "in"), rows.schema))
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.n, r.total) for r in spark.sql("select n, total from counts").collect()] == [(2, 3.0)]


def test_scores(spark):
    outcome = lambda x: one(spark, scores.error_outcome(F.lit(x)))
    assert [outcome(x) for x in ("Timed out", "file is encrypted", "password", "bad xref", "missing", "odd", None)] == ["TIMEOUT", "ENCRYPTED", "PASSWORD_REQUIRED", "MALFORMED", "UNSUPPORTED_DEPENDENCY", "PERMANENT_ERROR", "PERMANENT_ERROR"]
    assert [one(spark, scores.backoff_seconds(F.lit(n))) for n in (0, 1, 2, 3, 9)] == [60, 60, 300, 1500, 3600]
    assert one(spark, scores.retryable(F.lit("TIMEOUT"), F.lit(2))) and not one(spark, scores.retryable(F.lit("TIMEOUT"), F.lit(3)))
    assert one(spark, scores.iso_week(F.to_date(F.lit("2024-12-30")))) == "2025-W01"
    assert one(spark, scores.amounts(F.lit("15.000,00 EUR and 2000 Euros"))) == ["15.000,00 EUR", "2000 Euros"]


def test_simhash(spark):
    runs = ["a b c d", "b c d e", "c d e f"]
    votes = [0] * 64
    for r in runs:
        value = int.from_bytes(hashlib.blake2b(r.encode(), digest_size=8).digest(), "big")
        votes = [v + (1 if value >> i & 1 else -1) for i, v in enumerate(votes)]
    want = sum(1 << i for i, v in enumerate(votes) if v > 0)
    words = F.split(F.lit("a b c d e f"), " ")
    assert one(spark, scores.shingles(words)) == runs
    got = one(spark, scores.simhash64(scores.shingles(words)))
    assert got % (1 << 64) == want
    assert one(spark, scores.band_keys(F.lit(got))) == [want >> 16 * i & 0xFFFF for i in range(4)]
    assert one(spark, scores.hamming(F.lit(got), F.lit(got ^ 5))) == 2


def test_version_families(spark):
    rows = [(1, "/d", "plan_v2.txt"), (2, "/d", "plan_v10.txt"), (3, "/d", "plan.txt"), (4, "/d", "memo_final.txt"), (5, "/d", "memo.txt"), (6, "/e", "plan_v1.txt"), (7, "/d", "x y.txt"), (8, "/d", "x-y.txt")]
    df = spark.createDataFrame([(*r, f"2024-01-0{9 - r[0]}") for r in rows], "id long, folder string, name string, at string")
    got = {r["id"]: (r["stem"], r["confidence"], r["rank"], r["is_primary"]) for r in families.version_families(df, "folder", "name", "id", "at").collect()}
    assert got == {1: ("plan", "HIGH", 0, False), 2: ("plan", "HIGH", 1, False), 3: ("plan", "HIGH", 2, True), 4: ("memo", "MEDIUM", 1, True), 5: ("memo", "MEDIUM", 0, False), 7: ("x y", "UNORDERED", 1, True), 8: ("x y", "UNORDERED", 0, False)}
    near = spark.createDataFrame([(7, 8), (1, 7)], "src long, dst long")
    assert {r["confidence"] for r in families.version_families(df, "folder", "name", "id", "at", near).filter("stem = 'x y'").collect()} == {"MEDIUM"}


def test_kmeans(spark):
    rows = spark.createDataFrame([(i, [float(i % 2) * 9 + i / 100, 1.0]) for i in range(20)], "id long, v array<float>")
    got = {r["id"]: r["cluster"] for r in families.kmeans(rows, "id", "v", 2).collect()}
    assert len({got[i] for i in range(0, 20, 2)}) == len({got[i] for i in range(1, 20, 2)}) == 1 and got[0] != got[1]


def test_similar_pairs_are_all_found(spark, monkeypatch):
    """Pairs around the threshold, against brute force."""
    monkeypatch.setattr(vectors, "BLOCK", 20)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 64))
    v = np.concatenate([base, np.repeat(base, 5, axis=0) + rng.normal(0, 0.45, (150, 64)), np.zeros((2, 64))]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>")
    x = v.astype(float)
    lengths = np.maximum(np.linalg.norm(x, axis=1), 1e-30)
    near = (x @ x.T / lengths[:, None] / lengths).round(5)
    want = {(a, b): near[a, b] for a in range(len(v)) for b in range(a + 1, len(v)) if near[a, b] >= 0.9}
    got = {(r.a, r.b): r.similarity for r in vectors.similar_pairs(df, "id", "v", 64, 0.9).collect()}
    assert len(want) > 50 and got == pytest.approx(want)


def test_pagerank_converges(spark, tmp_path):
    """The query, on a two-sided graph of unequal sides, against the solution of the linear equations."""
    rng = np.random.default_rng(3)
    links = sorted({(int(rng.integers(3)), int(rng.integers(40))) for _ in range(90)})
    spark.createDataFrame(links, "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    arcs = {(f"s{a}", f"p{b}") for a, b in links}
    arcs |= {(b, a) for a, b in arcs}
    ids = sorted({a for a, _ in arcs})
    m = np.array([[(a, b) in arcs for a in ids] for b in ids], float)
    want = np.linalg.solve(np.eye(len(ids)) - 0.85 * m / m.sum(0), np.full(len(ids), 0.15 / len(ids)))
    got = {r.id: r["rank"] for r in QUERIES["m21_pagerank"](spark, str(tmp_path)).collect()}
    assert sum(abs(got[i] - w) for i, w in zip(ids, want, strict=True)) < 6e-4  # the tolerance times alpha / (1 - alpha)


def test_page_text_follows_the_sql(spark, tmp_path):
    """Entities without a semicolon, unclosed scripts and comments, > in quotes, other white space, pages without HTML."""
    bits = ["<!--", "-->", "<script", "</script", ">", "<style>", "</style >", "<p", "<BR/>", "<br/ >", "<li\n>", "<tr a='>'>", "&amp", "&amp;", "lt;", "&copy", "&eacute;", "&nbsp;", "\n", "\r", "\x0b", "\x0c", "\x85", " ", "a", "é", "<3", "<!x>"]
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices(bits, k=rng.randrange(30)))) for i in range(2000)] + [(2000, None), (2001, "<title>x&amp;&amp</title>"), (2002, "<script>a"), (2003, "a<!--b")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = {r.page_id: r.body for r in QUERIES["a24_html_text"](spark, str(tmp_path)).collect()}
    assert got == dict(db.sql(SQL["a24_html_text"]).fetchall())
    assert [got[i] for i in range(2000, 2004)] == [None, "x&&amp", "a", "a<!--b"]
    start = time.monotonic()
    for mark in ("<", "<!--", "<script>", "<p ", "<style"):
        markup.page_text(mark * 100_000)
    assert time.monotonic() - start < 20


def test_pagerank_needs_few_steps(spark, monkeypatch):
    """Two sides of unequal size, on which plain steps swing for dozens of rounds; a hub over several places, repeated edges and
    dangling nodes, against the solution of the linear equations."""
    rng = np.random.default_rng(7)
    arcs = {(f"s{a}", f"p{b}") for a, b in rng.integers([4, 90], size=(250, 2))}
    arcs |= {(b, a) for a, b in arcs} | {("hub", f"p{i}") for i in range(90)} | {("p1", "end"), ("s1", "s1")}
    ids = sorted({x for e in arcs for x in e})
    m = np.array([[(a, b) in arcs for a in ids] for b in ids], float)
    m = np.where(m.sum(0) > 0, m / np.maximum(m.sum(0), 1), 1 / len(ids))
    want = np.linalg.solve(np.eye(len(ids)) - 0.85 * m, np.full(len(ids), 0.15 / len(ids)))
    monkeypatch.setattr(graph, "NODE_EDGES", 20)
    got = {r.id: r["rank"] for r in graph.pagerank(spark.createDataFrame(sorted(arcs) + sorted(arcs)[:50], "a string, b string"), iterations=20).collect()}
    assert set(got) == set(ids) and sum(got.values()) == pytest.approx(1)
    assert sum(abs(got[i] - w) for i, w in zip(ids, want, strict=True)) < 6e-4
    assert graph.pagerank(spark.createDataFrame([], "a string, b string")).count() == 0
