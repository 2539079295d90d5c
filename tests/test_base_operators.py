"""Operators whose queries have no SQL, and general forms of others, against brute force on small fixtures."""

import random
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import entities
from foliant.operators import families, graph, scratch, search, store, vectors
from foliant.plans.queries import QUERIES, SQL
from foliant.sources import archives, compound, containers, markup


def test_degree_cap_is_the_greedy_one(spark):
    rng = random.Random(1)
    edges = sorted({(a, b) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(160)) if a < b})
    rows = [(a, b, rng.randrange(6)) for a, b in edges]
    df = spark.createDataFrame(rows, "a long, b long, s long")
    for most in (1, 3, 50):
        degree, want = [0] * 25, set()
        for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
            if degree[a] < most and degree[b] < most:
                degree[a] += 1
                degree[b] += 1
                want.add((a, b, s))
        got = store.capped_degree(df, "a", "b", [-F.col("s"), F.col("a"), F.col("b")], most)
        assert {tuple(r) for r in got.collect()} == want
    assert store.capped_degree(df.limit(0), "a", "b", [-F.col("s"), F.col("a"), F.col("b")], 2).count() == 0


def test_merge_clears_what_changed(spark):
    have = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", None, "z")], "path string, size int, text string")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("c", None), ("d", 4)], "path string, size int")
    got = {r["path"]: (r["size"], r["text"]) for r in store.merged(have, new, "path", ["size"], "text").collect()}
    assert got == {"a": (1, "x"), "b": (3, None), "c": (None, "z"), "d": (4, None)}


def test_places_in_order(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(9), i) for i in range(500)]
    got = scratch.in_order(spark.createDataFrame(rows, "a long, b long").repartition(5), [F.col("a"), F.col("b")]).collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["place"])] == sorted(rows) and [r["place"] for r in sorted(got, key=lambda r: r["place"])] == list(range(500))
    assert scratch.in_order(spark.createDataFrame([], "a long"), [F.col("a")]).count() == 0


def test_neighbours_and_reach(spark):
    rows = [(i, i % 3 if i % 7 else None, -i) for i in range(60)]
    got = graph.neighbours(spark.createDataFrame(rows, "id long, g long, o long"), ["g"], "id", [F.col("o")], 4).collect()
    want = set()
    for i, g, _ in rows:
        if g is not None:
            others = [j for j, h, _ in sorted(rows, key=lambda r: r[2]) if h == g and j != i]
            want |= {(i, j) for j in others[:4]}
    assert {(r["src"], r["dst"]) for r in got} == want and len(got) == len(want)
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (3, 4), (2, 0)], "a long, b long")
    start = spark.createDataFrame([(0,)], "id long")
    assert {tuple(r) for r in graph.reached(edges, start, 2, 9).collect()} == {(0, 0), (1, 1), (2, 1), (3, 2)}
    assert {tuple(r) for r in graph.reached(edges, start, 2, 2).collect()} == {(0, 0), (1, 1)}


def test_components_run_to_the_end(spark):
    """A path of 200 nodes, far longer than any fixed number of steps would take one by one."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["id"]: r["component"] for r in graph.components(edges).collect()}
    assert set(got.values()) == {0, 500} and sum(v == 0 for v in got.values()) == 201


VECTORS = np.random.default_rng(4).normal(size=(60, 8)).round(3)


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, i % 4, [float(x) for x in v]) for i, v in enumerate(VECTORS)]
    return spark.createDataFrame(rows, "id long, c int, v array<double>").repartition(3).cache()


def unit():
    return VECTORS / np.linalg.norm(VECTORS, axis=1, keepdims=True)


def test_silhouette(points):
    near = 1 - unit() @ unit().T
    labels = np.arange(60) % 4
    want = {}
    for i in range(60):
        mean = {c: near[i][(labels == c) & (np.arange(60) != i)].mean() for c in range(4)}
        a, b = mean[labels[i]], min(v for c, v in mean.items() if c != labels[i])
        want[i] = (b - a) / max(a, b)
    got = {r["id"]: r["score"] for r in vectors.silhouette(points, "id", "c", "v").collect()}
    assert got == pytest.approx(want)


def test_principal(points):
    for centred in (True, False):
        x = VECTORS - VECTORS.mean(0) * centred
        _, _, vt = np.linalg.svd(x, full_matrices=False)
        top = vt[:2] * np.sign(vt[:2][np.arange(2), np.abs(vt[:2]).argmax(1)])[:, None]
        got = {r["id"]: r["coordinates"] for r in vectors.principal(points, "id", "v", 8, 2, centred).collect()}
        assert np.allclose([got[i] for i in range(60)], x @ top.T)


def test_nearest_of_all(points, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 10)
    near = np.round(unit() @ unit().T, 5)
    want = {(i, j) for i in range(60) for j in sorted((j for j in range(60) if j != i), key=lambda j: (-near[i, j], j))[:5]}
    assert {(r["id"], r["other"]) for r in vectors.nearest_of_all(points, "id", "v", 8, 5).collect()} == want
    few = points.filter("id % 5 = 0")
    want = {(i, j) for i in range(60) for j in sorted((j for j in range(0, 60, 5) if j != i), key=lambda j: (-near[i, j], j))[:3]}
    assert {(r["id"], r["other"]) for r in vectors.nearest_of_all(points, "id", "v", 8, 3, few).collect()} == want


def test_assign_by_blocks(spark, points, monkeypatch):
    centres = vectors.centroids(points, "c", "v")
    want = {r["id"]: r["near"] for r in vectors.assign(points, centres, "id", "v", "c").collect()}
    monkeypatch.setattr(vectors, "CENTRE_BYTES", 0)
    assert {r["id"]: r["near"] for r in vectors.assign(points, centres, "id", "v", "c").collect()} == want and len(want) == 60


def test_percentiles_and_lookup(spark, monkeypatch):
    from foliant.operators import relational

    rng = random.Random(8)
    rows = [(rng.choice("aab"), rng.randrange(50)) for _ in range(300)] + [("c", 4), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {r["g"]: (r["n"], r["p50"], r["p99"]) for r in relational.percentile_by_index(df, "g", "v", {"p50": 0.5, "p99": 0.99}).collect()}
    for g in "abc":
        values = sorted(v for h, v in rows if h == g)
        assert got[g] == (len(values), *(values[min(int(len(values) * p), len(values) - 1)] for p in (0.5, 0.99)))
    table = spark.createDataFrame([("a", 1), ("b", 2)], "g string, x int")
    want = sorted((*r, {"a": 1, "b": 2}[r[0]]) for r in rows if r[0] in "ab")
    for most in (10, 0):
        monkeypatch.setattr(relational, "BROADCAST_ROWS", most)
        assert sorted(tuple(r) for r in relational.looked_up(df, table, "g").select("g", "v", "x").collect()) == want


def test_dbscan(points):
    near = np.round(unit() @ unit().T, 5) >= 1 - 0.3
    core = near.sum(1) >= 4
    label = {i: i for i in range(60) if core[i]}
    for _ in range(60):
        for i in label:
            label[i] = min(label[j] for j in label if near[i, j])
    for i in range(60):
        if not core[i]:
            label[i] = min((label[j] for j in range(60) if core[j] and near[i, j]), default=None)
    got = {r["id"]: r["cluster"] for r in vectors.dbscan(points, "id", "v", 8, 0.3, 4).collect()}
    assert got == label and len(set(label.values())) > 1


def test_chosen_k(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(8)[:4]
    rows = [(i, [float(x) for x in centres[i % 4] + rng.normal(0, 0.05, 8)]) for i in range(80)]
    found = vectors.chosen_k(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", (2, 3, 4, 6))
    assert found[0][0] == 4 and {k for k, _, _ in found} == {2, 3, 4, 6} and found[0][1] > 0.8


def test_simhash_pairs_fold_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    near = [*base[:299], "changed"]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, " ".join(f"z{i}" for i in range(300))), (5, None), (6, "a b")]
    got = families.simhash_pairs(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()
    assert {(r["src"], r["dst"]) for r in got} <= {(1, 3)} and all(r["lexical"] > 0.9 for r in got)


def test_saved_index(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("one two three four five".split()) for _ in range(rng.randrange(12)))) for i in range(80)] + [(80, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    search.save_index(docs, str(tmp_path / "index"), buckets=8)
    held = search.open_index(spark, str(tmp_path / "index"), buckets=8)
    for terms in (["one"], ["one", "four"], ["absent"], ["two", "two"]):
        saved = {tuple(r) for r in search.search_index(spark, held, terms).collect()}
        assert saved == {tuple(r) for r in search.bm25(docs, terms).collect()}


def test_fusion_keeps_one_of_each(spark):
    ranked = lambda *ids: spark.createDataFrame([(i, p) for p, i in enumerate(ids, 1)], "id long, place int")
    exact = spark.createDataFrame([(9,)], "id long")
    digests = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, digest string")
    got = [r["id"] for r in search.fused(ranked(1, 2, 9), ranked(2, 3), "id", exact, digests).orderBy("place").collect()]
    assert got == [9, 2, 3]


def test_entities(spark):
    text = "Dr. Jean Dupont met Muster GmbH in Paris on 2024-05-06, see https://x.org/a). It cost EUR 12 000."
    got = {(r["entity_type"], r["normalized"]) for r in entities.entities(spark.createDataFrame([(1, text), (2, None)], "id long, t string"), "id", "t").collect()}
    assert got == {("PERSON", "jean dupont"), ("ORGANIZATION", "muster gmbh"), ("LOCATION", "paris"), ("DATE", "2024-05-06"), ("URL", "https://x.org/a"), ("MONEY", "EUR12000")}


def test_office_bounds_and_faults():
    broken = containers.zipped([("word/document.xml", b"<w:document><w:t>one</w:t><w:t xml:space='x'>two &amp; three</w:t>")])
    assert markup.extract("x.docx", broken) == ("one two & three", None)
    wide = containers.xlsx([[str(i) for i in range(60)]] * 1100)
    lines = markup.extract("x.xlsx", wide)[0].split("\n")
    assert lines[0] == "Sheet: Data" and lines[1].split("\t") == [str(i) for i in range(50)] and len(lines) == 1 + 201  # 10,000 cells are passed in row 201
    assert len(markup.extract("x.xlsx", containers.xlsx([["a"]] * 1100))[0].split("\n")) == 1001
    assert markup.extract("x.pptx", containers.pptx([f"s{i}" for i in range(1, 12)]))[0].split("\n")[9:] == ["Slide: s10", "Slide: s11"]
    assert markup.extract("x.csv", b"a;b\n1;2\n;\n") == ("a | b\n1 | 2", None)
    assert markup.extract("x.json", b'{"a": {"b": []}, "c": [1]}')[0] == "a:\n  b:\n\nc:\n  [0]: 1" and markup.extract("x.json", b"{no")[0] == "{no"
    assert markup.extract("x.xml", b"<a> x <b>y</b></a>")[0] == "x\ny"
    assert markup.extract("x.md", b"# H\n```\ncode\n```\n*a* [l](u) `c`")[0] == "H\n\na l"
    assert markup.extract("x.epub", b"nothing") == (None, "BadZipFile")


def test_nested_archives():
    inner = containers.tarred([("deep.txt", b"deep")], "w:gz")
    outer = containers.zipped([("a.txt", b"a"), ("sub/in.tar.gz", inner), ("../x", b"no")])
    found, status = archives.members("f.zip", outer, content=True)
    assert status == "OK" and [(m["path"], m["depth"], m["content"]) for m in found if m["kind"] == "FILE" and m["member"].endswith(".txt")] == [("f.zip!/a.txt", 1, b"a"), ("f.zip!/sub/in.tar.gz!/deep.txt", 2, b"deep")]
    assert archives.members("f.zip", outer, archives.Limits(depth=1))[1] == "OK" and len(archives.members("f.zip", outer, archives.Limits(depth=1))[0]) == 2
    assert archives.members("f.zip", outer, archives.Limits(member_bytes=0))[1] == "LIMIT_MEMBER_SIZE"
    assert archives.members("f.zip", outer, archives.Limits(total_bytes=1))[1] == "LIMIT_TOTAL_SIZE"
    bomb = containers.zipped([("b", b"\0" * (3 << 20))])
    assert archives.members("b.zip", bomb)[1] == "LIMIT_COMPRESSION_RATIO"
    assert archives.members("b.zip", outer[:60])[1] == "CORRUPT_ARCHIVE" and archives.members("b.zip", b"x")[1] == "NOT_ARCHIVE_FORMAT"
    import bz2
    import lzma

    for name, data in (("n.txt.bz2", bz2.compress(b"x" * 9)), ("n.txt.xz", lzma.compress(b"x" * 9))):
        assert [(m["member"], m["size"]) for m in archives.members(name, data)[0]] == [("n.txt", 9)]
    assert archives.members("n.xz", lzma.compress(b"x" * 9)[:20])[1] == "CORRUPT_ARCHIVE"


def test_compound_messages():
    data = containers.compound([("__substg1.0_0037001F", "Hello".encode("utf-16-le")), ("__substg1.0_1000001E", b"the body")])
    assert sorted(compound.streams(data)) == ["__substg1.0_0037001F", "__substg1.0_1000001E"]
    assert markup.extract("m.msg", data)[0].split("\n")[0] == "Subject: Hello" and "the body" in markup.extract("m.msg", data)[0]
    assert markup.extract("m.msg", b"no") == (None, "ValueError") and compound.streams(data, most_bytes=5000).keys() <= compound.streams(data).keys()
    loop = bytearray(data)
    loop[-512 + 64 : -512 + 68] = struct.pack("<I", 16)  # the directory's sector follows itself
    with pytest.raises(ValueError):
        compound.streams(bytes(loop))


def test_sinks(spark, tmp_path):
    from foliant.sources import sinks

    rows = spark.createDataFrame([(i, f"n{i}<b>") for i in range(9)], "id long, name string")
    path = str(tmp_path / "runs")
    for run, n in (("a", 9), ("b", 2), ("a", 4)):
        sinks.save_run(rows.limit(n), path, run)
    assert [sinks.read_run(spark, path, r).count() for r in "ab"] == [4, 2]
    uri = f"file://{tmp_path}/report"
    parts = [sinks.section("S<1>", rows, ["id"])]
    manifest = sinks.write_report("T&", parts, uri)
    page = (tmp_path / "report" / "report.html").read_text()
    assert "n0&lt;b&gt;" in page and "S&lt;1&gt; (9)" in page and "T&amp;" in page and sinks.verify_report(uri) == []
    assert manifest["fingerprint"] == sinks.write_report("T&", [sinks.section("S<1>", rows.repartition(3), ["id"])], uri)["fingerprint"]
    (tmp_path / "report" / "report.json").write_text("{}")
    assert sinks.verify_report(uri) == ["report.json"]
    sinks.backup({"rows": rows, "none": rows.limit(0)}, str(tmp_path / "backup"))
    assert {r.name: (r.n, r.ok) for r in sinks.verify_backup(spark, str(tmp_path / "backup")).collect()} == {"rows": (9, True), "none": (0, True)}
    rows.limit(8).write.mode("overwrite").parquet(str(tmp_path / "backup" / "rows"))
    with pytest.raises(ValueError):
        sinks.restore(spark, str(tmp_path / "backup"), "rows")
    assert sinks.restore(spark, str(tmp_path / "backup"), "none").count() == 0


def test_parameters():
    from foliant.functions import validation as v

    v.SearchParameters("x", 1)
    v.SemanticParameters("x", 5, 0.0)
    for wrong in (lambda: v.SearchParameters("  "), lambda: v.SearchParameters("x" * 1001), lambda: v.SearchParameters(limit=0), lambda: v.SearchParameters(limit=10_001), lambda: v.SearchParameters(text_weight=1.1), lambda: v.SemanticParameters("x", threshold=-0.1)):
        with pytest.raises(ValueError):
            wrong()
    assert v.described_scope("prefix", prefix="/home/a/b/", limit=None) == {"kind": "prefix", "prefix": "<redacted>/b"}


def test_jobs(spark, tmp_path):
    from foliant import cli

    tables = "/root/testdata/sf0.001"
    if not __import__("os").path.isdir(tables):
        pytest.skip("no test tables")
    for mode in ("lexical", "semantic", "rerank"):
        got = cli.searched(spark, tables, '"of the" re', mode, 5, 2)
        assert got.columns == ["id", "score"] and 0 < got.count() <= 5
    counts = cli.built(spark, tables, "hashes", str(tmp_path))
    assert list(counts) == ["hashes", "duplicates", "near_duplicates"] and counts["hashes"] > 0


def test_scratch_is_released(spark):
    held = scratch.cut(spark.range(5))
    assert held.count() == 5
    from foliant.plans import queries

    queries._indexes.clear()
    scratch.release(spark)
    with pytest.raises(Exception):
        spark.read.parquet(scratch.folder(spark))
    assert scratch.cut(spark.range(3)).count() == 3


def test_resumable_job(spark, tmp_path):
    from foliant.streaming import jobs

    source, stop = tmp_path / "in", tmp_path / "stop"
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.mode("append").parquet(str(source))
    seen = []

    def work(rows):
        seen.append(rows.count())
        if len(seen) == 1:
            stop.write_text("")
        return rows.withColumn("double", F.col("id") * 2)

    go = lambda: jobs.run(spark, str(source), "id long", work, str(tmp_path / "out"), str(tmp_path / "checkpoint"), str(stop))
    assert not go() and spark.read.parquet(str(tmp_path / "out")).count() == 10
    stop.unlink()
    assert go() and sorted(r["double"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2 * i for i in range(30)]
    assert go() and seen == [10, 10, 10]


def test_large_lookups_broadcast_only_frequent_keys(spark, monkeypatch):
    """100,000 terms are shuffled, as the driver holds what is broadcast; with fewer places, keys of either kind are found once."""
    from foliant.operators import relational

    many = spark.range(100_000).select(F.col("id").cast("string").alias("g"), F.col("id").alias("x"))
    plan = relational.looked_up(many.select("g"), many, "g")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan
    rows = [("often", i) for i in range(500)] + [(f"g{i % 90}", i) for i in range(300)] + [("long" * 50, i) for i in range(200)] + [(None, 0), ("absent", 1)]
    df = spark.createDataFrame(rows, "g string, v int")
    names = {g: i for i, g in enumerate(sorted({g for g, _ in rows if g and g != "absent"}))}
    counts = {g: sum(h == g for h, _ in rows) for g in names}
    table = spark.createDataFrame([(g, x, counts[g]) for g, x in names.items()], "g string, x int, n int")
    want = sorted((g, v, names[g]) for g, v in rows if g in names)
    monkeypatch.setattr(relational, "BROADCAST_ROWS", 10)
    assert [r.g for r in relational.frequent(table, "g", "n")[0].collect()] == ["often"] and relational.frequent(table, "g", "n")[1] == 200
    for count in (None, "n"):
        assert sorted(tuple(r) for r in relational.looked_up(df, table, "g", count).select("g", "v", "x").collect()) == want


@pytest.mark.parametrize("most", [0, 30, 3000])
def test_tfidf_with_few_places(spark, monkeypatch, most):
    """The queries against their SQL with none, few and many terms broadcast."""
    from foliant.operators import relational

    db = duckdb.connect()
    db.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    monkeypatch.setattr(relational, "BROADCAST_ROWS", most)
    for name in ("j12_tfidf", "j13_class_tfidf"):
        want = db.sql(SQL[name]).fetchall()
        assert sorted(map(tuple, QUERIES[name](spark, "/root/testdata/sf0.001").collect())) == sorted(want) and want
