from pyspark.sql import functions as F

from foliant.functions import findings, language
from foliant.operators import categories, lifecycle


LANGUAGES = [
    (None, "und", "INSUFFICIENT_TEXT"),
    ("too short", "und", "INSUFFICIENT_TEXT"),
    ("the cat was in the house and it is not on the mat", "en", "OK"),
    ("le chat est dans la maison et il ne dort pas avec nous", "fr", "OK"),
    ("der Hund ist nicht mit dem Mann auf der Straße und schläft", "de", "OK"),
    ("кот сидит на окне и смотрит на двор весь день", "ru", "OK"),
    ("これ は 日本 の 本 です それ も 本 です", "ja", "OK"),
    ("x = {a: 1}; y = [b, c]; z = (d, e); w = {f: g}; v = <h>;", "code", "CODE"),
    ("zq xxw vvk qqp wwx kkv ppz qqx", "und", "UNKNOWN"),
]


def test_language(spark):
    rows = spark.createDataFrame([(i, text) for i, (text, _, _) in enumerate(LANGUAGES)], "id long, text string")
    got = language.detect(rows).orderBy("id").collect()
    assert [(r["text"], r["lang"], r["status"]) for r in got] == LANGUAGES
    assert all(0 <= r["confidence"] <= 1 and r["lang"] not in r["mixed"] for r in got)


def test_redaction():
    assert findings.redacted(None) == ""
    assert findings.redacted("to jane@x.org, 10.2.3.4") == "to j***@x.org, 10.2.*.*"
    assert findings.redacted("DE89 3704 0044 0532 0130 00") == "DE89 **** **** 3000"
    assert findings.redacted("4111 1111 1111 1111.") == "**** **** **** 1111."
    assert findings.redacted("4111 1111 1111 1112") != "**** **** **** 1112"
    assert findings.redacted("nothing here") == "nothing here"


def test_findings(spark):
    got = findings.found("a@b.org a@b.org 4111111111111111, 300.1.1.1 10.0.0.1")
    assert [(f["kind"], f["count"]) for f in got] == [("email", 2), ("card", 1), ("ip", 1)]
    assert findings.found("a@b.org", "s")[0]["fingerprint"] != findings.found("a@b.org")[0]["fingerprint"]
    rows = spark.createDataFrame([(1, "a@b.org"), (2, None)], "id long, text string")
    assert [(r["id"], len(r["f"])) for r in rows.select("id", findings.find()("text").alias("f")).orderBy("id").collect()] == [(1, 1), (2, 0)]
    assert [r["t"] for r in rows.orderBy("id").select(findings.redact("text").alias("t")).collect()] == ["a***@b.org", ""]


def test_categories(spark):
    rows = spark.createDataFrame([(1, "Machine learning on a server"), (2, ""), (3, None)], "id long, text string")
    got = categories.by_keywords(rows, "id", "text", {"tech": ["machine learning", "server"], "law": ["court"]}).collect()
    assert [tuple(r) for r in got] == [(1, "tech", 1.0)]


def test_lifecycle(spark):
    known = spark.createDataFrame([(1, None, "ACTIVE"), (2, 1, "ACTIVE"), (3, 2, "ACTIVE"), (4, None, "MISSING")], "id long, up long, state string")
    seen = spark.createDataFrame([(2,), (3,), (4,), (4,)], "id long")
    assert dict(lifecycle.reconciled(known, seen, "id", "up").select("id", "state").collect()) == {1: "MISSING", 2: "MISSING", 3: "MISSING", 4: "ACTIVE"}
    assert dict(lifecycle.reconciled(known, seen, "id").select("id", "state").collect()) == {1: "MISSING", 2: "ACTIVE", 3: "ACTIVE", 4: "ACTIVE"}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert sorted(r["id"] for r in lifecycle.membership(ids(1, 2, 2), ids(2), ids(5, 5), "id").collect()) == [1, 5]
    assert spark.range(1).select(lifecycle.thread_key(F.lit(""), F.lit("m")).alias("x")).first()["x"].startswith("thread:")
