"""Results out of the engine: tables of runs, JSON and CSV exports, reports with a manifest, and backups that can be verified.
Tables are written by the tasks; what the driver writes is a page of a report or a manifest, both of bounded size."""

from __future__ import annotations

import hashlib
import html
import json

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a report's section that are shown.
SHOWN = 200


def save_run(df: DataFrame, path: str, run: str) -> None:
    """Replace one run's partition of a table of runs; other runs stay."""
    rows = df.withColumn("run_id", F.lit(run))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_run(spark: SparkSession, path: str, run: str) -> DataFrame:
    """One run's rows; the partition is pruned."""
    return spark.read.parquet(path).filter(F.col("run_id") == run).drop("run_id")


def replace(df: DataFrame, path: str) -> DataFrame:
    """Write a derived table anew and read it back. Not onto a path that df itself reads."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_json(df: DataFrame, path: str, without: tuple[str, ...] = ()) -> None:
    """A JSON object a line; columns such as the content can be left out."""
    df.drop(*without).write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def section(title: str, df: DataFrame, order: list) -> dict:
    """The first rows of a section, with the number of all."""
    shown = [[None if v is None else str(v) for v in r] for r in df.orderBy(*order).limit(SHOWN).collect()]
    return {"title": title, "columns": df.columns, "rows": shown, "total": df.count()}


def report_html(title: str, sections: list[dict]) -> str:
    """A page without scripts; all values are escaped."""
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for s in sections:
        head = "".join(f"<th>{html.escape(c)}</th>" for c in s["columns"])
        body = "".join("<tr>" + "".join(f"<td>{html.escape(v or '')}</td>" for v in r) + "</tr>" for r in s["rows"])
        out.append(f"<h2>{html.escape(s['title'])} ({s['total']})</h2><table><tr>{head}</tr>{body}</table>")
    return "".join(out) + "</body></html>"


def fingerprint(title: str, sections: list[dict]) -> str:
    """SHA-256 of the canonical JSON: equal reports have equal fingerprints."""
    return hashlib.sha256(json.dumps({"title": title, "sections": sections}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _put(fs: pyarrow.fs.FileSystem, path: str, data: bytes) -> dict:
    """Written beside and moved, so a reader sees the whole file or none."""
    with fs.open_output_stream(path + ".part") as out:
        out.write(data)
    fs.move(path + ".part", path)
    return {"name": path.rpartition("/")[2], "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}


def write_report(title: str, sections: list[dict], uri: str) -> dict:
    """report.json, report.html and manifest.json with sizes and digests; returns the manifest."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    content = json.dumps({"title": title, "sections": sections}, sort_keys=True, ensure_ascii=False).encode()
    files = [_put(fs, f"{path}/report.json", content), _put(fs, f"{path}/report.html", report_html(title, sections).encode())]
    manifest = {"title": title, "fingerprint": fingerprint(title, sections), "files": files}
    _put(fs, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True).encode())
    return manifest


def verify_report(uri: str) -> list[str]:
    """Names of files that are gone or are not what the manifest says."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(f"{path}/manifest.json") as f:
        manifest = json.loads(f.read())
    bad = []
    for entry in manifest["files"]:
        try:
            with fs.open_input_stream(f"{path}/{entry['name']}") as f:
                if hashlib.sha256(f.read()).hexdigest() != entry["sha256"]:
                    bad.append(entry["name"])
        except FileNotFoundError:
            bad.append(entry["name"])
    return bad


def _sums(df: DataFrame) -> DataFrame:
    """Rows and an order-free checksum of all their values."""
    value = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.lit(0).cast("long")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(value), F.lit(0)).alias("checksum"))


def backup(tables: dict[str, DataFrame], path: str) -> None:
    """Copy tables to a folder, with a table of their rows and checksums."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    sums = [(name, *_sums(df).first()) for name, df in tables.items()]  # a row a table
    spark.createDataFrame(sums, "name string, n long, checksum long").coalesce(1).write.mode("overwrite").parquet(f"{path}/_sums")


def verify_backup(spark: SparkSession, path: str) -> DataFrame:
    """(name, n, ok) a table of a backup, read again."""
    known = spark.read.parquet(f"{path}/_sums").collect()  # a row a table
    found = [(r.name, *_sums(spark.read.parquet(f"{path}/{r.name}")).first(), r.n, r.checksum) for r in known]
    return spark.createDataFrame([(name, n, n == m and c == k) for name, n, c, m, k in found], "name string, n long, ok boolean")


def restore(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of a verified backup; ValueError if it is not what was saved."""
    if not verify_backup(spark, path).filter((F.col("name") == name) & F.col("ok")).count():
        raise ValueError(f"{name}: the backup is not what was saved")
    return spark.read.parquet(f"{path}/{name}")
