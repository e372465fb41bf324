"""Files of other kinds: partitioned Parquet, CSV, JSON lines, qrels, digests, manifests."""

from __future__ import annotations

import html
import io
import itertools
import json
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Zstandard Parquet in one directory per value, each value spread over tasks by the rows' hash."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def zstd_lines(spark: SparkSession, path: str, batch: int = 10_000) -> DataFrame:
    """``value``: the lines of all Zstandard files under a path, unpacked in pieces where each file is read."""
    packed = spark.read.format("binaryFile").option("pathGlobFilter", "*.zst").option("recursiveFileLookup", "true").load(path).select("content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        for b in batches:
            for content in b["content"]:
                lines = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True), encoding="utf-8", errors="replace")
                while some := list(itertools.islice(lines, batch)):
                    yield pd.DataFrame({"value": [x.rstrip("\n") for x in some]})

    return packed.mapInPandas(unpack, "value string")


def read_json_lines(spark: SparkSession, path: str, schema: str, kind: str | None = None, key: list[str] | None = None, zstd: bool = False) -> DataFrame:
    """JSON lines, gzip by name or ``zstd``; only rows of type ``kind``, each ``key`` once, with the least of its rows."""
    rows = zstd_lines(spark, path).select(F.from_json("value", schema).alias("r")).select("r.*") if zstd else spark.read.json(path, schema=schema)
    if kind:
        rows = rows.where(F.col("type") == kind)
    if not key:
        return rows
    rest = [c for c in rows.columns if c not in key]
    least = rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("least")) if rest else rows.distinct()
    return least.select(*[F.col(c) if c in key else F.col(f"least.{c}") for c in rows.columns])


def qrels_lines(judged: DataFrame) -> DataFrame:
    """Lines "query 0 document grade" per split and locale."""
    return judged.select("split", "locale", F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("0"), "doc_id", F.col("grade").cast("string")).alias("line"))


def write_qrels(judged: DataFrame, path: str) -> None:
    """The lines as text, sorted within files, in a folder for each split and locale."""
    judged = judged.repartitionByRange("split", "locale", "query_id").sortWithinPartitions("split", "locale", "query_id", "doc_id")
    qrels_lines(judged).write.mode("overwrite").partitionBy("split", "locale").text(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of every file under a path, computed where the file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "length")


def verify(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """``name`` and ``problem`` of each file under a path that differs from ``expected`` (``name``, ``sha256``), is missing or is not expected."""
    both = digests(spark, path).join(expected.select("name", F.col("sha256").alias("wanted")), "name", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("wanted").isNull(), "not expected").when(F.col("sha256") != F.col("wanted"), "differs")
    return both.select("name", problem.alias("problem")).where("problem IS NOT NULL")


def write_report(df: DataFrame, path: str, title: str, most: int = 1000) -> str:
    """A small table as JSON lines, Markdown or HTML by the ending of ``path``, written by Spark's file system; returns the text.

    A report is of at most ``most`` rows; more are an error, as they would not be read.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cells = [["" if v is None else str(v) for v in r] for r in rows]
    if path.endswith(".md"):
        clean = [[c.replace("|", "\\|").replace("\n", " ") for c in r] for r in cells]
        text = "\n".join([f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *["| " + " | ".join(r) + " |" for r in clean]])
    elif path.endswith(".html"):
        row = lambda tag, r: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in r) + "</tr>"
        text = f"<h1>{html.escape(title)}</h1>\n<table>\n" + "\n".join([row("th", df.columns), *[row("td", r) for r in cells]]) + "\n</table>"
    else:
        text = "\n".join(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str) for r in rows)
    jvm = df.sparkSession.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray((text + "\n").encode()))
    out.close()
    return text


def manifest(df: DataFrame, stage: str, *measures: Column) -> DataFrame:
    """One row with the stage's name, its rows and the given aggregates."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *measures).select(F.lit(stage).alias("stage"), "*")


def write_stage(df: DataFrame, path: str, stage: str) -> dict:
    """Writes a stage as Zstandard Parquet; returns its rows (counted while writing), bytes, seconds and rows a second."""
    began, seen = time.time(), Observation(stage)
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("compression", "zstd").parquet(path)
    jvm = df.sparkSession.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    took = time.time() - began
    return {"stage": stage, "rows": seen.get["rows"], "bytes": size, "seconds": round(took, 3), "rows_per_second": round(seen.get["rows"] / took, 1)}
