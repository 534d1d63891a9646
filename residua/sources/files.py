"""JSON data sets, reference sets, checksums and report sinks."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.operators.curation import sanitized

RECORD = "id string, sequence string, description string, organism string, label int, is_toxic int, is_antigen int, is_allergen int"


def read_records(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """(id, sequence, label, is_flagged, is_dropped) of a JSON list of records, sanitised.

    The label is the first of label, is_toxic, is_antigen and is_allergen that is
    given. Every record gives one row, whatever its id; those with a null sequence are left out.
    """
    raw = spark.read.schema(RECORD).json(path, multiLine=multiline)
    label = F.coalesce("label", "is_toxic", "is_antigen", "is_allergen")
    clean = sanitized(raw.select("id", "sequence", label.alias("label")), ["id", "label"], "sequence")
    return clean.select("id", F.col("sanitized_sequence").alias("sequence"), "label", "is_flagged", "is_dropped")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def table_hash(df: DataFrame, key: str) -> str:
    """Digest of a table that does not depend on its order: rows are hashed, the hashes summed in two halves."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    half = lambda i: F.sum(F.conv(F.substring(row, i, 12), 16, 10).cast("decimal(20,0)"))
    first, second, n = df.select(*df.columns).agg(half(1).alias("a"), half(13).alias("b"), F.count(key).alias("n")).first()
    return f"{n}-{int(first or 0):x}-{int(second or 0):x}"


def export(df: DataFrame, path: str, formats: tuple[str, ...] = ("csv", "json"), top: int = 200) -> list[str]:
    """Write a flat table as csv, json, parquet or html; the html report has the first ``top`` rows."""
    base = path.rsplit(".", 1)[0] if path.rsplit(".", 1)[-1] in ("csv", "json", "html", "parquet") else path
    out = []
    for kind in formats:
        target = f"{base}.{kind}"
        if kind == "csv":
            df.write.mode("overwrite").option("header", True).csv(target)
        elif kind == "json":
            df.write.mode("overwrite").json(target)
        elif kind == "parquet":
            df.write.mode("overwrite").parquet(target)
        elif kind == "html":
            page = report(df, top)
            df.sparkSession.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(target)
        else:
            raise ValueError(f"unknown format {kind}")
        out.append(target)
    return out


def report(df: DataFrame, top: int = 200) -> str:
    """A page with the number of rows and a table of the first ``top``; all values are escaped."""
    rows = df.limit(top).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!doctype html><html><body><p>{df.count()} rows</p><table><tr>{head}</tr>{body}</table></body></html>"


def append_log(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines, with the time they were written."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)
