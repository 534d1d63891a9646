"""Settings from JSON files, and stamps that say where a table came from."""

from __future__ import annotations

import json
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua import __version__
from residua.sources.files import table_hash


@cache
def read_config(path: str) -> dict:
    """Content of a JSON file, read once; an empty dict where there is none or it is not JSON."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}


def flattened(config: object, before: str = "") -> list[tuple[str, str | None]]:
    """(dotted name, value as text) of every leaf; places of lists are numbers."""
    if isinstance(config, dict):
        items = config.items()
    elif isinstance(config, list):
        items = enumerate(config)
    else:
        return [(before, None if config is None else config if isinstance(config, str) else json.dumps(config))]
    return [leaf for key, value in items for leaf in flattened(value, f"{before}.{key}" if before else str(key))]


def config_table(spark: SparkSession, config: dict) -> DataFrame:
    """(name, value) of a configuration, to be joined where rows choose their setting."""
    return spark.createDataFrame(flattened(config), "name string, value string")


def stamp(df: DataFrame, key: str, name: str) -> DataFrame:
    """(name, rows, table_hash, version): one row that names a table's content, whatever the order of its rows."""
    digest = table_hash(df, key)
    return df.sparkSession.createDataFrame([(name, int(digest.split("-")[0]), digest, __version__)], "name string, rows long, table_hash string, version string")


def with_provenance(df: DataFrame, source: str, version: str, ingest_date: str) -> DataFrame:
    """Adds source, source_version and ingest_date; rows that have them keep theirs."""
    out = df
    for column, value in (("source", source), ("source_version", version), ("ingest_date", ingest_date)):
        given = F.lit(value)
        out = out.withColumn(column, F.coalesce(F.col(column), given) if column in df.columns else given)
    return out


def read_pages(spark: SparkSession, folder: str, labels: dict[str, int]) -> DataFrame:
    """(id, sequence, category, label, page) of a scan kept as pages ``<category>/<page>.json``, JSON lines of id and sequence.

    All pages are read in one parallel scan. Categories outside ``labels`` are
    left out, and so are sequences with other than the standard residues.
    """
    rows = spark.read.schema("id string, sequence string").json(f"{folder}/*/*.json").select("id", "sequence", F.col("_metadata.file_path").alias("f"))
    rows = rows.select("id", "sequence", F.regexp_extract("f", "([^/]+)/[^/]+$", 1).alias("category"), F.regexp_extract("f", "([^/]+)[.]json$", 1).alias("page"))
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    rows = rows.withColumn("label", F.try_element_at(table, F.col("category"))).where("label is not null")
    return rows.where(F.col("sequence").rlike("^[ACDEFGHIKLMNPQRSTVWY]+$")).select("id", "sequence", "category", "label", "page")
