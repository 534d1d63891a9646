"""FASTA files as tables, read in parallel and written as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.operators.curation import parsed


def read_fasta(spark: SparkSession, path: str, least: int = 4, sanitize: bool = True) -> DataFrame:
    """(id, description, raw, sequence, length, problem) of every record of the files at ``path``.

    Files are split at record boundaries, so that one large file is read by many
    tasks. The id is the first word of the header. ``problem`` names what is
    wrong with a record (empty, too short, or, when nothing is mapped, residues
    that are not standard) and is null for good ones; nothing is dropped. Text
    before the first header is a record without a header and keeps a null id.
    """
    chunks = spark.read.option("lineSep", "\n>").text(path).select(
        F.regexp_replace("value", "\r", "").alias("v"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_n")
    )
    # the first record of a file still has its mark; in a file without such a record, the first text has no header
    files = chunks.where("_at = 0").groupBy("_file").agg(F.max(F.col("v").startswith(">")).alias("_marked"), F.min("_n").alias("_first")).where("not _marked")
    chunks = chunks.join(files, "_file", "left")
    headless = F.coalesce(F.col("_n") == F.col("_first"), F.lit(False))
    body = F.regexp_replace("v", "^>", "")
    header = F.when(headless, F.lit(None)).otherwise(F.substring_index(body, "\n", 1))
    lines = F.when(headless, body).otherwise(F.expr("CASE WHEN instr(regexp_replace(v, '^>', ''), '\n') > 0 THEN substr(regexp_replace(v, '^>', ''), instr(regexp_replace(v, '^>', ''), '\n') + 1) ELSE '' END"))
    rows = chunks.where("trim(v) <> ''").select(F.trim(header).alias("header"), F.regexp_replace(lines, r"\s+", "").alias("raw"))
    rows = rows.select(F.substring_index("header", " ", 1).alias("id"), F.expr("CASE WHEN instr(header, ' ') > 0 THEN trim(substr(header, instr(header, ' ') + 1)) ELSE '' END").alias("description"), "raw")
    clean = parsed("raw") if sanitize else F.upper("raw")
    rows = rows.withColumn("sequence", clean).withColumn("length", F.length("sequence"))
    problem = F.when(F.col("length") == 0, "empty").when(F.col("length") < least, "too_short").when(F.col("sequence").rlike("[^ACDEFGHIKLMNPQRSTVWY]"), "invalid_residue")
    return rows.withColumn("problem", problem)


def write_fasta(df: DataFrame, path: str, identifier: str = "id", sequence: str = "sequence") -> None:
    """One file per partition; rows with a null id or sequence are left out."""
    rows = df.where(F.col(identifier).isNotNull() & F.col(sequence).isNotNull())
    rows.select(F.concat(F.lit(">"), F.col(identifier), F.lit("\n"), F.col(sequence)).alias("value")).write.mode("overwrite").text(path)
