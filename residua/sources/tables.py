"""The peptide table that the screening queries start from, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Residues that stand for a standard one in curation.
CURATION_FROM, CURATION_TO = "BZJUO", "NQLCK"
NOT_STANDARD = "[^ACDEFGHIKLMNPQRSTVWY]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, sequence, len, label, source, organism, accession) of every record with four residues or more.

    One row per seq_id: deliveries agree in their residues, of the other columns
    the smallest value (of the label the largest) is taken.
    """
    raw = table(spark, sf_dir, "provenance_records").where("seq_id is not null and sequence is not null")
    clean = F.regexp_replace(F.translate(F.upper(F.regexp_replace("sequence", "[^A-Za-z]", "")), CURATION_FROM, CURATION_TO), NOT_STANDARD, "")
    one = raw.select(F.col("seq_id").alias("id"), clean.alias("sequence"), "label", "source", "organism", "accession")
    one = one.groupBy("id").agg(F.max("sequence").alias("sequence"), F.max("label").alias("label"), *[F.min(c).alias(c) for c in ("source", "organism", "accession")])
    return one.withColumn("len", F.length("sequence")).where("len >= 4")


PEPTIDES_SQL = f"""pep AS (
  SELECT id, max(sequence) AS sequence, max(label) AS label, min(source) AS source, min(organism) AS organism,
    min(accession) AS accession, length(max(sequence)) AS len
  FROM (SELECT seq_id AS id, regexp_replace(translate(upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')), '{CURATION_FROM}', '{CURATION_TO}'),
      '{NOT_STANDARD}', '', 'g') AS sequence, label, source, organism, accession
    FROM provenance_records WHERE seq_id IS NOT NULL AND sequence IS NOT NULL)
  GROUP BY id HAVING length(max(sequence)) >= 4)"""
