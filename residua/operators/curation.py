"""Cleaning of submitted sequences and resolution of duplicates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Strength of label evidence; anything else counts 10.
EVIDENCE = {
    "experimental_challenge_protection": 100, "experimental_assay": 90, "curated_experimental": 80, "peer_reviewed_clinical_ige": 75,
    "curated_literature": 50, "curated_swissprot": 50, "curated_non_immunogen": 40, "curated_viral": 40, "predicted": 10, "unknown": 0,
}

# Words that rule a description out as a negative control.
NOT_NEGATIVE = ("toxin", "venom", "hemolysin", "pore-forming", "allergen", "allergenic", "ige-binding", "antigen", "surface protein", "outer membrane", "protective", "virulence", "capsid", "spike", "envelope")


def _stripped(column: str) -> Column:
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def parsed(column: str) -> Column:
    """Cleaning on reading: no white space, upper case, ambiguous residues mapped, the rest dropped."""
    return F.regexp_replace(F.translate(F.upper(F.regexp_replace(column, r"\s+", "")), "BZUXJO", "DECALK"), "[^ACDEFGHIKLMNPQRSTVWY]", "")


def for_model(column: str) -> Column:
    """Cleaning before an embedding: rare residues mapped, unknown ones kept as X."""
    return F.regexp_replace(F.translate(F.upper(_stripped(column)), "UOBZJ", "CKNEL"), "[^ACDEFGHIKLMNPQRSTVWY]", "X")


def sanitized(df: DataFrame, key: str | list[str], column: str, most: float = 0.05, least: int = 4) -> DataFrame:
    """Sanitised sequence of each row, with a log of every changed character.

    Positions count from 0 after outer white space is cut off. Case changes are
    logged but do not count as altered. ``key`` names the columns that stay. Rows with a null sequence are left out;
    a blank one gives the empty sequence and is dropped.
    """
    keys = [key] if isinstance(key, str) else key
    text = df.where(F.col(column).isNotNull()).select(*keys, _stripped(column).alias("s"))
    letters = F.expr("CASE WHEN length(s) > 0 THEN transform(sequence(1, length(s)), i -> substr(s, i, 1)) ELSE array() END")
    standard, mapped = "instr('ACDEFGHIKLMNPQRSTVWY', upper(x)) > 0", "instr('BZJUO', upper(x)) > 0"
    log = f"""transform(c, (x, i) -> named_struct('position', i, 'original', x,
        'converted', CASE WHEN {standard} THEN upper(x) WHEN {mapped} THEN translate(upper(x), 'BZJUO', 'NQLCK') END,
        'action', CASE WHEN {standard} THEN CASE WHEN upper(x) <> x THEN 'case_converted' ELSE 'kept' END WHEN {mapped} THEN 'mapped' ELSE 'stripped' END))"""
    logged = text.withColumn("c", letters).withColumn("log", F.expr(log))
    altered = F.expr("size(filter(log, a -> a.action IN ('mapped', 'stripped')))")
    out = logged.select(
        *keys,
        F.expr("array_join(transform(log, a -> coalesce(a.converted, '')), '')").alias("sanitized_sequence"),
        F.length("s").alias("original_length"),
        F.expr("filter(log, a -> a.action <> 'kept')").alias("alterations"),
        altered.alias("altered_count"),
    )
    fraction = F.when(F.col("original_length") > 0, F.col("altered_count") / F.col("original_length")).otherwise(F.lit(0.0))
    return out.withColumn("sanitized_length", F.length("sanitized_sequence")).select(
        "*", F.round(fraction, 4).alias("altered_fraction"), (fraction > most).alias("is_flagged"), (F.col("sanitized_length") < least).alias("is_dropped")
    )


def evidence(column: str) -> Column:
    strengths = F.create_map(*[F.lit(x) for pair in EVIDENCE.items() for x in pair])
    return F.coalesce(F.try_element_at(strengths, F.col(column)), F.lit(10))


def resolved(df: DataFrame) -> DataFrame:
    """One survivor per exact sequence, by evidence; (sequence, kept_id, members, conflict).

    ``df`` has id, sequence, label, label_evidence. The strongest evidence wins,
    among equals the smallest id. Where records of the strongest evidence
    disagree in their label, none is kept: kept_id is null and conflict true.
    The rule is a single aggregation, so that copies are combined before the
    shuffle however many there are.
    """
    graded = df.select("id", "sequence", F.coalesce("label", F.lit(0)).alias("label"), evidence("label_evidence").alias("e"))
    order = F.struct((-F.col("e")).alias("e"), "id", "label")
    by_label = graded.groupBy("sequence", "label").agg(F.min(order).alias("best"), F.max("e").alias("e"), F.count("*").alias("members"))
    both = by_label.groupBy("sequence").agg(F.min("best").alias("best"), F.max("e").alias("top"), F.min("e").alias("low"), F.count("*").alias("labels"), F.sum("members").alias("members"))
    conflict = (F.col("labels") > 1) & (F.col("top") == F.col("low"))
    return both.select("sequence", F.when(~conflict, F.col("best.id")).alias("kept_id"), "members", conflict.alias("conflict"))


def resolved_in_order(df: DataFrame) -> DataFrame:
    """Removal log of the order-dependent resolution: rows of one sequence are met in ``ord``.

    (id, duplicate_of, reason). A later row with stronger evidence takes the
    place of the earlier one; equal evidence with other labels drops both. Only
    the rows of one sequence meet in a task.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord")
        rows = frame[["id", "label", "e"]].itertuples(index=False)
        held = next(rows)
        out = []
        for row in rows:
            stronger = row.e > held.e
            if row.label == held.label:
                reason = "EXACT_DUPLICATE_SUPERSEDED_BY_HIGHER_EVIDENCE" if stronger else "EXACT_DUPLICATE_RETAINED_PRIMARY"
            elif row.e != held.e:
                reason = "CONFLICTING_LABEL_DISCARDED"
            else:
                reason = "UNRESOLVED_CONFLICTING_LABELS_DROPPED"
            gone, kept = (held, row) if stronger else (row, held)
            out.append((gone.id, kept.id, reason))
            if stronger:
                held = row
        return pd.DataFrame(out, columns=["id", "duplicate_of", "reason"])

    graded = df.select("id", "sequence", "ord", F.coalesce("label", F.lit(0)).alias("label"), evidence("label_evidence").alias("e"))
    copied = graded.groupBy("sequence").count().where("count > 1").select("sequence")
    return graded.join(copied, "sequence").groupBy("sequence").applyInPandas(fold, "id string, duplicate_of string, reason string")


def negative_allowed(description: str, keywords: str | None = None, forbidden: tuple[str, ...] = ()) -> Column:
    """True where no word of the description, and none of the array ``keywords``, rules a row out as a negative control.

    Words of a description may stand anywhere, keywords must be equal but for case. Null counts as allowed.
    """
    named = F.coalesce(F.lower(F.col(description)).rlike("|".join(NOT_NEGATIVE)), F.lit(False))
    if keywords is None:
        return ~named
    listed = F.arrays_overlap(F.transform(F.col(keywords), F.lower), F.array(*[F.lit(w.lower()) for w in forbidden]))
    return ~named & ~F.coalesce(listed, F.lit(False))


def organism_class(column: str, aliases: dict[str, str] | None = None) -> Column:
    """bacteria, virus or tumor by an alias of the whole name or by words in it, else null (no score is given)."""
    name = F.lower(F.trim(F.col(column)))
    if aliases:
        table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        return F.coalesce(F.try_element_at(table, name), organism_class(column))
    return F.when(name.contains("bacter"), "bacteria").when(name.contains("vir"), "virus").when(name.contains("tumor") | name.contains("cancer"), "tumor")
