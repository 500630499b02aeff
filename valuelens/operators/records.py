"""Record views over the ``fields`` struct: flat, long, high-confidence, confidence counts.

All of these are row-local projections (no shuffle); the long layout is an
``inline`` of a fixed 37/29-element array, i.e. a Generate inside the same stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import APPRAISAL_FIELDS, CONFIDENCE_LEVELS

MEMBERS = ("value", "confidence", "reasoning", "source_snippet")


def fref(name: str, attr: str | None = None, fields_col: str = "fields") -> Column:
    c = F.col(fields_col).getField(name)
    return c.getField(attr) if attr else c


def flat_values(docs: DataFrame, names: list[str] = APPRAISAL_FIELDS) -> DataFrame:
    """(doc_id, file_name, <field>...) with the field values (to_flat_dict)."""
    return docs.select("doc_id", "file_name", *[fref(n, "value").alias(n) for n in names])


def fields_long(docs: DataFrame, names: list[str] = APPRAISAL_FIELDS, keep: tuple[str, ...] = ("doc_id",),
                members: tuple[str, ...] = MEMBERS) -> DataFrame:
    """One row per (doc, field) in declaration order: ord, field_name and the members, all four or those asked for.

    The planner does not narrow the entries of a generator, so whoever needs fewer members says so."""
    entries = [F.struct(F.lit(i).alias("ord"), F.lit(n).alias("field_name"), *[fref(n, m).alias(m) for m in members])
               for i, n in enumerate(names)]
    return unrolled(docs.select(*keep, F.array(*entries).alias("_entries")), *keep)


def unrolled(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns kept and a row for each entry of ``_entries``.

    The entries are projected below: a generator evaluates its own expressions one node at a time, without compiled code.
    There is always one; the outer form keeps the planner from testing that with a filter that makes all entries first."""
    return rows.select(*keep, F.inline_outer("_entries"))


def high_confidence(docs: DataFrame, names: list[str] = APPRAISAL_FIELDS) -> DataFrame:
    """Fields with confidence high and a non-empty value (high_confidence_fields)."""
    return (fields_long(docs, names, members=("value", "confidence"))
            .filter((F.col("confidence") == "high") & F.col("value").isNotNull() & (F.col("value") != ""))
            .select("doc_id", "field_name", "value"))


def field_view(docs: DataFrame, names: list[str] = APPRAISAL_FIELDS, show_all: bool = False,
               high_only: bool = False) -> DataFrame:
    """CLI field listing: high_only keeps high; unless show_all, missing is dropped; empty value shows as a dash."""
    long = fields_long(docs, names, members=("value", "confidence", "reasoning"))
    if high_only:
        long = long.filter(F.col("confidence") == "high")
    if not show_all:
        long = long.filter(F.col("confidence") != "missing")
    return long.select("doc_id", "ord", "field_name",
                       F.coalesce(F.nullif(F.col("value"), F.lit("")), F.lit("—")).alias("shown_value"),
                       "confidence", F.coalesce(F.col("reasoning"), F.lit("")).alias("reasoning"))


def confidence_counts(names: list[str] = APPRAISAL_FIELDS, fields_col: str = "fields") -> list[Column]:
    """Per-level counts as row-local sums (no aggregation, no shuffle)."""
    out = []
    for level in CONFIDENCE_LEVELS:
        terms = [F.when(fref(n, "confidence", fields_col) == level, 1).otherwise(0) for n in names]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        out.append(total.cast("bigint").alias(level))
    return out


def confidence_summary(docs: DataFrame, names: list[str] = APPRAISAL_FIELDS) -> DataFrame:
    return docs.select("doc_id", *confidence_counts(names))
