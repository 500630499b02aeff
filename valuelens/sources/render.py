"""Appraisal and loan document text rendered from the derived records.

Each appraisal becomes two pages (subject, sales comparison) of ``Label: value``
lines, so the text pipeline (pages -> assemble -> extract -> validate -> calibrate
-> comps -> roll-up) runs on inputs that grow with ``orders``/``lineitem``.  A
deterministic share of documents carries an extraction failure on its pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import APPRAISAL_LABELS, SSN_FIELD, loan_label
from ..schema import APPRAISAL_FIELDS, LOAN_FIELDS, STRATEGIES
from . import derive

PAGE_HEADS = ("UNIFORM RESIDENTIAL APPRAISAL REPORT", "SALES COMPARISON APPROACH")
LOAN_HEAD = "UNIFORM RESIDENTIAL LOAN APPLICATION"
FAILED_PAGE_ERROR = "pdfplumber: unreadable content stream"


def _line(label: str, value) -> F.Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{label}: "), value))


def appraisal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file_name, strategy, priority, page_number, raw_text, tables, error, elapsed_ms): two pages per document."""
    docs = derive.appraisals(spark, sf_dir)
    v = lambda n: F.col("fields").getField(n).getField("value")
    subject = [n for n in APPRAISAL_FIELDS if not n.startswith("comp_")]
    comps = [n for n in APPRAISAL_FIELDS if n.startswith("comp_")]
    p1 = F.concat_ws("\n", F.lit(PAGE_HEADS[0]), *[_line(APPRAISAL_LABELS[n], v(n)) for n in subject])
    p2 = F.concat_ws("\n", F.lit(PAGE_HEADS[1]), *[_line(APPRAISAL_LABELS[n], v(n)) for n in comps])
    pages = F.array(F.struct(F.lit(1).alias("page_number"), p1.alias("raw_text")),
                    F.struct(F.lit(2).alias("page_number"), p2.alias("raw_text")))
    failed = F.col("doc_id") % 97 == 0
    return docs.select("doc_id", "file_name", F.inline(pages)).select(
        "doc_id", "file_name", F.lit(STRATEGIES[0]).alias("strategy"), F.lit(0).alias("priority"),
        "page_number", F.when(~failed, F.col("raw_text")).alias("raw_text"),
        F.lit(None).cast("array<array<array<string>>>").alias("tables"),
        F.when(failed, F.lit(FAILED_PAGE_ERROR)).alias("error"),
        (F.col("doc_id") % 250 + 40 * F.col("page_number") + F.length("raw_text")).cast("bigint").alias("elapsed_ms"))


def loan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file_name, text): one page per loan application; the SSN line shows the full number."""
    docs = derive.loans(spark, sf_dir)
    lines = []
    for n in LOAN_FIELDS:
        val = F.col("fields").getField(n).getField("value")
        if n == SSN_FIELD:
            val = F.when(val.isNotNull(), F.concat(F.lit("900-"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"),
                                                   F.lit("-"), val))
        lines.append(_line(loan_label(n), val))
    return docs.select("doc_id", "file_name", F.concat_ws("\n", F.lit(LOAN_HEAD), *lines).alias("text"))
