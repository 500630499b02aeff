"""Batch roll-up: per-document status, the flat 67-column report row, failures,
summary, CSV/JSON sinks and the end-to-end text pipeline.

A bad document never fails the job: every failure is an error *column* (strategy
choice, decode) turned into ``status``/``error``; nothing raises inside tasks.
The whole pipeline is one lazy plan whose only exchanges are the page -> document
grouping and, for the summary, a global aggregate of constant size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import py_bool_str, py_float_str, py_round4_str, round_half_up
from ..schema import CSV_FIELDS, CSV_HEADERS, LOAN_FIELDS
from ..session import ensure_checkpoint_dir
from . import assemble as D
from . import calibrate as K
from . import comps as C
from . import decode as J
from . import extract as E
from . import records as R
from . import validate as V

# --------------------------------------------------------------------------
# Status values and error prefixes.
# --------------------------------------------------------------------------
STATUS_OK, STATUS_ERROR = "success", "error"
PDF_FAILED = "PDF extraction failed: "
# Values keep their blanks, quotes, commas and newlines; a quote inside a value is doubled.
CSV_OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
# --------------------------------------------------------------------------


def analysed(docs: DataFrame) -> DataFrame:
    """Validated record + calibration + comp analysis columns on every row."""
    return C.with_comp_analysis(K.with_calibration(V.post_validate(docs)))


def _seconds(df: DataFrame) -> Column:
    """A document's processing time, where its source recorded one."""
    return F.coalesce(F.col("processing_time_s"), F.lit(0.0)) if "processing_time_s" in df.columns else F.lit(0.0)


def report_rows(df: DataFrame, *keep: str) -> DataFrame:
    """*keep and the flat CSV row (all text, as a CSV writer renders it); failed documents are blank."""
    ok = F.col("status") == STATUS_OK

    def blank(c):
        return F.when(ok, c).otherwise(F.lit(""))

    cols = [F.col("file_name").alias("file_name"),
            py_float_str(round_half_up(_seconds(df), 3)).alias("processing_time_s"),
            F.col("status"),
            F.coalesce(F.col("error"), F.lit("")).alias("error")]
    for f in CSV_FIELDS:
        fld = F.col("fields").getField(f)
        cols.append(blank(F.coalesce(fld.getField("value"), F.lit(""))).alias(f))
        cols.append(blank(fld.getField("confidence")).alias(f"{f}_confidence"))
    counts = R.confidence_counts()
    for name, c in zip(("high_confidence_count", "medium_confidence_count", "low_confidence_count",
                        "missing_count"), counts):
        cols.append(blank(c.cast("string")).alias(name))
    cols += [
        blank(py_round4_str(F.col("_score"))).alias("reliability_score"),
        blank(F.col("_errors").cast("string")).alias("calibration_error_count"),
        blank(F.col("_warnings").cast("string")).alias("calibration_warning_count"),
        blank(py_round4_str(F.col("comp_quality_score"))).alias("comp_quality_score"),
        blank(F.col("comp_quality_label")).alias("comp_quality_label"),
        blank(py_bool_str(F.col("in_range"))).alias("appraised_value_in_comp_range"),
        blank(py_bool_str(F.col("is_bracketed"))).alias("bracketing_satisfied"),
    ]
    out = df.select(*keep, "doc_id", *cols)
    assert out.columns[len(keep) + 1:] == CSV_HEADERS
    return out


def batch_rows(docs: DataFrame) -> DataFrame:
    """B2 over already-extracted records (every document succeeded)."""
    return report_rows(analysed(docs).withColumns({"status": F.lit(STATUS_OK),
                                                   "error": F.lit(None).cast("string")}))


def process_pages(pages: DataFrame) -> DataFrame:
    """End-to-end: pages -> document text -> strategy -> labelled extraction -> validate ->
    calibrate -> comps, with status/error per document.  Where pages carry elapsed_ms, their sum is processing_time_s."""
    chosen = D.choose_and_assemble(pages, "strict")
    staged = chosen.select(
        "doc_id", "file_name", F.col("full_text").alias("text"),
        F.when(F.col("status") == "ok", F.lit(STATUS_OK)).otherwise(F.lit(STATUS_ERROR)).alias("status"),
        F.when(F.col("error").isNotNull(), F.concat(F.lit(PDF_FAILED), F.col("error"))).alias("error"),
        (F.col("elapsed_ms") / 1000.0 if "elapsed_ms" in chosen.columns else F.lit(0.0)).alias("processing_time_s"))
    return analysed(E.extract_labelled(staged, keep=("status", "error", "processing_time_s")))


def _decoded(responses: DataFrame, *keep: str, **names) -> DataFrame:
    decoded = J.decode_repair(responses, keep=("file_name", *keep), **names)
    return decoded.withColumn("status", F.when(F.col("status") == "ok", F.lit(STATUS_OK)).otherwise(F.lit(STATUS_ERROR)))


def process_responses(responses: DataFrame, *keep: str) -> DataFrame:
    """JSON responses (doc_id, file_name, json) -> strict decode -> validate -> calibrate -> comps, with status/error per
    document.  Row-local: nothing shuffles.  A response that cannot be decoded has null fields."""
    return analysed(_decoded(responses, *keep))


def process_loan_responses(responses: DataFrame) -> DataFrame:
    """The same for loan applications: strict decode -> validate, with status/error per document."""
    return V.post_validate_loan(_decoded(responses, names=LOAN_FIELDS))


def loan_rows(processed: DataFrame) -> DataFrame:
    """One flat row per loan application: status, values and confidences (blank if it failed), counts per confidence."""
    ok = F.col("status") == STATUS_OK
    cols = []
    for f in LOAN_FIELDS:
        fld = F.col("fields").getField(f)
        cols.append(F.when(ok, F.coalesce(fld.getField("value"), F.lit(""))).otherwise(F.lit("")).alias(f))
        cols.append(F.when(ok, fld.getField("confidence")).otherwise(F.lit("")).alias(f"{f}_confidence"))
    levels = ("high", "medium", "low", "missing")
    counts = [F.when(ok, c).alias(n) for n, c in zip(levels, R.confidence_counts(LOAN_FIELDS))]
    return processed.select("doc_id", "file_name", "status", F.coalesce("error", F.lit("")).alias("error"), *cols, *counts)


def batch_status(processed: DataFrame) -> DataFrame:
    return processed.select("doc_id", "file_name", "status", F.coalesce("error", F.lit("")).alias("error"))


def batch_failures(processed: DataFrame) -> DataFrame:
    return processed.filter(F.col("status") == STATUS_ERROR).select("doc_id", "file_name", "error")


def batch_summary(processed: DataFrame) -> DataFrame:
    """One row: totals, mean time over all documents, mean reliability over successes."""
    ok = F.col("status") == STATUS_OK
    return processed.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(ok, 1)).alias("successes"),
        F.count(F.when(~ok, 1)).alias("failures"),
        # rounded: the mean of unordered doubles is only stable to a few ulps
        F.coalesce(round_half_up(F.avg(_seconds(processed)), 6), F.lit(0.0)).alias("avg_processing_time_s"),
        round_half_up(F.avg(F.when(ok, F.coalesce(F.col("_score"), F.lit(0.0)))), 6).alias("avg_reliability_score"))


# ------------------------------------------------------------------ sinks
def output_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never a machine-local temp dir on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/valuelens-out/{name}-{uuid.uuid4().hex}"


def write_batch_csv(rows: DataFrame, path: str) -> None:
    """UTF-8 CSV with header, the 67 columns in order, empty fields left empty."""
    (rows.select(*CSV_HEADERS).write.mode("overwrite")
     .options(header=True, emptyValue="", nullValue="", **CSV_OPTIONS).csv(path))


def read_batch_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in CSV_HEADERS])
    df = spark.read.options(header=True, multiLine=True, **CSV_OPTIONS).schema(schema).csv(path)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in CSV_HEADERS])


def write_reports_json(processed: DataFrame, path: str) -> None:
    """One JSON report per document: header, fields, confidence summary, calibration with its flags and field
    reliabilities, comp analysis with its comparables, adjustments, bracketing and warnings.

    A failed document has its error and no report.  Files are compressed: names and texts repeat in every report, so that the
    fastest level takes out most already."""
    reports(processed).write.mode("overwrite").options(**{"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}).json(path)


def reports(processed: DataFrame) -> DataFrame:
    ok = F.col("status") == STATUS_OK
    return processed.select(
        "doc_id", "file_name", "status", "error",
        F.when(ok, F.col("fields")).alias("fields"),
        F.when(ok, F.struct(*R.confidence_counts())).alias("confidence_summary"),
        F.when(ok, K.nested_report()).alias("calibration"),
        F.when(ok, C.nested_report()).alias("comp_analysis"))


def entry_paths(name: str) -> list[str]:
    """What a report's list is read from: the document, the list itself and, for adjustments, their rate."""
    part = "calibration" if name in ("flags", "field_reliabilities") else "comp_analysis"
    return ["doc_id", f"{part}.{name}"] + (["comp_analysis.estimated_gla_rate_per_sqft"] if name == "adjustments" else [])


def report_entries(read: DataFrame, name: str) -> DataFrame:
    """One row per entry of a list in the reports, in list order; a failed document has no report and no entries."""
    entries = F.col(entry_paths(name)[1])
    if name == "warnings":
        return read.select("doc_id", F.posexplode(entries).alias("warning_ord", "warning"))
    rate = [F.col(p).alias("estimated_rate_per_sqft") for p in entry_paths(name)[2:]]
    return read.select("doc_id", *rate, F.inline(entries))


def members(schema: T.StructType, *paths: str) -> T.StructType:
    """The part of a schema that the dotted paths name: a JSON reader makes no values of what its schema has not."""
    names = [p.partition(".")[::2] for p in paths]
    parts = {f.name: [rest for n, rest in names if n == f.name] for f in schema}
    return T.StructType([T.StructField(f.name, f.dataType if "" in parts[f.name] else members(f.dataType, *parts[f.name]), f.nullable)
                         for f in schema if parts[f.name]])


def read_reports_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


# ------------------------------------------------------------------ sources
def scan_folder(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """Files of one folder (non-recursive, case-sensitive glob), sorted by path; content is pruned."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", False)
            .load(folder).select("path", "length", "modificationTime").orderBy("path"))


def field_catalogue(docs: DataFrame) -> DataFrame:
    """One row per appraisal field: description plus documents per confidence level over the corpus.

    The 37 groups come from a partial (map-side) aggregation, so each task ships at
    most 37 rows; descriptions are attached by field position, no join."""
    from ..schema import APPRAISAL_FIELDS_WITH_DESCRIPTIONS
    long = R.fields_long(docs)
    agg = long.groupBy("ord", "field_name").agg(
        *[F.count(F.when(F.col("confidence") == lv, 1)).alias(f"n_{lv}") for lv in ("high", "medium", "low",
                                                                                     "missing")])
    desc = F.array(*[F.lit(d) for _, d in APPRAISAL_FIELDS_WITH_DESCRIPTIONS])
    return agg.select("ord", "field_name", F.element_at(desc, F.col("ord") + 1).alias("description"),
                      F.lit(len(APPRAISAL_FIELDS_WITH_DESCRIPTIONS)).alias("total_fields"),
                      "n_high", "n_medium", "n_low", "n_missing")
