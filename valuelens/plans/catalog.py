"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the benchmark tables (or what Spark derives from them) in full
and applies one operator; outputs are flat scalar columns whose names match the
DuckDB oracle in ``plans/oracle.py``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import calibrate as K
from ..operators import comps as C
from ..operators import records as R
from ..operators import validate as V
from ..schema import LOAN_FIELDS
from ..sources import derive

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def _appr(spark, sf):
    return derive.appraisals(spark, sf)


def _loans(spark, sf):
    return derive.loans(spark, sf)


def _validated(spark, sf):
    return V.post_validate(_appr(spark, sf))


# ---------------------------------------------------------------- projections
@query("flat_appraisal")
def q_flat_appraisal(spark, sf):
    return R.flat_values(_appr(spark, sf))


@query("flat_loan")
def q_flat_loan(spark, sf):
    return R.flat_values(_loans(spark, sf), LOAN_FIELDS)


@query("fields_long")
def q_fields_long(spark, sf):
    return R.fields_long(_appr(spark, sf), members=("value", "confidence", "reasoning"))


@query("high_confidence")
def q_high_confidence(spark, sf):
    return R.high_confidence(_appr(spark, sf))


@query("high_confidence_loan")
def q_high_confidence_loan(spark, sf):
    return R.high_confidence(_loans(spark, sf), LOAN_FIELDS)


@query("field_view")
def q_field_view(spark, sf):
    return R.field_view(_validated(spark, sf))


@query("field_view_high_only")
def q_field_view_high_only(spark, sf):
    return R.field_view(_validated(spark, sf), high_only=True)


@query("field_view_loan")
def q_field_view_loan(spark, sf):
    return R.field_view(V.post_validate_loan(_loans(spark, sf)), LOAN_FIELDS, show_all=True)


@query("confidence_summary")
def q_confidence_summary(spark, sf):
    return R.confidence_summary(_validated(spark, sf))


@query("confidence_summary_loan")
def q_confidence_summary_loan(spark, sf):
    return R.confidence_summary(V.post_validate_loan(_loans(spark, sf)), LOAN_FIELDS)


# ---------------------------------------------------------------- scalar functions
def _values(spark, sf):
    return R.fields_long(_appr(spark, sf), members=("value", "confidence")).select("doc_id", "ord", "value", "confidence")


@query("parse_currency")
def q_parse_currency(spark, sf):
    return _values(spark, sf).select("doc_id", "ord", S.parse_currency("value").alias("parsed"))


@query("parse_float")
def q_parse_float(spark, sf):
    return _values(spark, sf).select("doc_id", "ord", S.parse_float("value").alias("parsed"))


@query("parse_int")
def q_parse_int(spark, sf):
    return _values(spark, sf).select("doc_id", "ord", S.parse_int("value").alias("parsed"))


@query("normalise_text")
def q_normalise_text(spark, sf):
    return _values(spark, sf).select("doc_id", "ord", S.normalise_text("value").alias("normalised"))


@query("downgrade_confidence")
def q_downgrade(spark, sf):
    return _values(spark, sf).select("doc_id", "ord", S.downgrade("confidence").alias("downgraded"))


# ---------------------------------------------------------------- validation
for _key, _field in [("validate_appraised_value", "appraised_value"), ("validate_year_built", "year_built"),
                     ("validate_gla", "gross_living_area_sqft"), ("validate_bedrooms", "number_of_bedrooms")]:
    REGISTRY[_key] = (lambda f: lambda spark, sf: V.validate_one(_appr(spark, sf), f))(_field)

for _key, _field in [("validate_loan_amount", "loan_amount"), ("validate_credit_score", "credit_score"),
                     ("validate_dti", "dti_ratio"), ("validate_ltv", "ltv_ratio"),
                     ("validate_interest_rate", "interest_rate"), ("validate_loan_term", "loan_term_months")]:
    REGISTRY[_key] = (lambda f: lambda spark, sf: V.validate_one(_loans(spark, sf), f, loan=True))(_field)


@query("post_validate")
def q_post_validate(spark, sf):
    return R.fields_long(_validated(spark, sf), members=("confidence", "reasoning"))


@query("post_validate_loan")
def q_post_validate_loan(spark, sf):
    return R.fields_long(V.post_validate_loan(_loans(spark, sf)), LOAN_FIELDS, members=("confidence", "reasoning"))


# ---------------------------------------------------------------- calibration
def _check(slots):
    return lambda spark, sf: K.check_columns(_validated(spark, sf), slots)


REGISTRY["check_completeness"] = _check([1])
REGISTRY["check_value_vs_comps"] = _check([2])
REGISTRY["check_ppsf_outlier"] = _check([3])
REGISTRY["check_year_vs_condition"] = _check([4])
REGISTRY["check_bed_bath"] = _check([5, 6, 7])
REGISTRY["check_prior_sale"] = _check([8])


@query("calibration_flags")
def q_calibration_flags(spark, sf):
    return K.calibration_flags(_validated(spark, sf))


@query("field_reliabilities")
def q_field_reliabilities(spark, sf):
    return K.field_reliabilities(_validated(spark, sf))


@query("reliability_score")
def q_reliability_score(spark, sf):
    return K.calibrate(_validated(spark, sf)).select("doc_id", "reliability_score", "critical_fields_present")


@query("calibration_counts")
def q_calibration_counts(spark, sf):
    return K.calibrate(_validated(spark, sf)).select("doc_id", "error_count", "warning_count")


@query("calibration_summary")
def q_calibration_summary(spark, sf):
    return K.calibrate(_validated(spark, sf)).select("doc_id", "summary")


@query("calibrate")
def q_calibrate(spark, sf):
    return K.calibrate(_validated(spark, sf))


# ---------------------------------------------------------------- comparable sales
def _comp_cols(*cols):
    return lambda spark, sf: C.analyze_comps(_validated(spark, sf)).select("doc_id", *cols)


@query("parse_comparables")
def q_parse_comparables(spark, sf):
    return C.parse_comparables(_validated(spark, sf))


REGISTRY["comp_ppsf"] = lambda spark, sf: C.parse_comparables(_validated(spark, sf)).select(
    "doc_id", "label", "price_per_sqft")
REGISTRY["subject_ppsf"] = _comp_cols("subject_implied_ppsf")
REGISTRY["ppsf_stats"] = _comp_cols("comp_ppsf_mean", "comp_ppsf_std", "comp_ppsf_min", "comp_ppsf_max",
                                    "subject_vs_mean_pct")
REGISTRY["gla_rate"] = _comp_cols("estimated_gla_rate_per_sqft")
REGISTRY["adjusted_range"] = _comp_cols("adjusted_value_range_low", "adjusted_value_range_high",
                                        "appraised_value_in_range")
REGISTRY["bracketing"] = _comp_cols("is_bracketed", "has_comp_above", "has_comp_below", "bracketing_message")
REGISTRY["comp_quality"] = _comp_cols("comp_quality_score", "comp_quality_label")
REGISTRY["comp_summary"] = _comp_cols("summary")


@query("gla_adjustments")
def q_gla_adjustments(spark, sf):
    return C.gla_adjustments(_validated(spark, sf))


@query("comp_warnings")
def q_comp_warnings(spark, sf):
    return C.comp_warnings(_validated(spark, sf))


@query("analyze_comps")
def q_analyze_comps(spark, sf):
    return C.analyze_comps(_validated(spark, sf))


# ---------------------------------------------------------------- document comparison
from ..operators import compare as X  # noqa: E402


def _pairs(spark, sf):
    """Consecutive documents of one customer, both records in one row."""
    return X.consecutive_documents(V.post_validate(derive.appraisals(spark, sf, owner=True)), "ck")


@query("compare_fields")
def q_compare_fields(spark, sf):
    return X.compare_long(_pairs(spark, sf)).drop("presence")


@query("compare_presence")
def q_compare_presence(spark, sf):
    return X.compare_long(_pairs(spark, sf)).select("pair_id", "ord", "field_name", "presence")


@query("compare_numeric_diff")
def q_compare_numeric_diff(spark, sf):
    return (X.compare_long(_pairs(spark, sf)).filter(F.col("difference_note").isNotNull())
            .select("pair_id", "field_name", "difference_note"))


@query("compare_summary")
def q_compare_summary(spark, sf):
    return X.compare_summary(_pairs(spark, sf))


@query("compare_discrepancies")
def q_compare_discrepancies(spark, sf):
    return X.compare_discrepancies(_pairs(spark, sf))


@query("compare_digest")
def q_compare_digest(spark, sf):
    return X.compare_digest(_pairs(spark, sf))


# ---------------------------------------------------------------- document assembly
from ..operators import assemble as D  # noqa: E402
from ..sources import pages as PG  # noqa: E402


@query("scan_pages")
def q_scan_pages(spark, sf):
    return PG.conversation_pages(spark, sf).select("doc_id", "file_name", "strategy", "page_number", "raw_text")


@query("page_char_count")
def q_page_char_count(spark, sf):
    return D.page_char_count(PG.conversation_pages(spark, sf))


@query("assemble_documents")
def q_assemble_documents(spark, sf):
    return D.assemble_documents(PG.conversation_pages(spark, sf)).drop("priority", "error")


@query("normalise_tables")
def q_normalise_tables(spark, sf):
    return D.normalise_tables(PG.conversation_pages(spark, sf))


def _choice(policy, preferred=None):
    return lambda spark, sf: D.choose_strategy(PG.strategy_candidates(spark, sf), policy, preferred).drop("full_text")


REGISTRY["choose_strategy"] = _choice("strict")
REGISTRY["choose_strategy_fallback"] = _choice("fallback")
REGISTRY["choose_strategy_preferred"] = _choice("strict", "pymupdf")


def _chosen_texts(spark, sf):
    """Every document that some strategy could read, with that strategy's text."""
    return D.choose_strategy(PG.strategy_candidates(spark, sf), "fallback").where("status = 'ok'")


@query("truncate_text")
def q_truncate_text(spark, sf):
    d = _chosen_texts(spark, sf)
    t = D.truncate_text(F.col("full_text"))
    return d.select("doc_id", t.alias("text"), F.length(t).alias("n_chars"))


@query("build_appraisal_request")
def q_build_appraisal_request(spark, sf):
    d = _chosen_texts(spark, sf)
    return d.select("doc_id", D.appraisal_request(F.col("full_text")).alias("request"))


@query("build_loan_request")
def q_build_loan_request(spark, sf):
    d = _chosen_texts(spark, sf)
    return d.select("doc_id", D.loan_request(F.col("full_text")).alias("request"))


@query("document_name")
def q_document_name(spark, sf):
    d = PG.named_documents(spark, sf)
    return d.select("doc_id", D.document_name(F.col("file_name"), F.col("path")).alias("name"))


@query("reject_non_pdf")
def q_reject_non_pdf(spark, sf):
    u = PG.uploads(spark, sf)
    ok = D.is_pdf_name(F.col("file_name"))
    return u.select("doc_id", "file_name", ok.alias("accepted"),
                    F.when(~ok, F.concat(F.lit("File '"), F.col("file_name"),
                                         F.lit("' is not a PDF. Only .pdf files are accepted."))).alias("error"))


# ---------------------------------------------------------------- response decoding
from ..operators import decode as E  # noqa: E402
from ..sources import responses as RS  # noqa: E402


@query("scan_responses")
def q_scan_responses(spark, sf):
    return RS.appraisal_responses(spark, sf)


@query("decode_appraisal")
def q_decode_appraisal(spark, sf):
    return R.fields_long(E.decode(RS.appraisal_responses(spark, sf)), members=("value", "confidence", "reasoning"))


def _strict_summary(decoded, names):
    ok = F.col("status") == "ok"
    cols = []
    for level, col in zip(("high", "medium", "low", "missing"), R.confidence_counts(names)):
        cols.append(F.when(ok, col).alias(level))
    return decoded.select("doc_id", "status", "error", *cols)


@query("decode_appraisal_repair")
def q_decode_appraisal_repair(spark, sf):
    from ..schema import APPRAISAL_FIELDS
    return _strict_summary(E.decode_repair(RS.appraisal_responses(spark, sf)), APPRAISAL_FIELDS)


@query("decode_loan")
def q_decode_loan(spark, sf):
    return _strict_summary(E.decode_repair(RS.loan_responses(spark, sf), LOAN_FIELDS), LOAN_FIELDS)


# ---------------------------------------------------------------- labelled extraction + batch roll-up
from ..operators import batch as B  # noqa: E402
from ..operators import extract as EX  # noqa: E402
from ..sources import render as RD  # noqa: E402


@query("extract_labelled")
def q_extract_labelled(spark, sf):
    docs = D.assemble_documents(RD.appraisal_pages(spark, sf))
    x = EX.extract_labelled(docs.withColumnRenamed("full_text", "text"))
    return R.fields_long(x).select("doc_id", "ord", "field_name", "value", "confidence", "source_snippet")


@query("extract_labelled_loan")
def q_extract_labelled_loan(spark, sf):
    x = EX.extract_labelled_loan(RD.loan_documents(spark, sf))
    return R.fields_long(x, LOAN_FIELDS).select("doc_id", "ord", "field_name", "value", "confidence")


def _processed(spark, sf):
    return B.process_pages(RD.appraisal_pages(spark, sf))


@query("batch_rows")
def q_batch_rows(spark, sf):
    return B.batch_rows(_appr(spark, sf))


@query("batch_pipeline")
def q_batch_pipeline(spark, sf):
    return B.report_rows(_processed(spark, sf))


def _named(responses: DataFrame, kind: str) -> DataFrame:
    return responses.withColumn("file_name", F.concat(F.lit(f"{kind}_"), F.col("doc_id").cast("string"), F.lit(".pdf")))


@query("response_pipeline")
def q_response_pipeline(spark, sf):
    return B.report_rows(B.process_responses(_named(RS.appraisal_responses(spark, sf), "appraisal")))


@query("loan_pipeline")
def q_loan_pipeline(spark, sf):
    return B.loan_rows(B.process_loan_responses(_named(RS.loan_responses(spark, sf), "loan")))


@query("batch_status")
def q_batch_status(spark, sf):
    return B.batch_status(_processed(spark, sf))


@query("batch_failures")
def q_batch_failures(spark, sf):
    return B.batch_failures(_processed(spark, sf))


@query("batch_summary")
def q_batch_summary(spark, sf):
    return B.batch_summary(_processed(spark, sf))


@query("write_batch_csv")
def q_write_batch_csv(spark, sf):
    path = B.output_dir(spark, "batch-csv")
    B.write_batch_csv(B.report_rows(_processed(spark, sf)), path)
    return B.read_batch_csv(spark, path)


def _reports(spark, sf, *paths):
    """The nested reports of all documents, written whole as JSON; the members that paths name are read back."""
    path = B.output_dir(spark, "reports-json")
    processed = _processed(spark, sf)
    B.write_reports_json(processed, path)
    return B.read_reports_json(spark, path, B.members(B.reports(processed).schema, *paths))


def _report_list(name):
    return lambda spark, sf: B.report_entries(_reports(spark, sf, *B.entry_paths(name)), name)


for _list in ("flags", "field_reliabilities", "comparables", "adjustments", "warnings"):
    REGISTRY[f"report_{_list}"] = _report_list(_list)


@query("report_bracketing")
def q_report_bracketing(spark, sf):
    parts = [f"comp_analysis.{p}" for p in ("subject", "ppsf", "adjusted_value_range", "bracketing")]
    return _reports(spark, sf, "doc_id", "status", *parts).filter("status = 'success'").select(
        "doc_id", F.col("comp_analysis.subject.implied_ppsf").alias("subject_implied_ppsf"),
        "comp_analysis.ppsf.comp_ppsf_mean", F.col("comp_analysis.adjusted_value_range.low").alias("adjusted_value_range_low"),
        "comp_analysis.bracketing.is_bracketed", "comp_analysis.bracketing.has_comp_above",
        "comp_analysis.bracketing.has_comp_below", F.col("comp_analysis.bracketing.message").alias("bracketing_message"))


@query("write_reports_json")
def q_write_reports_json(spark, sf):
    paths = ("calibration.reliability_score", "calibration.error_count", "comp_analysis.comp_quality_label", "confidence_summary.high")
    return _reports(spark, sf, "doc_id", "file_name", "status", *paths).select("doc_id", "file_name", "status",
                    F.col("calibration.reliability_score").alias("reliability_score"),
                    F.col("calibration.error_count").alias("error_count"),
                    F.col("comp_analysis.comp_quality_label").alias("comp_quality_label"),
                    F.col("confidence_summary.high").alias("high"))


@query("field_catalogue")
def q_field_catalogue(spark, sf):
    return B.field_catalogue(_validated(spark, sf))


FLAGSHIP = "batch_pipeline"


# ---------------------------------------------------------------- streaming intake
from ..streaming import intake as ST  # noqa: E402


@query("incremental_intake")
def q_incremental_intake(spark, sf):
    return ST.incremental_intake(spark, RS.appraisal_responses(spark, sf), B.output_dir(spark, "intake"))


@query("streamed_reports")
def q_streamed_reports(spark, sf):
    return ST.streamed_reports(spark, _named(RS.appraisal_responses(spark, sf), "appraisal"), B.output_dir(spark, "report-stream"))
