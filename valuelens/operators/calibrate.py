"""Cross-field calibration (completeness, value vs comps, $/sqft outlier, age vs
condition, bed/bath counts, prior sale), reliability score and per-field reliability.

Every check is a function of one document row, so the whole report is a single
projection over the wide record: no shuffle, no Python.  The three comparable
slots are unrolled as scalar columns (fixed summation order c1+c2+c3), which keeps
the projection inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import (downgrade, fixed0, fixed1, money0, percent, percent0, py_float_str,
                                round_half_up, truthy)
from ..schema import APPRAISAL_FIELDS, CRITICAL_FIELDS
from .numbers import NUMBER_COLUMNS, with_numbers
from .records import unrolled
from .validate import AS_OF_YEAR

# --------------------------------------------------------------------------
# Check names, affected fields, messages and actions of the flags.
# --------------------------------------------------------------------------
SLOTS = [
    # (slot, check_name, affected_fields)
    (1, "critical_field_completeness", CRITICAL_FIELDS),
    (2, "value_vs_comp_range", ["appraised_value", "comp_1_sale_price", "comp_2_sale_price", "comp_3_sale_price"]),
    (3, "price_per_sqft_outlier", ["appraised_value", "gross_living_area_sqft"]),
    (4, "year_built_vs_condition", ["year_built", "condition_rating"]),
    (5, "bedroom_count", ["number_of_bedrooms"]),
    (6, "bathroom_count", ["number_of_bathrooms"]),
    (7, "bedroom_bathroom_ratio", ["number_of_bedrooms", "number_of_bathrooms"]),
    (8, "prior_sale_vs_appraised", ["appraised_value", "prior_sale_price"]),
]
ACTION_COMPLETENESS_ERROR = ("Verify the PDF contains selectable text (not a scanned image). "
                             "Try re-uploading or using OCR preprocessing.")
ACTION_COMPLETENESS_WARNING = "Manually verify missing critical fields."
ACTION_VALUE_VS_COMPS = ("Verify appraised value and comparable sale prices were extracted correctly. "
                         "Large deviations may indicate extraction from the wrong field.")
ACTION_PPSF = ("Verify GLA and appraised value. Check if basement area "
               "was incorrectly included in above-grade GLA.")
ACTION_C1 = ("Verify condition rating — may have been extracted from "
             "a comparable sale row rather than the subject property.")
ACTION_C6 = "Verify both year_built and condition_rating extractions."
ACTION_BEDROOMS = "Verify bedroom count extraction — likely picked up wrong field."
ACTION_BATHROOMS = "Verify bathroom count — UAD format uses decimal notation (e.g. 2.1 = 2 full, 1 half)."
ACTION_RATIO = "Verify both counts. UAD bathroom notation may have been misread."
ACTION_PRIOR = ("Verify both values and the prior sale date. "
                "Large changes may be legitimate if the prior sale was many years ago.")
MSG_BEDROOMS = "Extracted bedroom count is 0, which is implausible for a residential appraisal."
MSG_BATHROOMS = "Extracted bathroom count is 0, which is implausible for a residential appraisal."
SUMMARY_HIGH = "Fields are internally consistent. Extraction is reliable."
SUMMARY_MEDIUM = "Some inconsistencies detected. Manual review recommended for flagged fields."
SUMMARY_LOW = ("Significant inconsistencies detected. "
               "Do not rely on extracted values without manual verification.")
ERROR_PENALTY = 0.20
WARNING_PENALTY = 0.08
# --------------------------------------------------------------------------

FLAG_COLUMNS = [f"_f{i}_{p}" for i, _, _ in SLOTS for p in ("sev", "msg", "act")]
WORK_COLUMNS = NUMBER_COLUMNS + FLAG_COLUMNS + ["_n_present", "_completeness", "_score", "_errors", "_warnings"]


def _s(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _present(name: str) -> Column:
    f = F.col("fields").getField(name)
    return (f.getField("confidence") != "missing") & f.getField("value").isNotNull()


def _sum_in_order(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _flags(as_of_year: int) -> tuple[dict[str, Column], dict[str, Column]]:
    """(staged inputs, severity / message / action columns of the eight flag slots).

    Subexpression elimination does not share work across CASE branches, so every
    condition input used by more than one of severity, message and action is
    projected first and referenced as a column."""
    av, gla, yb, beds, baths, prior, cond = (F.col(c) for c in
                                             ("_av", "_gla", "_yb", "_beds", "_baths", "_prior", "_cond"))
    cps = [F.col(f"_cp{i}") for i in (1, 2, 3)]
    cgs = [F.col(f"_cg{i}") for i in (1, 2, 3)]
    n_present = F.col("_n_present")
    comp = F.col("_completeness")
    out: dict[str, Column] = {}
    stage: dict[str, Column] = {}  # inputs of the conditions, projected before the flags

    # K1 completeness
    out["_f1_sev"] = F.when(comp < 0.5, "error").when(comp < 0.8, "warning")
    out["_f1_msg"] = (F.when(comp < 0.5, _s("Only ", n_present.cast("string"), f"/{len(CRITICAL_FIELDS)} critical "
                                           "fields were extracted. The document may not be a standard appraisal "
                                           "form, or text extraction failed."))
                      .when(comp < 0.8, _s(n_present.cast("string"), f"/{len(CRITICAL_FIELDS)} critical fields "
                                           "extracted. Some fields may be in non-standard locations.")))
    out["_f1_act"] = F.when(comp < 0.5, ACTION_COMPLETENESS_ERROR).when(comp < 0.8, ACTION_COMPLETENESS_WARNING)

    # K2 value vs comp midpoint (comps with price > 0)
    valid = [c.isNotNull() & (c > 0) for c in cps]
    n_valid = _sum_in_order([F.when(v, 1).otherwise(0) for v in valid])
    total = _sum_in_order([F.when(v, c).otherwise(F.lit(0.0)) for v, c in zip(valid, cps)])
    stage["_k2_mid"] = F.try_divide(total, n_valid)
    stage["_k2_dev"] = F.try_divide(F.abs(av - F.col("_k2_mid")), F.col("_k2_mid"))
    stage["_k2"] = av.isNotNull() & (n_valid > 0) & (F.col("_k2_dev") > 0.40)
    mid, dev, k2 = F.col("_k2_mid"), F.col("_k2_dev"), F.col("_k2")
    out["_f2_sev"] = F.when(k2, F.when(dev > 0.60, "error").otherwise("warning"))
    out["_f2_msg"] = F.when(k2, _s("Appraised value ($", money0(av), ") deviates ", percent(dev, 1),
                                   " from comparable sales midpoint ($", money0(mid), "). Standard appraisal "
                                   "practice requires strong justification for deviations >20%."))
    out["_f2_act"] = F.when(k2, ACTION_VALUE_VS_COMPS)

    # K3 subject $/sqft vs comps (population std, unrounded $/sqft)
    subj = F.try_divide(av, gla)
    ok = [truthy(p) & truthy(g) & (g > 0) for p, g in zip(cps, cgs)]
    n_ok = _sum_in_order([F.when(o, 1).otherwise(0) for o in ok])
    ppsf = [F.try_divide(p, g) for p, g in zip(cps, cgs)]
    mean = F.try_divide(_sum_in_order([F.when(o, x).otherwise(F.lit(0.0)) for o, x in zip(ok, ppsf)]), n_ok)
    var = F.try_divide(
        _sum_in_order([F.when(o, (x - mean) * (x - mean)).otherwise(F.lit(0.0)) for o, x in zip(ok, ppsf)]), n_ok)
    std = F.sqrt(var)
    z = F.try_divide(F.abs(subj - mean), std)
    stage.update({"_k3_subj": subj, "_k3_mean": mean, "_k3_std": std, "_k3_z": z,
                  "_k3": truthy(av) & truthy(gla) & (n_ok >= 2) & (std > 0) & (z > 2.0)})
    subj, mean, std, z, k3 = (F.col(c) for c in ("_k3_subj", "_k3_mean", "_k3_std", "_k3_z", "_k3"))
    out["_f3_sev"] = F.when(k3, "warning")
    out["_f3_msg"] = F.when(k3, _s("Subject implied price/sqft ($", fixed0(subj), "/sqft) is ", fixed1(z),
                                   " standard deviations from comp mean ($", fixed0(mean), "/sqft ± $", fixed0(std),
                                   "). This may indicate a GLA or value extraction error."))
    out["_f3_act"] = F.when(k3, ACTION_PPSF)

    # K4 year built vs condition (C1 tested first; substring match)
    age = F.lit(as_of_year) - yb
    cu = F.upper(cond)
    cu = F.regexp_replace(cu, r"(?U)^\s+|\s+$", "")
    base4 = yb.isNotNull() & cond.isNotNull() & (cond != "")
    stage["_k4_c1"] = base4 & cu.contains("C1") & (age > 2)
    stage["_k4_c6"] = base4 & ~(cu.contains("C1") & (age > 2)) & cu.contains("C6") & (age < 5)
    c1, c6 = F.col("_k4_c1"), F.col("_k4_c6")
    out["_f4_sev"] = F.when(c1 | c6, "warning")
    out["_f4_msg"] = (F.when(c1, _s("Condition rating C1 (new/never occupied) but year_built is ", yb.cast("string"),
                                    " (", age.cast("string"), " years ago). C1 is typically reserved for newly "
                                    "built properties."))
                      .when(c6, _s("Condition rating C6 (severe deferred maintenance) but property is only ",
                                   age.cast("string"), " years old (built ", yb.cast("string"),
                                   "). C6 is unusual for new properties.")))
    out["_f4_act"] = F.when(c1, ACTION_C1).when(c6, ACTION_C6)

    # K5 bedroom / bathroom counts
    both = beds.isNotNull() & baths.isNotNull()
    stage.update({"_k5a": both & (beds == 0), "_k5b": both & (baths == 0),
                  "_k5c": both & truthy(beds) & truthy(baths) & (baths > beds * 2)})
    k5a, k5b, k5c = F.col("_k5a"), F.col("_k5b"), F.col("_k5c")
    out["_f5_sev"] = F.when(k5a, "error")
    out["_f5_msg"] = F.when(k5a, MSG_BEDROOMS)
    out["_f5_act"] = F.when(k5a, ACTION_BEDROOMS)
    out["_f6_sev"] = F.when(k5b, "error")
    out["_f6_msg"] = F.when(k5b, MSG_BATHROOMS)
    out["_f6_act"] = F.when(k5b, ACTION_BATHROOMS)
    out["_f7_sev"] = F.when(k5c, "warning")
    out["_f7_msg"] = F.when(k5c, _s("Unusual bedroom/bathroom ratio: ", py_float_str(beds), " beds, ",
                                    py_float_str(baths), " baths. More than 2x bathrooms per bedroom is atypical."))
    out["_f7_act"] = F.when(k5c, ACTION_RATIO)

    # K6 prior sale vs appraised
    stage["_k6_change"] = F.try_divide(F.abs(av - prior), prior)
    stage["_k6"] = truthy(av) & truthy(prior) & (F.col("_k6_change") > 1.0)
    change, k6 = F.col("_k6_change"), F.col("_k6")
    out["_f8_sev"] = F.when(k6, "warning")
    out["_f8_msg"] = F.when(k6, _s("Appraised value ($", money0(av), ") differs from prior sale ($", money0(prior),
                                   ") by ", percent0(change), ". Changes >100% are unusual and may indicate an "
                                   "extraction error or non-arm's-length prior sale."))
    out["_f8_act"] = F.when(k6, ACTION_PRIOR)
    return stage, out


def with_calibration(docs: DataFrame, as_of_year: int = AS_OF_YEAR) -> DataFrame:
    """Adds the work columns (numbers, flag slots, completeness, score, counts)."""
    df = with_numbers(docs)
    n_present = _sum_in_order([F.when(_present(n), 1).otherwise(0) for n in CRITICAL_FIELDS])
    df = df.withColumns({"_n_present": n_present,
                         "_completeness": n_present / F.lit(float(len(CRITICAL_FIELDS)))})
    stage, flags = _flags(as_of_year)
    for name, col in stage.items():  # in order: later inputs refer to earlier ones
        df = df.withColumn(name, col)
    df = df.withColumns(flags).drop(*stage)
    sev = [F.col(f"_f{i}_sev") for i, _, _ in SLOTS]
    # Deduct in flag order, exactly as a running subtraction.
    score = F.lit(1.0)
    for s in sev:
        score = score - F.when(s == "error", ERROR_PENALTY).when(s == "warning", WARNING_PENALTY).otherwise(0.0)
    score = round_half_up(score * F.col("_completeness"), 4)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    errors = _sum_in_order([F.when(s == "error", 1).otherwise(0) for s in sev])
    warnings = _sum_in_order([F.when(s == "warning", 1).otherwise(0) for s in sev])
    return df.withColumns({"_score": score, "_errors": errors, "_warnings": warnings})


def summary_text(score: Column, completeness: Column, errors: Column, warnings: Column) -> Column:
    quality = F.when(score >= 0.85, "High").when(score >= 0.60, "Medium").otherwise("Low")
    desc = F.when(score >= 0.85, SUMMARY_HIGH).when(score >= 0.60, SUMMARY_MEDIUM).otherwise(SUMMARY_LOW)
    return _s("Reliability: ", quality, " (", percent0(score), "). Critical field completeness: ",
              percent0(completeness), ". ", errors.cast("string"), " error(s), ", warnings.cast("string"),
              " warning(s). ", desc)


def report_columns() -> list[Column]:
    return [
        F.col("_score").alias("reliability_score"),
        F.col("_errors").cast("bigint").alias("error_count"),
        F.col("_warnings").cast("bigint").alias("warning_count"),
        F.col("_completeness").alias("critical_fields_present"),
        summary_text(F.col("_score"), F.col("_completeness"), F.col("_errors"), F.col("_warnings")).alias("summary"),
    ]


def calibrate(docs: DataFrame, as_of_year: int = AS_OF_YEAR) -> DataFrame:
    """Flat calibration report: one row per document."""
    return with_calibration(docs, as_of_year).select("doc_id", *report_columns())


def flag_entries() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("flag_ord"), F.col(f"_f{i}_sev").alias("severity"),
                              F.lit(name).alias("check_name"), F.col(f"_f{i}_msg").alias("message"),
                              F.col(f"_f{i}_act").alias("suggested_action"),
                              F.lit(",".join(fields)).alias("affected_fields"))
                     for i, name, fields in SLOTS])


def nested_report() -> Column:
    """The whole calibration report of a document: scalars, the raised flags in flag order, every field's reliability."""
    raised = F.filter(flag_entries(), lambda f: f["severity"].isNotNull())
    return F.struct(*report_columns(), raised.alias("flags"), reliability_entries().alias("field_reliabilities"))


def calibration_flags(docs: DataFrame, as_of_year: int = AS_OF_YEAR) -> DataFrame:
    """One row per raised flag, in flag order."""
    return (unrolled(with_calibration(docs, as_of_year).select("doc_id", flag_entries().alias("_entries")), "doc_id")
            .filter(F.col("severity").isNotNull()))


def reliability_entries() -> Column:
    """Per field: downgrade once if any flag names it; reasons joined in flag order."""
    entries = []
    for ord_, name in enumerate(APPRAISAL_FIELDS):
        parts = [F.when(F.col(f"_f{i}_sev").isNotNull(),
                        _s(check, ": ", F.substring(F.col(f"_f{i}_msg"), 1, 80), "..."))
                 for i, check, fields in SLOTS if name in fields]
        orig = F.col("fields").getField(name).getField("confidence")
        if parts:
            hit = F.coalesce(*[F.col(f"_f{i}_sev") for i, _, fields in SLOTS if name in fields]).isNotNull()
            calibrated = F.when(hit, downgrade(orig)).otherwise(orig)
            reason = F.concat_ws(" | ", *parts)
        else:
            calibrated, reason = orig, F.lit("")
        entries.append(F.struct(F.lit(ord_).alias("ord"), F.lit(name).alias("field_name"),
                                orig.alias("original_confidence"), calibrated.alias("calibrated_confidence"),
                                reason.alias("adjustment_reason")))
    return F.array(*entries)


def field_reliabilities(docs: DataFrame, as_of_year: int = AS_OF_YEAR) -> DataFrame:
    return unrolled(with_calibration(docs, as_of_year).select("doc_id", reliability_entries().alias("_entries")), "doc_id")


def check_columns(docs: DataFrame, slots: list[int], as_of_year: int = AS_OF_YEAR) -> DataFrame:
    """The flag columns of selected checks as a flat table (severity + message per slot)."""
    df = with_calibration(docs, as_of_year)
    cols = []
    for i in slots:
        cols += [F.col(f"_f{i}_sev").alias(f"severity_{i}"), F.col(f"_f{i}_msg").alias(f"message_{i}")]
    return df.select("doc_id", *cols)
