"""DuckDB oracle SQL for every registered query that SQL can express.

Written independently of the Spark operators, in DuckDB's dialect, on the same
parquet tables.  ``ORACLE`` maps query name -> SQL string.
"""

from __future__ import annotations

from ..schema import APPRAISAL_FIELDS, CRITICAL_FIELDS, LOAN_FIELDS
from . import sqlfrag as Q
from .oracle_base import APPR_CTE, LOAN_CTE

ORACLE: dict[str, str] = {}
AS_OF = 2026


def W(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes if c.strip())


# ------------------------------------------------------------------ validation
def _issue_appr(f: str) -> str:
    n = Q.prule(f)
    v = f
    rules = {
        "appraised_value": f"CASE WHEN {n} < 1000 THEN 'Suspiciously low appraised value: ' || {v} "
                           f"WHEN {n} > 100000000 THEN 'Suspiciously high appraised value: ' || {v} END",
        "year_built": f"CASE WHEN {n} < 1600 OR {n} > {AS_OF} THEN 'year_built ' || {Q.pyfloat(n)} "
                      f"|| ' is out of plausible range' END",
        "gross_living_area_sqft": f"CASE WHEN {n} < 100 THEN 'GLA of ' || {Q.pyfloat(n)} || ' sqft is implausibly small' "
                                  f"WHEN {n} > 50000 THEN 'GLA of ' || {Q.pyfloat(n)} "
                                  f"|| ' sqft is implausibly large for residential' END",
        "number_of_bedrooms": f"CASE WHEN {n} < 0 OR {n} > 20 THEN 'Bedroom count ' || {Q.pyfloat(n)} "
                              f"|| ' is unrealistic' END",
    }
    return f"CASE WHEN {f} IS NOT NULL AND {f}__c <> 'missing' AND {n} IS NOT NULL THEN {rules[f]} END"


def _issue_loan(f: str) -> str:
    n = Q.ploanrule(f)
    p = Q.pyfloat(n)
    rules = {
        "loan_amount": f"CASE WHEN {n} < 10000 THEN 'Loan amount ' || {f} || ' is suspiciously low' "
                       f"WHEN {n} > 50000000 THEN 'Loan amount ' || {f} || ' exceeds residential limits' END",
        "credit_score": f"CASE WHEN {n} < 300 OR {n} > 850 THEN 'Credit score ' || {p} "
                        f"|| ' is outside valid range (300-850)' END",
        "dti_ratio": f"CASE WHEN {n} < 0 OR {n} > 100 THEN 'DTI ratio ' || {p} || '% is outside valid range (0-100%)' "
                     f"WHEN {n} > 65 THEN 'DTI ratio ' || {p} || '% is very high — likely approval risk' END",
        "ltv_ratio": f"CASE WHEN {n} < 0 OR {n} > 150 THEN 'LTV ratio ' || {p} || '% is outside plausible range' END",
        "interest_rate": f"CASE WHEN {n} < 0.5 OR {n} > 30 THEN 'Interest rate ' || {p} "
                         f"|| '% is outside plausible range' END",
        "loan_term_months": f"CASE WHEN {n} NOT IN (60, 120, 180, 240, 360, 480) THEN 'Loan term ' || {p} "
                            f"|| ' months is unusual (expected 60/120/180/240/360)' END",
    }
    return f"CASE WHEN {f} IS NOT NULL AND {f}__c <> 'missing' AND {n} IS NOT NULL THEN {rules[f]} END"


APPR_RULE_FIELDS = ["appraised_value", "year_built", "gross_living_area_sqft", "number_of_bedrooms"]
LOAN_RULE_FIELDS = ["loan_amount", "credit_score", "dti_ratio", "ltv_ratio", "interest_rate", "loan_term_months"]


def _validated_cte(name: str, src: str, names: list[str], rule_fields: list[str], issue) -> str:
    """name(doc_id, file_name, f, f__c (after validation), f__r (reasoning)) for every field."""
    iss = ",\n    ".join(f"{issue(f)} AS {f}__i" for f in rule_fields)
    step = f"{name}_i AS (SELECT *, {iss} FROM {src})"
    cols = []
    for f in names:
        if f in rule_fields:
            cols.append(f"{f}, CASE WHEN {f}__i IS NULL THEN {f}__c ELSE {Q.downgrade(f + '__c')} END AS {f}__c, "
                        f"CASE WHEN {f}__i IS NULL THEN '' ELSE ' [VALIDATION WARNING: ' || {f}__i || ']' END AS {f}__r")
        else:
            cols.append(f"{f}, {f}__c, '' AS {f}__r")
    return step + f",\n{name} AS (SELECT doc_id, file_name, " + ",\n    ".join(cols) + f" FROM {name}_i)"


VAL_CTE = _validated_cte("val", "appr", APPRAISAL_FIELDS, APPR_RULE_FIELDS, _issue_appr)
LVAL_CTE = _validated_cte("lval", "loan", LOAN_FIELDS, LOAN_RULE_FIELDS, _issue_loan)


def _validate_one(cte_base: str, cte_val: str, f: str) -> str:
    return (W(cte_base, cte_val) + f"\nSELECT doc_id, {f} AS value, {f}__c AS confidence, {f}__r AS reasoning, "
            f"({f}__r <> '') AS flagged FROM {cte_val.split(' AS (')[0].split(',')[-1].strip()}")


for key, f in [("validate_appraised_value", "appraised_value"), ("validate_year_built", "year_built"),
               ("validate_gla", "gross_living_area_sqft"), ("validate_bedrooms", "number_of_bedrooms")]:
    ORACLE[key] = (W(APPR_CTE, VAL_CTE) + f"\nSELECT doc_id, {f} AS value, {f}__c AS confidence, "
                   f"{f}__r AS reasoning, ({f}__r <> '') AS flagged FROM val")

for key, f in [("validate_loan_amount", "loan_amount"), ("validate_credit_score", "credit_score"),
               ("validate_dti", "dti_ratio"), ("validate_ltv", "ltv_ratio"),
               ("validate_interest_rate", "interest_rate"), ("validate_loan_term", "loan_term_months")]:
    ORACLE[key] = (W(LOAN_CTE, LVAL_CTE) + f"\nSELECT doc_id, {f} AS value, {f}__c AS confidence, "
                   f"{f}__r AS reasoning, ({f}__r <> '') AS flagged FROM lval")

ORACLE["post_validate"] = W(APPR_CTE, VAL_CTE) + "\n" + Q.unnest_fields(
    APPRAISAL_FIELDS, "val", {"confidence": "{f}__c", "reasoning": "{f}__r"})
ORACLE["post_validate_loan"] = W(LOAN_CTE, LVAL_CTE) + "\n" + Q.unnest_fields(
    LOAN_FIELDS, "lval", {"confidence": "{f}__c", "reasoning": "{f}__r"})

# ------------------------------------------------------------------ projections
ORACLE["flat_appraisal"] = W(APPR_CTE) + "\nSELECT doc_id, file_name, " + ", ".join(APPRAISAL_FIELDS) + " FROM appr"
ORACLE["flat_loan"] = W(LOAN_CTE) + "\nSELECT doc_id, file_name, " + ", ".join(LOAN_FIELDS) + " FROM loan"

_LONG_APPR = Q.unnest_fields(APPRAISAL_FIELDS, "appr", {"value": "{f}", "confidence": "{f}__c"})
ORACLE["fields_long"] = W(APPR_CTE) + "\nSELECT *, '' AS reasoning FROM (" + _LONG_APPR + ")"
ORACLE["high_confidence"] = (W(APPR_CTE) + "\nSELECT doc_id, field_name, value FROM (" + _LONG_APPR + ") "
                             "WHERE confidence = 'high' AND value IS NOT NULL AND value <> ''")
ORACLE["high_confidence_loan"] = (W(LOAN_CTE) + "\nSELECT doc_id, field_name, value FROM (" +
                                  Q.unnest_fields(LOAN_FIELDS, "loan", {"value": "{f}", "confidence": "{f}__c"}) +
                                  ") WHERE confidence = 'high' AND value IS NOT NULL AND value <> ''")


def _field_view(base, val_cte, src, names, high_only=False, show_all=False):
    long = Q.unnest_fields(names, src, {"value": "{f}", "confidence": "{f}__c", "reasoning": "{f}__r"})
    cond = ["TRUE"]
    if high_only:
        cond.append("confidence = 'high'")
    if not show_all:
        cond.append("confidence <> 'missing'")
    return (W(base, val_cte) + f"\nSELECT doc_id, ord, field_name, coalesce(nullif(value, ''), '—') AS shown_value, "
            f"confidence, coalesce(reasoning, '') AS reasoning FROM ({long}) WHERE " + " AND ".join(cond))


ORACLE["field_view"] = _field_view(APPR_CTE, VAL_CTE, "val", APPRAISAL_FIELDS)
ORACLE["field_view_high_only"] = _field_view(APPR_CTE, VAL_CTE, "val", APPRAISAL_FIELDS, high_only=True)
ORACLE["field_view_loan"] = _field_view(LOAN_CTE, LVAL_CTE, "lval", LOAN_FIELDS, show_all=True)


def _counts(names: list[str]) -> str:
    out = []
    for level in ("high", "medium", "low", "missing"):
        out.append("CAST(" + " + ".join(f"(CASE WHEN {n}__c = '{level}' THEN 1 ELSE 0 END)" for n in names)
                   + f" AS BIGINT) AS {level}")
    return ", ".join(out)


ORACLE["confidence_summary"] = W(APPR_CTE, VAL_CTE) + f"\nSELECT doc_id, {_counts(APPRAISAL_FIELDS)} FROM val"
ORACLE["confidence_summary_loan"] = W(LOAN_CTE, LVAL_CTE) + f"\nSELECT doc_id, {_counts(LOAN_FIELDS)} FROM lval"

# ------------------------------------------------------------------ scalar functions
_VALUES = Q.unnest_fields(APPRAISAL_FIELDS, "appr", {"value": "{f}", "confidence": "{f}__c"})
ORACLE["parse_currency"] = W(APPR_CTE) + f"\nSELECT doc_id, ord, {Q.pcur('value')} AS parsed FROM ({_VALUES})"
ORACLE["parse_float"] = W(APPR_CTE) + f"\nSELECT doc_id, ord, {Q.pflt('value')} AS parsed FROM ({_VALUES})"
ORACLE["parse_int"] = W(APPR_CTE) + f"\nSELECT doc_id, ord, {Q.pint('value')} AS parsed FROM ({_VALUES})"
ORACLE["normalise_text"] = W(APPR_CTE) + f"\nSELECT doc_id, ord, {Q.norm('value')} AS normalised FROM ({_VALUES})"
ORACLE["downgrade_confidence"] = (W(APPR_CTE) + f"\nSELECT doc_id, ord, {Q.downgrade('confidence')} AS downgraded "
                                  f"FROM ({_VALUES})")

# ------------------------------------------------------------------ calibration
NUM_CTE = f"""num AS (
  SELECT *, {Q.pcur('appraised_value')} AS av, {Q.pflt('gross_living_area_sqft')} AS gla,
         {Q.pint('year_built')} AS yb, {Q.pflt('number_of_bedrooms')} AS beds,
         {Q.pflt('number_of_bathrooms')} AS baths, {Q.pcur('prior_sale_price')} AS prior,
         condition_rating AS cond,
         {Q.pcur('comp_1_sale_price')} AS cp1, {Q.pcur('comp_2_sale_price')} AS cp2,
         {Q.pcur('comp_3_sale_price')} AS cp3,
         {Q.pflt('comp_1_gla')} AS cg1, {Q.pflt('comp_2_gla')} AS cg2, {Q.pflt('comp_3_gla')} AS cg3
  FROM val)"""


def _tr(x):
    return Q.truthy(x)


_present = " + ".join(f"(CASE WHEN {f}__c <> 'missing' AND {f} IS NOT NULL THEN 1 ELSE 0 END)"
                      for f in CRITICAL_FIELDS)
_valid = [f"(cp{i} IS NOT NULL AND cp{i} > 0)" for i in (1, 2, 3)]
_ok = [f"({_tr(f'cp{i}')} AND {_tr(f'cg{i}')} AND cg{i} > 0)" for i in (1, 2, 3)]

CAL1_CTE = f"""cal1 AS (
  SELECT *, {_present} AS n_present, ({_present}) / 11.0::DOUBLE AS completeness,
    {' + '.join(f'(CASE WHEN {v} THEN 1 ELSE 0 END)' for v in _valid)} AS n_valid,
    {' + '.join(f'(CASE WHEN {v} THEN cp{i} ELSE 0.0::DOUBLE END)' for i, v in zip((1, 2, 3), _valid))} AS tot,
    {' + '.join(f'(CASE WHEN {o} THEN 1 ELSE 0 END)' for o in _ok)} AS n_ok,
    {Q.div('av', 'gla')} AS subj,
    {', '.join(f"{Q.div(f'cp{i}', f'cg{i}')} AS pr{i}" for i in (1, 2, 3))}
  FROM num),
cal2 AS (
  SELECT *, {Q.div('tot', 'n_valid')} AS mid,
    {Q.div(' + '.join(f'(CASE WHEN {o} THEN pr{i} ELSE 0.0::DOUBLE END)' for i, o in zip((1, 2, 3), _ok)), 'n_ok')}
      AS mean3
  FROM cal1),
cal3 AS (
  SELECT *, {Q.div('abs(av - mid)', 'mid')} AS dev,
    sqrt({Q.div(' + '.join(f'(CASE WHEN {o} THEN (pr{i} - mean3) * (pr{i} - mean3) ELSE 0.0::DOUBLE END)'
                           for i, o in zip((1, 2, 3), _ok)), 'n_ok')}) AS std3,
    {AS_OF} - yb AS age, regexp_replace(upper(cond), '^\\s+|\\s+$', '', 'g') AS cu,
    {Q.div('abs(av - prior)', 'prior')} AS chg
  FROM cal2),
cal4 AS (
  SELECT *, {Q.div('abs(subj - mean3)', 'std3')} AS z,
    (yb IS NOT NULL AND cond IS NOT NULL AND cond <> '') AS base4,
    (beds IS NOT NULL AND baths IS NOT NULL) AS both5
  FROM cal3),
cal5 AS (
  SELECT *,
    (av IS NOT NULL AND n_valid > 0 AND dev > 0.40) AS k2,
    ({_tr('av')} AND {_tr('gla')} AND n_ok >= 2 AND std3 > 0 AND z > 2.0) AS k3,
    (base4 AND contains(cu, 'C1') AND age > 2) AS k4a,
    (base4 AND NOT (contains(cu, 'C1') AND age > 2) AND contains(cu, 'C6') AND age < 5) AS k4b,
    (both5 AND beds = 0) AS k5a, (both5 AND baths = 0) AS k5b,
    (both5 AND {_tr('beds')} AND {_tr('baths')} AND baths > beds * 2) AS k5c,
    ({_tr('av')} AND {_tr('prior')} AND chg > 1.0) AS k6
  FROM cal4)"""

_M = {  # messages
    "m1": ("CASE WHEN completeness < 0.5 THEN 'Only ' || CAST(n_present AS VARCHAR) || '/11 critical fields were "
           "extracted. The document may not be a standard appraisal form, or text extraction failed.' "
           "WHEN completeness < 0.8 THEN CAST(n_present AS VARCHAR) || '/11 critical fields extracted. "
           "Some fields may be in non-standard locations.' END"),
    "m2": (f"CASE WHEN k2 THEN 'Appraised value ($' || {Q.money0('av')} || ') deviates ' || {Q.percent('dev', 1)} "
           f"|| ' from comparable sales midpoint ($' || {Q.money0('mid')} || '). Standard appraisal practice requires "
           f"strong justification for deviations >20%.' END"),
    "m3": (f"CASE WHEN k3 THEN 'Subject implied price/sqft ($' || {Q.fixed0('subj')} || '/sqft) is ' || "
           f"{Q.fixed1('z')} || ' standard deviations from comp mean ($' || {Q.fixed0('mean3')} || '/sqft ± $' || "
           f"{Q.fixed0('std3')} || '). This may indicate a GLA or value extraction error.' END"),
    "m4": ("CASE WHEN k4a THEN 'Condition rating C1 (new/never occupied) but year_built is ' || CAST(yb AS VARCHAR) "
           "|| ' (' || CAST(age AS VARCHAR) || ' years ago). C1 is typically reserved for newly built properties.' "
           "WHEN k4b THEN 'Condition rating C6 (severe deferred maintenance) but property is only ' || "
           "CAST(age AS VARCHAR) || ' years old (built ' || CAST(yb AS VARCHAR) || '). C6 is unusual for new "
           "properties.' END"),
    "m5": "CASE WHEN k5a THEN 'Extracted bedroom count is 0, which is implausible for a residential appraisal.' END",
    "m6": "CASE WHEN k5b THEN 'Extracted bathroom count is 0, which is implausible for a residential appraisal.' END",
    "m7": (f"CASE WHEN k5c THEN 'Unusual bedroom/bathroom ratio: ' || {Q.pyfloat('beds')} || ' beds, ' || "
           f"{Q.pyfloat('baths')} || ' baths. More than 2x bathrooms per bedroom is atypical.' END"),
    "m8": (f"CASE WHEN k6 THEN 'Appraised value ($' || {Q.money0('av')} || ') differs from prior sale ($' || "
           f"{Q.money0('prior')} || ') by ' || {Q.percent0('chg')} || '. Changes >100% are unusual and may indicate "
           f"an extraction error or non-arm''s-length prior sale.' END"),
}
_SEV = {
    "s1": "CASE WHEN completeness < 0.5 THEN 'error' WHEN completeness < 0.8 THEN 'warning' END",
    "s2": "CASE WHEN k2 THEN (CASE WHEN dev > 0.60 THEN 'error' ELSE 'warning' END) END",
    "s3": "CASE WHEN k3 THEN 'warning' END",
    "s4": "CASE WHEN k4a OR k4b THEN 'warning' END",
    "s5": "CASE WHEN k5a THEN 'error' END",
    "s6": "CASE WHEN k5b THEN 'error' END",
    "s7": "CASE WHEN k5c THEN 'warning' END",
    "s8": "CASE WHEN k6 THEN 'warning' END",
}
_ACT = {
    "a1": ("CASE WHEN completeness < 0.5 THEN 'Verify the PDF contains selectable text (not a scanned image). "
           "Try re-uploading or using OCR preprocessing.' WHEN completeness < 0.8 THEN "
           "'Manually verify missing critical fields.' END"),
    "a2": ("CASE WHEN k2 THEN 'Verify appraised value and comparable sale prices were extracted correctly. "
           "Large deviations may indicate extraction from the wrong field.' END"),
    "a3": ("CASE WHEN k3 THEN 'Verify GLA and appraised value. Check if basement area was incorrectly included in "
           "above-grade GLA.' END"),
    "a4": ("CASE WHEN k4a THEN 'Verify condition rating — may have been extracted from a comparable sale row rather "
           "than the subject property.' WHEN k4b THEN 'Verify both year_built and condition_rating extractions.' END"),
    "a5": "CASE WHEN k5a THEN 'Verify bedroom count extraction — likely picked up wrong field.' END",
    "a6": ("CASE WHEN k5b THEN 'Verify bathroom count — UAD format uses decimal notation (e.g. 2.1 = 2 full, "
           "1 half).' END"),
    "a7": "CASE WHEN k5c THEN 'Verify both counts. UAD bathroom notation may have been misread.' END",
    "a8": ("CASE WHEN k6 THEN 'Verify both values and the prior sale date. Large changes may be legitimate if the "
           "prior sale was many years ago.' END"),
}
_score = "1.0::DOUBLE"
for i in range(1, 9):
    _score = f"({_score} - (CASE WHEN s{i} = 'error' THEN 0.20::DOUBLE WHEN s{i} = 'warning' THEN 0.08::DOUBLE " \
             f"ELSE 0.0::DOUBLE END))"
_errs = " + ".join(f"(CASE WHEN s{i} = 'error' THEN 1 ELSE 0 END)" for i in range(1, 9))
_warns = " + ".join(f"(CASE WHEN s{i} = 'warning' THEN 1 ELSE 0 END)" for i in range(1, 9))

CAL_CTE = f"""{CAL1_CTE},
cal6 AS (
  SELECT *, {', '.join(f'{v} AS {k}' for k, v in {**_SEV, **_M, **_ACT}.items())} FROM cal5),
cal AS (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, {Q.rnd(f'({_score}) * completeness', 4)})) AS score,
         CAST({_errs} AS BIGINT) AS n_err, CAST({_warns} AS BIGINT) AS n_warn
  FROM cal6)"""

_SUMMARY = (f"'Reliability: ' || (CASE WHEN score >= 0.85 THEN 'High' WHEN score >= 0.60 THEN 'Medium' ELSE 'Low' END)"
            f" || ' (' || {Q.percent0('score')} || '). Critical field completeness: ' || {Q.percent0('completeness')}"
            f" || '. ' || CAST(n_err AS VARCHAR) || ' error(s), ' || CAST(n_warn AS VARCHAR) || ' warning(s). ' || "
            f"(CASE WHEN score >= 0.85 THEN 'Fields are internally consistent. Extraction is reliable.' "
            f"WHEN score >= 0.60 THEN 'Some inconsistencies detected. Manual review recommended for flagged fields.' "
            f"ELSE 'Significant inconsistencies detected. Do not rely on extracted values without manual "
            f"verification.' END)")

CAL_ALL = W(APPR_CTE, VAL_CTE, NUM_CTE, CAL_CTE)


def _check(slots):
    cols = ", ".join(f"s{i} AS severity_{i}, m{i} AS message_{i}" for i in slots)
    return CAL_ALL + f"\nSELECT doc_id, {cols} FROM cal"


ORACLE["check_completeness"] = _check([1])
ORACLE["check_value_vs_comps"] = _check([2])
ORACLE["check_ppsf_outlier"] = _check([3])
ORACLE["check_year_vs_condition"] = _check([4])
ORACLE["check_bed_bath"] = _check([5, 6, 7])
ORACLE["check_prior_sale"] = _check([8])

_REPORT = (f"score AS reliability_score, n_err AS error_count, n_warn AS warning_count, "
           f"completeness AS critical_fields_present, {_SUMMARY} AS summary")
ORACLE["calibrate"] = CAL_ALL + f"\nSELECT doc_id, {_REPORT} FROM cal"
ORACLE["reliability_score"] = CAL_ALL + "\nSELECT doc_id, score AS reliability_score, " \
                                        "completeness AS critical_fields_present FROM cal"
ORACLE["calibration_counts"] = CAL_ALL + "\nSELECT doc_id, n_err AS error_count, n_warn AS warning_count FROM cal"
ORACLE["calibration_summary"] = CAL_ALL + f"\nSELECT doc_id, {_SUMMARY} AS summary FROM cal"

_SLOT_INFO = [
    (1, "critical_field_completeness", CRITICAL_FIELDS),
    (2, "value_vs_comp_range", ["appraised_value", "comp_1_sale_price", "comp_2_sale_price", "comp_3_sale_price"]),
    (3, "price_per_sqft_outlier", ["appraised_value", "gross_living_area_sqft"]),
    (4, "year_built_vs_condition", ["year_built", "condition_rating"]),
    (5, "bedroom_count", ["number_of_bedrooms"]),
    (6, "bathroom_count", ["number_of_bathrooms"]),
    (7, "bedroom_bathroom_ratio", ["number_of_bedrooms", "number_of_bathrooms"]),
    (8, "prior_sale_vs_appraised", ["appraised_value", "prior_sale_price"]),
]
ORACLE["calibration_flags"] = CAL_ALL + "\n" + " UNION ALL ".join(
    f"SELECT doc_id, {i} AS flag_ord, s{i} AS severity, '{name}' AS check_name, m{i} AS message, "
    f"a{i} AS suggested_action, '{','.join(fs)}' AS affected_fields FROM cal WHERE s{i} IS NOT NULL"
    for i, name, fs in _SLOT_INFO)


def _reliab_cols(f: str) -> tuple[str, str]:
    hits = [(i, name) for i, name, fs in _SLOT_INFO if f in fs]
    if not hits:
        return f"{f}__c", "''"
    any_hit = " OR ".join(f"s{i} IS NOT NULL" for i, _ in hits)
    parts = ", ".join(f"CASE WHEN s{i} IS NOT NULL THEN '{name}: ' || substring(m{i}, 1, 80) || '...' END"
                      for i, name in hits)
    return f"CASE WHEN {any_hit} THEN {Q.downgrade(f + '__c')} ELSE {f}__c END", f"concat_ws(' | ', {parts})"


_rel_items = []
for _i, _f in enumerate(APPRAISAL_FIELDS):
    _cal, _reason = _reliab_cols(_f)
    _rel_items.append(f"{{'ord': {_i}, 'field_name': '{_f}', 'original_confidence': {_f}__c, "
                      f"'calibrated_confidence': {_cal}, 'adjustment_reason': {_reason}}}")
ORACLE["field_reliabilities"] = CAL_ALL + (
    "\nSELECT doc_id, s.ord AS ord, s.field_name AS field_name, s.original_confidence AS original_confidence, "
    "s.calibrated_confidence AS calibrated_confidence, s.adjustment_reason AS adjustment_reason FROM ("
    f"SELECT doc_id, unnest([{', '.join(_rel_items)}]) AS s FROM cal)")

# ------------------------------------------------------------------ comparable sales
_pp = {i: f"(CASE WHEN {_tr(f'cp{i}')} AND {_tr(f'cg{i}')} AND cg{i} > 0 THEN {Q.rnd(Q.div(f'cp{i}', f'cg{i}'), 2)} END)"
       for i in (1, 2, 3)}
_subj_ok = f"({_tr('av')} AND {_tr('gla')} AND gla > 0)"
COMP_CTE = f"""cp1s AS (
  SELECT *, CASE WHEN {_subj_ok} THEN {Q.rnd(Q.div('av', 'gla'), 2)} END AS subj_ppsf,
    {_pp[1]} AS pp1, {_pp[2]} AS pp2, {_pp[3]} AS pp3,
    (CASE WHEN cp1 IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN cp2 IS NOT NULL THEN 1 ELSE 0 END)
      + (CASE WHEN cp3 IS NOT NULL THEN 1 ELSE 0 END) AS n_valid
  FROM num),
cp2s AS (
  SELECT *, (CASE WHEN pp1 IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN pp2 IS NOT NULL THEN 1 ELSE 0 END)
      + (CASE WHEN pp3 IS NOT NULL THEN 1 ELSE 0 END) AS n_pp
  FROM cp1s),
cp3s AS (
  SELECT *, {Q.div('coalesce(pp1, 0.0::DOUBLE) + coalesce(pp2, 0.0::DOUBLE) + coalesce(pp3, 0.0::DOUBLE)', 'n_pp')}
    AS mean_raw
  FROM cp2s),
cp4s AS (
  SELECT *,
    CASE WHEN n_pp > 1 THEN sqrt({Q.div(' + '.join(f'(CASE WHEN pp{i} IS NOT NULL THEN (pp{i} - mean_raw) * (pp{i} - mean_raw) ELSE 0.0::DOUBLE END)' for i in (1, 2, 3)), 'n_pp - 1')}) ELSE 0.0::DOUBLE END AS std_raw,
    {' + '.join(f'(CASE WHEN pp{i} IS NOT NULL THEN {Q.div(f"pp{i}", f"cg{i}")} ELSE 0.0::DOUBLE END)' for i in (1, 2, 3))} AS ws,
    {' + '.join(f'(CASE WHEN pp{i} IS NOT NULL THEN {Q.div("1.0::DOUBLE", f"cg{i}")} ELSE 0.0::DOUBLE END)' for i in (1, 2, 3))} AS wt
  FROM cp3s),
cp5s AS (
  SELECT *,
    CASE WHEN n_pp > 0 THEN {Q.rnd('mean_raw', 2)} END AS comp_ppsf_mean,
    CASE WHEN n_pp > 0 THEN {Q.rnd('std_raw', 2)} END AS comp_ppsf_std,
    CASE WHEN n_pp > 0 THEN {Q.rnd('least(pp1, pp2, pp3)', 2)} END AS comp_ppsf_min,
    CASE WHEN n_pp > 0 THEN {Q.rnd('greatest(pp1, pp2, pp3)', 2)} END AS comp_ppsf_max,
    CASE WHEN {_subj_ok} AND n_pp > 0 THEN {Q.rnd(Q.div(Q.div('av', 'gla') + ' - mean_raw', 'mean_raw'), 4)} END
      AS subject_vs_mean_pct,
    CASE WHEN n_pp >= 2 AND wt > 0 AND {_tr(Q.div('ws', 'wt'))} THEN {Q.rnd(Q.div('ws', 'wt') + ' * 0.25', 2)} END
      AS gla_rate
  FROM cp4s),
cp6s AS (
  SELECT *, ({_tr('gla_rate')} AND {_tr('gla')}) AS adj_ok FROM cp5s),
cp7s AS (
  SELECT *,
    {', '.join(f"(adj_ok AND cp{i} IS NOT NULL AND cg{i} IS NOT NULL) AS has{i}" for i in (1, 2, 3))}
  FROM cp6s),
cp8s AS (
  SELECT *,
    {', '.join(f"CASE WHEN has{i} THEN round_even(gla - cg{i}, 0) END AS diff{i}, "
               f"CASE WHEN has{i} THEN round_even((gla - cg{i}) * gla_rate, 0) END AS adj{i}, "
               f"CASE WHEN has{i} THEN round_even(cp{i} + (gla - cg{i}) * gla_rate, 0) END AS adjv{i}"
               for i in (1, 2, 3))},
    (has1 OR has2 OR has3) AS any_adj,
    ({_tr('av')} AND n_valid > 0) AS brk_ok
  FROM cp7s),
cp9s AS (
  SELECT *,
    CASE WHEN any_adj THEN round_even(least(adjv1, adjv2, adjv3), 0) END AS adj_low,
    CASE WHEN any_adj THEN round_even(greatest(adjv1, adjv2, adjv3), 0) END AS adj_high,
    CASE WHEN brk_ok THEN (coalesce(cp1 > av, false) OR coalesce(cp2 > av, false) OR coalesce(cp3 > av, false)) END
      AS has_comp_above,
    CASE WHEN brk_ok THEN (coalesce(cp1 < av, false) OR coalesce(cp2 < av, false) OR coalesce(cp3 < av, false)) END
      AS has_comp_below
  FROM cp8s),
cp10s AS (
  SELECT *,
    CASE WHEN any_adj AND {_tr('av')} THEN (adj_low <= av AND av <= adj_high) END AS in_range,
    CASE WHEN brk_ok THEN (has_comp_above AND has_comp_below) END AS is_bracketed
  FROM cp9s),
cp11s AS (
  SELECT *,
    CASE WHEN NOT brk_ok THEN NULL WHEN is_bracketed THEN 'Value is properly bracketed by comparable sales.'
         WHEN NOT has_comp_above THEN 'No comparable sale exceeds the appraised value of $' || {Q.money0('av')} ||
           '. UAD guidelines recommend at least one comp above the subject value.'
         ELSE 'No comparable sale is below the appraised value of $' || {Q.money0('av')} ||
           '. UAD guidelines recommend at least one comp below the subject value.' END AS bracketing_message,
    {Q.rnd('''least(1.0::DOUBLE, greatest(0.0::DOUBLE,
        (((n_valid / 3.0::DOUBLE * 0.4::DOUBLE)
          + (CASE WHEN subject_vs_mean_pct IS NOT NULL
                  THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(subject_vs_mean_pct) * 2) * 0.3::DOUBLE
                  ELSE 0.15::DOUBLE END))
          + (CASE WHEN coalesce(is_bracketed, false) THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END))
          + (CASE WHEN in_range THEN 0.15::DOUBLE WHEN in_range IS NULL THEN 0.075::DOUBLE ELSE 0.0::DOUBLE END)))''', 4)}
      AS comp_quality_score
  FROM cp10s),
comp AS (
  SELECT *,
    CASE WHEN comp_quality_score >= 0.75 THEN 'Strong' WHEN comp_quality_score >= 0.50 THEN 'Adequate'
         ELSE 'Weak' END AS comp_quality_label,
    list_filter([
      CASE WHEN n_valid = 0 THEN 'No valid comparable sales data found. Analysis is limited.' END,
      CASE WHEN adj_ok THEN (CASE WHEN any_adj AND {_tr('av')} AND NOT in_range THEN
             'Appraised value ($' || {Q.money0('av')} || ') falls outside GLA-adjusted comp range ($' ||
             {Q.money0('adj_low')} || ' – $' || {Q.money0('adj_high')} ||
             '). This may indicate additional adjustments are needed.' END)
           ELSE 'Could not estimate GLA adjustment rate — need at least 2 comps with both sale price and GLA.' END,
      CASE WHEN brk_ok AND NOT is_bracketed THEN bracketing_message END], lambda x: x IS NOT NULL) AS warn_list
  FROM cp11s),
compf AS (
  SELECT *, concat_ws(' ',
    'Comp selection quality: ' || comp_quality_label || ' (' || {Q.percent0('comp_quality_score')} || ').',
    CASE WHEN {_tr('comp_ppsf_mean')} THEN 'Comp $/sqft range: $' || {Q.fixed0('comp_ppsf_min')} || '–$' ||
      {Q.fixed0('comp_ppsf_max')} || ' (mean $' || {Q.fixed0('comp_ppsf_mean')} || ').' END,
    CASE WHEN {_tr('av')} AND subject_vs_mean_pct IS NOT NULL THEN 'Subject implied $/sqft is ' ||
      {Q.percent('abs(subject_vs_mean_pct)', 1)} || ' ' ||
      (CASE WHEN subject_vs_mean_pct > 0 THEN 'above' ELSE 'below' END) || ' comp mean.' END,
    CASE WHEN {_tr('adj_low')} AND {_tr('adj_high')} THEN 'Appraised value is ' ||
      (CASE WHEN coalesce(in_range, false) THEN 'within' ELSE 'outside' END) || ' GLA-adjusted comp range ($' ||
      {Q.money0('adj_low')} || '–$' || {Q.money0('adj_high')} || ').' END,
    bracketing_message) AS comp_summary
  FROM comp)"""

COMP_ALL = W(APPR_CTE, VAL_CTE, NUM_CTE, COMP_CTE)
_COMP_REPORT = {
    "subject_appraised_value": "av", "subject_gla_sqft": "gla", "subject_implied_ppsf": "subj_ppsf",
    "valid_comp_count": "CAST(n_valid AS BIGINT)", "comp_ppsf_mean": "comp_ppsf_mean",
    "comp_ppsf_std": "comp_ppsf_std", "comp_ppsf_min": "comp_ppsf_min", "comp_ppsf_max": "comp_ppsf_max",
    "subject_vs_mean_pct": "subject_vs_mean_pct", "estimated_gla_rate_per_sqft": "gla_rate",
    "adjusted_value_range_low": "adj_low", "adjusted_value_range_high": "adj_high",
    "appraised_value_in_range": "in_range", "is_bracketed": "is_bracketed", "has_comp_above": "has_comp_above",
    "has_comp_below": "has_comp_below", "bracketing_message": "bracketing_message",
    "comp_quality_score": "comp_quality_score", "comp_quality_label": "comp_quality_label",
    "warnings": "array_to_string(warn_list, chr(10))", "summary": "comp_summary",
}


def _comp(*cols):
    return COMP_ALL + "\nSELECT doc_id, " + ", ".join(f"{_COMP_REPORT[c]} AS {c}" for c in cols) + " FROM compf"


ORACLE["analyze_comps"] = _comp(*_COMP_REPORT)
ORACLE["subject_ppsf"] = _comp("subject_implied_ppsf")
ORACLE["ppsf_stats"] = _comp("comp_ppsf_mean", "comp_ppsf_std", "comp_ppsf_min", "comp_ppsf_max",
                             "subject_vs_mean_pct")
ORACLE["gla_rate"] = _comp("estimated_gla_rate_per_sqft")
ORACLE["adjusted_range"] = _comp("adjusted_value_range_low", "adjusted_value_range_high", "appraised_value_in_range")
ORACLE["bracketing"] = _comp("is_bracketed", "has_comp_above", "has_comp_below", "bracketing_message")
ORACLE["comp_quality"] = _comp("comp_quality_score", "comp_quality_label")
ORACLE["comp_summary"] = _comp("summary")
ORACLE["parse_comparables"] = COMP_ALL + "\n" + " UNION ALL ".join(
    f"SELECT doc_id, 'comp_{i}' AS label, comp_{i}_address AS address, cp{i} AS sale_price, cg{i} AS gla_sqft, "
    f"pp{i} AS price_per_sqft FROM compf" for i in (1, 2, 3))
ORACLE["comp_ppsf"] = COMP_ALL + "\n" + " UNION ALL ".join(
    f"SELECT doc_id, 'comp_{i}' AS label, pp{i} AS price_per_sqft FROM compf" for i in (1, 2, 3))
ORACLE["gla_adjustments"] = COMP_ALL + "\n" + " UNION ALL ".join(
    f"SELECT doc_id, gla_rate AS estimated_rate_per_sqft, 'comp_{i}' AS comp, cp{i} AS comp_sale_price, "
    f"diff{i} AS gla_difference_sqft, adj{i} AS adjustment, adjv{i} AS adjusted_comp_value FROM compf WHERE has{i}"
    for i in (1, 2, 3))
ORACLE["comp_warnings"] = COMP_ALL + (
    "\nSELECT doc_id, CAST(w.i - 1 AS INTEGER) AS warning_ord, warn_list[w.i] AS warning "
    "FROM compf, LATERAL (SELECT unnest(range(1, len(warn_list) + 1)) AS i) w")

# ------------------------------------------------------------------ document comparison
PAIRS_CTE = """pairs AS (
  SELECT pair_id, doc1, doc2 FROM (
    SELECT part * 1099511627776 + k AS pair_id, part * 1099511627776 + k AS doc2,
           lag(part * 1099511627776 + k) OVER (PARTITION BY ck ORDER BY part * 1099511627776 + k) AS doc1
    FROM ab) WHERE doc1 IS NOT NULL)"""


def _cmp_cols() -> str:
    out = []
    for f in APPRAISAL_FIELDS:
        v1, v2, c1, c2 = f"a.{f}", f"b.{f}", f"a.{f}__c", f"b.{f}__c"
        eq = (f"(CASE WHEN {c1} = 'missing' AND {c2} = 'missing' THEN TRUE "
              f"WHEN ({c1} <> 'missing' AND {c2} = 'missing') OR ({c1} = 'missing' AND {c2} <> 'missing') THEN FALSE "
              f"ELSE {Q.norm(v1)} = {Q.norm(v2)} END)")
        pres = (f"(CASE WHEN {c1} = 'missing' AND {c2} = 'missing' THEN 'both_missing' "
                f"WHEN {c1} <> 'missing' AND {c2} = 'missing' THEN 'only_in_doc1' "
                f"WHEN {c1} = 'missing' AND {c2} <> 'missing' THEN 'only_in_doc2' ELSE 'both_present' END)")
        if f in ("appraised_value", "gross_living_area_sqft", "year_built", "number_of_bedrooms",
                 "number_of_bathrooms", "prior_sale_price", "comp_1_sale_price", "comp_2_sale_price",
                 "comp_3_sale_price"):
            n1, n2 = Q.pcmp(v1), Q.pcmp(v2)
            note = (f"(CASE WHEN NOT {eq} AND {v1} IS NOT NULL AND {v1} <> '' AND {v2} IS NOT NULL AND {v2} <> '' "
                    f"AND {n1} IS NOT NULL AND {n2} IS NOT NULL THEN 'Difference: ' || {Q.money2(f'abs({n1} - {n2})')} END)")
        else:
            note = "CAST(NULL AS VARCHAR)"
        out.append(f"{v1} AS d1v_{f}, {v2} AS d2v_{f}, {c1} AS d1c_{f}, {c2} AS d2c_{f}, {eq} AS eq_{f}, "
                   f"{pres} AS pr_{f}, {note} AS note_{f}")
    return ",\n    ".join(out)


CMP_CTE = f"""cmp AS (
  SELECT p.pair_id, p.doc1, p.doc2, a.file_name AS doc1_name, b.file_name AS doc2_name,
    {_cmp_cols()}
  FROM pairs p JOIN val a ON a.doc_id = p.doc1 JOIN val b ON b.doc_id = p.doc2)"""
CMP_ALL = W(APPR_CTE, VAL_CTE, PAIRS_CTE, CMP_CTE)
_CMP_LONG = ("SELECT pair_id, doc1, doc2, s.ord AS ord, s.field_name AS field_name, s.doc1_value AS doc1_value, "
             "s.doc2_value AS doc2_value, s.doc1_confidence AS doc1_confidence, s.doc2_confidence AS doc2_confidence, "
             "s.are_equal AS are_equal, s.presence AS presence, s.difference_note AS difference_note FROM ("
             "SELECT pair_id, doc1, doc2, unnest([" + ", ".join(
                 f"{{'ord': {i}, 'field_name': '{f}', 'doc1_value': d1v_{f}, 'doc2_value': d2v_{f}, "
                 f"'doc1_confidence': d1c_{f}, 'doc2_confidence': d2c_{f}, 'are_equal': eq_{f}, "
                 f"'presence': pr_{f}, 'difference_note': note_{f}}}" for i, f in enumerate(APPRAISAL_FIELDS))
             + "]) AS s FROM cmp)")
ORACLE["compare_fields"] = CMP_ALL + ("\nSELECT pair_id, doc1, doc2, ord, field_name, doc1_value, doc2_value, "
                                      "doc1_confidence, doc2_confidence, are_equal, difference_note FROM (" +
                                      _CMP_LONG + ")")
ORACLE["compare_presence"] = CMP_ALL + f"\nSELECT pair_id, ord, field_name, presence FROM ({_CMP_LONG})"
ORACLE["compare_numeric_diff"] = CMP_ALL + (f"\nSELECT pair_id, field_name, difference_note FROM ({_CMP_LONG}) "
                                            "WHERE difference_note IS NOT NULL")
ORACLE["compare_discrepancies"] = CMP_ALL + (
    f"\nSELECT pair_id, ord, field_name, coalesce(nullif(doc1_value, ''), '—') AS doc1_shown, "
    f"coalesce(nullif(doc2_value, ''), '—') AS doc2_shown, coalesce(difference_note, '') AS difference_note "
    f"FROM ({_CMP_LONG}) WHERE NOT are_equal")
_agree = " + ".join(f"(CASE WHEN eq_{f} THEN 1 ELSE 0 END)" for f in APPRAISAL_FIELDS)
ORACLE["compare_summary"] = CMP_ALL + (
    f"\nSELECT pair_id, doc1, doc2, doc1_name, doc2_name, CAST(37 AS BIGINT) AS total_fields_compared, "
    f"CAST({_agree} AS BIGINT) AS fields_in_agreement, "
    f"CAST({' + '.join(f'(CASE WHEN NOT eq_{f} THEN 1 ELSE 0 END)' for f in APPRAISAL_FIELDS)} AS BIGINT) "
    f"AS fields_with_discrepancy, "
    f"CAST({' + '.join(f'(CASE WHEN pr_{f} = {chr(39)}only_in_doc1{chr(39)} THEN 1 ELSE 0 END)' for f in APPRAISAL_FIELDS)} AS BIGINT) "
    f"AS fields_only_in_doc1, "
    f"CAST({' + '.join(f'(CASE WHEN pr_{f} = {chr(39)}only_in_doc2{chr(39)} THEN 1 ELSE 0 END)' for f in APPRAISAL_FIELDS)} AS BIGINT) "
    f"AS fields_only_in_doc2, {Q.rnd(f'({_agree}) / 37.0::DOUBLE', 4)} AS agreement_rate FROM cmp")
_lines = ", ".join(
    f"CASE WHEN NOT eq_{f} THEN '  - {f}: ''' || coalesce(d1v_{f}, 'None') || ''' vs ''' || "
    f"coalesce(d2v_{f}, 'None') || '''' || coalesce(' (' || note_{f} || ')', '') END" for f in APPRAISAL_FIELDS)
ORACLE["compare_digest"] = CMP_ALL + (
    f"\nSELECT pair_id, CASE WHEN len(kept) = 0 THEN "
    f"'The two documents are in full agreement on all extracted fields.' ELSE array_to_string(kept, chr(10)) END "
    f"AS digest FROM (SELECT pair_id, list_filter([{_lines}], lambda x: x IS NOT NULL)[1:15] AS kept FROM cmp)")

# ------------------------------------------------------------------ document assembly
PAGES_CTE = """pg AS (
  SELECT conv_id AS doc_id, 'conv_' || CAST(conv_id AS VARCHAR) || '.pdf' AS file_name, 'pdfplumber' AS strategy,
         CAST(turn + 1 AS INTEGER) AS page_number, coalesce(text, '') AS raw_text,
         CASE WHEN turn % 3 = 0 THEN [[[role, CASE WHEN turn % 2 = 0 THEN NULL
                                               ELSE CAST(length(text) AS VARCHAR) END]]] END AS tables
  FROM conversations)"""
ORACLE["scan_pages"] = W(PAGES_CTE) + "\nSELECT doc_id, file_name, strategy, page_number, raw_text FROM pg"
ORACLE["page_char_count"] = W(PAGES_CTE) + "\nSELECT doc_id, page_number, length(raw_text) AS char_count FROM pg"
ORACLE["assemble_documents"] = W(PAGES_CTE) + (
    "\nSELECT doc_id, file_name, strategy, string_agg(raw_text, chr(10) || chr(10) || '--- PAGE BREAK ---' || "
    "chr(10) || chr(10) ORDER BY page_number) AS full_text, CAST(sum(length(raw_text)) AS BIGINT) AS total_chars, "
    "count(*) AS page_count FROM pg GROUP BY doc_id, file_name, strategy")
ORACLE["normalise_tables"] = W(PAGES_CTE, """t1 AS (
  SELECT doc_id, page_number, tables, unnest(range(len(tables))) AS ti FROM pg WHERE tables IS NOT NULL)""",
                               """t2 AS (
  SELECT doc_id, page_number, ti, tables[ti + 1] AS tb, unnest(range(len(tables[ti + 1]))) AS ri FROM t1)""",
                               """t3 AS (
  SELECT doc_id, page_number, ti, ri, tb[ri + 1] AS rw, unnest(range(len(tb[ri + 1]))) AS ci FROM t2)""") + (
    "\nSELECT doc_id, page_number, CAST(ti AS INTEGER) AS table_idx, CAST(ri AS INTEGER) AS row_idx, "
    "CAST(ci AS INTEGER) AS col_idx, coalesce(rw[ci + 1], '') AS cell FROM t3")

CAND_CTE = """cand0 AS (
  SELECT doc_id, 'doc_' || CAST(doc_id AS VARCHAR) || '.pdf' AS file_name, 'pdfplumber' AS strategy, 0 AS priority,
         text AS t, CASE WHEN doc_id % 13 = 0 THEN 'pdfplumber: unreadable content stream' END AS error
  FROM documents
  UNION ALL
  SELECT doc_id, 'doc_' || CAST(doc_id AS VARCHAR) || '.pdf', 'pymupdf', 1, trim(text),
         CASE WHEN doc_id % 17 = 0 THEN 'pymupdf: cannot open document' END
  FROM documents),
cand AS (
  SELECT doc_id, file_name, strategy, priority, CASE WHEN error IS NULL THEN t END AS full_text,
         CASE WHEN error IS NULL THEN length(t) END AS total_chars, CASE WHEN error IS NULL THEN 1 END AS page_count,
         error
  FROM cand0)"""


def _choice_sql(policy: str, preferred: str | None = None) -> str:
    p = f"(CASE WHEN strategy = '{preferred}' THEN -1 ELSE priority END)" if preferred else "priority"
    label = "'ExtractionStrategy.' || upper(strategy)"
    short_msg = f"{label} || ' returned only ' || CAST(total_chars AS VARCHAR) || ' chars — trying next strategy'"
    agg = f"""ch AS (
  SELECT doc_id, any_value(file_name) AS file_name, max(p) AS last_p,
    arg_min(p, p) FILTER (WHERE error IS NULL) AS ok_p,
    arg_min(strategy, p) FILTER (WHERE error IS NULL) AS ok_s,
    arg_min(total_chars, p) FILTER (WHERE error IS NULL) AS ok_n,
    arg_min(page_count, p) FILTER (WHERE error IS NULL) AS ok_pc,
    arg_min(strategy, p) FILTER (WHERE error IS NULL AND total_chars >= 50) AS long_s,
    arg_min(total_chars, p) FILTER (WHERE error IS NULL AND total_chars >= 50) AS long_n,
    arg_min(page_count, p) FILTER (WHERE error IS NULL AND total_chars >= 50) AS long_pc,
    arg_min(strategy, p) FILTER (WHERE error IS NULL AND strategy = 'pymupdf') AS end_s,
    arg_min(total_chars, p) FILTER (WHERE error IS NULL AND strategy = 'pymupdf') AS end_n,
    arg_min(page_count, p) FILTER (WHERE error IS NULL AND strategy = 'pymupdf') AS end_pc,
    arg_max(error, p) FILTER (WHERE error IS NOT NULL) AS last_err,
    arg_max(CASE WHEN error IS NOT NULL THEN error ELSE {short_msg} END, p)
      FILTER (WHERE error IS NOT NULL OR total_chars < 50) AS last_fail
  FROM (SELECT *, {p} AS p FROM cand) GROUP BY doc_id)"""
    if policy == "strict":
        sel = f"""SELECT doc_id, file_name,
  CASE WHEN ok_p IS NOT NULL AND NOT (ok_p <> last_p AND ok_n < 50) THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN ok_p IS NOT NULL AND NOT (ok_p <> last_p AND ok_n < 50) THEN ok_s END AS strategy_used,
  CASE WHEN ok_p IS NOT NULL AND NOT (ok_p <> last_p AND ok_n < 50) THEN ok_n END AS total_chars,
  CASE WHEN ok_p IS NOT NULL AND NOT (ok_p <> last_p AND ok_n < 50) THEN ok_pc END AS page_count,
  CASE WHEN ok_p IS NULL THEN 'All PDF extraction strategies failed. Last error: ' || last_err
       WHEN ok_p <> last_p AND ok_n < 50 THEN 'ExtractionStrategy.' || upper(ok_s) || ' returned only ' ||
         CAST(ok_n AS VARCHAR) || ' chars — trying next strategy' END AS error
FROM ch"""
    else:
        take_long = "long_s IS NOT NULL"
        take_last = "(long_s IS NULL AND end_s IS NOT NULL)"
        sel = f"""SELECT doc_id, file_name,
  CASE WHEN {take_long} OR {take_last} THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN {take_long} THEN long_s WHEN {take_last} THEN end_s END AS strategy_used,
  CASE WHEN {take_long} THEN long_n WHEN {take_last} THEN end_n END AS total_chars,
  CASE WHEN {take_long} THEN long_pc WHEN {take_last} THEN end_pc END AS page_count,
  CASE WHEN NOT ({take_long} OR {take_last}) THEN 'All PDF extraction strategies failed. Last error: ' || last_fail
  END AS error
FROM ch"""
    return W(CAND_CTE, agg) + "\n" + sel


ORACLE["choose_strategy"] = _choice_sql("strict")
ORACLE["choose_strategy_fallback"] = _choice_sql("fallback")
ORACLE["choose_strategy_preferred"] = _choice_sql("strict", "pymupdf")
# long enough from the first strategy that gives it, else whatever the last one gives
_first_ok_docs = ("SELECT doc_id, full_text FROM cand WHERE error IS NULL AND (total_chars >= 50 OR priority = 1) "
                  "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY total_chars < 50, priority) = 1")
ORACLE["truncate_text"] = W(CAND_CTE) + (f"\nSELECT doc_id, substring(full_text, 1, 12000) AS text, "
                                         f"length(substring(full_text, 1, 12000)) AS n_chars FROM ({_first_ok_docs})")


def _req_sql(head: str) -> str:
    return (W(CAND_CTE) + f"\nSELECT doc_id, '{head}' || chr(10) || chr(10) || '--- DOCUMENT START ---' || chr(10) || "
            f"substring(full_text, 1, 12000) || (CASE WHEN length(full_text) > 12000 THEN chr(10) || chr(10) || "
            f"'[... document truncated at 12000 chars ...]' ELSE '' END) || chr(10) || '--- DOCUMENT END ---' || "
            f"chr(10) AS request FROM ({_first_ok_docs})")


ORACLE["build_appraisal_request"] = _req_sql("Extract all appraisal fields from the following document text:")
ORACLE["build_loan_request"] = _req_sql(
    "Extract all Form 1003 loan application fields from the following document text:")
ORACLE["document_name"] = """SELECT doc_id, coalesce(
  CASE WHEN doc_id % 2 = 0 THEN 'doc_' || CAST(doc_id AS VARCHAR) || '.pdf' END,
  regexp_extract(CASE WHEN doc_id % 3 <> 0 THEN '/data/' || source || '/scan_' || CAST(doc_id AS VARCHAR) || '.pdf'
                 END, '([^/]+)$', 1),
  'unknown.pdf') AS name FROM documents"""
ORACLE["reject_non_pdf"] = """SELECT doc_id, file_name,
  (file_name IS NOT NULL AND file_name <> '' AND ends_with(lower(file_name), '.pdf')) AS accepted,
  CASE WHEN NOT (file_name IS NOT NULL AND file_name <> '' AND ends_with(lower(file_name), '.pdf'))
       THEN 'File ''' || file_name || ''' is not a PDF. Only .pdf files are accepted.' END AS error
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN ''
             ELSE 'upload_' || CAST(doc_id AS VARCHAR) || (['.pdf', '.PDF', '.txt', '.pdf.zip', ''])[doc_id % 5 + 1]
             END AS file_name FROM documents)"""

# ------------------------------------------------------------------ response decoding


def _q(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN 'null' ELSE '\"' || {x} || '\"' END)"


def _fjson(f: str, reasoning: str = "''") -> str:
    return (f"'{{\"value\":' || {_q(f)} || ',\"confidence\":' || {_q(f + '__c')} || ',\"reasoning\":' || "
            f"{_q(reasoning)} || ',\"source_snippet\":null}}'")


def _render_sql(src: str, names: list[str], variants: dict[int, dict[str, str | None]]) -> str:
    parts = []
    for n in names:
        entry = f"'\"{n}\":' || {_fjson(n)}"
        for code, repl in variants.items():
            if n in repl:
                r = repl[n]
                r_sql = "CAST(NULL AS VARCHAR)" if r is None else "'" + r.replace("'", "''") + "'"
                entry = f"CASE WHEN doc_id % 50 = {code} THEN {r_sql} ELSE {entry} END"
        parts.append(entry)
    b = "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"
    return f"""SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 'Sorry, I cannot extract fields from this document.'
  WHEN doc_id % 50 = 8 THEN '{{}}'
  WHEN doc_id % 50 = 9 THEN substring(b, 1, length(b) - 1) || ',"extra_notes":{{"value":"x"}}}}'
  WHEN doc_id % 50 = 12 THEN '[1,2]' ELSE b END AS json
FROM (SELECT doc_id, {b} AS b FROM {src})"""


RESP_CTE = "resp AS (" + _render_sql("appr", APPRAISAL_FIELDS, {
    1: {"city": '"city":"Springfield"'},
    2: {"state": '"state":null'},
    3: {"county": '"county":["Sangamon"]'},
    4: {"year_built": '"year_built":{"value":1987,"confidence":"high","reasoning":"","source_snippet":null}'},
    5: {"condition_rating": '"condition_rating":{"value":"C3","confidence":"certain","reasoning":""}'},
    6: {"appraiser_name": '"appraiser_name":{"value":"Jane Smith","confidence":"high","reasoning":null}'},
    10: {"property_address": None},
    11: {"lot_size": '"lot_size":{"value":"0.28 acres","confidence":"high","reasoning":"","page":1}'},
}) + ")"
LRESP_CTE = "lresp AS (" + _render_sql("loan", LOAN_FIELDS, {
    1: {"loan_purpose": '"loan_purpose":"Purchase"'},
    3: {"borrower_dob": '"borrower_dob":[]'},
    4: {"credit_score": '"credit_score":{"value":742,"confidence":"high","reasoning":""}'},
    5: {"loan_type": '"loan_type":{"value":"FHA","confidence":"sure","reasoning":""}'},
    10: {"lender_name": None},
}) + ")"
ORACLE["scan_responses"] = W(APPR_CTE, RESP_CTE) + "\nSELECT doc_id, json FROM resp"


def _jx(member: str, f: str) -> str:
    return f"(CASE WHEN json_valid(json) THEN json_extract_string(json, '$.{f}.{member}') END)"


ORACLE["decode_appraisal"] = W(APPR_CTE, RESP_CTE) + "\n" + Q.unnest_fields(
    APPRAISAL_FIELDS, "resp", {"value": _jx("value", "{f}"),
                               "confidence": f"coalesce({_jx('confidence', '{f}')}, 'missing')",
                               "reasoning": f"coalesce({_jx('reasoning', '{f}')}, '')"})


def _strict_sql(resp: str, names: list[str]) -> str:
    paths = ["$"] + [p for n in names for p in (f"$.{n}", *(f"$.{n}.{m}" for m in (
        "value", "confidence", "reasoning", "source_snippet")))]

    def jt(path):
        return f"types[{paths.index(path) + 1}]"

    cols, kept = [], {}
    for i, n in enumerate(names):
        k = f"coalesce({jt(f'$.{n}')} = 'OBJECT', false)"
        tv, tc, tr, ts = (jt(f"$.{n}.{m}") for m in ("value", "confidence", "reasoning", "source_snippet"))
        conf = f"levels[{i + 1}]"
        ok = (f"(({tv} IS NULL OR {tv} IN ('NULL', 'VARCHAR')) AND ({tc} IS NULL OR ({tc} = 'VARCHAR' AND {conf} IN "
              f"('high', 'medium', 'low', 'missing'))) AND ({tr} IS NULL OR {tr} = 'VARCHAR') AND "
              f"({ts} IS NULL OR {ts} IN ('NULL', 'VARCHAR')))")
        cols.append(f"{k} AS k_{n}, ({k} AND NOT {ok}) AS bad_{n}, "
                    f"CASE WHEN {k} THEN coalesce({conf}, 'missing') "
                    f"ELSE 'missing' END AS c_{n}")
        kept[n] = k
    first_bad = "coalesce(" + ", ".join(f"CASE WHEN bad_{n} THEN '{n}' END" for n in names) + ")"
    err = (f"CASE WHEN NOT json_valid(json) THEN 'Unexpected error: response is not valid JSON' "
           f"WHEN {jt('$')} <> 'OBJECT' THEN 'Unexpected error: response is not a JSON object' "
           f"WHEN {first_bad} IS NOT NULL THEN 'Unexpected error: invalid field ' || {first_bad} END")
    counts = ", ".join(
        f"CASE WHEN err IS NULL THEN CAST(" + " + ".join(f"(CASE WHEN c_{n} = '{lv}' THEN 1 ELSE 0 END)" for n in names)
        + f" AS BIGINT) END AS {lv}" for lv in ("high", "medium", "low", "missing"))
    return (f"SELECT doc_id, CASE WHEN err IS NULL THEN 'ok' ELSE 'error' END AS status, err AS error, {counts} "
            f"FROM (SELECT *, {err} AS err FROM (SELECT doc_id, json, types, {', '.join(cols)} FROM ("
            f"SELECT doc_id, json, CASE WHEN json_valid(json) THEN json_type(json, {paths}) END AS types, "
            f"CASE WHEN json_valid(json) THEN json_extract_string(json, {[f'$.{n}.confidence' for n in names]}) END AS levels "
            f"FROM {resp})))")


ORACLE["decode_appraisal_repair"] = W(APPR_CTE, RESP_CTE) + "\n" + _strict_sql("resp", APPRAISAL_FIELDS)
ORACLE["decode_loan"] = W(LOAN_CTE, LRESP_CTE) + "\n" + _strict_sql("lresp", LOAN_FIELDS)

# ------------------------------------------------------------------ labelled extraction + batch roll-up
from ..operators.extract import APPRAISAL_LABELS, loan_label  # noqa: E402
from ..schema import CSV_FIELDS  # noqa: E402

SRC_APPR_CTE = APPR_CTE.replace("appr AS (", "src_appr AS (")
_SUBJECT = [f for f in APPRAISAL_FIELDS if not f.startswith("comp_")]
_COMPF = [f for f in APPRAISAL_FIELDS if f.startswith("comp_")]


def _render_page(head: str, names: list[str], labels) -> str:
    lines = ", ".join(f"CASE WHEN {n} IS NOT NULL THEN '{labels(n)}: ' || {n} END" for n in names)
    return f"concat_ws(chr(10), '{head}', {lines})"


RENDER_CTE = f"""rpages AS (
  SELECT doc_id, file_name, page_number, doc_id % 250 + 40 * page_number + len(page) AS elapsed_ms,
    CASE WHEN doc_id % 97 <> 0 THEN page END AS raw_text,
    CASE WHEN doc_id % 97 = 0 THEN 'pdfplumber: unreadable content stream' END AS error
  FROM (
    SELECT doc_id, file_name, 1 AS page_number,
      {_render_page('UNIFORM RESIDENTIAL APPRAISAL REPORT', _SUBJECT, APPRAISAL_LABELS.get)} AS page
    FROM src_appr
    UNION ALL
    SELECT doc_id, file_name, 2,
      {_render_page('SALES COMPARISON APPROACH', _COMPF, APPRAISAL_LABELS.get)}
    FROM src_appr)),
rdocs AS (
  SELECT doc_id, file_name,
    string_agg(coalesce(raw_text, ''), chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10)
               ORDER BY page_number) AS full_text, max(error) AS error, sum(elapsed_ms)::BIGINT AS elapsed_ms
  FROM rpages GROUP BY doc_id, file_name),
xdocs AS (
  SELECT doc_id, file_name, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status,
    CASE WHEN error IS NOT NULL THEN 'PDF extraction failed: All PDF extraction strategies failed. Last error: '
      || error END AS error,
    CASE WHEN error IS NULL THEN full_text END AS text, elapsed_ms / 1000.0::DOUBLE AS seconds
  FROM rdocs)"""


def _pat(label: str) -> str:
    return f"'(?m)^{label}:[ \\t]*(.*?)[ \\t]*$'"


def _line_pat(label: str) -> str:
    return f"'(?m)^({label}:.*?)[ \\t]*$'"


def _xfields(names, labels, text="text", post=None) -> str:
    out = []
    for n in names:
        lb = labels(n)
        val = f"regexp_extract({text}, {_pat(lb)}, 1)"
        if post and n in post:
            val = post[n](val)
        found = f"regexp_extract({text}, {_pat(lb)}, 1) <> ''"
        out.append(f"CASE WHEN {found} THEN {val} END AS {n}, CASE WHEN {found} THEN 'high' ELSE 'missing' END "
                   f"AS {n}__c, CASE WHEN {found} THEN regexp_extract({text}, {_line_pat(lb)}, 1) END AS {n}__s")
    return ",\n    ".join(out)


XAPPR_CTE = f"""appr AS (
  SELECT doc_id, file_name, {_xfields(APPRAISAL_FIELDS, APPRAISAL_LABELS.get)}
  FROM xdocs)"""

ORACLE["extract_labelled"] = W(SRC_APPR_CTE, RENDER_CTE, XAPPR_CTE) + "\n" + Q.unnest_fields(
    APPRAISAL_FIELDS, "appr", {"value": "{f}", "confidence": "{f}__c", "source_snippet": "{f}__s"}).replace(
    "FROM appr", "FROM appr")

_SSN = "borrower_ssn_last4"
_loan_lines = ", ".join(
    (f"CASE WHEN {n} IS NOT NULL THEN 'Borrower SSN: 900-' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || '-' "
     f"|| {n} END") if n == _SSN else f"CASE WHEN {n} IS NOT NULL THEN '{loan_label(n)}: ' || {n} END"
    for n in LOAN_FIELDS)
LTEXT_CTE = f"""ltext AS (
  SELECT doc_id, concat_ws(chr(10), 'UNIFORM RESIDENTIAL LOAN APPLICATION', {_loan_lines}) AS text FROM loan),
lx AS (
  SELECT doc_id, {_xfields(LOAN_FIELDS, loan_label, post={_SSN: lambda v: f"nullif(regexp_extract({v}, '(\\d{{4}})$', 1), '')"})}
  FROM ltext)"""
ORACLE["extract_labelled_loan"] = W(LOAN_CTE, LTEXT_CTE) + "\n" + Q.unnest_fields(
    LOAN_FIELDS, "lx", {"value": "{f}", "confidence": "{f}__c"})

REP_CTE = """rep AS (
  SELECT c.*, f.comp_quality_score, f.comp_quality_label, f.in_range, f.is_bracketed
  FROM cal c JOIN compf f ON c.doc_id = f.doc_id)"""


def _row_sql(status_src: str | None) -> str:
    ok = "(status = 'success')"

    def blank(x):
        return f"CASE WHEN {ok} THEN {x} ELSE '' END"

    timed = Q.pyfloat("seconds") if status_src == "xdocs" else "'0.0'"
    cols = ["file_name", f"{timed} AS processing_time_s", "status", "coalesce(error, '') AS error"]
    for f in CSV_FIELDS:
        cols.append(f"{blank(f'coalesce({f}, {chr(39)}{chr(39)})')} AS {f}")
        cols.append(f"{blank(f + '__c')} AS {f}_confidence")
    for lv, name in zip(("high", "medium", "low", "missing"), ("high_confidence_count", "medium_confidence_count",
                                                                "low_confidence_count", "missing_count")):
        s = " + ".join(f"(CASE WHEN {n}__c = '{lv}' THEN 1 ELSE 0 END)" for n in APPRAISAL_FIELDS)
        cols.append(f"{blank(f'CAST({s} AS VARCHAR)')} AS {name}")
    cols += [f"{blank(Q.pyround4('score'))} AS reliability_score",
             f"{blank('CAST(n_err AS VARCHAR)')} AS calibration_error_count",
             f"{blank('CAST(n_warn AS VARCHAR)')} AS calibration_warning_count",
             f"{blank(Q.pyround4('comp_quality_score'))} AS comp_quality_score",
             f"{blank('comp_quality_label')} AS comp_quality_label",
             f"{blank(Q.pybool('in_range'))} AS appraised_value_in_comp_range",
             f"{blank(Q.pybool('is_bracketed'))} AS bracketing_satisfied"]
    if status_src is None:
        src = "(SELECT *, 'success' AS status, CAST(NULL AS VARCHAR) AS error FROM rep)"
    else:
        seconds = ", x.seconds" if status_src == "xdocs" else ""
        src = f"(SELECT rep.*, x.status, x.error{seconds} FROM rep JOIN {status_src} x ON rep.doc_id = x.doc_id)"
    return "SELECT doc_id, " + ", ".join(cols) + f" FROM {src}"


ORACLE["batch_rows"] = W(APPR_CTE, VAL_CTE, NUM_CTE, CAL_CTE, COMP_CTE, REP_CTE) + "\n" + _row_sql(None)
_PIPE = W(SRC_APPR_CTE, RENDER_CTE, XAPPR_CTE, VAL_CTE, NUM_CTE, CAL_CTE, COMP_CTE, REP_CTE)
ORACLE["batch_pipeline"] = _PIPE + "\n" + _row_sql("xdocs")
ORACLE["write_batch_csv"] = _PIPE + "\nSELECT * EXCLUDE (doc_id) FROM (" + _row_sql("xdocs") + ")"


def _decoded_cte(name: str, resp: str, names: list[str], kind: str) -> str:
    """name_docs (status and error per response) and name (doc_id, file_name, f, f__c), all missing where decoding failed."""
    fields = ", ".join(
        f"vals[{i}] AS {f}, coalesce(levels[{i}], 'missing') AS {f}__c" for i, f in enumerate(names, 1))
    lists = ", ".join(f"json_extract_string(json, {[f'$.{f}.{m}' for f in names]}) AS {c}"
                      for m, c in (("value", "vals"), ("confidence", "levels")))
    return f"""{name}_strict AS ({_strict_sql(resp, names)}),
{name}_docs AS (
  SELECT d.doc_id, '{kind}_' || d.doc_id || '.pdf' AS file_name, d.error,
         CASE WHEN d.status = 'ok' THEN 'success' ELSE 'error' END AS status,
         CASE WHEN d.status = 'ok' THEN r.json END AS json
  FROM {name}_strict d JOIN {resp} r ON d.doc_id = r.doc_id),
{name} AS MATERIALIZED (SELECT doc_id, file_name, {fields} FROM (SELECT doc_id, file_name, {lists} FROM {name}_docs))"""


def _blank_unless_ok(x: str) -> str:
    return f"CASE WHEN x.status = 'success' THEN {x} ELSE '' END"


ORACLE["response_pipeline"] = W(
    SRC_APPR_CTE, RESP_CTE.replace("FROM appr", "FROM src_appr"),
    _decoded_cte("appr", "resp", APPRAISAL_FIELDS, "appraisal"), VAL_CTE, NUM_CTE, CAL_CTE, COMP_CTE, REP_CTE) + (
    "\n" + _row_sql("appr_docs"))
_LOAN_COLS = ", ".join(f"{_blank_unless_ok(f'coalesce(v.{f}, {chr(39)}{chr(39)})')} AS {f}, "
                       f"{_blank_unless_ok(f'v.{f}__c')} AS {f}_confidence" for f in LOAN_FIELDS)
_LOAN_COUNTS = ", ".join(f"CASE WHEN x.status = 'success' THEN c.{lv} END AS {lv}"
                         for lv in ("high", "medium", "low", "missing"))
ORACLE["loan_pipeline"] = W(
    LOAN_CTE.replace("loan AS (", "src_loan AS ("), LRESP_CTE.replace("FROM loan", "FROM src_loan"),
    _decoded_cte("loan", "lresp", LOAN_FIELDS, "loan"), LVAL_CTE) + (
    f"\nSELECT v.doc_id, v.file_name, x.status, coalesce(x.error, '') AS error, {_LOAN_COLS}, {_LOAN_COUNTS} "
    f"FROM lval v JOIN loan_docs x ON v.doc_id = x.doc_id "
    f"JOIN (SELECT doc_id, {_counts(LOAN_FIELDS)} FROM lval) c ON v.doc_id = c.doc_id")
_PROC = "(SELECT rep.*, x.status, x.error, x.seconds FROM rep JOIN xdocs x ON rep.doc_id = x.doc_id)"
ORACLE["batch_status"] = _PIPE + f"\nSELECT doc_id, file_name, status, coalesce(error, '') AS error FROM {_PROC}"
ORACLE["batch_failures"] = _PIPE + f"\nSELECT doc_id, file_name, error FROM {_PROC} WHERE status = 'error'"
ORACLE["batch_summary"] = _PIPE + (
    f"\nSELECT count(*) AS total, count(CASE WHEN status = 'success' THEN 1 END) AS successes, "
    f"count(CASE WHEN status <> 'success' THEN 1 END) AS failures, coalesce({Q.rnd("avg(seconds)", 6)}, 0.0::DOUBLE) "
    f"AS avg_processing_time_s, {Q.rnd("avg(CASE WHEN status = 'success' THEN coalesce(score, 0.0::DOUBLE) END)", 6)} "
    f"AS avg_reliability_score FROM {_PROC}")
ORACLE["write_reports_json"] = _PIPE + (
    f"\nSELECT doc_id, file_name, status, CASE WHEN status = 'success' THEN score END AS reliability_score, "
    f"CASE WHEN status = 'success' THEN n_err END AS error_count, "
    f"CASE WHEN status = 'success' THEN comp_quality_label END AS comp_quality_label, "
    f"CASE WHEN status = 'success' THEN CAST(" + " + ".join(
        f"(CASE WHEN {n}__c = 'high' THEN 1 ELSE 0 END)" for n in APPRAISAL_FIELDS)
    + f" AS BIGINT) END AS high FROM {_PROC}")

# the lists of the reports: the queries of the same entries, over the documents of the text pipeline that succeeded
_ok_docs = "doc_id IN (SELECT doc_id FROM xdocs WHERE status = 'success')"
for _list, _key, _base in (("flags", "calibration_flags", CAL_ALL), ("field_reliabilities", "field_reliabilities", CAL_ALL),
                           ("comparables", "parse_comparables", COMP_ALL), ("adjustments", "gla_adjustments", COMP_ALL),
                           ("warnings", "comp_warnings", COMP_ALL)):
    ORACLE[f"report_{_list}"] = _PIPE + f"\nSELECT * FROM ({ORACLE[_key].removeprefix(_base)}) WHERE {_ok_docs}"
ORACLE["report_bracketing"] = _PIPE + (
    "\nSELECT doc_id, " + ", ".join(f"{_COMP_REPORT[c]} AS {c}" for c in (
        "subject_implied_ppsf", "comp_ppsf_mean", "adjusted_value_range_low", "is_bracketed", "has_comp_above",
        "has_comp_below", "bracketing_message")) + f" FROM compf WHERE {_ok_docs}")

_desc = ", ".join("'" + d.replace("'", "''") + "'" for _, d in __import__(
    "valuelens.schema", fromlist=["APPRAISAL_FIELDS_WITH_DESCRIPTIONS"]).APPRAISAL_FIELDS_WITH_DESCRIPTIONS)
ORACLE["field_catalogue"] = W(APPR_CTE, VAL_CTE) + (
    f"\nSELECT ord, field_name, ([{_desc}])[ord + 1] AS description, 37 AS total_fields, "
    f"count(CASE WHEN confidence = 'high' THEN 1 END) AS n_high, "
    f"count(CASE WHEN confidence = 'medium' THEN 1 END) AS n_medium, "
    f"count(CASE WHEN confidence = 'low' THEN 1 END) AS n_low, "
    f"count(CASE WHEN confidence = 'missing' THEN 1 END) AS n_missing FROM ("
    + Q.unnest_fields(APPRAISAL_FIELDS, "val", {"confidence": "{f}__c"}) + ") GROUP BY ord, field_name")

# ------------------------------------------------------------------ streaming intake (final table)
ORACLE["incremental_intake"] = ORACLE["decode_appraisal_repair"]
ORACLE["streamed_reports"] = ORACLE["response_pipeline"]
