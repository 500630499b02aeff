"""Row-in / row-out tests of single operators: validation rules, calibration checks,
comparable-sales analysis, parsers, and document comparison."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SAMPLE
from valuelens.functions import scalar as S
from valuelens.operators import calibrate as K
from valuelens.operators import compare as X
from valuelens.operators import comps as C
from valuelens.operators import validate as V


def _with(**over):
    d = dict(SAMPLE)
    d.update(over)
    return d


# ---------------------------------------------------------------- parsers / scalars
def test_parsers(spark):
    df = spark.createDataFrame([("$485,000",), ("2,150",), ("abc",), ("",), (None,), (" 3.5 ",)], "v string")
    got = df.select(S.parse_currency("v").alias("c"), S.parse_float("v").alias("f"),
                    S.parse_int("v").alias("i")).collect()
    assert [r["c"] for r in got] == [485000.0, 2150.0, None, None, None, 3.5]
    assert [r["f"] for r in got] == [None, 2150.0, None, None, None, 3.5]  # '$' is not a float
    assert [r["i"] for r in got] == [None, 2150, None, None, None, 3]


def test_downgrade_never_raises(spark):
    order = {"high": 0, "medium": 1, "low": 2, "missing": 3}
    df = spark.createDataFrame([(c,) for c in order], "c string")
    for r in df.select("c", S.downgrade("c").alias("d")).collect():
        assert order[r["d"]] >= order[r["c"]]
    assert {r["c"]: r["d"] for r in df.select("c", S.downgrade("c").alias("d")).collect()} == {
        "high": "medium", "medium": "low", "low": "low", "missing": "missing"}


# ---------------------------------------------------------------- validation
@pytest.mark.parametrize("field,value,flagged", [
    ("appraised_value", "$500", True),
    ("appraised_value", "$150,000,000", True),
    ("appraised_value", "$485,000", False),
    ("year_built", "1500", True),
    ("year_built", "2999", True),
    ("year_built", "1987", False),
    ("gross_living_area_sqft", "50", True),
    ("gross_living_area_sqft", "60,000", True),
    ("number_of_bedrooms", "25", True),
    ("number_of_bedrooms", "3", False),
    ("year_built", "unknown", False),
])
def test_appraisal_rules(docs, field, value, flagged):
    r = V.validate_one(docs([_with(**{field: value})]), field).first()
    assert r["flagged"] is flagged
    assert r["value"] == value  # the value is kept either way
    if flagged:
        assert r["confidence"] == "medium"
        assert "[VALIDATION WARNING:" in r["reasoning"]
    else:
        assert r["confidence"] == "high"


@pytest.mark.parametrize("field,value,flagged", [
    ("loan_amount", "$5,000", True),
    ("loan_amount", "$350,000", False),
    ("credit_score", "900", True),
    ("credit_score", "720", False),
    ("dti_ratio", "70", True),
    ("dti_ratio", "36", False),
    ("ltv_ratio", "160", True),
    ("interest_rate", "45", True),
    ("interest_rate", "6.5", False),
    ("loan_term_months", "100", True),
    ("loan_term_months", "360", False),
])
def test_loan_rules(docs, field, value, flagged):
    r = V.validate_one(docs([{field: value}], loan=True), field, loan=True).first()
    assert r["flagged"] is flagged


def test_missing_field_is_not_validated(docs):
    r = V.validate_one(docs([_with(year_built=("1500", "missing"))]), "year_built").first()
    assert r["flagged"] is False and r["confidence"] == "missing"


# ---------------------------------------------------------------- calibration
def _flags(df):
    return {r["check_name"]: r for r in K.calibration_flags(df).collect()}


def test_completeness_error_when_empty(docs):
    df = docs([{}])
    f = _flags(df)
    assert f["critical_field_completeness"]["severity"] == "error"
    r = K.calibrate(df).first()
    assert r["reliability_score"] == 0.0 and r["critical_fields_present"] == 0.0


def test_value_vs_comps(docs):
    f = _flags(docs([_with(appraised_value="$1,200,000")]))
    assert f["value_vs_comp_range"]["severity"] == "error"
    f = _flags(docs([_with(appraised_value="$700,000")]))
    assert f["value_vs_comp_range"]["severity"] == "warning"
    assert "value_vs_comp_range" not in _flags(docs([SAMPLE]))


def test_year_vs_condition(docs):
    f = _flags(docs([_with(condition_rating="C1", year_built="1950")]))
    assert f["year_built_vs_condition"]["severity"] == "warning"
    f = _flags(docs([_with(condition_rating="C6", year_built="2024")]))
    assert f["year_built_vs_condition"]["severity"] == "warning"
    assert "year_built_vs_condition" not in _flags(docs([_with(condition_rating="C1", year_built="2025")]))


def test_bedroom_bathroom(docs):
    f = _flags(docs([_with(number_of_bedrooms="0", number_of_bathrooms="2")]))
    assert f["bedroom_count"]["severity"] == "error"
    f = _flags(docs([_with(number_of_bedrooms="1", number_of_bathrooms="4")]))
    assert f["bedroom_bathroom_ratio"]["severity"] == "warning"


def test_prior_sale(docs):
    f = _flags(docs([_with(prior_sale_price="$100,000")]))
    assert f["prior_sale_vs_appraised"]["severity"] == "warning"
    assert "prior_sale_vs_appraised" not in _flags(docs([SAMPLE]))


def test_flagged_fields_are_downgraded(docs):
    df = docs([_with(number_of_bedrooms="0", number_of_bathrooms="2")])
    rel = {r["field_name"]: r for r in K.field_reliabilities(df).collect()}
    assert rel["number_of_bedrooms"]["calibrated_confidence"] == "medium"
    assert rel["number_of_bedrooms"]["adjustment_reason"].startswith("bedroom_count: ")
    assert rel["city"]["calibrated_confidence"] == "high"


# ---------------------------------------------------------------- comps
def test_not_bracketed(docs):
    r = C.analyze_comps(docs([_with(appraised_value="$520,000")])).first()
    assert r["is_bracketed"] is False and r["has_comp_above"] is False
    assert r["bracketing_message"].startswith("No comparable sale exceeds")


def test_no_comps(docs):
    d = {k: v for k, v in SAMPLE.items() if not k.startswith("comp_")}
    r = C.analyze_comps(docs([d])).first()
    assert r["valid_comp_count"] == 0
    assert "No valid comparable sales data found" in r["warnings"]
    assert r["estimated_gla_rate_per_sqft"] is None


def test_rate_needs_two_comps(docs):
    d = {k: v for k, v in SAMPLE.items() if not k.startswith(("comp_2", "comp_3"))}
    r = C.analyze_comps(docs([d])).first()
    assert r["estimated_gla_rate_per_sqft"] is None
    assert "Could not estimate GLA adjustment rate" in r["warnings"]


# ---------------------------------------------------------------- comparison
def test_compare_self_is_full_agreement(spark, docs):
    df = docs([SAMPLE, _with(appraised_value="$490,000", city=(None, "missing"))])
    pairs = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "pair_id long, doc1 long, doc2 long")
    s = {r["pair_id"]: r for r in X.compare_summary(pairs, df).collect()}
    assert s[1]["fields_in_agreement"] == 37 and s[1]["agreement_rate"] == 1.0
    assert s[2]["fields_with_discrepancy"] == 2 and s[2]["fields_only_in_doc1"] == 1
    dig = {r["pair_id"]: r["digest"] for r in X.compare_digest(pairs, df).collect()}
    assert dig[1] == X.FULL_AGREEMENT
    assert "appraised_value: '$485,000' vs '$490,000' (Difference: 5,000.00)" in dig[2]


def test_consecutive_pairs_hot_group_matches_lag(spark):
    """A group holding most rows, split over many buckets, pairs exactly like a plain lag."""
    from pyspark.sql import Window
    rows = spark.range(0, 5000).select(
        F.when(F.col("id") % 10 < 7, F.lit(0)).otherwise(F.col("id") % 13).alias("g"),
        (F.col("id") * 7 + 3).alias("k"))
    got = X.consecutive_pairs(rows, "g", "k", bucket_width=64)
    brute = (rows.withColumn("p", F.lag("k").over(Window.partitionBy("g").orderBy("k")))
             .filter(F.col("p").isNotNull()).select(F.col("p").alias("doc1"), F.col("k").alias("doc2"), "g"))
    assert got.count() == brute.count() == 5000 - rows.select("g").distinct().count()
    assert got.exceptAll(brute).count() == 0 and brute.exceptAll(got).count() == 0


def test_consecutive_documents_equal_the_pair_join(spark, docs):
    """Owners with one and many documents, a hot one over many buckets, none: the same rows as two joins on the pair table."""
    many = docs([SAMPLE, _with(appraised_value="$490,000", city=(None, "missing")), _with(year_built="1990")])
    ids = spark.range(0, 60).select((F.col("id") * 7 + 3).alias("new"), (F.col("id") % 3 + 1).alias("doc_id"),
                                    F.when(F.col("id") % 10 < 6, F.lit(0)).when(F.col("id") % 10 < 9, F.col("id")).alias("ck"))
    many = many.join(ids, "doc_id").select("ck", F.col("new").alias("doc_id"), F.concat("file_name", F.col("new")).alias("file_name"), "fields")
    pairs = X.consecutive_pairs(many.where("ck IS NOT NULL"), "ck", "doc_id", bucket_width=64)
    pairs = pairs.select(F.col("doc2").alias("pair_id"), "doc1", "doc2")
    both = X.consecutive_documents(many, "ck", bucket_width=64)
    for fn in (X.compare_summary, X.compare_long, X.compare_digest):
        a, b = fn(pairs, many), fn(both)
        assert a.columns == b.columns and a.count() == b.count() > 30
        assert a.exceptAll(b).count() == 0
