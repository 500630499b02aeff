"""What keeps work and disk in proportion: entries made below generators, compressed files, narrow rows in the stream's exchange."""

from __future__ import annotations

import glob
import re

from pyspark.sql import functions as F

from conftest import SAMPLE
from valuelens.functions import scalar as S
from valuelens.operators import batch as B
from valuelens.operators import calibrate as K
from valuelens.operators import compare as X
from valuelens.operators import decode as J
from valuelens.operators import extract as E
from valuelens.operators import records as R
from valuelens.operators import validate as V
from valuelens.streaming import intake as ST


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_entries_are_projected_below_the_generator(docs):
    d = docs([SAMPLE, SAMPLE])
    both = X.consecutive_documents(d.withColumn("g", F.lit(1)), "g")
    for df in (R.fields_long(d), K.field_reliabilities(d), X.compare_long(both)):
        plan = _plan(df)
        assert re.search(r"Generate inline\(_entries#\d+\)", plan) and "Filter (size(" not in plan


def test_white_space_is_that_of_regular_expressions(spark):
    df = spark.createDataFrame([(chr(i),) for i in range(1, 0x3100)], "c string").withColumn("t", F.concat("c", F.lit("A"), "c", "c", F.lit("b"), "c"))
    trimmed = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    lower = F.regexp_replace(F.regexp_replace(F.lower("t"), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    bare = F.regexp_replace("t", r"(?U)[,$\s]", "")
    wrong = df.where((S.strip_ends("t") != trimmed) | (S.normalise_text("t") != lower) | (S.without_chars("t", ",$" + S.WHITE) != bare))
    assert wrong.collect() == []


def test_equal_texts_and_missing_values_compare_as_before(docs):
    d = docs([{"city": "A  b", "state": (None, "low")}, {"city": "a b ", "state": ("", "low")}, {"city": "a c", "state": ("", "low")}])
    rows = X.compare_long(X.consecutive_documents(d.withColumn("g", F.lit(1)), "g")).where("field_name IN ('city', 'state')")
    assert sorted((r["pair_id"], r["field_name"], r["are_equal"]) for r in rows.collect()) == [
        (2, "city", True), (2, "state", True), (3, "city", False), (3, "state", True)]


def test_reports_and_landed_responses_are_compressed(spark, docs, tmp_path):
    B.write_reports_json(B.analysed(V.post_validate(docs([SAMPLE]))).withColumns({"status": F.lit("success"), "error": F.lit(None).cast("string")}),
                         str(tmp_path / "r"))
    ST.land(spark.createDataFrame([(1, "{}")], "doc_id long, json string"), str(tmp_path / "l"))
    for d in ("r", "l"):
        files = glob.glob(str(tmp_path / d / "part-*"))
        assert files and all(f.endswith(".json.gz") for f in files)


def test_redelivered_responses_are_decoded_before_the_exchange(spark):
    rows = spark.createDataFrame([(1, "{}"), (1, "{}"), (None, "{}"), (None, "[1]"), (None, "[1]")], "doc_id long, json string")
    once = ST.once_per_document(rows, lambda r: ST.decoded_counts(r, "_key"))
    assert once.columns == ["doc_id", "status", "error", "high", "medium", "low", "missing"]
    assert sorted((r["doc_id"] or 0, r["status"]) for r in once.collect()) == [(0, "error"), (0, "ok"), (1, "ok")]


def test_plain_numbers_are_told_before_separators_are_taken_out(spark):
    texts = ["$485,000", "1,2.50", "7", "12 ", " 3", "1\n", "1\x85", "$$1", "1%", "5,%", "-4", "+.5", "2.", "1e3", "1e309", "9" * 61, "9" * 62,
             "9" * 400, "1" * 61 + "." + "2" * 61, "١", "2,150 sq ft", "N/A", "nan", "1d", "0x1p3", "$", ",", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    slow = {S.parse_currency: S.without_chars("v", ",$" + S.WHITE), S.parse_float: S.without_chars("v", "," + S.WHITE),
            S.parse_rule_number: S.strip_ends(S.without_chars("v", ",$")), S.parse_loan_rule_number: S.strip_ends(S.without_chars("v", ",$%"))}
    for parse, clean in slow.items():
        assert df.where(~parse("v").eqNullSafe(S.to_double(clean))).collect() == []
        assert re.search(r"CASE WHEN RLIKE\(v#\d+, \^", _plan(df.select(parse("v"))).replace("cast(", ""))


def test_label_searches_begin_with_the_label(spark):
    assert all(p.startswith("(?m)City:(?<=^") for p in (E.label_pattern("City"), E.rest_pattern("City")))
    texts = ["City: a", "x City: a", "x\nCity:  a b \t\nCity: c", "x\rCity: a", "x\r\nCity: a\r\n", "x\x85City: a", "City:\nCity: b", "City:  ", "city: a", ""]
    df = spark.createDataFrame([(i, "f", t) for i, t in enumerate(texts)], "doc_id long, file_name string, text string")
    got = {r[0]: r[1:] for r in E.extract_labelled(df).select("doc_id", "fields.city.value", "fields.city.source_snippet").collect()}
    none = (None, None)
    assert [got[i] for i in range(len(texts))] == [("a", "City: a"), none, ("a b", "City:  a b"), ("a", "City: a"), ("a", "City: a"),
                                                   ("a", "City: a"), none, none, none, none]


def test_strict_decode_reads_each_type_once_and_none_of_the_root(spark):
    roots = {"{}": None, "[1]": J.ERR_NOT_OBJECT, "null": J.ERR_NOT_OBJECT, "1": J.ERR_NOT_OBJECT, '"{}"': J.ERR_NOT_OBJECT, "{": J.ERR_NOT_JSON,
             '{"city":1}': None, '{"city":{}}': None, '{"city":{"value":null,"source_snippet":null}}': None,
             **{f'{{"city":{{"{m}":{v}}}}}': J.ERR_FIELD + "city" for m, v in (("value", 1), ("confidence", "null"), ("confidence", '"sure"'),
                                                                               ("reasoning", "null"), ("source_snippet", "[]"))}}
    df = spark.createDataFrame(list(enumerate(roots)), "doc_id long, json string")
    out = J.decode_repair(df, ["city", "state"])
    assert [r["error"] for r in out.orderBy("doc_id").collect()] == [*roots.values()]
    assert len(re.findall(r"schema_?of_?variant\(", out._jdf.queryExecution().analyzed().toString(), re.I)) == 8


def test_records_are_not_made_for_readers_of_members(spark):
    """Long entries read columns, not a record that each step makes anew."""
    from conftest import SMALL
    from valuelens.plans.catalog import REGISTRY
    for name in ("field_view", "post_validate", "post_validate_loan", "decode_appraisal", "adjusted_range", "comp_warnings"):
        assert not re.search(r"fields#\d+\.", _plan(REGISTRY[name](spark, SMALL))), name


def test_null_records_and_fields_stay_null(spark):
    member = "struct<value:string,confidence:string,reasoning:string,source_snippet:string>"
    names = ("appraised_value", "year_built", "gross_living_area_sqft", "number_of_bedrooms", "city")
    rows = [(1, None), (2, (None, ("1500", "high", None, "s"), ("2,000", "low", "r", None), None, ("", "high", "", None)))]
    df = spark.createDataFrame(rows, f"doc_id long, fields struct<{','.join(f'{n}:{member}' for n in names)}>")
    got = {r["doc_id"]: r["fields"] for r in V.post_validate(df).collect()}
    assert got[1] is None and got[2]["appraised_value"] is None and got[2]["number_of_bedrooms"] is None
    assert tuple(got[2]["year_built"]) == ("1500", "medium", " [VALIDATION WARNING: year_built 1500.0 is out of plausible range]", "s")
    assert tuple(got[2]["gross_living_area_sqft"]) == ("2,000", "low", "r", None) and got[2]["city"]["value"] == ""


def test_warnings_are_listed_without_text(docs):
    from valuelens.operators import comps as C
    d = docs([SAMPLE, {}, {**SAMPLE, "appraised_value": "$900,000"}])
    text = {r["doc_id"]: r["warnings"].split("\n") if r["warnings"] else [] for r in C.analyze_comps(d).collect()}
    rows = C.comp_warnings(d)
    assert sorted(map(tuple, rows.collect())) == sorted((k, i, w) for k, ws in text.items() for i, w in enumerate(ws))
    assert text[1] == [] and len(text[3]) == 2 and "split(" not in _plan(rows)
