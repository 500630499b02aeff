"""The text path on small made documents: no cut, configured strategies, failures, sinks that round-trip."""

from __future__ import annotations

import csv
import glob

from pyspark.sql import functions as F

from valuelens.functions import scalar as S
from valuelens.operators import assemble as D
from valuelens.operators import batch as B
from valuelens.operators import extract as EX
from valuelens.schema import CSV_HEADERS

PAGES = ("doc_id long, file_name string, strategy string, priority int, page_number int, raw_text string, "
         "tables array<array<array<string>>>, error string")


def _pages(spark, rows):
    return spark.createDataFrame([(d, f"{d}.pdf", s, p, n, t, None, e) for d, s, p, n, t, e in rows], PAGES)


def test_late_fields_of_a_long_document_are_found(spark):
    long = "x" * 13_000
    pages = _pages(spark, [(1, "pdfplumber", 0, 1, long, None), (1, "pdfplumber", 0, 2, "Comp 1 Sale Price: $472,000", None)])
    row = B.process_pages(pages).select("status", F.col("fields.comp_1_sale_price.value").alias("v")).first()
    assert row["status"] == "success" and row["v"] == "$472,000"


def test_short_first_strategy_fails_though_it_is_the_only_one_there(spark):
    row = D.choose_and_assemble(_pages(spark, [(1, "pdfplumber", 0, 1, "short", None)])).first()
    assert row["status"] == "error" and "returned only 5 chars" in row["error"] and row["full_text"] is None
    last = D.choose_and_assemble(_pages(spark, [(1, "pdfplumber", 0, 1, None, "bad"), (1, "pymupdf", 1, 1, "short", None)])).first()
    assert last["status"] == "ok" and last["full_text"] == "short" and last["strategy_used"] == "pymupdf"


def test_choice_over_pages_equals_choice_over_documents(spark):
    rows = [(d, s, p, n, ("t" * (17 * d % 60 + 1)) * n if (d + p) % 5 else None, None if (d + p) % 5 else "bad")
            for d in range(30) for p, s in enumerate(("pdfplumber", "pymupdf")) for n in (2, 1)]
    pages = _pages(spark, rows)
    for policy in ("strict", "fallback"):
        a = D.choose_and_assemble(pages, policy)
        b = D.choose_strategy(D.assemble_documents(pages), policy)
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_blank_label_is_missing(spark):
    docs = spark.createDataFrame([(1, "a", "City: \nState: IL")], "doc_id long, file_name string, text string")
    r = EX.extract_labelled(docs).select("fields.city.confidence", "fields.city.value", "fields.state.value").first()
    assert tuple(r) == ("missing", None, "IL")


def test_failed_document_has_an_error_and_no_report(spark, tmp_path):
    done = B.process_pages(_pages(spark, [(1, "pdfplumber", 0, 1, None, "unreadable"),
                                          (2, "pdfplumber", 0, 1, "City: Springfield\n" + "x" * 60, None)]))
    B.write_reports_json(done, str(tmp_path / "r"))
    got = {r["doc_id"]: r for r in B.read_reports_json(spark, str(tmp_path / "r"), B.reports(done).schema).collect()}
    assert got[1]["calibration"] is None and got[1]["fields"] is None and "unreadable" in got[1]["error"]
    assert got[2]["calibration"] is not None and got[2]["fields"]["city"]["value"] == "Springfield"


def test_csv_keeps_blanks_quotes_commas_and_newlines(spark, tmp_path):
    value = '  lead, say "hi"\nnext '
    row = {c: "" for c in CSV_HEADERS} | {"file_name": value}
    rows = spark.createDataFrame([tuple(row[c] for c in CSV_HEADERS)], ", ".join(f"`{c}` string" for c in CSV_HEADERS))
    B.write_batch_csv(rows, str(tmp_path / "c"))
    assert B.read_batch_csv(spark, str(tmp_path / "c")).first()["file_name"] == value
    found = []  # an empty first part has only a header
    for part in glob.glob(str(tmp_path / "c" / "*.csv")):
        with open(part, newline="") as f:
            found += [r["file_name"] for r in csv.DictReader(f)]
    assert found == [value]


def test_plain_number_text(spark):
    df = spark.createDataFrame([(0.0004,), (12345678.5,), (12345678.0,), (2.5,)], "v double")
    assert [r[0] for r in df.select(S.py_float_str("v")).collect()] == ["0.0004", "12345678.5", "12345678.0", "2.5"]


def test_scan_folder(spark, tmp_path):
    for n in ("b.pdf", "a.pdf", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r["path"].rsplit("/", 1)[1] for r in B.scan_folder(spark, str(tmp_path)).collect()] == ["a.pdf", "b.pdf"]


def test_document_name(spark):
    df = spark.createDataFrame([("", "/x/y.pdf"), (None, None), ("a", "/b")], "f string, p string")
    assert [r[0] for r in df.select(D.document_name(F.col("f"), F.col("p"))).collect()] == ["y.pdf", "unknown.pdf", "a"]


def test_report_keeps_its_lists_through_json(spark, tmp_path):
    text = "\n".join(["Appraised Value: $500,000", "Above Grade GLA: 2000", "Bedrooms: 0", "Bathrooms: 2", "Comp 1 Address: 1 A St",
                      "Comp 1 Sale Price: $100,000", "Comp 1 GLA: 1900", "Comp 2 Sale Price: $110,000", "Comp 2 GLA: 2000"])
    done = B.process_pages(_pages(spark, [(1, "pdfplumber", 0, 1, text, None), (2, "pdfplumber", 0, 1, None, "bad"),
                                          (3, "pdfplumber", 0, 1, "Zip Code: 1\n" + "x" * 60, None)]))
    B.write_reports_json(done, str(tmp_path / "r"))
    got = {r["doc_id"]: r for r in B.read_reports_json(spark, str(tmp_path / "r"), B.reports(done).schema).collect()}
    assert got[2]["calibration"] is None and got[2]["comp_analysis"] is None
    names = [f["check_name"] for f in got[1]["calibration"]["flags"]]
    assert "value_vs_comp_range" in names and "bedroom_count" in names
    assert [f["flag_ord"] for f in got[1]["calibration"]["flags"]] == sorted(f["flag_ord"] for f in got[1]["calibration"]["flags"])
    by_name = {r["field_name"]: r for r in got[1]["calibration"]["field_reliabilities"]}
    assert len(by_name) == 37 and "bedroom_count" in by_name["number_of_bedrooms"]["adjustment_reason"]
    comps = got[1]["comp_analysis"]["comparables"]
    assert [c["label"] for c in comps] == ["comp_1", "comp_2", "comp_3"] and comps[0]["address"] == "1 A St"
    assert comps[2]["sale_price"] is None
    assert [a["comp"] for a in got[1]["comp_analysis"]["adjustments"]] == ["comp_1", "comp_2"]
    assert got[1]["comp_analysis"]["bracketing"]["is_bracketed"] is False
    assert len(got[1]["comp_analysis"]["warnings"]) == 2
    assert got[3]["comp_analysis"]["adjustments"] == []
    for name, rows in (("flags", len(names)), ("field_reliabilities", 37), ("comparables", 3), ("adjustments", 2),
                       ("warnings", 2)):
        flat = B.report_entries(B.read_reports_json(spark, str(tmp_path / "r"), B.reports(done).schema), name)
        assert flat.filter("doc_id = 1").count() == rows and flat.filter("doc_id = 2").count() == 0


def test_processing_time_is_the_sum_over_pages_and_strategies(spark):
    rows = [(1, "pdfplumber", 0, 1, None, "bad", 1200), (1, "pymupdf", 1, 1, "x" * 60, None, 34), (1, "pymupdf", 1, 2, "y", None, 1000),
            (2, "pdfplumber", 0, 1, "z" * 60, None, None), (3, "pdfplumber", 0, 1, None, "bad", 1)]
    pages = spark.createDataFrame([(d, f"{d}.pdf", s, p, n, t, None, e, ms) for d, s, p, n, t, e, ms in rows], PAGES + ", elapsed_ms long")
    done = B.process_pages(pages)
    got = {r["doc_id"]: r["processing_time_s"] for r in B.report_rows(done).collect()}
    assert got == {1: "2.234", 2: "0.0", 3: "0.001"}
    assert B.batch_summary(done).first()["avg_processing_time_s"] == 0.745
    assert {r["processing_time_s"] for r in B.report_rows(B.process_pages(pages.drop("elapsed_ms"))).collect()} == {"0.0"}
