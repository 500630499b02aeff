"""What keeps time and disk in proportion: pages exchanged once, narrow reads of reports, plain responses without variants."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuelens.operators import assemble as D
from valuelens.operators import batch as B
from valuelens.operators import decode as J
from valuelens.schema import APPRAISAL_FIELDS, LOAN_FIELDS, STRATEGIES

PAGES = "doc_id bigint, file_name string, strategy string, priority int, page_number int, raw_text string, error string, elapsed_ms bigint"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _exchanges(df) -> int:
    return _plan(df).count("Exchange hashpartitioning")


def test_pages_are_exchanged_once_and_texts_are_those_of_the_winner(spark):
    first, second, long = STRATEGIES[0], STRATEGIES[1], "x" * 60
    rows = [(1, "a", first, 0, 2, "two", None, 5), (1, "a", first, 0, 1, long, None, 6), (1, "a", second, 1, 1, "other" + long, None, 7),
            (2, "b", first, 0, 1, None, "broken", 1), (2, "b", second, 1, 1, "short", None, 1),
            (3, "c", first, 0, 1, None, "broken", 1), (3, "c", second, 1, 1, None, "broken too", 1),
            (4, "d", first, 0, 1, long, None, 1), (4, "e", first, 0, 1, long + "e", None, 1), (4, "e", first, 3, 1, "e3", None, 1),
            (5, "f", first, 0, 1, None, None, 1),
            (None, "g", first, 0, 1, long, None, 1), (6, "h", None, 0, 1, long, None, 1), (7, None, second, 1, None, long, None, None)]
    got = D.choose_and_assemble(spark.createDataFrame(rows, PAGES))
    assert _exchanges(got) <= 1
    found = sorted(((r.doc_id, r.file_name, r.status, r.strategy_used, r.full_text, r.elapsed_ms) for r in got.collect()), key=repr)
    assert found == sorted([
        (1, "a", "ok", first, long + D.PAGE_SEPARATOR + "two", 18), (2, "b", "ok", second, "short", 2), (3, "c", "error", None, None, 2),
        (4, "d", "ok", first, long, 3), (4, "d", "ok", first, long + "e", 3), (4, "d", "ok", first, "e3", 3),
        (5, "f", "error", None, None, 1), (None, "g", "ok", first, None, 1), (6, "h", "ok", None, None, 1),
        (7, None, "ok", second, long, None)], key=repr)


def test_reports_are_read_with_the_members_asked_for(spark, tmp_path):
    inner = T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.StringType())])
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("a", inner), T.StructField("b", inner)])
    part = B.members(schema, "b.y", "doc_id")
    assert part.simpleString() == "struct<doc_id:bigint,b:struct<y:string>>"
    assert B.members(schema, "a", "a.x").simpleString() == "struct<a:struct<x:bigint,y:string>>"
    spark.createDataFrame([(1, (2, "p"), (3, "q")), (2, None, None)], schema).write.json(f"{tmp_path}/r")
    assert sorted(B.read_reports_json(spark, f"{tmp_path}/r", part).select("doc_id", "b.y").collect()) == [(1, "q"), (2, None)]
    assert B.entry_paths("adjustments") == ["doc_id", "comp_analysis.adjustments", "comp_analysis.estimated_gla_rate_per_sqft"]


def _by_the_whole_rule(spark, rows, names, monkeypatch):
    """The decode with no response taken as plain."""
    with monkeypatch.context() as m:
        m.setattr(J, "PLAIN_CHARS", 0)
        return J.decode_repair(rows, names).collect()


def _field(value="v", confidence="high", reasoning="", snippet=None, **more):
    return {"value": value, "confidence": confidence, "reasoning": reasoning, "source_snippet": snippet} | more


def test_plain_responses_decode_as_by_the_whole_rule(spark, monkeypatch):
    for names in (APPRAISAL_FIELDS, LOAN_FIELDS):
        a, b = names[0], names[1]
        ok = {n: _field() for n in names}
        plain = [ok, {}, {a: _field(None, "low", "é 日本 😀", "it's")}, {b: {}}, {a: {"reasoning": "r"}, b: {"value": "", "source_snippet": ""}}]
        texts = [json.dumps(x, ensure_ascii=False, **how) for x in plain for how in ({}, {"indent": 1}, {"separators": (",", ":")})]
        n_plain = len(texts)
        odd = [ok | {a: "text"}, ok | {a: None}, ok | {a: ["x"]}, ok | {a: _field(7)}, ok | {a: _field(confidence="sure")}, ok | {a: _field(confidence=None)},
               ok | {a: _field(reasoning=None)}, ok | {a: _field(more=1)}, ok | {"extra": _field()}, {b: _field(), a: _field()},
               {a: {"confidence": "high", "value": "x"}}, {a: _field('say "x"\n\\')}, {a: _field("�")}, {a: _field(True)}, [1, 2], "text", 3, None]
        texts += [json.dumps(x, ensure_ascii=False) for x in odd]
        texts += [None, "", " ", "{", "{}}", "Sorry", f'{{"{a}":{{"value":"1","value":"2"}}}}', f'{{"{a}":{{}},"{a}":{{}}}}', f'{{"{a}":{{}},}}',
                  f'{{"{a}":{{"value":"x",}}}}', f'{{,"{a}":{{}}}}', f'{{"{a}":{{"value":"\\u00e9"}}}}', f'{{"{a}":{{"value":"a\tb"}}}}',
                  f'{{"{a}":{{"value":\'x\'}}}}', f'﻿{{"{a}":{{}}}}', f'{{"{a}":{{}}}} x', f'{{"{a}":{{}}}}\n\n', f'{{"{a}" "{b}":{{}}}}']
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, json string")
        assert J.decode_repair(rows, names).collect() == _by_the_whole_rule(spark, rows, names, monkeypatch)
        told = {r.doc_id for r in rows.where(F.col("json").rlike(J.plain_pattern(names))).collect()}
        assert set(range(n_plain)) <= told and all(i < n_plain or texts[i].endswith("\n\n") for i in told)


def test_long_strings_and_deep_responses_need_no_stack(spark):
    text = '{"%s":{"value":"%s"}}' % (APPRAISAL_FIELDS[0], "x y" * 100_000)
    rows = spark.createDataFrame([(1, text), (2, text[:-1]), (3, "[" * 900 + "]" * 900)], "doc_id bigint, json string")
    got = J.decode_repair(rows).select("doc_id", "status", F.length(f"fields.{APPRAISAL_FIELDS[0]}.value").alias("n")).collect()
    assert [tuple(r) for r in got] == [(1, "ok", 300_000), (2, "error", None), (3, "error", None)]
