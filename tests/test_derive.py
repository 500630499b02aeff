"""The derivation of appraisals from orders and line items."""

from __future__ import annotations

from collections import defaultdict

from conftest import SMALL

from valuelens.sources import derive


def test_every_line_is_read_once(spark):
    lines = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").collect():
        lines[r["l_orderkey"]].append((r["l_linenumber"], r["l_partkey"], r["l_suppkey"], r["l_extendedprice"]))
    orders = [r[0] for r in spark.read.parquet(f"{SMALL}/orders.parquet").select("o_orderkey").collect()]
    want = {}
    for k in orders:
        parts = [f"{x[1]} Oak Ave" for x in sorted(lines[k])]
        for n in range(max(1, -(-len(parts) // 3))):
            want[n * derive.PART_STEP + k] = (parts[3 * n:3 * n + 3] + [None] * 3)[:3]
    whole = derive.appraisals(spark, SMALL)
    got = whole.select("doc_id", *[f"fields.comp_{i}_address.value" for i in (1, 2, 3)]).collect()
    assert len(got) == len(want) and {r[0]: list(r[1:]) for r in got} == want
    assert sum(v is not None for r in got for v in r[1:]) == sum(len(lines[k]) for k in orders) > 3 * len(orders)
    assert whole.select("file_name").distinct().count() == len(want)
    owners = derive.document_owners(spark, SMALL)
    assert sorted(r["doc_id"] for r in owners.collect()) == sorted(want)


def test_hot_orders_rank_as_others(spark, monkeypatch):
    """An order with a third of all lines, and null and repeated line numbers."""
    rows = [(k, k % 7, 1 + k % 3, 10.0 * (k % 11), k % 5 if k % 13 else None, 1.0 * k) for k in range(400)]
    rows += [(7, 9000 - 31 * i, i % 4, 1.0 * i, 1 + i % 6 if i % 17 else None, 1.0 * i) for i in range(200)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, "
                                        "l_linenumber int, l_quantity double")
    want = derive.order_comps(lines).collect()
    monkeypatch.setattr(derive, "HOT_ORDER", 50)
    got = derive.order_comps(lines).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(r["n_lines"] for r in got) == len(rows)


def test_documents_of_hot_orders_are_those_of_the_other_path(spark, monkeypatch):
    """Every order of more than three lines as a hot one; hot orders are told exactly, also when their bucket has others."""
    want = derive.appraisals(spark, SMALL, owner=True)
    rows = sorted(map(str, want.collect()))
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    monkeypatch.setattr(derive, "HOT_ORDER", 3)
    monkeypatch.setattr(derive, "HOT_BUCKETS", 64)
    many = {r[0] for r in lines.groupBy("l_orderkey").count().filter("count > 3").collect()}
    assert many and {r[0] for r in derive.hot_orders(lines).collect()} == many
    assert sorted(map(str, derive.appraisals(spark, SMALL, owner=True).collect())) == rows


def test_lines_of_an_order_stay_where_they_were_ranked(spark):
    """No exchange above the ranking and the join, other than that of hot orders by part."""
    plan = derive.appraisals(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("RepartitionByExpression [o_orderkey")
    assert plan.count("RepartitionByExpression [k#") == 1 and "Join LeftOuter" in plan
    few = plan[plan.index("Join LeftOuter"):plan.index("RepartitionByExpression [l_orderkey")]
    assert "Window" in few and "Aggregate" not in few.split("Window")[0].split("Relation")[-1]
