"""Document tables derived from the benchmark tables (FIXTURES.md section 2).

The test corpus holds no appraisal text, so appraisals are derived from an order
and its line items (the comparable sales): one appraisal per three consecutive
lines, so that every line is read; loan applications are derived from an order
and its customer.  The derivation is a Spark job over the whole tables, so its
cost grows with the data:

* lineitem -> rank of a line in its order: ``row_number`` over ``l_orderkey``.
  Orders of more than HOT_ORDER lines are ranked by range instead: lines per
  (order, line-number and part range), running sums over an order's ranges, and
  ``row_number`` inside a range, so that no order meets in one task.
* pivot of three lines: an aggregate by (order, part); of a hot order each part is
  a group of its own.
* orders LEFT JOIN comps on the order key (sort-merge or AQE broadcast by size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import APPRAISAL_FIELDS, LOAN_FIELDS
from ..session import read_table

COMP_SLOTS = (1, 2, 3)
#: Order keys are below it.
PART_STEP = 1 << 40
#: Lines above which an order is ranked by ranges, and the width of a range in part keys.
HOT_ORDER = 100_000
RANGE_PARTS = 4096
#: Buckets of orders in which lines are counted to find hot orders.
HOT_BUCKETS = 1 << 16


def _money(x: Column) -> Column:
    """'$' + thousands-grouped floor(x + 0.5)."""
    return F.concat(F.lit("$"), F.format_number(F.floor(x + F.lit(0.5)), 0))


def _num(x: Column) -> Column:
    return F.format_number(x, 0)


def _tenths(m: Column, suffix: str = "") -> Column:
    """Integer m rendered as m/10 with one decimal, built from integers (no float text)."""
    return F.concat(F.floor(m / 10).cast("string"), F.lit("."), (m % 10).cast("string"), F.lit(suffix))


def field(value: Column | None, present: Column | None = None, confidence: Column | None = None) -> tuple[Column, Column | None]:
    """Value and, if it does not follow from the value, confidence of one field; an absent value is null."""
    if value is None:
        value = F.lit(None)
    if present is not None:
        value = F.when(present, value)
    return value.cast("string"), confidence


def records(base: DataFrame, fields: dict[str, tuple[Column, Column | None]], names: list[str], *keep: Column) -> DataFrame:
    """The columns kept and the record struct; a field that is not given is (null, 'missing', '', null).

    Values are projected first, then confidences as members of one column, below the structs.  A struct whose members are columns
    or members of columns is never made for readers of its members; one with expressions would be made whole, or rendered by each."""
    staged = base.withColumns({f"_v_{n}": value for n, (value, _) in fields.items()})
    staged = staged.withColumn("_c", F.struct(*[
        (F.when(F.col(f"_v_{n}").isNotNull(), F.col("_cp")).otherwise(F.lit("missing")) if confidence is None else confidence).alias(n)
        for n, (_, confidence) in fields.items()]))
    structs = []
    for n in names:
        value, confidence = F.lit(None).cast("string"), F.lit("missing")
        if n in fields:
            value, confidence = F.col(f"_v_{n}"), F.col("_c").getField(n)
        structs.append(F.struct(value.alias("value"), confidence.alias("confidence"), F.lit("").alias("reasoning"),
                                F.lit(None).cast("string").alias("source_snippet")).alias(n))
    return staged.select(*keep, F.struct(*structs).alias("fields"))


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def hot_orders(lines: DataFrame) -> DataFrame:
    """(l_orderkey) of orders with more than HOT_ORDER lines, at most one a HOT_ORDER lines, so they can be broadcast.

    Lines are counted by bucket of orders first, which leaves a row a bucket and task to exchange; only orders of a bucket
    that has so many lines are counted by themselves."""
    keyed = lines.select("l_orderkey", F.pmod(F.hash("l_orderkey"), F.lit(HOT_BUCKETS)).alias("_bucket"))
    full = keyed.groupBy("_bucket").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_ORDER).select("_bucket")
    return (keyed.join(F.broadcast(full), "_bucket", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))
            .filter(F.col("n") > HOT_ORDER).select("l_orderkey"))


def _few(lines: DataFrame) -> DataFrame:
    """Comps of orders that are not hot: a line and the two after it, from every third line."""
    here = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    at = {i: (lambda c, i=i: F.lead(c, i - 1).over(here)) for i in COMP_SLOTS[1:]}
    more = [F.when(at[i](F.lit(1)).isNotNull(), 1).otherwise(0) for i in at]
    slots = [c for i in at for c in (at[i]("l_partkey").alias(f"p{i}"), at[i]("l_quantity").alias(f"q{i}"))]
    rows = lines.select("l_orderkey", F.row_number().over(here).alias("rn"), (F.lit(1) + more[0] + more[1]).alias("n_lines"),
                        F.col("l_partkey").alias("p1"), F.col("l_quantity").alias("q1"), *slots)
    return (rows.filter("(rn - 1) % 3 = 0").withColumn("part", F.expr("(rn - 1) div 3"))
            .select("l_orderkey", "part", "n_lines", *[f"{c}{i}" for i in COMP_SLOTS for c in "pq"]))


def _many(lines: DataFrame) -> DataFrame:
    """Comps of hot orders, whose lines are ranked by ranges."""
    # ranges follow the order: line number first, then part
    at = ["l_orderkey", "l_linenumber", "range"]
    many = lines.withColumn("range", F.floor(F.col("l_partkey") / RANGE_PARTS))
    sizes = many.groupBy(*at).agg(F.count("*").alias("here"))
    through = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "range")
    sizes = sizes.select(*[F.col(c).alias(f"_{c}") for c in at], (F.sum("here").over(through) - F.col("here")).alias("before"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in at]
    many = many.withColumn("rn", F.row_number().over(Window.partitionBy(*at).orderBy(*LINE_ORDER))).join(sizes, same)
    many = many.withColumn("rn", (F.col("rn") + F.col("before")))
    top = many.withColumn("part", F.expr("(rn - 1) div 3")).withColumn("rn", F.expr("int((rn - 1) % 3 + 1)"))
    aggs = [F.max("rn").alias("n_lines")]
    for i in COMP_SLOTS:
        aggs.append(F.max(F.when(F.col("rn") == i, F.col("l_partkey"))).alias(f"p{i}"))
        aggs.append(F.max(F.when(F.col("rn") == i, F.col("l_quantity"))).alias(f"q{i}"))
    return top.groupBy("l_orderkey", "part").agg(*aggs)


def _lines(lineitem: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The hot orders, to be broadcast, the lines of the others and their lines."""
    lines = lineitem.select("l_orderkey", *LINE_ORDER, "l_quantity")
    hot = F.broadcast(hot_orders(lineitem))
    return hot, lines.join(hot, "l_orderkey", "left_anti"), lines.join(hot, "l_orderkey", "left_semi")


def order_comps(lineitem: DataFrame) -> DataFrame:
    """Three lines of an order as one row: (l_orderkey, part, n_lines, p1..p3, q1..q3); part n has lines 3n+1 to 3n+3."""
    _, few, many = _lines(lineitem)
    return _few(few).unionByName(_many(many))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Source rows dealt evenly over all tasks, before they become records.

    A record is dozens of times as wide and costly as its source row, so neither the splits of the source files nor the
    sizes that adaptive coalescing goes by say how much work a task gets; lines of one large order share a task as well.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys)


def document_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ck, doc_id) of every derived appraisal: its customer, without ranking the lines."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    last = F.greatest(F.lit(0).cast("long"), F.expr("(coalesce(n, 0) + 2) div 3 - 1"))
    return (orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
            .select(F.col("o_custkey").alias("ck"), "o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
            .select("ck", (F.col("part") * PART_STEP + F.col("o_orderkey")).alias("doc_id")))


def _order_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their comps, one row a part.

    Lines and orders are dealt by order once and stay there for ranking, comps, join and records; a number of partitions that
    is asked for is not coalesced by size.  Only hot orders are dealt by part."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    hot, few, many = _lines(read_table(spark, sf_dir, "lineitem"))
    is_hot = F.col("o_orderkey") == hot["l_orderkey"]
    same = F.col("o_orderkey") == F.col("l_orderkey")
    rows = spread(orders.join(hot, is_hot, "left_anti"), "o_orderkey").join(_few(spread(few, "l_orderkey")), same, "left")
    large = orders.join(hot, is_hot, "left_semi").join(_many(many), same)
    return _base(rows).unionByName(spread(_base(large), "k", "part"))


def _base(rows: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    ck = F.col("o_custkey")
    return rows.select(
        (F.coalesce("part", F.lit(0).cast("long")) * PART_STEP + k).alias("doc_id"),
        k.alias("k"), ck.alias("ck"), F.col("o_totalprice").alias("v"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("od"),
        (F.lit(800) + F.lit(40) * (F.lit(1) + k % 50)).cast("double").alias("g"),
        F.when(ck % 8 == 0, F.lit(2.2)).when(ck % 8 == 1, F.lit(1.6)).otherwise(F.lit(1.0)).alias("f"),
        F.when(k % 9 == 0, F.lit("medium")).when(k % 9 == 1, F.lit("low")).otherwise(F.lit("high"))
        .alias("_cp"),
        F.coalesce("part", F.lit(0).cast("long")).alias("part"),
        F.coalesce(F.col("n_lines"), F.lit(0)).alias("n_lines"),
        *[F.col(f"p{i}") for i in COMP_SLOTS], *[F.col(f"q{i}") for i in COMP_SLOTS])


def appraisal_field_columns() -> dict[str, tuple[Column, Column | None]]:
    """Fields of the derived appraisal, keyed by field name (base columns in scope)."""
    k, ck, v, g, f = (F.col(c) for c in ("k", "ck", "v", "g", "f"))
    nulled = k % 20 == 19
    sparse = (k % 20 == 9) | nulled
    cols = {
        "property_address": field(F.concat(k.cast("string"), F.lit(" Main St")), ~nulled),
        "city": field(F.lit(""), k % 13 == 4, F.when(k % 13 == 4, F.lit("high")).otherwise(F.lit("missing"))),
        "state": field(None, confidence=F.when(k % 17 == 0, F.lit("low")).otherwise(F.lit("missing"))),
        "appraised_value": field(
            F.when(k % 1000 == 7, F.lit("$500")).when(k % 1000 == 8, F.lit("$250,000,000"))
            .when(k % 1000 == 10, F.lit("N/A")).otherwise(_money(v)),
            confidence=F.when(k % 211 == 6, F.lit("missing")).otherwise(F.col("_cp"))),
        "effective_date_of_appraisal": field(F.col("od"), ~sparse),
        "appraiser_name": field(F.lit("Jane Smith"), ~sparse),
        "gross_living_area_sqft": field(
            F.when(k % 997 == 3, F.lit("50")).when(k % 997 == 4, F.lit("60,000"))
            .when(k % 101 == 5, F.lit("2,150 sq ft")).otherwise(_num(g))),
        "year_built": field(F.when(k % 500 == 11, F.lit("circa 1950"))
                            .otherwise((F.lit(1900) + ck % 140).cast("string")), ~nulled),
        "property_type": field(F.lit("Single Family"), ~sparse),
        "number_of_bedrooms": field(F.when(k % 700 == 13, F.lit("25")).otherwise((ck % 7).cast("string")),
                                    ~nulled),
        "number_of_bathrooms": field(_tenths((k % 11) * 5)),
        "condition_rating": field(F.concat(F.lit("C"), (F.lit(1) + k % 6).cast("string"))),
        "prior_sale_price": field(_money(v * (F.lit(0.3) + (ck % 20) / F.lit(10.0))), k % 5 != 0),
    }
    for i in COMP_SLOTS:
        has = F.col("n_lines") >= i
        q = F.col(f"q{i}")
        price = _money(v * f * (F.lit(0.85) + q / F.lit(165.0)))
        gla = _num(g - F.lit(100.0) + F.lit(4.0) * q)
        if i == 1:
            price = F.when(k % 307 == 1, F.lit("$0")).otherwise(price)
        if i == 2:
            gla = F.when(k % 401 == 2, F.lit("0")).otherwise(gla)
        cols[f"comp_{i}_address"] = field(F.concat(F.col(f"p{i}").cast("string"), F.lit(" Oak Ave")), has)
        cols[f"comp_{i}_sale_price"] = field(price, has)
        cols[f"comp_{i}_gla"] = field(gla, has)
    return cols


def appraisals(spark: SparkSession, sf_dir: str, owner: bool = False) -> DataFrame:
    """(doc_id, file_name, fields): one derived appraisal per three lines of an order; an order without lines has one.
    With owner, its customer ck comes first.

    Part n has doc_id ``n * PART_STEP + o_orderkey``; parts after the first have their number in the file name.
    """
    part = F.when(F.col("part") > 0, F.concat(F.lit("_"), F.col("part").cast("string"))).otherwise("")
    return records(
        _order_base(spark, sf_dir), appraisal_field_columns(), APPRAISAL_FIELDS,
        *([F.col("ck")] if owner else []), F.col("doc_id"),
        F.concat(F.lit("appraisal_"), F.col("k").cast("string"), part, F.lit(".pdf")).alias("file_name"))


def loan_field_columns() -> dict[str, tuple[Column, Column | None]]:
    k, ck, v = F.col("k"), F.col("ck"), F.col("v")
    bal = F.abs(F.col("c_acctbal"))
    terms = F.array(*[F.lit(t) for t in (60, 120, 180, 240, 300, 360, 480)])
    return {
        "loan_amount": field(F.when(k % 300 == 1, F.lit("$9,999")).when(k % 300 == 2, F.lit("$10,000"))
                             .when(k % 300 == 3, F.lit("$50,000,001")).when(k % 300 == 4, F.lit("$50,000,000"))
                             .otherwise(_money(v * F.lit(3.0)))),
        "loan_purpose": field(F.when(k % 3 == 0, F.lit("Purchase")).when(k % 3 == 1, F.lit("Refinance"))
                              .otherwise(F.lit("Construction"))),
        "loan_type": field(F.element_at(F.array(F.lit("Conventional"), F.lit("FHA"), F.lit("VA"), F.lit("USDA")),
                                        (k % 4 + 1).cast("int"))),
        "amortization_type": field(F.when(k % 5 == 0, F.lit("ARM")).otherwise(F.lit("Fixed Rate"))),
        "loan_term_months": field(F.element_at(terms, (k % 7 + 1).cast("int")).cast("string")),
        "interest_rate": field(_tenths(k % 320, "%")),
        "property_address": field(F.concat(k.cast("string"), F.lit(" Main St")), k % 20 != 19),
        "property_type": field(F.lit("Single Family")),
        "occupancy_type": field(F.lit("Primary Residence")),
        "purchase_price": field(_money(v * F.lit(4.0))),
        "down_payment": field(_money(v)),
        "ltv_ratio": field(_tenths((k * 7) % 1600, "%")),
        "borrower_name": field(F.col("c_name")),
        "borrower_ssn_last4": field(F.lpad(((ck * 37) % 10000).cast("string"), 4, "0")),
        "borrower_phone": field(F.concat(F.lit("555-"), F.lpad((ck % 10000).cast("string"), 4, "0"))),
        "borrower_email": field(F.concat(F.lower(F.regexp_replace(F.col("c_name"), "#", "")),
                                         F.lit("@example.com"))),
        "employer_name": field(F.concat(F.lit("Employer "), F.col("c_nationkey").cast("string"))),
        "employment_years": field((ck % 30).cast("string")),
        "gross_monthly_income": field(_money(bal + F.lit(5000.0))),
        "base_monthly_income": field(_money(bal + F.lit(4000.0))),
        "checking_savings_balance": field(_money(bal * F.lit(3.0))),
        "monthly_debt_payments": field(_money(v / F.lit(100.0))),
        "dti_ratio": field(_tenths(k % 1100, "%")),
        "credit_score": field(F.when(k % 250 == 5, F.lit("299"))
                              .otherwise((F.lit(300) + (ck * 7 + k) % 560).cast("string"))),
        "lender_name": field(F.lit("First National Bank")),
        "application_date": field(F.col("od")),
    }


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file_name, fields) — one derived loan application per order."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    k = F.col("o_orderkey")
    base = (orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
            .select(k.alias("k"), F.col("o_custkey").alias("ck"), F.col("o_totalprice").alias("v"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("od"), "c_name", "c_nationkey", "c_acctbal",
                    F.when(k % 9 == 0, F.lit("medium")).when(k % 9 == 1, F.lit("low")).otherwise(F.lit("high"))
                    .alias("_cp")))
    return records(spread(base, "k"), loan_field_columns(), LOAN_FIELDS, F.col("k").alias("doc_id"),
                   F.concat(F.lit("loan_"), F.col("k").cast("string"), F.lit(".pdf")).alias("file_name"))
