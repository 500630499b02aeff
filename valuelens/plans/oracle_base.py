"""DuckDB twins of sources/derive.py: the derived appraisal and loan tables as CTEs.

Flat layout: for every field ``f`` a value column ``f`` and a confidence column
``f__c``; reasoning is '' and source_snippet null for every derived field.
"""

from __future__ import annotations

from ..schema import APPRAISAL_FIELDS, LOAN_FIELDS

D = "::DOUBLE"


def money(x: str) -> str:
    return f"('$' || format('{{:,}}', CAST(floor({x} + 0.5{D}) AS BIGINT)))"


def num(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


def tenths(m: str, suffix: str = "") -> str:
    s = f" || '{suffix}'" if suffix else ""
    return f"(CAST(({m}) // 10 AS VARCHAR) || '.' || CAST(({m}) % 10 AS VARCHAR){s})"


def _appr_fields() -> dict[str, tuple[str, str]]:
    """field -> (value SQL, confidence SQL); value NULL means missing."""
    nulled = "k % 20 = 19"
    sparse = "k % 20 IN (9, 19)"

    def pres(v, cond=None):
        val = f"CASE WHEN NOT ({cond}) THEN {v} END" if cond else v
        return val, f"CASE WHEN ({val}) IS NOT NULL THEN cp ELSE 'missing' END"

    out = {
        "property_address": pres("CAST(k AS VARCHAR) || ' Main St'", nulled),
        "city": ("CASE WHEN k % 13 = 4 THEN '' END", "CASE WHEN k % 13 = 4 THEN 'high' ELSE 'missing' END"),
        "state": ("CAST(NULL AS VARCHAR)", "CASE WHEN k % 17 = 0 THEN 'low' ELSE 'missing' END"),
        "appraised_value": (
            f"CASE WHEN k % 1000 = 7 THEN '$500' WHEN k % 1000 = 8 THEN '$250,000,000' "
            f"WHEN k % 1000 = 10 THEN 'N/A' ELSE {money('v')} END",
            "CASE WHEN k % 211 = 6 THEN 'missing' ELSE cp END"),
        "effective_date_of_appraisal": pres("od", sparse),
        "appraiser_name": pres("'Jane Smith'", sparse),
        "gross_living_area_sqft": pres(
            f"CASE WHEN k % 997 = 3 THEN '50' WHEN k % 997 = 4 THEN '60,000' "
            f"WHEN k % 101 = 5 THEN '2,150 sq ft' ELSE {num('g')} END"),
        "year_built": pres("CASE WHEN k % 500 = 11 THEN 'circa 1950' ELSE CAST(1900 + ck % 140 AS VARCHAR) END",
                           nulled),
        "property_type": pres("'Single Family'", sparse),
        "number_of_bedrooms": pres("CASE WHEN k % 700 = 13 THEN '25' ELSE CAST(ck % 7 AS VARCHAR) END", nulled),
        "number_of_bathrooms": pres(tenths("(k % 11) * 5")),
        "condition_rating": pres("'C' || CAST(1 + k % 6 AS VARCHAR)"),
        "prior_sale_price": pres(money(f"v * (0.3{D} + (ck % 20) / 10.0{D})"), "k % 5 = 0"),
    }
    for i in (1, 2, 3):
        no_line = f"n_lines < {i}"
        price = money(f"v * f * (0.85{D} + q{i} / 165.0{D})")
        gla = num(f"g - 100.0{D} + 4.0{D} * q{i}")
        if i == 1:
            price = f"CASE WHEN k % 307 = 1 THEN '$0' ELSE {price} END"
        if i == 2:
            gla = f"CASE WHEN k % 401 = 2 THEN '0' ELSE {gla} END"
        out[f"comp_{i}_address"] = pres(f"CAST(p{i} AS VARCHAR) || ' Oak Ave'", no_line)
        out[f"comp_{i}_sale_price"] = pres(price, no_line)
        out[f"comp_{i}_gla"] = pres(gla, no_line)
    return out


def _select_list(names: list[str], spec: dict[str, tuple[str, str]]) -> str:
    parts = []
    for n in names:
        v, c = spec.get(n, ("CAST(NULL AS VARCHAR)", "'missing'"))
        parts.append(f"{v} AS {n}")
        parts.append(f"{c} AS {n}__c")
    return ",\n    ".join(parts)


CP = "CASE WHEN o_orderkey % 9 = 0 THEN 'medium' WHEN o_orderkey % 9 = 1 THEN 'low' ELSE 'high' END"

COMPS_CTE = """
lc_rank AS (
  SELECT l_orderkey, l_partkey, l_quantity,
         row_number() OVER (PARTITION BY l_orderkey
                            ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM lineitem),
lc AS (
  SELECT l_orderkey, (rn - 1) // 3 AS part, count(*) AS nl,
         max(CASE WHEN rn % 3 = 1 THEN l_partkey END) AS p1, max(CASE WHEN rn % 3 = 1 THEN l_quantity END) AS q1,
         max(CASE WHEN rn % 3 = 2 THEN l_partkey END) AS p2, max(CASE WHEN rn % 3 = 2 THEN l_quantity END) AS q2,
         max(CASE WHEN rn % 3 = 0 THEN l_partkey END) AS p3, max(CASE WHEN rn % 3 = 0 THEN l_quantity END) AS q3
  FROM lc_rank GROUP BY l_orderkey, (rn - 1) // 3)"""

APPR_CTE = f"""{COMPS_CTE},
ab AS (
  SELECT o_orderkey AS k, o_custkey AS ck, o_totalprice AS v, strftime(o_orderdate, '%Y-%m-%d') AS od,
         CAST(800 + 40 * (1 + o_orderkey % 50) AS DOUBLE) AS g,
         CASE WHEN o_custkey % 8 = 0 THEN 2.2{D} WHEN o_custkey % 8 = 1 THEN 1.6{D} ELSE 1.0{D} END AS f,
         {CP} AS cp, coalesce(part, 0) AS part,
         coalesce(nl, 0) AS n_lines, p1, p2, p3, q1, q2, q3
  FROM orders LEFT JOIN lc ON lc.l_orderkey = orders.o_orderkey),
appr AS (
  SELECT part * 1099511627776 + k AS doc_id,
    'appraisal_' || CAST(k AS VARCHAR) || CASE WHEN part > 0 THEN '_' || CAST(part AS VARCHAR) ELSE '' END || '.pdf' AS file_name,
    {_select_list(APPRAISAL_FIELDS, _appr_fields())}
  FROM ab)"""


def _loan_fields() -> dict[str, tuple[str, str]]:
    def pres(v, cond=None):
        val = f"CASE WHEN NOT ({cond}) THEN {v} END" if cond else v
        return val, f"CASE WHEN ({val}) IS NOT NULL THEN cp ELSE 'missing' END"

    bal = "abs(c_acctbal)"
    return {
        "loan_amount": pres(f"CASE WHEN k % 300 = 1 THEN '$9,999' WHEN k % 300 = 2 THEN '$10,000' "
                            f"WHEN k % 300 = 3 THEN '$50,000,001' WHEN k % 300 = 4 THEN '$50,000,000' "
                            f"ELSE {money(f'v * 3.0{D}')} END"),
        "loan_purpose": pres("CASE WHEN k % 3 = 0 THEN 'Purchase' WHEN k % 3 = 1 THEN 'Refinance' "
                             "ELSE 'Construction' END"),
        "loan_type": pres("(['Conventional', 'FHA', 'VA', 'USDA'])[k % 4 + 1]"),
        "amortization_type": pres("CASE WHEN k % 5 = 0 THEN 'ARM' ELSE 'Fixed Rate' END"),
        "loan_term_months": pres("CAST(([60, 120, 180, 240, 300, 360, 480])[k % 7 + 1] AS VARCHAR)"),
        "interest_rate": pres(tenths("k % 320", "%")),
        "property_address": pres("CAST(k AS VARCHAR) || ' Main St'", "k % 20 = 19"),
        "property_type": pres("'Single Family'"),
        "occupancy_type": pres("'Primary Residence'"),
        "purchase_price": pres(money(f"v * 4.0{D}")),
        "down_payment": pres(money("v")),
        "ltv_ratio": pres(tenths("(k * 7) % 1600", "%")),
        "borrower_name": pres("c_name"),
        "borrower_ssn_last4": pres("lpad(CAST((ck * 37) % 10000 AS VARCHAR), 4, '0')"),
        "borrower_phone": pres("'555-' || lpad(CAST(ck % 10000 AS VARCHAR), 4, '0')"),
        "borrower_email": pres("lower(replace(c_name, '#', '')) || '@example.com'"),
        "employer_name": pres("'Employer ' || CAST(c_nationkey AS VARCHAR)"),
        "employment_years": pres("CAST(ck % 30 AS VARCHAR)"),
        "gross_monthly_income": pres(money(f"{bal} + 5000.0{D}")),
        "base_monthly_income": pres(money(f"{bal} + 4000.0{D}")),
        "checking_savings_balance": pres(money(f"{bal} * 3.0{D}")),
        "monthly_debt_payments": pres(money(f"v / 100.0{D}")),
        "dti_ratio": pres(tenths("k % 1100", "%")),
        "credit_score": pres("CASE WHEN k % 250 = 5 THEN '299' ELSE CAST(300 + (ck * 7 + k) % 560 AS VARCHAR) END"),
        "lender_name": pres("'First National Bank'"),
        "application_date": pres("od"),
    }


LOAN_CTE = f"""
lb AS (
  SELECT o_orderkey AS k, o_custkey AS ck, o_totalprice AS v, strftime(o_orderdate, '%Y-%m-%d') AS od,
         c_name, c_nationkey, c_acctbal, {CP} AS cp
  FROM orders LEFT JOIN customer ON orders.o_custkey = customer.c_custkey),
loan AS (
  SELECT k AS doc_id, 'loan_' || CAST(k AS VARCHAR) || '.pdf' AS file_name,
    {_select_list(LOAN_FIELDS, _loan_fields())}
  FROM lb)"""
