"""DuckDB SQL fragments for the oracle: the same semantics as functions/scalar.py,
written independently in DuckDB's dialect (RE2 regexes, TRY_CAST, round_even)."""

from __future__ import annotations

GRAMMAR = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def to_double(s: str) -> str:
    d = f"(CASE WHEN regexp_full_match({s}, {q(GRAMMAR)}) THEN TRY_CAST({s} AS DOUBLE) END)"
    return f"(CASE WHEN isinf({d}) THEN NULL ELSE {d} END)"


def strip_ends(s: str) -> str:
    return f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"


def pcur(v: str) -> str:
    return to_double(f"regexp_replace({v}, '[,$\\s]', '', 'g')")


def pflt(v: str) -> str:
    return to_double(f"regexp_replace({v}, '[,\\s]', '', 'g')")


def pint(v: str) -> str:
    return f"TRY_CAST(trunc({pflt(v)}) AS BIGINT)"


def prule(v: str) -> str:
    return to_double(strip_ends(f"regexp_replace({v}, '[,$]', '', 'g')"))


def ploanrule(v: str) -> str:
    return to_double(strip_ends(f"regexp_replace({v}, '[,$%]', '', 'g')"))


def pcmp(v: str) -> str:
    return to_double(strip_ends(f"regexp_replace({v}, '[,$]', '', 'g')"))


def norm(v: str) -> str:
    inner = strip_ends(f"lower(coalesce({v}, ''))")
    return f"regexp_replace({inner}, '\\s+', ' ', 'g')"


def rnd(x: str, n: int) -> str:
    s = f"{float(10 ** n)!r}"
    return f"(CASE WHEN abs({x}) * {s} < 1e15 THEN floor({x} * {s} + 0.5) / {s} ELSE {x} END)"


def truthy(x: str) -> str:
    return f"({x} IS NOT NULL AND {x} <> 0)"


def downgrade(c: str) -> str:
    return f"(CASE WHEN {c} = 'high' THEN 'medium' WHEN {c} = 'medium' THEN 'low' ELSE {c} END)"


def money0(x: str) -> str:
    return f"format('{{:,.0f}}', {x})"


def fixed0(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


def money2(x: str) -> str:
    return f"format('{{:,.2f}}', {rnd(x, 2)})"


def percent(x: str, d: int) -> str:
    return f"format('{{:.{d}f}}%', {rnd(f'({x}) * 100.0', d)})"


def fixed1(x: str) -> str:
    return f"format('{{:.1f}}', {rnd(x, 1)})"


def pyfloat(x: str) -> str:
    return (f"(CASE WHEN {x} = floor({x}) AND abs({x}) < 1e15 "
            f"THEN CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) || '.0' ELSE CAST({x} AS VARCHAR) END)")


def percent0(x: str) -> str:
    return f"(CAST(CAST(round_even(({x}) * 100.0, 0) AS BIGINT) AS VARCHAR) || '%')"


def div(a: str, b: str) -> str:
    """Null on a zero divisor (DuckDB's double division would give inf)."""
    return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a}) / ({b}) END)"


def unnest_fields(names: list[str], src: str, cols: dict[str, str], keep: str = "doc_id") -> str:
    """Long layout: one row per (row of src, field) with ord/field_name and the given members.

    cols maps output member -> column template with '{f}' for the field name."""
    items = []
    for i, n in enumerate(names):
        members = ", ".join(f"'{k}': {t.format(f=n)}" for k, t in cols.items())
        items.append(f"{{'ord': {i}, 'field_name': '{n}', {members}}}")
    lst = "[" + ", ".join(items) + "]"
    inner = f"SELECT {keep}, unnest({lst}) AS s FROM {src}"
    outs = ", ".join(f"s.{k} AS {k}" for k in ["ord", "field_name", *cols])
    return f"SELECT {keep}, {outs} FROM ({inner})"


def pyround4(x: str) -> str:
    s = f"regexp_replace(format('{{:.4f}}', {x}), '0+$', '')"
    return f"(CASE WHEN ends_with({s}, '.') THEN {s} || '0' ELSE {s} END)"


def pybool(b: str) -> str:
    return f"(CASE WHEN {b} IS NULL THEN '' WHEN {b} THEN 'True' ELSE 'False' END)"
