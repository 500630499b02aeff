"""Scalar column functions (number parsing, normalisation, rounding, formatting).

Every function maps Columns to a Column built from native Catalyst expressions, so
it stays inside whole-stage codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python float() grammar restricted to finite decimal literals.  Applied before any
# cast so that Spark-only spellings ("1d", "1f") and non-finite words are rejected.
NUMBER_GRAMMAR = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

_INF = float("inf")

# Characters that (?U)\s matches (Unicode's White_Space), for trim and translate, which need no regular expression.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(text) -> Column:
    """String already stripped of separators -> DOUBLE, null when not a finite number."""
    s = _col(text)
    d = F.when(s.rlike(NUMBER_GRAMMAR), s.try_cast("double"))
    return F.when(~d.isin(_INF, -_INF), d)


def strip_ends(text) -> Column:
    """Trim Unicode whitespace at both ends (Python str.strip())."""
    return F.btrim(_col(text), F.lit(WHITE))


def without_chars(text, chars: str) -> Column:
    """Text without any of the characters."""
    return F.translate(_col(text), chars, "")


def _number(value, seps: str, clean: Column, sign: str = "", unit: str = "") -> Column:
    """Double of a value whose separators clean takes out; sign and unit are separators that may open and close it.

    A CASE shares no work between its conditions and its branches, so to_double makes clean four times.  Plain decimals are
    told from the value as it is, and are short enough to be finite; a value with a character that no number has needs
    neither.  The rest takes the whole grammar."""
    v = _col(value)
    opening, closing = (f"[{c}]?" if c else "" for c in (sign, unit))
    plain = rf"^{opening}[0-9][0-9,]{{0,60}}([.][0-9]{{1,60}})?{closing}\z"
    digits = v
    for c in seps:
        digits = F.replace(digits, F.lit(c))
    return (F.when(v.rlike(plain), digits.try_cast("double"))
            .when(v.rlike(f"[^-+.0-9eE{seps}{WHITE}]"), F.lit(None).cast("double"))
            .otherwise(to_double(clean)))


def parse_currency(value) -> Column:
    """'$425,000' -> 425000.0: delete ',', '$' and all whitespace, then parse; bad -> null."""
    return _number(value, ",$", without_chars(value, ",$" + WHITE), "$")


def parse_float(value) -> Column:
    """'2,150' -> 2150.0: delete ',' and all whitespace (a '$' makes it unparseable)."""
    return _number(value, ",", without_chars(value, "," + WHITE))


def parse_int(value) -> Column:
    """parse_float truncated toward zero."""
    return parse_float(value).try_cast("bigint")


def parse_rule_number(value) -> Column:
    """Number parse used by appraisal rule validation: delete ',' '$', strip the ends."""
    return _number(value, ",$", strip_ends(without_chars(value, ",$")), "$")


def parse_loan_rule_number(value) -> Column:
    """Number parse used by loan rule validation: delete ',' '$' '%', strip the ends."""
    return _number(value, ",$%", strip_ends(without_chars(value, ",$%")), "$", "%")


def parse_compare_number(value) -> Column:
    """Number parse used by document comparison: delete ',' and '$' (float() strips the ends)."""
    return _number(value, ",$", strip_ends(without_chars(value, ",$")), "$")


def normalise_text(value) -> Column:
    """null -> '', lower-case, trim, collapse whitespace runs to one blank."""
    text = strip_ends(F.lower(F.coalesce(_col(value), F.lit(""))))
    return F.when(text.rlike(r"(?U)\s\s|[\s&&[^ ]]"), F.regexp_replace(text, r"(?U)\s+", " ")).otherwise(text)


def round_half_up(x, digits: int) -> Column:
    """floor(x*10^d + 0.5)/10^d; the one rounding rule shared with the SQL oracle."""
    c = _col(x)
    scale = float(10 ** digits)
    return F.when(F.abs(c) * scale < 1e15, F.floor(c * scale + 0.5) / scale).otherwise(c)


def round_even0(x) -> Column:
    """Round to 0 digits, ties to even (Python round(x, 0))."""
    return F.bround(_col(x), 0)


def truthy(x) -> Column:
    """Python truthiness of an optional number: not null and not zero."""
    c = _col(x)
    return c.isNotNull() & (c != 0)


def downgrade(conf) -> Column:
    """high -> medium -> low -> low; missing stays missing."""
    c = _col(conf)
    return (F.when(c == "high", F.lit("medium"))
            .when(c == "medium", F.lit("low"))
            .otherwise(c))


def money0(x) -> Column:
    """Python '{x:,.0f}' (thousands separators, ties to even)."""
    return F.format_number(_col(x), 0)


def fixed0(x) -> Column:
    """Python '{x:.0f}'."""
    return F.format_string("%d", round_even0(x).try_cast("bigint"))


def money2(x) -> Column:
    """Python '{x:,.2f}' through the shared rounding rule."""
    return F.format_number(round_half_up(x, 2), 2)


def percent(x, digits: int) -> Column:
    """Python '{x:.N%}' through the shared rounding rule."""
    return F.format_string(f"%.{digits}f%%", round_half_up(_col(x) * 100.0, digits))


def fixed1(x) -> Column:
    """Python '{x:.1f}' through the shared rounding rule."""
    return F.format_string("%.1f", round_half_up(x, 1))


def py_float_str(x) -> Column:
    """Python str(float): plain digits between 1e-4 and 1e16, integral values as 'n.0'."""
    c = _col(x)
    text = c.cast("string")
    plain = F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(text.contains("E") & (F.abs(c) >= 1e-4) & (F.abs(c) < 1e16), plain).otherwise(text)


def percent0(x) -> Column:
    """Python '{x:.0%}' (ties to even)."""
    return F.concat(round_even0(_col(x) * 100.0).try_cast("bigint").cast("string"), F.lit("%"))


def py_round4_str(x) -> Column:
    """Python str() of a float already rounded to at most 4 decimals."""
    s = F.regexp_replace(F.format_string("%.4f", _col(x)), "0+$", "")
    return F.when(s.endswith("."), F.concat(s, F.lit("0"))).otherwise(s)


def py_bool_str(b) -> Column:
    """Python str() of an optional bool as written by a CSV writer: True / False / ''."""
    c = _col(b)
    return F.when(c.isNull(), F.lit("")).when(c, F.lit("True")).otherwise(F.lit("False"))
