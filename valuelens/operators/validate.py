"""Rule validation: a violated range rule keeps the value, appends a warning to the
reasoning and downgrades confidence one level.  Each rule is a CASE over one field,
applied with ``withField`` on the record struct, so validation is one projection."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import downgrade, parse_loan_rule_number, parse_rule_number, py_float_str
from ..schema import VALID_LOAN_TERMS

AS_OF_YEAR = 2026

Rule = Callable[[Column, Column], Column]  # (number, raw value) -> message or null


def _msg(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def appraisal_rules(as_of_year: int = AS_OF_YEAR) -> dict[str, Rule]:
    return {
        "appraised_value": lambda n, v: (
            F.when(n < 1000, _msg("Suspiciously low appraised value: ", v))
            .when(n > 100_000_000, _msg("Suspiciously high appraised value: ", v))),
        "year_built": lambda n, v: F.when(
            (n < 1600) | (n > as_of_year), _msg("year_built ", py_float_str(n), " is out of plausible range")),
        "gross_living_area_sqft": lambda n, v: (
            F.when(n < 100, _msg("GLA of ", py_float_str(n), " sqft is implausibly small"))
            .when(n > 50000, _msg("GLA of ", py_float_str(n), " sqft is implausibly large for residential"))),
        "number_of_bedrooms": lambda n, v: F.when(
            (n < 0) | (n > 20), _msg("Bedroom count ", py_float_str(n), " is unrealistic")),
    }


def loan_rules() -> dict[str, Rule]:
    return {
        "loan_amount": lambda n, v: (
            F.when(n < 10_000, _msg("Loan amount ", v, " is suspiciously low"))
            .when(n > 50_000_000, _msg("Loan amount ", v, " exceeds residential limits"))),
        "credit_score": lambda n, v: F.when(
            (n < 300) | (n > 850), _msg("Credit score ", py_float_str(n), " is outside valid range (300-850)")),
        "dti_ratio": lambda n, v: (
            F.when((n < 0) | (n > 100), _msg("DTI ratio ", py_float_str(n), "% is outside valid range (0-100%)"))
            .when(n > 65, _msg("DTI ratio ", py_float_str(n), "% is very high — likely approval risk"))),
        "ltv_ratio": lambda n, v: F.when(
            (n < 0) | (n > 150), _msg("LTV ratio ", py_float_str(n), "% is outside plausible range")),
        "interest_rate": lambda n, v: F.when(
            (n < 0.5) | (n > 30), _msg("Interest rate ", py_float_str(n), "% is outside plausible range")),
        "loan_term_months": lambda n, v: F.when(
            ~n.isin(*[float(t) for t in VALID_LOAN_TERMS]),
            _msg("Loan term ", py_float_str(n), " months is unusual (expected 60/120/180/240/360)")),
    }


def rule_issue(value: Column, confidence: Column, rule: Rule, number: Column) -> Column:
    """Warning text for one field, or null when skipped (null value, missing, not numeric) or clean.

    ``number`` is the parsed value, a column the caller staged in an earlier projection;
    subexpression elimination does not share work across CASE branches, so
    an inline parse would run once per comparison in the rule."""
    return F.when(value.isNotNull() & (confidence != "missing") & number.isNotNull(), rule(number, value))


def validated_field(f: Column, issue: Column) -> Column:
    return F.when(issue.isNull(), f).otherwise(
        f.withField("confidence", downgrade(f.getField("confidence")))
         .withField("reasoning", F.concat(F.coalesce(f.getField("reasoning"), F.lit("")),
                                          F.lit(" [VALIDATION WARNING: "), issue, F.lit("]"))))


def _post_validate(docs: DataFrame, rules: dict[str, Rule], parse, fields_col: str = "fields") -> DataFrame:
    # Numbers, then issues, then the fields with rules, each in their own projection: the parse regexes run once per
    # field and the issue text once, whatever the number of comparisons that use them.  Members are columns of their own
    # meanwhile, since a record that is passed on would be made in every projection, and the changed fields are members of
    # one column, so that the new record is not made for readers of its members.
    record = docs.schema[fields_col]
    fields = {n: F.struct(*[F.col(f"_{m}_{n}").alias(m) for m in record.dataType[n].dataType.names]) for n in record.dataType.names}
    whole = record.nullable or any(f.nullable for f in record.dataType)  # null records and fields stay what they are
    if whole:
        fields = {n: F.col(fields_col).getField(n) for n in fields}
        staged = docs
    else:
        staged = docs.select(*[c for c in docs.columns if c != fields_col], *[
            F.col(fields_col).getField(n).getField(m).alias(f"_{m}_{n}") for n in fields for m in record.dataType[n].dataType.names])
    value, confidence = ({n: fields[n].getField(m) if whole else F.col(f"_{m}_{n}") for n in rules} for m in ("value", "confidence"))
    staged = staged.withColumns({f"_num_{n}": parse(value[n]) for n in rules})
    staged = staged.withColumns({f"_issue_{n}": rule_issue(value[n], confidence[n], rules[n], F.col(f"_num_{n}")) for n in rules})
    staged = staged.withColumn("_ruled", F.struct(*[validated_field(fields[n], F.col(f"_issue_{n}")).alias(n) for n in rules]))
    if whole:
        rec = F.col(fields_col)
        for n in rules:
            rec = rec.withField(n, F.col("_ruled").getField(n))
    else:
        rec = F.struct(*[(F.col("_ruled").getField(n) if n in rules else f).alias(n) for n, f in fields.items()])
    return staged.select(*[rec.alias(c) if c == fields_col else c for c in docs.columns])


def post_validate(docs: DataFrame, as_of_year: int = AS_OF_YEAR) -> DataFrame:
    """Appraisal rules V1-V5 over the record (fields without a rule are untouched)."""
    return _post_validate(docs, appraisal_rules(as_of_year), parse_rule_number)


def post_validate_loan(docs: DataFrame) -> DataFrame:
    """Loan rules V7-V12 over the record."""
    return _post_validate(docs, loan_rules(), parse_loan_rule_number)


def validate_one(docs: DataFrame, name: str, loan: bool = False, as_of_year: int = AS_OF_YEAR) -> DataFrame:
    """One rule as a table: (doc_id, value, confidence, reasoning, flagged) after validation."""
    rules = loan_rules() if loan else appraisal_rules(as_of_year)
    parse = parse_loan_rule_number if loan else parse_rule_number
    f = F.col("fields").getField(name)
    issue = rule_issue(f.getField("value"), f.getField("confidence"), rules[name], F.col("_num"))
    staged = docs.select("doc_id", "fields", parse(f.getField("value")).alias("_num")).select("doc_id", "fields", issue.alias("_issue"))
    out = validated_field(f, F.col("_issue"))
    return staged.select("doc_id", out.getField("value").alias("value"),
                         out.getField("confidence").alias("confidence"),
                         out.getField("reasoning").alias("reasoning"),
                         F.col("_issue").isNotNull().alias("flagged"))
