"""Labelled-text extraction: fill each field from a ``Label: value`` line of the
document text (a deterministic, local stand-in for the remote extraction step).

One ``regexp_extract`` per field over the assembled text, all in one projection; value and
snippet are made from what it finds.
Found -> confidence high with the verbatim line as snippet; not found -> missing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import APPRAISAL_FIELDS, LOAN_FIELDS

# --------------------------------------------------------------------------
# Document labels of the appraisal fields (as printed on the form).
# --------------------------------------------------------------------------
APPRAISAL_LABELS = {
    "property_address": "Property Address", "city": "City", "state": "State", "zip_code": "Zip Code",
    "county": "County", "legal_description": "Legal Description", "assessors_parcel_number": "Assessor Parcel No",
    "appraised_value": "Appraised Value", "effective_date_of_appraisal": "Effective Date",
    "appraisal_purpose": "Purpose", "appraiser_name": "Appraiser Name", "appraiser_license_number": "License Number",
    "lender_client": "Lender / Client", "gross_living_area_sqft": "Above Grade GLA", "lot_size": "Lot Size",
    "year_built": "Year Built", "property_type": "Property Type", "number_of_bedrooms": "Bedrooms",
    "number_of_bathrooms": "Bathrooms", "number_of_stories": "Stories", "garage_capacity": "Garage",
    "basement": "Basement", "condition_rating": "Condition Rating", "quality_rating": "Quality Rating",
    "neighborhood_name": "Neighborhood Name", "market_trend": "Market Trend", "prior_sale_price": "Prior Sale Price",
    "prior_sale_date": "Prior Sale Date",
    "comp_1_address": "Comp 1 Address", "comp_1_sale_price": "Comp 1 Sale Price", "comp_1_gla": "Comp 1 GLA",
    "comp_2_address": "Comp 2 Address", "comp_2_sale_price": "Comp 2 Sale Price", "comp_2_gla": "Comp 2 GLA",
    "comp_3_address": "Comp 3 Address", "comp_3_sale_price": "Comp 3 Sale Price", "comp_3_gla": "Comp 3 GLA",
}
SSN_FIELD = "borrower_ssn_last4"
SSN_LABEL = "Borrower SSN"
# --------------------------------------------------------------------------


def loan_label(name: str) -> str:
    """Loan form labels follow the field name: words capitalised; the SSN line is labelled by itself."""
    return SSN_LABEL if name == SSN_FIELD else " ".join(w.capitalize() for w in name.split("_"))


def _line_start(label: str) -> str:
    """The label at the start of a line.  The literal comes first: a search for it skips ahead, where one that begins with an
    anchor tries every place of the text."""
    return rf"(?m){re.escape(label)}:(?<=^{re.escape(label)}:)"


def label_pattern(label: str) -> str:
    """What a field's value is; `rest_pattern` finds the same with the blanks before it."""
    return rf"{_line_start(label)}[ \t]*(.*?)[ \t]*$"


def rest_pattern(label: str) -> str:
    return rf"{_line_start(label)}(.*?)[ \t]*$"


def _rests(docs: DataFrame, text_col: str, labels: dict[str, str], *keep: str) -> DataFrame:
    """The columns kept and, for each field, what follows its label (empty if no line has it), as _rest_<field>."""
    return docs.select(*keep, *[F.regexp_extract(F.col(text_col), rest_pattern(label), 1).alias(f"_rest_{n}")
                                for n, label in labels.items()])


def _extract(name: str, label: str, post=None) -> Column:
    rest = F.col(f"_rest_{name}")
    value = F.ltrim(rest, F.lit(" \t"))
    found = value != ""  # no such line, or nothing after the label
    if post is not None:
        value = post(value)
    return F.struct(
        F.when(found, value).alias("value"),
        F.when(found, F.lit("high")).otherwise(F.lit("missing")).alias("confidence"),
        F.when(found, F.lit(f"Labelled line '{label}' found in document text")).otherwise(F.lit("")).alias("reasoning"),
        F.when(found, F.concat(F.lit(f"{label}:"), rest)).alias("source_snippet"),
    ).alias(name)


def extract_labelled(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, file_name, *keep, fields) from document text."""
    rests = _rests(docs, text_col, {n: APPRAISAL_LABELS[n] for n in APPRAISAL_FIELDS}, "doc_id", "file_name", *keep)
    return rests.select("doc_id", "file_name", *keep,
                        F.struct(*[_extract(n, APPRAISAL_LABELS[n]) for n in APPRAISAL_FIELDS]).alias("fields"))


def _last4(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"(\d{4})$", 1), F.lit(""))


def extract_labelled_loan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    rests = _rests(docs, text_col, {n: loan_label(n) for n in LOAN_FIELDS}, "doc_id", "file_name")
    fields = [_extract(n, loan_label(n), _last4 if n == SSN_FIELD else None) for n in LOAN_FIELDS]
    return rests.select("doc_id", "file_name", F.struct(*fields).alias("fields"))
