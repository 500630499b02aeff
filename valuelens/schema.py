"""Record layouts: field order, field sets and the Spark types of a document row.

A document is one row.  Its extracted fields live in one ``fields`` struct whose
members are ``field`` structs (value, confidence, reasoning, source_snippet).
Declaration order matters: reports, comparisons and unpivots follow it.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# These must equal the reference record contract exactly.
# --------------------------------------------------------------------------

# Confidence levels, best first.
CONFIDENCE_LEVELS = ["high", "medium", "low", "missing"]

# Appraisal fields in declaration order, with their catalogue description ("" = none).
APPRAISAL_FIELDS_WITH_DESCRIPTIONS = [
    ("property_address", "Full street address of the subject property."),
    ("city", ""),
    ("state", ""),
    ("zip_code", ""),
    ("county", ""),
    ("legal_description", ""),
    ("assessors_parcel_number", "APN or Tax ID for the property."),
    ("appraised_value", "Final appraised market value in USD."),
    ("effective_date_of_appraisal", ""),
    ("appraisal_purpose", "E.g. purchase, refinance, estate."),
    ("appraiser_name", ""),
    ("appraiser_license_number", ""),
    ("lender_client", ""),
    ("gross_living_area_sqft", "Above-grade living area in square feet (GLA)."),
    ("lot_size", "Lot area (acres or sq ft)."),
    ("year_built", ""),
    ("property_type", "E.g. single-family, condo, multi-family."),
    ("number_of_bedrooms", ""),
    ("number_of_bathrooms", ""),
    ("number_of_stories", ""),
    ("garage_capacity", "Number of cars the garage holds."),
    ("basement", "Basement presence and sq footage."),
    ("condition_rating", "UAD condition rating (C1-C6)."),
    ("quality_rating", "UAD quality rating (Q1-Q6)."),
    ("neighborhood_name", ""),
    ("market_trend", "Increasing, stable, or declining."),
    ("prior_sale_price", ""),
    ("prior_sale_date", ""),
    ("comp_1_address", ""),
    ("comp_1_sale_price", ""),
    ("comp_1_gla", ""),
    ("comp_2_address", ""),
    ("comp_2_sale_price", ""),
    ("comp_2_gla", ""),
    ("comp_3_address", ""),
    ("comp_3_sale_price", ""),
    ("comp_3_gla", ""),
]

# Loan application fields in declaration order.
LOAN_FIELDS = [
    "loan_amount", "loan_purpose", "loan_type", "amortization_type", "loan_term_months", "interest_rate",
    "property_address", "property_type", "occupancy_type", "purchase_price", "down_payment", "ltv_ratio",
    "borrower_name", "borrower_dob", "borrower_ssn_last4", "borrower_phone", "borrower_email", "co_borrower_name",
    "employer_name", "employment_years", "gross_monthly_income", "base_monthly_income",
    "checking_savings_balance", "monthly_debt_payments", "dti_ratio",
    "credit_score",
    "lender_name", "loan_officer_name", "application_date",
]

# Fields whose presence makes up critical-field completeness.
CRITICAL_FIELDS = [
    "property_address", "appraised_value", "effective_date_of_appraisal",
    "gross_living_area_sqft", "year_built", "property_type",
    "number_of_bedrooms", "number_of_bathrooms", "appraiser_name",
    "comp_1_address", "comp_1_sale_price",
]

# Appraisal fields visited by rule validation; also the set that gets a numeric difference note.
NUMERIC_FIELDS = [
    "appraised_value", "gross_living_area_sqft", "year_built", "number_of_bedrooms", "number_of_bathrooms",
    "prior_sale_price", "comp_1_sale_price", "comp_2_sale_price", "comp_3_sale_price",
]

# Fields exported as value + confidence column pairs in the batch CSV.
CSV_FIELDS = [
    "property_address", "city", "state", "zip_code",
    "appraised_value", "effective_date_of_appraisal",
    "gross_living_area_sqft", "lot_size", "year_built",
    "property_type", "number_of_bedrooms", "number_of_bathrooms",
    "condition_rating", "quality_rating", "appraiser_name",
    "neighborhood_name", "market_trend",
    "comp_1_address", "comp_1_sale_price", "comp_1_gla",
    "comp_2_address", "comp_2_sale_price", "comp_2_gla",
    "comp_3_address", "comp_3_sale_price", "comp_3_gla",
]

# Trailing summary columns of the batch CSV.
CSV_SUMMARY_COLUMNS = [
    "high_confidence_count", "medium_confidence_count", "low_confidence_count", "missing_count",
    "reliability_score", "calibration_error_count", "calibration_warning_count",
    "comp_quality_score", "comp_quality_label", "appraised_value_in_comp_range", "bracketing_satisfied",
]

# Allowed loan terms in months.
VALID_LOAN_TERMS = [60, 120, 180, 240, 360, 480]

# Text cap per document and the page separator used when assembling pages.
MAX_CHARS = 12000
PAGE_SEPARATOR = "\n\n--- PAGE BREAK ---\n\n"

# Extraction strategies in default priority order.
STRATEGIES = ["pdfplumber", "pymupdf"]

# --------------------------------------------------------------------------

APPRAISAL_FIELDS = [name for name, _ in APPRAISAL_FIELDS_WITH_DESCRIPTIONS]
CSV_HEADERS = (["file_name", "processing_time_s", "status", "error"]
               + [c for f in CSV_FIELDS for c in (f, f"{f}_confidence")]
               + CSV_SUMMARY_COLUMNS)

FIELD_TYPE = T.StructType([
    T.StructField("value", T.StringType(), True),
    T.StructField("confidence", T.StringType(), False),
    T.StructField("reasoning", T.StringType(), False),
    T.StructField("source_snippet", T.StringType(), True),
])


def fields_struct_type(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, FIELD_TYPE, False) for n in names])


APPRAISAL_STRUCT = fields_struct_type(APPRAISAL_FIELDS)
LOAN_STRUCT = fields_struct_type(LOAN_FIELDS)

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("file_name", T.StringType(), True),
    T.StructField("fields", APPRAISAL_STRUCT, False),
])
