from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from valuelens.schema import APPRAISAL_FIELDS, DOC_SCHEMA, LOAN_FIELDS, LOAN_STRUCT  # noqa: E402
from valuelens.session import local_session  # noqa: E402

from pyspark.sql import types as T  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("*", shuffle_partitions=8, app="valuelens-tests")


def _record(names, values: dict) -> dict:
    """Field record: unspecified fields are missing; a value given as (v, conf) keeps conf."""
    rec = {}
    for n in names:
        if n in values:
            v = values[n]
            value, conf = v if isinstance(v, tuple) else (v, "high")
            rec[n] = {"value": value, "confidence": conf, "reasoning": "", "source_snippet": None}
        else:
            rec[n] = {"value": None, "confidence": "missing", "reasoning": "", "source_snippet": None}
    return rec


def make_docs(spark, docs: list[dict], loan: bool = False):
    """DataFrame of (doc_id, file_name, fields) from plain dicts of field values."""
    names = LOAN_FIELDS if loan else APPRAISAL_FIELDS
    schema = DOC_SCHEMA if not loan else T.StructType([
        T.StructField("doc_id", T.LongType(), False),
        T.StructField("file_name", T.StringType(), True),
        T.StructField("fields", LOAN_STRUCT, False),
    ])
    rows = [(i + 1, f"doc{i + 1}.pdf", _record(names, d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def docs(spark):
    return lambda ds, loan=False: make_docs(spark, ds, loan)


# The published end-to-end sample document (field values and confidences).
SAMPLE = {
    "property_address": "742 Evergreen Terrace",
    "city": "Springfield",
    "state": (None, "low"),
    "zip_code": "62704",
    "county": "Sangamon",
    "legal_description": "Lot 12, Block 4, Evergreen Subdivision",
    "assessors_parcel_number": "14-25-376-012",
    "appraised_value": "$485,000",
    "effective_date_of_appraisal": "January 15, 2024",
    "appraisal_purpose": "Purchase",
    "appraiser_name": "Margaret J. Thompson, MAI",
    "appraiser_license_number": "IL-CG-004821",
    "lender_client": "First National Bank of Springfield",
    "gross_living_area_sqft": "2,150",
    "lot_size": "0.28 acres",
    "year_built": "1987",
    "property_type": "Single Family Residential",
    "number_of_bedrooms": (None, "low"),
    "number_of_bathrooms": "2.5",
    "number_of_stories": "2",
    "garage_capacity": "2",
    "basement": "Full, 800 sq ft, 60% finished",
    "condition_rating": "C3",
    "quality_rating": "Q4",
    "neighborhood_name": "Evergreen Heights",
    "market_trend": "Increasing",
    "prior_sale_price": "$341,000",
    "prior_sale_date": "March 12, 2018",
    "comp_1_address": "818 Mulberry Lane, Springfield, IL 62704",
    "comp_1_sale_price": "$472,000",
    "comp_1_gla": "2,080",
    "comp_2_address": "1204 Oak Street, Springfield, IL 62704",
    "comp_2_sale_price": "$498,500",
    "comp_2_gla": "2,210",
    "comp_3_address": "55 Chestnut Ave, Springfield, IL 62703",
    "comp_3_sale_price": "$479,000",
    "comp_3_gla": "2,100",
}
