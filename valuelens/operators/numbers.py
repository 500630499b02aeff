"""One projection that parses every number the calibration and comp checks read.

The checks read ``.value`` only (confidence is ignored), exactly like the record
contract.  Parsing happens once, in its own projection, so that it does not
re-run in every check that uses a number; rows that carry the numbers already keep them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import parse_currency, parse_float, parse_int

NUMBER_COLUMNS = ["_av", "_gla", "_yb", "_beds", "_baths", "_prior", "_cond",
                  "_cp1", "_cp2", "_cp3", "_cg1", "_cg2", "_cg3"]


def _v(name: str):
    return F.col("fields").getField(name).getField("value")


def with_numbers(docs: DataFrame) -> DataFrame:
    if set(NUMBER_COLUMNS) <= set(docs.columns):
        return docs
    return docs.withColumns({
        "_av": parse_currency(_v("appraised_value")),
        "_gla": parse_float(_v("gross_living_area_sqft")),
        "_yb": parse_int(_v("year_built")),
        "_beds": parse_float(_v("number_of_bedrooms")),
        "_baths": parse_float(_v("number_of_bathrooms")),
        "_prior": parse_currency(_v("prior_sale_price")),
        "_cond": _v("condition_rating"),
        **{f"_cp{i}": parse_currency(_v(f"comp_{i}_sale_price")) for i in (1, 2, 3)},
        **{f"_cg{i}": parse_float(_v(f"comp_{i}_gla")) for i in (1, 2, 3)},
    })
