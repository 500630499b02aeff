"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import string
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast table may have; above it the join is a shuffle join.
BROADCAST_ROWS = 1_000_000
#: Rows of keys in halves (`halves`), about 110 bytes each once broadcast.
BROADCAST_KEYS = 750_000

#: Split points between words in the sense of white space: [\x20\x09-\x0D].
BLANK = r"[\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Send a module's functions to executors by value, so that they need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Unset is accepted on a local master only (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="valuelens-llm-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/valuelens-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """Hint a shuffle join.  The planner takes a table to be as large as its compressed files, and no larger after an
    explode, so it would broadcast one that is many times its threshold once it is in the driver's memory."""
    return df.hint("merge")


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the (stored) table has at most max_rows rows; else a shuffle join."""
    return F.broadcast(df) if df.count() <= max_rows else shuffled(df)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  lower() does just that where every character is ASCII, and is faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def split_words(text: Column, gap: str) -> Column:
    """Array of the pieces between gaps, null or empty text gives an array without elements."""
    return F.split(F.coalesce(text, F.lit("")), gap, -1)


def without_empty_ends(parts: Column) -> Column:
    """Drop the empty first and last piece that split() leaves where a text begins or ends with a gap."""
    n = F.size(parts)
    lead = (F.element_at(parts, 1) == "").cast("int")
    trail = ((F.element_at(parts, -1) == "") & (n > 1)).cast("int")
    return F.slice(parts, lead + 1, n - lead - trail)


def row_key(doc_id: Column, text: Column) -> Column:
    """Identity of a row: its id and text.  Rows that repeat both are one document."""
    return F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"),
                           F.coalesce(text, F.lit(""))), 256)


def halves(key: Column | str) -> list[Column]:
    """A row_key as two numbers (_k1, _k2), one for each half of its digest: a quarter of its text in a broadcast."""
    key = F.col(key) if isinstance(key, str) else key
    return [F.xxhash64(F.substring(key, at, 32)).alias(name) for at, name in ((1, "_k1"), (33, "_k2"))]


def one_text(rows: DataFrame, *by: str) -> DataFrame:
    """A row for each value of the columns `by`: of the texts of a repeated id, the one with the smallest digest."""
    return rows.groupBy(*by).agg(F.min_by("text", F.md5(F.coalesce("text", F.lit("")))).alias("text"))


def without(docs: DataFrame, key: Column, bad: DataFrame) -> DataFrame:
    """docs without the rows whose key is in bad's column `key`.  Rows travel as one column, so no other name can clash."""
    return among(docs, key, bad, "left_anti")


def among(docs: DataFrame, key: Column, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """docs with the rows whose key is in the (stored) table's column `key`, or with left_anti without them."""
    rows = docs.select(F.struct("*").alias("row"), key.alias("key")).select("row", *halves("key"))
    return rows.join(small(keys.select(*halves("key")), BROADCAST_KEYS), ["_k1", "_k2"], how).select("row.*")


def held_out(doc_id: Column) -> Column:
    """True for the fold that training never sees: crc32 of the id as text, remainder 2 of 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
