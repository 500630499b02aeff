"""Page-level and document-level text sources derived from the benchmark tables.

* ``conversation_pages``: every conversation is a document, every turn a page
  (page_number = turn + 1); a few turns carry a small table with empty cells.
* ``strategy_candidates``: every row of ``documents`` as the output of the two
  text-extraction strategies, with derived per-strategy failures.
* ``named_documents`` / ``uploads``: document names and paths for the naming and
  upload-guard operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import STRATEGIES
from ..session import read_table


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    turn = F.col("turn")
    cell2 = F.when(turn % 2 == 0, F.lit(None).cast("string")).otherwise(F.length("text").cast("string"))
    tables = F.when(turn % 3 == 0, F.array(F.array(F.array(F.col("role"), cell2))))
    return c.select(
        F.col("conv_id").alias("doc_id"),
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("file_name"),
        F.lit(STRATEGIES[0]).alias("strategy"), F.lit(0).alias("priority"),
        (turn + 1).cast("int").alias("page_number"),
        F.coalesce(F.col("text"), F.lit("")).alias("raw_text"),
        tables.alias("tables"),
        F.lit(None).cast("string").alias("error"))


def strategy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file_name, strategy, priority, full_text, total_chars, page_count, error)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    first = d.select("doc_id", name.alias("file_name"), F.lit(STRATEGIES[0]).alias("strategy"),
                     F.lit(0).alias("priority"), F.col("text").alias("full_text"),
                     F.when(F.col("doc_id") % 13 == 0, F.lit("pdfplumber: unreadable content stream")).alias("error"))
    second = d.select("doc_id", name.alias("file_name"), F.lit(STRATEGIES[1]).alias("strategy"),
                      F.lit(1).alias("priority"), F.trim(F.col("text")).alias("full_text"),
                      F.when(F.col("doc_id") % 17 == 0, F.lit("pymupdf: cannot open document")).alias("error"))
    both = first.unionByName(second)
    return both.select("doc_id", "file_name", "strategy", "priority",
                       F.when(F.col("error").isNull(), F.col("full_text")).alias("full_text"),
                       F.when(F.col("error").isNull(), F.length("full_text")).alias("total_chars"),
                       F.when(F.col("error").isNull(), F.lit(1)).alias("page_count"), "error")


def named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    k = F.col("doc_id")
    return d.select(
        "doc_id",
        F.when(k % 2 == 0, F.concat(F.lit("doc_"), k.cast("string"), F.lit(".pdf"))).alias("file_name"),
        F.when(k % 3 != 0, F.concat(F.lit("/data/"), F.col("source"), F.lit("/scan_"), k.cast("string"),
                                    F.lit(".pdf"))).alias("path"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    k = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(e) for e in (".pdf", ".PDF", ".txt", ".pdf.zip", "")]), (k % 5 + 1).cast("int"))
    name = F.when(k % 5 == 4, F.lit("")).otherwise(F.concat(F.lit("upload_"), k.cast("string"), ext))
    return d.select("doc_id", name.alias("file_name"))
