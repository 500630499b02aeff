"""Document assembly from pages, strategy choice, truncation and request text.

* assemble: pages -> documents is the one shuffle here (group by document).  The
  group is one document's pages; the counts use partial aggregation, and the
  text is joined in page order from a sorted (page_number, text) list.
* choose_strategy: candidates per document are tiny groups (one row per
  configured strategy), aggregated with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MAX_CHARS, PAGE_SEPARATOR, STRATEGIES
from ..sources.derive import spread

# --------------------------------------------------------------------------
# Minimum text length, request wrappers and error texts.
# --------------------------------------------------------------------------
MIN_CHARS = 50
APPRAISAL_REQUEST_HEAD = "Extract all appraisal fields from the following document text:"
LOAN_REQUEST_HEAD = "Extract all Form 1003 loan application fields from the following document text:"
DOC_START = "--- DOCUMENT START ---"
DOC_END = "--- DOCUMENT END ---"
ALL_FAILED = "All PDF extraction strategies failed. Last error: "
UNKNOWN_NAME = "unknown.pdf"
# --------------------------------------------------------------------------


def page_char_count(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page_number", F.length(F.coalesce("raw_text", F.lit(""))).alias("char_count"))


def assemble_documents(pages: DataFrame) -> DataFrame:
    """(doc_id, file_name, strategy, priority, full_text, total_chars, page_count, error).

    total_chars is the sum of page lengths: the separators are not counted."""
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    grouped = pages.groupBy("doc_id", "file_name", "strategy", "priority").agg(
        F.sort_array(F.collect_list(F.struct(F.col("page_number"), text.alias("t")))).alias("_pages"),
        F.sum(F.length(text)).alias("total_chars"),
        F.count(F.lit(1)).alias("page_count"),
        F.max("error").alias("error"))
    full = F.array_join(F.transform("_pages", lambda p: p.getField("t")), PAGE_SEPARATOR)
    return grouped.select("doc_id", "file_name", "strategy", "priority", full.alias("full_text"),
                          "total_chars", "page_count", "error")


def normalise_tables(pages: DataFrame) -> DataFrame:
    """Flattened table cells with null cells as '' (null tables yield no cells)."""
    t = pages.select("doc_id", "page_number", F.posexplode("tables").alias("table_idx", "table"))
    r = t.select("doc_id", "page_number", "table_idx", F.posexplode("table").alias("row_idx", "row"))
    c = r.select("doc_id", "page_number", "table_idx", "row_idx", F.posexplode("row").alias("col_idx", "cell"))
    return c.withColumn("cell", F.coalesce(F.col("cell"), F.lit("")))


def _strategy_label(strategy: Column) -> Column:
    # An f-string of the strategy enum prints the member name with its class.
    return F.concat(F.lit("ExtractionStrategy."), F.upper(strategy))


def _choice(candidates: DataFrame, policy: str, preferred: str | None, min_chars: int,
            strategies: tuple[str, ...], carried: str | None = None) -> DataFrame:
    """The choice per document from small columns alone: no text takes part in it.

    With carried, a list of (strategy, that column) of all candidates comes last, as a column of the same name."""
    if policy not in ("strict", "fallback"):
        raise ValueError(f"unknown policy {policy!r}")
    order = [s for s in strategies if s != preferred]
    order = ([preferred] if preferred is not None else []) + order
    place = F.coalesce(*[F.when(F.col("strategy") == s, F.lit(i)) for i, s in enumerate(order)], F.lit(len(order)))
    last_p = len(order) - 1  # of the configured ones, whichever rows are there
    failed = F.col("error").isNotNull()
    short = F.col("total_chars") < min_chars
    short_msg = F.concat(_strategy_label(F.col("strategy")), F.lit(" returned only "),
                         F.col("total_chars").cast("string"), F.lit(" chars — trying next strategy"))
    pick = F.struct("_p", "strategy", "total_chars", "page_count")
    timed = "elapsed_ms" in candidates.columns
    agg = candidates.withColumn("_p", place).groupBy("doc_id").agg(
        *([F.sum("elapsed_ms").alias("elapsed_ms")] if timed else []),
        *([F.collect_list(F.struct("strategy", carried)).alias(carried)] if carried else []),
        F.min("file_name").alias("file_name"),
        F.min(F.when(~failed, pick)).alias("_first_ok"),
        F.min(F.when(~failed & (~short), pick)).alias("_first_long"),
        F.min(F.when(~failed & (F.col("_p") >= last_p), pick)).alias("_last_ok"),
        F.max(F.when(failed, F.struct("_p", "error"))).alias("_last_err"),
        F.max(F.when(failed | short, F.struct("_p", F.when(failed, F.col("error")).otherwise(short_msg).alias("e"))))
        .alias("_last_fail"))
    first_ok = F.col("_first_ok")
    if policy == "strict":
        is_short = first_ok.isNotNull() & (first_ok.getField("_p") < last_p) & \
            (first_ok.getField("total_chars") < min_chars)
        chosen = F.when(~is_short, first_ok)
        error = (F.when(first_ok.isNull(), F.concat(F.lit(ALL_FAILED), F.col("_last_err").getField("error")))
                 .when(is_short, F.concat(_strategy_label(first_ok.getField("strategy")), F.lit(" returned only "),
                                          first_ok.getField("total_chars").cast("string"),
                                          F.lit(" chars — trying next strategy"))))
    else:
        # the last configured strategy is accepted at any length
        chosen = F.coalesce(F.col("_first_long"), F.col("_last_ok"))
        error = F.when(chosen.isNull(), F.concat(F.lit(ALL_FAILED), F.col("_last_fail").getField("e")))
    return agg.select(
        "doc_id", "file_name",
        F.when(chosen.isNotNull(), F.lit("ok")).otherwise(F.lit("error")).alias("status"),
        chosen.getField("strategy").alias("strategy_used"),
        chosen.getField("total_chars").alias("total_chars"),
        chosen.getField("page_count").alias("page_count"),
        error.alias("error"), *(["elapsed_ms"] if timed else []), *([carried] if carried else []))


def choose_strategy(candidates: DataFrame, policy: str = "strict", preferred: str | None = None,
                    min_chars: int = MIN_CHARS, strategies: tuple[str, ...] = tuple(STRATEGIES)) -> DataFrame:
    """Pick one extraction result per document.

    strict   : first non-failed strategy in priority order; if it is not the last
               configured one and has fewer than min_chars characters the document fails.
    fallback : short non-last results are skipped like failures.
    preferred: that strategy is tried first, the others keep their order.
    """
    choice = _choice(candidates.drop("full_text"), policy, preferred, min_chars, strategies)
    text = candidates.select("doc_id", F.col("strategy").alias("strategy_used"), "full_text")
    return choice.join(text, ["doc_id", "strategy_used"], "left").select(
        "doc_id", "file_name", "status", "strategy_used", "total_chars", "page_count", "full_text", "error")


def choose_and_assemble(pages: DataFrame, policy: str = "strict", preferred: str | None = None,
                        min_chars: int = MIN_CHARS, strategies: tuple[str, ...] = tuple(STRATEGIES)) -> DataFrame:
    """choose_strategy over pages: the choice reads lengths only, then the winner's text is assembled once.

    Pages are made and exchanged once, by document; a document's pages, of all strategies, then stay where they are.
    Pages may carry elapsed_ms, the time that reading each took; a document's is the sum over all strategies tried."""
    timed = ["elapsed_ms"] if "elapsed_ms" in pages.columns else []
    cols = ("doc_id", "file_name", "strategy", "priority", "page_number", "error", *timed)
    read = spread(pages.select(*cols, F.coalesce("raw_text", F.lit("")).alias("t")), "doc_id")
    candidates = read.groupBy("doc_id", "file_name", "strategy").agg(
        *[F.sum(c).alias(c) for c in timed],
        F.sum(F.length("t")).alias("total_chars"), F.count(F.lit(1)).alias("page_count"), F.max("error").alias("error"),
        F.sort_array(F.collect_list(F.struct("priority", "page_number", "t"))).alias("_pages"))
    choice = _choice(candidates, policy, preferred, min_chars, strategies, "_pages")

    def texts(candidate: Column) -> Column:
        """The text of each priority, its pages in order."""
        found = candidate.getField("_pages")
        return F.transform(F.array_distinct(F.transform(found, lambda p: p.getField("priority"))), lambda at: F.array_join(
            F.transform(F.filter(found, lambda p: p.getField("priority").eqNullSafe(at)), lambda p: p.getField("t")), PAGE_SEPARATOR))

    # texts of candidates with other file names are rows of their own; a document without an id has none
    won = F.filter("_pages", lambda c: c.getField("strategy") == F.col("strategy_used"))
    all_texts = F.when(F.col("doc_id").isNotNull() & (F.col("status") == "ok"), F.flatten(F.transform(won, texts)))
    return choice.select("doc_id", "file_name", "status", "strategy_used", "total_chars", "page_count",
                         F.explode_outer(all_texts).alias("full_text"), "error", *timed)


def truncate_text(text: Column, max_chars: int = MAX_CHARS) -> Column:
    return F.substring(text, 1, max_chars)


def _request(head: str, text: Column, max_chars: int) -> Column:
    body = F.concat(truncate_text(text, max_chars),
                    F.when(F.length(text) > max_chars,
                           F.lit(f"\n\n[... document truncated at {max_chars} chars ...]")).otherwise(F.lit("")))
    return F.concat(F.lit(f"{head}\n\n{DOC_START}\n"), body, F.lit(f"\n{DOC_END}\n"))


def appraisal_request(text: Column, max_chars: int = MAX_CHARS) -> Column:
    return _request(APPRAISAL_REQUEST_HEAD, text, max_chars)


def loan_request(text: Column, max_chars: int = MAX_CHARS) -> Column:
    return _request(LOAN_REQUEST_HEAD, text, max_chars)


def document_name(file_name: Column, path: Column) -> Column:
    """Given name, else the path's base name, else 'unknown.pdf'."""
    return F.coalesce(F.nullif(file_name, F.lit("")), F.when(path.isNotNull(), F.regexp_extract(path, r"([^/]+)$", 1)),
                      F.lit(UNKNOWN_NAME))


def is_pdf_name(file_name: Column) -> Column:
    return file_name.isNotNull() & (file_name != "") & F.lower(file_name).endswith(".pdf")
