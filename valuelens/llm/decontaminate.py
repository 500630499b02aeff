r"""Operator 1, benchmark decontamination by a prefix-filtered set join.

Words are lower-cased (A-Z) runs of characters other than the ASCII ones that are neither letter nor digit.  A window
is 13 consecutive words of a benchmark item (the whole item if it has fewer).  Its shingles of three words (fewer for a
shorter window) are ordered by their count over the whole corpus.  Containment asks for every shingle, so the
necessary prefix is one token: the rarest.  Documents are joined on that token alone; the token's offset gives the one
place where the window can lie, length and position bounds drop those that reach over an end, and the words there must
equal the window's.  A window with a shingle that the corpus never has is dropped before the join.

All of this happens in the stage that scans the documents; only verified hits and one header row per document are
shuffled, by document.  The windows are broadcast in blocks of at most max_block_rows rows (each at most 13 words and
three numbers), one scan for each block, so memory does not depend on the benchmark's size.

Defined results: null or wordless texts have n_words 0 and are clean; items without words are ignored; repeated items
count under each item_id; rows that repeat doc_id and text are one document; extra columns are ignored; an empty
benchmark leaves every document clean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, row_key, small, split_words, stored, without, without_empty_ends

WINDOW = 13
SHINGLE = 3
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_ROWS = 500_000


def _worded(df: DataFrame, *keep: Column | str) -> DataFrame:
    parts = df.select(*keep, split_words(ascii_lower(F.col("text")), GAP).alias("parts"))
    names = [c for c in parts.columns if c != "parts"]
    return parts.select(*names, without_empty_ends(F.col("parts")).alias("words"))


def _token(words: str, pos: str, size: int) -> Column:
    at = [F.get(F.col(words), F.col(pos) + i) for i in range(size)]
    return F.xxhash64(F.lit(size), *at)


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    items = _worded(benchmark, "item_id").where(F.size("words") > 0)
    n = F.size("words")
    starts = items.select("item_id", "words", F.explode(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))).alias("s"))
    return starts.select("item_id", F.slice("words", F.col("s") + 1, window).alias("w")).select(
        "item_id", "w", F.array_join("w", " ").alias("window"), F.size("w").alias("wlen")).distinct()


def _doc_tokens(words: DataFrame, sizes: list[int], ends: bool) -> DataFrame:
    """A row for each word position (and one past the end if ends, whose token is 0) and each token size."""
    last = F.array(F.lit(None).cast("string")) if ends else F.array().cast("array<string>")
    cols = [c for c in words.columns]
    rows = words.select(*cols, F.posexplode(F.concat("words", last)).alias("pos", "_word"))
    header = F.col("_word").isNull()
    tokens = [_token("words", "pos", k) for k in sizes]
    if len(tokens) == 1:
        return rows.select(*cols, "pos", F.when(header, F.lit(0).cast("long")).otherwise(tokens[0]).alias("token"))
    zero = F.when(header, F.lit(0).cast("long"))
    return rows.select(*cols, "pos", F.explode(F.when(header, F.array(zero)).otherwise(F.array(*tokens))).alias("token"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_block_rows: int = BLOCK_ROWS):
    """(verified occurrences and one header row per document, (window, item_id) pairs)."""
    windows = stored(_windows(benchmark, window), "windows")
    items = windows.select("window", "item_id")
    unique = windows.select("window", "wlen", "w").distinct()
    sizes = sorted(r[0] for r in unique.select(F.least("wlen", F.lit(SHINGLE))).distinct().collect())  # at most three
    doc_cols = (row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id")
    words = _worded(docs, *doc_cols)
    if sizes:
        k = F.least("wlen", F.lit(SHINGLE))
        spots = unique.select("window", "wlen", "w", F.explode(F.sequence(F.lit(0), F.col("wlen") - k)).alias("offset"))
        token = reduce(lambda c, s: c.when(k == s, _token("w", "offset", s)), sizes[1:],
                       F.when(k == sizes[0], _token("w", "offset", sizes[0])))
        spots = stored(spots.select("window", "wlen", "offset", token.alias("token")), "tokens")
        seen = _in_blocks(_doc_tokens(words, sizes, ends=False).select("token"),
                          spots.select("token").distinct(), "token", max_block_rows)
        counts = stored(seen.groupBy("token").agg(F.count("*").alias("n")), "token_counts")
        ranked = spots.join(counts, "token", "left").groupBy("window", "wlen").agg(
            F.min(F.coalesce("n", F.lit(0))).alias("least"),
            F.min_by(F.struct("token", "offset"), F.struct(F.coalesce("n", F.lit(0)), "token", "offset")).alias("p"))
        prefix = ranked.where("least > 0").select("window", "wlen", "p.token", "p.offset")
    else:
        prefix = unique.select("window", "wlen", F.lit(0).cast("long").alias("token"), F.lit(0).alias("offset")).limit(0)
    header = docs.sparkSession.range(1).select(F.lit("").alias("window"), F.lit(0).alias("wlen"),
                                               F.lit(0).cast("long").alias("token"), F.lit(0).alias("offset"))
    prefix = stored(prefix.unionByName(header), "prefix")
    n_words = words.withColumn("n_words", F.size("words"))
    found = _in_blocks(_doc_tokens(n_words, sizes or [SHINGLE], ends=True), prefix, "token", max_block_rows)
    start = F.col("pos") - F.col("offset")
    inside = (start >= 0) & (start + F.col("wlen") <= F.col("n_words"))
    same = F.array_join(F.slice("words", start + 1, F.col("wlen")), " ") == F.col("window")
    found = found.where(F.when(inside, same).otherwise(False)).select(
        "key", "doc_id", "n_words", start.alias("start"), "wlen", "window")
    return stored(found, "occurrences"), items


def _in_blocks(left: DataFrame, right: DataFrame, on: str, max_rows: int) -> DataFrame:
    """Inner join with a table broadcast in hashed blocks of about max_rows rows, so that each has a bounded size."""
    n = -(-max(1, right.count()) // max_rows)
    part = F.pmod(F.hash(on), F.lit(n))
    return reduce(DataFrame.unionByName,
                  [left.join(F.broadcast(right if n == 1 else right.where(part == b)), on) for b in range(n)])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, n_words, n_hit, n_items, items (text), contaminated: one row per document."""
    found, items = matches(docs, benchmark, window)
    doc = ["key", "doc_id"]
    end = F.col("start") + F.col("wlen")
    before = Window.partitionBy(*doc).orderBy("start", "wlen").rowsBetween(Window.unboundedPreceding, -1)
    reach = found.withColumn("reach", F.coalesce(F.max(end).over(before), F.lit(0)))
    new = F.greatest(F.lit(0), end - F.greatest("start", "reach"))
    totals = reach.groupBy(*doc).agg(F.max("n_words").cast("long").alias("n_words"), F.sum(new).alias("n_hit"))
    hits = found.where("wlen > 0").select("key", "window").distinct()
    per_doc = hits.join(small(items), "window").select("key", F.col("item_id").cast("string").alias("item")).distinct()
    lists = per_doc.groupBy("key").agg(F.count("*").alias("n_items"),
                                       F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    out = totals.join(lists, "key", "left")
    return out.select("doc_id", "key", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce("items", F.lit("")).alias("items"),
                      ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones, all columns as they were."""
    bad = stored(contamination(docs, benchmark).where("contaminated").select("key"), "contaminated")
    return without(docs, row_key(F.col("doc_id"), F.col("text")), bad)


def query(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, bench).select("doc_id", "n_words", "n_hit", "n_items",
                                             F.sha2("items", 256).alias("items_sha256"), "contaminated")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle(documents: str = "documents") -> str:
    return rf"""
WITH bench AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, list_slice(w, s + 1, s + least(len(w), 13)) AS win
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS s FROM bench WHERE len(w) > 0)),
docw AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {documents}),
sizes AS (SELECT DISTINCT k FROM wins),
spots AS (
  SELECT doc_id, k, s, list_slice(w, s + 1, s + k) AS win
  FROM (SELECT doc_id, w, k, unnest(range(0, greatest(len(w) - k + 1, 0))) AS s FROM docw, sizes WHERE len(w) >= k)),
hits AS (SELECT DISTINCT doc_id, item_id, spots.k, s FROM spots JOIN wins USING (k, win)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


ORACLE = oracle()
