r"""Operator 7, mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all words; none gets more
than twice its words, and what it would get beyond is shared among the others by weight until none is above.  That is
one water level: sources fill in order of cap over weight.

Schedule: slot k of the mix has the golden-ratio point frac((k + 1/2) * phi).  The point falls in one source's part of
the cumulative target weights, and a source's slots are ranked by k.  mixed() gives its rows in this order.  Slot r of a source takes its r-th block: the
documents of the source are shuffled by a digest, laid end to end, and cut into blocks of equal size in words; after the
last block the source starts over.  A document's positions are those of its first slot in each lap.  A source's stream ends where its target is reached, inside its last block, so that
each source gives its target's whole words, and no document more than twice its size.  Slots that a source still needs when
the K points are used up follow in the tail of the schedule.

Running sums over a source would put it into one task, so each source is dealt into 2**BUCKET_BITS buckets by digest:
sums per bucket, running sums over those few rows, then over the documents of one bucket.  Reruns agree.

Defined results: a null or blank text has size 0 and is never taken; null sources are one source, the last; a null
doc_id is kept; rows that repeat doc_id, source and text are one document; extra columns are ignored by mixture() and
kept by mixed(); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANK, row_key, small, split_words, stored, without_empty_ends

BLOCK = 1024
BUCKET_BITS = 10
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
PHI = 0.6180339887498949
CELLS = 4096
CHUNK = 65536
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Number of runs of characters outside [\\x20\\x09-\\x0D]."""
    parts = split_words(text, BLANK)
    first, last = (F.element_at(parts, 1) == "").cast("int"), (F.element_at(parts, -1) == "").cast("int")
    return F.greatest(F.lit(0), F.size(parts) - first - last).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word, with its white space as it is."""
    words, gaps = without_empty_ends(split_words(text, BLANK)), split_words(text, WORD)
    chars = lambda parts: F.length(F.array_join(F.slice(parts, F.lit(1), n), ""))
    return F.left(text, chars(words) + chars(gaps))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target): one row per source.  These few rows alone meet in one task."""
    one = Window.orderBy(F.col("source").isNull(), "source")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(one) % len(WEIGHTS)
    weight = F.when(nth == 1, WEIGHTS[0]).when(nth == 2, WEIGHTS[1]).otherwise(WEIGHTS[2])
    per = per.withColumn("weight", weight)
    full = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    cap = CAP * F.col("source_size")
    per = per.withColumn("rest", SHARE * F.sum("source_size").over(every) - F.sum(cap).over(full) + cap)
    per = per.withColumn("left", F.sum("weight").over(every) - F.sum("weight").over(full) + F.col("weight"))
    # the level over the sources from this one on; the first source whose cap is above it sets the level for all
    per = per.withColumn("open", F.col("weight") * F.col("rest") <= cap * F.col("left"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source",
                                                 "rest", "left"))).over(every)
    per = per.withColumn("level", level)
    share = F.col("weight") * F.col("level.rest") / F.col("level.left")
    target = F.when(F.col("level").isNull(), cap.cast("double")).otherwise(F.least(cap.cast("double"), share))
    return per.select("source", "source_size", "weight", target.alias("target"))


def _key() -> Column:
    return row_key(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                               F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))), F.col("text"))


def _sized(docs: DataFrame) -> DataFrame:
    """A row per document with its size and, from a digest, its place in the shuffled order of its source."""
    rows = docs.select("doc_id", "source", _key().alias("key"), words_of(F.col("text")).alias("size"))
    rows = rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "size")])
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"),
                            F.coalesce("source", F.lit(""))))
    rows = rows.withColumn("u", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))  # 60 bits
    return rows.withColumn("bucket", F.shiftright("u", 60 - BUCKET_BITS).cast("int"))


def stream(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with size and begin, their first word's place in the source's stream; the targets)."""
    rows = stored(_sized(docs.select("doc_id", "source", "text")), "sizes")
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    rows = rows.withColumn("s", source)
    goal = stored(targets(rows).withColumn("s", source), "targets")
    sums = rows.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inner = Window.partitionBy("s", "bucket").orderBy("u", "doc_id", "key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = rows.join(sums, ["s", "bucket"]).select("doc_id", "key", "s", "size", (F.col("base") + F.col("inside")).alias("begin"))
    return stored(placed, "stream"), goal


def schedule(goal: DataFrame, block: int = BLOCK) -> DataFrame:
    """(s, r, position, words, block_no): the slots that each source takes, in the order of the mix."""
    spark = goal.sparkSession
    per = goal.withColumn("quota", F.floor(F.col("target")).cast("long")).where("quota > 0")
    n = F.ceil(F.col("source_size") / block)
    tail = F.greatest(F.lit(0), F.col("quota") - F.col("source_size"))
    need = F.ceil(F.least("quota", "source_size") / block) + F.ceil(tail / block)
    order = Window.orderBy("s")
    per = per.select("s", "source_size", "quota", n.alias("n"), need.alias("need"), F.sum("quota").over(order).alias("hi"),
                     F.sum("quota").over(Window.partitionBy()).alias("all"))
    per = stored(per.select("s", "source_size", "quota", "n", "need", ((F.col("hi") - F.col("quota")) / F.col("all")).alias("lo"),
                            (F.col("hi") / F.col("all")).alias("hi")), "parts")
    k = per.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    # a point meets the parts of its cell only, so that many sources cost no more for each slot
    cell = lambda c: F.least(F.floor(c * CELLS), F.lit(CELLS - 1))
    parts = per.select("s", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    spread = -(-max(1, k) // 500_000)
    points = spark.range(0, k, 1, spread).select("id", ((F.col("id") + 0.5) * PHI % 1.0).alias("x"))
    points = points.withColumn("cell", cell(F.col("x")))
    hits = points.join(F.broadcast(parts) if parts.count() <= 200_000 else parts, "cell")
    hits = hits.where("x >= lo AND x < hi").select("s", "id")
    # ranks by blocks of positions, so that a source with most slots is not ranked in one task
    hits = hits.withColumn("chunk", F.expr("id div 4096"))
    sums = hits.groupBy("s", "chunk").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inner = Window.partitionBy("s", "chunk").orderBy("id")
    ranked = hits.join(sums, ["s", "chunk"]).select(
        "s", "id", (F.col("base") + F.row_number().over(inner) - 1).alias("r"))
    # in two steps, so that no row holds more than CHUNK numbers
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(need - 1) div {CHUNK}")))
    needed = per.select("s", "source_size", "quota", "n", "need", step.alias("part")).repartition("s", "part")
    top = F.least(F.col("need"), (F.col("part") + 1) * CHUNK) - 1
    needed = needed.select("s", "source_size", "quota", "n", F.explode(F.sequence(F.col("part") * CHUNK, top)).alias("r"))
    slots = needed.join(ranked, ["s", "r"], "left")
    again = F.col("r") >= F.col("n")
    no = F.when(again, F.col("r") - F.col("n")).otherwise(F.col("r"))
    left = F.when(again, F.col("quota") - F.col("source_size")).otherwise(F.least("quota", "source_size")) - no * block
    words = F.least(F.lit(block).cast("long"), left, F.col("source_size") - no * block)
    return slots.select("s", "r", F.coalesce("id", F.lit(k) + F.col("r")).alias("position"), words.alias("words"),
                        no.alias("block_no"), again.cast("int").alias("lap"))


def mixture(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken, begin, first_position, second_position: one row per document.  The
    positions are those of the first slot that takes of it in each lap."""
    placed, goal = stream(docs)
    slots = schedule(goal, block)
    first = F.floor(F.col("begin") / block)
    last = F.greatest(first, F.floor((F.col("begin") + F.col("size") - 1) / block))
    parts = placed.where("size > 0").select("key", "s", "begin", "size", F.explode(F.sequence(first, last)).alias("block_no"))
    at = F.col("block_no") * block
    cut = parts.join(slots, ["s", "block_no"])
    got = F.least(F.col("begin") + F.col("size"), at + F.col("words")) - F.greatest("begin", at)
    taken = cut.withColumn("got", got).where("got > 0").groupBy("key").agg(
        F.sum("got").alias("taken"), F.min(F.when(F.col("lap") == 0, F.col("position"))).alias("first_position"),
        F.min(F.when(F.col("lap") == 1, F.col("position"))).alias("second_position"),
        F.sum(F.when(F.col("lap") == 0, F.col("got")).otherwise(0)).alias("first_lap"))
    return placed.join(taken, "key", "left").join(small(goal, 100_000), "s").select(
        "doc_id", "key", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("first_lap", F.lit(0)).cast("long").alias("first_lap"), "begin", "first_position", "second_position")


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as documents, in the order of the schedule: a row for each lap in which a document is taken, at the place
    of the first slot that takes of it; a part taken is its text up to the
    end of its last word that is taken."""
    got = mixture(docs, block).where("taken > 0")
    lap = lambda n, words, position: F.struct(F.lit(n).alias("lap"), words.alias("words"), F.col(position).alias("position"))
    laps = got.select("key", "size", "begin", F.inline(F.array(
        lap(0, F.col("first_lap"), "first_position"),
        lap(1, F.col("taken") - F.col("first_lap"), "second_position")))).where("words > 0")
    laps = stored(laps, "laps")
    # a row of docs travels as one column, so that no name can clash
    rows = docs.select(F.struct("*").alias("row"), _key().alias("key")).join(laps, "key").dropDuplicates(["key", "lap"])
    text = F.col("row.text")
    text = F.when(F.col("words") == F.col("size"), text).otherwise(first_words(text, F.col("words").cast("int")))
    rows = rows.withColumn("text", text)
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {})
    cols = [new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]
    return rows.orderBy("position", "begin", "key").select(*cols)


def query(spark, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "source_size", "target", "taken", "first_position", "second_position")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(source, '')), 1, 15))::BIGINT AS u
  , row_number() OVER () AS id FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n, [2, 3, 1][1 + row_number() OVER (ORDER BY source NULLS LAST) % 3] AS w
  FROM d GROUP BY source),
-- the level is the one l at which sum(least(2 n, w l)) is the share; try each set of sources that are full below it
levels AS (
  SELECT a.source, (SELECT 1.5::DOUBLE * sum(n) FROM s) - coalesce(sum(2 * b.n) FILTER (b.n / b.w < a.n / a.w), 0) AS rest,
         sum(b.w) FILTER (b.n / b.w >= a.n / a.w) AS w_left, any_value(a.n) / any_value(a.w) AS r
  FROM s a, s b GROUP BY a.source),
level AS (SELECT rest, w_left FROM levels WHERE rest <= 2 * r * w_left ORDER BY r LIMIT 1),
t AS (SELECT source, n, least(2.0::DOUBLE * n, w * rest / w_left::DOUBLE) AS target FROM s, level),
p AS (
  SELECT id, doc_id, d.source, size, n, target, floor(target)::BIGINT AS q,
         sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) - size AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
-- slot k of the schedule belongs to the source in whose part of the cumulative targets frac((k + 1/2) phi) falls
parts AS (
  SELECT source, n, q, ceil(n / 1024)::BIGINT AS blocks,
         (ceil(least(q, n) / 1024) + ceil(greatest(0, q - n) / 1024))::BIGINT AS need,
         sum(q) OVER (ORDER BY source NULLS LAST)::BIGINT AS upto, sum(q) OVER ()::BIGINT AS total
  FROM (SELECT source, n, floor(target)::BIGINT AS q FROM t) WHERE q > 0),
k AS (SELECT coalesce(sum(need), 0)::BIGINT AS slots FROM parts),
points AS (
  SELECT range AS id, ((range + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS x
  FROM range((SELECT slots FROM k))),
hits AS (
  SELECT source, points.id, row_number() OVER (PARTITION BY source ORDER BY points.id) - 1 AS r
  FROM points JOIN parts ON x >= (upto - q) / total::DOUBLE AND x < upto / total::DOUBLE),
slots AS (
  SELECT w.source, CASE WHEN w.r >= blocks THEN 1 ELSE 0 END AS lap, CASE WHEN w.r >= blocks THEN w.r - blocks ELSE w.r END AS no,
         CASE WHEN w.r >= blocks THEN q - n ELSE least(q, n) END AS stop, coalesce(h.id, slots + w.r) AS position
  FROM (SELECT *, unnest(range(need)) AS r FROM parts) w CROSS JOIN k
  LEFT JOIN hits h ON w.source IS NOT DISTINCT FROM h.source AND w.r = h.r),
places AS (
  SELECT p.id, min(position) FILTER (lap = 0) AS first_position, min(position) FILTER (lap = 1) AS second_position
  FROM p JOIN slots ON p.source IS NOT DISTINCT FROM slots.source AND no * 1024 < least(b + size, stop)
                   AND (no + 1) * 1024 > b AND b < stop AND size > 0
  GROUP BY p.id)
SELECT doc_id, size, n AS source_size, target,
       (greatest(0, least(size, least(q, n) - b)) + greatest(0, least(size, q - n - b)))::BIGINT AS taken,
       places.first_position, places.second_position
FROM p LEFT JOIN places USING (id)
"""
