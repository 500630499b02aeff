"""Operator 10, exact duplicates by deterministic block naming.

A text without white space is cut into blocks of fixed size.  Distinct blocks are sorted and take integer names; then
adjacent pairs of names are named in turn, level by level, until each document has one name.  Two documents have the
same (level, name) exactly when their normalised texts are identical: names stand for contents, not for hashes, so
there are no collisions.  A hash serves only to carry a block's name back to its documents without moving the text a
second time; the few hashes that two blocks share are resolved by the block itself.

Names are made in hash-partitioned, sorted order, so equal blocks meet after a map-side combine (a group of copies
sends one block per task), and every level is written to the shared folder.  The loop runs log2(longest text / block)
times over ever fewer rows.

Defined results: a null text counts as empty, and all empty texts are one group; rows that repeat both doc_id and text
are one document; a null doc_id is kept and sorts last among ties; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, stored

BLOCK = 4096
_WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in _WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _named(keys: DataFrame, by: list[str], label: str) -> DataFrame:
    """Distinct keys with an integer name from 1 on; sorted within each partition, so a rerun gives the same names."""
    return stored(keys.groupBy(*by).agg(F.lit(1).alias("_one")).drop("_one").sortWithinPartitions(*by)
                  .withColumn("name", F.monotonically_increasing_id() + 1), label)


def _block_names(blocks: DataFrame) -> DataFrame:
    """(key, idx, n_blocks, name) of every block of every document."""
    names = _named(blocks.select("hash", "block"), ["hash", "block"], "blocks")
    per_hash = names.groupBy("hash").agg(F.min("name").alias("name"), F.count("*").alias("n"))
    slim = stored(blocks.select("key", "idx", "n_blocks", "hash")
                  .join(per_hash.where("n = 1").select("hash", "name"), "hash")
                  .select("key", "idx", "n_blocks", "name"), "first_level")
    shared = stored(per_hash.where("n > 1").select("hash"), "shared_hashes")
    if shared.isEmpty():
        return slim
    return slim.unionByName(
        blocks.join(shared, "hash", "left_semi").join(names, ["hash", "block"])
        .select("key", "idx", "n_blocks", "name"))


def name_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, level, name): one collision-free identity for each distinct (doc_id, text) of docs."""
    text = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), normalised(F.col("text")).alias("norm"))
    pieces = F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    text = text.select("key", pieces.alias("pieces"))
    text = text.select("key", F.greatest(F.lit(1), F.size("pieces")).alias("n_blocks"), "pieces")
    blocks = text.select("key", "n_blocks", F.posexplode_outer("pieces").alias("idx", "block")).select(
        "key", F.coalesce("idx", F.lit(0)).alias("idx"), "n_blocks", F.coalesce("block", F.lit("")).alias("block"))
    blocks = blocks.withColumn("hash", F.xxhash64("block"))
    now = _block_names(blocks)
    done, level = [now.where("n_blocks = 1").select("key", F.lit(0).alias("level"), "name")], 0
    left = now.where("n_blocks > 1")
    while not left.isEmpty():
        level += 1
        even = F.col("idx") % 2 == 0
        pairs = left.groupBy("key", "n_blocks", F.expr("idx div 2").cast("int").alias("idx")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(0)).alias("b"))
        pairs = stored(pairs.withColumn("n_blocks", ((F.col("n_blocks") + 1) / 2).cast("int")), f"pairs{level}")
        names = _named(pairs.select("a", "b"), ["a", "b"], f"names{level}")
        now = stored(pairs.join(names, ["a", "b"]).select("key", "idx", "n_blocks", "name"), f"level{level}")
        done.append(now.where("n_blocks = 1").select("key", F.lit(level).alias("level"), "name"))
        left = now.where("n_blocks > 1")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.distinct()


def exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, key.

    Of equal texts the one with the most code points stays, then the smallest doc_id."""
    identity = name_documents(docs, block)
    facts = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"),
                        F.length(F.coalesce("text", F.lit(""))).alias("n"),
                        F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    facts = facts.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"),
                                     F.first("text_sha256").alias("text_sha256"))
    rows = stored(facts.join(identity, "key"), "identity")
    best = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("void"), "doc_id", "key")
    classes = rows.groupBy("level", "name").agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
    return rows.join(classes, ["level", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("best.key") == F.col("key")).alias("kept"), "text_sha256", "key")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS kept,
       sha256(t) AS text_sha256
FROM d
"""
