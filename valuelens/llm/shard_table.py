"""Operator 5, sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table: it starts at an offset and goes on by
a skip, both taken from a digest of its name.  The shards take turns, each claiming the first slot of its order that is
free, until the table is full.  A document's key picks a slot, and the slot's owner is its shard: one lookup in a
broadcast table of fixed size, no shuffle, and few documents move when a shard is added or removed.

The table's size is a parameter, not a property of the data, so its broadcast is bounded.  The default of 2,039 slots
for 16 shards gives each shard 127 or 128 of them.

Defined results: a document with a null doc_id is placed by its text (null: empty), so such rows spread as well; rows
that repeat go to the same shard; extra columns are kept, but for own columns named slot or shard, which are replaced;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 16
SLOTS = 2039


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """The owner (index into names) of each slot.  slots must be a prime above the number of names."""
    if slots <= len(names) or any(slots % d == 0 for d in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("slots must be a prime above the number of shards")
    at = [_digest(f"{n}/offset") % slots for n in names]
    skip = [_digest(f"{n}/skip") % (slots - 1) + 1 for n in names]
    owner = [-1] * slots
    for turn in range(slots):
        who = turn % len(names)
        while owner[at[who]] >= 0:
            at[who] = (at[who] + skip[who]) % slots
        owner[at[who]] = who
    return owner


def lookup_table(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard), one row per slot."""
    owners = F.split(F.lit(",".join(map(str, fill(names, slots)))), ",")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "shard")).select(
        "slot", F.col("shard").cast("int").alias("shard"))


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % slots).cast("int")


def placed(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """docs with the columns slot and shard."""
    table = lookup_table(docs.sparkSession, [f"shard-{i:05d}" for i in range(shards)], slots)
    rows = docs.drop("shard").withColumn("slot", slot_of(F.col("doc_id"), F.col("text"), slots))
    return rows.join(F.broadcast(table), "slot").select(*[c for c in rows.columns if c != "slot"], "slot", "shard")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return placed(docs).select("doc_id", "slot", "shard")


def _oracle(documents: str = "documents", columns: str = "doc_id") -> str:
    """The table is filled here once more, by searching each preference order from its start."""
    orders = []
    for i in range(SHARDS):
        a, b = (int(hashlib.md5(f"shard-{i:05d}/{w}".encode()).hexdigest()[:8], 16) for w in ("offset", "skip"))
        orders.append([(a % SLOTS + j * (b % (SLOTS - 1) + 1)) % SLOTS for j in range(SLOTS)])
    owner: dict[int, int] = {}
    while len(owner) < SLOTS:
        for i, order in enumerate(orders):
            if len(owner) < SLOTS:
                owner[next(s for s in order if s not in owner)] = i
    table = ",".join(str(owner[s]) for s in range(SLOTS))
    key = "coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))"
    return f"""
WITH d AS (SELECT {columns}, (('0x' || substr(md5({key}), 1, 8))::BIGINT % {SLOTS})::INTEGER AS slot FROM {documents})
SELECT {columns}, slot, ([{table}])[slot + 1] AS shard FROM d
"""


ORACLE = _oracle()
