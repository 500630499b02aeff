r"""Operator 13, Merkle manifest of a dataset by lag and lead windows.

Every document is a leaf: H of its fields, H the lower-case hex SHA-256 of concatenated inputs.  Leaves of a source ascend
by doc_id.  On each level 16 consecutive nodes form a run, and a run's digests concatenated are hashed to its parent, until
one node is left: the source's subroot.  Subroots in the order of their sources form a second tree of the same kind.

A run is one window partition of at most 16 rows, whatever a source's size.  In it, lag and lead columns of the offsets 1
to 15, masked by the slot and the run's length, give a node its siblings to the left and to the right; the row in the
run's first slot hashes the parent.  Places in the order come from a range-partitioned copy of the leaves: counts per
(range, source), their running sums, and row numbers inside a range, so that no source meets in one task.  Paths are put
together from the top down; the join that brings them to the leaves uses the partitioning of the leaves' windows.

Defined results: a null field is `-`; a null source is a source of its own, the first; null doc_ids come first in their
source; rows that repeat a doc_id follow each other by their digests (rows that repeat all five fields have equal digests,
so their order changes nothing); empty texts are values of zero bytes; extra columns are ignored; an empty table has no
leaves and no rows.  A null doc_id is never tampered with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, stored

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 5  # the query changes documents whose crc32 it divides


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _value(c: Column) -> Column:
    c = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf(text: Column | None = None) -> Column:
    """The digest of a row's fields, with another text if one is given."""
    return digest(*[_value(text if c == "text" and text is not None else F.col(c)) for c in FIELDS])


def _placed(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with `place`, the row's number from 0 in its group by order, and `n`, the group's size; stored."""
    ranges = stored(df.repartitionByRange(group, *order).withColumn("part", F.spark_partition_id()), f"{name}_ranges")
    counts = ranges.groupBy(group, "part").agg(F.count("*").alias("here"))
    through = Window.partitionBy(group).orderBy("part")
    counts = counts.select(group, "part", (F.sum("here").over(through) - F.col("here")).alias("before"),
                           F.sum("here").over(Window.partitionBy(group)).alias("n"))
    at = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order)) - 1
    out = ranges.withColumn("at", at).join(counts, [group, "part"])
    return stored(out.withColumn("place", F.col("at") + F.col("before")).drop("at", "before", "part"), name)


def _with_siblings(nodes: DataFrame, group: str) -> DataFrame:
    """Nodes (group, place, n, digest, ...) with run, slot, and the digests left and right of each node in its run."""
    rows = nodes.withColumn("run", F.floor(F.col("place") / FAN)).withColumn("slot", F.col("place") % FAN)
    rows = rows.withColumn("length", F.least(F.lit(FAN), F.col("n") - F.col("run") * FAN))
    run = Window.partitionBy(group, "run").orderBy("place")
    left = [F.when(F.col("slot") >= i, F.lag("digest", i).over(run)) for i in range(FAN - 1, 0, -1)]
    right = [F.when(F.col("slot") + i < F.col("length"), F.lead("digest", i).over(run)) for i in range(1, FAN)]
    return rows.withColumns({"left": F.concat_ws("", *left), "right": F.concat_ws("", *right)})


def _tree(nodes: DataFrame, group: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Trees over stored nodes (group, place, n, digest): (the tops: group, digest) and, for level 1 and up, the paths
    (group, place, path), path being (left, right) of each level from that node to its top."""
    level, levels = nodes.select(group, "place", "n", "digest"), []
    tops = []
    while True:
        tops.append(level.where("n = 1").select(group, "digest"))
        if level.where("n > 1").isEmpty():
            break
        parents = _with_siblings(level.where("n > 1"), group).where("slot = 0").select(
            group, F.col("run").alias("place"), F.ceil(F.col("n") / FAN).alias("n"),
            digest(F.col("digest"), F.col("right")).alias("digest"))
        level = stored(parents, f"{name}{len(levels) + 1}")
        levels.append(level)
    top = tops[0]
    for one in tops[1:]:
        top = top.unionByName(one)
    none = F.array().cast("array<struct<left:string,right:string>>")
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        here = levels[k].where("n = 1").select(group, "place", none.alias("path"))
        if paths is not None:
            here = here.unionByName(_joined_paths(levels[k].where("n > 1"), paths, group).select(group, "place", "path"))
        paths = stored(here, f"{name}_paths{k + 1}")
    return top, paths


def _joined_paths(nodes: DataFrame, paths: DataFrame, group: str) -> DataFrame:
    """nodes with path: their own siblings, then their parent's path (paths: group, place, path)."""
    up = paths.select(group, F.col("place").alias("run"), F.col("path").alias("up"))
    own = F.array(F.struct("left", "right"))
    return _with_siblings(nodes, group).join(up, [group, "run"]).withColumn("path", F.concat(own, "up"))


def _with_paths(nodes: DataFrame, paths: DataFrame | None, group: str) -> DataFrame:
    """Level 0 with path; a group of one node has an empty one."""
    none = F.array().cast("array<struct<left:string,right:string>>")
    alone = nodes.where("n = 1").withColumn("path", none)
    if paths is None:
        return alone
    return _joined_paths(nodes.where("n > 1"), paths, group).select(*nodes.columns, "path").unionByName(alone)


def fold(start: Column, path: Column) -> Column:
    """The root that a digest and its siblings give."""
    return F.aggregate(path, start, lambda acc, s: digest(s["left"], acc, s["right"]))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path and now, one row per row of docs: path holds (left, right) per level from the
    leaf to the root; `now` is the digest of the row with `changed` as its text (by default its leaf)."""
    key = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit(":"), F.col("source").cast("string")))
    rows = docs.select(*FIELDS).withColumn("digest", leaf())
    now = F.when(changed.isNull() | (changed == F.col("text")), F.col("digest")).otherwise(leaf(changed)) \
        if changed is not None else F.col("digest")
    rows = stored(rows.select(key.alias("s"), "doc_id", "digest", now.alias("now")), "leaves")
    leaves = _placed(rows, "s", ["doc_id", "digest"], "placed")
    tops, paths = _tree(leaves, "s", "level")
    tops = stored(tops.select(F.lit(0).alias("all"), "s", "digest"), "subroots")
    subroots = _placed(tops, "all", ["s"], "placed_subroots")
    root, over = _tree(subroots, "all", "upper")
    upper = _with_paths(subroots, over, "all").select("s", F.col("digest").alias("subroot"), F.col("path").alias("over"),
                                                      "all").join(root.select("all", F.col("digest").alias("root")), "all")
    upper = stored(upper.drop("all"), "upper")
    full = _with_paths(leaves, paths, "s").join(upper, "s")
    return full.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "over").alias("path"),
                       "now")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.crc32(F.col("doc_id").cast("long").cast("string")) % TAMPER == 0
    got = manifest(docs, F.when(hit, ascii_lower(F.col("text"))))
    got = got.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
                     fold(F.col("now"), F.col("path")).alias("folded_root"))
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(levels: int = 7) -> str:
    """The same trees in DuckDB, for up to 16**levels leaves a source and as many sources."""
    crc = ("list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), "
           "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), "
           "lambda y, k: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))").format("doc_id::VARCHAR")
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR"]
    head = " || ".join("coalesce(octet_length(encode({0}))::VARCHAR || ':' || {0}, '-')".format(f) for f in fields)
    text = "coalesce(octet_length(encode({0}))::VARCHAR || ':' || {0}, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [f"""base AS (SELECT doc_id, source, sha256({head} || {text.format('text')}) AS leaf,
        CASE WHEN text IS NOT NULL AND xor({crc}, 4294967295) % {TAMPER} = 0
             THEN sha256({head} || {text.format(low)}) END AS other FROM documents)""",
            """t0 AS (SELECT source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
        count(*) OVER (PARTITION BY source) AS n, leaf AS d, doc_id, coalesce(other, leaf) AS now FROM base)"""]

    def tree(t: str) -> None:
        for k in range(levels):
            ctes.append(f"""{t}{k + 1} AS (SELECT g, p // 16 AS p, (max(n) + 15) // 16 AS n,
        CASE WHEN max(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY p)) END AS d
        FROM {t}{k} GROUP BY g, p // 16)""")
            inner = "PARTITION BY g, p // 16 ORDER BY p ROWS BETWEEN"
            ctes.append(f"""{t}s{k} AS (SELECT g, p, n > 1 AS up,
        coalesce(string_agg(d, '') OVER ({inner} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(d, '') OVER ({inner} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {t}{k})""")

    def walk(t: str, name: str, start: str) -> None:
        """Proof and fold of every row of `start` (columns g, p, proof, now, ...), level by level."""
        last = start
        for k in range(levels):
            ctes.append(f"""{name}{k} AS (SELECT x.* EXCLUDE (proof, now), x.proof || s.l || s.r AS proof,
        CASE WHEN s.up THEN sha256(s.l || x.now || s.r) ELSE x.now END AS now
        FROM {last} x JOIN {t}s{k} s ON x.g IS NOT DISTINCT FROM s.g AND x.p // {16 ** k} = s.p)""")
            last = f"{name}{k}"

    tree("t")
    ctes.append("""u0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p, count(*) OVER () AS n, d,
        g AS source FROM t%d)""" % levels)
    tree("u")
    ctes.append("a AS (SELECT g, p, doc_id, d AS leaf, '' AS proof, now FROM t0)")
    walk("t", "w", "a")
    ctes.append(f"""b AS (SELECT 0 AS g, u0.p, x.doc_id, x.leaf, u0.d AS subroot, x.proof, x.now
        FROM w{levels - 1} x JOIN u0 ON x.g IS NOT DISTINCT FROM u0.source)""")
    walk("u", "v", "b")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT x.doc_id, x.leaf, x.subroot, r.d AS root, sha256(x.proof) AS proof_sha256, x.now AS folded_root,
       x.now = r.d AS verified FROM v{levels - 1} x CROSS JOIN u{levels} r"""


ORACLE = _oracle()
