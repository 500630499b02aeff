r"""Operator 2, personal data: expressions propose spans, checksums confirm them, nearby words adjust a score.

Each kind's expression proposes leftmost, non-overlapping spans of the whole text.  A text is split at the proposals, so
their places are running sums of the lengths of the pieces between; only proposals are shuffled, with one header row per
document.  Validators drop those that fail: parts over 255 (ip), Luhn (card), the count of digits (phone), mod-97
(iban).  The score is a prior by kind, plus a bonus if a word of the kind's list stands within CONTEXT characters before
or half as many after.  The base kinds (email, ip, card, phone) stay whatever their score; the added kinds (iban, ssn)
need MIN_SCORE.

The expressions match what the contract's do, but are possessive and start at the start of a run only (or where the
last match ended), so that long runs take linear time and no stack.

Defined results: a null text counts as empty; every input row gives one row, repeated ones too; a null doc_id is kept;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
CONTEXT = 40
MIN_SCORE = 0.5
BONUS = 0.3
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
NEAR = {
    "email": "mail|contact|write", "ip": "ip|server|host|address", "card": "card|visa|credit|payment|karte|carte",
    "phone": "phone|call|tel|mobile|fax", "iban": "iban|account|bank|konto", "ssn": "ssn|social|security|insurance",
}
_LABEL = "[A-Za-z0-9-]"
_LOCAL = "[A-Za-z0-9._%+-]"
PROPOSE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # the maximal chains of 13 to 19 digits; longer and shorter ones fail the validator as a whole
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)"
            r"(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def luhn(digits: Column) -> Column:
    """Luhn's check of a column of at most 19 digits, written out without a lambda."""
    total = F.lit(0)
    right = F.reverse(digits)
    for i in range(19):
        d = F.substring(right, i + 1, 1).try_cast("int")
        d = F.coalesce(d if i % 2 == 0 else 2 * d - 9 * (d > 4).cast("int"), F.lit(0))
        total = total + d
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 13616: the first four characters go last, letters count 10 to 35, the remainder is 1."""
    moved = F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4))
    chars = F.split(moved, "")
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.when(c == "", acc).otherwise(
        (F.when(value(c) > 9, acc * 100).otherwise(acc * 10) + value(c)) % 97)
    return F.aggregate(chars, F.lit(0), step) == 1


def _proposed(kind: str) -> Column:
    """Array of (kind_no, i, gap, gap text before, match, text after) of one kind."""
    no, pattern = KINDS.index(kind), F.lit(PROPOSE[kind])
    found, gaps = F.col(f"m_{kind}"), F.col(f"g_{kind}")
    made = F.transform(found, lambda m, i: F.struct(
        F.lit(no).alias("kind_no"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"),
        F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), m.alias("match"),
        F.left(F.get(gaps, i + 1), F.lit(CONTEXT // 2)).alias("after")))
    return made


def find(docs: DataFrame) -> DataFrame:
    """doc_id and found: array of (kind_no, kind, start, end, score), by kind, then start; ends are exclusive."""
    text = docs.select("doc_id", F.monotonically_increasing_id().alias("row"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    could = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+")}
    hit = text.select("doc_id", "row", "text", *[
        F.when(could.get(k, F.lit(True)), F.regexp_extract_all("text", F.lit(PROPOSE[k]), F.lit(0)))
        .otherwise(F.array().cast("array<string>")).alias(f"m_{k}") for k in KINDS])
    cut = hit.select("doc_id", "row", *[f"m_{k}" for k in KINDS], *[
        F.when(F.size(f"m_{k}") > 0, F.split("text", PROPOSE[k], -1)).alias(f"g_{k}") for k in KINDS])
    header = F.array(F.struct(F.lit(-1).alias("kind_no"), F.lit(0).alias("i"), F.lit(0).alias("gap"),
                              F.lit("").alias("before"), F.lit("").alias("match"), F.lit("").alias("after")))
    rows = cut.select("doc_id", "row", F.inline(F.concat(header, *[_proposed(k) for k in KINDS])))
    rows = rows.repartition("row")
    upto = Window.partitionBy("row", "kind_no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("match")
    rows = rows.withColumn("end", F.sum(F.col("gap") + size).over(upto)).withColumn("start", F.col("end") - size)
    digits = F.regexp_replace("match", "[^0-9]", "")
    plain = F.replace("match", F.lit(" "), F.lit(""))
    valid = {"email": F.lit(True), "ip": F.col("match").rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), "card": luhn(digits),
             "phone": F.length(digits).between(9, 15), "iban": F.length(plain).between(15, 34) & mod97(plain),
             "ssn": ~F.col("match").rlike("^(?:000|666|9)|-00-|-0000$")}
    kind = F.col("kind_no")
    pick = lambda by: reduce(lambda c, k: c.when(kind == KINDS.index(k), by(k)), KINDS[1:],
                             F.when(kind == 0, by("email")))
    near = pick(lambda k: F.lower(F.concat("before", F.lit(" "), "after")).rlike(rf"\b(?:{NEAR[k]})"))
    score = pick(lambda k: F.lit(PRIOR[k])) + F.when(near, F.lit(BONUS)).otherwise(F.lit(0.0))
    keep = pick(lambda k: valid[k]) & ((kind < len(BASE)) | (score >= MIN_SCORE))
    span = F.struct("kind_no", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
                    pick(F.lit).alias("kind"), F.least(F.lit(1.0), score).alias("score"))
    return rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"),
                                   F.array_sort(F.collect_list(F.when((kind >= 0) & keep, span))).alias("found"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat(s.kind, F.lit(":"), s.start, F.lit(":"), s.end)), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("found", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda s: s.kind_no < len(BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("found")).alias("spans"))
