"""Comparable-sales analysis: $/sqft statistics, GLA adjustment rate and adjusted
values, bracketing, quality score, warnings and summary.

Like calibration, the report is one projection over the document row with the
three comparable slots unrolled; the long outputs (comparables, adjustments) are an
``inline`` of a 3-element array in the same stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fixed0, money0, percent, percent0, round_even0, round_half_up, truthy
from .numbers import with_numbers
from .records import unrolled

SLOTS = (1, 2, 3)

# --------------------------------------------------------------------------
# Warning and message texts, score weights and label cut-offs.
# --------------------------------------------------------------------------
WARN_NO_COMPS = "No valid comparable sales data found. Analysis is limited."
WARN_NO_RATE = "Could not estimate GLA adjustment rate — need at least 2 comps with both sale price and GLA."
MSG_BRACKETED = "Value is properly bracketed by comparable sales."
GLA_RATE_HAIRCUT = 0.25
W_COUNT, W_PROXIMITY, W_BRACKET, W_RANGE = 0.4, 0.3, 0.15, 0.15
PROXIMITY_UNKNOWN, RANGE_UNKNOWN = 0.15, 0.075
STRONG_AT, ADEQUATE_AT = 0.75, 0.50
# --------------------------------------------------------------------------


def _s(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _sum(terms):
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _count(conds):
    return _sum([F.when(c, 1).otherwise(0) for c in conds])


def _any(conds):
    out = F.coalesce(conds[0], F.lit(False))
    for c in conds[1:]:
        out = out | F.coalesce(c, F.lit(False))
    return out


def with_comp_analysis(docs: DataFrame) -> DataFrame:
    df = with_numbers(docs)
    av, gla = F.col("_av"), F.col("_gla")
    cp = {i: F.col(f"_cp{i}") for i in SLOTS}
    cg = {i: F.col(f"_cg{i}") for i in SLOTS}
    subj_ok = truthy(av) & truthy(gla) & (gla > 0)
    stage1 = {
        "_subj_ppsf": F.when(subj_ok, round_half_up(F.try_divide(av, gla), 2)),
        **{f"_pp{i}": F.when(truthy(cp[i]) & truthy(cg[i]) & (cg[i] > 0), round_half_up(F.try_divide(cp[i], cg[i]), 2))
           for i in SLOTS},
        "_n_valid": _count([cp[i].isNotNull() for i in SLOTS]),
    }
    df = df.withColumns(stage1)
    pp = {i: F.col(f"_pp{i}") for i in SLOTS}
    has_pp = [pp[i].isNotNull() for i in SLOTS]
    n_pp = _count(has_pp)
    mean_raw = F.try_divide(_sum([F.coalesce(pp[i], F.lit(0.0)) for i in SLOTS]), n_pp)
    ws = _sum([F.when(pp[i].isNotNull(), F.try_divide(pp[i], cg[i])).otherwise(F.lit(0.0)) for i in SLOTS])
    wt = _sum([F.when(pp[i].isNotNull(), F.try_divide(F.lit(1.0), cg[i])).otherwise(F.lit(0.0)) for i in SLOTS])
    df = df.withColumns({"_n_pp": n_pp, "_mean_raw": mean_raw, "_rate": F.when(wt > 0, F.try_divide(ws, wt))})
    n_pp, mean_raw, rate = F.col("_n_pp"), F.col("_mean_raw"), F.col("_rate")
    sq = _sum([F.when(pp[i].isNotNull(), (pp[i] - mean_raw) * (pp[i] - mean_raw)).otherwise(F.lit(0.0))
               for i in SLOTS])
    std_raw = F.when(n_pp > 1, F.sqrt(F.try_divide(sq, n_pp - 1))).otherwise(F.lit(0.0))
    df = df.withColumns({
        "comp_ppsf_mean": F.when(n_pp > 0, round_half_up(mean_raw, 2)),
        "comp_ppsf_std": F.when(n_pp > 0, round_half_up(std_raw, 2)),
        "comp_ppsf_min": F.when(n_pp > 0, round_half_up(F.least(*[pp[i] for i in SLOTS]), 2)),
        "comp_ppsf_max": F.when(n_pp > 0, round_half_up(F.greatest(*[pp[i] for i in SLOTS]), 2)),
        "subject_vs_mean_pct": F.when(subj_ok & (n_pp > 0),
                                      round_half_up(F.try_divide(F.try_divide(av, gla) - mean_raw, mean_raw), 4)),
        "gla_rate": F.when((n_pp >= 2) & truthy(rate), round_half_up(rate * GLA_RATE_HAIRCUT, 2)),
    })
    rate_c = F.col("gla_rate")
    adj_ok = truthy(rate_c) & truthy(gla)
    adj = {}
    for i in SLOTS:
        has = adj_ok & cp[i].isNotNull() & cg[i].isNotNull()
        diff = gla - cg[i]
        raw = diff * rate_c
        adj[f"_has{i}"] = has
        adj[f"_diff{i}"] = F.when(has, round_even0(diff))
        adj[f"_adj{i}"] = F.when(has, round_even0(raw))
        adj[f"_adjv{i}"] = F.when(has, round_even0(cp[i] + raw))
    df = df.withColumns(adj)
    adjv = [F.col(f"_adjv{i}") for i in SLOTS]
    any_adj = _any([F.col(f"_has{i}") for i in SLOTS])
    low = F.when(any_adj, round_even0(F.least(*adjv)))
    high = F.when(any_adj, round_even0(F.greatest(*adjv)))
    in_range = F.when(any_adj & truthy(av), (low <= av) & (av <= high))
    brk_ok = truthy(av) & (F.col("_n_valid") > 0)
    above = F.when(brk_ok, _any([cp[i] > av for i in SLOTS]))
    below = F.when(brk_ok, _any([cp[i] < av for i in SLOTS]))
    df = df.withColumns({"adj_low": low, "adj_high": high, "in_range": in_range,
                         "has_comp_above": above, "has_comp_below": below})
    above, below, in_range = F.col("has_comp_above"), F.col("has_comp_below"), F.col("in_range")
    bracketed = F.when(brk_ok, above & below)
    brk_msg = (F.when(~brk_ok, F.lit(None).cast("string"))
               .when(above & below, MSG_BRACKETED)
               .when(~above, _s("No comparable sale exceeds the appraised value of $", money0(av),
                                ". UAD guidelines recommend at least one comp above the subject value."))
               .otherwise(_s("No comparable sale is below the appraised value of $", money0(av),
                             ". UAD guidelines recommend at least one comp below the subject value.")))
    vs = F.col("subject_vs_mean_pct")
    score = F.col("_n_valid") / F.lit(3.0) * W_COUNT
    score = score + F.when(vs.isNotNull(), F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(vs) * 2) * W_PROXIMITY) \
        .otherwise(F.lit(PROXIMITY_UNKNOWN))
    score = score + F.when(F.coalesce(bracketed, F.lit(False)), F.lit(W_BRACKET)).otherwise(F.lit(0.0))
    score = score + F.when(in_range, F.lit(W_RANGE)).when(in_range.isNull(), F.lit(RANGE_UNKNOWN)) \
        .otherwise(F.lit(0.0))
    score = round_half_up(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 4)
    df = df.withColumns({"is_bracketed": bracketed, "bracketing_message": brk_msg, "comp_quality_score": score})
    score = F.col("comp_quality_score")
    label = F.when(score >= STRONG_AT, "Strong").when(score >= ADEQUATE_AT, "Adequate").otherwise("Weak")
    low, high = F.col("adj_low"), F.col("adj_high")
    out_msg = _s("Appraised value ($", money0(av), ") falls outside GLA-adjusted comp range ($", money0(low),
                 " – $", money0(high), "). This may indicate additional adjustments are needed.")
    warnings = F.array_compact(F.array(
        F.when(F.col("_n_valid") == 0, F.lit(WARN_NO_COMPS)),
        F.when(adj_ok, F.when(any_adj & truthy(av) & ~in_range, out_msg)).otherwise(F.lit(WARN_NO_RATE)),
        F.when(brk_ok & ~F.col("is_bracketed"), F.col("bracketing_message")),
    ))
    mean_c = F.col("comp_ppsf_mean")
    summary = F.concat_ws(
        " ",
        _s("Comp selection quality: ", label, " (", percent0(score), ")."),
        F.when(truthy(mean_c), _s("Comp $/sqft range: $", fixed0(F.col("comp_ppsf_min")), "–$",
                                  fixed0(F.col("comp_ppsf_max")), " (mean $", fixed0(mean_c), ").")),
        F.when(truthy(av) & vs.isNotNull(),
               _s("Subject implied $/sqft is ", percent(F.abs(vs), 1), " ",
                  F.when(vs > 0, "above").otherwise("below"), " comp mean.")),
        F.when(truthy(low) & truthy(high),
               _s("Appraised value is ", F.when(F.coalesce(in_range, F.lit(False)), "within").otherwise("outside"),
                  " GLA-adjusted comp range ($", money0(low), "–$", money0(high), ").")),
        F.col("bracketing_message"),
    )
    return df.withColumns({"comp_quality_label": label, "comp_warnings": warnings, "comp_summary": summary})


def report_columns() -> list:
    return [
        F.col("_av").alias("subject_appraised_value"),
        F.col("_gla").alias("subject_gla_sqft"),
        F.col("_subj_ppsf").alias("subject_implied_ppsf"),
        F.col("_n_valid").cast("bigint").alias("valid_comp_count"),
        "comp_ppsf_mean", "comp_ppsf_std", "comp_ppsf_min", "comp_ppsf_max", "subject_vs_mean_pct",
        F.col("gla_rate").alias("estimated_gla_rate_per_sqft"),
        F.col("adj_low").alias("adjusted_value_range_low"),
        F.col("adj_high").alias("adjusted_value_range_high"),
        F.col("in_range").alias("appraised_value_in_range"),
        "is_bracketed", "has_comp_above", "has_comp_below", "bracketing_message",
        "comp_quality_score", "comp_quality_label",
        F.array_join("comp_warnings", "\n").alias("warnings"),
        F.col("comp_summary").alias("summary"),
    ]


def analyze_comps(docs: DataFrame) -> DataFrame:
    """Flat comp report: one row per document."""
    return with_comp_analysis(docs).select("doc_id", *report_columns())


def comparable_entries() -> Column:
    return F.array(*[F.struct(F.lit(f"comp_{i}").alias("label"),
                              F.col("fields").getField(f"comp_{i}_address").getField("value").alias("address"),
                              F.col(f"_cp{i}").alias("sale_price"), F.col(f"_cg{i}").alias("gla_sqft"),
                              F.col(f"_pp{i}").alias("price_per_sqft")) for i in SLOTS])


def adjustment_entries() -> Column:
    """One entry per adjusted comparable; none without a rate or a subject GLA."""
    entries = [F.when(F.col(f"_has{i}"), F.struct(
        F.lit(f"comp_{i}").alias("comp"), F.col(f"_cp{i}").alias("comp_sale_price"),
        F.col(f"_diff{i}").alias("gla_difference_sqft"), F.col(f"_adj{i}").alias("adjustment"),
        F.col(f"_adjv{i}").alias("adjusted_comp_value"))) for i in SLOTS]
    return F.array_compact(F.array(*entries))


def nested_report() -> Column:
    """The whole comp report of a document: scalars, blocks of them, comparables, adjustments, the list of warnings."""
    return F.struct(
        F.struct(F.col("_av").alias("appraised_value"), F.col("_gla").alias("gla_sqft"),
                 F.col("_subj_ppsf").alias("implied_ppsf")).alias("subject"),
        F.col("_n_valid").cast("bigint").alias("valid_comp_count"), comparable_entries().alias("comparables"),
        F.struct("comp_ppsf_mean", "comp_ppsf_std", "comp_ppsf_min", "comp_ppsf_max", "subject_vs_mean_pct").alias("ppsf"),
        F.col("gla_rate").alias("estimated_gla_rate_per_sqft"), adjustment_entries().alias("adjustments"),
        F.struct(F.col("adj_low").alias("low"), F.col("adj_high").alias("high"),
                 F.col("in_range").alias("appraised_value_in_range")).alias("adjusted_value_range"),
        F.struct("is_bracketed", "has_comp_above", "has_comp_below", F.col("bracketing_message").alias("message"))
        .alias("bracketing"),
        "comp_quality_score", "comp_quality_label", F.col("comp_warnings").alias("warnings"),
        F.col("comp_summary").alias("summary"))


def parse_comparables(docs: DataFrame) -> DataFrame:
    """Three rows per document: label, address, parsed price and GLA, rounded $/sqft."""
    return unrolled(with_comp_analysis(docs).select("doc_id", comparable_entries().alias("_entries")), "doc_id")


def gla_adjustments(docs: DataFrame) -> DataFrame:
    """One row per adjusted comparable (needs a rate, a subject GLA and the comp's price and GLA)."""
    df = with_comp_analysis(docs)
    entries = [F.struct(F.lit(f"comp_{i}").alias("comp"), F.col(f"_has{i}").alias("_has"),
                        F.col(f"_cp{i}").alias("comp_sale_price"), F.col(f"_diff{i}").alias("gla_difference_sqft"),
                        F.col(f"_adj{i}").alias("adjustment"), F.col(f"_adjv{i}").alias("adjusted_comp_value"))
               for i in SLOTS]
    df = df.select("doc_id", F.col("gla_rate").alias("estimated_rate_per_sqft"), F.array(*entries).alias("_entries"))
    return (unrolled(df, "doc_id", "estimated_rate_per_sqft")
            .filter(F.col("_has")).drop("_has"))


def comp_warnings(docs: DataFrame) -> DataFrame:
    """One row per warning, in order.  The outer form keeps the optimizer from testing the list with a filter that makes it
    first; a document without warnings has no row."""
    return (with_comp_analysis(docs).select("doc_id", F.col("comp_warnings").alias("_entries"))
            .select("doc_id", F.posexplode_outer("_entries").alias("warning_ord", "warning"))
            .filter(F.col("warning_ord").isNotNull()))
