"""Operators across the members of one group (for example all instruments at one time)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import PART, Running, last_rows, ordinals, range_buckets, running
from tidemark.session import cut_lineage

# Slices of the score axis in which spans are counted along time, for each doubling of a score.
SLICES = 16
# Steps of time that share a row of slice counts.
STEPS = 8


def placed_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, _same, _below): how often each value occurs, and how many rows of its group lie below.

    Copies are counted first, so a group in which all are equal is one row; the distinct values are dealt
    by sampled ranges, so a crowded group is many tasks.
    """
    values = df.groupBy(*keys, value).agg(F.count("*").alias("_same"))
    return running(
        range_buckets(values, [*keys, value]), keys, [value], F.col(PART),
        {"_below": Running("sum", F.col("_same"), exclusive=True)},
    ).drop(PART)


def percentile_rank(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Average-rank percentile in (0, 1]: ties share the mean of their ranks. NULL scores have none."""
    known = df.filter(F.col(score).isNotNull())
    placed = placed_values(known, keys, score)
    totals = known.groupBy(*keys).agg(F.count("*").alias("_total"))
    rank = (F.col("_below") + 1 + (F.col("_same") - 1) / 2.0) / F.col("_total")
    return (
        known.join(placed, [*keys, score]).join(totals, list(keys))
        .withColumn("pct_rank", rank).drop("_same", "_below", "_total")
    )


def score_slice(score: Column) -> Column:
    """The score rounded to few binary digits: it never falls as the score rises, and near scores share it."""
    wide = score * F.lit(2.0 ** 52 / SLICES + 1)
    ends = F.when(score > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(F.abs(score) < 1e290, wide - (wide - score)).when(F.isnan(score), score).otherwise(ends)


def span_cuts(
    spans: DataFrame, keys: Sequence[str], score: str, share: float, start: str = "enter", stop: str = "until",
    lowest: float | None = None,
) -> DataFrame:
    """(keys, idx, sure, least): the score from which the percentile reaches ``share``, one row a step.

    Scores up to ``lowest`` are counted, but a cut-off among them is not looked for.

    The percentile is that of ``percentile_rank`` among the spans that hold at the step; it is reached in
    slices from ``sure`` on, and by scores from ``least`` on. No panel is built: spans come and go as +1 and -1 on
    slices of the score axis; running sums give each step's count per slice, and so the slice in which the
    cut-off lies. Only spans in that slice are expanded and ranked by value.
    """
    c = F.col
    place = score_slice(c(score))
    if lowest is not None:
        place = F.when(c(score) > lowest, place).otherwise(float("-inf"))
    sliced = spans.select(*keys, score, start, stop, place.alias("_slice"))
    moves = sliced.select(*keys, "_slice", F.inline(F.array(
        F.struct(c(start).alias("_at"), F.lit(1).alias("_d")),
        F.struct((c(stop) + 1).alias("_at"), F.lit(-1).alias("_d")),
    ))).groupBy(*keys, "_slice", "_at").agg(F.sum("_d").alias("_d"))
    # A slice has a row for each step at most, a step one for each slice.
    along = Window.partitionBy(*keys, "_slice").orderBy("_at")
    levels = moves.select(
        *keys, "_slice", "_at", F.sum("_d").over(along).alias("_n"), F.lead("_at").over(along).alias("_end")
    ).filter("_n > 0")
    counts = levels.select(*keys, "_slice", "_n", F.explode(F.sequence("_at", c("_end") - 1)).alias("idx"))
    step = Window.partitionBy(*keys, "idx")
    below = F.coalesce(
        F.sum("_n").over(step.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    placed = cut_lineage(counts.withColumns({"_below": below, "_total": F.sum("_n").over(step)}).filter(
        (c("_below") + c("_n")) / c("_total") >= share
    ).withColumn("_sure", (c("_below") + 1) / c("_total") >= share))
    if lowest is not None:
        placed = placed.filter(c("_slice") > float("-inf"))
    sure = placed.groupBy(*keys, "idx").agg(F.min(F.when(c("_sure"), c("_slice"))).alias("sure"))
    reached = cut_lineage(
        placed.filter(~c("_sure")).groupBy(*keys, "_slice", F.expr(f"idx div {STEPS}").alias("_bin"))
        .agg(F.collect_list(F.struct("idx", "_below", "_total")).alias("_steps"))  # at most one entry a step
    )
    pieces = sliced.withColumn(
        "_bin", F.explode(F.sequence(F.expr(f"{start} div {STEPS}"), F.expr(f"{stop} div {STEPS}")))
    ).join(reached, [*keys, "_slice", "_bin"])
    inside = F.filter("_steps", lambda x: x["idx"].between(c(start), c(stop)))
    edge = cut_lineage(pieces.select(*keys, score, F.inline(inside)).groupBy(*keys, "idx", score).agg(
        F.count("*").alias("_same"), F.max("_below").alias("_below"), F.max("_total").alias("_total")))
    values = running(
        range_buckets(edge, [*keys, "idx", score]), [*keys, "idx"], [score], F.col(PART),
        {"_under": Running("sum", c("_same"), exclusive=True)},
    )
    rank = (c("_below") + c("_under") + 1 + (c("_same") - 1) / 2.0) / c("_total")
    least = values.filter(rank >= share).groupBy(*keys, "idx").agg(F.min(score).alias("least"))
    return cut_lineage(sure.join(least, [*keys, "idx"], "left"))


def reaches(score: Column, sure: Column, least: Column) -> Column:
    """Whether a score is above the cut-off of its step (``span_cuts``)."""
    return F.coalesce(score >= least, F.lit(False)) | F.coalesce(score_slice(score) >= sure, F.lit(False))


def above_cuts(
    spans: DataFrame, cuts: DataFrame, keys: Sequence[str], score: str, start: str = "enter", stop: str = "until"
) -> DataFrame:
    """Spans of time, one row for each step at which the score is above the step's cut-off."""
    kept = [x for x in spans.columns if x not in (start, stop)]
    cells = spans.select(*kept, F.explode(F.sequence(start, stop)).alias("idx"))
    return cells.join(cuts, [*keys, "idx"]).filter(reaches(F.col(score), F.col("sure"), F.col("least"))).select(*kept, "idx")


def top_spans(
    spans: DataFrame, keys: Sequence[str], score: str, share: float, start: str = "enter", stop: str = "until"
) -> DataFrame:
    """Spans of time with a score, one row for each step at which the score's percentile reaches ``share``.

    ``spans`` is read several times and should be a stored table.
    """
    return above_cuts(spans, span_cuts(spans, keys, score, share, start, stop), keys, score, start, stop)


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, tie: str, name: str = "median"
) -> DataFrame:
    """Median by position rather than by collecting a group: average of the middle one or two."""
    known = df.filter(F.col(value).isNotNull()).select(*keys, value, tie)
    placed = ordinals(
        range_buckets(known, [*keys, value, tie]), keys, [value, tie], F.col(PART), "_place"
    )
    size = known.groupBy(*keys).agg(F.count("*").alias("_n"))
    sized = placed.join(size, list(keys)) if keys else placed.withColumn("_n", size.scalar())
    middle = sized.filter(
        F.col("_place").between(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1)
    )
    return middle.groupBy(*keys).agg(F.avg(value).alias(name))


def capped_weights(
    df: DataFrame,
    keys: Sequence[str],
    weight: str,
    member: str,
    budget: float,
    cap: float,
    name: str = "weight",
) -> DataFrame:
    """Share a budget in proportion to ``weight`` with at most ``cap`` per member.

    At most budget/cap members can sit at the cap and they are the heaviest ones. So only the few
    heaviest per group are ordered (cut map-side); everyone else needs just the group total.
    """
    terms = capped_terms(df, keys, weight, member, budget, cap)
    share = capped_share(F.col(weight), F.col(member), budget, cap)
    return df.join(terms, list(keys)).withColumn(name, share).drop("_k", "_rest", "_edge")


def capped_terms(
    df: DataFrame, keys: Sequence[str], weight: str, member: str, budget: float, cap: float
) -> DataFrame:
    """(keys, _k, _rest, _edge): what ``capped_share`` needs to know of a group."""
    w = F.greatest(F.col(weight), F.lit(0.0))
    rows = df.withColumn("_w", w)
    most = int(math.floor(budget / cap + 1e-9)) + 1
    totals = rows.groupBy(*keys).agg(F.sum("_w").alias("_total"), F.count("*").alias("_members"))
    top = last_rows(
        rows.select(*keys, member, "_w"), keys, [F.col("_w").desc(), F.col(member)], most
    ).join(totals, list(keys))
    ahead = Window.partitionBy(*keys).orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("_rank") - 1
    left = F.greatest(F.lit(budget) - place * cap, F.lit(0.0))
    top = top.withColumn("_ahead", F.coalesce(F.sum("_w").over(ahead), F.lit(0.0))).withColumn(
        "_open", F.col("_w") * left / F.nullif(F.col("_total") - F.col("_ahead"), F.lit(0.0))
        <= F.lit(cap * (1 + 1e-12))
    )
    first_open = F.min(F.when(F.col("_open"), F.struct(place.alias("k"), F.col("_ahead"))))
    return (
        top.groupBy(*keys)
        .agg(
            first_open.alias("_cut"),
            F.first("_total").alias("_total"),
            F.first("_members").alias("_members"),
            F.transform(
                F.array_sort(F.collect_list(F.struct("_rank", "_w", F.col(member).alias("_m")))),
                lambda x: F.struct(x["_w"].alias("_w"), x["_m"].alias("_m")),
            ).alias("_top"),
        )
        .withColumns(
            {
                "_k": F.coalesce(F.col("_cut.k").cast("int"), F.col("_members").cast("int")),
                "_rest": F.col("_total") - F.col("_cut._ahead"),
            }
        )
        .select(
            *keys, "_k", "_rest", F.when(F.col("_k") > 0, F.try_element_at("_top", "_k")).alias("_edge")
        )
    )


def capped_share(weight: Column, member: Column, budget: float, cap: float) -> Column:
    """A member's share from the terms of its group: the cap for the heaviest, in proportion for the rest."""
    w, edge = F.greatest(weight, F.lit(0.0)), F.col("_edge")
    capped = F.coalesce((w > edge["_w"]) | ((w == edge["_w"]) & (member <= edge["_m"])), F.lit(False))
    share = w * F.greatest(F.lit(budget) - F.col("_k") * cap, F.lit(0.0)) / F.col("_rest")
    return F.when(capped, F.lit(float(cap))).otherwise(F.coalesce(share, F.lit(0.0)))


def concentration_rules(
    weights: DataFrame, keys: Sequence[str], limits, member: str = "instrument_id"
) -> DataFrame:
    """Cap breaches of a weighted portfolio: per member, per class, and the cash floor.

    ``weights`` carries the member, its weight and its asset class, industry and region.
    One pass with grouping sets covers the member, the three attributes and the whole.
    """
    sets = [member, "asset_class", "industry", "region"]
    long = weights.select(
        *keys,
        "weight",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("level"), F.col(c).cast("string").alias("item"))
                    for i, c in enumerate(sets)
                ],
                F.struct(F.lit(4).alias("level"), F.lit("").alias("item")),
            )
        ).alias("_g"),
    )
    sums = long.groupBy(*keys, "_g").agg(F.sum("weight").alias("total"))
    caps = F.array(
        *[
            F.lit(float(x))
            for x in (limits.single_cap, limits.asset_class_cap, limits.industry_cap,
                      limits.region_cap, 1 - limits.cash_floor)
        ]
    )
    # Rule codes.
    codes = F.array(
        *[
            F.lit(x)
            for x in ("SINGLE_ETF_CAP", "ASSET_CLASS_CAP", "INDUSTRY_CAP", "REGION_CAP",
                      "CASH_FLOOR")
        ]
    )
    level = F.col("_g.level")
    code = F.element_at(codes, level + 1)
    return sums.filter(F.col("total") > F.element_at(caps, level + 1) + 1e-9).select(
        *keys,
        level.alias("level"),
        F.when(level == 4, code).otherwise(F.concat_ws(":", code, F.col("_g.item"))).alias("rule"),
        "total",
    )
