"""News scoring: first matching exposure, time decay, and the strongest items per instrument."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clocks import cutoff
from tidemark.operators.ordered import last_rows
from tidemark.settings import DATA_MODES

HALF_LIFE_HOURS = 72
MIN_CONFIDENCE = 0.60
PROFILE = {"ASSET_CLASS": "asset_class", "REGION": "region", "INDUSTRY": "industry"}


def usable_news(news: DataFrame, at: datetime) -> DataFrame:
    c = F.col
    return news.filter(
        (c("available_at") <= cutoff(at, "utc")) & (c("source_uri") != "")
        & c("data_mode").isin(*DATA_MODES)
        & ~F.coalesce(F.array_contains("quality_flags", "PROMPT_INJECTION_SUSPECTED"), F.lit(False))
    )


def _impact(at: datetime) -> Column:
    c = F.col
    age = (F.unix_micros(cutoff(at, "utc")) - F.unix_micros(c("available_at"))) / 3.6e9
    decay = F.exp(-math.log(2) * F.greatest(F.lit(0.0), age) / HALF_LIFE_HOURS)
    return (
        c("direction") * c("relevance") * c("severity") * c("novelty") * c("source_grade"), decay
    )


def _profiles(instruments: DataFrame) -> DataFrame:
    return instruments.select(*PROFILE.values()).distinct()


def _first_match(signature: DataFrame, profiles: DataFrame) -> DataFrame:
    """For each (signature, profile): position of the first exposure that fits the profile.

    Signatures are distinct ordered exposure lists and profiles distinct attribute triples, so the
    work grows with the kinds of exposure and of instrument, not with news times instruments.
    """
    wanted = profiles.select(
        *PROFILE.values(),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k).alias("type"), F.col(v).alias("value"))
                    for k, v in PROFILE.items()
                ]
            )
        ).alias("_x"),
    )
    listed = signature.select("signature", F.posexplode("signature").alias("_pos", "_x"))
    hits = listed.join(wanted, "_x")
    return hits.groupBy("signature", *PROFILE.values()).agg(F.min("_pos").alias("_pos"))


def _positioned(news: DataFrame, at: datetime) -> DataFrame:
    """One row per (news, exposure position) with its value if that exposure is the match."""
    base, decay = _impact(at)
    signature = F.transform("exposures", lambda e: F.struct(e["type"].alias("type"),
                                                            e["value"].alias("value")))
    rows = usable_news(news, at).select(
        "event_id", signature.alias("signature"), base.alias("_base"), decay.alias("_decay"),
        F.posexplode("exposures").alias("_pos", "_e"),
    )
    # An exposure of low confidence stays in the list: matched first, it blocks later ones.
    return rows.filter(F.col("_e.confidence") >= MIN_CONFIDENCE).select(
        "event_id", "signature", "_pos",
        (F.col("_base") * F.col("_e.confidence") * F.col("_decay")).alias("value"),
    )


def news_scores(news: DataFrame, instruments: DataFrame, at: datetime) -> DataFrame:
    """Sum of matched news values per instrument, clipped to [-1, 1]; zero without news.

    Values are summed per (exposure list, position) before they meet the instruments.
    """
    sums = _positioned(news, at).groupBy("signature", "_pos").agg(F.sum("value").alias("value"))
    matches = _first_match(sums.select("signature").distinct(), _profiles(instruments))
    per_profile = (
        matches.join(sums, ["signature", "_pos"]).groupBy(*PROFILE.values())
        .agg(F.sum("value").alias("total"))
    )
    clipped = F.least(F.greatest(F.coalesce("total", F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))
    return instruments.join(per_profile, list(PROFILE.values()), "left").select(
        "instrument_id", clipped.alias("news_score")
    )


def news_evidence(news: DataFrame, instruments: DataFrame, at: datetime, top: int = 5) -> DataFrame:
    """The ``top`` strongest matched items per instrument, ties by event id.

    Only the strongest few per (exposure list, position) can be among them.
    """
    order = [F.round(F.abs("value"), 9).desc(), F.col("event_id")]
    rows = _positioned(news, at)
    strongest = last_rows(rows, ["signature", "_pos"], order, top).drop("_rank")
    matches = _first_match(strongest.select("signature").distinct(), _profiles(instruments))
    candidates = matches.join(strongest, ["signature", "_pos"])
    best = last_rows(candidates, list(PROFILE.values()), order, top)
    return best.join(instruments, list(PROFILE.values())).select(
        "instrument_id", "event_id", F.col("_rank").alias("place"), "value"
    )


def news_links(news: DataFrame, at: datetime) -> DataFrame:
    """Distinct source links of usable news, sorted inside each kind of exposure."""
    rows = usable_news(news, at)
    return rows.select(F.explode("exposures").alias("e"), "source_uri").groupBy(
        F.col("e.type").alias("type"), F.col("e.value").alias("value")
    ).agg(F.count_distinct("source_uri").alias("links"))
