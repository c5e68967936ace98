"""Landed JSON payloads to fact and news rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import name_based_id
from tidemark.functions.text import (
    cluster_key, injection_suspected, normalize_url, parse_feed_time, plain_text,
)

# Members every bar element must carry.
BAR_FIELDS = ("datetime", "open", "high", "low", "close", "volume")
# Fixed value: namespace of instrument ids derived from market and symbol.
INSTRUMENT_NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def bars_from_json(df: DataFrame, payload: str, strict: bool = True) -> DataFrame:
    """Explode ``{"values": [...]}`` into bars; unknown measures stay NULL.

    An element without a required member, or with one that is not a number, is a changed schema:
    strict mode fails the job, otherwise ``problem`` says what is wrong.
    """
    parsed = F.from_json(payload, "struct<values:array<map<string,string>>>")
    rows = df.withColumn("_values", parsed["values"]).select(
        "*", F.posexplode_outer("_values").alias("element", "_v")
    )
    v = F.col("_v")
    present = [F.coalesce(F.map_contains_key(v, f), F.lit(False)) for f in BAR_FIELDS]
    numbers = {f: v[f].try_cast("double") for f in BAR_FIELDS[1:]}
    missing = F.array_compact(
        F.array(*[F.when(~p, F.lit(f)) for f, p in zip(BAR_FIELDS, present)])
    )
    at = F.coalesce(
        F.try_to_timestamp(v["datetime"], F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(v["datetime"], F.lit("yyyy-MM-dd")),
    )
    bad_number = F.exists(F.array(*numbers.values()), lambda x: x.isNull())
    problem = (
        F.when(F.col("_values").isNull(), "no values array")
        .when(F.col("_v").isNull(), "empty response")
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ",")))
        .when(at.isNull() | bad_number, "not parsable")
    )
    if strict:
        problem = F.when(problem.isNotNull(), F.raise_error(problem).cast("string"))
    nothing = F.lit(None).cast("double")
    return rows.select(
        *df.columns, "element", at.alias("event_time"),
        *[c.alias(f) for f, c in numbers.items()],
        numbers["close"].alias("adjusted_close"), numbers["close"].alias("total_return_close"),
        nothing.alias("bid_ask_spread_bps"), F.lit(1.0).alias("fx_rate"),
        F.lit(0.0).alias("dividend"), F.lit(1.0).alias("split_factor"),
        nothing.alias("expense_ratio"), nothing.alias("nav_premium_bps"),
        nothing.alias("tracking_error"),
        F.array(F.lit("CORPORATE_ACTION_ADJUSTMENT_NOT_VERIFIED")).alias("quality_flags"),
        F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(v)))), 256)
        .alias("raw_payload_hash"),
        problem.alias("problem"),
    )


def articles_from_json(df: DataFrame, payload: str, closed: bool = False) -> DataFrame:
    """Explode ``{"articles": [...]}``; items without url, title or a readable time are skipped.

    ``closed`` is that of ``plain_text``.
    """
    shape = "struct<articles:array<struct<url:string,title:string,domain:string,seendate:string>>>"
    a = F.col("_a")
    title = plain_text(a["title"], 500, closed)
    source = plain_text(F.coalesce(a["domain"], F.lit("unknown")), 160, closed)
    rows = df.withColumn("_parsed", F.from_json(payload, shape)).select(
        *df.columns, F.explode("_parsed.articles").alias("_a")
    )
    rows = rows.filter((a["url"] != "") & (a["title"] != "")).select(
        *df.columns,
        normalize_url(a["url"]).alias("normalized_url"),
        title.alias("title"), source.alias("source_name"),
        parse_feed_time(a["seendate"]).alias("event_time"),
    ).filter(F.col("event_time").isNotNull())
    suspected = F.when(
        injection_suspected(F.col("title")) | injection_suspected(F.col("source_name")),
        F.array(F.lit("PROMPT_INJECTION_SUSPECTED")),
    ).otherwise(F.array().cast("array<string>"))
    seen = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss")
    return rows.withColumns(
        {
            "published_at": F.lit(None).cast("timestamp"),
            **{c: F.col("event_time") for c in ("first_seen_at", "available_at", "as_of")},
            "quality_flags": F.concat(
                suspected,
                F.array(F.lit("ENTITY_MAPPING_REQUIRED"), F.lit("PUBLISHED_AT_UNAVAILABLE")),
            ),
            "cluster_key": cluster_key(F.col("title")),
            "raw_payload_hash": F.sha2(
                F.concat_ws("\x1f", "normalized_url", "title", seen), 256
            ),
        }
    )


def instrument_id(mic: Column, symbol: Column) -> Column:
    return name_based_id(INSTRUMENT_NAMESPACE, F.concat_ws(":", mic, symbol))


def resolve_identifiers(
    requests: DataFrame, candidates: DataFrame, rank: str = "position"
) -> DataFrame:
    """Exact symbol, optional market, first candidate by rank; unmatched requests keep NULLs.

    The first match is a combinable aggregate, so a symbol listed everywhere is reduced map-side.
    """
    best = lambda keys: candidates.groupBy(*keys).agg(
        F.min_by(F.struct("symbol", F.col("mic").alias("found_mic")), rank).alias("_c")
    )
    # The market is optional: with one the exact pair counts, without one the first listing does.
    exact = best(["symbol", "mic"]).select("symbol", "mic", F.col("_c").alias("_exact"))
    loose = best(["symbol"]).select("symbol", F.col("_c").alias("_loose"))
    found = requests.join(exact, ["symbol", "mic"], "left").join(loose, "symbol", "left")
    pick = F.when(F.col("mic").isNotNull(), F.col("_exact")).otherwise(F.col("_loose"))
    return found.withColumn("_p", pick).select(
        *requests.columns, F.col("_p.found_mic").alias("found_mic"),
        F.when(F.col("_p").isNotNull(), instrument_id(F.col("_p.found_mic"), F.col("symbol")))
        .alias("instrument_id"),
    )


def holdings(positions: DataFrame, day: str = "as_of") -> DataFrame:
    """Weights of reported positions (instrument_id, holding_id, as-of day, value), knowable a day later.

    A weight is the position's share of its instrument's total of the day; totals are aggregated, so an
    instrument with very many positions isn't gathered.
    """
    held = positions.groupBy("instrument_id", "holding_id", day).agg(F.sum("value").alias("_value"))
    totals = positions.groupBy("instrument_id", day).agg(F.sum("value").alias("_total"))
    return held.join(totals, ["instrument_id", day]).select(
        "instrument_id", "holding_id", F.try_divide("_value", "_total").alias("weight"),
        F.col(day).alias("as_of"), (F.col(day) + F.expr("make_dt_interval(1)")).alias("available_at"),
    )
