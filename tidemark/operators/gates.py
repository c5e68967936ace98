"""Fail-closed gates: each one turns a row into an ordered array of reason codes.

The codes are fixed values of the data model; an empty array means the row may pass.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clocks import cutoff, minutes
from tidemark.functions.hashing import is_sha256
from tidemark.functions.text import normalize_url
from tidemark.settings import DATA_MODES, PURPOSE_RIGHTS


def reasons(*rules: tuple[str, Column]) -> Column:
    """Codes of the rules that hold or can't be decided, in order and without repeats.

    A condition that is NULL counts as holding, so that missing values block; rules on optional fields say so
    with ``optional``.
    """
    return F.array_distinct(listed(*[(F.coalesce(cond, F.lit(True)), F.lit(code)) for code, cond in rules]))


def listed(*entries: tuple[Column, Column], kind: str = "string") -> Column:
    """Array of the values whose condition holds, in order.

    Small arrays put together: a filter by a function would leave compiled code, with all that it is made of.
    """
    none = F.array().cast(f"array<{kind}>")
    return F.concat(*[F.when(cond, F.array(value)).otherwise(none) for cond, value in entries])


def optional(cond: Column) -> Column:
    """A rule on a field that may be missing: NULL doesn't block."""
    return F.coalesce(cond, F.lit(False))


def unclear(scope: Column) -> Column:
    return F.coalesce((scope == "") | F.upper(scope).contains("UNCLEAR"), F.lit(True))


def flags_blocked(flags: Column, blocked: Iterable[str]) -> Column:
    return F.coalesce(F.arrays_overlap(flags, F.array(*[F.lit(b) for b in blocked])), F.lit(False))


# ---------------------------------------------------------------- provider rights


def authorize(
    requests: DataFrame,
    registry: DataFrame,
    purposes: set[str],
    at: datetime,
    provider: str = "provider",
    market: str | None = None,
    region: str | None = None,
    name: str = "license_reasons",
) -> DataFrame:
    """Add why a provider may not be used for the purposes; the first failing check comes first.

    The registry is joined, not collected; being one row per provider it normally broadcasts, and
    the adaptive planner falls back to a shuffle when it does not fit.
    """
    rights = registry.select(
        F.col("provider_code").alias(provider), F.struct(*registry.columns).alias("_r")
    )
    col = lambda name: None if name is None else F.col(name)
    found = license_reasons(F.col("_r"), cutoff(at, "utc"), purposes, col(market), col(region))
    return requests.join(rights, provider, "left").withColumn(name, found).drop("_r")


def license_reasons(
    r: Column, at: Column, purposes: set[str], market: Column | None = None,
    region: Column | None = None, prefix: str = "",
) -> Column:
    """Codes for a struct of rights (NULL: not registered) at a time."""
    known = sorted(purposes & PURPOSE_RIGHTS.keys())
    unknown = sorted(purposes - PURPOSE_RIGHTS.keys())
    rules = [
        ("NOT_REGISTERED", r.isNull()),
        ("NOT_APPROVED", r.isNotNull() & (r["review_status"] != "APPROVED")),
        ("EXPIRED", r["expires_at"].isNotNull() & (r["expires_at"] <= at)),
        ("PURPOSE_UNKNOWN", F.lit(bool(unknown))),
        *[
            (f"PURPOSE_DENIED:{p}", r.isNotNull() & ~F.coalesce(r[PURPOSE_RIGHTS[p]], F.lit(False)))
            for p in known
        ],
    ]
    for place, code, places in ((market, "MARKET", "markets"), (region, "REGION", "regions")):
        if place is not None:
            inside = F.coalesce(F.array_contains(r[places], place), F.lit(False))
            rules.append((f"{code}_DENIED", r.isNotNull() & place.isNotNull() & ~inside))
    return reasons(*[(prefix + code, cond) for code, cond in rules])


def licensed_rows(
    rows: DataFrame, registry: DataFrame, purposes: set[str], at: datetime,
    scope=("provider", "mic", "region"),
) -> DataFrame:
    """Keep rows whose (provider, market, region) is licensed; each scope is checked once."""
    provider, market, region = scope
    scopes = rows.select(*scope).distinct()
    allowed = authorize(scopes, registry, purposes, at, provider, market, region).filter(
        F.size("license_reasons") == 0
    )
    return rows.join(allowed.select(*scope), list(scope), "left_semi")


# ---------------------------------------------------------------- instruments and signals

BLOCKING_BAR_FLAGS = (
    "CORPORATE_ACTION_ADJUSTMENT_NOT_VERIFIED", "LICENSE_UNCLEAR", "SCHEMA_UNVERIFIED",
    "TIME_VALIDATION_FAILED",
)


def bar_summary(bars: DataFrame) -> DataFrame:
    """What the risk rules need to know about the bars of an instrument, in one aggregation.

    Sets of providers, scopes and modes are kept as (min, max, nulls) so that the aggregate stays
    of fixed size per instrument.
    """
    flags = F.col("quality_flags") if "quality_flags" in bars.columns else F.lit(None)
    blocked = flags_blocked(flags, BLOCKING_BAR_FLAGS) if "quality_flags" in bars.columns else (
        F.lit(False)
    )

    def ends(c: str) -> list[Column]:
        if c not in bars.columns:
            return [F.lit(None).cast("string").alias(f"{c}_min"),
                    F.lit(None).cast("string").alias(f"{c}_max"), F.lit(0).alias(f"{c}_nulls")]
        return [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"),
                F.count_if(F.col(c).isNull()).alias(f"{c}_nulls")]

    return bars.groupBy("instrument_id").agg(
        F.count("*").alias("bar_count"),
        *ends("provider"),
        *ends("license_scope"),
        *ends("data_mode"),
        F.bool_or(~F.coalesce(F.col("data_mode").isin(*DATA_MODES), F.lit(False))).alias("mode_unknown"),
        F.max("available_at").alias("last_available"),
        F.max("event_time").alias("last_event"),
        F.max("as_of").alias("last_as_of"),
        F.bool_or(F.col("event_time").isNull() | F.col("as_of").isNull()).alias("time_invalid"),
        F.max_by("close", "event_time").alias("last_close"),
        F.max_by("bid_ask_spread_bps", "event_time").alias("last_spread"),
        F.bool_or(blocked).alias("flag_blocked"),
    )


def stale(at: Column, limit_minutes: int) -> Column:
    """Too old: by last availability, or by the older of last event and last as-of time."""
    age = minutes(limit_minutes)
    return (at - F.col("last_available") > age) | (
        at - F.least("last_event", "last_as_of") > age
    )


def signal_risk(
    instruments: DataFrame,
    summary: DataFrame,
    registry: DataFrame,
    at: datetime,
    limits,
    snapshot: dict[str, Column],
    licence_at: datetime | None = None,
) -> DataFrame:
    """Risk codes per instrument in their fixed order, plus ``stale``.

    ``snapshot`` gives the registered provider, license_scope, data_mode and quality_flags.
    """
    c, now = F.col, cutoff(at)
    joined = instruments.join(summary, "instrument_id", "left").withColumn(
        "_snapshot_provider", snapshot["provider"]
    )
    joined = authorize(
        joined, registry, {"display", "algorithm", "derivative", "cache"}, licence_at or at,
        provider="_snapshot_provider", market="mic", region="region",
    )
    has = c("bar_count").isNotNull()

    def mismatch(name: str) -> Column:
        same = (
            (c(f"{name}_min") == snapshot[name]) & (c(f"{name}_max") == snapshot[name])
            & (c(f"{name}_nulls") == 0)
        )
        return has & ~F.coalesce(same, F.lit(False))

    invalid = F.coalesce(c("time_invalid"), F.lit(False))
    old = F.when(has, invalid | F.coalesce(stale(now, limits.data_stale_after_minutes), F.lit(True))
                 ).otherwise(F.lit(True))
    flags = snapshot.get("quality_flags")
    blocked_flags = F.coalesce(c("flag_blocked"), F.lit(False))
    if flags is not None:
        blocked_flags = blocked_flags | flags_blocked(flags, BLOCKING_BAR_FLAGS)
    rules = reasons(
        ("LEVERAGED_ETF_FORBIDDEN", c("leveraged")),
        ("INVERSE_ETF_FORBIDDEN", c("inverse")),
        ("INSTRUMENT_INACTIVE", ~c("active")),
        ("LOW_LIQUIDITY_FORBIDDEN", c("liquidity_tier") > 2),
        ("GLOBAL_KILL_SWITCH", F.lit(limits.global_kill_switch)),
        ("NO_AVAILABLE_BARS", ~has),
        ("PROVIDER_LICENSE_BLOCKED", has & (F.size("license_reasons") > 0)),
        ("DATA_PROVIDER_MISSING", has & c("provider_min").isNull()),
        ("DATA_PROVIDER_MISMATCH", c("provider_min").isNotNull() & mismatch("provider")),
        ("LICENSE_SCOPE_MISSING", has & c("license_scope_min").isNull()),
        ("LICENSE_SCOPE_MISMATCH", c("license_scope_min").isNotNull() & mismatch("license_scope")),
        ("DATA_MODE_MISMATCH", mismatch("data_mode")),
        ("INVALID_DATA_MODE", has & F.coalesce(c("mode_unknown"), F.lit(False))),
        ("INVALID_FACT_TIME", has & invalid),
        # Missing times are INVALID_FACT_TIME already.
        ("FUTURE_FACT_TIME", has & optional((c("last_event") > now) | (c("last_as_of") > now))),
        ("DATA_STALE", has & old),
        ("INVALID_PRICE", has & ~F.coalesce(c("last_close") > 0, F.lit(False))),
        ("SPREAD_TOO_WIDE_OR_UNKNOWN", has & ~F.coalesce(c("last_spread") <= 25, F.lit(False))),
        ("INSUFFICIENT_RECENT_BARS", has & (c("bar_count") < 10)),
        ("REAL_DATA_CANDIDATE_GOVERNANCE_BLOCKED", has & (snapshot["data_mode"] != "DEMO_FIXTURE")),
        ("DATA_QUALITY_GATE_BLOCKED", has & blocked_flags),
    )
    return joined.withColumns({"rules": rules, "stale": old}).drop(
        "_snapshot_provider", "license_reasons"
    )


def model_rules(data_mode: Column, model: Column | None = None) -> Column:
    """Codes for a row of the model table (name, version, feature_version, status, scope ...).

    The row's columns, or those of the struct ``model``.
    """
    c = F.col if model is None else (lambda name: model[name])
    demo = data_mode.eqNullSafe("DEMO_FIXTURE")
    unexpected = ~(c("model_name").eqNullSafe("RuleBasedV1") & c("version").eqNullSafe("1.0.0"))
    detail = listed(
        (~c("feature_version").eqNullSafe("rule-features-v1"), F.lit("MODEL_FEATURE_VERSION_UNEXPECTED")),
        (~c("status").eqNullSafe("EXPERIMENTAL"),
         F.concat(F.lit("MODEL_STATUS_"), F.coalesce(c("status"), F.lit("MISSING")))),
        (demo & ~c("governance_scope").eqNullSafe("DEMO_FIXTURE_ONLY"), F.lit("MODEL_GOVERNANCE_SCOPE_INVALID")),
        (demo & ~c("real_data_candidate_gate").eqNullSafe("BLOCKED"), F.lit("MODEL_REAL_DATA_GATE_INVALID")),
        (demo & ~c("drift_status").eqNullSafe("NOT_APPLICABLE_TO_FIXED_FIXTURE"), F.lit("MODEL_DRIFT_GATE_FAILED")),
        (~demo, F.lit("REAL_DATA_MODEL_GATE_BLOCKED")),
    )
    return (
        F.when(c("model_name").isNull(), F.array(F.lit("MODEL_VERSION_MISSING")))
        .when(unexpected, F.array(F.lit("MODEL_VERSION_UNEXPECTED")))
        .otherwise(F.array_distinct(detail))
    )


def tradable_instrument(instrument: Column | None = None) -> Column:
    """Whether a row of the instrument master (or the struct ``instrument``) may be executed."""
    c = F.col if instrument is None else (lambda name: instrument[name])
    return c("active") & ~c("leveraged") & ~c("inverse") & (c("liquidity_tier") <= 2)


def executable_signal(mode: str = "DEMO_FIXTURE") -> Column:
    c = F.col
    return (
        (c("state") == "ENTRY_CANDIDATE") & c("is_current") & (c("latency_status") == "ON_TIME")
        & (c("data_mode") == mode) & (F.size("rules") == 0)
    )


# ---------------------------------------------------------------- news and calendar events

BLOCKING_NEWS_FLAGS = (
    "LICENSE_UNCLEAR", "TIME_VALIDATION_FAILED", "PROMPT_INJECTION_SUSPECTED",
    "ENTITY_MAPPING_REQUIRED", "ENTITY_MATCH_INSUFFICIENT", "MISSING_SOURCE_URL",
)
BLOCKING_EVENT_FLAGS = (
    "HASH_MISMATCH", "LICENSE_UNCLEAR", "MIGRATED_LINEAGE_REVIEW_REQUIRED", "SCHEMA_UNVERIFIED",
    "TIME_VALIDATION_FAILED",
)


def eligible_news(
    news: DataFrame, registry: DataFrame, at: datetime, data_mode: str,
    purposes: set[str] = frozenset({"algorithm", "derivative", "cache"}),
    require_exposure: bool = True, licence_at: datetime | None = None,
) -> DataFrame:
    """News that was knowable, is intact, mapped, unflagged and licensed at ``at``."""
    c, now = F.col, cutoff(at, "utc")
    published = c("published_at")
    dedupe = news_dedupe_hash(c("normalized_url"), c("title"), c("cluster_key"))
    kept = news.filter(
        (c("available_at") <= now) & (c("first_seen_at") <= now) & (c("data_mode") == data_mode)
        & (c("event_time") <= now) & (c("event_time") <= c("first_seen_at"))
        & (c("event_time") <= c("available_at")) & (c("first_seen_at") <= c("available_at"))
        & (c("as_of") <= now)
        & (published.isNull() | ((published <= c("available_at")) & (published <= now)))
        & (c("source_uri") != "") & ~unclear(c("license_scope"))
        & c("normalized_url").eqNullSafe(normalize_url(c("source_uri")))
        & c("normalized_url").isNotNull()
        & (c("dedupe_hash") == dedupe)
        & is_sha256(c("raw_payload_hash"))
        & ~flags_blocked(c("quality_flags"), BLOCKING_NEWS_FLAGS)
    )
    if require_exposure:
        kept = kept.filter((F.size("entities") > 0) & (F.size("exposures") > 0))
    providers = kept.select("provider").distinct()
    allowed = authorize(providers, registry, set(purposes), licence_at or at).filter(
        F.size("license_reasons") == 0
    )
    return kept.join(allowed.select("provider"), "provider", "left_semi")


def news_dedupe_hash(url: Column, title: Column, cluster: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", url, F.lower(title), cluster), 256)


def event_gate(
    events: DataFrame, registry: DataFrame, at: datetime, licence_at: datetime | None = None,
    intact: Column | None = None,
) -> DataFrame:
    """Reasons why a calendar event may not raise an alert; regions are checked one by one."""
    c, now = F.col, cutoff(at, "utc")
    purposes = {"display", "algorithm", "cache"}
    scopes = events.select("provider_code", "regions").distinct()
    pairs = scopes.withColumn("_region", F.explode_outer("regions"))
    denied = F.size("license_reasons") > 0
    # Without regions the row still checks the provider itself.
    verdict = (
        authorize(pairs, registry, purposes, licence_at or at, "provider_code", region="_region")
        .groupBy("provider_code", F.coalesce("regions", F.array().cast("array<string>")).alias("_rs"))
        .agg(F.bool_or(denied).alias("_denied"))
    )
    joined = events.withColumn(
        "_rs", F.coalesce("regions", F.array().cast("array<string>"))
    ).join(verdict, ["provider_code", "_rs"], "left")
    licence = F.coalesce(c("_denied"), F.lit(True))
    ok = intact if intact is not None else F.lit(True)
    rules = reasons(
        ("EVENT_RECORD_INTEGRITY_FAILED", ~F.coalesce(ok, F.lit(False))),
        ("EVENT_NOT_SCHEDULED", c("status") != "SCHEDULED"),
        ("EVENT_REVISION_NOT_CURRENT", ~c("is_current")),
        ("NOT_YET_PUBLICLY_ANNOUNCED", c("first_announced_at") > now),
        ("PUBLISHED_IN_FUTURE", optional(c("published_at") > now)),
        ("NOT_YET_FIRST_SEEN", c("first_seen_at") > now),
        ("NOT_YET_AVAILABLE", c("available_at") > now),
        ("AS_OF_IN_FUTURE", c("as_of") > now),
        ("INGESTED_IN_FUTURE", c("ingested_at") > now),
        ("ANNOUNCEMENT_AFTER_EVENT", c("first_announced_at") > c("scheduled_at")),
        ("FIRST_SEEN_BEFORE_ANNOUNCEMENT", c("first_announced_at") > c("first_seen_at")),
        ("FIRST_SEEN_BEFORE_PUBLISHED", optional(c("published_at") > c("first_seen_at"))),
        ("AVAILABLE_BEFORE_FIRST_SEEN", c("first_seen_at") > c("available_at")),
        ("AVAILABLE_BEFORE_AS_OF", c("as_of") > c("available_at")),
        ("INGESTED_BEFORE_AVAILABLE", c("available_at") > c("ingested_at")),
        ("EVENT_TIME_MISMATCH", c("event_time") != c("scheduled_at")),
        ("EVENT_ALREADY_PASSED", c("scheduled_at") < now),
        ("INVALID_DATA_MODE", ~c("data_mode").isin(*DATA_MODES)),
        ("LICENSE_SCOPE_UNCLEAR", unclear(c("license_scope"))),
        ("EVENT_QUALITY_BLOCKED", flags_blocked(c("quality_flags"), BLOCKING_EVENT_FLAGS)),
        ("RAW_PAYLOAD_HASH_INVALID", ~is_sha256(c("raw_payload_hash"))),
        ("SOURCE_URL_INVALID", normalize_url(c("source_uri")).isNull()),
        ("PROVIDER_LICENSE_BLOCKED", licence),
    )
    return joined.withColumn("gate_reasons", rules).drop("_rs", "_denied")


def lookup_by_hash(
    df: DataFrame, digest: str, registry: DataFrame, columns: Iterable[str], name: str
) -> DataFrame:
    """Columns of the registry row whose ``sha256`` is the row's ``digest``, and why there is none.

    A digest registered more than once counts once, with its smallest row.
    """
    found = registry.groupBy(F.col("sha256").alias("_sha")).agg(F.min(F.struct(*columns)).alias("_row"))
    joined = df.join(found, F.col(digest) == F.col("_sha"), "left")
    why = F.when(~is_sha256(F.col(digest)), "HASH_INVALID").when(F.col("_sha").isNull(), "NOT_FOUND")
    return joined.withColumns(
        {**{c: F.col("_row")[c] for c in columns}, name: why}
    ).drop("_sha", "_row")


# ---------------------------------------------------------------- output gates


def first_failure(checks: list[DataFrame]) -> DataFrame:
    """The failing check with the lowest priority number, or no row when all pass.

    Every check is a (priority, reason) frame holding a row per failure.
    """
    union = checks[0]
    for check in checks[1:]:
        union = union.unionByName(check)
    return union.groupBy().agg(
        F.min_by("reason", F.struct("priority", "reason")).alias("reason"),
        F.count("*").alias("failures"),
    )


def failing(df: DataFrame, priority: int, reason: Column | str, when: Column) -> DataFrame:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return df.filter(when).select(F.lit(priority).alias("priority"), reason.alias("reason"))


def safe_rule_codes(rules: Column) -> Column:
    """Rule codes without their suffixes, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.transform(rules, lambda x: F.split(x, ":")[0])))


def minimal_signal(df: DataFrame, now: datetime) -> DataFrame:
    """Bounded outward projection of current signals plus why a row is refused (or NULL)."""
    c = F.col
    codes = safe_rule_codes(c("rules"))
    wellformed = F.forall(
        c("rules"),
        lambda x: (F.length(x) <= 256) & F.split(x, ":")[0].rlike("^[A-Z][A-Z0-9_]{0,127}$"),
    )
    health = (
        ~c("is_current") | (c("latency_status") != "ON_TIME") | (c("state") == "DATA_STALE")
        | ~(c("data_as_of") <= c("available_at")) | ~(c("available_at") <= cutoff(now, "utc"))
        | (F.size("rules") > 100) | ~wellformed
        | ((F.size("rules") > 0) & c("state").contains("CANDIDATE"))
    )
    refused = F.when(c("data_mode") != "DEMO_FIXTURE", "NON_DEMO_MODE_BLOCKED").when(
        F.coalesce(health, F.lit(True)), "DATA_HEALTH_BLOCKED"
    )
    return df.withColumns({"refused": refused, "rule_codes": codes})


def masked(blocked: Column, safe: dict[str, Column], df: DataFrame) -> DataFrame:
    """Replace sensitive fields by safe values on blocked rows only."""
    return df.withColumns(
        {c: F.when(blocked, v).otherwise(F.col(c)) for c, v in safe.items()}
    )


def alert_view(alerts: DataFrame, reason: str = "display_blocked_reason") -> DataFrame:
    """Alerts for display: a blocked one keeps what it is, and loses what was derived for it.

    Its trigger says whether a signal or the alert itself is the cause.
    """
    c = F.col
    derived = (c("source_object_type") == "Signal") & (c(reason) != "ALERT_CONTENT_INTEGRITY_FAILED")
    trigger = F.when(derived, "SIGNAL_DERIVED_DISPLAY_BLOCKED").otherwise("ALERT_DERIVED_DISPLAY_BLOCKED")
    return masked(c(reason).isNotNull(), {
        "title": F.lit("withheld"), "message": F.lit("withheld"), "latency_status": F.lit("UNAVAILABLE"),
        "trigger_reason": trigger, "confidence": F.lit(None).cast("double"),
        "source_links": F.array().cast("array<string>"), "invalidation_conditions": F.array(F.lit("REVIEW_REQUIRED")),
    }, alerts)


def display_view(df: DataFrame, reason: Column, maps: Iterable[str], blocked_status: Column):
    """Result rows for display: blocked ones lose their metric maps and show why."""
    empty = F.create_map().cast("map<string,double>")
    blocked = reason.isNotNull()
    out = {m: F.when(blocked, empty).otherwise(F.col(m)) for m in maps}
    return df.withColumns(
        {
            "display_blocked_reason": reason,
            **out,
            "status": F.when(blocked, blocked_status).otherwise(F.col("status")),
        }
    )
