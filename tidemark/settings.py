"""Risk, delivery and backtest parameters with their default values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    data_stale_after_minutes: int = 2880
    global_kill_switch: bool = False
    monitoring_interval_hours: int = 1
    single_cap: float = 0.10
    asset_class_cap: float = 0.45
    industry_cap: float = 0.30
    region_cap: float = 0.60
    volatility_target: float = 0.12
    cash_floor: float = 0.20
    max_turnover: float = 0.25
    max_loss: float = 0.10
    max_drawdown: float = 0.15
    news_threshold: float = 0.70
    news_weight_cap: float = 0.15
    cooldown_minutes: int = 240
    daily_limit: int = 50
    quiet_start: int = 22
    quiet_end: int = 7
    alert_zone: str = "Asia/Shanghai"
    decision_delay_minutes: int = 30
    fee_bps: float = 2.5
    slippage_bps: float = 3.0


DEFAULTS = Limits()

# Enumerations of the data model.
DATA_MODES = ("LIVE_LICENSED", "DELAYED", "HISTORICAL", "DEMO_FIXTURE")
SIGNAL_STATES = (
    "NO_ACTION", "WATCH", "ENTRY_CANDIDATE", "HOLD", "REDUCE_CANDIDATE", "EXIT_CANDIDATE",
    "BLOCKED_BY_RISK", "DATA_STALE",
)
LICENSE_STATUSES = ("PENDING", "APPROVED", "BLOCKED", "EXPIRED")
MODEL_STATUSES = ("CHAMPION", "CHALLENGER", "EXPERIMENTAL", "REJECTED", "ROLLED_BACK")
CANDIDATE_STATES = ("ENTRY_CANDIDATE", "REDUCE_CANDIDATE", "EXIT_CANDIDATE")
# Purpose of use -> column of the rights registry.
PURPOSE_RIGHTS = {
    "display": "display_right",
    "algorithm": "non_display_algorithm_right",
    "derivative": "derivative_right",
    "cache": "cache_right",
    "training": "training_right",
    "redistribution": "redistribution_right",
}
