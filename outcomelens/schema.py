"""Schemas, vocabularies and thresholds shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

# Event vocabulary.
TRADE_OUTCOME, RECOMMENDATION, REJECTION, REGIME_CHANGE, SYSTEM_EVENT = "TRADE_OUTCOME", "RECOMMENDATION", "REJECTION", "REGIME_CHANGE", "SYSTEM_EVENT"
WIN, LOSS, BREAKEVEN, PENDING = "WIN", "LOSS", "BREAKEVEN", "PENDING"
OUTCOMES = (WIN, LOSS, BREAKEVEN, "PARTIAL", "EXPIRED", PENDING)
REGIMES = ("BULL", "BEAR", "NORMAL", "HIGH_VOL", "LOW_VOL", "UNKNOWN")
EVENT_TYPES = (TRADE_OUTCOME, RECOMMENDATION, REJECTION, REGIME_CHANGE, "ALLOCATION_CHANGE", SYSTEM_EVENT)
SETUPS = ("RSI_CROSS_UP", "TREND_PULLBACK", "TREND_CONTINUATION", "OVERSOLD_REBOUND", "BREAKOUT")
#: Regimes of exports, and what they are called here.
EXPORT_REGIMES = {"BULL": "BULL", "BEAR": "BEAR", "SIDEWAYS": "NORMAL", "HIGH_VOLATILITY": "HIGH_VOL", "RISK_ON": "BULL", "RISK_OFF": "BEAR", "UNKNOWN": "UNKNOWN"}
AUDIT_REGIMES = {
    "BULL": "BULL", "BEAR": "BEAR", "NORMAL": "NORMAL", "SIDEWAYS": "NORMAL", "HIGH_VOL": "HIGH_VOL", "LOW_VOL": "LOW_VOL",
    "STRESSED": "HIGH_VOL", "ELEVATED": "HIGH_VOL",
}
#: Regimes that evidence may name.
FLOOR_REGIMES = ("BULL", "BEAR", "NORMAL", "HIGH_VOL", "LOW_VOL", "SIDEWAYS", "HIGH_VOLATILITY")


@dataclass(frozen=True)
class Thresholds:
    """Documented thresholds of the analytics passes."""

    loss_streak: int = 3
    erosion: float = 0.10
    regime_multiplier: float = 2.0
    calibration_events: int = 5
    sample: int = 30
    small_overlap: int = 60
    trend_lookback: int = 5
    win_rate_shift: float = 0.05
    volume_shift: float = 0.30


THRESHOLDS = Thresholds()
