"""Thresholds of the price jobs in one frozen record; nothing reads the environment or the clock."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime


@dataclass(frozen=True)
class Settings:
    as_of: datetime = datetime(2024, 1, 31)
    min_score: float = 78.0
    auto_approve: float = 88.0
    volume_tolerance_ml: int = 5
    deal_threshold: float = 15.0
    history_drop_threshold: float = 5.0
    slack: float = 1e-9
    distinct_price: float = 0.01
    history_days: int = 90
    average_days: int = 30
    report_groups: int = 30
    search_limit: int = 20
    feed_limit: int = 60
    #: Whether an all-zero GTIN, which passes the check digit, is refused.
    reject_zero_gtin: bool = False

    def __post_init__(self):
        if self.min_score <= 0:
            raise ValueError("a threshold of 0 or less would link every pair of offers")


DEFAULT = Settings()
