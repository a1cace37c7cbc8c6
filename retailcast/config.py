"""Job parameters."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class BacktestConfig:
    train_window_months: int = 12
    test_window_days: int = 28
    step_days: int = 7
    min_train_samples: int = 365


@dataclass(frozen=True)
class JobConfig:
    raw_path: str = "data/raw"
    report_path: str = "data/reports"
    horizons: tuple[int, ...] = (7, 14, 28)
    lookback: int = 28
    iqr_multiplier: float = 1.5
    contamination: float = 0.01
    min_series_rows: int = 100
    backtest: BacktestConfig = field(default_factory=BacktestConfig)
