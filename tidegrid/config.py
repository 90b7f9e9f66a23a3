"""Key names and default parameters shared by all jobs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DemandConfig:
    # Column names, feature parameters and limits of the data model.
    key: str = "PULocationID"
    time: str = "hour"
    target: str = "pickup_count"
    region: str = "Borough"
    name: str = "zone_name"
    service: str = "service_zone"
    taxi_type: str = "yellow"
    months: tuple[str, ...] = ("2024-07", "2024-08", "2024-09", "2024-10", "2024-11", "2024-12")
    # Bounds of valid keys, for callers that have no lookup to tell; None: no bound.
    min_zone: int | None = None
    max_zone: int | None = None
    lags: tuple[int, ...] = (1, 2, 3, 24, 48, 168)
    windows: tuple[int, ...] = (3, 6, 24, 168)
    stats: tuple[str, ...] = ("mean", "std", "min", "max")
    fourier_order: int = 3
    daily_period: float = 24.0
    weekly_period: float = 168.0
    smoothing: float = 10.0
    horizon: int = 24
    test_hours: int = 168
    cv_splits: int = 5

    # A dense series is cut into blocks of this many hours, so that the windows
    # of one long series run in several tasks (see operators.blocks).
    block_hours: int = 8760


DEFAULT = DemandConfig()
