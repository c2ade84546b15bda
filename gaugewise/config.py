"""All tunable parameters in one immutable object."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

US_PER_SECOND = 1_000_000
US_PER_MINUTE = 60 * US_PER_SECOND
US_PER_HOUR = 60 * US_PER_MINUTE
US_PER_DAY = 24 * US_PER_HOUR

VARIABLES = ("temperature", "pressure", "humidity")

# Contract enums.
DECISIONS = ("genuine_weather", "sensor_fault", "uncertain")
FAULT_TYPES = (
    "temperature_spike", "temperature_drift", "frozen_sensor", "dropout",
    "abrupt_jump", "bias", "noise", "multivariate_inconsistency",
)
CORRECTION_STATUSES = ("SUGGESTED", "PENDING_REVIEW", "ACCEPTED", "REJECTED")


def _per_variable(temperature: float, pressure: float, humidity: float) -> dict[str, float]:
    return {"temperature": temperature, "pressure": pressure, "humidity": humidity}


@dataclass(frozen=True)
class Config:
    # history windows
    hist_window_us: int = 7 * US_PER_DAY
    corr_window_us: int = 3 * US_PER_DAY
    persist_window_us: int = 24 * US_PER_HOUR
    min_hist: int = 8
    min_recent: int = 3
    # signals
    z_cap: float = 6.0
    q_lo: float = 0.05
    q_hi: float = 0.95
    flag_stat: float = 0.5
    flag_if: float = 0.65
    flag_ae: float = 0.9
    # spatial neighbourhood
    radius_km: float = 30.0
    time_tol_us: int = 3 * US_PER_HOUR
    min_neighbours: int = 2
    idw_power: float = 2.0
    min_km: float = 0.1
    # temporal plausibility, rates per minute
    rate_soft: dict[str, float] = field(default_factory=lambda: _per_variable(1.0, 1.0, 5.0))
    rate_hard: dict[str, float] = field(default_factory=lambda: _per_variable(10.0, 5.0, 30.0))
    rarity_weight: float = 0.3
    max_rate_gap_us: int = 60 * US_PER_MINUTE
    station_scale: dict[str, float] = field(default_factory=lambda: _per_variable(8.0, 5.0, 25.0))
    # cross-sensor plausibility
    dt_min: float = 5.0
    rh_per_degree: float = 2.0
    max_dew_point: float = 35.0
    dp_min: float = 3.0
    gust_per_hpa: float = 2.0
    # evidence weights and decision thresholds
    weights: dict[str, float] = field(default_factory=lambda: {
        "temporal": 0.25, "cross_sensor": 0.25, "cross_station": 0.40, "persistence": 0.10})
    genuine_min: float = 0.65
    fault_max: float = 0.35
    min_coverage: float = 0.60
    max_conflict: float = 0.60
    # fault archetypes
    frozen_run: int = 5
    dropout_factor: float = 4.0
    noise_ratio: float = 3.0
    revert_tol: float = 0.5
    jump_rows: int = 5
    jump_z: float = 3.0
    drift_slope: dict[str, float] = field(default_factory=lambda: _per_variable(0.1, 0.1, 0.5))
    bias_min: float = 0.5
    bias_std_max: float = 0.25
    inconsistent_sensor: float = 0.3
    inconsistent_temporal: float = 0.7
    # sensor health and maintenance
    severity: dict[str, float] = field(default_factory=lambda: {
        "dropout": 1.0, "frozen_sensor": 0.9, "abrupt_jump": 0.8, "temperature_drift": 0.7,
        "bias": 0.6, "multivariate_inconsistency": 0.6, "temperature_spike": 0.4, "noise": 0.3})
    severity_none: float = 0.2
    health_drift: float = 40.0
    health_fault: float = 40.0
    health_noise: float = 10.0
    health_age: float = 10.0
    full_drift_factor: float = 4.0
    full_fault_share: float = 0.20
    full_age_days: float = 365.0
    noise_floor_q: float = 0.1
    # physical bounds
    bounds: dict[str, tuple[float, float]] = field(default_factory=lambda: {
        "temperature": (-90.0, 60.0), "pressure": (850.0, 1090.0), "humidity": (0.0, 100.0)})
    # Centring constants: rolling sums are kept on x - centre, which keeps variances accurate.
    centre: dict[str, float] = field(default_factory=lambda: _per_variable(15.0, 1005.0, 65.0))
    std_floor: float = 1e-5
    # physical layout: the span of one station's history that a single task sorts; ``plans.evaluate`` narrows
    # all of them when the busiest station would exceed ``max_rows_per_task``
    chunk_us: int = US_PER_DAY
    bucket_us: int = US_PER_DAY
    align_us: int = 3 * US_PER_HOUR
    quantile_us: int = 7 * US_PER_DAY
    tile_us: int = 7 * US_PER_DAY
    tile_radii: int = 4
    lifecycle_us: int = 365 * US_PER_DAY
    max_rows_per_task: int = 2_000_000
    #: How many readings an ordered step of the evaluation shuffles at once; more go through it in several passes.
    rows_per_pass: int = 8_000_000
    salts: int = 8

    def chunk_for(self, span_us: int, rows_per_hour: float) -> int:
        """The longest even part of ``span_us``, in whole seconds, that holds at most ``max_rows_per_task`` rows."""
        seconds = span_us // US_PER_SECOND
        most = self.max_rows_per_task * 3600 / max(rows_per_hour, 1e-9)
        parts = max(1, math.ceil(seconds / max(most, 1.0)))
        return seconds // next(p for p in range(parts, seconds + 1) if seconds % p == 0) * US_PER_SECOND

    def sized_for(self, busiest_hour_rows: int, busiest_share: float, partitions: int, asked_hour_rows: int = 0) -> Config:
        """A copy whose chunks and buckets hold at most ``max_rows_per_task`` rows of the busiest station-hour's rate,
        and whose salts spread a station with more than a fair share of all rows. ``asked_hour_rows``: the most that
        an hour has of the readings that meet in one tile of stations."""
        day = self.chunk_for(US_PER_DAY, busiest_hour_rows)
        week = self.chunk_for(self.hist_window_us, busiest_hour_rows)
        asked = max(asked_hour_rows, busiest_hour_rows)
        return replace(self, chunk_us=day, bucket_us=day, quantile_us=week, align_us=self.chunk_for(
            self.time_tol_us, asked), tile_us=self.chunk_for(self.hist_window_us, asked), salts=max(1, math.ceil(
                2 * busiest_share * partitions)))


DEFAULT = Config()
