"""Parameters that belong to a station and an evaluation, in one object."""

from __future__ import annotations

from dataclasses import dataclass

#: Weight of each sky cover code (fixed values); other codes have none.
SKY_WEIGHTS = {"OVC": 1.0, "BKN": 0.75, "SCT": 0.4, "FEW": 0.2, "CLR": 0.0}
#: Hectopascal in an inch of mercury (fixed value).
HPA_PER_INHG = 33.8639


@dataclass(frozen=True)
class Config:
    tz: str = "Pacific/Auckland"
    cps: tuple[str, ...] = ("20:00", "21:00", "22:00", "23:00")
    tmp_range: tuple[int, int] = (-10, 40)
    dwp_range: tuple[int, int] = (-50, 35)
    anchors: tuple[int, ...] = (6, 9, 12, 15, 18)
    min_obs: int = 40
    max_gap_minutes: int = 120
    min_quartiles: int = 1
    seed: int = 42
    whole_hours: bool = False
    ref_date: str = "2025-06-15"
    #: Columns that tell stations apart, kept through labels, slices and features; none for one station.
    station: tuple[str, ...] = ()
    blocked: tuple[tuple[str, str], ...] = (("sst_maritime_cap", "no source for sea surface temperature"),)

    @property
    def day(self) -> tuple[str, ...]:
        """The key of a day."""
        return (*self.station, "date_local")


#: Hypothesis ids and the feature columns that they test, H1 to H23 (fixed names).
HYPOTHESES = (
    "slope_3h", "hours_to_expected_peak", "regime_label", "dewpoint_depression", "tmax_dminus1", "tmin_delta_tmax",
    "intraday_regime_change", "wind_dir_change_s_to_n", "day_sequence_pattern", "precip_disruption",
    "tmax_hour_by_regime_month", "cloud_cover_suppression", "pressure_trend_3h", "foehn_score", "late_warming_anomaly",
    "regime_score_argmax", "warming_rate_06_09", "nocturnal_plateau_flag", "sst_maritime_cap",
    "dewpoint_collapse_rate_3h", "prefrontal_warming_window", "nw_sector_not_foehn", "cloud_base_transparency",
)
CATALOG = tuple((f"H{k}", column) for k, column in enumerate(HYPOTHESES, start=1))
