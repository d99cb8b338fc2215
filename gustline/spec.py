"""Feature specification and model contract: what the schema of a feature table means."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

POLLUTANTS = ["pm25", "pm10", "co", "no2", "so2", "o3", "aod", "dust"]
NON_NEGATIVE = ["pm25", "pm10", "co", "no2", "so2", "o3"]
WEATHER = ["temperature", "humidity", "precipitation", "pressure", "wind_speed",
           "wind_direction", "cloud_cover", "visibility", "weather_code"]
CALENDAR = ["hour", "day_of_week", "month", "day", "hour_sin", "hour_cos"]
TARGET = "pm25"

MODES = ("strict", "inclusive", "expanding_past")


@dataclass(frozen=True)
class FeatureSpec:
    """Lags and rolling windows of one target column.

    ``mode`` picks the rolling definition:

    * ``strict``: rows before the current one, null until the window is full;
    * ``inclusive``: the current row counts too and short windows are allowed;
    * ``expanding_past``: rows before the current one, short windows allowed, and a lag
      that reaches past the start of the series falls back to the last value.
    """

    target: str = TARGET
    lags: tuple[int, ...] = (1, 3, 6, 12, 24)
    means: tuple[int, ...] = (6, 12, 24)
    stds: tuple[int, ...] = ()
    mode: str = "strict"

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")

    @property
    def lookback(self) -> int:
        return max((*self.lags, *self.means, *self.stds, 1))

    @property
    def prefixes(self) -> tuple[str, str, str]:
        return (f"{self.target}_lag_", f"{self.target}_roll_mean_", f"{self.target}_roll_std_")

    @property
    def columns(self) -> list[str]:
        lag, mean, std = self.prefixes
        return ([f"{lag}{n}" for n in self.lags] + [f"{mean}{n}" for n in self.means]
                + [f"{std}{n}" for n in self.stds])

    @classmethod
    def from_columns(cls, columns: list[str], target: str = TARGET, mode: str = "inclusive"
                     ) -> "FeatureSpec":
        """Read the specification back from the names of an existing feature table."""
        empty = cls(target, (), (), (), mode)
        sizes = [tuple(sorted(int(c.rsplit("_", 1)[-1]) for c in columns if c.startswith(p)))
                 for p in empty.prefixes]
        return replace(empty, lags=sizes[0], means=sizes[1], stds=sizes[2])


FORECAST_SPEC = FeatureSpec(means=(3, 6, 12, 24), stds=(3, 6, 12, 24), mode="expanding_past")


def split_columns(columns: list[str], target: str = TARGET) -> tuple[list[str], list[str]]:
    """(base columns, derived columns) of a feature table, by prefix and calendar name."""
    prefixes = FeatureSpec(target).prefixes
    derived = [c for c in columns if c.startswith(prefixes) or c in CALENDAR]
    return [c for c in columns if c not in derived], derived


@dataclass(frozen=True)
class Contract:
    """What a promoted model needs at scoring time."""

    model_name: str
    features: list[str]
    target: str = TARGET
    requires_scaling: bool = False
    selected_by: str = ""
    test_metrics: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class LinearModel:
    """Coefficients of a linear model on standardised inputs (population std)."""

    contract: Contract
    coefs: list[float]
    intercept: float
    means: list[float] | None = None
    stds: list[float] | None = None
