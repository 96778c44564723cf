"""Settings shared by the operators: tiers, weights, column roles, source profiles."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

# Series identity, time and target columns of the canonical tables.
STATION = "station_id"
DEPTH = "Depth_m"
TIME = "Date"
TARGET = "O2_umol_L"
TIME_INDEX = "Time_Idx"
WEIGHT = "sample_weight"
DEFICIT = "oxygen_deficit"
SERIES_KEYS = (STATION, DEPTH)

# Depths, limits, lengths and ratios of the reproduced analysis.
SURFACE_DEPTH_M = 1.0
TARGET_DEPTH_M = 25.0
INTERPOLATION_LIMIT_WEEKS = 8
ASOF_TOLERANCE_DAYS = 3
ENCODER_LENGTH = 8
DECODER_LENGTH = 4
TRAIN_RATIO = 0.8
QUANTILES = (0.1, 0.5, 0.9)
LOSS_DIFFERENCE_PCT = 5.0

# Measured columns of the ocean table and of the daily weather table.
OCEAN_VALUES = ("Temp_C", "Salinity", "NO3", "NO2", "PO4", "Silicate", "O2_umol_L", "Chl_a")
WEATHER_VALUES = ("Air_Temp_C", "Wind_Speed_ms", "Wind_Dir_deg", "Wind_U", "Wind_V")
VALUE_COLUMNS = OCEAN_VALUES + WEATHER_VALUES

# Weather parameter -> column.
WEATHER_PARAMETERS = {
    "wind_speed": "Wind_Speed_ms",
    "wind_direction": "Wind_Dir_deg",
    "temperature_air_mean_2m": "Air_Temp_C",
}

# Covariates known ahead of time, and columns that are never model inputs.
KNOWN_COVARIATES = ("month_sin", "month_cos")
NON_FEATURES = (TIME, DEPTH, TIME_INDEX, TARGET, WEIGHT, DEFICIT) + KNOWN_COVARIATES
# Features that hold the target's own value or change.
TARGET_DERIVED = ("Vertical_O2_Grad", "O2_Derivative_1W")


@dataclass(frozen=True)
class Tiers:
    """Severity thresholds (strictly below counts) and the sample weight of each tier; the defaults are fixed values."""

    watch: float = 80.0
    hypoxic: float = 60.0
    severe: float = 30.0
    normoxic_weight: float = 1.0
    watch_weight: float = 3.0
    hypoxic_weight: float = 6.0
    severe_weight: float = 12.0

    def thresholds(self) -> dict[str, float]:
        return {"watch": self.watch, "hypoxic": self.hypoxic, "severe": self.severe}

    def weights(self) -> dict[str, float]:
        return {
            "normoxic": self.normoxic_weight,
            "watch": self.watch_weight,
            "hypoxic": self.hypoxic_weight,
            "severe": self.severe_weight,
        }


TIERS = Tiers()


@dataclass(frozen=True)
class SourceProfile:
    """How one kind of delimited file maps onto the canonical table.

    ``columns`` maps header text to column name. ``factors`` multiplies a column on the
    way in, for sources that report another unit.
    """

    name: str
    sep: str
    columns: Mapping[str, str]
    factors: Mapping[str, float] = field(default_factory=dict)
    header_prefix: str = "Date/Time"


# Header texts of the three file kinds, and the density in kg/L that turns
# micromoles per kilogram into micromoles per litre.
SEAWATER_DENSITY = 1.015

OCEAN_PER_KG = SourceProfile(
    name="ocean_per_kg",
    sep=";",
    columns={
        "Date/Time": "Date",
        "Depth water [m]": "Depth_m",
        "Temp [°C]": "Temp_C",
        "Sal": "Salinity",
        "O2 [µmol/kg]": "O2_umol_L",
        "[NO3]- [µmol/l]": "NO3",
        "[NO2]- [µmol/l]": "NO2",
        "[PO4]3- [µmol/l]": "PO4",
        "SiO2 [µmol/l]": "Silicate",
        "Chl a [µg/l]": "Chl_a",
    },
    factors={"O2_umol_L": SEAWATER_DENSITY},
)

OCEAN_PER_LITRE = SourceProfile(
    name="ocean_per_litre",
    sep=";",
    columns={
        "Date/Time": "Date",
        "Depth water [m]": "Depth_m",
        "Temp [°C]": "Temp_C",
        "Sal": "Salinity",
        "O2 [µmol/l]": "O2_umol_L",
        "[NO3]- [µmol/l]": "NO3",
        "[NO2]- [µmol/l]": "NO2",
        "[PO4]3- [µmol/l]": "PO4",
        "Si(OH)4 [µmol/l]": "Silicate",
    },
)

CHLOROPHYLL = SourceProfile(
    name="chlorophyll",
    sep="\t",
    columns={
        "Date/Time": "Date",
        "Depth water [m]": "Depth_m",
        "Chl a [µg/l]": "Chl_a_supplement",
    },
)
