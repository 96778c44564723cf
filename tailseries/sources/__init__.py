"""Readers and writers."""

from tailseries.sources.delimited import parse_lines, read_delimited, rejected_lines
from tailseries.sources.records import (
    best_configuration,
    read_leaderboard,
    read_manifest,
    run_manifest,
    write_leaderboard,
    write_manifest,
)
from tailseries.sources.tables import (
    read_weather_daily,
    read_weather_long,
    remove_older_weather,
    scratch_path,
    staged,
    staged_by,
    write_series_table,
    write_weather_daily,
    write_weather_long,
)

__all__ = [
    "best_configuration",
    "parse_lines",
    "read_delimited",
    "rejected_lines",
    "read_leaderboard",
    "read_manifest",
    "read_weather_daily",
    "read_weather_long",
    "remove_older_weather",
    "run_manifest",
    "scratch_path",
    "staged",
    "staged_by",
    "write_leaderboard",
    "write_manifest",
    "write_series_table",
    "write_weather_daily",
    "write_weather_long",
]
