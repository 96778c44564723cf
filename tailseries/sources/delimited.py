"""Delimited observation files whose header sits below a free-text preamble.

The files are read as lines, so one large file splits across tasks. Lines carry no order
there, hence preamble and header are told apart by content, not by line number: a record
is a line whose first field is a full date, with or without a time, and that has as many fields
as the header. ``rejected_lines`` gives the lines that look like records and are none.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tailseries import config as C
from tailseries.functions.measures import number


def _header_fields(lines: DataFrame, profile: C.SourceProfile) -> list[str]:
    """Field names from the header line; every file of one profile must agree on them."""
    found = (
        lines.where(F.col("value").startswith(profile.header_prefix + profile.sep))
        .select(F.rtrim("value").alias("value"))
        .distinct()
        .limit(2)
        .collect()
    )
    if not found:
        raise ValueError(f"{profile.name}: no header line starting with {profile.header_prefix!r}")
    if len(found) > 1:
        raise ValueError(f"{profile.name}: files disagree on their header; read them separately")
    fields = found[0]["value"].split(profile.sep)
    missing = [name for name in profile.columns if name not in fields]
    if missing:
        raise ValueError(f"{profile.name}: header lacks {missing}")
    return fields


#: A year or a time alone is no timestamp: preambles hold them.
FULL_DATE = r"^\d{4}-\d{2}-\d{2}([T ]|$)"


def _split(lines: DataFrame, profile: C.SourceProfile, fields: Sequence[str], keep: Sequence[str]):
    """Lines with their fields ``r`` by position, first field, and whether they are records.

    ``r._other`` holds the line where its number of fields is not the header's.
    """
    # Positional names: header texts hold brackets and may repeat.
    ddl = ", ".join([*(f"f{i} STRING" for i in range(len(fields))), "_other STRING"])
    options = {"sep": profile.sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_other"}
    split = lines.select(
        *keep,
        F.col("value"),
        F.regexp_extract("value", f"^[^{re.escape(profile.sep)}]*", 0).alias("_first"),
        F.from_csv(F.col("value"), ddl, options).alias("r"),
    )
    dated = F.col("_first").rlike(FULL_DATE)
    whole = F.col("r._other").isNull()
    return split.withColumns(
        {
            "_dated": dated & F.col("value").contains(profile.sep),
            "_whole": whole,
            "_record": dated & F.try_to_timestamp("_first").isNotNull() & whole,
        }
    )


def rejected_lines(
    lines: DataFrame,
    profile: C.SourceProfile,
    *,
    fields: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Lines that look like records and are none, with the reason: ``bad_time`` or ``field_count``.

    That is a line with the header's number of fields that has no readable time, or one that starts
    with a full date and has another number of fields. The rest is preamble.
    """
    fields = list(fields) if fields is not None else _header_fields(lines, profile)
    header = F.col("value").startswith(profile.header_prefix + profile.sep)
    return (
        _split(lines, profile, fields, keep)
        .where(~header & ~F.col("_record") & (F.col("_whole") | F.col("_dated")))
        .select(*keep, "value", F.when(F.col("_whole"), "bad_time").otherwise("field_count").alias("reason"))
    )


def parse_lines(
    lines: DataFrame,
    profile: C.SourceProfile,
    *,
    fields: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Turn text lines (column ``value``) into harmonised rows of ``profile``.

    ``fields`` gives the header when it is known; otherwise it is looked up in the lines.
    ``keep`` names further columns of ``lines`` to carry along, such as the station.
    """
    fields = list(fields) if fields is not None else _header_fields(lines, profile)
    position = {name: f"f{i}" for i, name in reversed(list(enumerate(fields)))}
    records = _split(lines, profile, fields, keep).where("_record")
    columns = []
    for source, name in profile.columns.items():
        field = F.col("r")[position[source]]
        if name == C.TIME:
            columns.append(F.try_to_timestamp(field).alias(name))
        else:
            value = number(field)
            if name in profile.factors:
                value = value * F.lit(profile.factors[name])
            columns.append(value.alias(name))
    return records.select(*keep, *columns)


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    profile: C.SourceProfile,
    *,
    station: str | None = None,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """Read files of one profile; ``station`` adds a constant station column."""
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths))
    keep = []
    if station is not None:
        lines = lines.withColumn(C.STATION, F.lit(station))
        keep.append(C.STATION)
    return parse_lines(lines, profile, fields=fields, keep=keep)
