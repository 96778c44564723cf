"""Registered queries: each a function of (spark, sf_dir), most with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from driver_queries import fits, roles as R
from driver_queries.oracle import OVER, SERIES, named, rounded, sql, surface
from driver_queries.roles import KEYS, OCEAN, SURFACE, TARGET, WEATHER, r6, table
from tailseries import config as C
from tailseries.functions.calendar import month_cos, month_sin
from tailseries.models import experiments as X
from tailseries.models.forecast import fit_forecaster, model_frame
from tailseries.models.moments import frame_moments
from tailseries.models.scenarios import response_table
from tailseries.models.store import ModelStore
from tailseries.operators import (
    asof,
    audit,
    episodes,
    evaluate,
    features,
    harmonize,
    labels,
    resample,
    split,
    weather,
    windows,
)
from tailseries.plans.prepare import join_weather, load_ocean
from tailseries.sources import delimited, records, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn

    return register


# --- Sources, harmonisation -----------------------------------------------------------------

_FIELDS = ["Date/Time", "Latitude", "Depth water [m]", "Temp [°C]", "Sal", "O2 [µmol/kg]"]
_PROFILE = C.SourceProfile(
    name="lineitem_text",
    sep=";",
    columns={
        "Date/Time": "Date",
        "Depth water [m]": "Depth_m",
        "Temp [°C]": "Temp_C",
        "Sal": "Salinity",
        "O2 [µmol/kg]": "O2_umol_L",
    },
    factors={"O2_umol_L": C.SEAWATER_DENSITY},
)


@query(
    sql("""SELECT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS "Date",
       CAST(l_linenumber AS DOUBLE) AS "Depth_m", round(sum(l_extendedprice), 2) AS "Temp_C",
       count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS n_salinity,
       round(sum(l_quantity * 10 * 1.015::DOUBLE), 6) AS "O2_umol_L"
FROM lineitem GROUP BY 1, 2, 3""")
)
def delimited_scan(spark, sf_dir):
    """Lines of text made from the table, with preamble and header among them, read back."""
    item = table(spark, sf_dir, "lineitem")
    record = F.concat_ws(
        ";",
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit("54.5295"),
        F.col("l_linenumber").cast("string"),
        F.col("l_extendedprice").cast("string"),
        F.when(F.col("l_returnflag") == "N", F.lit("n/a")).otherwise(F.col("l_tax").cast("string")),
        (F.col("l_quantity") * 10).cast("string"),
    )
    lines = item.select(F.col("l_suppkey").alias("station_id"), record.alias("value"))
    preamble = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("station_id"),
        F.explode(
            F.array(
                F.lit("/* DATA DESCRIPTION:"),
                F.concat(F.lit("Citation:\t"), F.col("s_name"), F.lit("; 2025-01-01")),
                F.lit(";".join(_FIELDS)),
            )
        ).alias("value"),
    )
    parsed = delimited.parse_lines(lines.unionByName(preamble), _PROFILE, keep=["station_id"])
    return parsed.groupBy("station_id", F.to_date("Date").alias("Date"), "Depth_m").agg(
        F.round(F.sum("Temp_C"), 2).alias("Temp_C"),
        F.count("Salinity").alias("n_salinity"),
        r6(F.sum("O2_umol_L"), "O2_umol_L"),
    )


@query(
    sql("""SELECT l_suppkey AS station_id, l_returnflag AS flag, count(*) AS n,
       count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS n_known,
       sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS total
FROM lineitem GROUP BY 1, 2""")
)
def coerce_text(spark, sf_dir):
    text = (
        F.when(F.col("l_returnflag") == "N", F.lit("<0.01"))
        .when(F.col("l_returnflag") == "R", F.lit("NaN"))
        .otherwise(F.col("l_quantity").cast("string"))
    )
    item = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("station_id"), F.col("l_returnflag").alias("flag"), text.alias("v")
    )
    return (
        harmonize.coerce_numbers(item, ["v"])
        .groupBy("station_id", "flag")
        .agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_known"), F.sum("v").alias("total"))
    )


@query(
    sql("""SELECT station_id, "Depth_m", CAST("Date" AS DATE) AS "Date", count(*) AS n,
       count("Chl_a") AS n_chl, round(sum("O2_umol_L"), 6) AS "O2_umol_L" FROM (
  SELECT station_id, "Depth_m", "Date", "O2_umol_L" * 1.015::DOUBLE AS "O2_umol_L", "Chl_a"
  FROM obs WHERE "Date" < TIMESTAMP '1998-01-01'
  UNION ALL BY NAME
  SELECT station_id, "Depth_m", "Date", "O2_umol_L" FROM obs
  WHERE "Date" >= TIMESTAMP '1998-01-01') GROUP BY 1, 2, 3""", "obs")
)
def union_units(spark, sf_dir):
    """An older source per kilogram with chlorophyll, a newer one per litre without."""
    seen = R.observations(spark, sf_dir)
    newer = F.col("Date") >= F.lit("1998-01-01").cast("timestamp")
    older = harmonize.convert_units(seen.where(~newer), {"O2_umol_L": C.SEAWATER_DENSITY})
    both = harmonize.union_sources(older, seen.where(newer).drop("Chl_a"))
    return both.groupBy(*KEYS, F.to_date("Date").alias("Date")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("Chl_a").alias("n_chl"),
        r6(F.sum("O2_umol_L"), "O2_umol_L"),
    )


def _lines(rows, profile, columns, preamble):
    """Records of a profile as text, with a preamble and the header among them."""
    order = ["Date/Time", "Vessel", *[f for f in reversed(profile.columns) if f != "Date/Time"]]
    known = {f: columns.get(c, F.lit("")) for f, c in profile.columns.items()}
    record = F.concat_ws(profile.sep, *[F.coalesce(known.get(f, F.lit("v1")).cast("string"), F.lit("")) for f in order])
    spark = rows.sparkSession
    head = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in [*preamble, profile.sep.join(order)]])).alias("value"))
    return rows.select(record.alias("value")).unionByName(head)


_MOMENT = "l_shipdate + to_seconds(l_orderkey % 86400)"


@query(f"""WITH ocean AS (
  SELECT {_MOMENT} AS at, l_linenumber AS d, l_quantity * 10 * CASE WHEN l_shipdate < DATE '1998-01-01' THEN 1.015::DOUBLE ELSE 1 END AS o2,
         CASE WHEN l_shipdate < DATE '1998-01-01' AND l_returnflag = 'A' THEN l_discount END AS chl,
         CASE WHEN l_shipdate >= DATE '1998-01-01' THEN l_tax END AS si
  FROM lineitem), supplement AS (
  SELECT {_MOMENT} AS at, l_linenumber AS d, l_tax AS s FROM lineitem WHERE l_returnflag <> 'A')
SELECT CAST(o.at AS TIMESTAMP) AS at, CAST(o.d AS DOUBLE) AS "Depth_m", count(*) AS n, round(sum(o2), 4) AS o2,
       count(coalesce(chl, s)) AS n_chl, round(sum(coalesce(chl, s)), 6) AS chl, round(sum(si), 6) AS si
FROM ocean o LEFT JOIN supplement x ON x.at = o.at AND x.d = o.d GROUP BY 1, 2""")
def ocean_files(spark, sf_dir):
    """Two ocean files and a tab-separated supplement, written as text and loaded onto one table."""
    item = table(spark, sf_dir, "lineitem")
    at = F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(secs=F.col("l_orderkey") % 86400)
    item = item.withColumn("at", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
    older = F.col("l_shipdate") < F.lit("1998-01-01")
    shared = {"Date": F.col("at"), "Depth_m": F.col("l_linenumber"), "O2_umol_L": F.col("l_quantity") * 10}
    own = F.when(F.col("l_returnflag") == "A", F.col("l_discount"))
    kinds = {
        "per_kg": (C.OCEAN_PER_KG, item.where(older), {**shared, "Chl_a": own}),
        "per_litre": (C.OCEAN_PER_LITRE, item.where(~older), {**shared, "Silicate": F.col("l_tax")}),
        "chlorophyll": (
            C.CHLOROPHYLL,
            item.where("l_returnflag <> 'A'"),
            {"Date": F.col("at"), "Depth_m": F.col("l_linenumber"), "Chl_a_supplement": F.col("l_tax")},
        ),
    }
    paths = {}
    for kind, (profile, rows, columns) in kinds.items():
        paths[kind] = tables.scratch_path(spark, kind)
        _lines(rows, profile, columns, ["/* notes", "1998", f"Citation:{profile.sep}2001"]).write.text(paths[kind])
    ocean = load_ocean(spark, **paths, station="fleet")
    return ocean.groupBy(F.col("Date").alias("at"), "Depth_m").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("O2_umol_L"), 4).alias("o2"),
        F.count("Chl_a").alias("n_chl"),
        r6(F.sum("Chl_a"), "chl"),
        r6(F.sum("Silicate"), "si"),
    )


def _gappy(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_suppkey").alias("station_id"),
        F.col("l_linenumber").alias("Depth_m"),
        F.to_date("l_shipdate").alias("Date"),
        F.when(F.col("l_returnflag") == "A", F.col("l_discount")).alias("Chl_a"),
    )
    supplement = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("station_id"),
        F.col("l_linenumber").alias("Depth_m"),
        F.to_date("l_shipdate").alias("Date"),
        F.col("l_tax").alias("Chl_a_supplement"),
    ).where(F.col("l_returnflag") == "R")
    return item, supplement


_GAPPY = """left_rows AS (
  SELECT l_orderkey, l_suppkey AS station_id, l_linenumber AS "Depth_m",
         CAST(l_shipdate AS DATE) AS "Date",
         CASE WHEN l_returnflag = 'A' THEN l_discount END AS "Chl_a" FROM lineitem),
 supplement AS (
  SELECT l_suppkey AS station_id, l_linenumber AS "Depth_m", CAST(l_shipdate AS DATE) AS "Date",
         l_tax AS s FROM lineitem WHERE l_returnflag = 'R')"""


@query(f"""WITH {_GAPPY}
SELECT l_orderkey, l.station_id, l."Depth_m", l."Date",
       round(coalesce(l."Chl_a", r.s), 6) AS "Chl_a"
FROM left_rows l LEFT JOIN supplement r ON l.station_id = r.station_id
 AND l."Depth_m" = r."Depth_m" AND l."Date" = r."Date" """)
def fill_join(spark, sf_dir):
    left, supplement = _gappy(spark, sf_dir)
    return harmonize.fill_missing(
        left,
        supplement,
        keys=["station_id", "Date", "Depth_m"],
        column="Chl_a",
        supplement_column="Chl_a_supplement",
    ).withColumn("Chl_a", F.round("Chl_a", 6))


@query(f"""WITH {_GAPPY},
 one AS (SELECT station_id, "Depth_m", "Date", avg(s) AS s FROM supplement GROUP BY 1, 2, 3)
SELECT l_orderkey, l.station_id, l."Depth_m", l."Date",
       round(coalesce(l."Chl_a", r.s), 6) AS "Chl_a"
FROM left_rows l LEFT JOIN one r ON l.station_id = r.station_id
 AND l."Depth_m" = r."Depth_m" AND l."Date" = r."Date" """)
def fill_join_one_per_key(spark, sf_dir):
    left, supplement = _gappy(spark, sf_dir)
    return harmonize.fill_missing(
        left,
        supplement,
        keys=["station_id", "Date", "Depth_m"],
        column="Chl_a",
        supplement_column="Chl_a_supplement",
        one_per_key=True,
    ).withColumn("Chl_a", F.round("Chl_a", 6))


# --- Weather, as-of -------------------------------------------------------------------------

_KINDS = {k: f"v_{k}" for k in ("view", "click", "error", "purchase", "signup")}
_EVENT_DAYS = f"""wide AS (
  SELECT user_id, ts, {", ".join(f"avg(value) FILTER (event_type = '{k}') AS {c}" for k, c in _KINDS.items())}
  FROM events GROUP BY 1, 2)"""


@query(f"""WITH {_EVENT_DAYS}
SELECT user_id, ts, {rounded(*_KINDS.values())} FROM wide""")
def long_to_wide(spark, sf_dir):
    """All kinds of events."""
    wide = weather.pivot_parameters(
        table(spark, sf_dir, "events").withColumnRenamed("event_type", "parameter"),
        by=["user_id"],
        time_col="ts",
        parameters=_KINDS,
    )
    return wide.select("user_id", "ts", *[r6(c) for c in _KINDS.values()])


@query(f"""WITH {_EVENT_DAYS},
 days AS (SELECT user_id, CAST(unnest(generate_series(date_trunc('day', min(ts)),
            date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS DATE) AS day
          FROM wide GROUP BY user_id),
 means AS (SELECT user_id, CAST(ts AS DATE) AS day, {", ".join(f"avg({c}) AS {c}" for c in _KINDS.values())}
           FROM wide GROUP BY 1, 2)
SELECT d.user_id, d.day, {rounded(*_KINDS.values())}
FROM days d LEFT JOIN means m ON m.user_id = d.user_id AND m.day = d.day""")
def daily_means(spark, sf_dir):
    wide = weather.pivot_parameters(
        table(spark, sf_dir, "events").withColumnRenamed("event_type", "parameter"),
        by=["user_id"],
        time_col="ts",
        parameters=_KINDS,
    )
    daily = weather.daily_means(
        wide, by=["user_id"], time_col="ts", value_cols=list(_KINDS.values()), day_col="day"
    )
    return daily.select("user_id", "day", *[r6(c) for c in _KINDS.values()])


@query(sql(f'SELECT nation_id, "Date", {rounded(*WEATHER)} FROM weather', "weather"))
def wind_vector(spark, sf_dir):
    return R.weather(spark, sf_dir).select("nation_id", "Date", *[r6(c) for c in WEATHER])


@query(sql(f"""SELECT CAST(nation_id AS VARCHAR) AS station_id, "Date", {rounded(*WEATHER)}
FROM weather WHERE nation_id % 2 = 1 OR "Date" >= DATE '1998-01-01'""", "weather"))
def daily_table(spark, sf_dir):
    """Daily weather of all stations published, that of every other station again from 1998 on, and read back."""
    path = tables.scratch_path(spark, "weather-daily")
    daily = R.weather(spark, sf_dir).withColumn("station_id", F.col("nation_id").cast("string"))
    tables.write_weather_daily(daily.drop("nation_id"), path)
    again = daily.where((F.col("nation_id") % 2 == 0) & (F.col("Date") >= F.lit("1998-01-01").cast("date")))
    tables.write_weather_daily(again.drop("nation_id"), path)
    stored = tables.read_weather_daily(spark, path)
    return stored.select("station_id", "Date", *[r6(c) for c in WEATHER])


@query(sql(f"""SELECT CAST(nation_id AS VARCHAR) AS station_id, "Date", {rounded(*WEATHER)} FROM weather
WHERE nation_id IN (SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey
                    WHERE r_name <> 'ASIA')""", "weather"))
def landed_weather(spark, sf_dir):
    """Readings landed by station and year, read back for a table of stations, up to the daily table."""
    path = tables.scratch_path(spark, "weather-long")
    readings = R.readings(spark, sf_dir).withColumn("station_id", F.col("nation_id").cast("string"))
    tables.write_weather_long(readings, path)
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region").where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    stations = places.select(F.col("n_nationkey").cast("string").alias("station_id"))
    landed = tables.read_weather_long(spark, path, stations=stations)
    wide = weather.pivot_parameters(landed, parameters=R.PARAMETERS)
    daily = weather.add_wind_vector(weather.daily_means(wide, value_cols=list(R.PARAMETERS.values())))
    return daily.select("station_id", "Date", *[r6(c) for c in WEATHER])


@query(
    sql("""SELECT p.station_id, p."Depth_m", CAST(p."Date" AS DATE) AS "Date",
       round(p."O2_umol_L", 6) AS "O2_umol_L", round(n.value, 6) AS value,
       CAST(n.seen AS DATE) AS seen
FROM placed p LEFT JOIN (
  SELECT nation, left_date, seen, value FROM (
    SELECT l.nation_id AS nation, l."Date" AS left_date, r.date AS seen, r.value,
           row_number() OVER (PARTITION BY l.nation_id, l."Date"
             ORDER BY abs(date_diff('day', l."Date", r.date)), r.date) AS k
    FROM (SELECT DISTINCT nation_id, "Date" FROM placed) l
    JOIN (SELECT nation_id, date, avg(value) AS value FROM readings GROUP BY 1, 2) r
      ON r.nation_id = l.nation_id AND abs(date_diff('day', l."Date", r.date)) <= 3)
  WHERE k = 1) n ON n.nation = p.nation_id AND n.left_date = p."Date" """, "placed", "readings")
)
def asof_nearest(spark, sf_dir):
    """Each sample with the nearest reading of its nation within three days."""
    right = R.readings(spark, sf_dir).groupBy("nation_id", "date").agg(F.avg("value").alias("value"))
    joined = asof.asof_nearest(
        R.placed_observations(spark, sf_dir),
        right,
        value_cols=["value"],
        by=["nation_id"],
        right_time_col="date",
        matched_time_col="seen",
    )
    return joined.select(
        *KEYS,
        F.to_date("Date").alias("Date"),
        r6("O2_umol_L"),
        r6("value"),
        F.to_date("seen").alias("seen"),
    )


@query("""WITH ask AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'),
 offer AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'),
 best AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, before DESC, tie) AS k
   FROM (SELECT a.event_id, o.value, o.event_id AS purchase_id,
                abs(epoch_us(a.ts) - epoch_us(o.ts)) AS gap, o.ts <= a.ts AS before,
                CASE WHEN o.ts <= a.ts THEN -o.event_id ELSE o.event_id END AS tie
         FROM ask a JOIN offer o ON o.user_id = a.user_id
          AND abs(epoch_us(a.ts) - epoch_us(o.ts)) <= 21600000000))
SELECT a.event_id, a.user_id, b.purchase_id, round(b.value, 6) AS value
FROM ask a LEFT JOIN best b ON b.event_id = a.event_id AND b.k = 1""")
def asof_subsecond(spark, sf_dir):
    """Each click with the purchase of the same user nearest in time, within six hours."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    joined = asof.asof_nearest(
        events.where(F.col("event_type") == "click").select("event_id", "user_id", "ts"),
        events.where(F.col("event_type") == "purchase").select(
            "user_id", "ts", F.col("event_id").alias("purchase_id"), "value"
        ),
        value_cols=["purchase_id", "value"],
        by=["user_id"],
        time_col="ts",
        tolerance=timedelta(hours=6),
        sequence_cols=["purchase_id"],
    )
    return joined.select("event_id", "user_id", "purchase_id", r6("value"))


@query(sql(f"""SELECT p.station_id, p."Depth_m", CAST(p."Date" AS DATE) AS "Date", count(*) AS n,
       count(n."Air_Temp_C") AS n_air, {", ".join(f'round(sum(n."{c}"), 4) AS "{c}"' for c in WEATHER)}
FROM placed p LEFT JOIN nearest n ON n.n = p.nation_id AND n.at = p."Date" GROUP BY 1, 2, 3""", "placed", "nearest"))
def weather_by_station(spark, sf_dir):
    """Samples with the weather of the weather station that serves their ocean station."""
    served = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("station_id"), F.col("s_nationkey").alias("weather_station")
    )
    daily = R.weather(spark, sf_dir).withColumnRenamed("nation_id", "station_id")
    joined = join_weather(R.observations(spark, sf_dir), daily, station_map=served)
    return joined.groupBy(*KEYS, F.to_date("Date").alias("Date")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("Air_Temp_C").alias("n_air"),
        *[F.round(F.sum(c), 4).alias(c) for c in WEATHER],
    )


# --- Weekly table ---------------------------------------------------------------------------


@query(sql("SELECT * FROM extent", "extent"))
def time_extent(spark, sf_dir):
    return resample.time_extent(R.observations(spark, sf_dir))


@query(sql("SELECT * FROM series", "series"))
def series_keys(spark, sf_dir):
    return audit.series_keys(R.observations(spark, sf_dir))


@query(sql(f'SELECT {SERIES}, "Date", {named(*OCEAN)} FROM weekly', "weekly"))
def weekly_mean(spark, sf_dir):
    means = resample.weekly_mean(R.observations(spark, sf_dir), value_cols=OCEAN)
    return means.select(*KEYS, "Date", *OCEAN)


@query(sql(f'SELECT {SERIES}, "Date", "Time_Idx", {named(*OCEAN)} FROM grid', "grid"))
def weekly_grid(spark, sf_dir):
    grid = resample.weekly_grid(R.observations(spark, sf_dir), value_cols=OCEAN)
    return grid.select(*KEYS, "Date", "Time_Idx", *OCEAN)


@query(sql(f"""SELECT {SERIES}, "Date", "Time_Idx", {named(*OCEAN)}, "O2_umol_L_observed"
FROM filled""", "filled"))
def interp_bounded(spark, sf_dir):
    rows = R.weekly(spark, sf_dir, observed_flags=True)
    return rows.select(*KEYS, "Date", "Time_Idx", *OCEAN, "O2_umol_L_observed")


@query(sql(f"""SELECT {SERIES}, "Date", "Time_Idx", "O2_umol_L", "Temp_C" FROM filled
WHERE "Depth_m" IN (1, 4)""", "filled"))
def series_table(spark, sf_dir):
    """The weekly table stored by depth and sorted, and two depths of it read back."""
    path = tables.scratch_path(spark, "weekly")
    tables.write_series_table(R.weekly(spark, sf_dir), path)
    stored = spark.read.parquet(path).where(F.col("Depth_m").isin(SURFACE, TARGET))
    return stored.select(*KEYS, "Date", "Time_Idx", "O2_umol_L", "Temp_C")


@query(sql(f"""SELECT {SERIES}, "Date", "Time_Idx", "O2_umol_L"
FROM filled""", "filled"))
def interp_on_grid(spark, sf_dir):
    """The same filling, applied to a grid that is complete already."""
    seen = R.observations(spark, sf_dir)
    grid = resample.weekly_grid(seen, value_cols=["O2_umol_L"], tasks=resample.series_tasks(seen))
    rows = resample.interpolate_bounded(grid, keys=KEYS, value_cols=["O2_umol_L"])
    return rows.select(*KEYS, "Date", "Time_Idx", "O2_umol_L")


@query(sql("""SELECT "Depth_m", count(*) AS n_weeks, count("O2_umol_L") AS n_known,
       count(CASE WHEN NOT "O2_umol_L_observed" THEN "O2_umol_L" END) AS n_filled,
       count(CASE WHEN NOT "O2_umol_L_observed" AND "O2_umol_L" < 60 THEN 1 END) AS n_filled_below,
       round(count(CASE WHEN NOT "O2_umol_L_observed" THEN "O2_umol_L" END)
             / count("O2_umol_L"), 6) AS filled_share,
       round(count(CASE WHEN NOT "O2_umol_L_observed" AND "O2_umol_L" < 60 THEN 1 END)
             / count("O2_umol_L"), 6) AS filled_below_share
FROM filled GROUP BY 1""", "filled"))
def interp_audit(spark, sf_dir):
    report = audit.interpolation_audit(R.weekly(spark, sf_dir, observed_flags=True), by=["Depth_m"])
    return report.withColumns({c: F.round(c, 6) for c in ("filled_share", "filled_below_share")})


@query("""SELECT o_orderkey, round(sin(2 * pi() * month(o_orderdate) / 12), 6) AS month_sin,
       round(cos(2 * pi() * month(o_orderdate) / 12), 6) AS month_cos FROM orders""")
def month_encoding(spark, sf_dir):
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", r6(month_sin(at), "month_sin"), r6(month_cos(at), "month_cos")
    )


# --- Features -------------------------------------------------------------------------------

_SURFACE = surface("filled")


def _with_surface(spark, sf_dir):
    weekly = R.weekly(spark, sf_dir)
    return features.add_surface_values(labels.select_depth(weekly, TARGET), weekly)


@query(sql(f"""SELECT station_id, "Date", {rounded("Surface_Temp_C", "Surface_O2_umol_L")}
FROM ({_SURFACE})""", "filled"))
def surface_lookup(spark, sf_dir):
    return _with_surface(spark, sf_dir).select(
        "station_id", "Date", r6("Surface_Temp_C"), r6("Surface_O2_umol_L")
    )


@query(sql(f"""SELECT station_id, "Date",
       round("Surface_Temp_C" - "Temp_C", 6) AS "Vertical_Temp_Grad",
       round("Surface_O2_umol_L" - "O2_umol_L", 6) AS "Vertical_O2_Grad"
FROM ({_SURFACE})""", "filled"))
def vertical_gradient(spark, sf_dir):
    return features.add_vertical_gradients(_with_surface(spark, sf_dir)).select(
        "station_id", "Date", r6("Vertical_Temp_Grad"), r6("Vertical_O2_Grad")
    )


@query(sql(f"""SELECT {SERIES}, "Date",
       "O2_umol_L" - lag("O2_umol_L") {OVER} AS "O2_Derivative_1W" FROM filled""",
       "filled"))
def diff_1w(spark, sf_dir):
    return features.add_change(R.weekly(spark, sf_dir)).select(*KEYS, "Date", "O2_Derivative_1W")


_LAGS = ["Chl_a_lag_1W", "Chl_a_lag_2W", "Chl_a_lag_3W", "Chl_a_lag_4W"]


@query(sql(f"""SELECT {SERIES}, "Date", {", ".join(
    f'lag("Chl_a", {k}) {OVER} AS "Chl_a_lag_{k}W"' for k in (1, 2, 3, 4))}
FROM filled""", "filled"))
def lags_1_4(spark, sf_dir):
    rows = features.add_lags(R.weekly(spark, sf_dir))
    return rows.select(*KEYS, "Date", *_LAGS)


@query("""SELECT o_orderkey, round(power(o_totalprice / 1000, 2), 6) AS "Wind_Mixing_Energy"
FROM orders""")
def mixing_energy(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("Wind_Speed_ms", F.col("o_totalprice") / 1000)
    return features.add_mixing_energy(rows).select("o_orderkey", r6("Wind_Mixing_Energy"))


@query(sql(f"""SELECT {SERIES}, "Date", round(avg("Chl_a") OVER (PARTITION BY {SERIES}
       ORDER BY "Date" ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS "Chl_a_mean_4W"
FROM filled""", "filled"))
def rolling_mean(spark, sf_dir):
    rows = features.add_rolling_mean(R.weekly(spark, sf_dir), column="Chl_a", weeks=4)
    return rows.select(*KEYS, "Date", r6("Chl_a_mean_4W"))


_FEATURES = [*OCEAN, *WEATHER, "month_sin", "month_cos", "Surface_Temp_C", "Surface_O2_umol_L",
             "Vertical_Temp_Grad", "Vertical_O2_Grad", "O2_Derivative_1W", "Wind_Mixing_Energy",
             *_LAGS, "oxygen_deficit", "sample_weight"]
_COMPLETE = " AND ".join(f'"{c}" IS NOT NULL' for c in _FEATURES)


@query(sql(f"""SELECT {SERIES}, "Date", "Time_Idx", {rounded(*_FEATURES)}
FROM featured WHERE {_COMPLETE}""", "featured"))
def engineered_features(spark, sf_dir):
    """From samples and readings to the complete labelled rows of the target depth."""
    rows = R.featured(spark, sf_dir, complete_only=True)
    return rows.select(*KEYS, "Date", "Time_Idx", *[r6(c) for c in _FEATURES])


@query(sql(f"""SELECT count(*) AS rows_before,
       count(CASE WHEN {_COMPLETE} THEN 1 END) AS rows_after,
       count(*) - count(CASE WHEN {_COMPLETE} THEN 1 END) AS rows_dropped,
       round(100.0::DOUBLE * (count(*) - count(CASE WHEN {_COMPLETE} THEN 1 END)) / count(*), 6)
         AS dropped_pct,
       count(*) - count("O2_umol_L") AS "null_O2_umol_L",
       count(*) - count("Air_Temp_C") AS "null_Air_Temp_C",
       count(*) - count("Chl_a_lag_4W") AS "null_Chl_a_lag_4W"
FROM featured""", "featured"))
def completeness(spark, sf_dir):
    report = labels.completeness_report(R.featured(spark, sf_dir, complete_only=False))
    return report.select(
        "rows_before",
        "rows_after",
        "rows_dropped",
        r6("dropped_pct"),
        "null_O2_umol_L",
        "null_Air_Temp_C",
        "null_Chl_a_lag_4W",
    )


# --- Labels, audits, episodes ---------------------------------------------------------------


@query(sql(f"""SELECT {SERIES}, "Date", round(oxygen_deficit, 6) AS oxygen_deficit
FROM labelled""", "labelled"))
def deficit(spark, sf_dir):
    return labels.add_deficit(R.weekly(spark, sf_dir)).select(*KEYS, "Date", r6("oxygen_deficit"))


@query(sql(f"""SELECT {SERIES}, "Date", sample_weight,
       CASE WHEN "O2_umol_L" < 30 THEN 'severe' WHEN "O2_umol_L" < 60 THEN 'hypoxic'
            WHEN "O2_umol_L" < 80 THEN 'watch' WHEN "O2_umol_L" IS NOT NULL THEN 'normoxic'
       END AS tier FROM labelled""", "labelled"))
def tier_weight(spark, sf_dir):
    rows = R.weekly(spark, sf_dir).transform(labels.add_tier_weight).transform(labels.add_tier)
    return rows.select(*KEYS, "Date", C.WEIGHT, "tier")


@query(sql(f"""SELECT station_id, "Date", {rounded("O2_umol_L", "oxygen_deficit")}, sample_weight
FROM labelled WHERE "Depth_m" = 4""", "labelled"))
def label_risk(spark, sf_dir):
    rows = labels.label_risk(R.weekly(spark, sf_dir), target_depth=TARGET)
    return rows.select("station_id", "Date", r6("O2_umol_L"), r6("oxygen_deficit"), C.WEIGHT)


@query(sql(f"""SELECT {SERIES}, "Date",
       CASE WHEN "O2_umol_L" < 60 THEN 100.0::DOUBLE ELSE 1.0 END AS sample_weight
FROM labelled""", "labelled"))
def extreme_weight(spark, sf_dir):
    return labels.with_extreme_weights(R.labelled(spark, sf_dir)).select(*KEYS, "Date", C.WEIGHT)


@query(sql(f"""SELECT {SERIES}, "Date", 1.0::DOUBLE AS sample_weight FROM labelled""", "labelled"))
def uniform_weight(spark, sf_dir):
    return labels.with_uniform_weights(R.labelled(spark, sf_dir)).select(*KEYS, "Date", C.WEIGHT)


_SHARES = ", ".join(
    f'round(avg(CASE WHEN "O2_umol_L" IS NOT NULL THEN CAST("O2_umol_L" < {t} AS DOUBLE) END), 6) '
    f"AS {n}" for n, t in (("watch", 80), ("hypoxic", 60), ("severe", 30))
)


def _rounded_shares(report: DataFrame) -> DataFrame:
    return report.withColumns({c: F.round(c, 6) for c in ("watch", "hypoxic", "severe")})


@query(sql(f'SELECT "Depth_m", {_SHARES} FROM labelled GROUP BY 1', "labelled"))
def imbalance(spark, sf_dir):
    return _rounded_shares(labels.imbalance_report(R.labelled(spark, sf_dir), by=["Depth_m"]))


@query(sql(f"""SELECT CAST(month AS INTEGER) AS month, CAST(decade AS INTEGER) AS decade,
       count("O2_umol_L") AS n_known, {_SHARES}
FROM (SELECT *, month("Date") AS month, year("Date") // 10 * 10 AS decade FROM labelled)
GROUP BY GROUPING SETS ((month), (decade), ())""", "labelled"))
def imbalance_by_period(spark, sf_dir):
    return _rounded_shares(audit.imbalance_by_period(R.labelled(spark, sf_dir)))


@query(sql("""SELECT "Depth_m", round(skewness("O2_umol_L"), 6) AS skew_target,
       count(CASE WHEN oxygen_deficit > 0 THEN 1 END) AS n_deficit,
       round(skewness(CASE WHEN oxygen_deficit > 0 THEN oxygen_deficit END), 6) AS skew_deficit,
       round(skewness(CASE WHEN oxygen_deficit > 0 THEN ln(1 + oxygen_deficit) END), 6)
         AS skew_log_deficit
FROM labelled GROUP BY 1""", "labelled"))
def skew_audit(spark, sf_dir):
    report = audit.skewness_audit(R.labelled(spark, sf_dir), by=["Depth_m"])
    return report.withColumns(
        {c: F.round(c, 6) for c in report.columns if c.startswith("skew")}
    )


@query(sql(f'SELECT {SERIES}, "Date", is_below, CAST(run AS BIGINT) AS run FROM runs', "runs"))
def run_numbers(spark, sf_dir):
    return episodes.mark_runs(R.weekly(spark, sf_dir)).select(*KEYS, "Date", "is_below", "run")


_EPISODE = f'{SERIES}, start_date, end_date, duration_weeks, min_o2'


@query(sql(f"SELECT {_EPISODE} FROM episodes", "episodes"), name="episodes")
def find_episodes(spark, sf_dir):
    """Flagship: samples to weekly grid to bounded interpolation to episodes per series."""
    return episodes.find_episodes(R.weekly(spark, sf_dir))


@query(sql(f"""SELECT {_EPISODE} FROM episodes
WHERE duration_weeks >= 2 AND start_date >= DATE '2000-01-01'""", "episodes"))
def held_out_events(spark, sf_dir):
    return episodes.held_out_events(R.weekly(spark, sf_dir), min_weeks=2, from_date="2000-01-01")


@query(sql("""SELECT "Depth_m", count(*) AS n_episodes, max(duration_weeks) AS longest_weeks
FROM episodes GROUP BY 1""", "episodes"))
def episode_stats(spark, sf_dir):
    found = episodes.find_episodes(R.weekly(spark, sf_dir))
    return episodes.episode_statistics(found, by=["Depth_m"])


# --- Split, windows, weights ----------------------------------------------------------------


@query(sql(f'SELECT {SERIES}, "Date", split FROM cut', "cut"))
def chrono_split(spark, sf_dir):
    return R.split(spark, sf_dir).select(*KEYS, "Date", "split")


@query(sql(f"""SELECT {SERIES}, "Date",
       CASE WHEN row_number() {OVER} <= floor(count(*) OVER (PARTITION BY {SERIES}) * 0.8::DOUBLE)
            THEN 'train' ELSE 'validation' END AS split FROM known""", "known"))
def split_per_series(spark, sf_dir):
    return split.split_per_series(R.known_weeks(spark, sf_dir)).select(*KEYS, "Date", "split")


_PROFILE_SQL = """SELECT coalesce(split, 'total') AS split, count(*) AS n_rows,
       min("Date") AS first_date, max("Date") AS last_date
FROM cut GROUP BY ROLLUP (split)"""


@query(sql(_PROFILE_SQL, "cut"))
def split_profile(spark, sf_dir):
    return audit.dataset_profile(R.split(spark, sf_dir))


@query(sql(f"""SELECT *, 3 AS n_features, 60.0::DOUBLE AS hypoxic_below,
       12.0::DOUBLE AS severe_weight, 0.8::DOUBLE AS train_ratio FROM ({_PROFILE_SQL})""", "cut"))
def run_manifest(spark, sf_dir):
    """Manifest of a run, written and read back."""
    path = tables.scratch_path(spark, "manifest")
    manifest = records.run_manifest(
        audit.dataset_profile(R.split(spark, sf_dir)),
        features=["Temp_C", "Chl_a", "Salinity"],
        hyperparameters={"reg_param": 0.1},
        settings={"train_ratio": 0.8},
    )
    records.write_manifest(manifest, path)
    return records.read_manifest(spark, path).select(
        F.inline("dataset"),
        F.size("features").alias("n_features"),
        F.col("weights.thresholds")["hypoxic"].alias("hypoxic_below"),
        F.col("weights.tier_weights")["severe"].alias("severe_weight"),
        F.col("settings")["train_ratio"].alias("train_ratio"),
    )


def _check_sql(source: str) -> str:
    low = '"O2_umol_L" < 60'
    mean_low = f"avg(CASE WHEN {low} THEN sample_weight END)"
    mean_high = f"avg(CASE WHEN coalesce({low}, FALSE) THEN NULL ELSE sample_weight END)"
    return f"""SELECT "Depth_m", count(sample_weight) > 0 AS weight_present,
       count(CASE WHEN {low} THEN 1 END) AS n_below,
       count(*) - count(CASE WHEN {low} THEN 1 END) AS n_not_below,
       round({mean_low}, 6) AS mean_weight_below, round({mean_high}, 6) AS mean_weight_not_below,
       round({mean_low} / {mean_high}, 6) AS weight_ratio
FROM {source} GROUP BY 1"""


def _rounded_check(report: DataFrame) -> DataFrame:
    names = ("mean_weight_below", "mean_weight_not_below", "weight_ratio")
    return report.withColumns({c: F.round(c, 6) for c in names})


@query(sql(_check_sql("labelled"), "labelled"))
def weight_check(spark, sf_dir):
    return _rounded_check(audit.weight_check(R.labelled(spark, sf_dir), by=["Depth_m"]))


@query(sql(_check_sql("(SELECT * FROM cut WHERE split = 'train')"), "cut"))
def train_weight_check(spark, sf_dir):
    train, _ = split.split_frames(R.split(spark, sf_dir))
    return _rounded_check(audit.weight_check(train, by=["Depth_m"], empty_ratio_as_zero=True))


@query(sql(f"""SELECT {SERIES}, count(CASE WHEN "O2_umol_L" < 60 THEN 1 END) AS n_below,
       count(*) - count(CASE WHEN "O2_umol_L" < 60 THEN 1 END) AS n_not_below
FROM labelled GROUP BY {SERIES}""", "labelled"))
def class_counts(spark, sf_dir):
    return audit.class_counts(R.labelled(spark, sf_dir), by=KEYS)


_STEPS = f"""steps AS (
  SELECT o.station_id, o."Depth_m", o.split, o."Time_Idx" AS origin,
         t."Time_Idx" - o."Time_Idx" AS "offset", t."O2_umol_L",
         CASE WHEN t."Time_Idx" > o."Time_Idx" THEN t.sample_weight END AS sample_weight,
         count(*) FILTER (t."Time_Idx" <= o."Time_Idx") OVER g AS n_encoder,
         count(*) FILTER (t."Time_Idx" > o."Time_Idx") OVER g AS n_decoder
  FROM (SELECT * FROM parts) o JOIN parts t ON t.station_id = o.station_id
   AND t."Depth_m" = o."Depth_m" AND t.split = o.split
   AND t."Time_Idx" BETWEEN o."Time_Idx" - 7 AND o."Time_Idx" + 4
  WINDOW g AS (PARTITION BY o.station_id, o."Depth_m", o.split, o."Time_Idx"))"""
_PARTS = f"""parts AS (
  SELECT *, CASE WHEN row_number() {OVER}
              <= floor(count(*) OVER (PARTITION BY {SERIES}) * 0.8::DOUBLE)
            THEN 'train' ELSE 'validation' END AS split FROM known)"""


def _windows(spark, sf_dir, *, digits=(), **covariates):
    """Windows on rows with gaps, inside either side of the split. Columns ``digits`` are rounded: once per week."""
    known = R.known_weeks(spark, sf_dir).withColumns({c: r6(c) for c in digits})
    parts = split.split_per_series(known)
    return windows.encoder_decoder_windows(parts, split_col="split", **covariates)


@query(sql("SELECT 1", "known").replace(
    "SELECT 1", f""", {_PARTS}, {_STEPS}
SELECT {SERIES}, split, origin, "offset", "O2_umol_L", sample_weight
FROM steps WHERE n_encoder >= 4 AND n_decoder >= 1"""))
def enc_dec_windows(spark, sf_dir):
    # Spark doesn't look into collected structs for what is never read, so covariates that no step shows stay out here.
    held = _windows(spark, sf_dir, known=(), unknown=())
    steps = windows.window_steps(held, keys=[*KEYS, "split"])
    return steps.select(*KEYS, "split", "origin", "offset", "O2_umol_L", C.WEIGHT)


_PAST = ("Temp_C", "Salinity", "Chl_a")
_ROLES = [*_PAST, *C.KNOWN_COVARIATES]


@query(sql("SELECT 1", "known").replace(
    "SELECT 1", f""", {_PARTS}, {_STEPS.replace('t."O2_umol_L",', 't."O2_umol_L", ' + ", ".join(
        f'CASE WHEN t."Time_Idx" <= o."Time_Idx" THEN t."{c}" END AS "{c}"' for c in _PAST
    ) + ", t.month_sin, t.month_cos,")}
SELECT {SERIES}, split, origin, "offset", {rounded(*_ROLES)}, n_encoder AS encoder_length,
       min("offset") OVER (PARTITION BY {SERIES}, split, origin) AS first_index,
       max("offset") OVER (PARTITION BY {SERIES}, split, origin) AS last_index
FROM steps WHERE n_encoder >= 4 AND n_decoder >= 1"""))
def window_covariates(spark, sf_dir):
    """Covariates by role: past ones in the encoder only, the calendar in both, with the window's own columns."""
    # A week lies in up to twelve windows, so it is rounded before and not in each of them.
    held = _windows(spark, sf_dir, digits=_ROLES).withColumns(
        {
            "first_index": F.element_at("relative_index", 1),
            "last_index": F.element_at("relative_index", -1),
        }
    )
    keys, own = [*KEYS, "split"], ["encoder_length", "first_index", "last_index"]
    steps = windows.window_steps(held, keys=keys, covariates=_ROLES, carry=own)
    return steps.select(*keys, "origin", "offset", *_ROLES, *own)


@query(sql("SELECT 1", "known").replace(
    "SELECT 1", f""", {_PARTS}, {_STEPS}
SELECT {SERIES}, max(origin) AS origin
FROM steps WHERE n_encoder >= 4 AND n_decoder = 4 AND split = 'validation'
GROUP BY {SERIES}"""))
def last_window(spark, sf_dir):
    held_out = _windows(spark, sf_dir).where(F.col("split") == "validation")
    return windows.last_window(held_out).select(*KEYS, F.col("Time_Idx").alias("origin"))



_Z = '("O2_umol_L" + ln(1 - exp(-"O2_umol_L")))'


@query(sql(f"""SELECT c.station_id, c."Depth_m", "Date",
       round(({_Z} - center) / CASE WHEN scale <> 0 THEN scale END, 6) AS "O2_umol_L_scaled",
       round(ln(1 + exp(({_Z} - center) / CASE WHEN scale <> 0 THEN scale END * scale + center)), 6) AS "O2_umol_L_back"
FROM (SELECT * FROM cut WHERE split = 'validation') c
LEFT JOIN (SELECT station_id, "Depth_m", avg({_Z}) AS center, stddev_samp({_Z}) AS scale
           FROM cut WHERE split = 'train' GROUP BY 1, 2) s
  ON s.station_id = c.station_id AND s."Depth_m" = c."Depth_m" """, "cut"))
def group_scaling(spark, sf_dir):
    """Validation rows on the scale of their series' training rows, and back."""
    train, validation = split.split_frames(R.split(spark, sf_dir))
    scaled = windows.apply_scaling(validation, windows.fit_scaling(train))
    back = windows.unscale(scaled, column="O2_umol_L_scaled", name="O2_umol_L_back")
    return back.select(*KEYS, "Date", r6("O2_umol_L_scaled"), r6("O2_umol_L_back"))


# --- Evaluation on the persistence baseline -------------------------------------------------


@query(sql(f"""SELECT {SERIES}, split, origin, horizon, "Date", actual, predicted,
       sample_weight FROM forecasts_across""", "forecasts_across"))
def persistence(spark, sf_dir):
    rows = R.baseline_across(spark, sf_dir)
    return rows.select(
        *KEYS, "split", "origin", "horizon", "Date", "actual", "predicted", C.WEIGHT
    )


_SCORES = """count(*) AS n,
       round((sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y))
         / sqrt((sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x))
              * (sum(w) * sum(w * y * y) - sum(w * y) * sum(w * y))), 6) AS weighted_corr,
       round(sqrt(sum(w * (y - x) * (y - x)) / sum(w)), 6) AS weighted_rmse,
       round(sqrt(avg(CASE WHEN y < 60 THEN (y - x) * (y - x) END)), 6) AS tail_rmse"""
_WXY = "(SELECT *, sample_weight AS w, predicted AS x, actual AS y FROM forecasts)"


def _rounded_scores(scores: DataFrame) -> DataFrame:
    names = ("weighted_corr", "weighted_rmse", "tail_rmse", "f1", "roc_auc")
    return scores.withColumns({c: F.round(c, 6) for c in names if c in scores.columns})


@query(sql(f"SELECT split, {_SCORES} FROM {_WXY} GROUP BY split", "forecasts"))
def weighted_scores(spark, sf_dir):
    return _rounded_scores(evaluate.weighted_scores(R.baseline(spark, sf_dir), by=["split"]))


def _banded(targets, *, across: bool = False):
    """Baseline with a band: lowest and highest known value of the eight weeks before.

    Inside either side of the split, as scores are per side, or ``across`` it for all weeks of a series.
    """
    series = KEYS if across else [*KEYS, "split"]
    past = W.partitionBy(*series).orderBy("Time_Idx").rowsBetween(-7, 0)
    rows = R.observed(targets).withColumns(
        {"low": F.min("O2_umol_L").over(past), "high": F.max("O2_umol_L").over(past)}
    )
    held = evaluate.persistence(rows, keys=series, carry=["split", "low", "high"])
    return held.withColumns(
        {
            "p10": F.least("low", "predicted"),
            "p50": F.col("predicted"),
            "p90": F.greatest("high", "predicted"),
        }
    )


def _pinball(q: float, c: str) -> str:
    return (f"sum(sample_weight * greatest({q}::DOUBLE * (actual - {c}), "
            f"({q}::DOUBLE - 1) * (actual - {c}))) / sum(sample_weight)")


@query(sql(f"""SELECT split, horizon, round({_pinball(0.1, "p10")}, 6) AS pinball_10,
       round({_pinball(0.5, "p50")}, 6) AS pinball_50,
       round({_pinball(0.9, "p90")}, 6) AS pinball_90,
       round(({_pinball(0.1, "p10")} + {_pinball(0.5, "p50")} + {_pinball(0.9, "p90")}) / 3, 6)
         AS pinball_mean
FROM banded GROUP BY 1, 2""", "banded"))
def pinball_weighted(spark, sf_dir):
    scores = evaluate.pinball_scores(
        _banded(R.targets(spark, sf_dir)),
        quantile_cols={0.1: "p10", 0.5: "p50", 0.9: "p90"},
        by=["split", "horizon"],
    )
    return scores.select(
        "split", "horizon", *[r6(c) for c in scores.columns if c.startswith("pinball")]
    )


@query(sql(f"""SELECT {SERIES}, origin, horizon, "Date", round(CASE
       WHEN 60 < p10 THEN 0.05::DOUBLE WHEN 60 > p90 THEN 0.95
       WHEN 60 < p50 THEN 0.1 + 0.4::DOUBLE * (60 - p10) / (p50 - p10)
       WHEN p90 = p50 THEN 0.5 ELSE 0.5 + 0.4::DOUBLE * (60 - p50) / (p90 - p50) END, 6) AS risk
FROM banded_across""", "banded_across"))
def risk_probability(spark, sf_dir):
    rows = evaluate.risk_by_date(_banded(R.targets(spark, sf_dir), across=True))
    return rows.select(*KEYS, "origin", "horizon", "Date", r6("risk"))


_COUNTS = """count(*) FILTER (x < t AND y < t) AS tp, count(*) FILTER (x < t AND y >= t) AS fp,
       count(*) FILTER (x >= t AND y < t) AS fn, count(*) FILTER (x >= t AND y >= t) AS tn"""


@query(sql(f"""SELECT split, threshold, tp, fp, fn, tn,
       round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
       round(tp / CASE WHEN tp + fp > 0 THEN tp + fp END, 6) AS "precision",
       round(tp / CASE WHEN tp + fn > 0 THEN tp + fn END, 6) AS recall,
       round(2 * tp / CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp + fp + fn END, 6) AS f1
FROM (SELECT split, t AS threshold, {_COUNTS} FROM {_WXY}
      CROSS JOIN (VALUES (20.0::DOUBLE), (30.0), (40.0), (50.0), (60.0), (70.0), (80.0)) v(t)
      GROUP BY 1, 2)""", "forecasts"))
def threshold_sweep(spark, sf_dir):
    swept = evaluate.threshold_sweep(
        R.baseline(spark, sf_dir), thresholds=[20, 30, 40, 50, 60, 70, 80], by=["split"]
    )
    ratios = ("accuracy", "precision", "recall", "f1")
    return swept.withColumns({c: F.round(c, 6) for c in ratios})


# Rank-sum form of the area under the curve, ties at their mean rank.
_AUC = """CASE WHEN np * nn > 0 THEN (ranks - np * (np + 1) / 2) / (np * nn) END"""


def _auc_sql(groups: str) -> str:
    return f"""SELECT {groups}, count(*) FILTER (y < 60) AS np, count(*) FILTER (y >= 60) AS nn,
         sum(CASE WHEN y < 60 THEN r END) AS ranks
  FROM (SELECT *, rank() OVER (PARTITION BY {groups} ORDER BY x DESC)
               + (count(*) OVER (PARTITION BY {groups}, x) - 1) / 2 AS r FROM {_WXY})
  GROUP BY {groups}"""


@query(sql(f"""SELECT split, np AS n_positive, nn AS n_negative, round({_AUC}, 6) AS roc_auc
FROM ({_auc_sql("split")})""", "forecasts"))
def roc_auc(spark, sf_dir):
    return _rounded_scores(evaluate.roc_auc(R.baseline(spark, sf_dir), by=["split"]))


_BY_HORIZON = f"""SELECT s.*, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
       round({_AUC}, 6) AS roc_auc
FROM (SELECT split, horizon, {_SCORES} FROM {_WXY} GROUP BY 1, 2) s
JOIN (SELECT split, horizon, {_COUNTS} FROM (SELECT *, 60 AS t FROM {_WXY}) GROUP BY 1, 2) c
  ON c.split = s.split AND c.horizon = s.horizon
JOIN ({_auc_sql("split, horizon")}) a ON a.split = s.split AND a.horizon = s.horizon"""


@query(sql(_BY_HORIZON, "forecasts"))
def metrics_by_horizon(spark, sf_dir):
    stored = tables.staged(R.baseline(spark, sf_dir), "baseline")
    return _rounded_scores(evaluate.metrics_by_horizon(stored, by=["split"]))


@query(sql(f"""SELECT coalesce(min(CASE WHEN roc_auc >= 0.7 THEN NULL ELSE horizon END) - 1, max(horizon))
       AS reliable_horizon
FROM (SELECT horizon, {_AUC} AS roc_auc FROM ({_auc_sql("horizon")}))""", "forecasts"))
def reliable_horizon(spark, sf_dir):
    by_horizon = evaluate.roc_auc(R.baseline(spark, sf_dir), by=["horizon"])
    return evaluate.largest_reliable_horizon(by_horizon)


@query(sql(f"""SELECT split, horizon, metric, round(value, 6) AS value, expected_low,
       expected_high, CASE WHEN value < expected_low THEN 'below'
         WHEN value > expected_high THEN 'above' ELSE 'within' END AS verdict
FROM (SELECT split, horizon, unnest(['f1', 'roc_auc']) AS metric,
             unnest([f1, roc_auc]) AS value, unnest([0.2::DOUBLE, 0.7]) AS expected_low,
             unnest([0.4::DOUBLE, 0.85]) AS expected_high FROM ({_BY_HORIZON}))""", "forecasts"))
def expectation_check(spark, sf_dir):
    stored = tables.staged(R.baseline(spark, sf_dir), "baseline")
    found = _rounded_scores(evaluate.metrics_by_horizon(stored, by=["split"]))
    return evaluate.expectation_check(found.select("split", "horizon", "f1", "roc_auc"))


def _study(spark, sf_dir):
    targets = R.targets(spark, sf_dir)
    events = episodes.held_out_events(targets, from_date="2000-01-01")
    return evaluate.event_study(
        events,
        _banded(targets, across=True).withColumn("middle", (F.col("p10") + F.col("p90")) / 2),
        value_cols=["actual", "predicted", "middle"],
    )


_STUDY = """SELECT b.station_id, b."Depth_m", start_date, end_date, b."Date", origin, horizon,
       actual, predicted, (p10 + p90) / 2 AS middle
FROM banded_across b JOIN (SELECT * FROM episodes WHERE duration_weeks >= 2
                    AND start_date >= DATE '2000-01-01') e
  ON e.station_id = b.station_id AND e."Depth_m" = b."Depth_m"
 AND b."Date" BETWEEN start_date AND end_date"""


@query(sql(f"""SELECT {SERIES}, start_date, end_date, "Date", origin, horizon,
       actual, predicted, middle FROM ({_STUDY})""", "banded_across", "episodes"))
def event_study(spark, sf_dir):
    """Observation, persistence and middle of the band for every week of an event."""
    return _study(spark, sf_dir).select(
        *KEYS,
        "start_date",
        "end_date",
        "Date",
        "origin",
        "horizon",
        "actual",
        "predicted",
        "middle",
    )


@query(sql(f"""SELECT {SERIES}, start_date, end_date, horizon, count(*) AS n_weeks,
       round(avg(actual), 6) AS mean_actual,
       round(avg(predicted - actual), 6) AS bias_predicted,
       round(avg(middle - actual), 6) AS bias_middle,
       round(avg(abs(predicted - actual)), 6) AS mae_predicted,
       round(avg(abs(middle - actual)), 6) AS mae_middle
FROM ({_STUDY}) GROUP BY ALL""", "banded_across", "episodes"))
def event_summary(spark, sf_dir):
    summary = evaluate.event_summary(_study(spark, sf_dir), models=["predicted", "middle"])
    values = [c for c in summary.columns if c.startswith(("mean_", "bias_", "mae_"))]
    return summary.withColumns({c: F.round(c, 6) for c in values})


# --- Models ---------------------------------------------------------------------------------

_INPUTS = list(fits.INPUTS)


def _model_table(spark, sf_dir, *, by_station=True):
    """Rows with all inputs known and their split, stored by station because every fit and forecast reads them.

    The side of the split is a comparison, so it is not worth another stored table. Trees store a frame of their own, and
    nearly equal splits of theirs are told apart by the last digits of sums in the order of its rows: not by station.
    """
    tasks = R.place_tasks(spark, sf_dir)
    rows = labels.drop_incomplete(
        R.featured(spark, sf_dir, complete_only=False, tasks=tasks), [*_INPUTS, C.TARGET, C.WEIGHT]
    )
    kept = rows.select(
        *KEYS, "Date", "Time_Idx", "month_sin", "month_cos", *_INPUTS, C.TARGET, C.WEIGHT
    )
    held = tables.staged_by(kept, "labelled", ["station_id"], tasks) if by_station else tables.staged(kept, "labelled")
    return split.chronological_split(held)


def r3(column: str):
    return F.round(column, 3).alias(column)


_FORECAST = """SELECT station_id, "Depth_m", origin, horizon, "Date", round(actual, 3) AS actual,
       round(predicted, 3) AS predicted, round(p10, 3) AS p10, round(p50, 3) AS p50, round(p90, 3) AS p90
FROM tier_forecast"""


@query(sql(_FORECAST, "tier_forecast"))
def forecast(spark, sf_dir):
    rows = X.validation_forecast(_model_table(spark, sf_dir), features=_INPUTS)
    return rows.select(
        *KEYS, "origin", "horizon", "Date", *[r3(c) for c in ("actual", "predicted", "p10", "p50", "p90")]
    )


@query(sql(f"""SELECT horizon, names[i] AS input, round(beta[i] * s[i], 4) AS effect, round(intercept, 2) AS intercept
FROM (SELECT *, [{", ".join(f"'{c}'" for c in [*_INPUTS, *[f"{c}_enc" for c in _INPUTS], "future_sin", "future_cos"])}]
               AS names, unnest(range(1, {fits.Y + 1})) AS i FROM tier_form)""", "tier_form"))
def linear_form(spark, sf_dir):
    """Each input's effect on the forecast per standard deviation, by horizon."""
    frame = model_frame(_model_table(spark, sf_dir), features=_INPUTS, keys=[*KEYS, "split"]).store()
    train = frame.where(F.col("split") == "train")
    model = fit_forecaster(train, band=False)
    moments = frame_moments(train)
    rows = []
    for h, form in model.models.items():
        spread = (moments[None, h].co.diagonal() / moments[None, h].weight) ** 0.5
        for name, b, s in zip(form.columns, form.coefficients, spread):
            rows.append((h, name.removesuffix(f"_{h}") if name.startswith("future_") else name, float(b * s), form.intercept))
    effects = spark.createDataFrame(rows, "horizon INT, input STRING, effect DOUBLE, intercept DOUBLE")
    return effects.select("horizon", "input", F.round("effect", 4).alias("effect"), F.round("intercept", 2).alias("intercept"))


@query()
def forecast_trees(spark, sf_dir):
    rows = X.validation_forecast(_model_table(spark, sf_dir, by_station=False), features=_INPUTS, kind="trees")
    return rows.select(*KEYS, "origin", "horizon", "Date", "actual", "predicted", "p10", "p90")


@query(sql(f"""SELECT weights, round(loss, 6) AS loss, round(weighted_rmse, 6) AS weighted_rmse,
       round(tail_rmse, 6) AS tail_rmse, round(difference_pct, 4) AS difference_pct, difference_pct > 5 AS passed
FROM (SELECT *, 100.0::DOUBLE * abs(max(CASE WHEN weights = 'extreme' THEN loss END) OVER ()
                    - max(CASE WHEN weights = 'uniform' THEN loss END) OVER ())
                  / max(CASE WHEN weights = 'uniform' THEN loss END) OVER () AS difference_pct
      FROM ({fits.scores("extreme")} UNION ALL {fits.scores("uniform")}))""", "extreme_forecast", "uniform_forecast"))
def weight_experiment(spark, sf_dir):
    found = X.weight_experiment(_model_table(spark, sf_dir), features=_INPUTS)
    rounded_ = {c: F.round(c, 6) for c in ("loss", "weighted_rmse", "tail_rmse")}
    return found.withColumns({**rounded_, "difference_pct": F.round("difference_pct", 4)})


@query(sql("""SELECT e.station_id, e."Depth_m", start_date, end_date, w."Date", w.origin, w.horizon,
       round(w.actual, 3) AS actual, round(w.predicted, 3) AS weighted, round(u.predicted, 3) AS unweighted
FROM (SELECT * FROM episodes WHERE duration_weeks >= 2) e
JOIN tier_forecast w ON w.station_id = e.station_id AND w."Depth_m" = e."Depth_m" AND w."Date" BETWEEN start_date AND end_date
JOIN uniform_forecast u ON u.station_id = w.station_id AND u."Depth_m" = w."Depth_m" AND u.origin = w.origin
 AND u.horizon = w.horizon""", "episodes", "tier_forecast", "uniform_forecast"))
def event_study_models(spark, sf_dir):
    """Observation, weighted and unweighted model, week by week of every event of the validation side."""
    rows = _model_table(spark, sf_dir)
    both = X.validation_forecast(rows, features=_INPUTS).select(
        *KEYS, "origin", "horizon", "Date", "actual", F.col("predicted").alias("weighted")
    )
    plain = X.validation_forecast(labels.with_uniform_weights(rows), features=_INPUTS).select(
        *KEYS, "origin", "horizon", F.col("predicted").alias("unweighted")
    )
    study = evaluate.event_study(
        episodes.held_out_events(R.weekly(spark, sf_dir)),
        both.join(plain, [*KEYS, "origin", "horizon"]),
        value_cols=["actual", "weighted", "unweighted"],
    )
    return study.withColumns({c: F.round(c, 3) for c in ("actual", "weighted", "unweighted")})


@query()
def param_search(spark, sf_dir):
    """The leaderboard of the default search, written and read back."""
    store = ModelStore(spark, tables.scratch_path(spark, "models"))
    board = X.search_parameters(_model_table(spark, sf_dir), features=_INPUTS, store=store)
    path = tables.scratch_path(spark, "leaderboard")
    records.write_leaderboard(board, path)
    return records.read_leaderboard(spark, path)


_TRIALS = """trials AS (
  SELECT CAST(s_suppkey AS INTEGER) AS trial, score,
         CASE WHEN s_suppkey % 7 = 0 THEN 'failed' WHEN s_suppkey % 3 = 0 THEN 'pruned' ELSE 'complete' END AS state,
         s_nationkey AS width
  FROM supplier JOIN (SELECT l_suppkey, round(avg(l_quantity), 3) AS score FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)"""


@query(f"""WITH {_TRIALS}, best AS (SELECT * FROM trials WHERE state = 'complete' ORDER BY score, trial LIMIT 1)
SELECT v.state, CAST(CASE v.state WHEN 'total' THEN (SELECT count(*) FROM trials)
         ELSE (SELECT count(*) FROM trials t WHERE t.state = v.state) END AS BIGINT) AS n_trials,
       b.trial AS best_trial, b.score AS best_score, CAST(b.width AS DOUBLE) AS width, 0.25::DOUBLE AS reg_param, 8.0::DOUBLE AS encoder_length
FROM (VALUES ('total'), ('complete'), ('pruned'), ('failed')) v(state) CROSS JOIN best b""")
def trial_board(spark, sf_dir):
    """Suppliers as trials: leaderboard written and read back, its summary, best trial and merged configuration."""
    mean = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.round(F.avg("l_quantity"), 3).alias("score")
    )
    key = F.col("s_suppkey")
    state = F.when(key % 7 == 0, "failed").when(key % 3 == 0, "pruned").otherwise("complete")
    trials = table(spark, sf_dir, "supplier").join(mean, "s_suppkey").select(
        key.cast("int").alias("trial"),
        state.alias("state"),
        F.when(state != "failed", F.col("score")).alias("score"),
        F.lit(1).alias("iterations"),
        F.create_map(F.lit("width"), F.col("s_nationkey").cast("double")).alias("parameters"),
        F.when(state == "failed", "ValueError: no rows").alias("message"),
    )
    path = tables.scratch_path(spark, "leaderboard")
    records.write_leaderboard(trials, path)
    board = records.read_leaderboard(spark, path)
    merged = records.best_configuration(board, {"width": -1.0, "encoder_length": 8.0, "reg_param": 0.1}, {"reg_param": 0.25})
    best = X.best_trial(board).select(F.struct(F.col("trial").alias("best_trial"), F.col("score").alias("best_score")).alias("b"))
    return X.trial_summary(board).withColumn("b", best.scalar()).select(
        "state", "n_trials", "b.*", *[F.lit(merged[c]).alias(c) for c in ("width", "reg_param", "encoder_length")]
    )


@query(sql(fits.SELECTION, *[f"best_{k}" for k in range(fits.N + 1)]))
def forward_selection(spark, sf_dir):
    """Every candidate's validation error in every step of the selection, all features as candidates."""
    _, steps = X.select_features(_model_table(spark, sf_dir), candidates=_INPUTS)
    rows = [(s.step, s.candidate, round(s.score, 6), s.taken) for s in steps]
    return spark.createDataFrame(rows, "step INT, candidate STRING, score DOUBLE, taken BOOLEAN")


_LEVELS = {
    "Surface_O2_umol_L": [0, 125, 250, 375, 500],
    "Wind_Speed_ms": [50, 100, 150, 200, 250],
    "Temp_C": [10000, 30000, 50000, 70000, 90000],
    "Salinity": [0, 4, 8],
}


@query(sql(fits.response(_LEVELS), "model_ahead", "tier_form"))
def virtual_experiments(spark, sf_dir):
    """The response of the forecast to every combination of four drivers."""
    frame = model_frame(_model_table(spark, sf_dir), features=_INPUTS, keys=[*KEYS, "split"]).store()
    model = fit_forecaster(frame.where(F.col("split") == "train"), band=False)
    table_ = response_table(model, frame.where(F.col("split") == "validation"), _LEVELS)
    return table_.withColumn("mean_predicted", F.round("mean_predicted", 3))
