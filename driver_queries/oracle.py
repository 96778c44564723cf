"""Plain SQL for the registered queries, written independently of the Spark plans.

Where the operators unfold gaps and combine sums, the SQL uses a calendar, joins and ranks.
"""

from __future__ import annotations

# Common table expressions: name -> (needs, text).
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, needs: tuple[str, ...], text: str) -> None:
    CTES[name] = (needs, text)


_cte("obs", (), """
    SELECT l_suppkey AS station_id, l_linenumber AS "Depth_m",
           l_shipdate AS "Date", l_quantity * 10 AS "O2_umol_L", round(l_extendedprice) AS "Temp_C",
           round(l_discount * 100) AS "Chl_a", round(l_tax * 100) AS "Salinity"
    FROM lineitem""")
_cte("extent", ("obs",), """
    SELECT CAST(min("Date") AS DATE) AS first_day, CAST(max("Date") AS DATE) AS last_day FROM obs""")
_cte("weeks", ("extent",), """
    SELECT CAST(w AS DATE) AS "Date",
           CAST(row_number() OVER (ORDER BY w) - 1 AS INTEGER) AS "Time_Idx"
    FROM (SELECT unnest(generate_series(
            CAST(date_trunc('week', first_day + 6) AS TIMESTAMP),
            CAST(last_day AS TIMESTAMP), INTERVAL 7 DAY)) AS w FROM extent)""")
_cte("weekly", ("obs",), """
    SELECT station_id, "Depth_m",
           CAST(date_trunc('week', CAST("Date" AS DATE) + 6) AS DATE) AS "Date",
           avg("O2_umol_L") AS "O2_umol_L", avg("Temp_C") AS "Temp_C",
           avg("Chl_a") AS "Chl_a", avg("Salinity") AS "Salinity"
    FROM obs GROUP BY 1, 2, 3""")
_cte("series", ("obs",), """
    SELECT DISTINCT station_id, "Depth_m" FROM obs
    WHERE station_id IS NOT NULL AND "Depth_m" IS NOT NULL""")
_cte("grid", ("series", "weeks", "weekly"), """
    SELECT s.station_id, s."Depth_m", w."Date", w."Time_Idx",
           v."O2_umol_L", v."Temp_C", v."Chl_a", v."Salinity"
    FROM series s CROSS JOIN weeks w
    LEFT JOIN weekly v ON v.station_id = s.station_id AND v."Depth_m" = s."Depth_m"
                      AND v."Date" = w."Date" """)


def _filling(columns: tuple[str, ...], source: str, series: str) -> str:
    """Bounded interpolation and edge fill of columns of a complete grid."""
    ends, filled = [], []
    for c in columns:
        i = f'CASE WHEN "{c}" IS NOT NULL THEN "Time_Idx" END'
        ends.append(f'''
           last_value({i} IGNORE NULLS) OVER b AS "pi_{c}",
           last_value("{c}" IGNORE NULLS) OVER b AS "pv_{c}",
           first_value({i} IGNORE NULLS) OVER f AS "ni_{c}",
           first_value("{c}" IGNORE NULLS) OVER f AS "nv_{c}"''')
        filled.append(f'''
           CASE WHEN "{c}" IS NOT NULL THEN "{c}"
                WHEN "pv_{c}" IS NULL THEN "nv_{c}"
                WHEN "nv_{c}" IS NULL THEN "pv_{c}"
                WHEN "Time_Idx" - "pi_{c}" <= 8 THEN "pv_{c}" + ("nv_{c}" - "pv_{c}")
                     / ("ni_{c}" - "pi_{c}") * ("Time_Idx" - "pi_{c}") END AS "{c}",
           "{c}" IS NOT NULL AS "{c}_observed"''')
    return f"""
    SELECT {series}, "Date", "Time_Idx", {",".join(filled)},
           sin(2 * pi() * month("Date") / 12) AS month_sin,
           cos(2 * pi() * month("Date") / 12) AS month_cos
    FROM (SELECT *, {",".join(ends)}
          FROM {source}
          WINDOW b AS (PARTITION BY {series} ORDER BY "Time_Idx"
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 f AS (PARTITION BY {series} ORDER BY "Time_Idx"
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


SERIES = 'station_id, "Depth_m"'
OVER = f'OVER (PARTITION BY {SERIES} ORDER BY "Date")'
WITHIN = f'OVER (PARTITION BY {SERIES}, split ORDER BY "Date")'
_cte("filled", ("grid",), _filling(("O2_umol_L", "Temp_C", "Chl_a", "Salinity"), "grid", SERIES))


def _weight(c: str = '"O2_umol_L"') -> str:
    return (
        f"CASE WHEN {c} < 30 THEN 12.0::DOUBLE WHEN {c} < 60 THEN 6.0 WHEN {c} < 80 THEN 3.0 "
        f"WHEN {c} IS NOT NULL THEN 1.0 END"
    )


def _deficit(c: str = '"O2_umol_L"') -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN greatest(60.0::DOUBLE - {c}, 0.0) END"


_cte("labelled", ("filled",), f"""
    SELECT *, {_deficit()} AS oxygen_deficit, {_weight()} AS sample_weight FROM filled""")
_cte("known", ("labelled",), """
    SELECT * FROM labelled WHERE "O2_umol_L" IS NOT NULL AND "Temp_C" IS NOT NULL
      AND "Chl_a" IS NOT NULL AND "Salinity" IS NOT NULL""")
_cte("cut", ("labelled",), f"""
    SELECT *, CASE WHEN row_number() OVER (
                 ORDER BY "Date", substr(md5(concat_ws('|', CAST(station_id AS VARCHAR),
                          CAST("Depth_m" AS VARCHAR))), 1, 3), {SERIES})
               <= floor(count(*) OVER () * 0.8::DOUBLE)
             THEN 'train' ELSE 'validation' END AS split
    FROM labelled""")
_cte("runs", ("labelled",), f"""
    SELECT *, sum(CASE WHEN is_below <> before THEN 1 ELSE 0 END) {OVER} AS run
    FROM (SELECT *, coalesce(lag(is_below) {OVER}, FALSE) AS before
          FROM (SELECT *, coalesce("O2_umol_L" < 60, FALSE) AS is_below FROM labelled))""")
_cte("episodes", ("runs",), f"""
    SELECT {SERIES}, min("Date") AS start_date, max("Date") AS end_date,
           count(*) AS duration_weeks, min("O2_umol_L") AS min_o2
    FROM runs WHERE is_below GROUP BY {SERIES}, run""")
_cte("forecasts", ("cut",), f"""
    SELECT o.station_id, o."Depth_m", o.split, o.origin, h.horizon, t."Date",
           t."O2_umol_L" AS actual, o.predicted, t.sample_weight
    FROM (SELECT station_id, "Depth_m", split, "Date" AS origin,
                 last_value("O2_umol_L" IGNORE NULLS) {WITHIN} AS predicted FROM cut) o
    CROSS JOIN (VALUES (1), (2), (3), (4)) h(horizon)
    JOIN cut t ON t.station_id = o.station_id AND t."Depth_m" = o."Depth_m" AND t.split = o.split
              AND t."Date" = o.origin + 7 * h.horizon
    WHERE o.predicted IS NOT NULL AND t."O2_umol_L" IS NOT NULL""")
_cte("banded", ("forecasts", "cut"), f"""
    SELECT f.*, least(b.low, f.predicted) AS p10, f.predicted AS p50,
           greatest(b.high, f.predicted) AS p90
    FROM forecasts f
    JOIN (SELECT station_id, "Depth_m", "Date",
                 min("O2_umol_L") OVER w AS low, max("O2_umol_L") OVER w AS high
          FROM cut
          WINDOW w AS (PARTITION BY {SERIES}, split ORDER BY "Date"
                       ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) b
      ON b.station_id = f.station_id AND b."Depth_m" = f."Depth_m" AND b."Date" = f.origin""")

# Every origin and horizon, those with the origin on one side of the split and the target on the other included.
_cte("forecasts_across", ("cut",), f"""
    SELECT o.station_id, o."Depth_m", o.split, o.origin, h.horizon, t."Date",
           t."O2_umol_L" AS actual, o.predicted, t.sample_weight
    FROM (SELECT station_id, "Depth_m", split, "Date" AS origin,
                 last_value("O2_umol_L" IGNORE NULLS) {OVER} AS predicted FROM cut) o
    CROSS JOIN (VALUES (1), (2), (3), (4)) h(horizon)
    JOIN cut t ON t.station_id = o.station_id AND t."Depth_m" = o."Depth_m"
              AND t."Date" = o.origin + 7 * h.horizon
    WHERE o.predicted IS NOT NULL AND t."O2_umol_L" IS NOT NULL""")
_cte("banded_across", ("forecasts_across", "labelled"), f"""
    SELECT f.*, least(b.low, f.predicted) AS p10, f.predicted AS p50,
           greatest(b.high, f.predicted) AS p90
    FROM forecasts_across f
    JOIN (SELECT station_id, "Depth_m", "Date",
                 min("O2_umol_L") OVER w AS low, max("O2_umol_L") OVER w AS high
          FROM labelled
          WINDOW w AS (PARTITION BY {SERIES} ORDER BY "Date"
                       ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) b
      ON b.station_id = f.station_id AND b."Depth_m" = f."Depth_m" AND b."Date" = f.origin""")


def surface(source: str) -> str:
    """Target rows with the surface values of their station and day."""
    at = 'OVER (PARTITION BY station_id, "Date")'
    return f"""SELECT * FROM (SELECT *,
             max(CASE WHEN "Depth_m" = 1 THEN "Temp_C" END) {at} AS "Surface_Temp_C",
             max(CASE WHEN "Depth_m" = 1 THEN "O2_umol_L" END) {at} AS "Surface_O2_umol_L"
           FROM {source}) WHERE "Depth_m" = 4"""


# Weather by nation, its nearest day for every sample, and the table with both.
_cte("readings", (), """
    SELECT c_nationkey AS nation_id, o_orderdate AS date, o_orderpriority AS parameter,
           round(o_totalprice / 1000) AS value
    FROM orders JOIN customer ON c_custkey = o_custkey""")
_cte("wide", ("readings",), """
    SELECT nation_id, date,
           avg(value) FILTER (parameter = '1-URGENT') AS "Wind_Speed_ms",
           avg(value) FILTER (parameter = '2-HIGH') AS "Wind_Dir_deg",
           avg(value) FILTER (parameter = '3-MEDIUM') AS "Air_Temp_C"
    FROM readings GROUP BY 1, 2""")
_cte("weather", ("wide",), """
    SELECT d.nation_id, d."Date", w."Air_Temp_C", w."Wind_Speed_ms", w."Wind_Dir_deg",
           -w."Wind_Speed_ms" * sin(radians(w."Wind_Dir_deg")) AS "Wind_U",
           -w."Wind_Speed_ms" * cos(radians(w."Wind_Dir_deg")) AS "Wind_V"
    FROM (SELECT nation_id, CAST(unnest(generate_series(
                   date_trunc('day', min(date)), date_trunc('day', max(date)), INTERVAL 1 DAY))
                 AS DATE) AS "Date" FROM wide GROUP BY nation_id) d
    LEFT JOIN (SELECT nation_id, CAST(date AS DATE) AS "Date",
                      avg("Air_Temp_C") AS "Air_Temp_C", avg("Wind_Speed_ms") AS "Wind_Speed_ms",
                      avg("Wind_Dir_deg") AS "Wind_Dir_deg"
               FROM wide GROUP BY 1, 2) w
      ON w.nation_id = d.nation_id AND w."Date" = d."Date" """)
_cte("placed", ("obs",), """
    SELECT o.*, s_nationkey AS nation_id FROM obs o JOIN supplier ON s_suppkey = o.station_id""")
_cte("nearest", ("placed", "weather"), """
    SELECT * FROM (
      SELECT l.nation_id AS n, l."Date" AS at, w."Air_Temp_C", w."Wind_Speed_ms",
             w."Wind_Dir_deg", w."Wind_U", w."Wind_V",
             row_number() OVER (PARTITION BY l.nation_id, l."Date"
                 ORDER BY abs(epoch_us(l."Date") - epoch_us(CAST(w."Date" AS TIMESTAMP))),
                          w."Date") AS r
      FROM (SELECT DISTINCT nation_id, "Date" FROM placed) l
      JOIN weather w ON w.nation_id = l.nation_id
       AND abs(epoch_us(l."Date") - epoch_us(CAST(w."Date" AS TIMESTAMP))) <= 3 * 86400000000)
    WHERE r = 1""")
_cte("full_weekly", ("placed", "nearest"), """
    SELECT p.station_id, p."Depth_m",
           CAST(date_trunc('week', CAST(p."Date" AS DATE) + 6) AS DATE) AS "Date",
           avg("O2_umol_L") AS "O2_umol_L", avg("Temp_C") AS "Temp_C", avg("Chl_a") AS "Chl_a",
           avg("Salinity") AS "Salinity", avg("Air_Temp_C") AS "Air_Temp_C",
           avg("Wind_Speed_ms") AS "Wind_Speed_ms", avg("Wind_Dir_deg") AS "Wind_Dir_deg",
           avg("Wind_U") AS "Wind_U", avg("Wind_V") AS "Wind_V"
    FROM placed p LEFT JOIN nearest n ON n.n = p.nation_id AND n.at = p."Date"
    WHERE p."Depth_m" IN (1, 4) GROUP BY 1, 2, 3""")
_FULL = ("O2_umol_L", "Temp_C", "Chl_a", "Salinity", "Air_Temp_C", "Wind_Speed_ms",
         "Wind_Dir_deg", "Wind_U", "Wind_V")
_cte("full_grid", ("series", "weeks", "full_weekly"), f"""
    SELECT s.station_id, s."Depth_m", w."Date", w."Time_Idx",
           {", ".join(f'v."{c}"' for c in _FULL)}
    FROM series s CROSS JOIN weeks w
    LEFT JOIN full_weekly v ON v.station_id = s.station_id AND v."Depth_m" = s."Depth_m"
                           AND v."Date" = w."Date"
    WHERE s."Depth_m" IN (1, 4)""")
_cte("full_filled", ("full_grid",), _filling(_FULL, "full_grid", SERIES))
_cte("featured", ("full_filled",), f"""
    SELECT *, "Surface_Temp_C" - "Temp_C" AS "Vertical_Temp_Grad",
           "Surface_O2_umol_L" - "O2_umol_L" AS "Vertical_O2_Grad",
           "O2_umol_L" - lag("O2_umol_L") {OVER} AS "O2_Derivative_1W",
           power("Wind_Speed_ms", 2) AS "Wind_Mixing_Energy",
           lag("Chl_a", 1) {OVER} AS "Chl_a_lag_1W", lag("Chl_a", 2) {OVER} AS "Chl_a_lag_2W",
           lag("Chl_a", 3) {OVER} AS "Chl_a_lag_3W", lag("Chl_a", 4) {OVER} AS "Chl_a_lag_4W",
           {_deficit()} AS oxygen_deficit, {_weight()} AS sample_weight
    FROM ({surface("full_filled")})""")


def sql(select: str, *needs: str) -> str:
    """The select statement, preceded by the expressions it needs in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in CTES[name][0]:
                visit(other)
            order.append(name)

    for need in needs:
        visit(need)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
    return (f"WITH {parts}\n" if parts else "") + select


def rounded(*columns: str) -> str:
    return ", ".join(f'round("{c}", 6) AS "{c}"' for c in columns)


def named(*columns: str) -> str:
    return ", ".join(f'"{c}"' for c in columns)
