from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tailseries import config as C
from tailseries.operators import harmonize
from tailseries.plans.prepare import load_ocean
from tailseries.sources import delimited, published, records, tables


def text_file(path, profile, records, *, preamble=(), extra=("Vessel", "Remark")):
    """A file as a profile expects it: any lines, a header with some more fields, and one line per record."""
    fields = [f for f in profile.columns if f != "Date/Time"]
    order = ["Date/Time", extra[0], *reversed(fields), *extra[1:]]
    lines = [*preamble, profile.sep.join(order)]
    for r in records:
        texts = {f: r.get(c, "") for f, c in profile.columns.items()}
        lines.append(profile.sep.join(str(texts.get(f, r.get(f, ""))) for f in order))
    path.write_text("\n".join(lines) + "\n")
    return str(path)


CAST = datetime(2003, 5, 20, 8, 15)


@pytest.fixture
def per_kg(tmp_path):
    """One cast over four depths; the deepest sample has only texts where numbers belong."""
    records = [
        {"Date": "2003-05-20T08:15", "Depth_m": d, "Temp_C": 14.5 - d / 4, "Salinity": 18 + d / 10, "O2_umol_L": 400 - 8 * d}
        for d in (2, 6, 12)
    ]
    records[1] |= {"Chl_a": 3.25, "Remark": '"calm; clear"'}
    records.append({"Date": "2003-05-20T08:15", "Depth_m": 20, "O2_umol_L": "lost", "NO3": "<0.3", "PO4": "nan"})
    noise = ["/* header", "2003", "08:15:00", "2003-05", "2003-02-30 10:00", "Comment:;2003-05-20 spring"]
    return text_file(tmp_path / "kg.txt", C.OCEAN_PER_KG, records, preamble=noise)


@pytest.fixture
def per_litre(tmp_path):
    records = [
        {"Date": f"2018-09-0{day}T1{day}:30:45", "Depth_m": d, "O2_umol_L": 90.5 * day + d, "Silicate": day / 8}
        for day in (1, 2)
        for d in (2, 20)
    ]
    return text_file(tmp_path / "litre.txt", C.OCEAN_PER_LITRE, records, preamble=["x"] * 3, extra=("QC", "QC2"))


def test_density_is_applied_per_kilogram_and_texts_become_unknown(spark, per_kg):
    rows = delimited.read_delimited(spark, per_kg, C.OCEAN_PER_KG).orderBy("Depth_m").collect()
    assert [(r.Date, r.Depth_m) for r in rows] == [(CAST, d) for d in (2.0, 6.0, 12.0, 20.0)]
    assert [r.O2_umol_L for r in rows[:3]] == pytest.approx([389.76, 357.28, 308.56])
    assert [r.Temp_C for r in rows] == [14.0, 13.0, 11.5, None]
    # A quoted separator stays inside its field.
    assert [r.Chl_a for r in rows] == [None, 3.25, None, None]
    assert (rows[3].O2_umol_L, rows[3].NO3, rows[3].PO4) == (None, None, None)
    assert set(rows[0].asDict()) == set(C.OCEAN_PER_KG.columns.values())


def test_second_profile_has_its_own_columns_and_no_factor(spark, per_litre):
    rows = delimited.read_delimited(spark, per_litre, C.OCEAN_PER_LITRE).orderBy("Date", "Depth_m").collect()
    assert [r.O2_umol_L for r in rows] == [92.5, 110.5, 183.0, 201.0]
    assert rows[2].Date == datetime(2018, 9, 2, 12, 30, 45) and rows[2].Silicate == 0.25
    assert "Chl_a" not in rows[0].asDict()


def test_both_sources_and_the_supplement_make_one_table(spark, per_kg, per_litre, tmp_path):
    supplement = [
        {"Date": "2003-05-20T08:15", "Depth_m": 2, "Chl_a_supplement": 1.75},
        {"Date": "2003-05-20T08:15", "Depth_m": 6, "Chl_a_supplement": 99},
        {"Date": "2003-05-20T08:16", "Depth_m": 12, "Chl_a_supplement": 5},
        {"Date": "2018-09-02T12:30:45", "Depth_m": 20, "Chl_a_supplement": 0.5},
        {"Date": "2018-09-02T12:30:45", "Depth_m": 20, "Chl_a_supplement": 0.75},
        {"Date": "2018-09-02T12:30:45", "Chl_a_supplement": 42},
    ]
    tab = text_file(tmp_path / "s.tab", C.CHLOROPHYLL, supplement, preamble=["Notes", "\t2003-05-20"])
    df = load_ocean(spark, per_kg=per_kg, per_litre=per_litre, chlorophyll=tab, station="p7")
    got = sorted((r.Date.year, r.Date.day, r.Depth_m, r.Chl_a) for r in df.collect() if r.Chl_a is not None)
    # Own values win, times must be equal, and a key given twice counts twice.
    assert got == [(2003, 20, 2.0, 1.75), (2003, 20, 6.0, 3.25), (2018, 2, 20.0, 0.5), (2018, 2, 20.0, 0.75)]
    assert df.count() == 9 and {r.station_id for r in df.collect()} == {"p7"}


def test_headers_must_agree(spark, tmp_path):
    text_file(tmp_path / "a.tab", C.CHLOROPHYLL, [])
    text_file(tmp_path / "b.tab", C.CHLOROPHYLL, [], extra=("Vessel", "Remark", "Sampler"))
    with pytest.raises(ValueError, match="disagree"):
        delimited.read_delimited(spark, str(tmp_path), C.CHLOROPHYLL)
    with pytest.raises(ValueError, match="no header"):
        delimited.read_delimited(spark, str(tmp_path / "a.tab"), C.OCEAN_PER_KG)


def test_lines_that_are_no_records_are_rejected_and_none_is_invented(spark):
    lines = [
        "2021", "2021-03", "2021-03-04", "12:30:00\ta note", "Citation:\t2021-01-01",
        "\t".join(["Date/Time", "a", "b", "Depth water [m]", "c", "d", "Chl a [µg/l]"]),
        "2019-02-03T04:05:06\t1\t2\t10\t1\tx\t0.5",
        "2019-02-04\t1\t2\t\t1\tx\t<1",
        "12:30:00\t1\t2\t10\t1\tx\t0.5",
        "2019-13-44T00:00\t1\t2\t10\t1\tx\t0.5",
        "04.02.2019\t1\t2\t10\t1\tx\t0.5",
        "2019-02-05\t1\t2\t10",
        "2019-02-06\t1\t2\t10\t1\tx\t0.5\tmore",
    ]
    table = spark.createDataFrame([(x, "s") for x in lines], "value STRING, station_id STRING")
    kept = delimited.parse_lines(table, C.CHLOROPHYLL, keep=["station_id"]).orderBy("Date").collect()
    assert [(r.Date, r.Depth_m, r.Chl_a_supplement) for r in kept] == [
        (datetime(2019, 2, 3, 4, 5, 6), 10.0, 0.5),
        (datetime(2019, 2, 4), None, None),
    ]
    gone = {r.value: r.reason for r in delimited.rejected_lines(table, C.CHLOROPHYLL).collect()}
    assert gone == {x: "bad_time" for x in lines[8:11]} | {x: "field_count" for x in lines[11:]}


def fill(left, right, **options):
    return harmonize.fill_missing(
        left, right, keys=["k"], column="v", supplement_column="s", **options
    )


def test_fill_join_matches_missing_keys_and_keeps_copies(spark):
    left = spark.createDataFrame([("a", None), (None, None), ("c", 5.0)], "k STRING, v DOUBLE")
    right = spark.createDataFrame(
        [("a", 1.0), ("a", 3.0), (None, 7.0), ("c", 9.0)], "k STRING, s DOUBLE"
    )
    rows = sorted(fill(left, right).collect(), key=str)
    assert sorted((r.k or "", r.v) for r in rows) == [("", 7.0), ("a", 1.0), ("a", 3.0), ("c", 5.0)]
    once = fill(left, right, one_per_key=True).collect()
    assert sorted((r.k or "", r.v) for r in once) == [("", 7.0), ("a", 2.0), ("c", 5.0)]


def test_fill_join_spreads_a_key_that_has_most_rows(spark, monkeypatch):
    left = spark.range(300_000).select(
        F.when(F.col("id") % 3 > 0, F.lit(None)).otherwise(F.col("id") % 7).cast("string").alias("k"),
        F.when(F.col("id") % 5 == 0, F.col("id").cast("double")).alias("v"),
        "id",
    )
    right = spark.createDataFrame([(None, -1.0), ("0", -2.0), ("3", -3.0)], "k STRING, s DOUBLE")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = fill(left, right)
        total = got.agg(F.count("v"), F.sum("v"), F.count(F.lit(1))).first()
        parts = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = [(i, None if i % 3 else str(i % 7), float(i) if i % 5 == 0 else None) for i in range(300_000)]
    filled = [v if v is not None else {None: -1.0, "0": -2.0, "3": -3.0}.get(k) for _, k, v in rows]
    known = [v for v in filled if v is not None]
    assert tuple(total) == (len(known), sum(known), 300_000)
    # Two thirds of all rows have no key; in one task they would be 200 000.
    assert max(parts) < 150_000


def test_union_keeps_missing_columns_as_null(spark):
    both = harmonize.union_sources(
        spark.createDataFrame([(1, 2.0)], "a INT, b DOUBLE"),
        spark.createDataFrame([(3,)], "a INT"),
    )
    assert sorted((r.a, r.b) for r in both.collect()) == [(1, 2.0), (3, None)]


def test_coercion_before_unit_factor(spark):
    df = spark.createDataFrame([("2",), ("x",), ("NaN",)], "o STRING")
    assert [r.o for r in harmonize.convert_units(df, {"o": 1.5}).collect()] == [3.0, None, None]


def test_feature_lists(spark):
    df = spark.createDataFrame(
        [], "station_id STRING, Date DATE, Depth_m DOUBLE, Time_Idx INT, O2_umol_L DOUBLE, "
        "Temp_C DOUBLE, month_sin DOUBLE, sample_weight DOUBLE"
    )
    assert harmonize.feature_columns(df) == ["Temp_C"]
    made = df.withColumns({c: F.lit(0.0) for c in C.TARGET_DERIVED})
    assert harmonize.feature_columns(made) == ["Temp_C", *C.TARGET_DERIVED]
    assert harmonize.feature_columns(made, target_feedback=False) == ["Temp_C"]
    assert harmonize.present(df, ["NO3", "Temp_C"]) == ["Temp_C"]


def daily(spark, *rows):
    """Rows of station, day of January and wind speed."""
    table = spark.createDataFrame([(s, f"2020-01-{d:02d}", float(v)) for s, d, v in rows], "s STRING, d STRING, v DOUBLE")
    return table.selectExpr(
        "s AS station_id", "DATE(d) AS Date", "1D AS Air_Temp_C", "v AS Wind_Speed_ms",
        "3D AS Wind_Dir_deg", "4D AS Wind_U", "CAST(NULL AS DOUBLE) AS Wind_V",
    )


def speeds(table):
    return sorted(((r.station_id or "-", r.Date.day, r.Wind_Speed_ms) for r in table.collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_daily_table_of_one_station_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "daily")
    assert speeds(tables.read_weather_daily(spark, path)) == []
    tables.write_weather_daily(daily(spark, ("north", 1, 5), ("north", 2, 6), ("1", 1, 7), (None, 3, 8)), path)
    tables.write_weather_daily(daily(spark, ("north", 9, 1)), path)
    assert speeds(tables.read_weather_daily(spark, path)) == [("-", 3, 8.0), ("1", 1, 7.0), ("north", 9, 1.0)]
    back = tables.read_weather_daily(spark, path, stations=["north"])
    assert [(r.station_id, r.Wind_U, r.Wind_V) for r in back.collect()] == [("north", 4.0, None)]
    assert "station_id" in plan_of(back).split("PartitionFilters: [")[1].split("]")[0]
    some = spark.createDataFrame([("1",), ("1",), ("x",)], "station_id STRING")
    assert speeds(tables.read_weather_daily(spark, path, stations=some)) == [("1", 1, 7.0)]
    assert tables.remove_older_weather(spark, path) == []
    tables.write_weather_daily(daily(spark, ("1", 2, 2), (None, 4, 4)), path)
    assert len(tables.remove_older_weather(spark, path)) == 1
    assert speeds(tables.read_weather_daily(spark, path)) == [("-", 4, 4.0), ("1", 2, 2.0), ("north", 9, 1.0)]


def test_a_run_that_dies_before_publishing_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "daily")
    tables.write_weather_daily(daily(spark, ("a", 1, 5)), path)

    def dies(*_, **__):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(published, "publish", dies)
        with pytest.raises(RuntimeError):
            tables.write_weather_daily(daily(spark, ("a", 1, 6), ("b", 1, 6)), path)
    assert speeds(tables.read_weather_daily(spark, path)) == [("a", 1, 5.0)]
    # Newer than all that is published, it could belong to a run under way.
    assert tables.remove_older_weather(spark, path) == []
    tables.write_weather_daily(daily(spark, ("a", 1, 7)), path)
    assert len(tables.remove_older_weather(spark, path)) == 2
    assert speeds(tables.read_weather_daily(spark, path)) == [("a", 1, 7.0)]


def test_versions_in_force_follow_the_log(spark, tmp_path):
    path = str(tmp_path / "log")
    slots = spark.createDataFrame([("x",), ("y",)], "slot STRING")
    assert published.in_force(spark, path).collect() == []
    published.publish(slots, path, "v1", score=2.0)
    published.publish(slots.where("slot = 'y'"), path, "v2")
    got = {r.slot: (r.version, r.score) for r in published.in_force(spark, path).collect()}
    assert got == {"x": ("v1", 2.0), "y": ("v2", None)}
    assert published.new_version() < published.new_version()


def test_landed_weather_replaces_its_years_and_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "hourly")
    schema = "station_id STRING, date TIMESTAMP, parameter STRING, value DOUBLE"

    def landed(*rows):
        return spark.createDataFrame([(s, datetime(y, 3, 4, h), "wind_speed", float(v)) for s, y, h, v in rows], schema)

    tables.write_weather_long(landed(("a", 2001, 1, 1), ("a", 2002, 2, 2), ("b", 2001, 3, 3), ("b", 2001, 4, 4)), path)
    tables.write_weather_long(landed(("b", 2001, 9, 9)), path)

    def read(**options):
        table = tables.read_weather_long(spark, path, **options)
        assert table.schema.fieldNames() == ["station_id", "date", "parameter", "value"]
        return sorted((r.station_id, r.date.year, r.value) for r in table.collect())

    assert read() == [("a", 2001, 1.0), ("a", 2002, 2.0), ("b", 2001, 9.0)]
    assert read(stations=["a"], years=(2002, 2009)) == [("a", 2002, 2.0)]
    places = spark.createDataFrame([("a", "coast"), ("b", "inland")], "station_id STRING, kind STRING")
    coast = places.where("kind = 'coast'")
    assert read(stations=coast) == [("a", 2001, 1.0), ("a", 2002, 2.0)]
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = plan_of(tables.read_weather_long(spark, path, stations=coast, years=(2001, 2001)))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "year" in filters and "dynamicpruning" in filters


def test_leaderboard_round_trip_applies_every_tuned_field(spark, tmp_path):
    board = records.leaderboard(
        spark,
        [
            (0, "complete", 2.0, 9, {"encoder_length": 8.0}, None),
            (1, "complete", 1.0, 9, {"encoder_length": 12.0, "reg_param": 0.5}, None),
            (2, "failed", None, 0, {"encoder_length": 4.0}, "ValueError: no rows"),
            (3, "pruned", 0.5, 3, {"encoder_length": 6.0}, None),
        ],
    )
    path = str(tmp_path / "board")
    records.write_leaderboard(board, path)
    best = records.best_configuration(
        records.read_leaderboard(spark, path),
        {"encoder_length": 8.0, "reg_param": 0.1, "decoder_length": 4.0},
        {"decoder_length": 2.0},
    )
    assert best == {"encoder_length": 12.0, "reg_param": 0.5, "decoder_length": 2.0}


def test_scratch_folder_is_the_shared_one(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert tables.scratch_path(spark, "x").startswith(base)
    staged = tables.staged(spark.range(3).withColumn("v", F.col("id") * 2), "x")
    assert staged.count() == 3
