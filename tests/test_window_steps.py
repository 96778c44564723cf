import re

from pyspark.sql import functions as F

from driver_queries.catalog import QUERIES
from tailseries.operators import windows


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_steps_are_looked_up_without_rebuilding_the_arrays(spark, o2_series):
    df = o2_series([10.0, None, 30.0, 40.0, 50.0]).where("O2_umol_L IS NOT NULL").withColumn("sample_weight", F.lit(2.0))
    held = windows.encoder_decoder_windows(df, encoder_length=3, decoder_length=2, min_encoder=1, min_decoder=0)
    steps = windows.window_steps(held, covariates=["Salinity"])
    assert "lambdafunction" not in _plan(steps)
    rows = sorted((r["origin"], r["offset"], r["O2_umol_L"], r["sample_weight"], r["Salinity"]) for r in steps.collect())
    values = {0: 10.0, 2: 30.0, 3: 40.0, 4: 50.0}
    assert rows == [
        (i, j - i, v, 2.0 if j > i else None, None) for i in values for j, v in values.items() if -2 <= j - i <= 2
    ]


def test_window_query_gathers_only_what_its_steps_show(spark, tmp_path):
    spark.range(400).selectExpr(
        "id % 4 AS l_suppkey", "CAST(4 AS INT) AS l_linenumber",
        "CAST(date_add(DATE '2020-01-06', CAST(id AS INT)) AS TIMESTAMP) AS l_shipdate",
        "CAST(id % 50 AS DOUBLE) AS l_quantity", "CAST(id AS DOUBLE) AS l_extendedprice", "0.01D AS l_discount", "0.02D AS l_tax",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    steps = QUERIES["enc_dec_windows"](spark, str(tmp_path))
    structs = re.findall(r"struct\(Time_Idx, Time_Idx#\d+(.*?)\)", _plan(steps))
    assert steps.count() > 0 and len(structs) >= 2
    assert not any(c in text for text in structs for c in ("Temp_C", "Salinity", "Chl_a", "month_sin"))


def test_covariates_are_rounded_once_per_week_and_not_per_step(spark, tmp_path):
    spark.range(300).selectExpr(
        "id % 3 AS l_suppkey", "CAST(4 AS INT) AS l_linenumber",
        "CAST(date_add(DATE '2020-01-06', CAST(id AS INT)) AS TIMESTAMP) AS l_shipdate",
        "CAST(id % 50 AS DOUBLE) AS l_quantity", "CAST(id * 10 AS DOUBLE) AS l_extendedprice",
        "id % 11 / 100 AS l_discount", "id % 9 / 100 AS l_tax",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    steps = QUERIES["window_covariates"](spark, str(tmp_path))
    after, _, before = _plan(steps).partition("collect_list")
    assert "round(" in before and "round(" not in after
    covariates = ["Temp_C", "Salinity", "Chl_a", "month_sin", "month_cos"]
    rows = steps.select(*covariates).collect()
    assert len(rows) > 0 and {r.Temp_C is None for r in rows} == {True, False}
    assert all(v is None or v == round(v, 6) for r in rows for v in r)
