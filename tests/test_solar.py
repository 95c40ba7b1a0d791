"""The precise sun against published worked examples."""

import pytest
from pyspark.sql import functions as F

from sungrid.functions import solar


def test_published_positions(spark):
    rows = [("2003-10-17 19:30:30", 39.742476, -105.1786), ("1992-10-12 23:59:00.8", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "t string, lat double, lon double").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = {r.lat: r for r in solar.with_precise_sun(df, delta_t=67.0).collect()}
    # Reda and Andreas (2003): elevation 39.872046 before refraction, azimuth 194.340241.
    assert 90 - got[39.742476].zenith_deg == pytest.approx(39.872046, abs=0.002)
    assert got[39.742476].azimuth_deg == pytest.approx(194.340241, abs=0.002)
    # Meeus (1998), example 25.b, for 0h of uniform time: longitude 199.90606, declination -7.783872.
    day = spark.createDataFrame([("1992-10-13 00:00:00", 0.0, 0.0)], df.drop("ts").schema).withColumn("ts", F.col("t").cast("timestamp_ntz"))
    meeus = solar.with_precise_sun(day, delta_t=0.0).first()
    assert meeus.sun_longitude_deg == pytest.approx(199.90606, abs=0.001) and meeus.declination_deg == pytest.approx(-7.783872, abs=0.001)


def test_cheap_form_is_near_the_precise_one(spark):
    df = spark.range(0, 366).select(F.timestamp_seconds(1704067200 + F.col("id") * 86400 + F.col("id") * 997 % 86400).cast("timestamp_ntz").alias("ts"), (F.col("id") % 120 - 60.0).alias("lat"), (F.col("id") % 300 - 150.0).alias("lon"))
    both = solar.with_precise_sun(df).withColumnsRenamed({"zenith_deg": "z", "azimuth_deg": "a"})
    gap = solar.with_sun(both).agg(F.max(F.abs(F.col("zenith_deg") - F.col("z")))).first()[0]
    assert 0.01 < gap < 0.6
