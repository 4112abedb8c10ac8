import pytest

from zonarium.operators.statistics import Units, zonal_statistics
from zonarium.streaming.statistics import running_statistics, windowed_weights

SCHEMA = "zone_id int, band_name string, value long, coverage long, weight long, at timestamp"


def test_running_equals_table(spark, tmp_path):
    rows = [(i % 3, "b", i * 7 % 11, i % 5, 1 + i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "zone_id int, band_name string, value long, coverage long, weight long").selectExpr("*", "timestamp_seconds(zone_id * 100) as at")
    for i in range(3):
        df.where(f"value % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    units = Units(0.5, 0.25, 1.0, 4)
    names = ["mean", "var", "boundaryWeight"]
    q = running_statistics(stream, names, units=units).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    got = {r.zone_id: (r["mean"], r["var"], r["boundaryWeight"]) for r in spark.table("running").collect()}
    want = {r.zone_id: (r["b_mean"], r["b_var"], r["b_boundaryWeight"]) for r in zonal_statistics(df, names, bands=["b"], units=units).collect()}
    assert got == want
    with pytest.raises(ValueError):
        running_statistics(stream, ["median"])
    whole = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = windowed_weights(whole, "at", "60 seconds", "1 second").writeStream.outputMode("append").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    done = spark.table("windows").collect()
    assert {r.zone_id: r.weight for r in done}[0] == sum(c * w for z, _, _, c, w in rows if z == 0)
