import duckdb
from pyspark.sql import functions as F

from blockweave.sources.partition_store import box_key


def test_halves_are_those_of_the_double(spark):
    """Ends near a half of the last decimal, on both sides of zero, against DuckDB's rounding."""
    x = [s * (k / 65536 + off) for k in range(0, 65536 * 60, 64) for off in (0.01, -0.01) for s in (1, -1)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    c = F.col("x")
    got = {r["x"]: r["key"] for r in df.select("x", box_key(c, c, c, c).alias("key")).collect()}
    con = duckdb.connect()
    rows = con.execute("select x, printf('%.5f_%.5f_%.5f_%.5f', round(x, 5), round(x, 5), round(x, 5), round(x, 5)) from (select unnest(?::double[]) as x)", [x]).fetchall()
    assert got == dict(rows)
