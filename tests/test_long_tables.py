import time

from pyspark.sql import functions as F

from docweft.operators import tables


def test_a_long_table_is_serialised_in_one_pass(spark):
    n = 3000
    row = F.array(F.concat(F.lit(" Lamp "), F.col("id").cast("string")), F.col("id").cast("string"), F.lit(""), F.lit("brass"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("id", row.alias("r")))), lambda s: s["r"])
    t = spark.range(n).agg(F.concat(F.array(F.array(*map(F.lit, ["Name", "Size", "Note", "Type"]))), body).alias("rows"))
    began = time.perf_counter()
    text = t.select(tables.serialise(F.col("rows")).alias("t")).first().t
    assert text == "\n".join(f"Lamp {i} | Size: {i} | Type: brass" for i in range(n))
    assert time.perf_counter() - began < 20  # with headers made again for each row it took minutes
