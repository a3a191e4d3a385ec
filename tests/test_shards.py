from tickloom.operators.shards import fits, lookup_join


def test_salted_lookup_equals_broadcast(spark):
    big = spark.createDataFrame([("hot", i) for i in range(50)] + [("x", 50), (None, 51)], "k string, i int")
    small = spark.createDataFrame([("hot", 1), ("y", 2)], "k string, v int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        a, b = (sorted(map(str, lookup_join(big, small, "k", how, max_rows=n).collect())) for n in (100, 0))
        assert a == b


def test_lookups_are_measured_in_rows_and_bytes(spark):
    small = spark.createDataFrame([("a", 1, [1, 2]), (None, 2, None)], "k string, v int, x array<int>")
    assert fits(small) and not fits(small, max_rows=1) and not fits(small, max_bytes=50)
    wide = spark.createDataFrame([("a" * 5_000, 1)], "k string, v int")
    assert fits(wide, max_bytes=6_000) and not fits(wide, max_bytes=4_000)
    assert fits(small.limit(0))
