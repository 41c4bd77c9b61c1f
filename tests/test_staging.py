from corpusloom.staging import grid_join


def test_hot_keys_on_either_side(spark):
    left = spark.createDataFrame([(k % 3 if k % 2 else 7, k) for k in range(90)] + [(None, 1)] * 30, "key int, a int")
    right = spark.createDataFrame([(k % 5 if k % 3 else 7, k) for k in range(120)] + [(7, 3), (7, 3), (None, 1)], "key int, b int")
    want = sorted(map(tuple, left.join(right, "key").collect()))
    for size in (1, 7, 1000):
        for keys in (1, 50):
            assert sorted(map(tuple, grid_join(left, right, "key", size, keys).collect())) == want
    assert grid_join(left.limit(0), right, "key", 2).count() == 0
    one = right.groupBy("key").agg({"b": "max"}).toDF("key", "b")
    want = sorted(map(tuple, left.join(one, "key").collect()))
    assert sorted(map(tuple, grid_join(left, one, "key", 3, unique=True).collect())) == want
