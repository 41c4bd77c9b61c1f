import pytest
from corpusloom.plans import evaluation


def put(spark, folder, vectors, keys):
    spark.createDataFrame([(i, [float(i + d // 16) for d in range(64)]) for i in vectors], "vec_id bigint, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(k, k) for k in keys], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_indices_span_all_vectors(spark, tmp_path):
    sf = put(spark, tmp_path, range(700), range(0, 1400, 7))
    got = {r["o_orderkey"]: (r["vec_id"], r["first"]) for r in evaluation.indexed_vector_fetch(spark, sf).collect()}
    assert got == {k: (k % 700, float(k % 700)) for k in range(0, 1400, 7)}


def test_missing_vector_is_an_error(spark, tmp_path):
    sf = put(spark, tmp_path, [0, 2], [1, 2])
    with pytest.raises(Exception, match="no vector 1"):
        evaluation.indexed_vector_fetch(spark, sf).collect()


def test_all_four_parts(spark, tmp_path):
    sf = put(spark, tmp_path, [5], [])
    assert [r.asDict() for r in evaluation.segment_pooling(spark, sf).collect()] == [{"vec_id": 5, "part_0": 5.0, "part_1": 6.0, "part_2": 7.0, "part_3": 8.0}]
