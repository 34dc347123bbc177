"""Vectors and batch scoring (VEC)."""


from helixframe.operators import vectors as V


def test_l2_zero_vector_unchanged(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [r[0] for r in df.select(V.l2_normalize("v")).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]


def test_readout_and_first_position(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "p array<array<double>>")
    r = df.select(V.readout("p", "mean").alias("m"), V.readout("p", "sum").alias("s"),
                  V.first_position("p").alias("f")).first()
    assert r.m == [2.0, 3.0] and r.s == [4.0, 6.0] and r.f == [1.0, 2.0]
    import pytest
    with pytest.raises(ValueError):
        V.readout("p", "max")


def test_score_batches_keeps_all_rows(spark):
    n = 103  # not a multiple of the batch size
    df = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(n)], "id long, x array<float>, label int")
    s = V.score_batches(df, V.linear_loader([1.0, -1.0]), "x", ["id", "label"], ["score"], batch_size=8)
    rows = s.collect()
    assert len(rows) == n and all(r.score == r.id - 1.0 for r in rows)


def test_group_mean(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0]), (1, [5.0, 6.0])], "g int, v array<float>")
    got = {r.g: r.mean for r in V.group_mean(df, "v", ["g"]).collect()}
    assert got == {0: [2.0, 3.0], 1: [5.0, 6.0]}


def test_pca_shape(spark):
    df = spark.createDataFrame([(i, [float(i), float(2 * i), float(i % 3)]) for i in range(20)], "id long, v array<float>")
    out = V.project_2d(df, "v", ["id"])
    assert out.columns == ["id", "pc1", "pc2"] and out.count() == 20
