import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphist.functions import vectors
from glyphist.functions.paths import base_name, metadata_name
from glyphist.functions.text import first_tag, fixed_decimals, libsvm_line


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_base_name(spark):
    paths = ["d/x.jpg", "x", "a/b.c/d", "a/b.tar.gz", r"c:\img\y.png", "a/.hidden", "dir/", ""]
    want = ["x", "x", "d", "b.tar", "y", "", "", ""]
    assert values(spark, [(p,) for p in paths], "p string", base_name("p")) == want


def test_metadata_name_replaces_every_lower_case_extension(spark):
    paths = ["d/x.jpg", "d/x.JPG", "d/x.png", "d/a.jpg.jpg"]
    want = ["d/x.json", "d/x.JPG", "d/x.png", "d/a.json.json"]
    assert values(spark, [(p,) for p in paths], "p string", metadata_name("p")) == want


def test_first_tag_edges(spark):
    rows = [('{"tags":["a","b"]}',), ('{"tags":[]}',), ("{}",), ('{"tags":"x"}',), ("bad",), (None,)]
    assert values(spark, rows, "j string", first_tag("j")) == ["a", None, None, None, None, None]


def test_decimals_round_half_even_without_separators(spark):
    rows = [(0.125,), (0.375,), (1234.5,), (0.0,)]
    assert values(spark, rows, "v double", fixed_decimals(F.col("v"), 2)) == ["0.12", "0.38", "1234.50", "0.00"]


def test_libsvm_line(spark):
    rows = [(3.0, [0.0, 0.5, 0.123456])]
    line = values(spark, rows, "label double, f array<double>", libsvm_line(F.col("label"), F.col("f")))
    assert line == ["3.0 1:0.00000 2:0.50000 3:0.12346 "]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 40), st.integers(1, 30), st.sampled_from([0, 1, 3]))
def test_nearest_equals_direct_sum(seed, k, dim, grid):
    """On a coarse grid most points have several equally near words."""
    rng = np.random.default_rng(seed)
    if grid:
        points, words = rng.integers(0, grid + 1, (50, dim)) * 0.1, rng.integers(0, grid + 1, (k, dim)) * 0.1
    else:
        points, words = rng.normal(size=(50, dim)), rng.normal(size=(k, dim))
    direct = vectors.squared_distances(points, words)
    word, distance = vectors.nearest(points, words)
    assert np.array_equal(word, direct.argmin(axis=1))
    assert np.array_equal(distance, direct.min(axis=1))


def test_nearest_far_from_origin():
    """Large offsets leave the matrix product few digits; the answer stays exact."""
    rng = np.random.default_rng(3)
    points, words = 1e8 + rng.random((200, 5)), 1e8 + rng.random((30, 5))
    word, _ = vectors.nearest(points, words)
    assert np.array_equal(word, vectors.squared_distances(points, words).argmin(axis=1))


def test_few_rows_need_double_precision(monkeypatch):
    rng = np.random.default_rng(5)
    points, words = rng.random((20_000, 4)), rng.random((100, 4))
    double, seen = vectors._nearest_block, []
    monkeypatch.setattr(vectors, "_nearest_block", lambda p, *more: (seen.append(len(p)), double(p, *more))[1])
    word, _ = vectors.nearest(points, words)
    assert sum(seen) < 200
    assert np.array_equal(word, vectors.squared_distances(points, words).argmin(axis=1))


@pytest.mark.parametrize("scale", [1e-200, 1e-40, 1e-25, 1e-19, 1e18, 1e25, 1e100])
def test_nearest_beyond_single_precision(scale):
    rng = np.random.default_rng(6)
    words = rng.normal(size=(40, 3)) * scale * rng.choice([1, 1e-20, 1e20], size=(40, 1))
    points = np.vstack([rng.normal(size=(300, 3)) * scale, words, (words + words[::-1]) / 2])
    direct = vectors.squared_distances(points, words)
    word, distance = vectors.nearest(points, words)
    assert np.array_equal(word, direct.argmin(axis=1)) and np.array_equal(distance, direct.min(axis=1))


def test_margins_match_product():
    rng = np.random.default_rng(4)
    points, weights = rng.normal(size=(20, 7)), rng.normal(size=(3, 7))
    assert np.allclose(vectors.margins(points, weights), points @ weights.T)


@pytest.mark.parametrize("column", [[[1.0, 2.0], [3.0]], [[1.0, 2.0], None], [[1.0], [1.0, 2.0, 3.0]]])
def test_unequal_vectors_are_refused(column):
    with pytest.raises(ValueError, match="2 values"):
        vectors.batch_matrix(pa.array(column, pa.list_(pa.float64())), 2)


@pytest.mark.parametrize("column", [[[1.0, None], [3.0, 4.0]], [[1.0, float("nan")]], [[float("inf"), 0.0]]])
def test_missing_and_infinite_numbers_are_refused(column):
    with pytest.raises(ValueError, match="1 feature vectors"):
        vectors.batch_matrix(pa.array(column, pa.list_(pa.float64())), 2)


def test_dense_vector_and_double(spark):
    df = spark.createDataFrame([([1.5, 2.0],)], "f array<float>").select(
        vectors.dense_vector("f").alias("v"), vectors.to_double("f").alias("d")
    )
    row = df.first()
    assert row.v.toArray().tolist() == [1.5, 2.0] and row.d == [1.5, 2.0]
