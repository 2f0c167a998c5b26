"""The .npy source and the bytes it reads, against numpy."""

import numpy as np
import pytest
from lodestar.sources import npy


def saved(tmp_path, array):
    np.save(tmp_path / "a.npy", array)
    return str(tmp_path / "a.npy")


def rows(df):
    return [list(r["values"]) for r in df.orderBy("row").collect()]


@pytest.mark.parametrize("array", [np.arange(6.0).reshape(2, 3), np.asfortranarray(np.arange(6, dtype="<f4").reshape(2, 3)), np.arange(4, dtype=np.uint8), np.zeros((0, 3))])
def test_numbers_as_doubles(spark, tmp_path, array):
    assert rows(npy.read_npy(spark, saved(tmp_path, array))) == [np.atleast_1d(x).astype(float).tolist() for x in array]


@pytest.mark.parametrize("array", [np.array([[2**53 + 1, -5], [-(2**63), 2**63 - 1]]), np.array([True, False]), np.array([7, 200], np.uint8)])
def test_whole_numbers_are_exact(spark, tmp_path, array):
    assert rows(npy.read_npy(spark, saved(tmp_path, array), array.dtype.str)) == [np.atleast_1d(x).astype(int).tolist() for x in array]


@pytest.mark.parametrize("array, dtype", [(np.array([2**53 + 1]), None), (np.array([2**63], np.uint64), "<u8"), (np.array([1.0]), "<i8"), (np.array(["a"]), None)])
def test_what_cannot_be_held_fails(spark, tmp_path, array, dtype):
    with pytest.raises(Exception, match="cannot hold|not <i8|not supported"):
        npy.read_npy(spark, saved(tmp_path, array), dtype).collect()


def test_written_rows_read_back(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, [3.0, 4.0]), ("b", 0, [1.0, 2.0]), ("c", 0, [5.0, 6.0])], "g string, o long, v array<double>")
    got = {r.g: bytes(r.content) for r in npy.to_npy(df, "g", "o", "v").collect()}
    (tmp_path / "b.npy").write_bytes(got["b"])
    assert set(got) == {"b", "c"} and rows(npy.read_npy(spark, str(tmp_path / "b.npy"), "<f4")) == [[1, 2], [3, 4]]
