"""Numpy files by byte ranges: any type and size of a partition, archives stored and compressed, and what is refused."""

import numpy as np
import pytest

from phasespark.sources import numpy_files
from phasespark.sources.numpy_files import NumpyFiles
from phasespark.sources.signals import from_numpy


def loaded(spark, path, **options):
    spark.dataSource.register(NumpyFiles)
    df = spark.read.format("numpy").options(path=str(path), **options).load()
    rows = df.orderBy("t").collect()
    assert [r["t"] for r in rows] == list(range(len(rows)))
    return np.array([r["x"] for r in rows]), df.rdd.getNumPartitions()


@pytest.mark.parametrize("kind", ["f8", ">f4", "i2", "?", "u8"])
def test_arrays_in_byte_ranges(spark, tmp_path, kind):
    x = (np.random.default_rng(1).random(1000) * 100).astype(kind)
    np.save(tmp_path / "x.npy", x)
    np.savez(tmp_path / "s.npz", other=np.arange(3), x=x)
    np.savez_compressed(tmp_path / "c.npz", x=x)
    for name, options in (("x.npy", {}), ("s.npz", {"key": "x"})):
        got, parts = loaded(spark, tmp_path / name, partitionBytes=str(256 * x.itemsize), **options)
        assert np.array_equal(got, x.astype(float)) and parts == 4
    got, parts = loaded(spark, tmp_path / "c.npz", partitionBytes="64")
    assert np.array_equal(got, x.astype(float)) and parts == 1
    assert np.array_equal(loaded(spark, f"file://{tmp_path}/x.npy")[0], x.astype(float))


def test_chunks_of_a_compressed_member(spark, tmp_path):
    x = np.cumsum(np.random.default_rng(2).normal(size=numpy_files.CHUNK + 77))
    np.savez_compressed(tmp_path / "c.npz", x)
    rows = from_numpy(spark, str(tmp_path / "c.npz"), series_id="a").toPandas().sort_values("t")
    assert np.array_equal(rows["x"], x) and set(rows["series_id"]) == {"a"}


@pytest.mark.parametrize("x", [np.zeros((2, 2)), np.zeros(0), np.array(["a"]), np.array([1 + 2j]), np.float64(3.0)])
def test_other_arrays_are_refused(spark, tmp_path, x):
    np.save(tmp_path / "x.npy", x)
    with pytest.raises(ValueError, match="array"):
        from_numpy(spark, str(tmp_path / "x.npy"))


def test_other_files_and_keys_are_refused(spark, tmp_path):
    (tmp_path / "x.npy").write_bytes(b"some text, long enough")
    np.savez(tmp_path / "s.npz", a=np.arange(3), b=np.arange(4))
    np.save(tmp_path / "o.npy", np.array([None, 1], dtype=object), allow_pickle=True)
    for name, key in (("x.npy", None), ("s.npz", None), ("s.npz", "c"), ("o.npy", None)):
        with pytest.raises(ValueError):
            from_numpy(spark, str(tmp_path / name), key)
    with pytest.raises(OSError):
        from_numpy(spark, str(tmp_path / "none.npy"))


def test_values_that_are_not_finite_fail_when_read(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.array([1.0, np.nan]))
    with pytest.raises(Exception, match="not finite"):
        from_numpy(spark, str(tmp_path / "x.npy")).collect()
    np.save(tmp_path / "y.npy", np.arange(10.0))
    (tmp_path / "y.npy").write_bytes((tmp_path / "y.npy").read_bytes()[:-8])
    with pytest.raises(Exception, match="ends before"):
        from_numpy(spark, str(tmp_path / "y.npy")).collect()
