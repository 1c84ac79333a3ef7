"""Chunked writing: runs that die part of the way are resumed without loss or repeats."""

import pytest

from careflow.sources import chunks


def table(spark, n=60):
    return spark.createDataFrame([(i, float(i)) for i in range(n)] + [(None, -1.0), (-5, -2.0)], "stay long, v double")


def values(df):
    return sorted(r.v for r in df.collect())


def test_a_run_that_dies_before_its_commit_counts_for_nothing(spark, tmp_path, monkeypatch):
    path, df = str(tmp_path / "t"), table(spark)
    chunks.write(df.filter("stay between 0 and 19"), path, "stay", step=10)

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(chunks, "commit", die)
        with pytest.raises(KeyboardInterrupt):
            chunks.write(df, path, "stay", step=10, skip_present=True)
    assert values(chunks.read(spark, path)) == [float(i) for i in range(20)]
    assert {r.chunk for r in chunks.manifest(spark, path).collect()} == {0, 1}
    assert chunks.write(df, path, "stay", step=10, skip_present=True) == {-1: 2, 2: 10, 3: 10, 4: 10, 5: 10}
    assert values(chunks.read(spark, path)) == values(df)


def test_a_committed_run_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    path, df = str(tmp_path / "t"), table(spark)
    real, calls = chunks._names, []

    def die_half_way(fs, folder):
        calls.append(1)
        if "chunk=3" in str(folder.getName()):
            raise KeyboardInterrupt
        return real(fs, folder)

    with monkeypatch.context() as m:
        m.setattr(chunks, "_names", die_half_way)
        with pytest.raises(KeyboardInterrupt):
            chunks.write(df, path, "stay", step=10)
    assert calls and spark.read.parquet(path).count() < df.count()
    assert chunks.write(df, path, "stay", step=10, skip_present=True) == {}
    assert values(chunks.read(spark, path)) == values(df)


def test_empty_chunks_are_not_asked_for_again(spark, tmp_path):
    path = str(tmp_path / "t")
    few = spark.createDataFrame([(3, 1.0), (99, 2.0)], "stay long, v double")
    assert chunks.write(few, path, "stay", step=10, chunks=3, skip_present=True) == {-1: 1, 0: 1, 1: 0, 2: 0}
    assert chunks.write(few, path, "stay", step=10, chunks=3, skip_present=True) == {}
    empty = str(tmp_path / "e")
    assert chunks.write(few.filter("v > 9"), empty, "stay", step=10) == {}
    assert chunks.manifest(spark, empty).count() == 0


def test_files_and_manifest_must_agree(spark, tmp_path):
    path, df = str(tmp_path / "t"), table(spark)
    chunks.write(df, path, "stay", step=10)
    chunks.write(df.filter("stay = 7"), path, "stay", step=10)
    assert chunks.read(spark, path).filter("stay = 7").count() == 2
    df.filter("stay = 3").write.mode("append").parquet(path + "/chunk=0")
    with pytest.raises(ValueError):
        chunks.read(spark, path)
