"""Merged tables: bounded scans, compaction that may be lost half-way, bucket splitting, freed space."""

import os

import pytest
from plumbline.operators.load import merge_scd1
from plumbline.streaming import streams


def merge(target, new):
    return new if target is None else merge_scd1(target, new, ["k"])


def batch(spark, n):
    return spark.createDataFrame([((n * 7 + i * 3) % 50, f"{n}-{i}") for i in range(4)] + [(1000 + n, None)], "k int, v string")


def put(spark, path, numbers, state, **options):
    for n in numbers:
        rows = batch(spark, n)
        streams.merge_into_buckets(rows, path, ["k"], merge, n, 8, **options)
        state.update({r["k"]: r["v"] for r in rows.collect()})


def rows_of(spark, path):
    found = [tuple(r) for r in streams.read_merged(spark, path).select("k", "v").collect()]
    assert len(found) == len(dict(found))
    return dict(found)


def test_many_batches_leave_few_scans(spark, tmp_path):
    path, state = str(tmp_path / "t"), {}
    put(spark, path, range(8), state, compact_after=3)
    assert rows_of(spark, path) == state
    assert streams.live_versions(spark, path) <= 4
    put(spark, path, [3, 7], dict(state), compact_after=3)  # replays change nothing
    assert rows_of(spark, path) == state


@pytest.mark.parametrize("lost", ["data", "log"])
def test_compaction_lost_half_way(spark, tmp_path, monkeypatch, lost):
    path, state = str(tmp_path / "t"), {}
    put(spark, path, range(3), state, compact_after=None)
    honest = streams._commit

    def fail(*args):
        raise OSError("lost")

    monkeypatch.setattr(streams, "_commit", fail)
    with pytest.raises(OSError):
        streams.compact(spark, path, ["k"])
    monkeypatch.setattr(streams, "_commit", honest)
    if lost == "log":  # files of a commit that never ended
        os.makedirs(os.path.join(path, "log", "_temporary", "0"), exist_ok=True)
    assert rows_of(spark, path) == state
    put(spark, path, [5], state, compact_after=None)
    streams.compact(spark, path, ["k"])
    assert rows_of(spark, path) == state and streams.live_versions(spark, path) == 1


def test_buckets_split_and_space_is_freed(spark, tmp_path):
    path, state = str(tmp_path / "t"), {}
    put(spark, path, range(5), state, compact_after=None)
    streams.compact(spark, path, ["k"], rows_per_bucket=1)
    log = streams._log(spark, path)
    assert {r["buckets"] for r in log.select("buckets").distinct().collect()} == {32} and rows_of(spark, path) == state
    assert streams.vacuum(spark, path) == 5 and rows_of(spark, path) == state
    assert streams.vacuum(spark, path) == 0 or rows_of(spark, path) == state
    put(spark, path, [5], state, compact_after=None)
    assert rows_of(spark, path) == state
    streams.compact(spark, path, ["k"])
    streams.vacuum(spark, path)
    assert rows_of(spark, path) == state


def test_nothing_to_compact(spark, tmp_path):
    path = str(tmp_path / "none")
    streams.compact(spark, path, ["k"])
    assert streams.vacuum(spark, path) == 0 and streams.live_versions(spark, path) == 0
    streams.merge_into_buckets(batch(spark, 0).limit(0), path, ["k"], merge, 0, 4)
    with pytest.raises(ValueError):
        streams.read_merged(spark, path)
