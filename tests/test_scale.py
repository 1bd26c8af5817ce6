"""Skew, plan shape, replay and invariants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import census, integrity, load, ordering, similar, transforms
from plumbline.sources import readers, writers
from plumbline.streaming import streams


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_exact_percentiles_with_hot_value(spark, hot):
    rng = random.Random(7)
    values = [5.0 if rng.random() < hot else rng.gauss(0, 100) for _ in range(5000)] + [None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    clean = [v for v in values if v is not None and v == v]
    probs = (0.0, 0.05, 0.25, 0.5, 0.95, 1.0)
    row = ordering.exact_percentiles(df, {"v": F.col("v")}, probs, accuracy=50).first()
    assert np.allclose([row[f"v__{i}"] for i in range(len(probs))], np.quantile(clean, probs))


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert ordering.exact_percentiles(df, {"v": F.col("v")}, (0.5,)).first()["v__0"] is None


def test_global_row_number_with_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    got = [(r.k, r.id) for r in ordering.global_row_number(df, [F.asc("k"), F.asc("id")]).orderBy("row_no").collect()]
    assert got == sorted(got)


def test_fill_forward_with_hot_group(spark):
    rows = [(0 if i % 3 else i, i, float(i) if i % 7 == 0 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "g long, t long, v double")
    want, last = {}, {}
    for g, t, v in rows:
        last[g] = v if v is not None else last.get(g)
        want[t] = last[g]
    assert {r.t: r.v for r in transforms.fill_directional(df, "v", ["g"], "t", "t").collect()} == want


def brute_force(sets, threshold):
    hit = set()
    items = list(sets.items())
    for x, (a, sa) in enumerate(items):
        for b, sb in items[x + 1:]:
            if len(sa & sb) >= threshold * len(sa | sb):
                hit |= {a, b}
    return hit


def test_similar_sets_match_brute_force(spark):
    rng = random.Random(3)
    base = list(range(20))
    sets = {}
    for i in range(300):
        if i % 3 == 0:  # a third of all rows: near copies of one set, none of them equal
            s = set(base) - {rng.choice(base)} | {1000 + i}
        else:
            s = {rng.randrange(200) for _ in range(rng.randint(1, 12))}
        sets[i] = s
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id int, toks array<long>")
    for t in (0.5, 0.8, 0.92):
        got = {r.id for r in similar.similar_set_flags(df, "id", "toks", t).collect()}
        assert got == brute_force(sets, t)


def test_documents_match_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(80):
        words = [rng.choice(vocabulary) for _ in range(40)]
        texts[i] = words
        if i % 2:
            texts[i] = list(texts[i - 1])
            texts[i][rng.randrange(40)] = "changed"
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "id int, text string")
    sets = {i: {tuple(w[k:k + 3]) for k in range(len(w) - 2)} for i, w in texts.items()}
    assert {r.id for r in similar.near_duplicate_documents(df, "id", "text", 0.8).collect()} == brute_force(sets, 0.8)


def test_latest_row_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("ts"))
    assert "WindowGroupLimit" in plan(integrity.keep_latest(df, ["k"], "ts", ["ts"]))


def test_extract_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    text = plan(load.extract(df, "incremental", "o_orderdate", "1997-01-01 00:00:00").select("o_orderkey"))
    assert "GreaterThan(o_orderdate" in text and "o_totalprice" not in text


def test_rejects_partition_the_input(spark):
    df = spark.createDataFrame([(1, "a@b.c", "5"), (2, None, "x"), (None, "bad", "6")], "id long, email string, amount string")
    rules = load.LoadRules(keys=["id"], numeric=["amount"], emails=["email"])
    good, bad = load.split_rejects(df, rules, "p", "t", "2024-01-01 00:00:00")
    hard = bad.filter("rejects").select("row_json").distinct().count()
    assert good.count() + hard == df.count()
    kept, _ = load.split_rejects(df, rules, "p", "t", "2024-01-01 00:00:00", never_drop_rows=True)
    assert kept.count() == 3


def test_orphans_and_matches_add_up(spark):
    child = spark.createDataFrame([(i, i % 7 if i % 5 else None) for i in range(100)], "id long, fk long")
    parent = spark.createDataFrame([(i,) for i in range(5)], "pk long")
    good, bad = integrity.enforce_reference(child, parent, "fk", "pk")
    assert good.count() + bad.count() == 100
    assert bad.filter("fk IS NULL").count() == 0


def test_one_current_row_per_key(spark):
    target = load.start_scd2(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), "2020-01-01 00:00:00")
    for mode, rows in (("always", 4), ("only_changed", 3)):
        new = load.merge_scd2(target, spark.createDataFrame([(1, "a"), (2, "c")], "k int, v string"), ["k"], "2021-01-01 00:00:00", mode)
        assert new.count() == rows
        assert new.filter("is_current").groupBy("k").count().filter("count <> 1").count() == 0


def test_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "target")
    first = spark.createDataFrame([(i, "a") for i in range(50)], "k int, v string")
    second = spark.createDataFrame([(i, "b") for i in range(40, 60)], "k int, v string")

    def merge(old, new):
        return load.start_scd2(new, "2020-01-01 00:00:00") if old is None else load.merge_scd2(old, new, ["k"], "2021-01-01 00:00:00")

    streams.merge_into_buckets(first, path, ["k"], merge, 0, 4)
    streams.merge_into_buckets(second, path, ["k"], merge, 1, 4)
    once = sorted(map(tuple, streams.read_merged(spark, path).select("k", "v", "is_current").collect()))
    streams.merge_into_buckets(second, path, ["k"], merge, 1, 4)
    assert sorted(map(tuple, streams.read_merged(spark, path).select("k", "v", "is_current").collect())) == once
    assert len(once) == 70


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,name\n1,x,y\n")
    assert readers.csv_header(spark, str(tmp_path / "a.csv")) == ["id", "name", "name"]
    (tmp_path / "d.json").write_text('{"total": 2, "data": {"src": "s", "items": [{"id": 1, "in": {"a": 5}}, {"id": 2, "in": {"a": 6}}]}}')
    rows = readers.read_json_document(spark, str(tmp_path / "d.json")).orderBy("id").collect()
    assert [(r.total, r.data_src, r.id, r.in_a) for r in rows] == [(2, "s", 1, 5), (2, "s", 2, 6)]
    (tmp_path / "l.jsonl").write_text('{"id": 1}\nnot json\n')
    assert {(r.id, r.value) for r in readers.read_jsonl(spark, str(tmp_path / "l.jsonl")).collect()} == {(1, None), (None, "not json")}
    assert not writers.mirror(spark.range(0), str(tmp_path / "none"))
    loaded = readers.Catalog(spark).load([{"path": str(tmp_path / "a.csv")}, {"path": str(tmp_path / "gone.parquet")}])
    assert list(loaded.tables) == ["a"] and loaded.failures[0][0] == "gone"


def test_select_guard():
    assert readers.guard_select(" select 1; ") == "select 1"
    for bad in ("delete from t", "select 1; drop table t", "with x as (select 1) insert into t select * from x"):
        with pytest.raises(ValueError):
            readers.guard_select(bad)
    o = readers.jdbc_options("jdbc:x", table="t", partition_column="id", bounds=(0, 10), partitions=4)
    assert o["numPartitions"] == "4" and o["dbtable"] == "t"


def test_reservoir_is_exact_and_repeatable(spark):
    df = spark.range(10_000)
    a = {r.id for r in readers.reservoir(df, 100).collect()}
    assert len(a) == 100 and a == {r.id for r in readers.reservoir(df.repartition(7), 100).collect()}


def test_scratch_lies_in_the_configured_folder(spark):
    from plumbline import session

    class Conf:
        def get(self, key, default=None):
            return "/shared/ck/" if key == "spark.checkpoint.dir" else default

    class Named:
        conf = Conf()

    assert session.scratch_dir(Named()).startswith("/shared/ck/plumbline-")


def test_no_python_runs_in_the_tasks(spark):
    from plumbline.queries import catalog

    for name in ("assess_lineitem_issues", "profile_lineitem_columns", "load_reject_quarantine", "score_quality"):
        text = plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "Python" not in text and "CartesianProduct" not in text


def test_census_deals_a_large_table_to_tasks_by_its_cells(spark, monkeypatch):
    df = spark.range(1000).coalesce(1).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("t"))
    want = {(r.column_name, r.value, r.n) for r in census.value_census(df).collect()}
    assert len(want) == 1000 + 1 + 666
    monkeypatch.setattr(census, "CELLS_PER_TASK", 100)
    dealt = census.value_census(df)
    assert "RoundRobinPartitioning(20)" in plan(dealt)
    assert {(r.column_name, r.value, r.n) for r in dealt.collect()} == want


@pytest.mark.parametrize("bits", [1 << 26, 40000, 5])
def test_sets_travel_only_if_their_bit_is_set(spark, monkeypatch, bits):
    monkeypatch.setattr(similar, "BITS", bits)
    numbers = spark.range(2000)
    table = similar.bit_table(F.col("id"), numbers.filter("id % 10 = 0"))
    kept = {r.id for r in similar.by_bits(numbers, F.col("id"), table, "left_semi").collect()}
    left = {r.id for r in similar.by_bits(numbers, F.col("id"), table, "left_anti").collect()}
    assert kept | left == set(range(2000)) and not kept & left and kept >= set(range(0, 2000, 10))
    assert bits < 1 << 26 or len(kept) < 210
    rng = random.Random(3)
    sets = {i: set(rng.sample(range(400), 20)) for i in range(120)}
    sets |= {200 + i: set(sets[i]) for i in range(0, 30, 3)}
    sets |= {300 + i: (sets[i] - {min(sets[i])}) | {1000 + i} for i in range(40, 60)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, g array<long>")
    assert {r.id for r in similar.similar_set_flags(df, "id", "g", 0.8).collect()} == brute_force(sets, 0.8)
