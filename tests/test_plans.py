"""Plans with side outputs, and sources whose files break while they are read."""

import gzip
import json
import os

import pytest
from plumbline.plans.steps import Step, plan_summary, run_plan, run_steps
from plumbline.sources.readers import Catalog
from pyspark.sql import functions as F

ROWS = [(1, " A@x.de ", "open", 5.0), (2, "nope", "open", 500.0), (3, None, "OPEN", None), (4, "b@x.de", "odd", -1.0), (5, "a@x.de", "open", 7.0), (6, "a@x.de", "open", 7.0), (None, "c@x.de", "open", 1.0)]
STEPS = [
    Step("deduplicate", "email", {"order_by": ["id"], "latest": True}),
    Step("reject_outside", "amount", {"low": 0, "high": 100}),
    Step("reject_unmatched", "email", {"pattern": "@", "reason": "bad_email"}),
    Step("reject_unlisted", "status", {"allowed": ["open"]}),
    Step("trim", "email"), Step("lowercase", "email"),
]


def people(spark):
    return spark.createDataFrame([(*r, 1) for r in ROWS], "id int, email string, status string, amount double, `a.b` int")


def test_rows_leave_at_the_first_phase_with_all_its_reasons(spark):
    out = run_plan(people(spark), STEPS)
    assert sorted((r["id"], r["email"]) for r in out.good.filter("id IS NOT NULL").collect()) == [(3, None), (6, "a@x.de")]
    assert out.good.columns == people(spark).columns and out.good.count() == 3
    got = sorted((json.loads(r["row_json"])["id"], r["step_no"], r["phase"], r["reason"], r["column_name"]) for r in out.rejects.collect())
    assert got == [
        (1, 0, "deduplicate", "duplicate", "email"), (2, 1, "reject", "reject_outside", "amount"), (2, 2, "reject", "bad_email", "email"),
        (4, 1, "reject", "reject_outside", "amount"), (4, 3, "reject", "reject_unlisted", "status"), (5, 0, "deduplicate", "duplicate", "email")]
    assert out.audit.count() == 0
    kinds = {(r["kind"], r["step_no"]): r["n_rows"] for r in plan_summary(out).collect()}
    assert kinds == {("good", None): 3, ("rejected", 0): 2, ("rejected", 1): 2, ("rejected", 2): 1, ("rejected", 3): 1}


def test_never_drop_rows_changes_values(spark):
    out = run_plan(people(spark), STEPS[1:], never_drop_rows=True)
    got = sorted(((r["id"] or 0), r["email"], r["status"], r["amount"]) for r in out.good.collect())
    assert got[2] == (2, None, "open", None) and got[4] == (4, "b@x.de", None, None) and len(got) == len(ROWS)
    assert out.rejects.count() == 0 and out.audit.count() == 4


def test_many_rejecting_steps_read_the_source_once(spark):
    steps = [Step("reject_when", "id", {"condition": f"id = {k}", "reason": f"r{k}"}) for k in range(30)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    plain = people(spark).drop("a.b")
    source = plain.mapInArrow(count, plain.schema)
    out = run_plan(source, steps)
    assert (out.good.count(), out.rejects.count()) == (1, 6)
    assert seen.value == len(ROWS)


def test_orphans_duplicates_and_copy(spark):
    parent = spark.createDataFrame([(1,), (1,), (5,), (None,)], "k int")
    steps = [Step("reject_orphans", "id", {"parent": parent, "parent_key": "k"}), Step("copy", "", {"batch_id": "b", "loaded_at": "2024-01-01 00:00:00"})]
    out = run_plan(people(spark), steps)
    assert sorted(str(r["id"]) for r in out.good.collect()) == ["1", "5", "None"]
    assert "etl_batch_id" in out.good.columns
    assert sorted(json.loads(r["row_json"])["id"] for r in out.rejects.collect()) == [2, 3, 4, 6]
    kept = run_plan(people(spark), steps[:1], never_drop_rows=True)
    assert kept.good.count() == len(ROWS) and kept.good.filter("id IS NULL").count() == 5 and kept.audit.count() == 4


def test_identical_rows_and_null_keys(spark):
    df = spark.createDataFrame([(1, "x")] * 4 + [(None, "y"), (None, "y"), (2, None)], "k int, v string")
    out = run_plan(df, [Step("deduplicate", "k")])
    assert sorted(str(r["k"]) for r in out.good.collect()) == ["1", "2", "None", "None"] and out.rejects.count() == 3


def test_flatten_comes_before_deduplication(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, '{"a": 1, "b": "y"}'), (3, "broken")], "id int, j string")
    out = run_plan(df, [Step("deduplicate", "j_a", {"order_by": ["id"]}), Step("flatten", "j", {"schema": "a int, b string"})])
    assert sorted((r["id"], r["j_b"]) for r in out.good.collect()) == [(1, "x"), (3, None)]


def test_empty_table_and_no_steps(spark):
    out = run_plan(people(spark).limit(0), STEPS)
    assert out.good.count() == out.rejects.count() == 0
    assert run_plan(people(spark), []).good.count() == len(ROWS)


def test_steps_that_need_a_plan_are_refused_elsewhere(spark):
    with pytest.raises(ValueError, match="run_plan"):
        run_steps(people(spark), STEPS)


# --- sources that break -----------------------------------------------------------------------------

def test_one_torn_file_among_ten(spark, tmp_path):
    folder = str(tmp_path / "t")
    spark.range(1000).repartition(10).write.parquet(folder)
    names = sorted(f for f in os.listdir(folder) if f.endswith(".parquet"))
    whole = spark.read.parquet(folder)
    lost = {r["id"] for r in whole.filter(F.col("_metadata.file_name") == names[4]).collect()}
    with open(os.path.join(folder, names[4]), "r+b") as f:
        f.truncate(os.path.getsize(os.path.join(folder, names[4])) // 2)
    found = Catalog(spark).load([{"path": folder, "format": "parquet", "name": "t"}], verify=True)
    assert {r["id"] for r in found.tables["t"].collect()} == set(range(1000)) - lost
    assert [(r["name"], names[4] in r["error"]) for r in found.errors().collect()] == [("t", True)]


def test_cut_off_gzip_and_sources_that_fail_whole(spark, tmp_path):
    for k in range(4):
        with gzip.open(tmp_path / f"part{k}.csv.gz", "wt") as f:
            f.write("id,v\n" + "\n".join(f"{k * 1000 + i},{'x' * (i % 50)}" for i in range(800)))
    data = (tmp_path / "part2.csv.gz").read_bytes()
    (tmp_path / "part2.csv.gz").write_bytes(data[: len(data) // 2])
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.parquet").write_bytes(b"no parquet")
    (tmp_path / "bad" / "b.parquet").write_bytes(b"nor this")
    specs = [{"path": str(tmp_path / "bad"), "format": "parquet", "name": "bad"}, {"path": str(tmp_path / "*.csv.gz"), "format": "csv", "name": "good"}, {"path": str(tmp_path / "none"), "format": "csv", "name": "none"}]
    found = Catalog(spark).load(specs, verify=True)
    assert set(found.tables) == {"good"} and found.tables["good"].count() == 2400
    errors = found.errors().collect()
    assert sorted(r["name"] for r in errors) == ["bad", "bad", "good", "none"]
    assert any("part2.csv.gz" in r["error"] for r in errors)
