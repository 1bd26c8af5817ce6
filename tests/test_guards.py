"""Empty inputs, statements that must not run, and CSV files with line ends inside quotes."""

import pytest
from plumbline.operators import drift, integrity, keys, relate, rules
from plumbline.sources.readers import guard_select, read_csv


def test_tables_without_shared_keys_give_empty_results(spark):
    a, b = spark.createDataFrame([(1,)], "a_id int"), spark.createDataFrame([("x",)], "name string")
    tables = {"a": a, "b": b}
    assert relate.key_census(tables).count() == 0
    assert relate.relationships(tables).count() == 0
    assert relate.id_type_drift({"b": b}).count() == 0


def test_no_rules_give_no_issues(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert rules.apply_rules(df, "t", []).columns == ["dataset", "column_name", "issue_type", "severity", "n_bad", "n_checked", "pct"]
    assert rules.apply_rules(df, "t", []).count() == keys.functional_dependencies(df, "t").count() == 0


@pytest.mark.parametrize("statement", ["select 'update; drop' as a", "SELECT 1 -- delete\n", "with x as (select 1 as a) select a from x;", 'select 1 as "insert"', "/* drop */ select `update` from t"])
def test_statements_that_only_read(statement):
    assert guard_select(statement)


@pytest.mark.parametrize("statement", [
    "with x as (select 1) insert into t select * from x", "select 1; drop table t", "drop table t", "", "-- select\ndelete from t", "select 'a''; ' ; delete from t", "'select'"])
def test_statements_that_change_things(statement):
    with pytest.raises(ValueError):
        guard_select(statement)


def test_preview_leaves_views_as_they_were(spark):
    spark.range(5).createOrReplaceTempView("orders")
    spark.catalog.dropTempView("fresh")
    out = drift.sql_preview({"orders": spark.range(3), "fresh": spark.range(2)}, "SELECT count(*) AS n, 'a;b' AS s FROM orders CROSS JOIN fresh")
    assert out.first()["n"] == 6
    assert spark.table("orders").count() == 5 and "fresh" not in {v.name for v in spark.catalog.listTables()}
    with pytest.raises(ValueError):
        drift.sql_preview({"orders": spark.range(3)}, "WITH x AS (SELECT 1) INSERT INTO orders SELECT * FROM x")
    spark.catalog.dropTempView("orders")


def test_csv_is_split_by_line_unless_values_hold_line_ends(spark, tmp_path):
    plain, quoted = tmp_path / "plain.csv", tmp_path / "quoted.csv"
    plain.write_text('a,b\n1,"x ""y"" z"\n2,w\n')
    quoted.write_text('a,b\n1,"two\nlines"\n2,w\n')
    assert [tuple(r) for r in read_csv(spark, str(plain)).collect()] == [(1, 'x "y" z'), (2, "w")]
    assert [tuple(r) for r in read_csv(spark, str(quoted)).collect()] == [(1, "two\nlines"), (2, "w")]
    big = tmp_path / "big.csv"
    big.write_text("a,b\n" + "\n".join(f"{i},{'x' * 20}" for i in range(30_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        assert read_csv(spark, str(big)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_several_defaults_are_one_value(spark):
    df = spark.createDataFrame([(None,), ("a",)], "v string")
    default = spark.createDataFrame([("z",), ("b",), (None,)], "value string").repartition(3)
    assert sorted(r["v"] for r in integrity.apply_config_tables(df, "v", default=default).collect()) == ["a", "b"]
