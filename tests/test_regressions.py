"""Inputs that once gave wrong answers."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.functions.columns import infos
from plumbline.operators import checks, integrity, load, ordering, profile, rules, score
from plumbline.operators.census import census_summary, value_census
from plumbline.sources import readers
from plumbline.streaming import streams


def test_null_pattern_reads_every_category(spark):
    rows = [(None if i % 2 else i, *[str(i % 3)] * 5, "tied" if i % 2 else "free") for i in range(60)]
    df = spark.createDataFrame(rows, "v int, a string, b string, c string, d string, e string, f string")
    got = profile.null_patterns(df, "t", "v", list("abcdef")).first()
    assert (got.pattern, got.concentrated_in_col, got.concentrated_in_value) == ("MNAR", "f", "tied")


def test_case_collisions_of_long_text(spark):
    long = "Long Text " * 20
    df = spark.createDataFrame([(v,) for v in (long, long.lower(), "a", "A")], "name string")
    got = {r.issue_type: r.n_bad for r in checks.case_findings(df, "t").collect()}
    assert got["case_inconsistency"] == 4
    top = profile.column_profile(spark.createDataFrame([(long,)] * 3, "name string"), "t").first()
    assert top.top_value == long


def test_decimals_keep_their_digits(spark):
    rows = [(Decimal("12345678901234567890123456.01"),), (Decimal("12345678901234567890123456.02"),)]
    df = spark.createDataFrame(rows, "v decimal(38,2)")
    assert census_summary(value_census(df)).first().unique_count == 2


def test_value_list_of_any_length(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(3000)], "k int, v string")
    rule = [{"type": "valid_values", "values": {"t.v": [str(i) for i in range(2500)]}}]
    assert rules.apply_rules(df, "t", rule).first().n_bad == 500
    assert rules.rule_violations(df, "t", rule, ["k"]).count() == 500


def test_sample_of_a_tiny_share(spark):
    assert readers.sample_rows(spark.range(3_000_000), 1).count() <= 8
    assert 900 <= readers.sample_rows(spark.range(100_000), 1000).count() <= 1100


def test_reports_are_whole_unless_asked(spark):
    issues = spark.createDataFrame([("d", f"c{i}", "nulls", "high", 1) for i in range(12)], "dataset string, column_name string, issue_type string, severity string, n_bad long")
    assert score.column_risk(issues).count() == score.executive_summary(issues).count() == 12
    assert score.column_risk(issues, 3).count() == 3


def test_json_lines_with_a_value_field(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "value": "x"}\nbroken\n{"id": 2, "value": "y"}\n')
    got = {(r.id, r.value, r[readers.CORRUPT_LINE]) for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl")).select("id", "value", readers.CORRUPT_LINE).collect()}
    assert got == {(1, "x", None), (2, "y", None), (None, None, "broken")}


def test_csv_with_quoted_newlines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"a,1",b\n"two\nlines",1\n"say ""hi""",2\n')
    path = str(tmp_path / "a.csv")
    assert readers.csv_header(spark, path) == ["a,1", "b"]
    assert [tuple(r) for r in readers.read_csv(spark, path).collect()] == [("two\nlines", 1), ('say "hi"', 2)]


def test_nested_html_tables(spark):
    page = "<p><TABLE><tr><td>a</td><td><table><tr><td>in</td></tr></table>x</td></tr><tr><td>b</td></tr></table><table><tr><td>no</td></tr></table>"
    rows = readers.html_table_rows(spark.createDataFrame([(1, page)], "k int, html string"), "k", "html").collect()
    assert [(r.row_no, r.col_no, " ".join(r.value.split())) for r in rows] == [(0, 0, "a"), (0, 1, "in x"), (1, 0, "b")]


def test_deep_lists_are_found(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"a": {"b": {"c": {"d": {"e": [{"x": 1}, {"x": 2}]}}}}, "top": [{"y": 5}]}')
    df = spark.read.json(str(tmp_path / "d.json"))
    deep = ["a", "b", "c", "d", "e"]
    assert sorted(r.x for r in readers.explode_document(df, deep).collect()) == [1, 2]
    assert readers.find_list_path(df.select("a").schema) == deep


def test_config_spellings_do_not_multiply_rows(spark):
    df = spark.createDataFrame([(1, "City1"), (2, "City2")], "k int, city string")
    bad = spark.createDataFrame([("CITY1",), (" city1",)], "value string")
    assert sorted(tuple(r) for r in integrity.apply_config_tables(df, "city", bad).collect()) == [(1, None), (2, "City2")]


def test_merges_with_null_and_repeated_keys(spark):
    target = spark.createDataFrame([(None, "old"), (1, "one")], "k int, v string")
    staged = spark.createDataFrame([(None, "new"), (2, "a"), (2, "b")], "k int, v string")
    got = sorted(map(tuple, load.merge_scd1(target, staged, ["k"]).collect()), key=str)
    assert got == [(1, "one"), (2, "b"), (None, "new")]
    history = load.merge_scd2(load.start_scd2(target, "2020-01-01 00:00:00"), staged, ["k"], "2021-01-01 00:00:00")
    current = sorted(map(tuple, history.where("is_current").select("k", "v").collect()), key=str)
    assert current == [(1, "one"), (2, "b"), (None, "new")]
    assert history.where("NOT is_current").select("v").first().v == "old"


def test_late_rows_change_nothing(spark):
    target = spark.createDataFrame([(1, "new", 5), (None, "x", 5)], "k int, v string, ts int")
    late = spark.createDataFrame([(1, "late", 3), (2, "fresh", 1), (None, "y", 6)], "k int, v string, ts int")
    assert sorted((r.v for r in load.without_late(target, late, ["k"], "ts").collect())) == ["fresh", "y"]


def test_percentiles_scan_the_input_three_times(spark, tmp_path):
    spark.range(1000).withColumn("v", F.col("id") * 1.0).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = ordering.exact_percentiles(df, {"v": F.col("v")}, (0.25, 0.75))
    assert tuple(out.first()) == (249.75, 749.25)
    # two scans ran while it was built; the last one is shared by both uses of the bracket
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 2


def test_no_local_scratch_on_a_cluster(monkeypatch):
    from plumbline import session

    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.master": "yarn"}.get(key, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(Session())
    assert streams is not None


def test_merge_survives_a_half_written_first_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, "a") for i in range(20)], "k int, v string")
    merge = lambda old, new: new if old is None else load.merge_scd1(old, new, ["k"])
    for left in ("data/0.0/_temporary/0", "log/_temporary/0"):
        (tmp_path / "t" / left).mkdir(parents=True)
    streams.merge_into_buckets(rows, path, ["k"], merge, 0, 4)
    # a lost second batch leaves data that no log entry names
    spark.createDataFrame([(1, "lost", 1)], "k int, v string, _bucket int").write.partitionBy("_bucket").parquet(f"{path}/data/1.0")
    assert {r.v for r in streams.read_merged(spark, path).collect()} == {"a"}
    streams.merge_into_buckets(spark.createDataFrame([(1, "b"), (99, "c")], "k int, v string"), path, ["k"], merge, 1, 64)
    got = {r.k: r.v for r in streams.read_merged(spark, path).collect()}
    assert len(got) == 21 and got[1] == "b" and got[99] == "c" and got[2] == "a"


def test_an_empty_target_fails_the_load(spark):
    rows = spark.range(3)
    load.require_loaded(rows, rows)
    with pytest.raises(ValueError, match="empty"):
        load.require_loaded(rows.limit(0), rows)


def test_scalar_types_parse_only_what_looks_like_json_or_a_number(spark):
    values = ["12", " -3 ", "1.5e3", "1.2.3", "True", "[1, 2]", "[1, 2", "{\"a\": 1}", "[1}", "word", "", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    flags = profile.scalar_type_flags(infos(df)[0])
    names = ("integer", "float", "boolean", "list", "dict", "string")
    found = df.select("v", F.concat_ws(",", *[F.when(flags[n], n) for n in names]).alias("kind"))
    want = dict(zip(values, ["integer", "integer", "float", "string", "boolean", "list", "string", "dict", "string", "string", "string", ""]))
    assert {r.v: r.kind for r in found.collect()} == want
    counted = df.agg(*[F.count_if(flags[n]).alias(n) for n in names])
    text = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "parseJson" in text
    for part in text.split("parseJson")[:-1]:
        assert part.endswith("THEN isnotnull(static_invoke(VariantExpressionEvalUtils.")
