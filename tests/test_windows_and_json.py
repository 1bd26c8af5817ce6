"""Signals between the windows of a stream, and types of JSON text by content."""

import json
import random

from plumbline.operators import profile
from plumbline.streaming import streams
from pyspark.sql import functions as F


def day_rows(day, n, bad):
    return [(f"2024-03-{day:02d} {i % 24:02d}:00:00", i < bad) for i in range(n)]


def test_each_signal_comes_once_and_late_rows_count(spark, tmp_path):
    """Files arrive one a run; a late row of the second day arrives before that day closes."""
    folder, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    files = [day_rows(1, 10, 1), day_rows(2, 10, 1), day_rows(2, 2, 2) + day_rows(3, 30, 3), day_rows(4, 30, 20), day_rows(6, 5, 0), day_rows(9, 5, 0)]
    stream = lambda: spark.readStream.schema("ts string, bad boolean").option("maxFilesPerTrigger", 1).parquet(folder)
    for rows in files:
        spark.createDataFrame(rows, "ts string, bad boolean").coalesce(1).write.mode("append").parquet(folder)
        streams.stream_window_drift(stream(), "ts", {"bad": F.col("bad")}, out, ck, late="1 day").awaitTermination()
    got = sorted((r["window_start"].day, r["signal"], r["metric"], r["before"], r["after"]) for r in streams.read_window_drift(spark, out).collect())
    assert got == [
        (2, "rate_drift", "bad", 0.1, 0.25), (2, "row_count_drift", "n_rows", 10.0, 12.0),
        (3, "rate_drift", "bad", 0.25, 0.1), (3, "row_count_drift", "n_rows", 12.0, 30.0),
        (4, "rate_drift", "bad", 0.1, 0.666667), (6, "rate_drift", "bad", 0.666667, 0.0), (6, "row_count_drift", "n_rows", 30.0, 5.0)]


def brute_paths(values):
    out = {}

    def kind(v):
        names = {bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}
        return "null" if v is None else names[type(v)]

    def walk(path, v):
        out[(path, kind(v))] = out.get((path, kind(v)), 0) + 1
        for key, child in (v.items() if isinstance(v, dict) else [(None, c) for c in v] if isinstance(v, list) else []):
            walk(path + ("[]" if key is None else f".{key}"), child)

    for text in values:
        try:
            walk("$", json.loads(text))
        except ValueError:
            out[("$", "invalid")] = out.get(("$", "invalid"), 0) + 1
    return out


def random_value(rng, depth):
    kind = rng.choice(["int", "float", "str", "bool", "null"] + ["list", "dict"] * (depth > 0))
    if kind == "list":
        return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    if kind == "dict":
        return {rng.choice("abc"): random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))}
    return {"int": rng.randint(0, 99), "float": rng.randint(0, 99) + 0.5, "str": "x", "bool": True, "null": None}[kind]


def test_paths_of_random_values(spark):
    rng = random.Random(2)
    values = [json.dumps(random_value(rng, 4)) for _ in range(120)] + ["{oops}", "[1, 2", "", "nope"]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "j string")
    got = {(r["path"], r["type"]): r["n"] for r in profile.json_path_types(df, "j").collect()}
    assert got == brute_paths(values)
    assert profile.json_path_types(df.limit(0), "j").count() == 0


def test_brackets_alone_are_no_nested_value(spark):
    df = spark.createDataFrame([("{oops}",), ('{"a": 1}',), ("[x]",), ("[1]",)], "j string")
    r = profile.type_mix(df, "t", ["j"]).first()
    assert (r["pct_dict"], r["pct_list"], r["pct_string"]) == (0.25, 0.25, 0.5)
