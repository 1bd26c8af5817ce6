"""Rule statistics against brute force, forests against a plain tree walk, verdicts against held-out labels."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plumbline.llm import queries, rule_forest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    w = WORD.findall(text or "")
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    repeated = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeated), len(lines)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab#|<é   \n\t\x0b\r", max_size=80), max_size=5))
def test_statistics(texts):
    got = rule_forest.statistics(pa.array(texts, pa.string()))
    assert [tuple(r) for r in got.tolist()] == [brute_counts(t) for t in texts]


def walk(forest, t, row):
    """Path length of one row in one tree, node by node."""
    node = 0
    while node < len(forest.feature[t]):
        node = 2 * node + (2 if row[forest.feature[t, node]] > forest.cut[t, node] else 1)
    return forest.path[t, node - len(forest.feature[t])]


def test_scores_are_path_lengths():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    x[:20, 1] += 9
    forest = rule_forest.IsolationForest(x, trees=40, sample=64)
    c = 2 * (sum(1 / k for k in range(1, 64))) - 2 * 63 / 64
    want = [2 ** -(np.mean([walk(forest, t, row) for t in range(40)]) / c) for row in x]
    assert np.allclose(forest.score(x), want, atol=5e-3)  # the harmonic number is approximated
    assert forest.score(x)[:20].mean() > forest.score(x)[20:].mean() + 0.1


def test_each_path_holds_its_sample():
    """The rows that end in a leaf and the leaf's depth give the path that is stored there."""
    x = np.random.default_rng(1).normal(size=(64, 2))
    forest = rule_forest.IsolationForest(x, trees=5, sample=64)
    for t in range(5):
        leaves = collections.Counter(walk(forest, t, row) for row in x)
        assert sum(leaves.values()) == 64 and min(leaves) >= 1


@pytest.mark.parametrize("bad,good,want_caught,want_lost", [
    ([0, 0, 0, 5, 5], [50, 50, 0, 0, 0], 10, 0),  # a gap
    ([5, 5, 0, 0, 0], [0, 0, 0, 50, 50], 0, 0),  # the wrong way round: nothing is rejected
    ([0, 0, 5, 5, 0], [10, 10, 10, 10, 10], 0, 0),  # every cut would lose too many
])
def test_threshold(monkeypatch, bad, good, want_caught, want_lost):
    monkeypatch.setattr(rule_forest, "GRID", 4)
    at = rule_forest.threshold(np.array(bad), np.array(good))
    assert sum(bad[at + 1:]) == want_caught and sum(good[at + 1:]) == want_lost


def test_threshold_without_both_kinds():
    none, some = np.zeros(rule_forest.GRID + 1), np.ones(rule_forest.GRID + 1)
    assert rule_forest.threshold(none, some) == rule_forest.threshold(some, none) == round(rule_forest.DEFAULT_THRESHOLD * rule_forest.GRID)


def test_query_counts_match_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{sf}/documents.parquet").to_pandas()
    want = {}
    for d, t in zip(docs["doc_id"], docs["text"]):
        n, chars, symbols, dup, again, _ = brute_counts(t)
        want[d] = (n, chars, symbols, dup, again, n < 50 or 100 * again > 50 * n)
    rows = queries.QUERIES["op13_quality_rules"](spark, sf).collect()
    assert {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows} == want
    assert not any(r["kept"] for r in rows if r["base_failed"])


def test_held_out_labels(spark):
    """Thresholds from four fifths of the labels: bad documents of the rest go, good ones stay."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    learned = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    rows = rule_forest.judged_documents(spark.read.parquet(f"{sf}/documents.parquet"), learned).collect()
    held = [r for r in rows if r["doc_id"] in known and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and not r["base_failed"]]
    good, bad = ([r["kept"] for r in held if known[r["doc_id"]] == k] for k in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad) and bad


EDGE = [(1, None), (2, ""), (3, " \n\n"), (4, "a b c d " * 30), (5, " ".join(f"w{i}" for i in range(60))), (5, " ".join(f"w{i}" for i in range(60))),
        (None, " ".join(f"v{i}" for i in range(80))), (7, "# " * 100), (8, " ".join(f"long{i}" for i in range(40_000))), (9, "\n".join(f"line {i % 30} of {i}" for i in range(200)))]


@pytest.mark.parametrize("marks", [[], [(1, None), (None, 1)], [(5, 1), (5, 0), (7, 0), (8, 1), (99, 1)]])
def test_edge_cases_and_clashing_columns(spark, marks):
    docs = spark.createDataFrame([(*r, 1, "k", True) for r in EDGE], "doc_id long, text string, n_words int, steps string, kept boolean")
    labels = spark.createDataFrame([(*m, 2) for m in marks], "doc_id long, quality int, score int")
    rows = rule_forest.judged_documents(docs, labels).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["base_failed"]) for r in rows) == sorted(
        (str(d), (c := brute_counts(t))[0], c[0] < 50 or 100 * c[4] > 50 * c[0]) for d, t in EDGE)
    same = [r["kept"] for r in rows if r["doc_id"] == 5]
    assert same[0] == same[1]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert rule_forest.judged_documents(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_same_sample_whatever_the_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = (rule_forest.fit_forests(rule_forest.rule_statistics(docs.repartition(k)), rows=50) for k in (1, 7))
    assert all((x.cut == y.cut).all() and (x.path == y.path).all() for x, y in zip(a, b))
