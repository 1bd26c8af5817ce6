"""Edit similarity, rank association, distribution distances, isolation and keys by content against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from plumbline.operators import association, edits, isolation, relate
from pyspark.sql import functions as F


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def pairs_of(texts, threshold):
    out = set()
    for (i, a), (j, b) in itertools.combinations(texts, 2):
        m = max(len(a), len(b))
        if a != b and abs(len(a) - len(b)) <= (1 - threshold) * m + 1e-9 and levenshtein(a, b) <= (1 - threshold) * m + 1e-9:
            out.add((min(i, j), max(i, j), levenshtein(a, b)))
    return out


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        kind, at = rng.choice("idr"), rng.randrange(len(chars) + 1)
        if kind == "i":
            chars.insert(at, rng.choice("abcdef "))
        elif chars and at < len(chars):
            chars[at:at + 1] = [] if kind == "d" else [rng.choice("abcdef ")]
    return "".join(chars)


@pytest.mark.parametrize("threshold,length", [(0.92, 14), (0.92, 30), (0.8, 12), (0.92, 48), (0.92, 52), (0.85, 47), (0.92, 130), (0.9, 60), (0.6, 20)])
def test_all_pairs_within_the_threshold(spark, threshold, length):
    rng = random.Random(length)
    texts, k = [], 0
    for _ in range(12):
        base = "".join(rng.choice("abcdef") for _ in range(length + rng.randint(-2, 2)))
        for _ in range(7):
            texts.append((k, edited(rng, base, rng.randint(0, int((1 - threshold) * length) + 2))))
            k += 1
    texts = [(i, t) for i, t in {t: i for i, t in texts if t}.items() for i, t in [(t, i)]]
    df = spark.createDataFrame(texts, "id int, s string")
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"]), r["edits"]) for r in edits.similar_pairs(df, threshold).collect()}
    assert got == pairs_of(texts, threshold)
    assert got


def test_pairs_across_the_length_limit(spark):
    """The shorter text has a key of its own length, the longer one is beyond the limit."""
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh") for _ in range(edits.SHORT + 1))
    texts = [(0, base), (1, base[:-1]), (2, base[:20] + base[21:]), (3, base[:-2]), (4, base + "x"), (5, base[1:] + "yz"), (6, base[:10] + "qq" + base[10:])]
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"]), r["edits"]) for r in edits.similar_pairs(spark.createDataFrame(texts, "id int, s string"), 0.9).collect()}
    assert got == pairs_of(texts, 0.9)


ROWS = [(1, "Anna Miller", "12 Long Street"), (2, "miller ANNA", "Street 12 long"), (3, "Anna Miller", "12 Long Streat"), (4, None, None), (5, "", " "), (6, "--", "..."),
        (7, "Bob", None), (8, None, "bob"), (9, "Zoë Äpfel", "Größe 7"), (10, "Zoe Äpfel", "Größe 7"), (11, "x", "y")]


def test_rows_with_partners(spark):
    df = spark.createDataFrame([(*r, 5) for r in ROWS], "key int, name string, address string, id int")
    assert {r["key"] for r in edits.near_duplicate_keys(df, "key", ["name", "address"], 0.9).collect()} == {1, 2, 3, 7, 8, 9, 10}
    pairs = {(r["key_a"], r["key_b"]): (r["edits"], r["similarity"]) for r in edits.near_duplicate_pairs(df, "key", ["name", "address"], 0.9).collect()}
    assert set(pairs) == {(1, 3), (9, 10)} and pairs[(9, 10)][0] == 1
    issue = edits.near_duplicate_issue(df, "people", "key", ["name", "address"], 0.9).collect()
    assert [(r["n_bad"], r["n_checked"]) for r in issue] == [(7, 11)]
    assert edits.near_duplicate_keys(df.limit(0), "key", ["name", "address"]).count() == 0


def test_a_large_group_of_equal_rows_is_one_text(spark):
    df = spark.range(5000).select(F.col("id").alias("key"), F.when(F.col("id") < 4000, "one and the same text of a row").otherwise(F.concat(F.lit("row "), F.md5(F.col("id").cast("string")))).alias("name"))
    assert edits.near_duplicate_keys(df, "key", ["name"]).count() == 4000


# --- Kendall -------------------------------------------------------------------------------------

def brute_tau(x, y):
    s = t = u = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        s, t, u = s + a * b, t + abs(a), u + abs(b)
    return round(float(s / math.sqrt(t * u)), 6) if t and u else None


@pytest.mark.parametrize("seed", range(12))
def test_order_score(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 60))
    x, y, w = rng.integers(0, 8 + seed, n), rng.integers(0, 3 + 2 * seed, n).astype(float), rng.integers(1, 5, n)
    want = sum(int(w[i] * w[j] * np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])) for i, j in itertools.combinations(range(n), 2))
    assert association.order_score(x, y, w) == want
    assert association.order_score(x, y, w.astype(np.int64) * 10**9) == want * 10**18


@pytest.mark.parametrize("kind", ["continuous", "ties", "hot value", "monotone"])
def test_kendall(spark, kind):
    rng = np.random.default_rng(5)
    n = 400
    a = rng.normal(size=n)
    b = a + rng.normal(size=n)
    c = rng.normal(size=n)
    if kind == "ties":
        a, b = np.round(a), np.round(b * 2)
    elif kind == "hot value":
        a[: n // 2], b[n // 3:] = 0.0, 1.5
    elif kind == "monotone":
        b = np.exp(a)
    rows = [tuple(map(float, r)) for r in zip(a, b, c)] + [(None, 1.0, 2.0), (1.0, None, float("nan")), (None, None, None)]
    got = {(r["column_a"], r["column_b"]): (r["n"], r["correlation"]) for r in association.kendall(spark.createDataFrame(rows, "a double, `b.x` double, c double"), ["a", "b.x", "c"]).collect()}
    full = [r for r in rows if None not in r and not any(math.isnan(v) for v in r)]
    for i, j in ((0, 1), (0, 2), (1, 2)):
        known = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None and not math.isnan(r[i]) and not math.isnan(r[j])]
        names = ("a", "b.x", "c")
        assert got[(names[i], names[j])] == (len(known), brute_tau(*zip(*known)))
    assert len(full) == n


def test_kendall_without_rows_or_spread(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, 3.0, None)], "a double, b double, c double")
    got = {(r["column_a"], r["column_b"]): (r["n"], r["correlation"]) for r in association.kendall(df, ["a", "b", "c"]).collect()}
    assert got == {("a", "b"): (2, None), ("a", "c"): (0, None), ("b", "c"): (0, None)}


# --- distances -----------------------------------------------------------------------------------

def test_distances(spark):
    rng = np.random.default_rng(3)
    a, b = np.round(rng.normal(size=700), 2), np.round(rng.normal(0.3, 1.2, size=400), 2)
    x, y = (spark.createDataFrame([(float(v), 1.0) for v in s] + [(None, float("nan"))], "v double, w double") for s in (a, b))
    got = {r["column_name"]: r for r in association.distribution_distances(x, y, ["v", "w"]).collect()}
    values = np.unique(np.concatenate([a, b]))
    gaps = [round(abs((a <= v).mean() - (b <= v).mean()), 9) for v in values]
    assert got["v"]["ks"] == round(max(gaps), 6) and got["v"]["at_value"] == values[int(np.argmax(gaps))]
    edges = np.quantile(a, np.arange(1, 10) / 10)
    pa, pb = (np.maximum(1e-4, np.bincount([(v > edges).sum() for v in s], minlength=10) / len(s)) for s in (a, b))
    assert got["v"]["psi"] == pytest.approx(((pb - pa) * np.log(pb / pa)).sum(), abs=2e-6)
    assert (got["w"]["ks"], got["w"]["psi"], got["w"]["n_a"], got["w"]["n_b"]) == (0.0, 0.0, 700, 400)


# --- isolation -----------------------------------------------------------------------------------

def test_isolation_finds_what_the_centre_hides(spark):
    """A ring with points in the middle: their Mahalanobis distance is the smallest of all."""
    rng = np.random.default_rng(0)
    angle = rng.uniform(0, 2 * math.pi, 1500)
    rows = [(i, float(10 * math.cos(t) + rng.normal(0, 0.2)), float(10 * math.sin(t) + rng.normal(0, 0.2))) for i, t in enumerate(angle)]
    rows += [(10_000 + i, float(rng.normal(0, 1.5)), float(rng.normal(0, 1.5))) for i in range(15)] + [(20_000, None, 1.0)]
    found = isolation.isolated_rows(spark.createDataFrame(rows, "key int, x double, `y.z` double"), "key", ["x", "y.z"], 0.05).filter("is_outlier").collect()
    assert sum(r["key"] >= 10_000 for r in found) >= 12 and len(found) <= 0.05 * 1515 + 1


def test_isolation_is_the_same_on_any_partitioning(spark):
    df = spark.range(3000).select(F.col("id").alias("key"), (F.col("id") * 37 % 1000).cast("double").alias("x"), (F.col("id") * F.col("id") % 777).cast("int").alias("y"))
    a, b = ({r["key"]: r["_score"] for r in isolation.isolation_scores(df.repartition(k), "key", ["x", "y"]).collect()} for k in (1, 9))
    assert a == b and len(a) == 3000


@pytest.mark.parametrize("n", [0, 1, 5, 12, 300])
def test_isolation_of_small_tables(spark, n):
    df = spark.range(n).select(F.col("id").alias("key"), (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") == 11, 1e6).otherwise(F.col("id") % 3).alias("y"))
    assert isolation.isolation_scores(df, "key", ["x", "y"]).count() == n
    issue = isolation.isolation_issue(df, "t", "key", ["x", "y"], 0.1).collect()
    assert len(issue) == (n >= 10)


# --- keys by content -----------------------------------------------------------------------------

def test_keys_are_found_by_content(spark):
    people = spark.createDataFrame([(1, "a", None), (2, "b", 1.5), (3, "c", 2.0)], "pid int, `first.name` string, score double")
    visits = spark.createDataFrame([(10, 1.0, "2"), (11, 3.0, "b"), (12, None, None), (13, 1.0, "c")], "nr int, who double, note string")
    empty = spark.createDataFrame([], "k int, t string")
    found = {(r["dataset_a"], r["column_a"], r["dataset_b"], r["column_b"]): (r["n_a"], r["n_b"], r["n_common"], r["is_complete"])
             for r in relate.potential_join_keys({"people": people, "visits": visits, "empty": empty}, 0.6).collect()}
    assert found == {
        ("visits", "who", "people", "pid"): (2, 3, 2, True), ("people", "pid", "visits", "who"): (3, 2, 2, False),
        ("people", "first.name", "visits", "note"): (3, 3, 2, False), ("visits", "note", "people", "first.name"): (3, 3, 2, False)}
    assert relate.value_overlaps({"empty": empty, "more": empty}).count() == 0
    assert relate.value_overlaps({"one": people}).count() == 0


def test_texts_that_share_most_of_their_words(spark, monkeypatch):
    rng = random.Random(5)
    texts = sorted({f"{rng.choice([40712, 4071, 88213])}{rng.randrange(100)} active city{rng.randrange(30)} com example user{rng.randrange(10**rng.choice([3, 5]))}" for _ in range(150)})
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    monkeypatch.setattr(edits, "HEAVY", 3)
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))
            if levenshtein(texts[a], texts[b]) <= 0.1 * max(len(texts[a]), len(texts[b])) + 1e-9}
    assert len(want) > 20
    assert {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in edits.similar_pairs(df, 0.9).collect()} == want
    asked = df.filter("id % 7 = 0").select("id")
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in edits.similar_pairs(df, 0.9, asked).collect()}
    assert got == {p for p in want if p[0] % 7 == 0 or p[1] % 7 == 0}
    assert {r["id"] for r in edits.near_duplicate_keys(df, "id", ["s"], 0.9).collect()} == {x for i, j, _ in pairs_of([(i, " ".join(sorted(t.split()))) for i, t in enumerate(texts)], 0.9) for x in (i, j)}
    # a word that all texts hold at one place makes no pairs of all texts
    many = spark.range(6000).select("id", F.concat(F.sha1(F.col("id").cast("string")).substr(1, 10), F.lit(" active somewhere "), F.sha1(F.col("id").cast("string")).substr(11, 10)).alias("s"))
    monkeypatch.setattr(edits, "HEAVY", 100)
    rows = many.withColumn("n", F.length("s"))
    assert edits._short_candidates(rows, rows, 0.92, True).count() < 6000
