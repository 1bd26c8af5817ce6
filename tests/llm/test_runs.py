"""Periodic runs against a definition read literally."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plumbline.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """Stretches of each period, longest possible, that no smaller period explains."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                s = w[i:j + q]
                if not any(s[d:] == s[:-d] for d in range(1, q)):
                    out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    gone = {k for a, n, q in runs for k in range(a + q, a + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def planted(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def expected_row(doc_id, text):
    w = planted(doc_id, text)
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *top, digest("".join(f"{a},{n},{q}\n" for a, n, q in runs)), digest(brute_collapsed(w, runs)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), max_size=6))
def test_runs_of_small_alphabets(documents):
    _, runs, kept = periodic_runs._searched_texts(pa.array([" ".join(d) for d in documents], pa.string()))
    for words, found, text in zip(documents, runs, kept):
        want = brute_runs(words)
        assert [(r["start"], r["length"], r["period"]) for r in found] == want
        assert text.decode() == brute_collapsed(words, want)
        assert periodic_runs.runs_of_words([w.encode() for w in words]) == want


@pytest.mark.parametrize("seed", range(30))
def test_nested_and_neighbouring_runs(seed):
    """Blocks repeated a few times, some of them themselves repeated, joined by other words and by nothing."""
    rng = random.Random(seed)
    words = []
    for _ in range(rng.randint(1, 8)):
        block = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))] * rng.choice((1, 1, 2, 5))
        words += (block * rng.randint(1, 9))[:rng.randint(1, 300)] + [f"u{rng.random()}"] * rng.randint(0, 2)
    _, runs, _ = periodic_runs._searched_texts(pa.array([" ".join(words)]))
    assert [(r["start"], r["length"], r["period"]) for r in runs[0]] == brute_runs(words)


def test_long_text_takes_time_in_proportion():
    """One word 300,000 times, and a stretch of 40,000 words four times over."""
    base = [str(k * k % 39_989) for k in range(40_000)]
    _, runs, kept = periodic_runs._searched_texts(pa.array(["a " * 300_000, " ".join(base * 4)]))
    assert [[tuple(r.values()) for r in found] for found in runs][0] == [(0, 300_000, 1)]
    assert (0, 160_000, 40_000) in [tuple(r.values()) for r in runs[1]]
    assert kept[0] == b"a"


def test_splitting_keeps_every_run_whole():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 40, 3_000).astype(np.uint64)
    words[500:600] = np.tile(np.arange(1000, 1020, dtype=np.uint64), 5)
    starts, lengths = periodic_runs.split_by_frequency(np.zeros(len(words), np.int64), words)
    assert any(a <= 500 and a + n >= 600 for a, n in zip(starts, lengths))
    for a, n in zip(starts, lengths):
        assert n >= 6 and np.unique(words[a:a + n], return_counts=True)[1].min() >= 4


def test_colliding_hashes_are_noticed(monkeypatch):
    """With hashes that confuse words the words themselves decide."""
    honest = periodic_runs.shared.words_of

    def confused(texts):
        words = honest(texts)
        words.hash[:] = words.hash & np.uint64(1)
        return words

    monkeypatch.setattr(periodic_runs.shared, "words_of", confused)
    text = " ".join(random.Random(5).choice("abcdefg") for _ in range(400)) + " x y" * 9
    _, runs, _ = periodic_runs._searched_texts(pa.array([text]))
    assert [(r["start"], r["length"], r["period"]) for r in runs[0]] == brute_runs(text.split())


EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "go " * 5), (6, "go " * 6), (6, "go " * 6), (None, "a b " * 4), (None, None),
        (7, "a b\x0bc a b c " * 9), (8, "x" * 50_000 + " y" * 7), (35, "plant some words here " * 40), (-7, "é è " * 300)]


def test_edge_cases_and_clashing_columns(spark):
    docs = spark.createDataFrame([(*r, 1, "k", [2], 3) for r in EDGE], "doc_id long, text string, n_words int, collapsed string, runs array<int>, h int")
    got = sorted((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(docs.where("doc_id IS NOT NULL")).collect())
    want = []
    for d, t in EDGE:
        w = WORD.findall(t or "")
        if d is not None:
            want.append((d, len(w), brute_runs(w), brute_collapsed(w, brute_runs(w))))
    assert got == sorted(want)
    assert periodic_runs.periodic_runs(docs).count() == len(EDGE)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_query_matches_brute_force(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    want = sorted(expected_row(d, t) for d, t in zip(docs["doc_id"], docs["text"]))
    got = sorted(tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect())
    assert got == want
    assert any(r[1] for r in got)


def test_planting_on_edge_cases(spark):
    ids = [i for i in range(3_000) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = [None, "", " ", "a", "a b", "a\tb  c", " ".join(map(str, range(97)))]
    rows = [(i, texts[k % len(texts)]) for k, i in enumerate(ids)] + [(None, "a b c"), (1, " raw  text ")]
    for row in queries.with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if row["doc_id"] in ids:
            assert (row["text"] or "").split() == planted(row["doc_id"], dict(rows)[row["doc_id"]])
        else:
            assert row["text"] in ("a b c", " raw  text ")
