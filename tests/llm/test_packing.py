"""Packing: pieces against the tokenizers library, sequences against the packing rules and a lower bound."""

import zlib

import numpy as np
import pandas as pd
import pytest
from plumbline.llm import packing, queries

SF = "/root/testdata/sf0.001"


def expected_pieces(rows, path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    out = []
    for doc_id, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        start = 0
        for piece, n in enumerate(packing.cut_lengths(len(ids))):
            out.append((doc_id, piece, start, n, zlib.crc32(ids[start:start + n].tobytes())))
            start += n
    return sorted(out, key=str)


def check_sequences(table: pd.DataFrame):
    for _, g in table.sort_values("offset").groupby("sequence_id"):
        ends = g["offset"] + g["length"]
        assert g["offset"].iloc[0] == 0 and ends.iloc[-1] <= packing.SEQUENCE
        assert (g["offset"].iloc[1:].to_numpy() == ends.iloc[:-1].to_numpy()).all()


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op3_best_fit_packing"](spark, SF).toPandas()
    want = expected_pieces([(r.doc_id, r.text) for r in docs.collect()], queries.tokenizer_path())
    assert sorted(got[list(packing.OUT[:5])].itertuples(index=False, name=None), key=str) == want
    check_sequences(got)
    assert got["sequence_id"].nunique() <= 1.02 * got["length"].sum() / packing.SEQUENCE + 1


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "same"), (3, "same"), (4, "word " * 5000), (5, " " * 3000), (6, "<|endoftext|> x")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, length string, no int")
    got = packing.packed_documents(frame, queries.tokenizer_path("byte_bpe_50k.tiktoken")).toPandas()
    got["doc_id"] = got["doc_id"].astype(object).where(got["doc_id"].notna(), None)
    want = expected_pieces(rows, queries.tokenizer_path())
    rounded = [(None if a is None else int(a), *map(int, rest)) for a, *rest in got[list(packing.OUT[:5])].itertuples(index=False, name=None)]
    assert sorted(rounded, key=str) == want
    check_sequences(got)
    assert packing.packed_documents(frame.limit(0), queries.tokenizer_path("byte_bpe_50k.tiktoken")).count() == 0


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 20)
    got = queries.QUERIES["op3_best_fit_packing"](spark, SF).toPandas()
    check_sequences(got)
    assert got["sequence_id"].nunique() <= 1.15 * got["length"].sum() / packing.SEQUENCE + 1


@pytest.mark.parametrize("low,high", [(1, 1024), (300, 400), (1, 200), (500, 530)])
def test_search_improves_squared_fill(low, high):
    lengths = np.random.default_rng(1).integers(low, high, 3000)
    bins = packing.Bins(lengths, 1024)
    squares = lambda: sum((1024 - f) ** 2 for f in bins.free)
    before, used = squares(), sum(map(bool, bins.items))
    bins.search()
    assert squares() >= before and sum(map(bool, bins.items)) <= used
    assert sorted(i for items in bins.items for i in items) == list(range(3000))
    assert all(sum(lengths[i] for i in items) + free == 1024 for items, free in zip(bins.items, bins.free))


def test_few_distinct_lengths():
    lengths = np.array([400] * 2000 + [300] * 4000)
    sequence, _, _ = packing.pack(lengths)
    assert len(set(sequence)) == 2000


def allowed_step(bins):
    """A move, one-for-one or two-for-one exchange that raises the sum of squared fills, by trying all."""
    for a, mine in enumerate(bins.items):
        gives = {bins.length[i] for i in mine} | {bins.length[i] + bins.length[j] for k, i in enumerate(mine) for j in mine[k + 1:]}
        for b, other in enumerate(bins.items):
            for d in {g - t for g in gives for t in (0, *(bins.length[i] for i in other))} if a != b and mine and other else ():
                if 0 < d <= bins.free[b] and d > bins.free[b] - bins.free[a]:
                    return a, b, d
    return None


@pytest.mark.parametrize("lengths", [[400] * 20 + [300] * 40, [310, 353, 401] * 30, list(range(300, 400)), list(range(1, 1000, 9)), [511, 2, 512, 513] * 9])
def test_search_ends_without_an_allowed_step(lengths):
    bins = packing.Bins(np.array(lengths), 1024)
    bins.search()
    assert allowed_step(bins) is None
    assert sorted(i for items in bins.items for i in items) == list(range(len(lengths)))
