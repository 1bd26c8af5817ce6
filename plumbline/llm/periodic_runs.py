"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run is a maximal stretch of words with smallest period q (words q apart are identical) of at least ``LEAST_WORDS``
words and ``REPEATS`` periods. Every word of a run therefore occurs at least ``REPEATS`` times in it, so a word that
occurs less often inside a segment lies in no run of that segment: it splits the segment. What is left is counted again
until no word is too rare; segments too short for a run end there. Most prose is gone after two or three rounds.

The segments that survive are scanned lag by lag, up to a quarter of their length. A run of lag q holds ``REPEATS``
places in a row that are multiples of q from the segment's start, so only these places are compared: about
``m * ln(m)`` comparisons for m words. Places that agree are checked by hashes of the whole stretch, and what passes is
extended to both sides. Lags go up, and a stretch inside a run of a smaller period is a multiple of that period.
The words of every run are compared themselves at the end; hashes that collide send the document through exact codes.

Each document is one task's work, its memory about 200 bytes a word; nothing is shuffled.

Edge cases: null and empty texts have no words and no runs. Rows with a null or repeated doc_id are rows like any
other. Empty tables give empty results. Very long texts are treated whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shared

LEAST_WORDS, REPEATS = 6, 4
PAIRS_AT_ONCE = 1 << 20  # places compared in one step of the lag scan
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 0 of the stretches of equal rows of the columns."""
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.append(0, np.cumsum(new)) if len(columns[0]) else np.empty(0, np.int64)


def split_by_frequency(row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and lengths of the segments in which each word occurs at least ``REPEATS`` times.

    ``row`` is the document of each word, in order. A segment holds every run that its document has in that place.
    """
    at, segment = np.arange(len(word)), _numbered(row)
    starts, lengths = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(at):
        with np.errstate(over="ignore"):
            key = shared.mixed(word[at] + segment.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        frequent = count[which] >= REPEATS
        size = np.bincount(segment)
        stable = np.bincount(segment, weights=frequent, minlength=len(size)) == size
        first = np.cumsum(size) - size
        starts.append(at[first[stable]])
        lengths.append(size[stable])
        open_ = frequent & ~stable[segment]
        at, segment = at[open_], segment[open_]
        segment = _numbered(at - np.arange(len(at)), segment)
        long_enough = (np.bincount(segment) >= LEAST_WORDS)[segment] if len(at) else np.empty(0, bool)
        at, segment = at[long_enough], _numbered(segment[long_enough])
    start, length = np.concatenate(starts), np.concatenate(lengths)
    kept = length >= LEAST_WORDS
    order = np.argsort(start[kept])
    return start[kept][order], length[kept][order]


def scan_lags(word: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lags and places p of the stretches ``p ... p + 3 * lag`` of period lag, at multiples of the lag in each segment."""
    most = length // REPEATS
    lag = np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most) + 1
    start, length = np.repeat(start, most), np.repeat(length, most)
    places = (length - 1) // np.maximum(lag, 1) - (REPEATS - 2)
    total = np.cumsum(places)
    powers = shared._powers(1 << max(6, (len(word) + 1).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.append(np.uint64(0), np.cumsum(word * powers[:len(word)]))
    lags, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    begin = 0
    while begin < len(lag):
        stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS_AT_ONCE, side="right")))
        n = places[begin:stop]
        q = np.repeat(lag[begin:stop], n)
        p = np.repeat(start[begin:stop], n) + q * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        for k in range(REPEATS - 1):
            same = word[p + k * q] == word[p + (k + 1) * q]
            p, q = p[same], q[same]
        with np.errstate(over="ignore"):  # equal stretches have equal hashes
            inner = (sums[p + 2 * q + 1] - sums[p]) * powers[q - 1] == sums[p + 3 * q + 1] - sums[p + q]
        lags.append(q[inner])
        found.append(p[inner])
        begin = stop
    return np.concatenate(lags), np.concatenate(found)


def _extended(word: np.ndarray, place: int, lag: int) -> tuple[int, int]:
    """The maximal stretch of period ``lag`` around ``place ... place + 3 * lag``."""
    begin, size = place, 64
    while begin > 0:
        low = max(0, begin - size)
        differ = np.flatnonzero(word[low:begin] != word[low + lag:begin + lag])
        if len(differ):
            begin = low + int(differ[-1]) + 1
            break
        begin, size = low, 2 * size
    end, size = place + 3 * lag + 1, 64
    while end < len(word):
        high = min(len(word), end + size)
        differ = np.flatnonzero(word[end:high] != word[end - lag:high - lag])
        if len(differ):
            end += int(differ[0])
            break
        end, size = high, 2 * size
    return begin, end


def runs_at(word: np.ndarray, lags: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one document, from the places that the lag scan found in it."""
    runs: list[tuple[int, int, int]] = []
    begins = reach = np.empty(0, np.int64)
    order = np.lexsort((places, lags))
    lags, places = lags[order], places[order]
    first = np.flatnonzero(np.append(True, lags[1:] != lags[:-1])) if len(lags) else np.empty(0, np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(lags)]):
        lag, candidates = int(lags[a]), places[a:b]
        if len(begins):  # inside a run of a smaller period, which divides this lag
            k = np.searchsorted(begins, candidates, side="right")
            candidates = candidates[(k == 0) | (reach[k - 1] <= candidates + 3 * lag)]
        covered, new = -1, False
        for place in candidates.tolist():
            if place + 3 * lag < covered:
                continue
            begin, covered = _extended(word, place, lag)
            if covered - begin >= max(LEAST_WORDS, REPEATS * lag):
                runs.append((begin, covered - begin, lag))
                new = True
        if new:
            spans = np.array(sorted((a, a + n) for a, n, _ in runs), dtype=np.int64)
            begins, reach = spans[:, 0], np.maximum.accumulate(spans[:, 1])
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _searched(row: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Rows with runs, and these runs, of a sequence of documents."""
    lags, places = scan_lags(word, *split_by_frequency(row, word))
    owners = row[places]
    order = np.argsort(owners, kind="stable")
    for which in np.split(order, np.flatnonzero(np.diff(owners[order])) + 1):
        if len(which):
            r = int(owners[which[0]])
            a, b = np.searchsorted(row, [r, r + 1])
            runs = runs_at(word[a:b], lags[which], places[which] - a)
            if runs:
                yield r, runs


def runs_of_words(words: list[bytes]) -> list[tuple[int, int, int]]:
    """Runs of one document, its words compared by codes that are exact."""
    codes: dict[bytes, int] = {}
    with np.errstate(over="ignore"):
        code = shared.mixed(np.array([codes.setdefault(w, len(codes)) for w in words], dtype=np.uint64) + np.uint64(1))
    return next((runs for _, runs in _searched(np.zeros(len(words), np.int64), code)), [])


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change)[:len(words)] == 0)]


def _searched_texts(texts: pa.Array) -> tuple[np.ndarray, list, list[bytes]]:
    """Word counts, runs and collapsed texts of a text column without nulls."""
    words = shared.words_of(texts)
    found = dict(_searched(words.row, words.hash))
    counts, runs, kept = np.diff(words.first), [], []
    for r, text in enumerate(texts):
        split = text.as_buffer().to_pybytes().split()  # bytes split at exactly the blanks [\\x20\\x09-\\x0D]
        mine = found.get(r, [])
        if any(split[a:a + n - q] != split[a + q:a + n] for a, n, q in mine):  # two words share a hash
            mine = runs_of_words(split)
        runs.append([{"start": a, "length": n, "period": q} for a, n, q in mine])
        kept.append(b" ".join(collapsed(split, mine) if mine else split))
    return counts, runs, kept


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the collapsed text per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shared.pieces(batch, "text"):
                counts, runs, kept = _searched_texts(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(runs, RUNS), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCHEMA)
