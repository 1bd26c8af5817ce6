"""Substring de-duplication with difference-cover anchors.

A window is ``WINDOW`` consecutive words; a window that also starts in a document with a smaller doc_id goes, with
all words it covers. To find such windows without hashing each position against all others, only anchors are
compared first: runs of ``ANCHOR`` words at positions whose remainder modulo ``PERIOD`` is in a difference cover.
For any two places of a repeated window some shift inside the window puts both on the cover, so every repeated
window holds an anchor that occurs in both documents. Anchors that occur in one document only, nearly all, end there.
The others go into a bit table of fixed size; it lets no shared anchor through unseen, and what it lets through by
chance is settled next. Windows around shared anchors are extended: all of them are compared by their 96-bit hash,
the smallest doc_id of each wins, and the windows of the others are merged into spans.

Texts of equal words are settled beforehand: all but the one with the smallest doc_id lose everything, and only that
one is searched. Before a shuffle, each task reduces its windows piece by piece: where a smaller document of the same piece has the window,
the removal is settled on the spot, so a passage that a third of all documents share reaches the shuffle once per piece.
A window is judged on the input texts, whatever else goes.

Edge cases: null texts have no words. A row with a null doc_id keeps all words and removes none elsewhere. Rows that
share a doc_id do not remove each other's words; they are told apart by their text. Empty tables give empty results.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import shared

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)  # every remainder modulo 7 is a difference of two of these
ANCHOR = WINDOW - PERIOD + 1
ANCHOR_BITS = 27  # of the bit table of shared anchors
DOCUMENT_BITS = 26  # of the tables of documents
FLUSH_BYTES = 12 << 20  # of text that a task reduces before it hands rows on
POSITION_BITS = 40  # of a place; above them lie bits of the text's hash


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _first_of_runs(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _anchors(words: shared.Words) -> tuple[np.ndarray, np.ndarray]:
    """First words and 48-bit hashes of the runs at cover positions."""
    first, value = words.windows(ANCHOR, seed=1)
    place = first - words.first[words.row[first]]
    on = np.isin(place % PERIOD, COVER)
    return first[on], value[on] >> np.uint64(16)


def _doc_bit():
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << DOCUMENT_BITS)).alias("bit")


def document_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, a, b, n_words, words_sha256) per row of ``docs``; a and b sign the sequence of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shared.pieces(batch, "text"):
                words = shared.words_of(part.column("text"))
                a, b = (signature(words, len(part), seed) for seed in (1, 2))
                digests = [hashlib.sha256(b" ".join(t.as_buffer().to_pybytes().split())).hexdigest() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array((a >> np.uint64(44)).astype(np.int64)), shared.signed(a), shared.signed(b),
                     pa.array(np.diff(words.first).astype(np.int64)), pa.array(digests, pa.string())],
                    names=["doc_id", "tag", "a", "b", "n_words", "words_sha256"])

    return shared.written(_texts(docs).mapInArrow(run, "doc_id long, tag long, a long, b long, n_words long, words_sha256 string"))


def signature(words: shared.Words, n: int, seed: int) -> np.ndarray:
    """64 bits that sign the sequence of words of each row."""
    total = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        if len(words.hash):
            place = (np.arange(len(words.hash)) - words.first[words.row]).astype(np.uint64)
            filled = np.flatnonzero(np.diff(words.first))
            total[filled] = np.add.reduceat(shared.mixed(words.hash + place * np.uint64(0x9E3779B97F4A7C15 + 2 * seed)), words.first[filled])
        return shared.mixed(total + np.uint64(seed))


def _originals(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Parts of about FLUSH_BYTES of the batches, without most of the rows whose bit is off."""
    for batch in batches:
        yield from shared.pieces(batch.filter(pa.array(shared.bits_on(table, batch.column("bit").to_numpy()))), "text", FLUSH_BYTES)


def shared_anchors(docs: DataFrame, originals: np.ndarray) -> DataFrame:
    """(anchor) of every anchor that occurs under more than one doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _originals(batches, originals):
            found, owners = [], []
            for part in shared.pieces(batch, "text"):
                words = shared.words_of(part.column("text"))
                first, value = _anchors(words)
                found.append(value)
                owners.append(part.column("doc_id").to_numpy()[words.row[first]])
            anchor, owner = np.concatenate(found), np.concatenate(owners)
            order = np.lexsort((owner, anchor))
            anchor, owner = anchor[order], owner[order]
            first = _first_of_runs(anchor)
            low, high = owner[first], owner[np.append(first[1:], len(anchor))[:len(first)] - 1]
            yield pa.RecordBatch.from_arrays(
                [shared.signed(np.append(anchor[first], anchor[first][low != high])), pa.array(np.append(low, high[low != high]))], names=["anchor", "doc_id"])

    rows = _texts(docs.where("doc_id IS NOT NULL")).select("*", _doc_bit()).mapInArrow(run, "anchor long, doc_id long")
    return rows.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")


def removals(docs: DataFrame, originals: np.ndarray) -> DataFrame:
    """(doc_id, tag, places) of the windows that go: the places of their first words, per text."""
    table = shared.bit_table(shared_anchors(docs, originals).select(F.pmod("anchor", F.lit(1 << ANCHOR_BITS)).alias("bit")), ANCHOR_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _originals(batches, originals):
            columns: list[list[np.ndarray]] = [[] for _ in range(4)]
            for part in shared.pieces(batch, "text"):
                words = shared.words_of(part.column("text"))
                anchors, value = _anchors(words)
                hit = np.zeros(len(words.hash) + WINDOW, dtype=np.int32)
                hit[anchors] = shared.bits_on(table, (value & np.uint64((1 << ANCHOR_BITS) - 1)).astype(np.int64))
                before = np.append(0, np.cumsum(hit))
                first, w1 = words.windows(WINDOW, seed=2)
                chosen = np.flatnonzero(before[first + PERIOD] > before[first])  # a shared anchor lies inside the window
                _, w2 = words.windows(WINDOW, seed=3)
                first = first[chosen]
                row = words.row[first]
                tags = (signature(words, len(part), 1) >> np.uint64(44)).astype(np.int64)
                for c, x in zip(columns, (w1[chosen], w2[chosen] >> np.uint64(32), part.column("doc_id").to_numpy()[row],
                                          (tags[row] << POSITION_BITS) | (first - words.first[row]))):
                    c.append(x)
            w1, w2, doc, at = map(np.concatenate, columns)
            order = np.lexsort((doc, w2, w1))
            w1, w2, doc, at = (x[order] for x in (w1, w2, doc, at))
            starts = _first_of_runs(w1, w2)
            known = doc != np.repeat(doc[starts], np.diff(np.append(starts, len(doc))))
            with np.errstate(over="ignore"):  # settled rows need not meet: they are dealt out evenly
                w1 = np.where(known, shared.mixed(doc.astype(np.uint64) * np.uint64(31) + at.astype(np.uint64)), w1)
            yield pa.RecordBatch.from_arrays(
                [shared.signed(w1), pa.array(w2.astype(np.int64)), pa.array(doc), pa.array(at.astype(np.int64)), pa.array(known)],
                names=["w1", "w2", "doc_id", "at", "known"])

    texts = _texts(docs.where("doc_id IS NOT NULL")).select("*", _doc_bit())
    found = texts.mapInArrow(run, "w1 long, w2 long, doc_id long, at long, known boolean")
    least = F.min(F.when(~F.col("known"), F.col("doc_id"))).over(Window.partitionBy("w1", "w2"))
    gone = found.withColumn("least", least).where("known OR doc_id > least")
    place = F.col("at").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    return shared.written(
        gone.select("doc_id", F.shiftright("at", POSITION_BITS).alias("tag"), place.alias("place"))
        .groupBy("doc_id", "tag").agg(F.collect_list("place").alias("places")))


def kept_words(text: bytes, places: np.ndarray) -> tuple[int, list[bytes]]:
    """Number of words, and the words that no window starting at ``places`` covers."""
    words = text.split()  # bytes split at exactly the blanks [\\x20\\x09-\\x0D]
    change = np.zeros(len(words) + WINDOW + 1, dtype=np.int32)
    np.add.at(change, places, 1)
    np.add.at(change, places + WINDOW, -1)
    covered = np.cumsum(change)[:len(words)] > 0
    return len(words), [words[i] for i in np.flatnonzero(~covered)]


def changed_texts(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, tag, n_removed, kept_text) of the texts that lose some words."""
    table = shared.bit_table(gone.select(_doc_bit()), DOCUMENT_BITS)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _originals(batches, table):
            tags = signature(shared.words_of(part.column("text")), len(part), 1) >> np.uint64(44)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tags.astype(np.int64)), part.column("text")], names=["doc_id", "tag", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shared.pieces(batch, "text"):
                counts, texts = [], []
                for text, places in zip(part.column("text"), part.column("places")):
                    n, kept = kept_words(text.as_buffer().to_pybytes(), np.asarray(places.values, dtype=np.int64))
                    counts.append(n - len(kept))
                    texts.append(b" ".join(kept).decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tag"), pa.array(counts, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "tag", "n_removed", "kept_text"])

    texts = _texts(docs.where("doc_id IS NOT NULL")).select("*", _doc_bit()).mapInArrow(candidates, "doc_id long, tag long, text string")
    return texts.join(gone, ["doc_id", "tag"]).mapInArrow(cut, "doc_id long, tag long, n_removed long, kept_text string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row of ``docs``."""
    rows = document_rows(docs)
    long_enough = (F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull()
    # written first: the join then has plain exchanges, and a group with a third of all rows can be split
    firsts = shared.written(
        rows.where(long_enough).groupBy("a", "b").agg(F.min("doc_id").alias("first")).withColumnsRenamed({"a": "fa", "b": "fb"}))
    marked = rows.join(firsts, (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb")) & long_enough, "left").withColumn(
        "copy", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))).drop("fa", "fb")
    originals = shared.bit_table(firsts.select(F.col("first").alias("doc_id")).select(_doc_bit()), DOCUMENT_BITS)
    changed = changed_texts(docs, removals(docs, originals)).select(
        F.col("doc_id").alias("cd"), F.col("tag").alias("ct"), "n_removed", F.sha2("kept_text", 256).alias("changed_sha256")).dropDuplicates(["cd", "ct"])
    nothing = hashlib.sha256(b"").hexdigest()
    return marked.join(changed, (F.col("doc_id") == F.col("cd")) & (F.col("tag") == F.col("ct")), "left").select(
        "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), nothing).otherwise(F.coalesce("changed_sha256", "words_sha256")).alias("kept_sha256"))
