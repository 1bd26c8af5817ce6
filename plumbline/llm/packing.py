"""Best-fit packing of documents into sequences of fixed length, improved by a swap-based local search.

A document is its token ids and an end id. Documents longer than a sequence are cut into full sequences; what is
left over comes first. Full pieces are sequences of their own; all others are packed. Pieces are dealt by hash into
blocks of bounded size, and each block is packed in one task: best fit, longest first, then a local search that
empties the emptiest sequences. It moves a piece, exchanges one piece for a shorter one of another sequence, or two
pieces for one that is shorter than both together. Every step that makes the sum of squared fills larger is allowed,
and the search ends when no sequence of the block has one; an emptied sequence is gone. Sequences that stay loose at the end of a block
are dealt anew, into fewer blocks, with those of other blocks, until one block is left or nothing gets tighter.

The ids come from the byte-level BPE vocabulary at ``path``: a ``.json`` file is read by tokenizers, a ``.tiktoken``
file (the same vocabulary as ranks, several times faster) by tiktoken. Both give the same ids.

Edge cases: null and empty texts are one end id. Rows that repeat are packed each. A null doc_id is passed on. Empty
tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shared

SEQUENCE = 1024
END_ID = 2
BLOCK = 16_384
LOOSE = 0.97  # sequences filled less are dealt anew while there are several blocks
OUT = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@functools.cache
def encoder(path: str):
    """Function from text to token ids."""
    if not path.endswith(".tiktoken"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    exact = None

    def encode(text: str):
        nonlocal exact
        try:
            return encoding.encode(text, allowed_special="all")
        except (ValueError, RuntimeError):  # its pattern matcher gives up on extreme runs of white space
            exact = exact or encoder(path.removesuffix(".tiktoken") + ".json")
            return exact(text)

    return encode


def cut_lengths(n: int, size: int = SEQUENCE) -> list[int]:
    """Lengths of a document's pieces: only the first may be short."""
    if n <= size:
        return [n]
    return [n % size] * (n % size > 0) + [size] * (n // size)


def token_pieces(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, no) per piece, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.array([*encode(text.as_py() or ""), END_ID], dtype="<u4")
                start = 0
                for piece, length in enumerate(cut_lengths(len(ids))):
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[start:start + length].tobytes())))
                    start += length
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(OUT[:5]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return shared.written(rows.withColumn("no", F.monotonically_increasing_id()))


def _spread(bits: int, low: int, high: int) -> int:
    """All sums of a bit's number and one of low..high."""
    width, left = 1, high - low + 1
    while 2 * width <= left:
        bits |= bits << width
        width *= 2
    return (bits | bits << (left - width)) << low


class Bins:
    """Sequences under construction, indexed by what is free in them and by the lengths they hold."""

    def __init__(self, lengths: np.ndarray, size: int):
        self.length = lengths.tolist()
        self.size = size
        self.items: list[list[int]] = []
        self.free: list[int] = []
        self._best_fit()
        self.holders: dict[tuple[int, int], set[int]] = defaultdict(set)  # (free, length) -> sequences; length 0: all
        self.held: dict[int, int] = defaultdict(int)  # free -> bits of the lengths in holders
        self.reach: dict[int, int] = {}  # free -> bits of the lengths that can be given for one of held
        self.clock = 0
        self.stamp: dict[int, int] = defaultdict(int)  # free -> time a sequence last came to it
        self.failed = [-1] * len(self.items)  # time a sequence last found no step; -1 after a change
        for b in range(len(self.items)):
            self._index(b)

    def _best_fit(self):
        at_free: list[list[int]] = [[] for _ in range(self.size + 1)]
        mask = 0  # bit r: some sequence has r free
        for i in sorted(range(len(self.length)), key=self.length.__getitem__, reverse=True):
            need = self.length[i]
            fits = mask >> need
            if fits:
                r = need + (fits & -fits).bit_length() - 1
                b = at_free[r].pop()
                if not at_free[r]:
                    mask &= ~(1 << r)
                self.items[b].append(i)
            else:
                r, b = self.size, len(self.items)
                self.items.append([i])
                self.free.append(0)
            self.free[b] = r - need
            if r > need:
                at_free[r - need].append(b)
                mask |= 1 << (r - need)

    def _index(self, b: int, on: bool = True):
        r = self.free[b]
        if not r or not self.items[b]:
            return
        for held in {0, *(self.length[i] for i in self.items[b])}:
            found = self.holders[r, held]
            (found.add if on else found.discard)(b)
            bit = 1 << held
            self.held[r] = self.held[r] | bit if found else self.held[r] & ~bit
        self.reach.pop(r, None)

    def _exchange(self, donor: int, give: list[int], target: int, take: list[int]):
        """Exchanges pieces; the donor is not in the index."""
        self._index(target, False)
        moved = sum(self.length[i] for i in give) - sum(self.length[i] for i in take)
        self.items[donor] = [i for i in self.items[donor] if i not in give] + take
        self.items[target] = [i for i in self.items[target] if i not in take] + give
        self.free[donor] += moved
        self.free[target] -= moved
        self._index(target)
        self.clock += 1
        for b in (donor, target):
            self.failed[b] = -1
            self.stamp[self.free[b]] = self.clock

    def _found(self, donor: int) -> tuple[list[int], int, list[int]] | None:
        """(pieces to give, target, pieces to take) of a step that raises the sum of squared fills; None if there is none.

        To move d tokens into a sequence with r free raises the sum if d <= r and d > r - free of the donor. What a donor
        that found nothing has seen is not looked at again.
        """
        mine = self.free[donor]
        piece = {self.length[i]: i for i in self.items[donor]}
        twice = {}
        for i in self.items[donor]:
            if i != piece[self.length[i]]:
                twice[self.length[i]] = i
        rooms = [r for r, held in self.held.items() if held and self.stamp[r] > self.failed[donor]]
        rooms.sort(key=lambda r: (r > mine, -r))
        one = sum(1 << n for n in piece)
        both = one
        for n in piece:
            both |= (one >> n + 1 << n + 1 | (1 << n if n in twice else 0)) << n

        def step(gives: int, r: int, d: int):
            hit = gives & (self.held[r] << d)
            whole = hit.bit_length() - 1
            if whole in piece:
                give = [piece[whole]]
            else:
                a = next(n for n in piece if whole - n in piece and (2 * n != whole or n in twice))
                give = [piece[a], twice[a] if 2 * a == whole else piece[whole - a]]
            b = next(iter(self.holders[r, whole - d]))
            return give, b, [next(i for i in self.items[b] if self.length[i] == whole - d)] if whole > d else []

        for n in sorted(piece, reverse=True):  # move
            r = min((r for r in rooms if r >= n > r - mine), default=None)
            if r is not None:
                return [piece[n]], next(iter(self.holders[r, 0])), []
        for gives in (one, both):  # exchanges that fill a sequence to the brim
            for r in rooms:
                if gives & (self.held[r] << r):
                    return step(gives, r, r)
        for r in rooms:  # all others, most tokens first
            least = max(1, r - mine + 1)
            if least == 1:
                if r not in self.reach:
                    self.reach[r] = _spread(self.held[r], 1, r)
                reach = self.reach[r]
            else:
                reach = _spread(self.held[r], least, r)
            if both & reach:
                return step(both, r, next(d for d in range(r, 0, -1) if both & (self.held[r] << d)))
        return None

    def search(self):
        """Steps until no sequence has one."""
        changed = True
        while changed:
            changed = False
            for donor in sorted((b for b in range(len(self.items)) if self.free[b]), key=self.free.__getitem__, reverse=True):
                while self.items[donor] and self.free[donor]:
                    self._index(donor, False)
                    found = self._found(donor)
                    if found:
                        self._exchange(donor, *found)
                        changed = True
                    else:
                        self.failed[donor] = self.clock
                    self._index(donor)
                    if not found:
                        break


def pack(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, offset in it, and fill of it for every length."""
    bins = Bins(lengths, size)
    bins.search()
    sequence, offset, fill = (np.zeros(len(lengths), dtype=np.int64) for _ in range(3))
    for b, items in enumerate(bins.items):
        at = 0
        for i in items:
            sequence[i], offset[i], at = b, at, at + bins.length[i]
        fill[items] = at
    return sequence, offset, fill


def pack_round(pieces: DataFrame, blocks: int, number: int) -> DataFrame:
    """Packs each block of ``pieces``; adds sequence_id, offset and whether the sequence is loose."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("no")
        sequence, offset, fill = pack(block["length"].to_numpy())
        first = (number << 52) + (block["block"][0].as_py() << 20)
        for name, values in (("sequence_id", first + sequence), ("offset", offset), ("loose", fill < LOOSE * SEQUENCE)):
            block = block.append_column(name, pa.array(values))
        return block

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("no", F.lit(number)), F.lit(blocks)).cast("long"))
    schema = f"{', '.join(f'{n} {t}' for n, t in dealt.dtypes)}, sequence_id long, offset long, loose boolean"
    return shared.written(dealt.groupBy("block").applyInArrow(run, schema))


def packed_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece."""
    pieces = token_pieces(docs, path)
    full = F.col("length") == SEQUENCE
    result = pieces.where(full).withColumns({"sequence_id": -1 - F.col("no"), "offset": F.lit(0).cast("long")}).select(*OUT)
    rest = pieces.where(~full)
    count, number = rest.count(), 0
    while True:
        blocks = -(-count // BLOCK) or 1
        packed = pack_round(rest, blocks, number)
        left = packed.where("loose").count() if blocks > 1 else 0
        again = 0 < left < 0.9 * count
        result = result.unionByName((packed.where("not loose") if again else packed).select(*OUT))
        if not again:
            return result
        rest, count, number = packed.where("loose").drop("block", "sequence_id", "offset", "loose"), left, number + 1
