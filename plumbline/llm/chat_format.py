"""Chat formatting with loss masks that are aligned by offsets.

A conversation is rendered as a whole, turn after turn: ``<|turn|>role<|text|>text<|end|>``. The rendering is
encoded once; the encoder returns the span of characters of every token. The spans of the assistants' texts are
sorted, so one binary search per token tells whether the token lies inside one: those tokens carry loss.

Control strings are special tokens of the encoder, so no token crosses the border of a text. Control strings that
occur inside a role or text (this template's and those of other common templates) are escaped: a backslash goes
between their first and second character, and a backslash is doubled. Dropping the backslash before each escaped
character restores the text exactly.

Turns are dealt by ranges of (conversation, turn), so a long conversation lies in several tasks, in order. What one task
holds of a conversation, up to ``SEGMENT_CHARS``, is a segment: rendered and encoded on its own, which changes nothing,
since segments are cut between turns. So memory is bounded by a segment and no task holds a whole hot conversation.
Reading back finishes the conversations that lie inside a task; of those that reach a task's border the texts go on, once,
to be digested in order.

The vocabulary at ``tokenizer_path`` is a ``.json`` file, read by tokenizers, or a ``.tiktoken`` file (the same vocabulary
as ranks, several times faster), whose token spans follow from the tokens' lengths in bytes. Both give the same tokens.

Edge cases: null role or text is empty text; a turn without text is a turn with nothing under the mask. Turns sort
by turn (null first), then role, then text, so repeated rows keep a defined order and all count. A null conv_id is
a conversation of its own. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shared

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Control strings that are escaped inside texts.
CONTROL = (
    TURN, TEXT, END, "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
LOSS_ROLE = "assistant"
SEGMENT_CHARS = 1 << 20
MOST_WAITING = 8  # segments of a conversation that a task holds until it knows where it ends
FORMATTED = "conv_id long, part int, segment int, n_turns long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"

_ESCAPED = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_TURNS = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.S)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\\\" if m.group() == "\\" else m.group() + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@functools.cache
def span_encoder(path: str):
    """Function from text to token ids, starts and ends (in characters); the template's marks are special tokens.

    A character that several tokens share lies in the spans of all of them.
    """
    if not path.endswith(".tiktoken"):
        from tokenizers import Tokenizer, processors

        tokenizer = Tokenizer.from_file(path)
        tokenizer.add_special_tokens([TURN, TEXT, END])
        tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)

        def encode(text: str):
            code = tokenizer.encode(text, add_special_tokens=False)
            offsets = np.fromiter(itertools.chain.from_iterable(code.offsets), np.int32, 2 * len(code.ids)).reshape(-1, 2)
            return np.array(code.ids, dtype=np.int32), offsets[:, 0], offsets[:, 1]

        return encode
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    end_of_text = max(ranks.values()) + 1  # the vocabulary's own special token comes before the template's
    marks = {mark: end_of_text + 1 + k for k, mark in enumerate((TURN, TEXT, END))}
    encoding = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=marks)
    size = np.zeros(max(marks.values()) + 1, dtype=np.int64)
    for token, number in [*ranks.items(), *((mark.encode(), k) for mark, k in marks.items())]:
        size[number] = len(token)
    exact = None

    def encode_fast(text: str):
        nonlocal exact
        try:
            ids = np.array(encoding.encode(text, allowed_special=set(marks), disallowed_special=()), dtype=np.int32)
        except (ValueError, RuntimeError):  # its pattern matcher gives up on extreme runs of white space
            exact = exact or span_encoder(path.removesuffix(".tiktoken") + ".json")
            return exact(text)
        after = np.cumsum(size[ids])
        character = np.cumsum((np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80) - 1  # of each byte
        return ids, character[after - size[ids]].astype(np.int32), (character[after - 1] + 1).astype(np.int32)

    return encode_fast


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendering of turns and the spans of the texts under the mask, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{END}")
        at += len(parts[-1])
    return "".join(parts), spans


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token lies inside one of the sorted spans."""
    if not spans:
        return np.zeros(len(starts), dtype=bool)
    opens, closes = np.array(spans).T
    at = np.searchsorted(opens, starts, side="right") - 1
    return (at >= 0) & (ends <= closes[np.maximum(at, 0)]) & (ends > starts)


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    """A list column straight from arrays."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts) if parts else np.empty(0), kind))


def format_conversations(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """Segments of formatted conversations: rendering, token ids, token spans and loss mask.

    (part, segment) orders the segments of a conversation; a task's segments come out in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = span_encoder(tokenizer_path), TaskContext.get().partitionId()
        current, segment, turns, size, rows = None, 0, [], 0, []

        def close():
            nonlocal turns, size, segment
            text, spans = render(turns)
            ids, starts, ends = encode(text)
            rows.append((current, segment, len(turns), text, ids, starts, ends, loss_mask(starts, ends, spans)))
            segment, turns, size = segment + 1, [], 0

        def flush():
            conv, number, n, text, *lists = zip(*rows) if rows else [[]] * 8
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(conv, pa.int64()), pa.array([part] * len(conv), pa.int32()), pa.array(number, pa.int32()), pa.array(n, pa.int64()), pa.array(text, pa.string()),
                 *(_lists(list(x), kind) for x, kind in zip(lists, (pa.int32(), pa.int32(), pa.int32(), pa.bool_())))],
                names=["conv_id", "part", "segment", "n_turns", "formatted", "ids", "starts", "ends", "loss"])

        started, waiting = False, 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if started and (conv != current or size > SEGMENT_CHARS):
                    close()
                    waiting += len(rows[-1][3])
                if not started or conv != current:
                    current, segment, started = conv, 0, True
                turns.append((role, text))
                size += len(text)
                if len(rows) >= 200 or waiting > SEGMENT_CHARS:
                    yield flush()
                    waiting = 0
        if started:
            close()
        yield flush()

    ordered = (
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("conv_id", "turn", "role", F.xxhash64("text")).sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return ordered.mapInArrow(run, FORMATTED)


def _texts_of_segments(batch: pa.RecordBatch) -> Iterator[tuple[str, str, int, int]]:
    """Per segment: its turns as role, line feed, text, line feed; the text under the mask; turns; characters."""
    lists = [batch.column(c) for c in ("starts", "ends", "loss")]
    bounds = lists[0].offsets.to_numpy()
    starts, ends, loss = (x.values.to_numpy(zero_copy_only=False) for x in lists)
    for k, text in enumerate(batch.column("formatted").to_pylist()):
        turns = _TURNS.findall(text)
        said = "".join(f"{unescape(role)}\n{unescape(body)}\n" for role, body in turns)
        on = loss[bounds[k]:bounds[k + 1]].astype(bool)
        opens, closes = starts[bounds[k]:bounds[k + 1]][on], ends[bounds[k]:bounds[k + 1]][on]
        pieces = []
        if len(opens):
            # tokens of one text touch or overlap (a character may be split over tokens); a gap begins another text
            new_run = np.flatnonzero(np.append(True, opens[1:] > closes[:-1]))
            pieces = [unescape(text[a:b]) for a, b in zip(opens[new_run].tolist(), np.maximum.reduceat(closes, new_run).tolist())]
        yield said, "".join(pieces), len(turns), len(text)


class _Digest:
    """What is read back of one conversation, segment by segment."""

    def __init__(self):
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, said: str, loss: str, n: int, chars: int) -> None:
        self.turns.update(said.encode())
        self.loss.update(loss.encode())
        self.n, self.loss_chars, self.chars = self.n + n, self.loss_chars + len(loss), self.chars + chars

    def result(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digested(conv_id, digest: _Digest) -> tuple:
    return (conv_id, None, None, *digest.result(), None, None)


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=_READ)


_READ = ["conv_id", "part", "segment", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "said", "loss"]
_READ_SCHEMA = "conv_id long, part int, segment int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, said string, loss string"


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted output alone: turns, their digest, and what the loss mask covers.

    ``formatted`` comes from ``format_conversations`` as it is: a task's segments in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of the conversations inside the task; the segments of its first and last one go on as texts."""
        current, digest, passing, waiting = None, None, True, []
        for batch in batches:
            rows = []
            ids, parts, segments = (batch.column(c).to_pylist() for c in ("conv_id", "part", "segment"))
            for conv, part, segment, (said, loss, n, chars) in zip(ids, parts, segments, _texts_of_segments(batch)):
                if digest is None or conv != current:
                    if not passing:
                        rows.append(_digested(current, digest))
                    passing = digest is None  # the first one may have begun in another task
                    current, digest, waiting = conv, _Digest(), []
                row = (conv, part, segment, n, None, None, None, chars, said, loss)
                if passing:
                    rows.append(row)
                    continue
                digest.add(said, loss, n, chars)
                waiting.append(row)
                if len(waiting) > MOST_WAITING:  # long: it passes on whatever follows
                    rows, waiting, passing = rows + waiting, [], True
            yield _segment_batch(rows)
        if not passing:  # the last one may go on in another task
            yield _segment_batch(waiting)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of the conversations that reach a border, their segments in order."""
        current, digest = None, None
        for batch in batches:
            done = []
            for conv, n, chars, said, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_turns", "formatted_chars", "said", "loss"))):
                if digest is not None and conv != current:
                    done.append(_digested(current, digest))
                    digest = None
                current, digest = conv, digest or _Digest()
                digest.add(said, loss, n, chars)
            yield _segment_batch(done)
        yield _segment_batch([_digested(current, digest)] if digest is not None else [])

    read = shared.written(formatted.mapInArrow(run, _READ_SCHEMA))
    cut = read.where("turns_sha256 IS NULL").repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment").mapInArrow(finish, _READ_SCHEMA)
    return read.where("turns_sha256 IS NOT NULL").unionByName(cut).select(*_READ[:1], *_READ[3:8])
