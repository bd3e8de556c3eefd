"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, turn by turn::

    <|turn|>role<|body|>text<|end|>

Control strings inside roles and texts are escaped: a backslash is put behind their
first character, also where one or more stand there already, so taking one away
restores any text. The rendered string is encoded once, with offsets; the markers
are special tokens, so no token spans a border of a text. The loss mask comes from
binary searches of the token spans among the sorted spans of the assistant's texts.

A conversation is one sample and one row, so its turns meet in one task; the number
of conversations, not their length, is what grows.

Edge cases: a null role or text is empty. Turns are in order of turn (null first),
then role, then text; repeated rows are repeated turns. Rows without a conv_id form
one conversation. An empty table has no conversations. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
LEARNED = "assistant"
VOCABULARY = "byte_bpe_50k"
# Openings of control strings of this and other common templates.
_CONTROL = re.compile(r"([<\[])(\\*)(?=\||/?s>|/?INST\]|</?SYS>>)")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=\||/?s>|/?INST\]|</?SYS>>)")
_MARKED = re.compile(re.escape(TURN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The string, and the spans of the texts to learn, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{BODY}", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def tokenizer(vocabulary: str = VOCABULARY):
    """The public vocabulary with the markers as special tokens."""
    import public_tokenizers
    from tokenizers import AddedToken, Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    found = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    found.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in (TURN, BODY, END)])
    return found


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For each token (start, end), whether it meets one of the sorted spans (start, end)."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    candidate = np.searchsorted(spans[:, 1], offsets[:, 0], "right")
    inside = candidate < len(spans)
    starts = spans[np.minimum(candidate, len(spans) - 1), 0]
    return inside & (starts < offsets[:, 1])


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted``, token ``ids``, their ``starts`` and ``ends`` in code points, and the loss ``mask``."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer().encode
        for batch in batches:
            out = []
            for turns in batch.column("turns"):
                text, spans = render([(t["role"], t["text"]) for t in turns.as_py()])
                found = encode(text, add_special_tokens=False)
                offsets = np.array(found.offsets, np.int32).reshape(-1, 2)
                mask = loss_mask(offsets, np.array(spans, np.int32).reshape(-1, 2))
                out.append((text, found.ids, offsets[:, 0], offsets[:, 1], mask))
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=names)

    names = ["conv_id", "formatted", "ids", "starts", "ends", "mask"]
    types = [pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]
    schema = "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>"
    return whole.mapInArrow(of, schema)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a rendered conversation."""
    return [(unescape(role), unescape(text)) for role, text in _MARKED.findall(formatted)]


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """What lies under the loss mask, without escapes: runs of masked tokens, each unescaped by itself."""
    edges = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    runs = zip(starts[np.flatnonzero(edges > 0)], ends[np.flatnonzero(edges < 0) - 1])
    return "".join(unescape(formatted[a:b]) for a, b in runs)


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of the turns and of the text under the mask, read from the formatted output only."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts, ends, mask in zip(*(batch.column(c) for c in ("formatted", "starts", "ends", "mask"))):
                text = text.as_py()
                turns = parse(text)
                digest = hashlib.sha256("".join(f"{role}\n{body}\n" for role, body in turns).encode())
                loss = masked_texts(text, *(c.values.to_numpy(zero_copy_only=False) for c in (starts, ends, mask)))
                out.append((len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(of, schema)
