"""Chat formatting with offset-aligned loss masks (operator 4).

A conversation is rendered whole, turn by turn, between control tokens that the tokenizer treats as units, and encoded
once with offsets. The loss mask is the intersection of the assistant turns' sorted spans with the tokens' spans, found by
binary search. Rows reach the renderer sorted by conversation and turn, as a stream: only one conversation is held at a
time, and it is the unit that the tokenizer needs whole.

The template is, for each turn, ``<|turn|>role<|says|>text<|end|>``. A backslash in a role or text is doubled and ``<|``
becomes ``<\\|``, so control strings occur nowhere else and every text can be read back.

Defined results: null texts and roles are empty; null turns come first, and equal turns are ordered by role, then text;
repeated rows are each a turn; rows with a null conv_id form one conversation with a null id.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import byte_chunks, map_arrow

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[int], list[int]]:
    """The formatted conversation and the sorted starts and ends of the trained role's escaped texts."""
    out, at, starts, ends = [], 0, [], []
    for role, text in turns:
        head, body = TURN + escape(role) + SAYS, escape(text)
        if role == trained:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), starts, ends


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(END)[:-1]:
        head, _, body = part.partition(SAYS)
        turns.append((unescape(head.removeprefix(TURN)), unescape(body)))
    return turns


def token_mask(offsets: np.ndarray, starts: list[int], ends: list[int]) -> np.ndarray:
    """True for tokens that lie in one of the sorted spans; offsets: (tokens, 2), sorted, in characters."""
    if not len(offsets) or not starts:
        return np.zeros(len(offsets), bool)
    turn = np.searchsorted(np.array(starts), offsets[:, 0], side="right") - 1
    end = np.array(ends)[np.maximum(turn, 0)]
    return (turn >= 0) & (offsets[:, 1] <= end) & (offsets[:, 0] < end)


def masked_spans(offsets: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Joined character spans of the masked tokens."""
    spans: list[tuple[int, int]] = []
    for a, b in offsets[mask].tolist():
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


_WORKER: dict[str, object] = {}


def _tokenizer(path: str):
    """Without a post-processor, which would trim white space from offsets; control strings are single tokens."""
    if path not in _WORKER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        t = Tokenizer.from_file(path)
        t.pre_tokenizer = ByteLevel(add_prefix_space=False, trim_offsets=False)
        t.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (TURN, SAYS, END)])
        _WORKER[path] = t
    return _WORKER[path]


def format_conversations(turns: DataFrame, tokenizer_path: str, *, trained: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, ids array<int>, mask array<boolean>, spans array<struct<start, end>>) per conversation.

    ``spans`` joins the characters of masked tokens. Conversations are dealt out by their id and sorted within tasks.
    """
    schema = "conv_id long, n_turns long, formatted string, ids array<int>, mask array<boolean>, spans array<struct<start:bigint,end:bigint>>"
    arrow = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def finish(conv_id: int | None, held: list[tuple[str, str]]) -> dict:
        formatted, starts, ends = render(held, trained)
        encoded = _tokenizer(tokenizer_path).encode(formatted, add_special_tokens=False)
        offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
        mask = token_mask(offsets, starts, ends)
        return {"conv_id": conv_id, "n_turns": len(held), "formatted": formatted, "ids": encoded.ids, "mask": mask.tolist(), "spans": [{"start": a, "end": b} for a, b in masked_spans(offsets, mask)]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out, size = None, [], [], 0
        for batch in batches:
            for part in byte_chunks(batch):
                for conv_id, role, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                    if held and conv_id != now:
                        out.append(finish(now, held))
                        size += len(out[-1]["formatted"])
                        held = []
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, arrow)
                            out, size = [], 0
                    now = conv_id
                    held.append((role or "", text or ""))
        if held:
            out.append(finish(now, held))
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_arrow(dealt, run, schema, stream=True)
