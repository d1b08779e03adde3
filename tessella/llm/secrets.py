"""Secret scans by one combined automaton (operator 8).

The rules are compiled into a single minimal automaton, read backward (see ``automaton``), built once on the driver and
shipped as arrays. One byte pass over each batch of whole texts gives every byte at which a rule's match begins, for all
rules together. From a begin, the rule's own automaton runs forward to the end of the longest match, which for these rules
is the greedy one; begins inside a match are passed over, and a match that fails its length test is dropped whole.

Defined results: a null text is empty; rows with null or repeated ids are each scanned; offsets are code points.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.automaton import Automaton, compile_rules
from tessella.llm.common import byte_chunks, map_arrow


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """``finds``: the extent, greedy. ``least`` characters at least after ``head``, which begins the extent.

    ``begins``: an expression that matches wherever a valid extent begins and nowhere before it in the same run; it is what
    the combined automaton reads. It is ``finds`` itself but for runs of one class, where the length keeps prose out."""

    kind: str
    finds: str
    head: str = ""
    least: int = 1
    base: bool = False
    begins: str = ""


_KEY = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key") + ")"
_ASSIGN = _KEY + r"""["']?\x20*[:=]\x20*["']?"""
_JWT = "[A-Za-z0-9_-]+"

RULES = [
    Rule("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", _ASSIGN, 8, True),
    Rule("access", "AKIA[A-Z0-9]+", "", 16, True),
    Rule("hex", "[0-9a-f]+", "", 32, True, "[0-9a-f]{32}"),
    Rule("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]+", "", 40),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]+", "", 15),
    Rule("web_token", rf"eyJ{_JWT}\.eyJ{_JWT}\.{_JWT}", "", 40),
]


@dataclass(frozen=True)
class Machine:
    """The combined automaton, and for each rule the forward ones of its extent and its head."""

    rules: list[Rule]
    begins: Automaton
    extents: list[Automaton]
    heads: list[Automaton | None]

    def spans(self, texts: list[bytes], **cut: int) -> dict[int, list[tuple[int, int, int]]]:
        """{text: [(start byte, rule, end byte), ...]} of the texts with a span, sorted."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        for t, marks in self.begins.starts(texts, **cut).items():
            here = []
            for k, rule in enumerate(self.rules):
                done = 0
                for at, bits in marks:
                    if not bits >> k & 1 or at < done:
                        continue
                    done = self.extents[k].longest(texts[t], at)
                    first = self.heads[k].longest(texts[t], at) if self.heads[k] else at
                    if done - first >= rule.least:
                        here.append((at, k, done))
            if here:
                out[t] = sorted(here)
        return out


def machine(rules: list[Rule]) -> Machine:
    alone = lambda p: compile_rules([p], anchored=True) if p else None
    return Machine(rules, compile_rules([r.begins or r.finds for r in rules], backward=True), [alone(r.finds) for r in rules], [alone(r.head) for r in rules])


def _points(text: bytes, spans: list[tuple[int, int, int]]) -> dict[int, int]:
    """Code points before each byte offset of the spans."""
    out, at, n = {}, 0, 0
    for b in sorted({x for a, _, e in spans for x in (a, e)}):
        n += len(text[at:b].decode())
        at = b
        out[b] = n
    return out


def scan_secrets(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, found array<struct<kind, start, end, base>>) for every document, by start and then the rules' order."""
    rules = rules or RULES
    made = machine(rules)
    kind = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def scan(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for part in byte_chunks(batch):
            texts = [t.as_py() or b"" for t in part.column("text").cast(pa.large_binary())]
            found: list[list[dict]] = [[] for _ in texts]
            for t, spans in made.spans(texts).items():
                points = _points(texts[t], spans)
                found[t] = [{"kind": rules[k].kind, "start": points[a], "end": points[b], "base": rules[k].base} for a, k, b in spans]
            out.append(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, arrow)], ["doc_id", "found"]))
        return out

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scan, f"doc_id long, found {kind}")
