"""Personal data by a skip-chain conditional random field (operator 7).

Base rules find e-mail addresses, IP addresses, card and phone numbers exactly. On top, a conditional random field labels
the tokens that could be part of such data (those with a digit or an at sign): its chain potentials join neighbouring
tokens, its skip potentials join repeated or similar tokens however far apart, and loopy message passing settles a
label for all of them together. So a number written in full once marks its short form elsewhere in the document.

The field is trained piecewise: unary, chain and skip potentials are fitted to counts of token shapes, neighbours and
similar pairs with the base rules' labels over all documents; the counts are added up in the cluster and only the table
of contexts (``SHAPES`` by themselves, the others by size) reaches the driver. So the field finds what the base rules pass
over with a longer match that fails: of two card numbers side by side, each one with a right check digit. Where a digit or at sign is missing, Arrow's kernels say so
for a whole batch, and Python sees none of the text.

Spans that the field adds must pass their kind's own test (``plausible``) and overlap no base span.

Defined results: a null text is empty; rows with null or repeated ids are each searched; offsets are code points;
without base spans in the corpus the field is untrained and adds nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import byte_chunks, map_arrow, materialize

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]
K = len(LABELS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive and anchored to the start of a run: the same matches without the square of a run's length
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if k % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def plausible(kind: str, text: str) -> bool:
    """The test of a kind on a span's text."""
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in text.split(".")) if re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", text) else False
    if kind == "card":
        return 16 <= len(d := _digits(text)) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(_digits(text)) <= 15
    return "@" in text


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each at sign's run of local characters, as far as the match before."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind and start. Failing matches are dropped and not tried again."""
    out = [(0, a, b) for a, b in _emails(text)]
    for k, rule in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += [(k, *m.span()) for m in rule.finditer(text) if plausible(KINDS[k], m[0].lstrip("+"))]
    return out


@dataclass
class Nodes:
    """Candidate tokens of one text: spans without edge marks, shapes, chain edges and skip edges."""

    spans: list[tuple[int, int]]
    shapes: list[str]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def _shape(token: str) -> str:
    """Classes of characters in order, runs joined, with the number of digits in steps."""
    d = _digits(token)
    n = len(d)
    size = "0" if not n else "1" if n < 4 else "4" if n < 8 else "8" if n < 12 else "12" if n < 16 else "16" if n < 20 else "20"
    if 16 <= n <= 19 and luhn(d):
        size += "L"  # the check digit is right
    runs = re.sub(r"(.)\1+", r"\1", re.sub("[^9a@.()+-]", "x", re.sub("[A-Za-z]", "a", re.sub("[0-9]", "9", token))))
    return f"{runs if len(runs) <= 12 else 'long'}/{size}"


def _keys(token: str) -> list[str]:
    """What makes tokens similar: their digits (four or more), and for an address its parts."""
    d = _digits(token)
    out = [f"d{d}"] if len(d) >= 4 else []
    if "@" in token:
        local, _, domain = token.partition("@")
        out += [f"l{local.lower()}", f"l{token.lower()}"]
    elif d:
        out.append(f"l{token.lower()}")
    return out


def nodes_of(text: str) -> Nodes:
    spans, shapes, chain, skip = [], [], [], []
    latest: dict[str, int] = {}
    before = -2
    for place, m in enumerate(_TOKEN.finditer(text)):
        token = m[0]
        if not ("@" in token or any(c in "0123456789" for c in token)):
            continue
        core = token.strip(_EDGE)
        if not core:
            continue
        start = m.start() + token.index(core)
        k = len(spans)
        spans.append((start, start + len(core)))
        shapes.append(_shape(core))
        if before == place - 1:
            chain.append((k - 1, k))
        before = place
        # each token is tied to the latest one that is like it, so edges grow with tokens and not with pairs
        for key in _keys(core):
            if key in latest and (latest[key], k) not in chain[-1:]:
                skip.append((latest[key], k))
            latest[key] = k
    return Nodes(spans, shapes, chain, list(dict.fromkeys(skip)))


def _labels(nodes: Nodes, base: list[tuple[int, int, int]]) -> list[int]:
    """Label of each token by the base span that it overlaps, 0 if none."""
    out = []
    for a, b in nodes.spans:
        out.append(next((k + 1 for k, s, e in base if s < b and a < e), 0))
    return out


#: Distinct contexts that training looks at by themselves, the most frequent first. All others are added up by the size of
#: their numbers, as contexts of the shape "other".
SHAPES = 4096


def _signs(shape: str, left: str, right: str) -> list[str]:
    """Binary features of a token with its neighbours' leading classes."""
    runs, _, size = shape.partition("/")
    return ["one", f"r{runs}", f"s{size}", f"f{runs[:1]}", f"b{runs[-1:]}", *(f"h{c}" for c in "@.()+-ax" if c in runs), f"<{left}", f">{right}"]


@dataclass
class Field:
    """Potentials (log): ``unary`` of features by label, ``chain`` and ``skip`` of label pairs."""

    unary: dict[str, np.ndarray]
    chain: np.ndarray
    skip: np.ndarray

    def scores(self, signs: list[str]) -> np.ndarray:
        zero = np.zeros(K)
        signs = ["rother" if s[0] == "r" and s not in self.unary else s for s in signs]
        return sum((self.unary.get(s, zero) for s in signs), zero)

    def marginals(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = 8) -> np.ndarray:
        """Loopy sum-product over all edges at once, ``rounds`` times with damping; (nodes, labels)."""
        edges = np.concatenate([chain, skip])
        pots = np.concatenate([np.broadcast_to(self.chain, (len(chain), K, K)), np.broadcast_to(self.skip, (len(skip), K, K))])
        belief = unary.copy()
        if len(edges):
            src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            pot = np.concatenate([pots, pots.transpose(0, 2, 1)])
            half = len(edges)
            back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
            msg = np.zeros((2 * half, K))
            for _ in range(rounds):
                x = (belief[src] - msg[back])[:, :, None] + pot
                top = x.max(axis=1, keepdims=True)
                new = top[:, 0] + np.log(np.exp(x - top).sum(axis=1))
                msg = 0.5 * msg + 0.5 * (new - new.max(axis=1, keepdims=True))
                belief = unary.copy()
                np.add.at(belief, dst, msg)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _class(shape: str) -> str:
    return shape[:1]


def _contexts(nodes: Nodes) -> list[tuple[str, str, str]]:
    left, right = [""] * len(nodes.spans), [""] * len(nodes.spans)
    for a, b in nodes.chain:
        right[a], left[b] = _class(nodes.shapes[b]), _class(nodes.shapes[a])
    return list(zip(nodes.shapes, left, right))


def _candidates(text: pa.Array) -> list[int]:
    """Rows with a digit or an at sign."""
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(text, "[0-9@]"), False).to_numpy(zero_copy_only=False)).tolist()


def learn_field(docs: DataFrame) -> Field | None:
    """Counts over all documents, then the three pieces' fits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str, int, int]] = Counter()

        def give() -> pa.RecordBatch:
            rows = [(*k, c) for k, c in seen.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["kind", "what", "a", "b", "c"])

        for batch in batches:
            for part in byte_chunks(batch):
                text = part.column("text")
                for i in _candidates(text):
                    t = text[i].as_py()
                    nodes, base = nodes_of(t), base_spans(t)
                    y = _labels(nodes, base)
                    seen.update(("unary", "\t".join(x), k, 0) for x, k in zip(_contexts(nodes), y))
                    seen.update(("chain", "", y[a], y[b]) for a, b in nodes.chain)
                    seen.update(("skip", "", y[a], y[b]) for a, b in nodes.skip)
                    if len(seen) > 100_000:
                        yield give()
        if seen:
            yield give()

    made = map_arrow(docs.select(F.col("text").cast("string").alias("text")), count, "kind string, what string, a int, b int, c long", stream=True)
    counts = materialize(made.groupBy("kind", "what", "a", "b").agg(F.sum("c").alias("c")), "field-counts")
    # before any count, similar tokens are held to agree
    pairs = {"chain": np.ones((K, K)), "skip": np.ones((K, K)) + 20 * np.eye(K)}
    for r in counts.where("kind != 'unary'").collect():
        pairs[r["kind"]][r["a"], r["b"]] += r["c"]
    unary = counts.where("kind = 'unary'").select("what", "a", "c")
    often = materialize(unary.groupBy("what").agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "what").limit(SHAPES).select("what"), "frequent-contexts")
    size = F.regexp_extract("what", "/([0-9]+L?)\t", 1)
    rare = unary.join(often, "what", "left_anti").groupBy(F.concat(F.lit("other/"), size, F.lit("\t\t")).alias("what"), "a").agg(F.sum("c").alias("c"))
    rows = unary.join(often, "what").unionByName(rare).orderBy("what", "a").collect()
    if not any(r["a"] for r in rows):
        return None
    signs = [_signs(*r["what"].split("\t")) for r in rows]
    names = {s: i for i, s in enumerate(dict.fromkeys(x for s in signs for x in s))}
    x = np.zeros((len(rows), len(names)))
    for i, s in enumerate(signs):
        x[i, [names[n] for n in s]] = 1
    y = np.array([r["a"] for r in rows])
    weight = np.sqrt(np.array([r["c"] for r in rows], float))
    weight /= weight.sum()
    w, g2 = np.zeros((len(names), K)), np.full((len(names), K), 1e-8)
    for _ in range(300):  # adaptive gradient on the weighted likelihood with a small quadratic penalty
        s = x @ w
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = x.T @ (p * weight[:, None]) + 1e-4 * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)

    def lift(n: np.ndarray) -> np.ndarray:
        """Log ratio of pairs to chance, in bounds that leave the unary piece a say."""
        joint = n / n.sum()
        return np.clip(np.log(joint / np.outer(joint.sum(axis=1), joint.sum(axis=0))), -3, 3)

    skip = pairs["skip"] + pairs["skip"].T
    return Field({s: w[i] for s, i in names.items()}, lift(pairs["chain"]), lift(skip))


def field_spans(text: str, nodes: Nodes, marginal: np.ndarray, base: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int]]:
    """Runs of tokens with one sure label that pass their kind's test and overlap no base span."""
    sure = np.where(marginal.max(axis=1) >= least, marginal.argmax(axis=1), 0)
    tied = {b: a for a, b in nodes.chain}
    out, k = [], 0
    while k < len(sure):
        first = k
        while sure[first] and k + 1 < len(sure) and tied.get(k + 1) == k and sure[k + 1] == sure[first]:
            k += 1
        a, b = nodes.spans[first][0], nodes.spans[k][1]
        if sure[first] and not any(s < b and a < e for _, s, e in base) and plausible(KINDS[sure[first] - 1], text[a:b]):
            out.append((int(sure[first]) - 1, a, b))
        k += 1
    return out


def _find(texts: list[str], field: Field | None, least: float) -> list[list[tuple[int, int, int, bool]]]:
    """Spans of each text: the texts' graphs are joined into one and settled together."""
    based = [base_spans(t) for t in texts]
    out = [[(k, a, b, True) for k, a, b in base] for base in based]
    if field is not None:
        graphs = [nodes_of(t) for t in texts]
        sizes = np.cumsum([0, *(len(g.spans) for g in graphs)])
        if sizes[-1]:
            known: dict[tuple[str, str, str], np.ndarray] = {}
            unary = np.array([known[x] if x in known else known.setdefault(x, field.scores(_signs(*x))) for g in graphs for x in _contexts(g)])
            chain, skip = (np.array([(a + o, b + o) for g, o in zip(graphs, sizes.tolist()) for a, b in getattr(g, name)], np.int64).reshape(-1, 2) for name in ("chain", "skip"))
            p = field.marginals(unary, chain, skip)
            for i, g in enumerate(graphs):
                out[i] += [(k, a, b, False) for k, a, b in field_spans(texts[i], g, p[sizes[i] : sizes[i + 1]], based[i], least)]
    return [sorted(x, key=lambda s: s[:3]) for x in out]


def find_personal(docs: DataFrame, *, least: float = 0.75) -> DataFrame:
    """(doc_id, found array<struct<kind, start, end, base>>) for every document, by kind and start."""
    field = learn_field(docs)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def find(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for part in byte_chunks(batch):
            text = part.column("text")
            rows = _candidates(text)
            found: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for i, spans in zip(rows, _find([text[i].as_py() for i in rows], field, least)):
                found[i] = [{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in spans]
            out.append(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, arrow)], ["doc_id", "found"]))
        return out

    schema = "doc_id long, found array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), find, schema)


def redact(docs: DataFrame, *, least: float = 0.75) -> DataFrame:
    """The same columns; each span of a text (overlapping ones as one) gives way to its kind in angle brackets, and
    ``n_chars``, where there is such a column, is counted anew."""
    field = learn_field(docs)

    def clean(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for part in byte_chunks(batch):
            place = part.schema.get_field_index("text")
            texts = part.column(place)
            rows = _candidates(texts)
            new = {}
            for i, spans in zip(rows, _find([texts[i].as_py() for i in rows], field, least)):
                t, pieces, at = texts[i].as_py(), [], 0
                for k, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if a >= at:
                        pieces += [t[at:a], f"<{KINDS[k].upper()}>"]
                    at = max(at, b)
                if spans:
                    new[i] = "".join([*pieces, t[at:]])
            if new:
                values = texts.to_pylist()
                for i, t in new.items():
                    values[i] = t
                part = part.set_column(place, part.schema.field(place), pa.array(values, texts.type))
            out.append(part)
        return out

    cleaned = map_arrow(docs, clean, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind))
    return cleaned.select(*docs.columns)
