"""Language-model scoring with a gated recurrent network (operator 3).

Counts of every word of every training document are exact and made in the cluster; what is gathered from the corpus grows
with it. The network predicts a fixed vocabulary (the ``vocabulary`` most frequent tokens, the end and one symbol for
all other words) through a class-factored softmax: a token's probability is that of its frequency class times its own
within the class. Other words get the network's probability of the symbol times their smoothed share among such words,
so every text has a proper probability. The network is written in numpy: truncated backpropagation through ``window``
steps, and the hidden state carried from window to window, in training and in scoring of whole documents.

Training has two parts. First the driver fits the network on about ``fit_tokens`` tokens, drawn by a hash of document and
block from the whole training set: only a start, which spares the averaged rounds a cold one. Then the cluster trains it on
every training document, each once: the documents are dealt to ``rounds`` rounds by a hash of their ids, in each round every
task trains a copy on its documents, and the copies' weights are averaged by the tokens that they have read. Bounds: the ``head`` most frequent words are broadcast with their counts; the others are
joined, and as each has less than 1 / ``head`` of all tokens, none is a hot key.

Defined results: a null text is empty and has one token, the end; a null id counts as held out; repeated rows and ids
are each scored; with no training documents every count is 0 and the network is untrained.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import byte_chunks, is_held_out, map_arrow, materialize, one_blas_thread

_TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The end of a document among the words; no word is empty.
END = b""
LN10 = float(np.log(10.0))


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words (A-Z only) and the end."""
    return [*(text or b"").translate(_TO_LOWER).split(), END]


def _with_ones(hidden: np.ndarray) -> np.ndarray:
    """A last column of ones, whose weights are the biases."""
    return np.concatenate([hidden, np.ones((len(hidden), 1), hidden.dtype)], axis=1)


def _softmax(weights: np.ndarray, hidden: np.ndarray, own: np.ndarray, wide: bool, picked: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Exponentials (outputs, tokens); their sums go to ``total``, the logits at the flat places ``own`` to ``picked``. The
    greatest of a token is taken off only where weights are so ``wide`` that exponentials could leave the range of 32 bits."""
    x = weights @ hidden.T
    if wide:
        x -= x.max(axis=0)
    picked[:] = x.ravel().take(own)
    np.exp(x, out=x)
    x.sum(axis=0, out=total)
    return x


def _softmax_grads(x: np.ndarray, own: np.ndarray, total: np.ndarray) -> None:
    """From what ``_softmax`` gives to the gradients of its logits, in place."""
    x *= 1 / total
    flat = x.ravel()
    flat[own] = flat.take(own) - 1


def _is_wide(weights: np.ndarray, hidden: np.ndarray) -> bool:
    """Whether a logit may lie so far from 0 that its exponential leaves the range of 32 bits."""
    far = max(1.0, float(np.abs(hidden).max(initial=0)))
    return float((np.abs(weights) @ np.ones(weights.shape[1], weights.dtype)).max()) * far > 75


def _by_gate(x: np.ndarray) -> np.ndarray:
    """A copy of (n, 3 h) as (3, n, h)."""
    return x.reshape(len(x), 3, -1).transpose(1, 0, 2).copy()


def _put_back(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[order] = values
    return out


def _adam(p: np.ndarray, g: np.ndarray, m: np.ndarray, s: np.ndarray, lr: float, count: int, block: int = 1 << 14) -> None:
    """One step in place, by blocks that stay in the cache."""
    for a in range(0, len(p), block):
        at = slice(a, a + block)
        gb, mb, sb = g[at], m[at], s[at]
        mb += 0.1 * (gb - mb)
        gb *= gb
        gb -= sb
        gb *= 0.01
        sb += gb
        root = np.sqrt(sb)
        root *= (1 - 0.99**count) ** -0.5
        root += 1e-6
        np.divide(mb, root, out=root)
        root *= lr / (1 - 0.9**count)
        p[at] -= root


def _sums_by_word(words_: np.ndarray, rows: np.ndarray, v: int, often: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(words, sums of their rows), words by falling count: long runs are summed at once, the others' k-th rows together."""
    order = np.argsort(words_.astype(np.uint16) if v <= 1 << 16 else words_, kind="stable")
    counts = np.bincount(words_, minlength=v)
    first = np.cumsum(counts) - counts
    used = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    counts, first = counts[used], first[used]
    long = int(np.count_nonzero(counts > often))
    out = np.zeros((len(used), rows.shape[1]), rows.dtype)
    ones = np.ones(counts[0] if long else 0, rows.dtype)
    for i in range(long):
        np.matmul(ones[: counts[i]], rows.take(order[first[i] : first[i] + counts[i]], axis=0), out=out[i])
    for k in range(int(counts[long]) if long < len(counts) else 0):
        most = int(np.searchsorted(-counts, -k, side="left"))  # words with more than k rows
        out[long:most] += rows.take(order[first[long:most] + k], axis=0)
    return used, out


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in one array as ``tokens`` has them, without the ends, and where each text's begin (and the last's end)."""
    # a copy first: of a slice without nulls the kernel would lose words
    texts = texts.cast(pa.large_string()).fill_null("").take(pa.array(np.arange(len(texts))))
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, cuts = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
    real = pc.greater(pc.binary_length(flat), 0)  # white space at either side of a text leaves an empty word there
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return (flat if before[-1] == len(flat) else flat.filter(real)).cast(pa.large_binary()), before[cuts]


def streams_of(numbers: np.ndarray, cuts: np.ndarray, end: int) -> list[np.ndarray]:
    """Each text's numbers and the end."""
    ids = np.insert(numbers.astype(np.int32, copy=False), cuts[1:], end)
    return np.split(ids, cuts[1:-1] + np.arange(1, len(cuts) - 1)) if len(cuts) > 1 else []


def index_of(words_: pa.Array, among: pa.Array, default: int) -> np.ndarray:
    """The words' places in ``among``."""
    return pc.index_in(words_, value_set=among).fill_null(default).to_numpy()


class GruLm:
    """A GRU with a class-factored output over ids 0..V-1. ``classes``: first id of each class, ids being sorted by class."""

    def __init__(self, counts: np.ndarray, n_classes: int = 64, hidden: int = 24, seed: int = 1):
        v, h = len(counts), hidden
        rng = np.random.default_rng(seed)
        share = (counts + 0.5) / (counts + 0.5).sum()
        # classes of about equal sums of square roots: frequent words in small classes, none very large
        mass = np.cumsum(np.sqrt(share)) / np.sqrt(share).sum()
        of = np.minimum((mass * n_classes).astype(int), n_classes - 1)
        self.classes = np.flatnonzero(np.diff(np.concatenate([[-1], of])))
        self.class_of = np.searchsorted(self.classes, np.arange(v), side="right") - 1
        c = len(self.classes)
        by_class = np.add.reduceat(share, self.classes)
        small = lambda *shape: (rng.standard_normal(shape) * 0.08).astype(np.float32)
        self.p = {
            "E": small(v, h), "W": small(h, 3 * h), "b": np.zeros(3 * h, np.float32), "U": small(h, 3 * h),
            "C": np.zeros((h, c), np.float32), "bc": np.log(by_class).astype(np.float32),
            "O": np.zeros((v, h), np.float32), "bo": np.log(share / by_class[self.class_of]).astype(np.float32),
        }
        self.hidden, self.v = h, v

    def run(self, inputs: np.ndarray, state: np.ndarray, keep: bool = False):
        """Hidden states after each of (T, B) inputs; with ``keep``, what the backward pass needs."""
        p, h = self.p, self.hidden
        if not hasattr(self, "table"):
            # the gates apart, (3, words, h) and (3, h, h): each step then works on whole blocks of memory. The first two are
            # negative, as their exponentials are taken of that
            w, b, u = _by_gate(p["W"]), _by_gate(p["b"][None]), _by_gate(p["U"])
            for x in (w, b, u):
                np.negative(x[:2], out=x[:2])
            table = p["E"] @ w
            table += b
            self.table = table, u
        table, recur = self.table
        out = np.empty((*inputs.shape, h), np.float32)
        kept = []
        for t in range(len(inputs)):
            x, un = table.take(inputs[t], axis=1), state @ recur[2]
            gates = x[:2]
            gates += state @ recur[:2]
            np.exp(gates, out=gates)
            gates += 1
            np.divide(1, gates, out=gates)
            z, r, n = x
            n += r * un
            np.tanh(n, out=n)
            if keep:
                kept.append((state, z, r, n, un))
            state = state - n
            state *= z
            state += n
            out[t] = state
        return out, state, kept

    def log_probs(self, hidden: np.ndarray, targets: np.ndarray, grads: dict | None = None, block: int = 1024):
        """Natural log probabilities of targets (n,) after hidden states (n, h); fills ``grads`` and returns d hidden too.
        Classes are worked on for ``block`` tokens at a time, which stay in the cache."""
        p = self.p
        n = len(targets)
        rows = np.arange(n)
        # ids are sorted by class, so targets in their order are too; of 16 bits, they are sorted by digits
        order = np.argsort(targets.astype(np.uint16) if self.v <= 1 << 16 else targets, kind="stable")
        targets, hidden = targets.take(order), _with_ones(hidden.take(order, axis=0))
        of_class, of_word = np.concatenate([p["C"].T, p["bc"][:, None]], axis=1), np.concatenate([p["O"], p["bo"][:, None]], axis=1)
        cls = self.class_of.take(targets)
        cuts = np.searchsorted(cls, np.arange(len(self.classes) + 1))
        ends = np.append(self.classes[1:], self.v)
        # places in the blocks below, (words of a class, its tokens) as one row
        places = (targets - self.classes.take(cls)) * np.diff(cuts).take(cls) + rows - cuts.take(cls)
        # classes and words down, tokens across: sums over few classes or words then run along whole rows of tokens
        picked, total = np.zeros((2, n), of_class.dtype), np.ones((2, n), of_class.dtype)
        back, made = (None, None) if grads is None else (np.empty((n, self.hidden), of_class.dtype), np.zeros_like(of_class))
        wide = _is_wide(of_class, hidden)
        for a in range(0, n, block):
            at = slice(a, min(a + block, n))
            near, own = hidden[at], cls[at] * (at.stop - a) + rows[: at.stop - a]
            x = _softmax(of_class, near, own, wide, picked[0, at], total[0, at])
            if grads is not None:
                _softmax_grads(x, own, total[0, at])
                made += x @ near
                np.matmul(x.T, p["C"].T, out=back[at])
        if grads is not None:
            grads["C"], grads["bc"] = made[:, :-1].T, made[:, -1]
            made = np.zeros_like(of_word)
        wide = _is_wide(of_word, hidden)
        for k in np.flatnonzero((np.diff(cuts) > 0) & (ends - self.classes > 1)):
            words_ = slice(self.classes[k], ends[k])
            at = slice(cuts[k], cuts[k + 1])
            near, own = hidden[at], places[at]
            x = _softmax(of_word[words_], near, own, wide, picked[1, at], total[1, at])
            if grads is not None:
                _softmax_grads(x, own, total[1, at])
                np.matmul(x, near, out=made[words_])
                back[at] += x.T @ p["O"][words_]
        if grads is not None:
            grads["O"], grads["bo"] = made[:, :-1], made[:, -1]
        lp = (picked - np.log(total)).sum(axis=0)
        return _put_back(lp, order), None if back is None else _put_back(back, order)

    def fit(self, streams: list[np.ndarray], end: int, *, window: int = 24, batch: int = 48, epochs: int = 2, rate: float = 0.012, fall: float = 0.9) -> None:
        """Truncated backpropagation over parallel lanes of concatenated documents, with Adam. The state is carried from
        window to window."""
        data = np.concatenate([np.array([end]), *streams]).astype(np.int64) if streams else np.zeros(0, np.int64)
        steps = (len(data) - 1) // batch
        if steps < 1:
            return
        source, target = data[: steps * batch].reshape(batch, steps).T, data[1 : steps * batch + 1].reshape(batch, steps).T
        # all weights in one row, of which each array is a view while it is trained
        names = list(self.p)
        flat = np.concatenate([self.p[k].ravel() for k in names])
        cuts = np.cumsum([self.p[k].size for k in names])[:-1]
        self.p = {k: x.reshape(self.p[k].shape) for k, x in zip(names, np.split(flat, cuts))}
        m, s = np.zeros_like(flat), np.zeros_like(flat)
        count, rounds = 0, epochs * -(-steps // window)
        for _ in range(epochs):
            state = np.zeros((batch, self.hidden), np.float32)
            for at in range(0, steps, window):
                x, y = (np.ascontiguousarray(d[at : at + window]) for d in (source, target))
                self.__dict__.pop("table", None)
                grads, state = self._grads(x, y, state)
                count += 1
                lr = rate * (1 - fall * count / rounds)
                _adam(flat, np.concatenate([grads[k].ravel() for k in names]), m, s, lr, count)
        self.p = {k: x.copy() for k, x in self.p.items()}
        self.__dict__.pop("table", None)

    def _grads(self, x: np.ndarray, y: np.ndarray, state: np.ndarray):
        p, h = self.p, self.hidden
        out, last, kept = self.run(x, state, keep=True)
        grads: dict[str, np.ndarray] = {}
        _, back = self.log_probs(out.reshape(-1, h), y.ravel(), grads)
        back = back.reshape(out.shape)
        into = np.empty((*x.shape, 3 * h), np.float32)
        by_gate = np.empty((3, *state.shape), np.float32)
        recur = np.ascontiguousarray(_by_gate(p["U"]).transpose(0, 2, 1))
        grads["U"] = np.zeros((3, h, h), np.float32)
        dh = np.zeros_like(state)
        for t in range(len(x) - 1, -1, -1):
            before, z, r, n, un = kept[t]
            dh = dh + back[t]
            dz, dr, dn = by_gate
            np.multiply(dh, 1 - z, out=dn)
            dn *= 1 - n * n
            np.subtract(before, n, out=dz)
            dh *= z
            dz *= dh
            dz *= 1 - z
            np.multiply(dn, r, out=dr)
            into[t, :, 2 * h :] = dn
            dn[...] = dr
            dr *= un
            dr *= 1 - r
            into[t, :, :h], into[t, :, h : 2 * h] = dz, dr
            grads["U"] += before.T @ by_gate
            for part in by_gate @ recur:
                dh += part
        grads["U"] = grads["U"].transpose(1, 0, 2).reshape(h, 3 * h)
        flat = into.reshape(-1, 3 * h)
        used, by_word = _sums_by_word(x.ravel(), flat, self.v)
        grads["b"] = by_word.sum(axis=0)
        grads["W"] = p["E"][used].T @ by_word
        grads["E"] = np.zeros_like(p["E"])
        grads["E"][used] = by_word @ p["W"].T
        for g in grads.values():
            g /= x.size
            np.clip(g, -0.5, 0.5, out=g)
        return grads, last

    def score(self, docs: list[np.ndarray], end: int, window_tokens: int = 49152, lanes: int = 384) -> np.ndarray:
        """Natural log probability of each document (ids that end with ``end``), read from a start like after an end.

        All documents advance together, longest first; the live ones' states are carried from window to window. So many ``lanes``
        are run at once that a step's arrays stay in the cache.
        """
        out = np.zeros(len(docs))
        order = np.array(sorted(range(len(docs)), key=lambda i: -len(docs[i])), np.int64)
        sizes = np.array([len(docs[i]) for i in order], np.int64)
        # one row of all documents with an end before each, which it is read from
        start = np.array([end], np.int32)
        flat = np.concatenate([x for i in order for x in (start, docs[i])] or [start])
        first = np.cumsum(sizes + 1) - sizes - 1
        state = np.zeros((len(docs), self.hidden), np.float32)
        at = 0
        while len(sizes) and at < sizes[0]:
            live = int(np.searchsorted(-sizes, -at, side="left"))
            wide = int(min(max(window_tokens // live, 1), 512, sizes[0] - at))
            # beyond a document's end others follow, which are read and left out
            ids = flat.take(first[:live] + at + np.arange(wide + 1)[:, None], mode="clip")
            hidden = np.empty((wide, live, self.hidden), np.float32)
            for a in range(0, live, lanes):
                own = slice(a, min(a + lanes, live))
                hidden[:, own], state[own], _ = self.run(ids[:-1, own], state[own])
            real = np.flatnonzero(np.arange(wide)[:, None] < sizes[:live] - at)
            lp, _ = self.log_probs(hidden.reshape(-1, self.hidden).take(real, axis=0), ids[1:].ravel().take(real))
            out[order[:live]] += np.bincount(real % live, weights=lp, minlength=live)
            at += wide
        return out


def count_tokens(docs: DataFrame) -> DataFrame:
    """(word binary, c long) over documents that are not held out; the empty word is the end. Workers add up first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_chunks(batch):
                seen = pc.value_counts(words_of(part.column("text"))[0])
                words_, c = seen.field("values").cast(pa.binary()), seen.field("counts")
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([words_, pa.array([END], pa.binary())]), pa.concat_arrays([c, pa.array([part.num_rows], pa.int64())])], ["word", "c"])

    train = docs.where(~is_held_out(F.col("doc_id"))).select(F.col("text").cast("string").alias("text"))
    return map_arrow(train, count, "word binary, c long", stream=True).groupBy("word").agg(F.sum("c").alias("c"))


def _most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Words by falling count, at most ``most`` of them: all with a count above a limit read off a histogram of sixteenths of
    powers of two. A sorted limit would send as many rows from every task."""
    words_ = counts.where(F.length("word") > 0)
    grade = F.floor(F.log2("c") * 16).cast("int")
    least, total = None, 0
    for r in sorted(words_.groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["g"]):
        total += r["n"]
        if total > most:
            break
        least = r["g"]
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["c"]) for r in words_.where(grade >= least).collect()), key=lambda x: (-x[1], x[0]))


def _sample(docs: DataFrame, ids_of: dict[bytes, int], other: int, share: float, block: int = 1024) -> list[np.ndarray]:
    """Blocks of training documents as ids, each drawn with chance ``share`` by a hash of document and block number."""

    of_docs = min(1.0, 16 * share)  # documents first, in the JVM, then blocks of those

    def draw(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for key, t in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.large_binary())):
            w = tokens(t.as_py())
            for k in range(0, len(w), block):
                if (key * 31 + k * 0x9E3779B97F4A7C15) % 2**61 * 0x9E3779B1 % 2**32 < share / of_docs * 2**32:
                    out.append(np.array([ids_of.get(x, other) for x in w[k : k + block]], np.int32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    key = F.pmod(F.xxhash64("doc_id"), F.lit(2**40))
    train = docs.where(~is_held_out(F.col("doc_id")) & (key < int(of_docs * 2**40))).select(key.alias("key"), F.col("text").cast("string").alias("text"))
    return [np.frombuffer(r["ids"], np.int32) for r in map_arrow(train, draw, "ids binary").orderBy(F.xxhash64("ids"), "ids").collect()]


def lanes_of(streams: list[np.ndarray], most: int = 384, least: int = 24) -> tuple[int, np.ndarray]:
    """(lanes, tokens): so many lanes that each has about ``least`` tokens or more, and all tokens, filled up from the first so
    that the lanes are of one length and none is left out."""
    flat = np.concatenate(streams)
    lanes = max(1, min(most, len(flat) // least))
    return lanes, np.resize(flat, -(-len(flat) // lanes) * lanes)


def _train_round(docs: DataFrame, model: GruLm, vocab: dict[bytes, int], other: int, end: int, part: tuple[float, float], *, rate: float, chunk: int = 1 << 20, piece: int = 4096) -> None:
    """One round over the training documents whose hash lies in ``part`` (of 0 to 1): the averaged weights replace the model's.

    A task holds at most about ``chunk`` tokens at a time. Weights travel in pieces, which are added up as they stream by."""
    sent = docs.sparkSession.sparkContext.broadcast((model, pa.array(list(vocab), pa.large_binary()), np.array([*vocab.values(), other], np.int32)))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        start, known, ids = sent.value
        own, read, waiting = None, 0, 0
        held: list[np.ndarray] = []

        def learn() -> None:
            nonlocal own, waiting
            own = own or copy.deepcopy(start)
            lanes, flat = lanes_of(held)
            with one_blas_thread():
                own.fit([flat], end, batch=lanes, epochs=1, rate=rate, fall=0.5)
            held.clear()
            waiting = 0

        for batch in batches:
            for part in byte_chunks(batch, 4 << 20):
                words_, cuts = words_of(part.column("text"))
                for doc in streams_of(ids.take(index_of(words_, known, len(known))), cuts, end):
                    held.append(doc)
                    read += len(doc)
                    waiting += len(doc)
                    if waiting > chunk:
                        learn()
        if held:
            learn()
        if own is not None:
            flat = np.concatenate([own.p[k].ravel() for k in sorted(own.p)]).astype(np.float32)
            cut = range(0, len(flat), piece)
            yield pa.RecordBatch.from_arrays([pa.array(list(range(len(cut))), pa.int32()), pa.array([read] * len(cut), pa.int64()), pa.array([flat[a : a + piece].tobytes() for a in cut], pa.binary())], ["piece", "n", "weights"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, n = None, None, 0
        done = []
        for batch in batches:
            for k, c, w in zip(*(batch.column(x).to_pylist() for x in ("piece", "n", "weights"))):
                if k != now:
                    if now is not None:
                        done.append((now, (total / n).astype(np.float32).tobytes()))
                    now, total, n = k, 0.0, 0
                total = total + np.frombuffer(w, np.float32).astype(float) * c
                n += c
        if now is not None:
            done.append((now, (total / n).astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int32()), pa.array([w for _, w in done], pa.binary())], ["piece", "weights"])

    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    chosen = docs.where(~is_held_out(F.col("doc_id")) & (place >= int(part[0] * (1 << 30))) & (place < int(part[1] * (1 << 30)))).select("text")
    made = map_arrow(chosen, train, "piece int, n long, weights binary", stream=True)
    # a few dozen pieces of 16 KB each: the model
    got = map_arrow(made.repartition("piece").sortWithinPartitions("piece"), average, "piece int, weights binary", stream=True).collect()
    if got:
        flat = np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(got, key=lambda r: r["piece"])])
        at = 0
        for k in sorted(model.p):
            size = model.p[k].size
            model.p[k] = flat[at : at + size].reshape(model.p[k].shape).copy()
            at += size
    model.__dict__.pop("table", None)
    sent.unpersist()


def score_documents(docs: DataFrame, *, vocabulary: int = 4096, head: int = 200_000, fit_tokens: int = 600_000, rounds: int = 2, hidden: int = 24, n_classes: int = 64) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of whole texts."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = materialize(count_tokens(docs), "token-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = _most_frequent(counts, head)
    ends = counts.where(F.length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    size = min(vocabulary, len(top))
    # ids by falling count: words of the vocabulary, with the end and the symbol for other words in their places
    known = sum(c for _, c in top[:size]) + ends
    ranked = sorted([*((c, k) for k, (_, c) in enumerate(top[:size])), (ends, size), (n - known, size + 1)], key=lambda x: (-x[0], x[1]))
    new_id = {k: i for i, (_, k) in enumerate(ranked)}
    end, other = new_id[size], new_id[size + 1]
    model = GruLm(np.array([c for c, _ in ranked], float), n_classes, hidden)
    vocab = {top[k][0]: new_id[k] for k in range(size)} | {END: end}
    if n:
        with one_blas_thread():
            model.fit(_sample(docs, vocab, other, min(1.0, fit_tokens / n)), end)
        for k in range(rounds):
            _train_round(docs, model, vocab, other, end, (k / rounds, (k + 1) / rounds), rate=0.003 / (k + 1))
    model.__dict__.pop("table", None)
    # a place in the head for each frequent word: its id in the network (or the symbol) and the log of its count
    words_ = [END, *(w for w, _ in top)]
    ids = np.array([end, *(new_id[k] if k < size else other for k in range(len(top)))], np.int32)
    logs = np.log10(np.array([ends, *(c for _, c in top)], float) + 0.1)
    alive = ends > 0
    sent = spark.sparkContext.broadcast((pa.array(words_, pa.large_binary()), ids, logs, model))

    def score(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        known, ids, logs, model = sent.value
        out = []
        for part in byte_chunks(batch, 24 << 20):
            words_, cuts = words_of(part.column("text"))
            found = index_of(words_, known, -1)
            # places of all tokens, the ends' being 0; each document has one at least
            place = np.insert(found, cuts[1:], 0)
            first = cuts[:-1] + np.arange(part.num_rows)
            head = place >= 0
            number = np.where(head, ids.take(place, mode="clip"), other)
            log = np.where(head, logs.take(place, mode="clip"), 0.0)
            is_other = number == other
            streams = np.split(number, first[1:])
            rows = {
                "n_tokens": np.diff(cuts) + 1,
                "n_head": np.add.reduceat(head.astype(np.int64), first) - (0 if alive else 1),
                "log_known": np.add.reduceat(np.where(is_other, 0.0, log), first),
                "log_other": np.add.reduceat(np.where(is_other, log, 0.0), first),
                "n_other": np.add.reduceat(is_other.astype(np.int64), first),
            }
            # words outside the head, each once a document with how often it occurs there
            at = np.flatnonzero(found < 0)
            rare = words_.take(pa.array(at)).dictionary_encode()
            pairs, k = np.unique((np.searchsorted(cuts, at, side="right") - 1) * max(len(rare.dictionary), 1) + rare.indices.to_numpy(), return_counts=True)
            doc, word = np.divmod(pairs, max(len(rare.dictionary), 1))
            words_of_doc = pa.StructArray.from_arrays([rare.dictionary.take(pa.array(word)).cast(pa.binary()), pa.array(k, pa.int64())], ["word", "k"])
            tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32()), words_of_doc)
            with one_blas_thread():
                lp = model.score(streams, end) / LN10
            arrays = [part.column("doc_id"), part.column("held_out"), *(pa.array(x) for x in rows.values()), pa.array(lp), tail]
            out.append(pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_head", "log_known", "log_other", "n_other", "network", "tail"]))
        return out

    schema = "doc_id long, held_out boolean, n_tokens long, n_head long, log_known double, log_other double, n_other long, network double, tail array<struct<word:binary,k:bigint>>"
    rows = map_arrow(docs.select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out")), score, schema)
    scored = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    tail = scored.select("row", F.explode_outer("tail").alias("t")).where(F.col("t").isNotNull()).select("row", F.col("t.word").alias("word"), F.col("t.k").alias("k"))
    looked = tail.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("log_tail"), F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("n_tail")
    )
    log_other = F.col("log_other") + F.coalesce("log_tail", F.lit(0.0))
    log_n = float(np.log10(n + 0.1 * (v + 1)))
    rest = n - known
    log_rest = float(np.log10(rest + 0.1 * (v - size - (1 if alive else 0) + 1)))
    return scored.drop("tail").join(looked, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("log_known") + log_other - F.col("n_tokens") * F.lit(log_n)).alias("base_score"),
        (F.col("network") + log_other - F.col("n_other") * F.lit(log_rest)).alias("score"),
    )
