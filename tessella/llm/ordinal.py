"""Quality classifier: ordinal cumulative-link regression on graded ratings (operator 6).

Grades are ordered; one weight vector over hashed words is shared by all of them, and ordered thresholds cut its score:
P(grade >= k) = sigmoid(score - threshold_k). Expected grade and tail probabilities follow from the tails. Words are hashed
by CRC-32 into ``2**bits`` places; a document's vector has a 1 in the place of each of its words. Places that fewer than
``RARE`` of the fitted documents have get no weight, as they would only learn documents by heart.

The weights are fitted on at most ``fit_rows`` labelled documents (those with the least hashes of their ids; every
labelled one where there are fewer); scoring reads every document whole.

Defined results: a null or blank text has the zero vector and gets the prior's tails; ratings that are null or out of range
are left out, and a repeated id counts by its lowest grade and one of its texts; without two grades the model is flat (every tail 1/2).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import byte_chunks, map_arrow, materialize

_TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class WordPlaces:
    """CRC-32 places of words, remembered for a bounded number of them."""

    def __init__(self, bits: int, most: int = 300_000):
        self.mask, self.most, self.known = (1 << bits) - 1, most, {}

    def of(self, text: bytes | None) -> np.ndarray:
        known, mask = self.known, self.mask
        if len(known) > self.most:
            known.clear()
        w = (text or b"").translate(_TO_LOWER).split()
        try:
            return np.array([known[x] for x in w], np.int32)
        except KeyError:
            out = [known[x] if x in known else known.setdefault(x, zlib.crc32(x) & mask) for x in w]
            return np.array(out, np.int32)


def text_vector(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places and their values."""
    at = np.unique(places)
    return at, np.ones(len(at))


#: A place that fewer fitted documents have is too rare to be fitted.
RARE = 3


@dataclass
class CumulativeLink:
    """P(grade >= k + 1) = sigmoid(w . x - thresholds[k])."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, dim: int, *, epochs: int = 40, rate: float = 0.3, batch: int = 256, penalty: float = 1e-3, seed: int = 7) -> CumulativeLink:
    """Mini-batch adaptive gradients on the likelihood of the grade; thresholds are kept in order by their gaps' logs."""
    w = np.zeros(dim)
    share = np.array([(grades >= k + 1).mean() if len(grades) else 0.5 for k in range(n_grades - 1)])
    share = np.clip(share, 1e-3, 1 - 1e-3)
    first = np.log((1 - share) / share)
    if len(set(grades.tolist())) < 2:
        return CumulativeLink(w, np.zeros(n_grades - 1))
    often = np.bincount(np.concatenate([a for a, _ in vectors]), minlength=dim) >= RARE
    vectors = [(a[often[a]], b[often[a]]) for a, b in vectors]
    theta = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    gw, gt = np.full(dim, 1e-6), np.full(n_grades - 1, 1e-6)
    sizes = np.array([len(a) for a, _ in vectors])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    at, x = np.concatenate([a for a, _ in vectors]), np.concatenate([b for _, b in vectors])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(vectors))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            pick = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in rows])
            of = np.repeat(np.arange(len(rows)), sizes[rows])
            a, b, y = at[pick], x[pick], grades[rows]
            score = np.bincount(of, weights=w[a] * b, minlength=len(rows))
            cuts = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
            s = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -40, 40)))
            tail = np.concatenate([np.ones((len(rows), 1)), s, np.zeros((len(rows), 1))], axis=1)
            r = np.arange(len(rows))
            p = np.maximum(tail[r, y] - tail[r, y + 1], 1e-9)
            d = np.concatenate([np.zeros((len(rows), 1)), s * (1 - s), np.zeros((len(rows), 1))], axis=1)
            upper, lower = d[r, y] / p, d[r, y + 1] / p
            dscore = -(upper - lower)
            g = np.bincount(a, weights=dscore[of] * b, minlength=dim) / len(rows) + penalty * w
            dcut = np.zeros(n_grades + 1)
            np.add.at(dcut, y, upper)
            np.add.at(dcut, y + 1, -lower)
            dcut = dcut[1:-1] / len(rows)
            dtheta = np.cumsum(dcut[::-1])[::-1] * np.concatenate([[1.0], np.exp(theta[1:])])
            gw += g * g
            gt += dtheta * dtheta
            w -= rate * g / np.sqrt(gw)
            theta -= 0.5 * rate * dtheta / np.sqrt(gt)
    return CumulativeLink(w, np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])])))


def learn_grades(docs: DataFrame, ratings: DataFrame, *, n_grades: int, bits: int = 18, fit_rows: int = 8000) -> CumulativeLink:
    """Fit on rated documents; ``ratings``: (doc_id, grade) with grades 0 to ``n_grades`` - 1."""
    good = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, n_grades - 1)).groupBy(F.col("doc_id").alias("r_id")).agg(F.min("grade").cast("int").alias("grade"))
    chosen = materialize(good.orderBy(F.xxhash64("r_id"), "r_id").limit(fit_rows), "rated")
    rated = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, F.col("doc_id") == F.col("r_id"))
    # one row an id, however often it repeats: the text with the least hash; this combines before its shuffle
    rows = rated.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"))

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        places = WordPlaces(bits)
        made = [text_vector(places.of(t.as_py())) for t in batch.column("text").cast(pa.large_binary())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array([a.astype(np.int32).tobytes() for a, _ in made], pa.binary()), pa.array([b.astype(np.float32).tobytes() for _, b in made], pa.binary())], ["doc_id", "grade", "at", "x"])

    got = map_arrow(rows, vectors, "doc_id long, grade int, at binary, x binary").orderBy("doc_id", "at").collect()
    found = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32).astype(float)) for r in got]
    return fit(found, np.array([r["grade"] for r in got], int), n_grades, 1 << bits)


def grade_documents(docs: DataFrame, ratings: DataFrame, *, n_grades: int = 3, select_tail: int = 2, least: float = 0.4, bits: int = 18, fit_rows: int = 8000) -> DataFrame:
    """(doc_id, expected_grade, p_ge_1 ... , selected) for every document; selected: P(grade >= ``select_tail``) >= ``least``."""
    model = learn_grades(docs, ratings, n_grades=n_grades, bits=bits, fit_rows=fit_rows)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    tails = [f"p_ge_{k}" for k in range(1, n_grades)]
    kept: dict[str, WordPlaces] = {}

    def grade(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        weights, thresholds = sent.value
        places = kept.setdefault("places", WordPlaces(bits))
        out = []
        for part in byte_chunks(batch):
            score = np.zeros(part.num_rows)
            for i, t in enumerate(part.column("text").cast(pa.large_binary())):
                at = places.of(t.as_py())
                if len(at):
                    at, x = text_vector(at)
                    score[i] = float(weights[at] @ x)
            p = CumulativeLink(weights, thresholds).tails(score)
            out.append(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p.sum(axis=1)), *(pa.array(p[:, k]) for k in range(n_grades - 1)), pa.array(p[:, select_tail - 1] >= least)], ["doc_id", "expected_grade", *tails, "selected"]))
        return out

    schema = ", ".join(["doc_id long", "expected_grade double", *(f"{t} double" for t in tails), "selected boolean"])
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), grade, schema)


def grade_of_labels(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Graded rating of a labelled document: 0 toxic, 1 of low quality, 2 good; null where a label that decides is null."""
    return F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when((F.col(quality) == 1) & (F.col(toxic) == 0), 2)
