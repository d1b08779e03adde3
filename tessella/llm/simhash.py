"""SimHash near-duplicates by a segment-popcount embedding (operator 5).

1. Fingerprints: XXH64 of every word shingle, one pass of Arrow batches; bit counts come from byte histograms.
2. Distinct fingerprints are grouped first, so copies cost one row however many there are.
3. A fingerprint of 64 bits maps to the vector of its segments' bit counts. The Manhattan distance of two vectors never
   exceeds the Hamming distance of the fingerprints, so a range join on vectors misses no link. The join is a grid
   join: vectors at distance d <= 2 have a grid point within 1 of both, so each vector is put into the cells within 1.
4. Fingerprints that share a cell are verified exactly. Small cells are compared by pairs. Cells with more than
   ``pair_cell`` fingerprints would need pairs in the square of their size; their fingerprints meet instead in the points
   at one bit or none from each (a pair within 2 bits shares such a point, and no point has more than 65 members), which
   is exact as well.
5. Components: alternating minimum-label steps (large star, small star) over links between distinct fingerprints.

Defined results: a null or blank text has fingerprint zero and links like any other; a repeated id is one row each time;
null ids belong to components but never name one (a component with no other ids has the null id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import byte_chunks, discard, map_arrow, materialize, row_copy

BITS = 64
SEED = 42
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_TO_LOWER = bytes.maketrans(_UPPER, _LOWER)


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """SimHash of a UTF-8 text: lower-cased A-Z, words parted by white space, ``size``-word shingles with repeats."""
    w = (text or b"").translate(_TO_LOWER).split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = [0, *(ends[:-size] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64)
    return bits_over_half(hashes)


def bits_over_half(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half of the hashes."""
    by_byte = hashes.view(np.uint8).reshape(-1, 8)  # little-endian
    counts = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ _BIT_OF_BYTE for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp long): fp is the fingerprint's bits as a signed number."""

    def of(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for part in byte_chunks(batch):
            texts = part.column("text").cast(pa.large_binary())
            fp = np.array([fingerprint(t.as_py(), size) for t in texts], np.uint64).view(np.int64)
            out.append(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"]))
        return out

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), of, "doc_id long, fp long")


def cells(fps: DataFrame, segments: int = 32) -> DataFrame:
    """(cell, fp): grid cells within Manhattan distance 1 of a fingerprint's segment popcounts.

    Only cells whose counts can occur are made: a point between two vectors has coordinates between theirs. A cell is
    the pair of two longs, in which each segment has its count in a field of ``64 / (segments / 2)`` bits.
    """
    width = BITS // segments
    half = segments // 2
    field = BITS // half

    def grid(part: pa.RecordBatch) -> pa.RecordBatch:
        fp = part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        vector = bits.reshape(-1, segments, width).sum(axis=2).astype(np.uint64)
        shift = (np.arange(half, dtype=np.uint64) * np.uint64(field))[None, :]
        lo = (vector[:, :half] << shift).sum(axis=1, dtype=np.uint64)
        hi = (vector[:, half:] << shift).sum(axis=1, dtype=np.uint64)
        out = [(lo, hi, fp)]
        for s in range(segments):
            one = np.uint64(1) << np.uint64(field * (s % half))
            for up in (True, False):
                at = vector[:, s] < width if up else vector[:, s] > 0
                a, b = lo[at], hi[at]
                if s < half:
                    a = a + one if up else a - one
                else:
                    b = b + one if up else b - one
                out.append((a, b, fp[at]))
        a, b, f = (np.concatenate(x).view(np.int64) for x in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(f)], ["lo", "hi", "fp"])

    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        return [grid(batch.slice(i, 4096)) for i in range(0, batch.num_rows, 4096)]

    return map_arrow(fps.select("fp"), run, "lo long, hi long, fp long")


def links(fps: DataFrame, *, distance: int = 2, segments: int = 32, pair_cell: int = 16) -> DataFrame:
    """(a, b) with a < b: links that connect all distinct fingerprints at ``distance`` (at most 2) or fewer bits.

    Every pair in a small cell is given. In large cells the members of a one-bit point are linked to its least one; as
    any two members of a point are within 2 bits, these are true links and connect the same components.
    """
    if distance != 2:
        raise ValueError("the grid is laid out for a distance of 2 bits")
    keyed = materialize(cells(fps, segments), "cells")
    crowd = keyed.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(keyed.join(crowd, ["lo", "hi"]), "shared-cells")
    small = shared.where(F.col("n") <= pair_cell)
    left, right = small.select("lo", "hi", F.col("fp").alias("a")), small.select("lo", "hi", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = left.join(right, ["lo", "hi"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    crowded = shared.where(F.col("n") > pair_cell).select("fp").distinct()
    points = crowded.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(BITS)])).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("members")).select("a", F.explode("members").alias("b")).where("a < b")
    return pairs.unionByName(least).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each component of the undirected edges (a, b), for nodes with an edge.

    Large-star and small-star steps by turns until nothing changes. A step groups only by minimum, which combines
    before the shuffle; each round is written to the shared folder.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        before, now = now, materialize(small, "small-star")
        discard(before, large)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if new == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, *, size: int = 3, distance: int = 2, segments: int = 32, pair_cell: int = 16) -> DataFrame:
    """(doc_id, fp, component_id) for every document."""
    marked = materialize(fingerprints(docs, size), "fingerprints")
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    rooted = components(links(fps, distance=distance, segments=segments, pair_cell=pair_cell))
    grouped = fps.join(rooted, fps.fp == rooted.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialize(grouped.join(lowest, "root").select("fp", "component_id"), "components")
    # the many copies of one fingerprint are a skewed key here; adaptive execution splits such partitions
    return marked.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def drop_near_duplicates(docs: DataFrame, *, size: int = 3, **how: int) -> DataFrame:
    """One row of each component stays, with all its columns: the one with the least id, null ids last.

    Rows are told apart by id and text, so rows that repeat an id with unlike texts are judged apart.
    """
    from tessella.llm.near_copies import keep_rows

    text = F.col("text").cast("string")
    found = near_duplicates(docs.select(row_copy(text).alias("doc_id"), "text"), size=size, **how)
    groups = materialize(found.groupBy(F.col("doc_id").alias("copy")).agg(F.min("component_id").alias("root")), "copy-components")
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_copy(text).alias("copy"))
    least = marked.join(groups, "copy").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")).alias("f"))
    return keep_rows(docs, least.select(F.col("f.doc_id").alias("v_id"), F.col("f.copy").alias("v_copy")), marked)
