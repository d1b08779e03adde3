"""SimHash near-dedup's wide mode: near copies by the similarity of word shingles (the pipeline's de-duplication stage).

Candidates come from SimHash and, as similarity of 0.8 on five-word shingles puts fingerprints of 64 bits up to 14 bits apart,
where segment popcounts no longer tell pairs from chance, from MinHash besides (see the README). Both are checked exactly.

1. Copies with the same words collapse first: a text's key is XXH64 of its lower-cased words.
   SimHash: texts with one fingerprint, and fingerprints that ``simhash.links`` joins by segment popcounts, are candidates.
2. MinHash: ``bands`` keys of ``rows`` minima each over the hashes of a text's distinct shingles. A pair of similarity s
   shares a band with the chance 1 - (1 - s^rows)^bands, at 0.8 with the defaults 0.999997, above it more.
3. The texts of a band's bucket are compared with one of them, its centre, exactly, by their shingle sets: a star. A star of many
   members is dealt out in parts, each with a copy of its centre, so a large group of near copies costs one comparison a
   member and no task holds a group. Links make components.
4. Where a bucket still holds several components, pairs across them are compared too, in blocks of members that carry the
   64-bit hashes of their shingles: exactly, inside the tasks, so that pairs which are not alike never become rows.

Only texts that may be compared or dropped move: a filter of bounded size (``common.row_filter``) tells the others where they
are read. The joins are merge joins at every size, so that costs grow in proportion to the input.

Defined results: shingles and words are those of ``simhash.fingerprint``; a text of fewer than ``size`` words is one
shingle; null and blank texts are copies of each other. A row is its id and its text: rows that repeat an id with other
texts are judged apart, rows that repeat both count as copies. Of a group the row with the least id stays (null ids last).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import COPY, byte_chunks, discard, in_filter, map_arrow, materialize, row_copy, row_filter, same_row
from tessella.llm.simhash import _TO_LOWER, SEED, components, fingerprint, links as fingerprint_links

SIZE = 5
SIMILARITY = 0.8
#: Members of a star that one part compares, and of a block of a mixed bucket (about), where a member has MEAN shingles at most.
PART = 256
BLOCK = 1024
MEAN = 256


def _joined(text: bytes | None) -> bytes:
    """Lower-cased words (A-Z only) with one space between."""
    return b" ".join((text or b"").translate(_TO_LOWER).split())


def shingles(text: bytes | None, size: int = SIZE) -> set[bytes]:
    """Distinct shingles of a UTF-8 text."""
    w = _joined(text).split()
    return {b" ".join(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def alike(x: set[bytes], y: set[bytes], similarity: float = SIMILARITY) -> bool:
    """Whether the shared shingles are at least ``similarity`` of both texts' shingles."""
    both = len(x & y)
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


class MinHash:
    """Band keys of a text."""

    def __init__(self, size: int, bands: int, rows: int):
        rng = np.random.default_rng(SEED)
        self.size, self.bands, self.rows = size, bands, rows
        self.times = rng.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 2**63, bands * rows, np.uint64)

    def of(self, text: bytes | None) -> tuple[int, list[int]]:
        """(key of the whole text, keys of its bands)."""
        h = xxhash.xxh64_intdigest
        hashes = np.array([h(s, SEED) for s in shingles(text, self.size)], np.uint64)
        least = np.full(self.bands * self.rows, 2**64 - 1, np.uint64)
        for at in range(0, len(hashes), 512):
            np.minimum(least, (hashes[at : at + 512, None] * self.times + self.plus).min(axis=0), out=least)
        return h(_joined(text), SEED), [h(row.tobytes(), k) for k, row in enumerate(least.reshape(self.bands, self.rows))]


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, _copy, text)."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_copy(text).alias(COPY), text.alias("text"))


def banded(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, copy, key long, fp long, bands array<long>) of every row; fp is the SimHash fingerprint of its shingles."""
    of = MinHash(size, bands, rows)

    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for part in byte_chunks(batch):
            texts = [t.as_py() for t in part.column("text").cast(pa.large_binary())]
            found = [of.of(t) for t in texts]
            fp = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
            key = np.array([k for k, _ in found], np.uint64).view(np.int64)
            each = np.array([b for _, b in found], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * bands, pa.array(each.ravel()))
            out.append(pa.RecordBatch.from_arrays([part.column("doc_id"), part.column(COPY), pa.array(key), pa.array(fp), lists], ["doc_id", "copy", "key", "fp", "bands"]))
        return out

    return map_arrow(_rows(docs), run, "doc_id long, copy long, key long, fp long, bands array<long>")


def _fingerprint_pairs(one: DataFrame) -> DataFrame:
    """(a, b) of keys: each text with the first one of its fingerprint, and the first ones of linked fingerprints."""
    lead = materialize(one.groupBy("fp").agg(F.min("key").alias("lead")), "distinct-fingerprints")
    same = one.join(lead, "fp").where("key != lead").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    x, y = (lead.select(F.col("fp").alias(f"fp_{c}"), F.col("lead").alias(c)) for c in "xy")
    met = fingerprint_links(lead.select("fp"))
    linked = met.join(x, met.a == F.col("fp_x")).join(y, met.b == F.col("fp_y")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return same.unionByName(linked)


def _alike_pairs(pairs: DataFrame, one: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The distinct pairs (a, b) of keys whose texts are alike; a is the centre of a star."""
    stars = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    members = pairs.join(stars, "a").select("a", F.pmod("b", "parts").alias("part"), F.col("b").alias("key"))
    centres = stars.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("key"))
    wanted = members.unionByName(centres).join(one.select("key", F.col("first.doc_id").alias("v_id"), F.col("first.copy").alias("v_copy")), "key")
    wanted = materialize(wanted, "star-rows")
    rows = in_filter(_rows(docs), row_filter(wanted), inside=True)
    met = rows.hint("merge").join(wanted, same_row(rows, wanted)).select("a", "part", "key", "text")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that repeat the row before: repeats of a document lie side by side after the merge."""
        before = None
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("a", "part", "key"))))
            keep = [x != y for x, y in zip(names, [before, *names])]
            before = names[-1] if names else before
            yield batch.filter(pa.array(keep, pa.bool_()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, centre = None, set()
        for batch in batches:
            for part in byte_chunks(batch):
                hit = []
                for a, p, key, text in zip(*(part.column(c).to_pylist() for c in ("a", "part", "key")), part.column("text").cast(pa.large_binary())):
                    if key == a:
                        if star != (a, p):
                            star, centre = (a, p), shingles(text.as_py(), size)
                    elif star == (a, p) and alike(centre, shingles(text.as_py(), size), similarity):
                        hit.append((a, key))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in hit], pa.int64()) for k in (0, 1)], ["a", "b"])

    rows = map_arrow(met, once, "a long, part long, key long, text string", stream=True)
    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("key") != F.col("a"), "key")
    return map_arrow(dealt, compare, "a long, b long", stream=True).distinct()


def _shingle_sets(keys: DataFrame, one: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(key, shingles binary, n) of some keys: the sorted 64-bit hashes of the distinct shingles, and how many they are."""
    wanted = materialize(keys.join(one.select("key", F.col("first.doc_id").alias("v_id"), F.col("first.copy").alias("v_copy")), "key"), "mixed-rows")
    rows = in_filter(_rows(docs), row_filter(wanted), inside=True)
    met = rows.hint("merge").join(wanted, same_row(rows, wanted)).select("key", "text")
    h = xxhash.xxh64_intdigest

    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for part in byte_chunks(batch):
            sets = [np.unique(np.array([h(s, SEED) for s in shingles(t.as_py(), size)], np.uint64)) for t in part.column("text").cast(pa.large_binary())]
            out.append(pa.RecordBatch.from_arrays([part.column("key"), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64())], ["key", "shingles", "n"]))
        return out

    return materialize(map_arrow(met, run, "key long, shingles binary, n long").groupBy("key").agg(F.first("shingles").alias("shingles"), F.first("n").alias("n")), "mixed-shingles")


def _forest(key: np.ndarray, root: np.ndarray, sets: list[np.ndarray], meet: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (a, b) that connect what alike pairs connect, among members whose ``meet`` differs; a ``root`` is one from the start."""
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    group, mark, found = root.copy(), np.zeros(len(ids) + 1, bool), []
    for x in range(len(key)):
        # a set of the size of x or more, the later one of equal size
        fits = (sizes[x] >= similarity * sizes - 1e-9) & ((sizes > sizes[x]) | ((sizes == sizes[x]) & (np.arange(len(key)) > x)))
        at = np.flatnonzero(fits & (meet[x] != meet) & (group != group[x]))
        if not len(at):
            continue
        own = ids[begins[x] : begins[x] + sizes[x]]
        mark[own] = True
        ends = np.cumsum(sizes[at])
        takes = np.repeat(begins[at] - ends + sizes[at], sizes[at]) + np.arange(ends[-1])
        both = np.add.reduceat(mark[ids[takes]], ends - sizes[at], dtype=np.int64)
        mark[own] = False
        for k in at[both >= similarity * (sizes[x] + sizes[at] - both) - 1e-9]:
            if group[k] != group[x]:
                found.append((int(key[x]), int(key[k])))
                group[group == group[k]] = group[x]
    return found


def _cross_links(mixed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between mixed buckets' members of different components, as many as connect all that alike pairs connect.

    A bucket's members are packed into blocks, one row each: components of ``BLOCK`` members or more have blocks of their own,
    the others share theirs; ``MEAN`` shingles a member count as one, a longer text as several. Two blocks of one large component
    need not meet, so a large group with a few members outside costs a comparison with those few. Pairs are compared exactly,
    by their sets, inside the task that holds the two blocks; only links that join two groups there become rows. The sets
    are shuffled once into blocks, and again only where a bucket has several.
    """
    mixed = materialize(mixed.join(sets.select("key", F.greatest(F.lit(1.0), F.col("n") / MEAN).alias("load")), "key"), "mixed-members")
    sizes = mixed.groupBy("bucket", "root").agg(F.sum("load").alias("load")).withColumn("own", F.when(F.col("load") >= BLOCK, F.col("root")))
    parts = sizes.groupBy(F.col("bucket").alias("p_bucket"), F.col("own").alias("p_own")).agg(F.ceil(F.sum("load") / BLOCK).alias("parts"))
    placed = mixed.drop("load").join(sizes.drop("load"), ["bucket", "root"])
    placed = placed.join(parts, (F.col("bucket") == F.col("p_bucket")) & F.col("own").eqNullSafe(F.col("p_own")))
    part = F.pmod(F.xxhash64("key"), "parts")
    placed = materialize(placed.select("bucket", "key", "root", "own", F.xxhash64(F.lit(1), "own", part).alias("id")), "block-members")
    every = placed.select("bucket", "id", "own").distinct().groupBy("bucket").agg(F.collect_list(F.struct("id", "own")).alias("every"))
    foreign = F.filter("every", lambda x: F.col("own").isNull() | x["own"].isNull() | (x["own"] != F.col("own")))
    blocks = placed.join(sets.select("key", "shingles"), "key").groupBy("bucket", "id", "own").agg(F.collect_list(F.struct("key", "root", "shingles")).alias("members"))
    sent = blocks.join(every, "bucket").select("bucket", "id", "members", F.explode(F.transform(foreign, lambda x: x["id"])).alias("other"))
    dealt = sent.select("bucket", F.least("id", "other").alias("i"), F.greatest("id", "other").alias("j"), "id", "members")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None

        def links() -> pa.RecordBatch:
            key, root = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            # within one block each pair meets, between blocks each member meets the other block
            side = np.arange(len(key)) if group[1] == group[2] else np.concatenate([np.full(len(h[1]), h[0]) for h in held])
            found = _forest(key, root, [s for h in held for s in h[3]], side, similarity)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in range(batch.num_rows):
                b, i, j, own = (batch.column(c)[row].as_py() for c in ("bucket", "i", "j", "id"))
                if (b, i, j) != group:
                    if held:
                        yield links()
                    held, group = [], (b, i, j)
                members = batch.column("members")[row].values
                key, root = (members.field(c).to_numpy(zero_copy_only=False).copy() for c in ("key", "root"))
                held.append((own, key, root, [np.frombuffer(x.as_py(), np.uint64) for x in members.field("shingles")]))
        if held:
            yield links()

    # a block that meets itself is whole where it is
    ordered = dealt.where("i != j").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    alone, across = (map_arrow(x, meet, "a long, b long", stream=True) for x in (dealt.where("i = j"), ordered))
    return alone.unionByName(across).distinct()


def _classes(docs: DataFrame, size: int, similarity: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, copy, key ...; texts: key, first, root): ``first`` is the text's row with the least id."""
    marked = materialize(banded(docs, size, bands, rows), "banded")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")).alias("first")
    one = materialize(marked.groupBy("key").agg(first, F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct-texts")
    keyed = one.select("key", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("bucket")
    found = materialize(keyed.hint("merge").join(shared, "bucket"), "shared-buckets")
    # a bucket's centre is the member whose buckets are the largest: an original has more in common with its copies than they have
    degree = found.join(found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket").groupBy("key").agg(F.sum("n").alias("degree"))
    centre = found.join(degree, "key").groupBy("bucket").agg(F.max_by("key", F.struct("degree", "key")).alias("centre"))
    members = materialize(found.join(centre, "bucket"), "bucket-members")
    stars = members.where("key != centre").select(F.col("centre").alias("a"), F.col("key").alias("b"))
    pairs = materialize(stars.unionByName(_fingerprint_pairs(one)).distinct(), "star-pairs")
    links = materialize(_alike_pairs(pairs, one, docs, size, similarity), "star-links")
    rooted = components(links)
    placed = materialize(members.join(rooted, members.key == rooted.node, "left").select("bucket", "key", "centre", F.coalesce("root", "key").alias("root")), "placed-members")
    # buckets of the same members compare the same pairs: one of them does
    same = [F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"same{k}") for k in range(2)]
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("n"), *same).where("r0 < r1")
    open_ = open_.groupBy("n", "same0", "same1").agg(F.min("bucket").alias("bucket")).select("bucket")
    mixed = placed.join(open_, "bucket").select("bucket", "key", "root")
    sets = _shingle_sets(mixed.select("key").distinct(), one, docs, size)
    cross = materialize(_cross_links(mixed, sets, similarity), "cross-links")
    if not cross.isEmpty():
        rooted = components(links.unionByName(cross))
    texts = materialize(one.join(rooted, one.key == rooted.node, "left").select("key", "first", F.coalesce("root", "key").alias("root")), "copy-groups")
    discard(one, found, members, pairs, links, placed, sets, cross)
    return marked.select("doc_id", "copy", "key"), texts


def near_copies(docs: DataFrame, *, size: int = SIZE, similarity: float = SIMILARITY, bands: int = 32, rows: int = 5) -> DataFrame:
    """(doc_id, key, component_id) for every document: component_id is the least id of its group of near copies."""
    marked, texts = _classes(docs, size, similarity, bands, rows)
    lowest = texts.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    named = texts.join(lowest, "root").select("key", "component_id")
    return marked.join(named, "key", "left").select("doc_id", "key", "component_id")


def drop_near_copies(docs: DataFrame, *, size: int = SIZE, similarity: float = SIMILARITY, bands: int = 32, rows: int = 5) -> DataFrame:
    """One row of each group of near copies stays, with all its columns: the one with the least id, null ids last."""
    marked, texts = _classes(docs, size, similarity, bands, rows)
    first = texts.groupBy("root").agg(F.min("first").alias("f")).select(F.col("f.doc_id").alias("v_id"), F.col("f.copy").alias("v_copy"))
    return keep_rows(docs, first, marked)


def keep_rows(docs: DataFrame, first: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``first`` (v_id, v_copy) names, one each; ``marked`` has (doc_id, copy) of all rows.

    Rows to drop or to fold into one are listed, and a filter of bounded size tells most other rows from them where they are
    read. Only rows that may be listed are shuffled, to be settled exactly.
    """
    times = marked.groupBy(F.col("doc_id").alias("m_id"), F.col("copy").alias("m_copy")).agg(F.count(F.lit(1)).alias("times"))
    named = times.join(first.withColumn("stays", F.lit(True)), times["m_id"].eqNullSafe(first["v_id"]) & (times["m_copy"] == first["v_copy"]), "left")
    listed = named.where(F.col("stays").isNull() | (F.col("times") > 1)).select(F.col("m_id").alias("v_id"), F.col("m_copy").alias("v_copy"), F.coalesce("stays", F.lit(False)).alias("folds"))
    listed = materialize(listed, "listed-rows")
    bits = row_filter(listed)
    given = docs.withColumn(COPY, row_copy(F.col("text").cast("string")))
    clear = in_filter(given, bits, inside=False)
    open_ = in_filter(given, bits, inside=True).hint("merge")
    others = open_.join(listed, same_row(open_, listed), "left_anti")
    folds = listed.where("folds")
    each = [F.col(c) for c in docs.columns]
    folded = open_.join(folds, same_row(open_, folds), "left_semi").groupBy(F.xxhash64("doc_id", COPY).alias("_g"), "doc_id", COPY).agg(F.min_by(F.struct(*each), F.xxhash64(*each)).alias("_row"))
    return clear.select(*docs.columns).unionByName(others.select(*docs.columns)).unionByName(folded.select("_row.*"))
