"""Clusters of token sets over all pairs at a Jaccard similarity or more, without a bound on buckets or candidates (T-8)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.storage import discard, perhaps_in, stored

#: Pairs that are compared at once; classes whose tokens are ordered at once (at most 14 bits of a sort key), and bytes of their keys.
AT_ONCE, ROWS, BYTES = 1 << 18, 1 << 13, 1 << 22
#: 64-bit words of a sketch.
WORDS = 3
#: Groups up to this size are compared as Python sets.
FEW = 12

Columns = list[np.ndarray]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts, so that long keys do not add up."""
    end_of = np.cumsum(pc.binary_length(batch.column("key")).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        fit = int(np.searchsorted(end_of, (end_of[begin - 1] if begin else 0) + BYTES, "right"))
        end = min(begin + ROWS, max(begin + 1, fit))
        yield batch.slice(begin, end - begin)
        begin = end


def _prefix_rows(classes: DataFrame, place: dict[str, int], threshold: float) -> DataFrame:
    """(k, cls, size, s0, s1, s2): a row for each token of a class's prefix. Tokens are in one order for all classes, rarest first; two
    sets of the similarity share a token of both prefixes, whatever the order. k is the token's CRC-32 (tokens of one CRC share a bucket, which
    only adds comparisons); size has the tokens of the class in its upper half and in its lower half those from this one on. A sketch's
    bits are parities of tokens, so bits that differ are never more than the tokens that differ."""
    sent = classes.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sent.value
        for whole in batches:
            for batch in _slices(whole):
                parts = pc.split_pattern(batch.column("key"), " ")
                n = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
                words = pc.list_flatten(parts).dictionary_encode()
                code = np.fromiter((at.get(w) or zlib.crc32(w.encode()) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
                row = np.repeat(np.arange(len(n)), n)
                token = np.sort(code[words.indices.to_numpy()] | row.astype(np.uint64) << np.uint64(50)) & np.uint64(0xFFFFFFFF)
                first = np.cumsum(n) - n
                bit = token % np.uint64(64 * WORDS)
                one = np.uint64(1) << (bit & np.uint64(63))
                sketch = [np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == w, one, np.uint64(0)), first).view(np.int64) for w in range(WORDS)]
                left = np.repeat(n + first, n) - np.arange(len(row))
                # the least overlap with any partner lies in the tokens from a prefix token on
                kept = left >= np.ceil(threshold * n - 1e-9).astype(np.int64)[row]
                row = row[kept]
                cls = batch.column("cls").to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token[kept].astype(np.uint32).view(np.int32), cls, n[row] << 32 | left[kept], *(s[row] for s in sketch))], ["k", "cls", "size", *(f"s{w}" for w in range(WORDS))])

    return classes.select("cls", "key").mapInArrow(run, "k int, cls long, size long, " + ", ".join(f"s{w} long" for w in range(WORDS)))


def _link(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of ``a`` and ``b``; ``root`` holds each row's least one before and after."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root[:] = further


def _candidates(columns: Columns, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(group, cls): classes linked by pairs of one bucket that may have the similarity, judged by sizes, places and sketches.
    The columns hold whole buckets."""
    order = np.lexsort((columns[2], columns[0]))
    k, cls, size, *sketch = (c[order] for c in columns)
    n, left = size >> 32, size & 0xFFFFFFFF
    share, apart = threshold / (1 + threshold), (1 - threshold) / (1 + threshold)
    bucket = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]])).astype(np.int64)
    # the smaller set of a pair comes first; their first common token has the whole overlap from it on in both
    most = np.minimum(np.floor(n / threshold + 1e-9), np.floor(left / share - n + 1e-9)).astype(np.int64)
    count = np.maximum(np.searchsorted(bucket << 32 | n, bucket << 32 | np.maximum(most, 0), "right") - np.arange(len(k)) - 1, 0)
    root = np.arange(len(k))
    asked = np.flatnonzero(count)
    total = np.cumsum(count[asked])
    begin = 0
    while begin < len(asked):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + AT_ONCE, "right")))
        x, c = asked[begin:end], count[asked[begin:end]]
        a = np.repeat(x, c)
        b = np.arange(len(a)) + np.repeat(x + 1 - (np.cumsum(c) - c), c)
        both = n[a] + n[b]
        good = left[b] >= both * share - 1e-9
        a, b, both = a[good], b[good], both[good]
        differ, bound = np.zeros(len(a), np.int64), both * apart + 1e-9
        for s in sketch:
            differ += np.bitwise_count((s[a] ^ s[b]).view(np.uint64))
            good = differ <= bound
            a, b, differ, bound = a[good], b[good], differ[good], bound[good]
        _link(root, a, b)
        begin = end
    met = np.bincount(root, minlength=len(root))[root] > 1
    return root[met], cls[met]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, cut between values of the first one only."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1], "left"))
        if held and (cut or held[-1][0][-1] != columns[0][0]):
            held.append([c[:cut] for c in columns])
            yield [np.concatenate(c) for c in zip(*held)]
            held = []
        elif cut:
            yield [c[:cut] for c in columns]
        held.append([c[cut:] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _groups(rows: DataFrame, threshold: float) -> DataFrame:
    """(g, cls): groups of classes that may be linked in one bucket. A group is named by its members, so that buckets with the same
    members give it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_groups(batches):
            root, cls = _candidates(columns, threshold)
            order = np.lexsort((cls, root))
            root, cls = root[order], cls[order]
            names, sizes = [], []
            for members in np.split(cls, np.flatnonzero(root[1:] != root[:-1]) + 1) if len(cls) else []:
                names.append(int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True))
                sizes.append(len(members))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, np.int64), sizes), pa.int64()), pa.array(cls, pa.int64())], ["g", "cls"])

    return rows.repartition("k").sortWithinPartitions("k").mapInArrow(run, "g long, cls long")


def _tree(keys: list[str], threshold: float) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of the sets that have the similarity, exact. Each set is compared with those that no link has
    reached yet, so a large group of near copies ends early."""
    sets: list[set[str]] = [set(key.split(" ")) for key in keys]
    if len(sets) <= FEW:
        rest = list(range(len(sets)))
        while rest:
            front = [rest.pop()]
            while front:
                x = front.pop()
                far = []
                for y in rest:
                    common = len(sets[x] & sets[y])
                    if common / (len(sets[x]) + len(sets[y]) - common) >= threshold:
                        yield x, y
                        front.append(y)
                    else:
                        far.append(y)
                rest = far
        return
    number: dict[str, int] = {}
    coded = [np.fromiter((number.setdefault(w, len(number)) for w in s), np.int32, len(s)) for s in sets]
    del sets
    n = np.array([len(c) for c in coded])
    marks = np.zeros(len(number), bool)
    rest = np.arange(len(coded))
    flat = np.concatenate(coded)
    front: list[int] = []
    while len(rest):
        if not front:
            front, took = [int(rest[0])], np.arange(len(rest)) == 0
        else:
            x = front.pop()
            marks[coded[x]] = True
            common = np.add.reduceat(marks[flat], np.cumsum(n[rest]) - n[rest], dtype=np.int64)
            marks[coded[x]] = False
            took = common / (n[x] + n[rest] - common) >= threshold
            for y in rest[took].tolist():
                yield x, y
                front.append(y)
        if took.any():
            flat, rest = flat[np.repeat(~took, n[rest])], rest[~took]


def _links(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b) for (g, cls, key): within each group, links between classes of the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, cls, key in _whole_groups(batches):
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            found = [(begin + x, begin + y) for begin, end in zip(cuts, cuts[1:]) if end - begin > 1 for x, y in _tree(key[begin:end].tolist(), threshold)]
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[a], cls[b])), pa.array(np.maximum(cls[a], cls[b]))], ["a", "b"])

    return members.select("g", "cls", "key").repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def similar_links(classes: DataFrame, frequent: Callable[[DataFrame], list[str]], *, threshold: float) -> DataFrame:
    """(a, b): links that connect exactly those of ``classes`` (cls, key; distinct keys) that a chain of pairs with Jaccard >=
    ``threshold`` connects. ``frequent`` gives the most frequent tokens by rising frequency from (token, df)."""
    counts = stored(classes.select(F.explode(F.split("key", " ")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")), "token-counts")
    place = {t: k << 32 | zlib.crc32(t.encode()) for k, t in enumerate(frequent(counts), 1)}
    discard(counts)
    tried = stored(_groups(_prefix_rows(classes, place, threshold), threshold).distinct(), "tried-groups")
    some = tried.select("cls").distinct()
    named = perhaps_in(classes, some, "cls").select("cls", "key").join(tried, "cls")
    links = stored(_links(named, threshold).distinct(), "similar-links")
    discard(tried)
    return links
