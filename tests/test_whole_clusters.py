"""T-8 over all pairs: against every pair of lines, where the bounded join of J10 and A16 leaves pairs out."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa

from tessella.functions import text as T
from tessella.operators import dedupe, review, similar


def by_brute_force(sets, threshold=0.72):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    usable = {i: t for i, t in sets.items() if len(t) >= 3}
    for a, b in combinations(usable, 2):
        if threshold <= len(usable[a] & usable[b]) / len(usable[a] | usable[b]) < 1:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    groups = {}
    for i in sets:
        groups.setdefault(find(i), set()).add(i)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def without_copies(groups, sets):
    """Copies of one set are linked only through another set."""
    return {g for g in groups if len({frozenset(sets[i]) for i in g}) > 1}


def test_line_clusters_have_no_bound(spark):
    rng = random.Random(11)
    word = lambda k: f"w{k}x"
    large = [word(k) for k in range(900, 920)]
    lines = [" ".join([*large, f"own{i}z"]) for i in range(230)]  # every token that two of them share is in 230 lines
    lines += [" ".join([*large[:13], *(f"far{i}y{j}z" for j in range(7))]) for i in range(3)]
    lines += [" ".join([*(word(k) for k in range(400, 420)), *(f"rare{i}y{j}z" for j in range(3))]) for i in range(4)]
    lines += [" ".join([*(word(k) for k in range(420, 440)), *(f"only{i}y{j}z" for j in range(4))]) for i in range(2)]  # 20 of 28: below
    lines += [" ".join(word(k) for k in range(500, 518)), " ".join(word(k) for k in range(500, 525))]  # 18 of 25: the bound itself
    lines += [" ".join(word(k) for k in range(600, 617)), " ".join(word(k) for k in range(600, 624))]  # 17 of 24: below
    lines += [" ".join(word(k) for k in range(1000, 1000 + n)) for n in (300, 320, 500)] + ["alpha bravo", "alpha bravo charlie", "alpha bravo charlie delta", "", "alpha"]
    lines += [" ".join(w if rng.random() > 0.1 else word(rng.randint(0, 60)) for w in map(word, range(5 * (i % 9), 5 * (i % 9) + 12))) for i in range(90)]
    lines += lines[:2] + ["copied line without partners", "copied line without partners"]
    frame = spark.createDataFrame([(i % 7, i, "s", x) for i, x in enumerate(lines)], "doc_id long, line_no int, section string, text string")
    sets = {r["line_no"]: frozenset(r["t"]) for r in frame.select("line_no", T.near_tokens("text").alias("t")).collect()}
    want = without_copies(by_brute_force(sets), sets)
    got = {}
    for r in review.line_clusters(frame, key="doc_id").collect():
        got.setdefault((r["cluster"], r["size"], r["first_text"]), []).append(r["line_no"])
    assert {frozenset(g) for g in got.values()} == want and all(len(g) == size for (_, size, _), g in got.items())
    assert max(map(len, want)) >= 232 and any({233, 234, 235, 236} <= g for g in want)
    bounded = dedupe.near_clusters(frame.selectExpr("cast(line_no as long) line_id", "text"))
    assert bounded.count() < sum(map(len, want))  # the bound of J10 and A16 stays theirs


def test_links_of_large_groups_and_small_steps(monkeypatch):
    rng = random.Random(4)
    sets = [set(rng.sample(range(30), 20)) if i % 2 else set(range(100, 120)) ^ {rng.randint(100, 140)} for i in range(80)]
    sets = [frozenset(s) for s in {frozenset(s) for s in sets}]
    keys = [" ".join(f"t{x}" for x in s) for s in sets]
    want = by_brute_force(dict(enumerate(sets)))
    for few in (0, 1000):
        monkeypatch.setattr(similar, "FEW", few)
        links = list(similar._tree(keys, 0.72))
        assert all(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.72 for a, b in links)
        root = np.arange(len(sets))
        similar._link(root, *np.array(links).T)
        assert {frozenset(np.flatnonzero(root == x).tolist()) for x in set(root.tolist()) if (root == x).sum() > 1} == want and len(links) == sum(len(g) - 1 for g in want)
    n = np.array([4, 5, 4, 40, 4] * 6)
    columns = [np.repeat(np.arange(6, dtype=np.int32), 5), np.arange(30), n << 32 | n, *(np.zeros(30, np.int64) for _ in range(similar.WORDS))]
    whole = similar._candidates(columns, 0.72)
    monkeypatch.setattr(similar, "AT_ONCE", 1)
    stepped = similar._candidates(columns, 0.72)
    assert all((a == b).all() for a, b in zip(whole, stepped)) and len(whole[1]) == 24


def test_long_keys_are_taken_in_parts(monkeypatch):
    monkeypatch.setattr(similar, "BYTES", 10)
    monkeypatch.setattr(similar, "ROWS", 3)
    keys = ["abc", "abcd", "abcdefghijklmnop", "a", "b", "c", "d", "abcdefghij", "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(keys)], ["key"])
    assert [x.column("key").to_pylist() for x in similar._slices(batch)] == [["abc", "abcd"], ["abcdefghijklmnop"], ["a", "b", "c"], ["d"], ["abcdefghij"], ["z"]]
    assert not list(similar._slices(batch.slice(0, 0)))


def test_tables_without_near_lines(spark):
    for rows in ([], [(1, None), (2, ""), (3, "alpha bravo charlie"), (4, "Alpha, bravo: charlie!")]):
        assert dedupe.whole_clusters(spark.createDataFrame(rows, "line_id long, text string")).count() == 0


def test_batches_are_cut_between_keys_only():
    keys = [1, 1, 2, 2, 2, 3, 3, 3, 3, 5, 6, 6]
    for size in range(1, 6):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size]), pa.array(list(range(i, min(i + size, len(keys)))))], ["k", "v"]) for i in range(0, len(keys), size)]
        groups = [(k.tolist(), v.tolist()) for k, v in similar._whole_groups(iter(batches))]
        assert [x for k, _ in groups for x in k] == keys and [x for _, v in groups for x in v] == list(range(len(keys)))
        assert all(not set(a) & set(b) for (a, _), (b, _) in combinations(groups, 2))
