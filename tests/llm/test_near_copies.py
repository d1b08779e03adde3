"""The de-duplication stage against groups from all pairs by exact shingle similarity."""

import random

import corpus_pipeline
import numpy as np
import pytest
from test_ops import WORD, lower
from tessella.llm import near_copies, simhash

SF = "/root/testdata/sf0.001"


def grams(t):
    w = WORD.findall(lower(t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_kept(rows):
    """Least id of each component of pairs with similarity >= 0.8, null where a component has no other."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(top(i), []).append((d is None, d or 0))
    return sorted(min(x) for x in least.values())


def ids_of(frame):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in frame.collect())


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.random()}"
    return w


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(base))
        texts += [" ".join(edited(rng, base, rng.randint(0, 8))) for _ in range(3)]
    chain = [f"c{k}" for k in range(200)]
    for _ in range(12):  # neighbours are alike, the ends are not
        texts.append(" ".join(chain).upper())
        chain = edited(rng, chain, 3)
    texts += [texts[0], texts[4] + "\n", "", "  \n", None, "a b", "A  B", "a b c", "a b c d e", "a b c d e f"]
    rng.shuffle(texts)
    alone = " ".join(f"alone{k}" for k in range(50))
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, alone), (None, alone)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, copy int")
    kept = near_copies.drop_near_copies(frame)
    assert ids_of(kept) == brute_kept(rows) and kept.columns == frame.columns
    assert near_copies.drop_near_copies(frame.limit(0)).count() == 0


def test_rows_that_share_an_id_are_judged_apart(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (3, a), (7, c), (7, c), (7, "other words than those of the first row"), (None, b)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(3, a), (5, b), (7, c), (7, rows[5][1])])
    for drop in (near_copies.drop_near_copies, simhash.drop_near_duplicates):
        assert sorted((r["doc_id"], r["text"]) for r in drop(frame).collect()) == want


@pytest.mark.parametrize("blocks", [1, 2])
def test_a_task_links_what_alike_pairs_connect(blocks):
    """Random sets near the bound of 0.8, some in one group from the start, against all pairs."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, base = 24, rng.choice(10**6, 40, replace=False).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(40) < 0.93], rng.integers(10**6, 10**7, rng.integers(0, 5)).astype(np.uint64)])) for _ in range(n)]
        sets[3] = sets[2][:1]
        key, root = np.arange(n) * 7, rng.integers(0, 12, n)
        meet = np.arange(n) if blocks == 1 else np.arange(n) % 2

        def classes(links):
            top = root.copy()
            for a, b in links:
                top[top == top[b]] = top[a]
            return [[bool(x == y) for y in top] for x in top]

        both = lambda x, y: len(np.intersect1d(sets[x], sets[y]))
        true = [(x, y) for x in range(n) for y in range(x) if meet[x] != meet[y] and 5 * both(x, y) >= 4 * (len(sets[x]) + len(sets[y]) - both(x, y))]
        got = [(a // 7, b // 7) for a, b in near_copies._forest(key, root, sets, meet, 0.8)]
        assert classes(got) == classes(true) and len(got) < len(set(root.tolist()))
        assert all((max(g), min(g)) in true for g in got)


@pytest.mark.parametrize("block", [2, 512])
def test_a_mixed_bucket_links_members_that_its_centre_is_unlike(spark, monkeypatch, block):
    """Families of texts that share half their words fall into common buckets; pairs within a family must be found."""
    rng = random.Random(11)
    common = [f"w{k}" for k in range(60)]
    texts = []
    for f in range(40):
        own = common + [f"f{f}x{k}" for k in range(45)]
        texts += [" ".join(own), " ".join(edited(rng, own, 1)), " ".join(edited(rng, own, 2))]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "PART", block)
    assert ids_of(near_copies.drop_near_copies(frame)) == brute_kept(rows)


def test_pipeline_stage_drops_edited_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, SF)
    assert ids_of(got) == brute_kept(rows)


def test_fingerprints_give_candidates_too(spark):
    """With bands that no two unlike texts share, texts within two bits are still compared, and only like ones are joined."""
    words = [f"w{k * k % 977}" for k in range(600)]
    first = " ".join(words)
    edits = (" ".join([*words[:k], "other", *words[k + 1 :]]) for k in range(0, 600, 7))
    fp = lambda t: simhash.fingerprint(t.encode(), 5)
    second = next(t for t in edits if (fp(t) ^ fp(first)).bit_count() <= 2)
    docs = spark.createDataFrame([(1, first), (2, second), (3, " ".join(f"x{k}" for k in range(300)))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs, bands=1, rows=400).collect()) == [1, 3]
