"""The pipeline's stages against brute force, and its query against the stages."""

from collections import Counter

import corpus_pipeline
import pytest
from test_near_copies import brute_kept
from test_ops import WORD, brute_personal

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        assert name == "packing" or docs.columns == columns
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    before, after = map(text, seen["quality_rules"])
    assert all(len(WORD.findall(t)) >= 20 for t in after.values()) and len(after) > 0.6 * len(before)
    before, after = map(text, seen["simhash_dedup"])
    assert sorted((False, i) for i in after) == brute_kept(list(before.items()))
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def grams(t):
        w = WORD.findall(t.lower())
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    before, after = map(text, seen["decontaminate"])
    sets = [grams(t) for t in items]
    assert set(after) == {i for i, t in before.items() if not any(len(grams(t) & s) >= 0.8 * len(s) for s in sets)}
    before, after = map(text, seen["pii"])
    assert set(before) == set(after) and not any(brute_personal(t) for t in after.values())
    assert all(after[i] == t for i, t in before.items() if not any(c in t for c in "0123456789@"))
    pieces = seen["packing"][1].groupBy("doc_id").sum("length").count()
    assert pieces == len(after)
    assert corpus_pipeline.run(spark, SF).drop("sequence_id").exceptAll(seen["packing"][1].drop("sequence_id")).isEmpty()


@pytest.fixture(scope="module")
def odd(spark):
    """Null, repeated and empty rows, and columns whose names the operators use themselves."""
    good = "\n".join(" ".join(f"word{i * 7 + k}" for k in range(12)) for i in range(6))
    rows = [(1, good), (1, "too short"), (1, good), (None, good + " more mail a.b@example.com"), (None, None), (None, "other " + " ".join(f"x{k}" for k in range(40))), (2, ""), (3, " ".join(f"long{k}" for k in range(30000)))]
    names = ["lang", "source", "n_chars", "kept", "rule", "key", "copy", "start", "found", "fp", "bucket", "w", "t"]
    return spark.createDataFrame([(*r, *(["x"] * 2 + [1] + ["y"] * 10)) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'{n} string' for n in names[3:])}")


def test_stages_take_odd_rows(spark, odd):
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality_rules"](spark, odd, SF)
    assert good.columns == odd.columns
    # each row is judged by its own text: the short row of id 1 goes, its long ones stay
    assert Counter(r["doc_id"] for r in good.collect()) == {1: 2, None: 2, 3: 1}
    once = stage["simhash_dedup"](spark, odd, SF)
    assert once.columns == odd.columns and Counter(r["doc_id"] for r in once.collect()) == {1: 2, None: 1, 2: 1, 3: 1}
    clear = stage["decontaminate"](spark, odd, SF)
    assert clear.columns == odd.columns and clear.count() == odd.count()
    hidden = stage["pii"](spark, odd, SF)
    assert hidden.columns == odd.columns and hidden.count() == odd.count()
    assert stage["packing"](spark, odd, SF).groupBy("doc_id").sum("length").count() == 4


def test_stages_take_empty_tables(spark, odd):
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, odd.limit(0), SF).count() == 0, name
