"""Each operator against a brute-force version on a small fixture, and on nulls, blanks, ties, repeats, long texts, no rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash

from tessella.llm import chat, decontaminate, gru_lm, licenses, ordinal, packing, pii, quality_rules, secrets, simhash
from tessella.llm.queries import span_digests

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta,", "epsilon.", "zeta", "été", "ñu", "x", "theta\n"]) + rng.choice(["", "", "s", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    out += [out[0], out[1], out[2] + " more", None, "", "   \n\t ", "one", "one two", "same line here\nsame line here\n\n \n", "a b c d e f g h " * 6, prose(rng, 6000), "x" * 70000, "### $$ | & <b> " * 8]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "kept", 1.5) for i, t in enumerate(texts)] + [(3, texts[3], "kept", 1.5), (None, "one two three four five six", "kept", None), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, fp double").repartition(3).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_op1_statistics(docs):
    def brute(t):
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)

    got = quality_rules.text_stats(docs).collect()
    want = Counter((i, *brute(t)) for i, t in rows_of(docs))
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want


def test_op1_learns_a_rule_and_keeps_clean_documents(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(4000)]
    clean = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(300)]
    junk = [" ".join(rng.choice(words) + "###" for _ in range(60)) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300), None) for i in range(360) if i % 2] + [(None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(frame, labels).collect()}
    assert all(out[i]["kept"] for i in range(300)) and not any(out[i]["kept"] for i in range(300, 360))
    kept = quality_rules.keep_good(frame, labels)
    assert kept.columns == frame.columns and kept.count() == 300
    assert all(r["kept"] for r in quality_rules.quality_rules(frame, labels.limit(0)).collect())
    assert quality_rules.quality_rules(frame.limit(0), labels).count() == 0


def test_op2_round_trip(docs, nothing):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_BPE)
    pieces = packing.pack(docs, WORD_BPE).collect()
    by = {}
    for r in pieces:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 4096 and len(r["ids"]) == 4 * r["length"] and r["offset"] == 0
        by.setdefault(r["doc_id"], []).append(r)
    assert len({r["sequence_id"] for r in pieces}) == len(pieces)
    for i, t in rows_of(docs):
        if i is None or i == 3:
            continue
        own = sorted(by[i], key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist()
        assert ids == whole.encode(t or "", add_special_tokens=False).ids + [2]
        assert [r["start"] for r in own] == [0, *itertools.accumulate(r["length"] for r in own)][:-1] and own[0]["doc_tokens"] == len(ids)
    assert len(by[None]) == len(packing.piece_lengths(len(whole.encode("one two three four five six", add_special_tokens=False).ids) + 1, 4096)) + 1
    assert packing.pack(nothing, WORD_BPE).count() == 0


def test_op2_words_in_parts_are_exact():
    from tokenizers import Tokenizer

    whole, ids = Tokenizer.from_file(WORD_BPE), packing.word_ids(WORD_BPE)
    for t in ["It's l'été, don't! ab'll x.y. (ÀÉ) ß µ ª", "<|endoftext|>. a<|startoftext|>b", "x̂ é İstanbul ŒUVRE ﬁ", "__a_b_ 12ab ²³ .,;", "tab\tnew\nline\x0b\x0c\r end", " no break"]:
        assert np.frombuffer(ids.text(t.encode()), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_op3_counts_and_probabilities(spark, docs, nothing):
    out = gru_lm.score_documents(docs, vocabulary=20, head=30, hidden=8, n_classes=4).collect()

    def held(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0

    rows = [(i, [*WORD.findall(lower(t or "")), ""]) for i, t in rows_of(docs)]
    c = Counter(w for i, ws in rows for w in ws if not held(i))
    n, v = sum(c.values()), len(c)
    want = sorted(((-1 if i is None else i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for i, ws in rows)
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out) == want
    assert all(r["score"] <= 0 for r in out)
    assert gru_lm.score_documents(nothing).count() == 0


def test_op3_network_is_a_distribution_with_right_gradients_and_state():
    counts = np.array([50, 30, 20, 10, 5, 5, 1, 1], float)
    m = gru_lm.GruLm(counts, n_classes=3, hidden=5)
    rng = np.random.default_rng(0)
    for k in m.p:
        m.p[k] = rng.standard_normal(m.p[k].shape) * 0.3
    h = rng.standard_normal((1, 5))
    total = sum(np.exp(m.log_probs(h, np.array([t]))[0][0]) for t in range(8))
    assert abs(total - 1) < 1e-6
    x, y = rng.integers(0, 8, (4, 3)), rng.integers(0, 8, (4, 3))

    def loss():
        m.__dict__.pop("table", None)
        out, _, _ = m.run(x, np.zeros((3, 5)))
        return -m.log_probs(out.reshape(-1, 5).astype(float), y.ravel())[0].sum() / x.size

    m.__dict__.pop("table", None)
    grads, _ = m._grads(x, y, np.zeros((3, 5)))
    for k in m.p:
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        old = m.p[k][at]
        m.p[k][at] = old + 1e-3
        up = loss()
        m.p[k][at] = old - 1e-3
        down = loss()
        m.p[k][at] = old
        assert abs((up - down) / 2e-3 - grads[k][at]) < 2e-3, k
    m.__dict__.pop("table", None)
    texts = [rng.integers(0, 8, n) for n in (1, 40, 7, 23)]
    assert np.allclose(m.score(texts, 0, window_tokens=8), m.score(texts, 0, window_tokens=4096), atol=1e-4)
    assert np.allclose(m.score(texts, 0), [m.score([t], 0)[0] for t in texts], atol=1e-4)


def test_op3_network_beats_the_base_on_held_out_text(spark):
    rng = random.Random(1)
    kinds = [["aa", "bb", "cc", "dd"], ["ee", "ff", "gg", "hh"]]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(80))) for i in range(300)]
    out = gru_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), hidden=16).where("held_out").collect()
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) * 0.85


def test_op4_masks_exactly_the_assistant(spark):
    says = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "system", None), (1, 1, "user", "Hi <|end|> \\<| there\\"), (1, 2, "assistant", " é\n<|turn|>assistant<|says|>x<|end|>\\ "), (1, 3, "assistant", "日本語 <\\|"), (1, 2, "assistant", " é\n<|turn|>assistant<|says|>x<|end|>\\ "), (2, 0, "assistant", ""), (None, None, None, "orphan"), (-7, 0, "user", says), (-7, 1, "assistant", says)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.format_conversations(frame, BYTE_BPE).collect():
        own = sorted(((-1 if x[1] is None else x[1], x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]))
        assert chat.read_back(r["formatted"]) == [x[1:] for x in own] and r["n_turns"] == len(own)
        assert "".join(chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["spans"]) == "".join(t for _, role, t in own if role == "assistant")
        assert len(r["ids"]) == len(r["mask"])
    assert chat.format_conversations(frame.limit(0), BYTE_BPE).count() == 0


def brute_fingerprint(t):
    w = WORD.findall(lower(t or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {f: find(f) for f in fps}


def test_op5_against_all_pairs(docs, nothing):
    rows = rows_of(docs)
    fp = [(i, brute_fingerprint(t)) for i, t in rows]
    group = brute_components({f for _, f in fp})
    least = {}
    for i, f in fp:
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    out = simhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in out) == Counter((i, f, least.get(group[f])) for i, f in fp)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted(set(least.values()))
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("pair_cell", [1, 16])
def test_op5_links_near_fingerprints_in_small_and_large_cells(spark, pair_cell):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base[:5]:
        for _ in range(60):
            x = b
            for k in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << k
            fps.add(x)
    frame = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    edges = simhash.links(frame, pair_cell=pair_cell)
    assert all((r["a"] ^ r["b"]) % 2**64 and ((r["a"] ^ r["b"]) % 2**64).bit_count() <= 2 for r in edges.collect())
    root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    got = Counter(root.get(simhash._signed(f), simhash._signed(f)) for f in fps)
    assert sorted(got.values()) == sorted(Counter(brute_components(fps).values()).values())


def test_op6_orders_grades_and_takes_nulls(spark, docs, nothing):
    rng = random.Random(4)
    words = [["vile", "nasty"], ["meh", "thin"], ["fine", "good"]]
    rows = [(i, " ".join([rng.choice(words[i % 3]), *(rng.choice(["a", "b", "c", "d"]) for _ in range(20))])) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(0, 600, 2)] + [(None, 1), (5, None), (7, 9)], "doc_id long, grade int")
    out = {r["doc_id"]: r for r in ordinal.grade_documents(frame, ratings).collect()}
    mean = [np.mean([out[i]["expected_grade"] for i in range(1, 600, 2) if i % 3 == g]) for g in range(3)]
    assert mean[0] + 0.3 < mean[1] < mean[2] - 0.3
    assert np.mean([out[i]["selected"] == (i % 3 == 2) for i in range(1, 600, 2)]) > 0.9
    assert all(1 >= r["p_ge_1"] >= r["p_ge_2"] >= 0 for r in out.values())
    flat = ordinal.grade_documents(docs, ratings.limit(0)).collect()
    assert len(flat) == docs.count() and all(r["p_ge_1"] == 0.5 for r in flat)
    assert ordinal.grade_documents(nothing, ratings).count() == 0


PARTS = ["1", "23", "256", ".", ".", "-", " ", "@", "a", "b.c", "+", "(", ")", "4111111111111111", "\n", "_", "%", "é", "192.168.0.1", "+1 (909) 555-7013", "x@y.com"]


def brute_personal(t):
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_op7_base_spans():
    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 25)))
        assert pii.base_spans(t) == brute_personal(t), t


def test_op7_field_finds_the_short_form_of_a_known_number(spark, nothing):
    texts = ["Call +1 (909) 555-7013 now or later at (909) 555-7013 please. Version 4.0.", None, "", "12 (3) of 4567-1234", "1" * 50000 + "@", "3 apples and 4.0 pears"]
    texts += [f"and the +1 ({200 + i}) 555-{1000 + i} was mail{i}@ex{i}.com or {i}.2.3.4 it 4.0. {i} items" for i in range(60)]
    frame = spark.createDataFrame([(i, t, None if t is None else len(t), i) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, start long")
    out = {r["doc_id"]: r["found"] for r in pii.find_personal(frame).collect()}
    assert [(s["kind"], texts[0][s["start"] : s["end"]], s["base"]) for s in out[0]] == [("phone", "+1 (909) 555-7013", True), ("phone", "(909) 555-7013", False)]
    assert not any(out[i] for i in (1, 2, 3, 4, 5))
    for i, t in enumerate(texts):
        assert [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in out[i] if s["base"]] == brute_personal(t or "")
    clean = {r["doc_id"]: r for r in pii.redact(frame).collect()}
    assert clean[0]["text"] == "Call <PHONE> now or later at <PHONE> please. Version 4.0." and clean[0]["n_chars"] == len(clean[0]["text"]) and clean[1]["text"] is None and clean[5]["text"] == texts[5]
    assert pii.find_personal(nothing).count() == 0
    digest = span_digests(pii.find_personal(frame), pii.KINDS).where("doc_id = 0").first()
    assert digest["base_sha256"] == hashlib.sha256(b"phone:5:22").hexdigest() and digest["spans"] == "phone:5:22,phone:39:53"


def test_op8_against_regular_expressions(spark, docs, nothing):
    rng = random.Random(8)
    parts = ["password", "Secret", "TOKEN", "api_key", "apikey", "passwd", "=", ":", " ", '"', "'", "abcdefgh", "0123456789abcdef", "AKIA", "ABCDEFGH1234", "\n", "é", "x", "deadbeef", "/+", "ghp_" + "a" * 36]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 20))) for _ in range(1500)] + [None, "", "a" * 100000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in secrets.scan_secrets(frame).collect():
        t = texts[r["doc_id"]] or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert [(s["start"], ["assign", "access", "hex"].index(s["kind"]), s["end"]) for s in r["found"] if s["base"]] == sorted(want), t
        assert ("ghp_" + "a" * 36 in t) <= any(s["kind"] == "code_host" for s in r["found"])
    assert secrets.scan_secrets(docs).count() == docs.count() and secrets.scan_secrets(nothing).count() == 0


def test_op8_spans_equal_re_however_texts_are_cut():
    rng = random.Random(6)
    parts = ["password", "Secret", "TOKEN", "api_key", "=", ":", " ", '"', "'", "abcdefgh", "0123456789abcdef", "AKIA", "ABCDEFGH1234", "\n", "é", "-----BEGIN RSA PRIVATE KEY-----", "ghp_", "xoxb-", "a" * 40, "eyJ", ".", "token: secret:"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))).encode() for _ in range(800)]
    made = secrets.machine(secrets.RULES)
    want = {}
    for t, x in enumerate(texts):
        here = []
        for k, rule in enumerate(secrets.RULES):
            for m in re.finditer(rule.finds.encode(), x):
                first = re.match(rule.head.encode(), x[m.start() :]).end() if rule.head else 0
                if m.end() - m.start() - first >= rule.least:
                    here.append((m.start(), k, m.end()))
        if here:
            want[t] = sorted(here)
    assert want == made.spans(texts) == made.spans(texts, lane=7, warm=0, together=50) == made.spans(texts, lane=16, warm=3, together=64)


def test_op8_one_long_text_takes_about_as_long_as_many_short_ones():
    import time

    rng = random.Random(7)
    made = secrets.machine(secrets.RULES)
    words = "the of deadbeef cafe token = and secret a1 B2 eyJa.".split()
    texts = [" ".join(rng.choice(words) for _ in range(350)).encode() for _ in range(540)]
    made.spans(texts[:2])
    begin = time.process_time()
    made.spans(texts)
    many = time.process_time() - begin
    begin = time.process_time()
    made.spans([b" ".join(texts)])
    assert time.process_time() - begin < 8 * many + 0.5
    begin = time.process_time()
    made.spans([b"eyJa" * 20_000, b"a" * 300_000])
    assert time.process_time() - begin < 8


def test_op9_tells_licences_apart(spark, docs, nothing):
    cases = {
        "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"], "Licensed under CC BY 4.0.": ["CC-BY-4.0"], "text\nReleased under the terms of the MIT license!\nmore": ["MIT"],
        "foo This work is licensed under the GNU General Public License, version 3. bar": ["GPL-3.0"], "Licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
        "no permission to enter, copyright by me": [], "We talked about a licence to fish.": [], "": [], "word " * 3000 + "Licensed under CC BY-SA 4.0. " + "word " * 3000: ["CC-BY-SA-4.0"],
        "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.": ["CC-BY-NC-4.0", "Apache-2.0"],
    }
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(cases)] + [(99, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in licenses.scan_licenses(frame).collect()}
    for i, (t, want) in enumerate(cases.items()):
        assert sorted(s["license_id"] for s in out[i]["found"]) == sorted(want), t[:80]
    assert out[99]["n_licenses"] == 0 and licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(nothing).count() == 0


def test_op10_against_all_pairs(spark, nothing):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(6, 40)))) for i in range(40)] + [(90, None), (91, ""), (92, "two words"), (93, "w1 w1 w1 w1 w1 w1 w1 w1")]
    rows = []
    for i in range(150):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 300))]
        if i % 3 == 0:
            part = items[i % 40][1].split()
            for _ in range(rng.randint(0, 2)):
                part[rng.randrange(len(part))] = "changed"
            w[len(w) // 2 : len(w) // 2] = part
        rows.append((i, " ".join(w).upper() if i % 2 else " ".join(w)))
    rows += [(150, None), (151, ""), (152, "Two words"), (153, "w1 " * 50), (0, rows[0][1]), (None, items[0][1])]

    def grams(t):
        w = WORD.findall((t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    want = set()
    for (d, t), (k, x) in itertools.product(rows, items):
        if grams(x) and len(grams(t) & grams(x)) >= 0.8 * len(grams(x)) - 1e-9:
            want.add((d, k, len(grams(x)), len(grams(t) & grams(x))))
    frame, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(frame, bench).collect()
    assert Counter((r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in got) == Counter(want)
    bad = {d for d, *_ in want}
    assert Counter(r["doc_id"] for r in decontaminate.decontaminate(frame, bench).collect()) == Counter(d for d, _ in rows if d not in bad)
    assert decontaminate.contaminated(nothing, bench).count() == 0 and decontaminate.contaminated(frame, bench.limit(0)).count() == 0


def test_native_plans_have_no_python(spark, docs):
    for frame in (quality_rules.text_stats(docs), decontaminate._hashed(docs, "text", 5, "doc_id")):
        assert not re.search("Python|Arrow|Pandas", frame._jdf.queryExecution().executedPlan().toString())


def test_language_model_trains_on_every_document(spark, monkeypatch):
    """The rounds' shares follow on each other from nothing to all, and no token of a task is left over."""
    parts = []
    monkeypatch.setattr(gru_lm, "_train_round", lambda docs, model, vocab, other, end, part, **how: parts.append(part))
    docs = spark.createDataFrame([(i, f"a b c{i}") for i in range(30)], "doc_id long, text string")
    assert gru_lm.score_documents(docs, vocabulary=20, head=30, hidden=8, n_classes=4).count() == 30
    assert parts[0][0] == 0 and parts[-1][1] == 1 and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
    for n in (1, 30, 383, 385, 10_001):
        lanes, flat = gru_lm.lanes_of([np.arange(n)])
        assert len(flat) % lanes == 0 and set(flat.tolist()) == set(range(n)) and len(flat) < n + lanes


def test_op3_gradients_of_repeated_words_without_scattered_adds():
    """Adding up word by word took a quarter of the training time; sums of sorted runs give the same."""
    assert not re.search(r"add\.at\(", Path(gru_lm.__file__).read_text())
    rng = np.random.default_rng(2)
    m = gru_lm.GruLm(np.array([9, 5, 3, 1], float), n_classes=2, hidden=3)
    x, y = np.array([[1, 1, 2], [1, 2, 2]]), rng.integers(0, 4, (2, 3))
    grads, _ = m._grads(x, y, np.zeros((3, 3), np.float32))
    assert not grads["E"][[0, 3]].any()
    assert np.allclose(grads["b"] @ m.p["W"].T, grads["E"].sum(axis=0), atol=1e-6)


def test_op3_words_of_whole_columns_lose_none():
    """Words are parted for a whole column at once, which took a Python loop a document before; slices keep every word."""
    import pyarrow as pa

    odd = ["", " a  B\x0bc\x0c\x1c\x85 d É\x00x", "   ", "x ", "\nx", *[f"A{chr(i)}b{chr(i)} c" for i in range(256)]]
    for texts in (odd, [None, *odd]):
        whole = pa.array(texts, pa.string())
        for column in (whole, whole[7:60], whole[100:], whole[:0]):
            words_, cuts = gru_lm.words_of(column)
            got = [[w.as_py() for w in words_[a:b]] for a, b in zip(cuts, cuts[1:])]
            assert got == [gru_lm.tokens(t and t.encode())[:-1] for t in column.to_pylist()]
            assert [len(x) for x in gru_lm.streams_of(np.zeros(len(words_), np.int32), cuts, 7)] == [len(x) + 1 for x in got]


def test_op3_large_weights_stay_finite_and_running_changes_none():
    m = gru_lm.GruLm(np.array([9, 5, 3, 1], float), n_classes=2, hidden=3)
    m.p["C"][:], m.p["O"][:] = 300, 300
    m.p["b"][:] = 0.5
    hidden = np.ones((5, 3), np.float32)
    assert np.isfinite(m.log_probs(hidden, np.array([0, 1, 2, 3, 0]))[0]).all()
    m.run(np.array([[1, 2]]), np.zeros((2, 3), np.float32))
    assert (m.p["b"] == 0.5).all()
