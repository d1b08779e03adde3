"""The same operators in DuckDB SQL, for the side-by-side check of ``registry``."""

from __future__ import annotations

from tessella.functions.text import NEAR_SUFFIXES, NEAR_WORDS, SECTIONS, STOP_WORDS, WORD


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + "]"


def stem(x: str) -> str:
    plural = f"""CASE WHEN length({x}) > 4 AND {x} LIKE '%ies' THEN left({x}, -3) || 'y' WHEN length({x}) > 4 AND {x} LIKE '%sses' THEN left({x}, -2)
        WHEN length({x}) > 4 AND {x} LIKE '%es' AND {x} NOT LIKE '%oes' AND {x} NOT LIKE '%aes' THEN left({x}, -2)
        WHEN length({x}) > 3 AND {x} LIKE '%s' AND {x} NOT LIKE '%ss' THEN left({x}, -1) ELSE {x} END"""
    rules = [("ational", "at"), ("ization", "iz"), ("isation", "iz"), ("ation", "at"), ("ement", ""), ("ment", ""), ("ness", ""), ("ing", ""), ("ed", "")]
    ends = " ".join(f"WHEN p LIKE '%{a}' AND length(p) >= {len(a) + 3} THEN left(p, -{len(a)}) || '{b}'" for a, b in rules)
    # list_transform over one item stands for a local name
    derived = f"list_transform([{plural}], lambda p: CASE {ends} ELSE p END)"
    return f"list_transform({derived}, lambda q: CASE WHEN length(q) > 4 AND q LIKE '%e' THEN left(q, -1) ELSE q END)[1]"


def words(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(lower({text}), '{WORD}'), lambda w: trim(w, '.')), lambda w: length(w) >= 2 AND NOT list_contains({_list(STOP_WORDS)}, w))"


def stems(text: str) -> str:
    return f"list_transform({words(text)}, lambda s: {stem('s')})"


def with_pairs(w: str) -> str:
    return f"list_concat({w}, [{w}[i] || ' ' || {w}[i + 1] FOR i IN range(1, len({w}))])"


def near_stem(w: str) -> str:
    return "CASE " + " ".join(f"WHEN length({w}) >= {len(s) + 4} AND {w} LIKE '%{s}' THEN left({w}, -{len(s)})" for s in NEAR_SUFFIXES) + f" ELSE {w} END"


def near_tokens(text: str) -> str:
    kept = f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({_list(NEAR_WORDS)}, w))"
    return f"list_distinct(list_transform({kept}, lambda w: {near_stem('w')}))"


#: (doc_id, term, tf) of documents and (item_id, term, tf) of benchmark.
COUNTS = f"""
    dw AS MATERIALIZED (SELECT doc_id, {stems('text')} AS w FROM documents),
    dt AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({with_pairs('w')}) AS term FROM dw) GROUP BY ALL),
    jw AS MATERIALIZED (SELECT item_id, {stems('text')} AS w FROM benchmark),
    jt AS MATERIALIZED (SELECT item_id, term, count(*) AS tf, min(pos) AS first_pos FROM (SELECT item_id, unnest({with_pairs('w')}) AS term, generate_subscripts({with_pairs('w')}, 1) AS pos FROM jw) GROUP BY ALL),
    n AS (SELECT count(*) + 1 AS n FROM documents),
    df AS MATERIALIZED (SELECT term, count(*) AS df, sum(tf) AS ptf FROM dt GROUP BY term)"""

RANK = f"""{COUNTS},
    pairs AS (SELECT item_id, doc_id FROM (SELECT DISTINCT item_id, doc_id FROM dt JOIN jt USING (term))),
    dv AS (SELECT doc_id, term, (1 + ln(tf)) AS tw, df, n FROM dt JOIN df USING (term), n),
    pv AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1 + n) / (2 + coalesce(df, 0))) + 1) AS pw FROM jt LEFT JOIN df USING (term), n),
    p2 AS (SELECT item_id, sum(pw * pw) AS p2 FROM pv GROUP BY item_id),
    d2 AS (SELECT doc_id, sum(pow(tw * (ln((1 + n) / (1 + df)) + 1), 2)) AS d2 FROM dv GROUP BY doc_id),
    met AS (SELECT item_id, doc_id, sum(tw * (ln((1 + n) / (2 + df)) + 1) * pw) AS dot, sum(tw * tw * (pow(ln((1 + n) / (2 + df)) + 1, 2) - pow(ln((1 + n) / (1 + df)) + 1, 2))) AS more FROM dv JOIN pv USING (term) GROUP BY ALL),
    ranking AS (SELECT item_id, doc_id, dot / (sqrt(d2 + more) * sqrt(p2)) AS similarity FROM met JOIN d2 USING (doc_id) JOIN p2 USING (item_id))"""

COVERAGE = f"""{COUNTS},
    w AS (SELECT item_id, term, first_pos, (1 + ln(tf)) * (ln((1 + n) / (2 + coalesce(df, 0))) + 1) AS weight, df IS NOT NULL AS has FROM jt LEFT JOIN df USING (term), n),
    k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, first_pos) AS place FROM w),
    c AS (SELECT item_id, count(*) FILTER (WHERE place <= 30) AS n_key, count(*) FILTER (WHERE place <= 30 AND has) AS n_covered,
        coalesce(sum(weight) FILTER (WHERE place <= 30 AND has), 0) / sum(weight) FILTER (WHERE place <= 30) AS coverage FROM k GROUP BY item_id)"""

LINES = "SELECT doc_id, lang, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents"
#: A final line end gives no empty line.
LINE_ROWS = f"SELECT doc_id, lang, line_no, line FROM ({LINES}) l WHERE NOT (line = '' AND line_no = (SELECT max(len(string_split(d.text, chr(10)))) - 1 FROM documents d WHERE d.doc_id = l.doc_id))"

KEY = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def header(line: str) -> str:
    s = f"regexp_replace(regexp_replace(regexp_replace({line}, '^\\s+|\\s+$', '', 'g'), '^:+|:+$', '', 'g'), '^\\s+|\\s+$', '', 'g')"
    keys = " ".join(f"WHEN contains(lower(s), '{k}') THEN '{v}'" for k, v in SECTIONS)
    return f"""list_transform([{s}], lambda s: CASE WHEN length(s) = 0 OR length(s) > 45 OR len(regexp_split_to_array(s, '\\s+')) > 4 OR length(regexp_replace(s, '[^\\pL]', '', 'g')) = 0 OR s LIKE '%.' THEN NULL
        WHEN length(regexp_replace(s, '[^\\p{{Lu}}]', '', 'g')) / length(regexp_replace(s, '[^\\pL]', '', 'g')) < 0.6 AND regexp_matches(s, '(^|\\s)[\\p{{Ll}}\\p{{Lo}}\\p{{Lm}}\\p{{Lt}}]') THEN NULL {keys} END)[1]"""


PRICES = "(VALUES ('small', 1.0, 5.0), ('medium', 3.0, 15.0)) p(model, input_rate, output_rate)"
#: Tokens of a turn are its characters by four; every third conversation uses a model without a price.
CALLS = """SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium-20250101' ELSE 'other' END AS model,
    CASE WHEN role = 'assistant' THEN 0 ELSE length(text) // 4 END AS input_tokens, CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END AS output_tokens,
    CASE WHEN turn = 0 THEN length(text) // 8 ELSE 0 END AS cache_creation_input_tokens, CASE WHEN turn > 0 THEN length(text) // 8 ELSE 0 END AS cache_read_input_tokens FROM conversations"""
PRICED = f"""calls AS ({CALLS}), priced AS (SELECT c.*, input_rate IS NOT NULL AS priced,
    coalesce((input_tokens * input_rate + output_tokens * output_rate + cache_creation_input_tokens * input_rate * 1.25 + cache_read_input_tokens * input_rate * 0.1) / 1e6, 0) AS cost_usd
    FROM calls c LEFT JOIN {PRICES} ON p.model = regexp_replace(c.model, '-[0-9]{{8}}$', ''))"""
