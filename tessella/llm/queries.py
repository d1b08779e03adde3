"""The registered queries of this subpackage: each applies one operator to its whole table and derives digest columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.chat import format_conversations, read_back, unescape
from tessella.llm.common import map_arrow, table
from tessella.llm.decontaminate import contaminated
from tessella.llm.gru_lm import score_documents
from tessella.llm.licenses import scan_licenses
from tessella.llm.ordinal import grade_documents, grade_of_labels
from tessella.llm.packing import pack
from tessella.llm.pii import KINDS, find_personal
from tessella.llm.quality_rules import quality_rules
from tessella.llm.secrets import scan_secrets
from tessella.llm.simhash import hex_fingerprint, near_duplicates


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], given.schema)
    made = format_conversations(given.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json"))

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for conv_id, formatted, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans"))):
            turns = read_back(formatted)
            loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
            whole = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append((conv_id, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names)

    return map_arrow(made.select("conv_id", "formatted", "spans"), digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def span_digests(found: DataFrame, kinds: list[str]) -> DataFrame:
    """(doc_id, n_<kind> ..., base_sha256, spans) from (doc_id, found)."""
    base = F.filter("found", lambda x: x["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans"))


def op6_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = table(spark, sf_dir, "labels").select("doc_id", grade_of_labels().alias("grade"))
    return grade_documents(table(spark, sf_dir, "documents"), ratings)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(find_personal(table(spark, sf_dir, "documents")), KINDS)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(scan_secrets(table(spark, sf_dir, "documents")), ["assign", "access", "hex"])


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The parts of four operators' results that SQL can express, each derived from the same query.


def base_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def base_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_lm_score": op3_lm_score,
    "op4_chat": op4_chat,
    "op5_simhash": op5_simhash,
    "op6_quality_grade": op6_quality_grade,
    "op7_pii": op7_pii,
    "op8_secrets": op8_secrets,
    "op9_licenses": op9_licenses,
    "op10_decontaminate": op10_decontaminate,
    "base_words": base_words,
    "base_unigrams": base_unigrams,
    "base_personal": base_personal,
    "base_secrets": base_secrets,
}

_WORDS = r"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"
#: CRC-32 of an id as text, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(c)::BIGINT FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT FOR i IN range(8)]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT)"""

ORACLE_SQL: dict[str, str] = {
    "base_words": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format(x="coalesce(text, '')")} AS w FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8), k AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS gram FROM g),
        r AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
        c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (SELECT unnest(range(8)) AS j) GROUP BY doc_id),
        l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
        b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id))
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b""",
    "base_unigrams": rf"""
        WITH d AS (SELECT doc_id, {_CRC} % 10 = 0 AS held_out, list_append({_WORDS.format(x="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, '') AS w FROM documents),
        t AS (SELECT doc_id, held_out, unnest(w) AS word FROM d), c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY word), s AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
        SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1) / (n + 0.1 * (v + 1)))), 4) AS base_score
        FROM t LEFT JOIN c USING (word), s GROUP BY doc_id, held_out, n""",
    "base_personal": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        x AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
            [regexp_replace(c, '[^0-9]', '', 'g') FOR c IN regexp_extract_all(t, '[0-9]([ -]?[0-9])+')] AS cards, [regexp_replace(c, '[^0-9]', '', 'g') FOR c IN regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]')] AS phones FROM d)
        SELECT doc_id, CAST(n_email AS BIGINT) AS n_email, CAST(len(list_filter(ips, lambda i: len(list_filter(string_split(i, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0)) AS BIGINT) AS n_ip,
            CAST(len(list_filter(cards, lambda c: length(c) BETWEEN 16 AND 19 AND list_sum([CASE WHEN k % 2 = 0 THEN CAST(c[length(c) - k] AS INT) ELSE CAST(c[length(c) - k] AS INT) * 2 - CASE WHEN CAST(c[length(c) - k] AS INT) > 4 THEN 9 ELSE 0 END END FOR k IN range(length(c))]) % 10 = 0)) AS BIGINT) AS n_card,
            CAST(len(list_filter(phones, lambda c: length(c) BETWEEN 8 AND 15)) AS BIGINT) AS n_phone FROM x""",
    "base_secrets": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda v: length(v) >= 8)) AS BIGINT) AS n_assign,
            CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 16)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda v: length(v) >= 32)) AS BIGINT) AS n_hex FROM d""",
    "op4_chat": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
            CAST(coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(t, '\', '\\'), '<|', '<\|')) + 23) AS BIGINT) AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op10_decontaminate": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) AS shingle FROM w WHERE len(w) > 0),
        v AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
        t AS (SELECT DISTINCT item_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) AS shingle FROM v WHERE len(w) > 0),
        n AS (SELECT item_id, count(*) AS n_shingles FROM t GROUP BY item_id)
        SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
        FROM s JOIN t USING (shingle) JOIN n USING (item_id)
        GROUP BY doc_id, item_id, n_shingles HAVING count(*) / n_shingles >= 0.8""",
}
