"""Registered queries of the engine's own operators over the whole test tables, and their SQL.

The tables stand in for the engine's inputs: documents are postings, profile chunks or files; benchmark items are profiles or
jobs; embeddings are stored chunks (slug: label); conversations are model calls; events carry scores of replies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import cost, coverage, dedupe, dense, index, judge, profile, repair, review, tfidf
from tessella.plans import sql
from tessella.sources.files import latex_texts, postings_of
from tessella.sources.storage import spread

FLAGSHIP = "e3_tfidf_rank"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(oracle: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE_SQL[fn.__name__] = oracle
        return fn

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, line_no, line) of documents."""
    return _t(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode_outer(T.lines("text")).alias("line_no", "line")).where(F.col("line").isNotNull())


@_query(
    r"""WITH p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'Title: Job ' || doc_id || ' at ' || source || chr(10) || '  company :' || source || ' ' || chr(10) || 'LOCATION: ' || lang || chr(10) || text
            ELSE 'role: Clerk' || chr(10) || 'Employer: ' || lang || ' & Co' || chr(10) || text END AS text FROM documents WHERE regexp_matches(text, '\S')),
        l AS (SELECT *, regexp_replace(coalesce(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))[1], ''), '^\s+|\s+$', '', 'g') AS first FROM p)
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN first WHEN 1 THEN 'Job ' || doc_id || ' at ' || (SELECT source FROM documents d WHERE d.doc_id = l.doc_id) ELSE 'Clerk' END AS title,
        CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN (SELECT source FROM documents d WHERE d.doc_id = l.doc_id) ELSE (SELECT lang FROM documents d WHERE d.doc_id = l.doc_id) || ' & Co' END AS company,
        CASE doc_id % 3 WHEN 1 THEN (SELECT lang FROM documents d WHERE d.doc_id = l.doc_id) ELSE '' END AS location,
        CASE doc_id % 3 WHEN 0 THEN first WHEN 1 THEN 'Job ' || doc_id || ' at ' || (SELECT source FROM documents d WHERE d.doc_id = l.doc_id) ELSE 'Clerk - ' || (SELECT lang FROM documents d WHERE d.doc_id = l.doc_id) || ' & Co' END AS label,
        left(sha256(text), 16) AS content_hash FROM l"""
)
def s1_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields, label and hash of each posting that is not blank. Two of three get header lines here."""
    rows = _t(spark, sf_dir, "documents").where(F.length(T.strip("text")) > 0)
    job = F.concat(F.lit("Title: Job "), "doc_id", F.lit(" at "), "source", F.lit("\n  company :"), "source", F.lit(" \nLOCATION: "), "lang", F.lit("\n"), "text")
    clerk = F.concat(F.lit("role: Clerk\nEmployer: "), "lang", F.lit(" & Co\n"), "text")
    text = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, job).otherwise(clerk)
    made = postings_of(spread(rows.select("doc_id", F.col("doc_id").cast("string").alias("slug"), text.alias("text"))))
    return made.select("doc_id", "title", "company", "location", "label", "content_hash")


@_query(f"WITH {sql.COUNTS} SELECT term, df, round(ln((1 + n) / (1 + df)) + 1, 9) AS idf FROM df, n")
def a2_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and smoothed idf of every term."""
    docs = _t(spark, sf_dir, "documents")
    df = tfidf.document_frequency(tfidf.term_counts(spread(docs.select("doc_id", "text")), "doc_id"))
    n = docs.agg((F.count(F.lit(1)) + 1).alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(tfidf.idf(F.col("n"), F.col("df")), 9).alias("idf"))


@_query(f"WITH {sql.RANK} SELECT item_id, doc_id, round(similarity, 6) AS similarity FROM ranking")
def e3_tfidf_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a profile against every document that shares a term."""
    ranking = tfidf.rank_tfidf(_t(spark, sf_dir, "benchmark"), _t(spark, sf_dir, "documents"), profile_id="item_id", posting_id="doc_id")
    return ranking.select("item_id", "doc_id", F.round("similarity", 6).alias("similarity"))


@_query(
    f"""WITH {sql.RANK}, a AS (SELECT b.item_id, d.doc_id, round(coalesce(similarity, 0), 6) AS similarity, similarity IS NULL AS unranked FROM benchmark b CROSS JOIN documents d LEFT JOIN ranking r ON r.item_id = b.item_id AND r.doc_id = d.doc_id)
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY unranked, similarity DESC, doc_id) AS place FROM a"""
)
def j2_full_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, U2, T-1, T-2, W8: every profile's ranking with the postings that it lacks behind: by definition a row for each pair."""
    docs, items = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark")
    full = tfidf.with_unranked(tfidf.rank_tfidf(items, docs, profile_id="item_id", posting_id="doc_id"), items, docs, profile_id="item_id", posting_id="doc_id")
    rounded = full.select("item_id", "doc_id", F.round("similarity", 6).alias("similarity"), "unranked")
    return rounded.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy("unranked", F.desc("similarity"), "doc_id")))


@_query(f"""WITH {sql.RANK}, r AS (SELECT item_id, doc_id, round(similarity, 6) AS similarity FROM ranking QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(similarity, 6) DESC, doc_id) <= 5)
    SELECT item_id, doc_id, similarity, left(sha256(text), 16) AS content_hash FROM r JOIN documents USING (doc_id) WHERE similarity > 0""")
def t3_selected_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-3, P9, J3, E8: the top five postings of every profile with their texts; the limit is the feature."""
    docs, items = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark")
    ranked = tfidf.rank_tfidf(items, docs, profile_id="item_id", posting_id="doc_id").select("item_id", "doc_id", F.round("similarity", 6).alias("similarity"))
    top = ranked.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("similarity"), "doc_id"))).where("place <= 5 AND similarity > 0")
    return top.join(docs.select("doc_id", "text"), "doc_id").select("item_id", "doc_id", "similarity", T.content_hash("text").alias("content_hash"))


@_query(
    f"""WITH {sql.COVERAGE} SELECT item_id, n_key, n_covered, round(coverage, 6) AS coverage,
    CASE WHEN coverage >= 0.6 THEN 'strong-overlap' WHEN coverage >= 0.35 THEN 'moderate-overlap' ELSE 'weak-overlap' END AS verdict FROM c"""
)
def e1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1, A10, J7, J8, T-4, T-5, P16: benchmark items as jobs against all documents as profile chunks."""
    return _explained(spark, sf_dir).select("item_id", "n_key", "n_covered", F.round("coverage", 6).alias("coverage"), "verdict")


@_query()
def e1_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 in full: strengths with evidence, gaps and best chunks (J9, J13, W12, T-6, T-7, F6, F17)."""
    return _explained(spark, sf_dir)


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("section"), "text")
    return coverage.explain(chunks, _t(spark, sf_dir, "benchmark"), job_id="item_id")


_STORE = "SELECT label AS slug, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"
_HITS = f"""WITH s AS ({_STORE}), q AS (SELECT vec_id AS query_id, v AS qv FROM s WHERE vec_id % 50 = 0),
    x AS (SELECT query_id, slug, vec_id, greatest(0, least(1, list_cosine_similarity(qv, v))) AS similarity FROM q, s),
    h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS hit FROM x QUALIFY hit <= 25)"""


def _dense(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = _t(spark, sf_dir, "embeddings")
    store = vectors.select(F.col("label").cast("string").alias("slug"), F.col("vec_id").alias("chunk_index"), F.col("vec_id").alias("ordinal"), "embedding")
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), store


@_query(f"{_HITS} SELECT query_id, vec_id, round(similarity, 6) AS similarity FROM h")
def w6_top_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 nearest stored chunks of each query, exactly."""
    queries_, store = _dense(spark, sf_dir)
    return dense.top_hits(queries_, store).select("query_id", F.col("chunk_index").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@_query(
    f"""{_HITS}, c AS (SELECT slug, vec_id, max(similarity) AS s FROM h GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY s DESC, vec_id) AS r FROM c)
    SELECT CAST(slug AS VARCHAR) AS slug, count(*) AS matched_chunks, round(avg(s) FILTER (WHERE r <= 3), 6) AS similarity, min(vec_id) FILTER (WHERE r = 1) AS best_chunk, any_value(n) AS total_chunks
    FROM r JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) ON label = slug GROUP BY slug"""
)
def e4_dense_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the best three chunks per slug."""
    return dense.rank_dense(*_dense(spark, sf_dir)).select("slug", "matched_chunks", F.round("similarity", 6).alias("similarity"), "best_chunk", "total_chunks")


@_query(
    """WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS slug, left(sha256(left(sha256(text), 16) || '|400|80|none'), 16) AS k FROM documents),
    s AS (SELECT CAST(CASE WHEN doc_id % 7 = 0 THEN doc_id + 1000000 ELSE doc_id END AS VARCHAR) AS slug, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE left(sha256(left(sha256(text), 16) || '|400|80|none'), 16) END AS k FROM documents)
    SELECT coalesce(w.slug, s.slug) AS slug, CASE WHEN s.slug IS NULL THEN 'added' WHEN w.slug IS NULL THEN 'removed' WHEN w.k = coalesce(s.k, '') THEN 'unchanged' ELSE 'updated' END AS action
    FROM w FULL JOIN s ON w.slug = s.slug"""
)
def j1_sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions between documents on disk and a store that lacks some, has stale ones and others besides."""
    key = index.index_key(T.content_hash("text"), 400, 80, "none")
    docs = _t(spark, sf_dir, "documents")
    stored = docs.select(F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") + 1_000_000).otherwise(F.col("doc_id")).cast("string").alias("slug"), F.when(F.col("doc_id") % 5 != 0, key).alias("index_key"))
    return index.plan_sync(docs.select(F.col("doc_id").cast("string").alias("slug"), key.alias("index_key")), stored)


@_query()
def f18_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents."""
    return index.split_chunks(_t(spark, sf_dir, "documents").select("doc_id", "text"))


_DEDUPED = f"""WITH l AS ({sql.LINE_ROWS}), k AS (SELECT *, row_number() OVER (PARTITION BY lang, {sql.KEY.format(x='line')} ORDER BY doc_id, line_no) AS r FROM l)"""


@_query(f"{_DEDUPED} SELECT doc_id, line_no, lang, line FROM k WHERE r = 1")
def w3_dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each language and key."""
    return dedupe.dedupe_exact(_lines(spark, sf_dir), section="lang", text="line", order=("doc_id", "line_no")).select("doc_id", "line_no", "lang", "line")


_NEAR = f"""WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id * 100000 + line_no AS id, {sql.near_tokens('line')} AS t FROM ({sql.LINE_ROWS})),
    e AS MATERIALIZED (SELECT id, len(t) AS n, unnest(t) AS token FROM l), df AS (SELECT token, count(*) AS df FROM e GROUP BY token),
    rare AS (SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY df, token) AS r FROM e JOIN df USING (token) WHERE n >= 3 QUALIFY r <= 4),
    b AS MATERIALIZED (SELECT id, token FROM rare QUALIFY count(*) OVER (PARTITION BY token) BETWEEN 2 AND 200),
    p AS (SELECT DISTINCT x.id AS a, y.id AS b FROM b x JOIN b y USING (token) WHERE x.id < y.id),
    near AS MATERIALIZED (SELECT a, b, len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) AS similarity FROM p JOIN l x ON x.id = a JOIN l y ON y.id = b QUALIFY similarity >= 0.72 AND similarity < 1)""".replace("QUALIFY similarity", "WHERE len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t)))").replace("AND similarity < 1", "AND len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) < 1")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select((F.col("doc_id") * 100_000 + F.col("line_no")).alias("line_id"), F.col("line").alias("text"))


@_query(f"{_NEAR} SELECT a, b, round(similarity, 9) AS similarity FROM near")
def j10_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate pairs of all documents' lines."""
    return dedupe.near_pairs(_numbered(spark, sf_dir)).select("a", "b", F.round("similarity", 9).alias("similarity"))


@_query(
    f"""{_NEAR}, sym AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
    reach(node, root) AS (SELECT a, a FROM sym UNION SELECT sym.b, reach.root FROM reach JOIN sym ON sym.a = reach.node),
    c AS (SELECT node, min(root) AS root FROM reach GROUP BY node) SELECT node AS line_id, root AS cluster_id, count(*) OVER (PARTITION BY root) AS cluster_size FROM c"""
)
def a16_near_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of near-duplicate lines."""
    return dedupe.near_clusters(_numbered(spark, sf_dir))


_VOCAB = """WITH w AS (SELECT lower(t) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS t FROM documents) WHERE length(t) BETWEEN 2 AND 24 GROUP BY ALL),
    m AS (SELECT word, max(n) AS n, max(f) AS f FROM (SELECT word, n, 0 AS f FROM w UNION ALL VALUES ('a', 0, 1), ('i', 0, 1)) GROUP BY word), s AS (SELECT sum(n) AS total FROM w)"""


@_query(f"{_VOCAB} SELECT word, n, round(CASE WHEN n > 0 AND length(word) < 16 THEN ln(n / total) WHEN f = 1 THEN ln(0.1 / total) END, 9) AS logp FROM m, s")
def a11_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts and log probabilities, without a dictionary."""
    return repair.vocabulary(_t(spark, sf_dir, "documents")).select("word", "n", F.round("logp", 9).alias("logp"))


_HARMED = "(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(replace(replace(replace(text, 'ti', 'fi'), 'sh', 'fl'), 'fi', 'ki'), 'fl', 'kl') ELSE replace(replace(text, 'ti', 'fi'), 'sh', 'fl') END AS text FROM documents)"


def _harmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ligatures, which every fifth of them has lost."""
    text = F.replace(F.replace("text", F.lit("ti"), F.lit("fi")), F.lit("sh"), F.lit("fl"))
    lost = F.replace(F.replace(text, F.lit("fi"), F.lit("ki")), F.lit("fl"), F.lit("kl"))
    return spread(_t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, lost).otherwise(text).alias("text")))


@_query(
    f"""{_VOCAB.replace("FROM documents", "FROM " + _HARMED)}, t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS token FROM {_HARMED}), o AS (SELECT token, lower(token) AS low, coalesce(n, 0) AS own FROM t LEFT JOIN m ON word = lower(token) WHERE length(token) >= 4),
    f AS (SELECT token, own, 0 AS i, replace(low, 'ki', 'fi') AS fixed FROM o WHERE contains(low, 'ki') UNION ALL SELECT token, own, 1, replace(low, 'kl', 'fl') FROM o WHERE contains(low, 'kl')),
    g AS (SELECT token, arg_min(fixed, i) AS fixed FROM f JOIN m ON word = fixed WHERE n > own GROUP BY token)
    SELECT token, CASE WHEN upper(token) = token THEN upper(fixed) WHEN regexp_matches(token, '^[A-Z]') THEN upper(fixed[1]) || fixed[2:] ELSE fixed END AS repaired FROM g"""
)
def f13_ligatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens whose ligature was read wrongly."""
    docs = _harmed(spark, sf_dir)
    return repair.token_repairs(docs, repair.vocabulary(docs)).where("kind = 'ligature'").select("token", "repaired")


@_query(
    f"""{_VOCAB}, t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS token FROM documents), c AS (SELECT doc_id, count(*) AS tokens, count(*) FILTER (WHERE length(token) >= 16) AS long_tokens FROM t GROUP BY doc_id)
    SELECT doc_id, coalesce(tokens, 0) AS tokens, coalesce(long_tokens, 0) AS long_tokens FROM documents LEFT JOIN c USING (doc_id)"""
)
def a13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13's denominator, and the tokens that its test of a split is put to."""
    docs = _t(spark, sf_dir, "documents")
    counted = docs.select("doc_id", F.explode_outer(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("token")).groupBy("doc_id")
    return counted.agg(F.count("token").alias("tokens"), F.count_if(F.length("token") >= repair.RUN_ON).alias("long_tokens"))


@_query()
def a13_residual_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each document's tokens that stay run together."""
    docs = _t(spark, sf_dir, "documents")
    return repair.residual_damage(docs, repair.vocabulary(docs), key="doc_id")


@_query()
def t8_line_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-8, J10, A16: near-duplicate lines of all documents, by cluster."""
    rows = _lines(spark, sf_dir).select("doc_id", "line_no", F.col("lang").alias("section"), F.col("line").alias("text"))
    return review.line_clusters(rows, key="doc_id")


@_query(
    r"""SELECT doc_id, 'Job ' || doc_id || chr(10) || source || ' — ' || lang || chr(10) || '50% & more_' || lang || chr(10) || chr(10) || '• ' || source || ' | ' || lang AS text FROM documents"""
)
def f20_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LaTeX sources made of every document's fields, read back as text."""
    docs = _t(spark, sf_dir, "documents")
    source = F.concat(
        F.lit("\\documentclass[a4]{article}% no\n\\begin{document}\\setcounter{page}{1}\\section*{Job "), F.col("doc_id").cast("string"), F.lit("}\n\\cvitem{"), "source", F.lit("}{\\textbf{"), "lang", F.lit("}}\n50\\% \\& {\\bf more\\_"), "lang",
        F.lit("}\\vspace{2pt}\\begin{tabular}{ll}\\item "), "source", F.lit(" & \\textcolor{red}{"), "lang", F.lit("}\\faIcon{x}\\end{tabular}\n\\end{document} tail"),
    )
    return latex_texts(docs.select("doc_id", source.alias("text")))


@_query()
def f14_run_ons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-together tokens and their split."""
    docs = _t(spark, sf_dir, "documents")
    return repair.token_repairs(docs, repair.vocabulary(docs)).where("kind = 'run_on'").select("token", "repaired")


@_query(
    f"""WITH l AS ({sql.LINE_ROWS}), t AS (SELECT doc_id, line_no, line, regexp_replace(regexp_replace(regexp_replace(line, '[\\pL\\p{{Nd}}_.+-]+@[\\pL\\p{{Nd}}_-]+\\.[\\pL\\p{{Nd}}_.]+', '[email]', 'g'), '(?:\\+?[0-9]{{1,3}}[\\s.-]?)?\\(?[0-9]{{3}}\\)?[\\s.-]?[0-9]{{3}}[\\s.-]?[0-9]{{4}}\\b', '[phone]', 'g'), '(?i)\\b(?:linkedin\\.com|github\\.com)/[\\pL\\p{{Nd}}_./-]+', '[profile-url]', 'g') AS r FROM l)
    SELECT doc_id, line_no, CASE WHEN length(regexp_replace(regexp_replace(r, '\\[(?:email|phone|profile-url)\\]', '', 'g'), '[^A-Za-z]', '', 'g')) < 3 THEN ''
        ELSE regexp_replace(regexp_replace(regexp_replace(r, '\\s+', ' ', 'g'), '^[ |,•-]+|[ |,•-]+$', '', 'g'), '^\\s+|\\s+$', '', 'g') END AS redacted,
        length(line) < 4 OR length(regexp_replace(line, '[^A-Za-z]', '', 'g')) < 3 OR regexp_matches(line, '(?i)^page [0-9]+( of [0-9]+)?$') AS noise FROM t"""
)
def f10_redacted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact details as tags, and the noise test, for every line."""
    return _lines(spark, sf_dir).select("doc_id", "line_no", T.redact_contacts("line").alias("redacted"), T.is_noise("line").alias("noise"))


@_query(
    f"""WITH l AS ({sql.LINE_ROWS}), h AS (SELECT doc_id, line_no, {sql.header('line')} AS header FROM l),
    s AS (SELECT doc_id, line_no, header, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'SUMMARY') AS section FROM h)
    SELECT doc_id, section, count(*) AS n FROM s WHERE header IS NULL GROUP BY ALL"""
)
def w1_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per document and section."""
    return profile.sectioned(_lines(spark, sf_dir), key="doc_id").groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"))


@_query()
def e7_build_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile of all documents, repaired first (reflow is a fold without SQL)."""
    from tessella.plans.engine import Engine

    return Engine(spark).build_profile(_t(spark, sf_dir, "documents"), key="doc_id")


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations")
    n = F.length("text")
    zero = F.lit(0).cast("long")
    calls = c.select(
        "conv_id", "turn", F.when(F.col("conv_id") % 3 == 0, "small").when(F.col("conv_id") % 3 == 1, "medium-20250101").otherwise("other").alias("model"),
        F.when(F.col("role") == "assistant", zero).otherwise(F.floor(n / 4)).alias("input_tokens"), F.when(F.col("role") == "assistant", F.floor(n / 4)).otherwise(zero).alias("output_tokens"),
        F.when(F.col("turn") == 0, F.floor(n / 8)).otherwise(zero).alias("cache_creation_input_tokens"), F.when(F.col("turn") > 0, F.floor(n / 8)).otherwise(zero).alias("cache_read_input_tokens"),
    )
    prices = spark.createDataFrame([("small", 1.0, 5.0), ("medium", 3.0, 15.0)], "model string, input_rate double, output_rate double")
    return cost.price(calls, prices)


@_query(f"""WITH {sql.PRICED} SELECT conv_id, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_creation_input_tokens) AS BIGINT) AS cache_creation_input_tokens,
    CAST(sum(cache_read_input_tokens) AS BIGINT) AS cache_read_input_tokens, round(sum(cost_usd), 9) AS cost_usd, count(*) FILTER (WHERE NOT priced) AS unpriced_calls FROM priced GROUP BY conv_id""")
def a18_session_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and cost of each conversation."""
    return cost.session_totals(_priced(spark, sf_dir), "conv_id").withColumn("cost_usd", F.round("cost_usd", 9))


@_query(f"""WITH {sql.PRICED} SELECT conv_id, turn, round(sum(cost_usd) OVER w, 9) AS cost_so_far, CAST(sum(input_tokens + output_tokens + cache_creation_input_tokens + cache_read_input_tokens) OVER w AS BIGINT) AS tokens_so_far
    FROM priced WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def w10_running_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost and tokens so far within each conversation."""
    return cost.running_totals(_priced(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", F.round("cost_so_far", 9).alias("cost_so_far"), "tokens_so_far")


@_query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'refusal' WHEN 1 THEN 'malformed' ELSE 'ok' END AS outcome, CASE WHEN event_id % 5 > 1 THEN round(greatest(0, least(100, value)), 6) END AS score,
    CASE WHEN event_id % 5 > 1 THEN CASE WHEN value >= 80 THEN 'strong' WHEN value >= 50 THEN 'moderate' ELSE 'weak' END END AS verdict,
    CASE WHEN event_id % 5 > 1 THEN 2 + (CASE WHEN value > 100 OR value < 0 THEN 1 ELSE 0 END) + 1 END AS n_notes FROM events"""
)
def n2_parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made of events: refused, broken, or fenced JSON with scores out of range."""
    e = _t(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.col("value").alias("match_score"), F.col("event_type").alias("verdict")))
    made = e.select("event_id", F.when(F.col("event_id") % 5 == 1, F.lit("no { JSON")).otherwise(F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```"))).alias("text"), F.when(F.col("event_id") % 5 == 0, "refusal").otherwise("end_turn").alias("stop_reason"))
    got = judge.parse_replies(made)
    return got.select("event_id", "outcome", F.round("score", 6).alias("score"), "verdict", F.when(F.col("notes").isNotNull(), F.size("notes")).alias("n_notes"))


@_query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 0 WHEN 4 THEN 2 ELSE 1 END AS n_strengths, CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 0 END AS n_notes,
    CASE event_id % 6 WHEN 1 THEN event_type WHEN 2 THEN event_type WHEN 4 THEN event_type WHEN 5 THEN event_type END AS first, CASE event_id % 6 WHEN 2 THEN 'high' WHEN 5 THEN 'unknown' END AS severity FROM events"""
)
def n3_coerced_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that are missing, text, objects, of another type, mixed with foreign entries, or hold empty requirements."""
    e = _t(spark, sf_dir, "events")
    kind, k = F.to_json(F.struct("event_type")), F.col("event_id") % 6
    item = lambda extra: F.concat(F.lit('{"requirement": "'), "event_type", F.lit('", '), F.lit(extra), F.lit("}"))
    strengths = (
        F.when(k == 0, F.lit("null")).when(k == 1, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(k == 2, F.concat(F.lit("["), item('"evidence": null'), F.lit(', "b"]')))
        .when(k == 3, kind).when(k == 4, F.concat(F.lit("["), item('"evidence": 3'), F.lit(', 7, {"requirement": ""}, "x"]'))).otherwise(F.concat(F.lit("["), item('"evidence": ""'), F.lit("]")))
    )
    gaps = F.when(k == 2, F.concat(F.lit("["), item('"severity": "HIGH"'), F.lit("]"))).when(k == 5, F.concat(F.lit("["), item('"note": "n"'), F.lit("]"))).otherwise(F.lit("[]"))
    body = F.concat(F.lit('{"match_score": 50, "verdict": "moderate", "rationale": "r", "matching_strengths": '), strengths, F.lit(', "gaps": '), gaps, F.lit("}"))
    got = judge.parse_replies(e.select("event_id", body.alias("text"), F.lit("end_turn").alias("stop_reason")))
    first = F.get(F.col("strengths"), F.lit(0))["requirement"]
    return got.select("event_id", F.size("strengths").alias("n_strengths"), F.size("notes").alias("n_notes"), first.alias("first"), F.get(F.col("gaps"), F.lit(0))["severity"].alias("severity"))


@_query(
    f"""WITH i AS (SELECT length(text) AS n, row_number() OVER (ORDER BY item_id) - 1 AS k FROM benchmark)
    SELECT doc_id, CAST((coalesce(length(text), 0) + {len(judge.INSTRUCTIONS)} + i.n) // 4 AS BIGINT) AS tokens FROM documents JOIN i ON i.k = doc_id % (SELECT count(*) FROM benchmark)"""
)
def x5_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request sizes for every document as a job, each with one of the profiles in turn; nothing is sent."""
    items = _t(spark, sf_dir, "benchmark")
    numbered = items.select(F.col("text").alias("profile"), (F.row_number().over(Window.orderBy("item_id")) - 1).alias("k"))  # profiles are few
    rows = _t(spark, sf_dir, "documents").withColumn("k", F.pmod("doc_id", F.lit(items.count()))).join(numbered, "k").select("doc_id", judge.build_request(F.col("profile"), F.col("text"), F.lit("small")).alias("r"))
    return rows.select("doc_id", cost.estimate_tokens(F.col("r.system")[0]["text"], F.col("r.system")[1]["text"], F.col("r.messages")[0]["content"]).alias("tokens"))
