"""The queries of this folder, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm.common import table
from tablescope.llm.exact_dedup import exact_dedup
from tablescope.llm.katz import katz_scores
from tablescope.llm.language_crf import identify
from tablescope.llm.mixing import mix
from tablescope.llm.packing import pack
from tablescope.llm.simhash import simhash_dedup
from tablescope.llm.spelling import spelling_variants
from tablescope.llm.substring_dedup import substring_dedup
from tablescope.llm.token_output import token_round_trip
from tablescope.llm.toxicity_crf import toxicity
from tablescope.llm.vamana import nearest
from tablescope.llm.vector_codes import vector_codes
from tablescope.llm.warc import warc_round_trip

#: Production weights; a source's domain is its number's rest by 4.
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
BUDGET_SHARE, MAX_EPOCHS, SEED = 0.9, 2, 7


def mix_documents(df: DataFrame, rows: bool = False) -> DataFrame:
    number = F.expr(r"try_cast(regexp_extract(source, '(\\d+)$', 1) AS int)")
    domain = F.concat(F.lit("domain"), F.coalesce(number % 4, F.lit(3)).cast("string"))
    return mix(df, domain, F.col("lang"), F.col("source"), BUDGET_SHARE, MAX_EPOCHS, DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS,
               None, SEED, rows=rows)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=35).drop("spans")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"), folds=7, held=2)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), window=1024)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), folds=4, held=2)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, held=1, threshold=0.7)
    return found.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), min_length=7, min_count=2, ratio=10)


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_substring_dedup, op3_lm_scoring, op4_simhash, op5_mixing, op6_packing, op7_language_id,
    op8_ann, op9_token_ids, op10_warc, op11_vector_codes, op12_toxicity, op13_spelling)}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DOMAIN = "'domain' || cast(coalesce(try_cast(regexp_extract(source, '(\\d+)$', 1) AS INT) % 4, 3) AS VARCHAR)"


def _cases(column: str, weights: dict[str, int]) -> str:
    return f"CASE {' '.join(f"WHEN {column} = '{k}' THEN {w}" for k, w in weights.items())} ELSE 1 END::DOUBLE"


def _fill_sql(name: str, nodes: str, parent: str, order: str) -> str:
    """Share ``budget`` of the parent among its children, in proportion to ``w`` and up to ``cap``."""
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}_r AS (SELECT *, cap / w AS ratio FROM ({nodes})),
{name}_l AS (SELECT *, (budget - coalesce(sum(cap) OVER ({by} ORDER BY ratio, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER ({by} ORDER BY ratio, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM {name}_r),
{name} AS (SELECT * EXCLUDE (budget), CAST(CASE WHEN lev >= ratio THEN cap ELSE least(cap, CAST(floor(w *
    max(CASE WHEN lev < ratio THEN lev END) OVER ({by})) AS BIGINT)) END AS BIGINT) AS given FROM {name}_l)"""


ORACLE = {
    "op1_exact_dedup": f"""
WITH n AS (SELECT doc_id, {_FOLD} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
""",
    "op5_mixing": f"""
WITH base AS (SELECT doc_id, {_DOMAIN} AS domain, lang AS language, source, md5(coalesce(text, '')) AS tie,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, language, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {MAX_EPOCHS})::BIGINT AS cap FROM base GROUP BY ALL),
langs AS (SELECT domain, language, sum(cap)::BIGINT AS cap FROM leaves GROUP BY ALL),
domains AS (SELECT domain, sum(cap)::BIGINT AS cap FROM langs GROUP BY ALL),
total AS (SELECT floor(sum(tokens) * {BUDGET_SHARE}::DOUBLE)::BIGINT AS budget FROM leaves),
{_fill_sql("top", f"SELECT d.*, budget, {_cases('domain', DOMAIN_WEIGHTS)} AS w FROM domains d, total", "", "domain")},
{_fill_sql("mid", f"SELECT l.*, t.given AS budget, {_cases('l.language', LANGUAGE_WEIGHTS)} AS w FROM langs l JOIN top t USING (domain)", "domain", "language")},
{_fill_sql("low", "SELECT l.*, m.given AS budget, 1::DOUBLE AS w FROM leaves l JOIN mid m USING (domain, language)", "domain, language", "source")},
plan AS (SELECT domain, language, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS epochs,
    CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS rest FROM low),
keyed AS (SELECT b.*, p.epochs, p.rest, md5('{SEED}:' || p.epochs || ':' || b.doc_id || ':' || b.tie) AS key
    FROM base b JOIN plan p USING (domain, language, source)),
placed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, language, source ORDER BY key
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM keyed)
SELECT doc_id, domain, language, source, n_tokens, epochs + CASE WHEN begins < rest THEN 1 ELSE 0 END AS copies FROM placed
""",
}
