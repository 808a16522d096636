"""The queries of this folder's operators, one per operator, each over its whole table; SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.base import table
from framewright.llm.bpe_automaton import encoded, vocabulary_path
from framewright.llm.decontaminate import contamination
from framewright.llm.embedding_dedup import near_duplicates
from framewright.llm.jaccard_join import jaccard_components
from framewright.llm import graph_search
from framewright.llm import ranked_search
from framewright.llm import secret_scan
from framewright.llm import url_templates
from framewright.llm.language_id import fitted, languages
from framewright.llm import pitman_yor
from framewright.llm import turn_repair
from framewright.llm.suffix_dedup import without_repeats
from framewright.llm.personal_data import KINDS, digest_text, personal_data

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), 400).drop("removed")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _held_out(modulus: int, remainder: int):  # noqa: ANN202
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scored(table(spark, sf_dir, "documents"), _held_out(7, 2))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = _held_out(5, 0)
    model = fitted(docs.where(~held))
    return languages(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_* count the base spans; ``spans`` also has those behind disguises."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(digest_text(base), 256).alias("base_sha256"), digest_text(F.col("spans")).alias("spans"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a file (repository) and its source the owner; n_* count the base spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return secret_scan.secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secret_scan.KINDS], F.sha2(secret_scan.digest_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.digest_text(F.concat("base", "added")).alias("spans"), "n_live", "n_example")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


_JACCARD_SQL = f"""
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'),
  lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
posts AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM posts a JOIN posts b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comps AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)"""

_JACCARD_TWIN = f"""WITH RECURSIVE {_JACCARD_SQL.strip()}
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN comps USING (doc_id)"""


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), vocabulary_path(), digests=True)


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judged(table(spark, sf_dir, "pages"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


_EMBEDDING_TWIN = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comps AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comps ON vec_id = comps.a LEFT JOIN counts ON vec_id = counts.a"""


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of which no row is left after the damage have zeros, an empty audit and the digest of the empty string."""
    rows = table(spark, sf_dir, "conversations")
    done = turn_repair.audits(turn_repair.damaged(rows)).withColumnRenamed("conv_id", "c")
    zero = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return rows.select("conv_id").distinct().join(done, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *[F.coalesce(z, F.lit(0).cast("long")).alias(z) for z in zero], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_pitman_yor": op2_pitman_yor,
    "op3_decontaminate": op3_decontaminate,
    "op4_language_id": op4_language_id,
    "op5_personal_data": op5_personal_data,
    "op6_secret_scan": op6_secret_scan,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_bpe_automaton": op8_bpe_automaton,
    "op9_url_templates": op9_url_templates,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_turn_repair": op11_turn_repair,
    "op12_ranked_search": op12_ranked_search,
    "op13_graph_search": op13_graph_search,
}
SQL: dict[str, str] = {
    "op7_jaccard_join": _JACCARD_TWIN,
    "op9_url_templates": url_templates.twin_sql(),
    "op10_embedding_dedup": _EMBEDDING_TWIN,
    "op12_ranked_search": ranked_search.twin_sql(),
}
