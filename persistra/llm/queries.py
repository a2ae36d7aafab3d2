"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from persistra.llm.base import table


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from persistra.llm.matroska import store_and_read_back

    return store_and_read_back(table(spark, sf_dir, "documents"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from persistra.llm.minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from persistra.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from persistra.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "source", "n_tokens", "weight", "copies")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from persistra.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from persistra.llm.language_id import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs), "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from persistra.llm.chat_format import format_conversations, with_control_strings

    return format_conversations(with_control_strings(table(spark, sf_dir, "conversations")))


def op6_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from persistra.llm.phrase_dedup import remove_repeats

    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from persistra.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from persistra.llm.bpe import encode_and_decode

    return encode_and_decode(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_ann_search": op1_ann_search,
    "op2_source_mixing": op2_source_mixing,
    "op3_html_text": op3_html_text,
    "op4_language_id": op4_language_id,
    "op5_chat_format": op5_chat_format,
    "op6_phrase_dedup": op6_phrase_dedup,
    "op7_matroska": op7_matroska,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_bpe": op10_bpe,
    "pipeline": pipeline,
}


#: windows are compared word by word: words hold no space, so a joined window is the window
PHRASE_ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT r, s, array_to_string(ws[s : s + 34], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS s FROM d)
), again AS (
  SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(s, s + 35)) AS i FROM again
), word AS (
  SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d
), kept AS (
  SELECT word.r, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, i) GROUP BY word.r
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r
"""

#: shingles are compared word by word, all pairs that share one
NEAR_ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(ws[i : i + 4], ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), pairs AS (
  SELECT a.r AS a, b.r AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pairs JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * m >= 75 * (x.n + y.n - m)
), reach(a, b) AS (
  SELECT r, r FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(e.doc_id) AS component_id, d.doc_id = min(e.doc_id) AS kept
FROM d JOIN reach ON reach.a = d.r JOIN d e ON e.r = reach.b LEFT JOIN n ON n.r = d.r
GROUP BY d.r, d.doc_id
"""


def _oracles() -> dict[str, str]:
    from persistra.llm.url_filter import ORACLE

    return {"op6_phrase_dedup": PHRASE_ORACLE, "op8_minhash_dedup": NEAR_ORACLE, "op9_url_filter": ORACLE}


ORACLES: dict[str, str] = _oracles()
