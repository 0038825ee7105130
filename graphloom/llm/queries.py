"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chat, fingerprints, maxscore, packing, quality, segmentation, simhash, substring_dedup, token_files, toxicity
from graphloom.llm.shared import new_folder, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file, which every machine has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.size("removed").alias("n_removed"), F.to_json("removed").alias("removed_spans"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(docs, tokenizer_file("byte_bpe_50k.json"), new_folder(spark, "token-files"))
    return token_files.read_token_files(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: A conversation whose texts are made of the template's own marks.
PLANTED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    values = ", ".join(f"({c}L, {n}L, '{role}', r'{text}')" for c, n, role, text in PLANTED)
    planted = spark.sql(f"SELECT * FROM VALUES {values} AS t(conv_id, turn, role, text)")
    return chat.digests(chat.format_conversations(rows.unionByName(planted)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", maxscore.quantized(F.col("embedding")).alias("v"))
    return maxscore.top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5)


def op7_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("row_key"), "text")
    sampled = segmentation.sample_segmentations(rows, tokenizer_file("piece_bpe_32k.model"), k=3, out_col="decoded")
    return sampled.select(
        "row_key", "sample", F.size("ids").alias("n_pieces"), "log_prob", "perturbed", "inclusion",
        F.crc32(F.array_join("ids", " ")).alias("ids_crc32"), F.crc32("decoded").alias("decoded_crc32"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")).drop("ids")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_simhash": op2_simhash,
    "op3_token_files": op3_token_files,
    "op4_chat": op4_chat,
    "op5_toxicity": op5_toxicity,
    "op6_maxscore": op6_maxscore,
    "op7_segmentation": op7_segmentation,
    "op8_packing": op8_packing,
    "op9_fingerprints": op9_fingerprints,
    "op10_quality": op10_quality,
}

OP1_SQL = r"""
WITH lowered AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), listed AS (
  SELECT doc_id, length(low) AS n_chars,
         regexp_extract_all(low, '(?:[UNSPACED]|[^\x09-\x0D\x20UNSPACED]{1,16})[\x09-\x0D\x20]*') AS parts
  FROM lowered
), spread AS (
  SELECT doc_id, n_chars, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS k FROM listed
), words AS (
  SELECT doc_id, k, length(part) AS size, regexp_replace(part, '[\x09-\x0D\x20]+$', '') AS word,
         n_chars - sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS place,
         contains(coalesce(lag(part) OVER (PARTITION BY doc_id ORDER BY k), chr(10)), chr(10)) AS line_starts
  FROM spread
), hashes AS (
  SELECT word, lpad((list_reduce(list_transform(range(1, length(word) + 1), lambda i: unicode(substr(word, i, 1))::HUGEINT), lambda a, x: (a * 2685821657736338717 + x) % 18446744073709551616) * 1983613069789375825 % 18446744073709551616 // 4294967296)::VARCHAR, 10, '0') AS hash
  FROM (SELECT DISTINCT word FROM words)
), sums AS (
  SELECT *, list(word) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS every,
         min(CASE WHEN again > 14 THEN hash || lpad(k::VARCHAR, 10, '0') END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS least
  FROM (SELECT *, coalesce(k - lag(k) OVER (PARTITION BY doc_id, hash ORDER BY k), 15) AS again FROM words JOIN hashes USING (word))
), borders AS (
  SELECT doc_id, k FROM words WHERE line_starts
  UNION SELECT doc_id, least[11:]::BIGINT FROM sums WHERE k >= 14 AND least IS NOT NULL
), ends AS (
  SELECT doc_id, k, place AS stop FROM words JOIN borders USING (doc_id, k)
  UNION ALL SELECT doc_id, max(k) + 1, max(n_chars) FROM spread GROUP BY doc_id
), line_ends AS (
  SELECT *, lag(past) OVER (PARTITION BY doc_id ORDER BY past) AS line
  FROM (SELECT doc_id, k AS past, place AS stop FROM words WHERE line_starts UNION ALL SELECT doc_id, max(k) + 1, max(n_chars) FROM spread GROUP BY doc_id)
), stretches AS (
  SELECT a.doc_id, a.k, z.k AS past, z.stop FROM borders a ASOF JOIN ends z ON a.doc_id = z.doc_id AND a.k + 20 <= z.k
  UNION SELECT l.doc_id, a.k, l.past, l.stop FROM line_ends l ASOF JOIN borders a ON l.doc_id = a.doc_id AND l.past - 20 >= a.k WHERE a.k >= l.line
), formed AS (
  SELECT s.doc_id, w.place AS start, s.stop, array_to_string(w.every[s.k + 1 : s.past], ' ') AS form FROM stretches s JOIN sums w ON s.doc_id = w.doc_id AND s.k = w.k
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS kept_doc_id, first_value(start) OVER w AS kept_start, row_number() OVER w AS n
  FROM formed WINDOW w AS (PARTITION BY form ORDER BY doc_id, start)
), flagged AS (
  SELECT *, coalesce(lag(stop) OVER w >= start AND (lag(kept_doc_id) OVER w = kept_doc_id OR lag(start) OVER w = start), false) AS goes_on
  FROM ranked WHERE n > 1 WINDOW w AS (PARTITION BY doc_id ORDER BY start, stop)
), numbered AS (
  SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS nth FROM flagged
), pieces AS (
  SELECT doc_id, nth, min(start) AS start, max(stop) AS stop, arg_min(kept_doc_id, {'a': start, 'b': stop}) AS kept_doc_id, arg_min(kept_start, {'a': start, 'b': stop}) AS kept_start FROM numbered GROUP BY doc_id, nth
), spans AS (
  SELECT doc_id, start, least(stop, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), stop)) AS stop, kept_doc_id, kept_start FROM pieces
), removed AS (
  SELECT doc_id, count(*) AS n, string_agg('{"start":' || start || ',"stop":' || stop || ',"kept_doc_id":' || kept_doc_id || ',"kept_start":' || kept_start || '}', ',' ORDER BY start) AS spans FROM spans GROUP BY doc_id
), held AS (
  SELECT d.doc_id, string_agg(substr(d.text, w.place::BIGINT + 1, w.size), '' ORDER BY w.k) FILTER (WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = w.doc_id AND s.start <= w.place AND w.place < s.stop)) AS text
  FROM documents d JOIN words w USING (doc_id) GROUP BY d.doc_id
)
SELECT doc_id, regexp_extract(d.text, '^[\x09-\x0D\x20]*') || coalesce(h.text, '') AS text,
       CAST(coalesce(r.n, 0) AS INTEGER) AS n_removed, '[' || coalesce(r.spans, '') || ']' AS removed_spans
FROM documents d LEFT JOIN held h USING (doc_id) LEFT JOIN removed r USING (doc_id)
""".replace("UNSPACED", r"\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}")

OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), marked AS (
  SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS previous,
         9 + length(role) + 6 + length(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ')) AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) - 1 AS BIGINT) AS formatted_chars,
       bool_and((previous, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))) AS valid
FROM marked GROUP BY conv_id
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

SQL: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op4_chat": OP4_SQL, "op6_maxscore": OP6_SQL}
