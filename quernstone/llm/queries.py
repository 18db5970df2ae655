"""The queries opN_<name> with production parameters over whole tables, and their SQL where it can be said."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .op01_mix import mixture
from .op02_dedup import exact_dedup
from .op03_nearjoin import near_join
from .op04_pii import pseudonymise
from .op05_shard import shard
from .op06_extract import extract_main
from .op07_lines import line_dedup
from .op08_quality import quality
from .op09_chat import CHAT, chat_format, formatted, read_back, unescape
from .op10_decontaminate import contaminated
from .op11_negatives import hard_negatives
from .op12_tokens import Vocabulary, token_counts
from .op13_fim import fill_in_middle, restored

#: Weights that the sources take in turn, what the mix holds of all words, and the most of a source.
MIX_WEIGHTS, MIX_SHARE, MIX_MOST, MIX_SEED = (3.0, 1.0, 2.0), 1.5, 2.0, "mix"
SHARDS = 24
#: Session setting with the key of the pseudonyms. Without it a random key holds for this driver, whose pseudonyms nobody can undo.
PII_KEY = "spark.quernstone.pii.key"
_random_key = secrets.token_hex(32)
LINE_MIN_DOCS, LINE_MIN_CHARS = 10, 1
QUALITY_THRESHOLD = 0.3
#: Share of a full copy's alignment score from which a document counts as contaminated.
LEAK_SCORE = 0.5
#: Session setting with the vocabulary's file; without it the one of the installed public tokenizers.
VOCABULARY = "spark.quernstone.tokens.model"
TOKEN_LIMIT = 4096
FIM_SEED, FIM_RATE, FIM_SPM = "7", 100, 50


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixture(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SHARE, MIX_MOST, MIX_SEED)
    return drawn.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_nearjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(PII_KEY, None) or _random_key
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key).select("doc_id", "text", "pii", F.size("pii").alias("n_pii"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = shard(table(spark, sf_dir, "documents"), SHARDS)
    return places.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(table(spark, sf_dir, "pages"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), LINE_MIN_DOCS, LINE_MIN_CHARS)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), QUALITY_THRESHOLD)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything returned is read back from the formatted conversations."""
    trial = r"\### Assistant: </turn> ok"
    extra = spark.sql(f"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, r'{trial}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    chats = chat_format(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    whole = chats.withColumn("out", formatted(F.col("segments"))).withColumn("turns", read_back(F.col("out")))
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], CHAT)), "")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.withColumn("learnt", learnt).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("out").cast("long").alias("formatted_chars"),
        F.col("fault").isNull().alias("valid"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), LEAK_SCORE)


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id = F.col("vec_id")
    moved = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), vec_id % 50 == 0, moved)


def vocabulary_path(spark: SparkSession) -> str:
    named = spark.conf.get(VOCABULARY, None)
    if not named:
        import public_tokenizers

        named = public_tokenizers.path("piece_bpe_32k.model")
    return str(named)


def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), Vocabulary.from_model(vocabulary_path(spark)), TOKEN_LIMIT)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"), FIM_SEED, FIM_RATE, FIM_SPM)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


SQL_OP1 = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), weighted AS (
  SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM sources
), level AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING) + weight AS open
  FROM weighted
), settled AS (
  SELECT *, rest / open AS rate, rest / open * weight > cap AS capped FROM level
), final AS (
  SELECT *, (SELECT rate FROM settled WHERE NOT capped ORDER BY cap / weight, rate LIMIT 1) AS final_rate FROM settled
), targets AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(cap, final_rate * weight) END AS target FROM final
), rated AS (
  SELECT *, CAST(coalesce(round(target / nullif(source_size, 0) * 268435456), 0) AS BIGINT) AS rate,
    CAST('0x' || substr(md5('mix' || coalesce('=' || source, '')), 1, 7) AS BIGINT) AS start FROM targets
), ranked AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.rate, r.start,
    row_number() OVER (PARTITION BY d.source ORDER BY length(CAST(d.size AS VARCHAR)) * 100 + CAST(substr(CAST(d.size AS VARCHAR), 1, 2) AS INT),
      substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), d.text)), 1, 2), d.size, d.doc_id) AS rank
  FROM docs d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, CAST(((start + rate * rank) >> 28) - ((start + rate * (rank - 1)) >> 28) AS INT) AS copies,
  CAST((((start + rate * rank) >> 28) - ((start + rate * (rank - 1)) >> 28)) * size AS BIGINT) AS taken
FROM ranked
"""

SQL_OP2 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

SQL_OP3 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), grams AS (
  SELECT doc_id, CASE WHEN len(w) < 5 THEN [hash(array_to_string(w, ' '))]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i : i + 4], ' '))))) END AS grams FROM words
), sets AS MATERIALIZED (
  SELECT grams, min(doc_id) AS rep, count(*) AS weight, len(grams) AS n FROM grams GROUP BY grams
), tokens AS MATERIALIZED (
  SELECT rep, n, unnest(grams) AS token FROM sets
), links AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b FROM tokens a JOIN tokens b ON a.token = b.token AND a.rep <> b.rep AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n
  GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9
), reach AS (
  SELECT rep AS a, rep AS b FROM sets
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), classes AS (
  SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a
), near AS (
  SELECT l.a AS rep, sum(s.weight) AS near FROM links l JOIN sets s ON l.b = s.rep GROUP BY l.a
)
SELECT g.doc_id, c.class_id, CAST(coalesce(near.near, 0) + s.weight - 1 AS BIGINT) AS links, CAST(s.weight - 1 AS BIGINT) AS copies
FROM grams g JOIN sets s USING (grams) JOIN classes c USING (rep) LEFT JOIN near USING (rep)
"""

SQL_OP7 = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), common AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM common)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (key NOT IN (SELECT key FROM common)), '')) AS kept_sha256
FROM lines GROUP BY doc_id
"""

SQL_OP9 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t.turn, t.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)
), coded AS (
  SELECT *, length(replace(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t'), '):', '\c')) + length(CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' WHEN 'assistant' THEN '### Assistant: '
    ELSE '### (' || replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), '):', '\c') || '): ' END) + 8 AS chars,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') || '>' || role AS step, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(step IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') AND (from_end > 1 OR role IN ('user', 'assistant'))) AS valid
FROM coded GROUP BY conv_id
"""

SQL_OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER best AS INT) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW best AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER best <= 3
"""

SQL_OP13 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), drawn AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM docs
), cuts AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM drawn
), parts AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts
"""

QUERIES = {
    "op1_mix": op1_mix,
    "op2_dedup": op2_dedup,
    "op3_nearjoin": op3_nearjoin,
    "op4_pii": op4_pii,
    "op5_shard": op5_shard,
    "op6_extract": op6_extract,
    "op7_lines": op7_lines,
    "op8_quality": op8_quality,
    "op9_chat": op9_chat,
    "op10_decontaminate": op10_decontaminate,
    "op11_negatives": op11_negatives,
    "op12_tokens": op12_tokens,
    "op13_fim": op13_fim,
}
ORACLE_SQL = {"op1_mix": SQL_OP1, "op2_dedup": SQL_OP2, "op3_nearjoin": SQL_OP3, "op7_lines": SQL_OP7, "op9_chat": SQL_OP9, "op11_negatives": SQL_OP11, "op13_fim": SQL_OP13}
