"""Queries over the test tables, each with its SQL where SQL can say it.

`documents` plays the ingested corpus, `pages` the HTML files, `embeddings` the vectors, `conversations` the chat and export
rows, `labels` the task results, `events.props` the JSON texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as x
from ..functions.confidence import confidence, needs_review
from ..operators import entities as ent
from ..operators import keywords as kw
from ..operators import langmodel
from ..operators import language as lang
from ..operators import phrases
from ..operators import profile as prof
from ..operators import similarity as sim
from ..operators import gazetteer, polarity, tagger, wordvectors
from ..operators.clustering import kmeans
from ..operators.clustering import learnt_topics as topics_of_texts
from ..operators.density import density_topics as dense
from ..operators.dedup import content_hash, drop_duplicates, mark_duplicates
from ..operators.label import Decision, Models, label
from ..providers.brain import parse_design
from ..providers.clients import GENERATIVE, FakeClient, generate_column, usage
from ..session import scratch, spread
from ..sinks import export
from ..sources.files import read_any_text, scan_files
from ..sources.folder import json_values
from ..sources.html import html_metadata, html_text
from .pipeline import ingest_texts, kept, with_ids

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

WORDS_SQL = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(f"SELECT doc_id, CAST(len({WORDS_SQL.format('text')}) AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS char_count, CAST(octet_length(encode(text)) AS BIGINT) AS size, left(text, 20) AS prefix FROM documents")
def doc_stats(spark, d):
    return t(spark, d, "documents").select("doc_id", x.word_count("text").cast("long").alias("words"), F.length("text").cast("long").alias("char_count"), F.octet_length("text").cast("long").alias("size"), x.head("text", 20).alias("prefix"))


NOISE_SQL = r"coalesce(len(regexp_extract_all(text, '[^a-zA-Z0-9\s]'))::DOUBLE / nullif(length(text), 0), 0)"


@query(f"SELECT doc_id, round({NOISE_SQL}, 4) AS noise FROM documents")
def noise_ratio(spark, d):
    return t(spark, d, "documents").select("doc_id", F.round(x.noise_ratio("text"), 4).alias("noise"))


@query(
    r"""SELECT conv_id, turn, regexp_matches(line, '(^|\n)(User:|Assistant:|Q:|A:|Speaker)') AS dialogue,
    regexp_matches(line, '(def |class |#include|console\.log|public static|import )') AS code
    FROM (SELECT conv_id, turn, upper(left(role, 1)) || lower(substr(role, 2)) || ': ' || text AS line FROM conversations)"""
)
def structure_flags(spark, d):
    line = F.concat(F.initcap("role"), F.lit(": "), "text")
    return t(spark, d, "conversations").select("conv_id", "turn", x.has_dialogue(line).alias("dialogue"), x.has_code(line).alias("code"))


@query(f"SELECT doc_id, round(coalesce(len(list_distinct({WORDS_SQL.format('text')}))::DOUBLE / nullif(len({WORDS_SQL.format('text')}), 0), 0), 6) AS diversity FROM documents")
def lexical_diversity(spark, d):
    return t(spark, d, "documents").select("doc_id", F.round(x.lexical_diversity("text"), 6).alias("diversity"))


def _chunk_sql(size: int) -> str:
    return f"""SELECT doc_id, CAST(i AS INT) AS idx, list_aggregate(list_slice(w, i * {size} + 1, (i + 1) * {size}), 'string_agg', ' ') AS chunk
    FROM (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / {size}.0) AS BIGINT))) AS i FROM (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents))"""


def _chunked(spark, d, size):
    return t(spark, d, "documents").select("doc_id", F.posexplode(x.chunks("text", size)).alias("idx", "chunk"))


@query(_chunk_sql(1000))
def chunk_text(spark, d):
    return _chunked(spark, d, 1000)


@query(_chunk_sql(100))
def chunk_text_100(spark, d):
    return _chunked(spark, d, 100)


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY md5(text)")
def exact_dedup(spark, d):
    slim = t(spark, d, "documents").select("doc_id", content_hash("text").alias("digest"))
    return drop_duplicates(slim, "digest", "doc_id")


@query(
    f"""SELECT count(*) AS total_docs, list_sort(list(DISTINCT lang)) AS languages, list_sort(list(DISTINCT source)) AS formats,
    (SELECT count(*) - count(DISTINCT md5(text)) FROM documents) AS duplicates, CAST(floor(avg(len({WORDS_SQL.format('text')}))) AS BIGINT) AS avg_length,
    round(sum(octet_length(encode(text))) / 1048576, 3) AS total_size_mb
    FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS turn FROM documents) WHERE turn = 1"""
)
def ingestion_report(spark, d):
    slim = t(spark, d, "documents").select("doc_id", "lang", "source", content_hash("text").alias("digest"), x.word_count("text").alias("words"), F.octet_length("text").alias("size"))
    marked = mark_duplicates(slim, "digest", "doc_id")
    return prof.ingestion_stats(
        marked.withColumns({c: F.when(~F.col("duplicate"), F.col(c)) for c in ("words", "size")}),
        form="source",
        duplicates=F.count(F.when(F.col("duplicate"), 1)),
    ).withColumn("total_docs", F.col("total_docs") - F.col("duplicates"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def lang_distribution(spark, d):
    return prof.distribution(t(spark, d, "documents"), "lang")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def cluster_sizes(spark, d):
    return prof.distribution(t(spark, d, "documents"), "source")


@query("SELECT source, list_sort(list(doc_id)) AS doc_ids FROM documents GROUP BY source")
def cluster_members(spark, d):
    return prof.members(t(spark, d, "documents"), "source")


@query(
    rf"""WITH d AS (SELECT *, {NOISE_SQL} AS noise, regexp_matches(text, '(^|\n)(User:|Assistant:|Q:|A:|Speaker)') AS dialogue,
      regexp_matches(text, '(def |class |#include|console\.log|public static|import )') AS code FROM documents)
    SELECT CASE WHEN avg(dialogue::INT) > 0.4 THEN 'chat_dataset' WHEN avg(code::INT) > 0.3 THEN 'technical_dataset' WHEN count(DISTINCT lang) > 2 THEN 'multilingual_dataset' ELSE 'mixed_dataset' END AS probable_dataset_type,
      count(*) AS total_documents, count(DISTINCT source) AS topics, round(avg(noise), 4) AS avg_noise_ratio, round(avg(dialogue::INT), 4) AS dialogue_ratio, round(avg(code::INT), 4) AS code_ratio, count(DISTINCT lang) AS languages FROM d"""
)
def dataset_profile(spark, d):
    whole = prof.dataset_profile(t(spark, d, "documents"), topic="source")
    return whole.select("probable_dataset_type", "total_documents", F.size("topics_detected").cast("long").alias("topics"), "avg_noise_ratio", "dialogue_ratio", "code_ratio", F.size("language_distribution").cast("long").alias("languages"))


@query("SELECT lang, count(*) AS n FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 100) GROUP BY lang")
def lang_head_sample(spark, d):
    return prof.distribution(prof.head_sample(t(spark, d, "documents"), "doc_id", 100), "lang")


def _lang_sql() -> str:
    tokens = r"list_filter(regexp_split_to_array(regexp_replace(lower(left(text, 5000)), '[.,;:!?()]+', ' ', 'g'), '\s+'), lambda w: w <> '')"
    scores = ", ".join(f"len(list_filter(w, lambda z: list_contains([{', '.join(repr(s) for s in stop)}], z))) AS {name}" for name, stop in lang.STOP_WORDS.items())
    names = list(lang.STOP_WORDS)
    pick = " ".join(f"WHEN {n} > 0 AND {n} = greatest({', '.join(names)}) THEN '{n}'" for n in names)
    return f"SELECT doc_id, CASE {pick} ELSE 'unknown' END AS detected FROM (SELECT doc_id, {scores} FROM (SELECT doc_id, {tokens} AS w FROM documents))"


@query(_lang_sql())
def lang_detect(spark, d):
    return spread(t(spark, d, "documents").select("doc_id", "text")).select("doc_id", lang.detect_language("text").alias("detected"))


# Rows whose id is a multiple of five are held out from learning.
LANG_MODEL_SQL = r"""WITH RECURSIVE plain AS (SELECT doc_id, lang, doc_id % 5 = 0 AS held_out, ' ' || trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+|[\x{10000}-\x{10FFFF}]+', ' ', 'g'), ' +', ' ', 'g')) || ' ' AS t FROM documents),
    grams AS MATERIALIZED (SELECT doc_id, lang, held_out, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS g FROM plain WHERE t <> '  '),
    n3 AS MATERIALIZED (SELECT lang, g, count(*) AS n FROM grams WHERE NOT held_out GROUP BY ALL), n2 AS MATERIALIZED (SELECT lang, substr(g, 2) AS g, sum(n) AS n FROM n3 GROUP BY ALL), n1 AS MATERIALIZED (SELECT lang, g[2] AS g, sum(n) AS n FROM n2 GROUP BY ALL),
    total AS (SELECT lang, sum(n) AS every, count(*) AS kinds FROM n1 GROUP BY lang), c2 AS (SELECT lang, g[:2] AS c, sum(n) AS n, count(*) AS t FROM n3 GROUP BY ALL), c1 AS (SELECT lang, g[1] AS c, sum(n) AS n, count(*) AS t FROM n2 GROUP BY ALL),
    asked AS MATERIALIZED (SELECT DISTINCT g FROM grams),
    p AS MATERIALIZED (SELECT l.lang, a.g, ln(CASE WHEN c2.n IS NULL THEN q ELSE (coalesce(n3.n, 0) + c2.t * q) / (c2.n + c2.t)::DOUBLE END) AS log FROM
      (SELECT l.lang, a.g, CASE WHEN c1.n IS NULL THEN r ELSE (coalesce(n2.n, 0) + c1.t * r) / (c1.n + c1.t)::DOUBLE END AS q FROM
        (SELECT l.lang, a.g, (coalesce(n1.n, 0) + 1) / (l.every + l.kinds + 1)::DOUBLE AS r FROM asked a CROSS JOIN total l LEFT JOIN n1 ON n1.lang = l.lang AND n1.g = a.g[3]) AS x(lang, g, r)
        JOIN total l ON l.lang = x.lang JOIN asked a ON a.g = x.g LEFT JOIN n2 ON n2.lang = x.lang AND n2.g = substr(x.g, 2) LEFT JOIN c1 ON c1.lang = x.lang AND c1.c = x.g[2]) AS y(lang, g, q)
      JOIN total l ON l.lang = y.lang JOIN asked a ON a.g = y.g LEFT JOIN n3 ON n3.lang = y.lang AND n3.g = y.g LEFT JOIN c2 ON c2.lang = y.lang AND c2.c = y.g[:2]),
    s AS (SELECT doc_id, p.lang, sum(log) / count(*) AS log FROM grams JOIN p USING (g) GROUP BY ALL),
    best AS (SELECT doc_id, lang AS detected, log FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY log DESC, lang) = 1)"""


def _told(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", "text", (F.col("doc_id") % 5 == 0).alias("held_out"))
    return langmodel.detect(docs, langmodel.train(docs.where("not held_out")))


@query(f"{LANG_MODEL_SQL} SELECT doc_id, held_out, coalesce(detected, 'unknown') AS detected, round(log, 6) AS log FROM plain LEFT JOIN best USING (doc_id)")
def lang_learnt(spark, d):
    return _told(spark, d).select("doc_id", "held_out", "detected", F.round("detected_log", 6).alias("log"))


@query(f"{LANG_MODEL_SQL} SELECT lang, count(*) AS held_out_docs, count(*) FILTER (detected = lang) AS right_docs FROM plain LEFT JOIN best USING (doc_id) WHERE held_out GROUP BY lang")
def lang_learnt_accuracy(spark, d):
    told = _told(spark, d).where("held_out")
    return told.groupBy("lang").agg(F.count("*").alias("held_out_docs"), F.count_if(F.col("detected") == F.col("lang")).alias("right_docs"))


TERMS_SQL = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), '\s+'), lambda w: length(w) > 1)"


@query(
    f"""WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 100), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS_SQL}) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), s AS (SELECT doc_id, term, round(tf * (ln((SELECT count(*) FROM d)::DOUBLE / df) + 1), 6) AS score FROM tf JOIN df USING (term)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS INT) AS rank FROM s)
    SELECT doc_id, rank, term, score FROM r WHERE rank <= 20"""
)
def keyword_topk(spark, d):
    return kw.top_terms(t(spark, d, "documents"))


STOPS_SQL = f"(length(w) < {phrases.SHORTEST} OR w IN ({', '.join(map(repr, phrases.STOPS))}))"
PHRASES_SQL = rf"""WITH said AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?\n]+'), lambda s:
      list_filter(list_transform(regexp_split_to_array(s, '[^\p{{L}}\p{{N}} \t]+'), lambda c: list_filter(regexp_split_to_array(c, '[ \t]+'), lambda w: w <> '')), lambda c: len(c) > 0)), lambda s: len(s) > 0) AS ss FROM documents),
    sentences AS (SELECT doc_id, unnest(ss) AS cs, generate_subscripts(ss, 1) - 1 AS s FROM said),
    stretches AS MATERIALIZED (SELECT doc_id, s, unnest(cs) AS ws, generate_subscripts(cs, 1) - 1 AS c FROM sentences),
    tokens AS (SELECT doc_id, s, c, generate_subscripts(ws, 1) AS i, unnest(ws) AS raw, ws FROM stretches),
    words AS (SELECT doc_id, s, lower(raw) AS w, raw, lower(CASE WHEN i > 1 THEN ws[i - 1] END) AS l, lower(ws[i + 1]) AS r, c = 0 AND i = 1 AS opens FROM tokens),
    terms AS MATERIALIZED (SELECT doc_id, w, count(*) AS tf, count(*) FILTER (upper(raw) = raw AND lower(raw) <> raw AND length(raw) > 1) AS acronym, count(*) FILTER (raw[1] <> lower(raw[1]) AND NOT opens) AS name,
      median(DISTINCT s) AS middle, count(DISTINCT s) AS spread, max(s) AS last, coalesce(count(DISTINCT l) / nullif(count(l), 0)::DOUBLE, 0) AS dl, coalesce(count(DISTINCT r) / nullif(count(r), 0)::DOUBLE, 0) AS dr FROM words GROUP BY doc_id, w),
    whole AS (SELECT doc_id, coalesce(avg(tf) FILTER (NOT {STOPS_SQL}) + stddev_pop(tf) FILTER (NOT {STOPS_SQL}), 0) AS usual, max(tf) AS most, max(last) + 1 AS n FROM terms GROUP BY doc_id),
    features AS (SELECT doc_id, w AS term, tf, greatest(acronym, name) / ln(1 + tf) AS casing, ln(ln(3 + middle)) AS position, coalesce(tf / nullif(usual, 0), 0) AS frequency, 1 + (dl + dr) * tf / most AS related, spread / n::DOUBLE AS spread FROM terms JOIN whole USING (doc_id)),
    scores AS MATERIALIZED (SELECT *, related * position / (casing + (frequency + spread) / related) AS score FROM features)"""


@query(f'{PHRASES_SQL} SELECT doc_id, term, tf, round(casing, 6) AS casing, round(position, 6) AS position, round(frequency, 6) AS frequency, round(related, 6) AS related, round(spread, 6) AS spread, round(score, 6) AS score FROM scores')
def keyphrase_features(spark, d):
    found = phrases.term_features(t(spark, d, "documents")).withColumnRenamed("case", "casing")
    return found.select("doc_id", "term", "tf", *[F.round(c, 6).alias(c) for c in ("casing", "position", "frequency", "related", "spread", "score")])


@query()
def keyphrases(spark, d):
    return phrases.key_phrases(t(spark, d, "documents"))


@query()
def keywords(spark, d):
    return kw.keywords(t(spark, d, "documents"))


@query(
    f"""WITH tf AS (SELECT lang, term, count(*) AS tf FROM (SELECT lang, unnest({TERMS_SQL}) AS term FROM documents) GROUP BY ALL), o AS (SELECT term, sum(tf) AS every FROM tf GROUP BY term),
    s AS (SELECT lang, sum(tf) AS size FROM tf GROUP BY lang), m AS (SELECT avg(size) AS mean FROM s),
    r AS (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY round(tf / size::DOUBLE * ln(1 + mean / every), 9) DESC, term) AS rank FROM tf JOIN o USING (term) JOIN s USING (lang), m)
    SELECT lang, string_agg(term, '_' ORDER BY rank) AS topic FROM r WHERE rank <= 2 GROUP BY lang"""
)
def topic_names(spark, d):
    return kw.topic_names(t(spark, d, "documents"), "lang")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def top_topics(spark, d):
    return kw.top_topics(t(spark, d, "documents"), "source")


@query(
    r"""SELECT page_id, trim(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&')) AS title,
    list_transform(regexp_extract_all(html, '<h[123]>([^<]*)</h[123]>', 1), lambda h: trim(replace(h, '&amp;', '&'))) AS headings,
    regexp_extract_all(html, '<a href="([^"]*)"', 1) AS links FROM pages"""
)
def html_title_headings_links(spark, d):
    return t(spark, d, "pages").select("page_id", html_metadata("html").alias("m")).select("page_id", "m.title", "m.headings", "m.links")


#: Enough for these pages: no quoted > in a tag, only scripts and styles without text, and a few character references.
VISIBLE_SQL = r"""SELECT page_id, list_aggregate(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '<i>', 'gs'), '<!--.*?-->', '<i>', 'gs'), '<[^>]*>'),
    lambda s: regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(s, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;?', '&', 'g'), '^\s+|\s+$', '', 'g')), lambda s: s <> ''), 'string_agg', chr(10)) AS text FROM pages"""


@query(VISIBLE_SQL)
def html_visible_text(spark, d):
    return t(spark, d, "pages").select("page_id", html_text("html").alias("text"))


@query(
    r"""SELECT p_partkey, trim(replace(regexp_replace(trim(lower('This is a ' || replace(p_type, ' ', '_'))), '^(this message is a |this message is |this is a |this is |the message is |request to |a )', ''), '_', ' ')) AS label FROM part"""
)
def label_clean(spark, d):
    return t(spark, d, "part").select("p_partkey", x.clean_label(F.concat(F.lit("This is a "), F.translate("p_type", " ", "_"))).alias("label"))


@query("SELECT doc_id, CASE 1 + (doc_id % 5) WHEN 1 THEN 'negative' WHEN 2 THEN 'negative' WHEN 3 THEN 'neutral' ELSE 'positive' END AS sentiment FROM labels")
def sentiment_map(spark, d):
    return t(spark, d, "labels").select("doc_id", x.star_sentiment(F.concat((1 + F.col("doc_id") % 5).cast("string"), F.lit(" stars"))).alias("sentiment"))


QUALITY_SQL = f"""CASE WHEN len({WORDS_SQL.format('text')}) = 0 THEN 0.0 WHEN len({WORDS_SQL.format('text')}) = 1 THEN 0.35 WHEN len({WORDS_SQL.format('text')}) <= 3 THEN 0.55
    WHEN len({WORDS_SQL.format('text')}) <= 10 THEN 0.75 WHEN len({WORDS_SQL.format('text')}) <= 50 THEN 0.9 ELSE 0.95 END::DOUBLE"""


@query(f"SELECT doc_id, {QUALITY_SQL} AS quality FROM documents")
def text_quality(spark, d):
    return t(spark, d, "documents").select("doc_id", x.text_quality("text").alias("quality"))


# A document with labels has a classification and, by its toxicity, an intent; a cluster if its source is even.
CONFIDENCE_SQL = f"""WITH s AS (SELECT doc_id, {QUALITY_SQL} AS tq, CASE WHEN l.quality = 1 THEN 0.9::DOUBLE WHEN l.quality = 0 THEN 0.4::DOUBLE END AS c, CASE WHEN l.toxic = 1 THEN 0.3::DOUBLE WHEN l.toxic = 0 THEN 0.8::DOUBLE END AS i,
      CASE WHEN doc_id % 2 = 0 THEN 0.65::DOUBLE END AS k, least(0.5::DOUBLE + (doc_id % 7) * 0.1::DOUBLE, 0.95::DOUBLE) AS e FROM documents LEFT JOIN labels l USING (doc_id)),
    w AS (SELECT doc_id, tq, coalesce(c * 0.3::DOUBLE, 0::DOUBLE) + coalesce(i * 0.25::DOUBLE, 0::DOUBLE) + e * 0.1::DOUBLE + coalesce(k * 0.05::DOUBLE, 0::DOUBLE) AS sw,
      CASE WHEN c IS NULL THEN 0::DOUBLE ELSE 0.3::DOUBLE END + CASE WHEN i IS NULL THEN 0::DOUBLE ELSE 0.25::DOUBLE END + 0.1::DOUBLE + CASE WHEN k IS NULL THEN 0::DOUBLE ELSE 0.05::DOUBLE END AS w FROM s)
    SELECT doc_id, round(greatest(least(sw / w * 0.85::DOUBLE + tq * 0.15::DOUBLE, 1::DOUBLE), 0::DOUBLE), 4) AS confidence_score FROM w"""


def _scored(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    score = confidence(
        "text",
        classification=F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.4),
        intent=F.when(F.col("toxic") == 1, 0.5).when(F.col("toxic") == 0, 0.8),
        intent_name=F.when(F.col("toxic") == 1, "unknown").otherwise("greeting"),
        entities=F.col("doc_id") % 7,
        cluster=F.when(F.col("doc_id") % 2 == 0, 1),
    )
    return rows.select("doc_id", score.alias("confidence_score"))


@query(CONFIDENCE_SQL)
def confidence_score(spark, d):
    return _scored(spark, d)


@query(f"SELECT doc_id, confidence_score < 0.5 AS needs_review FROM ({CONFIDENCE_SQL})")
def review_flag(spark, d):
    return _scored(spark, d).select("doc_id", needs_review("confidence_score").alias("needs_review"))


@query(f'SELECT count(*) AS "rows", round(avg(confidence_score), 4) AS avg_confidence, count(*) FILTER (confidence_score < 0.5) AS needs_review FROM ({CONFIDENCE_SQL})')
def batch_summary(spark, d):
    return prof.batch_summary(_scored(spark, d).withColumn("needs_review", needs_review("confidence_score")))


@query(
    """WITH e AS (SELECT label, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS ex FROM embeddings GROUP BY label), s AS (SELECT v.vec_id, e.label, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), e.ex) AS sim FROM embeddings v, e),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, CAST(label AS VARCHAR)) AS turn FROM s)
    SELECT vec_id, CASE WHEN sim >= 0.55 THEN CAST(label AS VARCHAR) ELSE 'unknown' END AS intent, round(sim, 4) AS confidence FROM r WHERE turn = 1"""
)
def intent_detect(spark, d):
    vectors = t(spark, d, "embeddings")
    first = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    best = sim.best_exemplar("embedding", sim.exemplar_table(first, "label", "embedding"))
    return vectors.select("vec_id", best.alias("b")).select("vec_id", "b.intent", F.round("b.confidence", 4).alias("confidence"))


@query()
def intent_of_text(spark, d):
    return sim.detect_intent(t(spark, d, "conversations")).select("conv_id", "turn", "intent.intent", "intent.confidence")


@query(
    """WITH p AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v, vec_id FROM embeddings), c AS (SELECT i, avg(v) AS m FROM p GROUP BY i),
    f AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label), s AS (SELECT label, sum(v * m) AS score FROM p JOIN f USING (label, vec_id) JOIN c USING (i) GROUP BY label)
    SELECT CAST(label AS VARCHAR) AS domain, round(score, 6) AS score FROM s ORDER BY s.score DESC, CAST(label AS VARCHAR) LIMIT 1"""
)
def domain_detect(spark, d):
    vectors = t(spark, d, "embeddings")
    templates = sim.exemplar_table(vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")), "label", "embedding")
    return sim.best_domain(sim.mean_vector(vectors, "embedding"), "embedding", {k: v[0] for k, v in templates.items()})


PPMI_SQL = f"""WITH w AS MATERIALIZED (SELECT doc_id, {TERMS_SQL} AS w FROM documents), known AS (SELECT term FROM (SELECT unnest(list_distinct(w)) AS term FROM w) GROUP BY term HAVING count(*) >= 5),
    near AS (SELECT w[i] AS x, w[i + j] AS y FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM w), range(1, 5) AS r(j) WHERE i + j <= len(w)),
    once AS MATERIALIZED (SELECT x, y, count(*) AS n FROM near WHERE x IN (SELECT term FROM known) AND y IN (SELECT term FROM known) GROUP BY ALL),
    n AS MATERIALIZED (SELECT a, b, CAST(sum(n) AS BIGINT) AS n FROM (SELECT x AS a, y AS b, n FROM once UNION ALL SELECT y, x, n FROM once) GROUP BY ALL), s AS MATERIALIZED (SELECT a, sum(n) AS total FROM n GROUP BY a),
    e AS MATERIALIZED (SELECT n.a, n.b, n.n, ln(n.n * (SELECT sum(total) FROM s)::DOUBLE / (sa.total::DOUBLE * sb.total)) AS ppmi FROM n JOIN s sa ON sa.a = n.a JOIN s sb ON sb.a = n.b
    WHERE ln(n.n * (SELECT sum(total) FROM s)::DOUBLE / (sa.total::DOUBLE * sb.total)) > 0)"""


@query(f"{PPMI_SQL} SELECT a, b, n, round(ppmi, 6) AS ppmi FROM e")
def ppmi_pairs(spark, d):
    words = wordvectors.near(t(spark, d, "documents"))
    return words.named(wordvectors.ppmi(words.both())).withColumn("ppmi", F.round("ppmi", 6))


POLARITY_SQL = f"""{PPMI_SQL}, r AS MATERIALIZED (SELECT toxic, list_distinct(w) AS w FROM w JOIN labels USING (doc_id) WHERE doc_id % 5 <> 0 AND toxic IN (0, 1)),
    z AS (SELECT count(*)::DOUBLE AS n, sum(toxic)::DOUBLE AS yes FROM r), c AS (SELECT term, count(*)::DOUBLE AS n, sum(toxic)::DOUBLE AS yes FROM (SELECT toxic, unnest(w) AS term FROM r) GROUP BY term HAVING count(*) >= 5),
    o AS MATERIALIZED (SELECT term, round(ln((c.yes + 0.5) * (z.n - z.yes - c.n + c.yes + 0.5) / ((c.n - c.yes + 0.5) * (z.yes - c.yes + 0.5))), 6) AS odds FROM c, z),
    seeds AS MATERIALIZED ((SELECT term, -1 AS side FROM o ORDER BY odds DESC, term LIMIT {polarity.SEEDS}) UNION ALL (SELECT term, 1 AS side FROM o ORDER BY odds, term LIMIT {polarity.SEEDS})),
    g AS MATERIALIZED (SELECT a AS term, sum(ppmi) AS d FROM e GROUP BY a), m AS MATERIALIZED (SELECT a, b, {1 - polarity.RESTART} * ppmi / sqrt(x.d * y.d) AS w FROM e JOIN g x ON x.term = a JOIN g y ON y.term = b),
    k AS (SELECT term, max((side > 0)::INT)::DOUBLE AS p, max((side < 0)::INT)::DOUBLE AS n FROM seeds SEMI JOIN g USING (term) GROUP BY term),
    w0 AS MATERIALIZED (SELECT term, coalesce(p / nullif((SELECT sum(p) FROM k), 0), 0) AS p, coalesce(n / nullif((SELECT sum(n) FROM k), 0), 0) AS n FROM k),
    {", ".join(f"w{i} AS MATERIALIZED (SELECT term, sum(p) AS p, sum(n) AS n FROM (SELECT a AS term, w * p AS p, w * n AS n FROM m JOIN w{i - 1} ON b = term UNION ALL SELECT term, {polarity.RESTART} * p, {polarity.RESTART} * n FROM w0) GROUP BY term)" for i in range(1, polarity.ROUNDS + 1))},
    idle AS (SELECT term, sqrt(d) / (SELECT sum(sqrt(d)) FROM g) AS idle FROM g),
    lexicon AS MATERIALIZED (SELECT term, p, n, (p + idle) / (p + n + 2 * idle) AS polarity FROM w{polarity.ROUNDS} JOIN idle USING (term) WHERE p + n > 0)"""


def _lexicon(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    seeds = polarity.seed_terms(docs, t(spark, d, "labels").where("doc_id % 5 <> 0"))
    words, met = wordvectors.meetings(docs)
    return docs, polarity.walk_words(words.terms, met, seeds)


@query(f"{POLARITY_SQL} SELECT term, round(p, 9) AS positive, round(n, 9) AS negative, round(polarity, 6) AS polarity FROM lexicon")
def sentiment_terms(spark, d):
    """Polarity of all terms, from seeds of the labelled documents that aren't held out."""
    _, lexicon = _lexicon(spark, d)
    return lexicon.select("term", F.round("positive", 9).alias("positive"), F.round("negative", 9).alias("negative"), F.round("polarity", 6).alias("polarity"))


@query(
    f"""{POLARITY_SQL}, x AS (SELECT doc_id, sum((2 * polarity - 1) * abs(2 * polarity - 1)) AS x, sum(abs(2 * polarity - 1)) AS w FROM (SELECT doc_id, unnest(w) AS term FROM w) JOIN lexicon USING (term) GROUP BY doc_id),
    mean AS (SELECT doc_id, coalesce(round(x / nullif(w, 0), 6), 0) AS mean FROM documents LEFT JOIN x USING (doc_id))
    SELECT doc_id, CASE WHEN mean > {polarity.FAR} THEN 'positive' WHEN mean > {polarity.BAND} THEN 'positive' WHEN mean >= -{polarity.BAND} THEN 'neutral' ELSE 'negative' END AS sentiment, mean FROM mean"""
)
def sentiment_learnt(spark, d):
    docs, lexicon = _lexicon(spark, d)
    return polarity.rate(docs, lexicon).select("doc_id", x.star_sentiment("label").alias("sentiment"), "mean")


@query()
def text_vectors(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    return wordvectors.text_vectors(docs, wordvectors.learn(docs))


@query()
def learnt_topics(spark, d):
    return topics_of_texts(t(spark, d, "documents").select("doc_id", "text"))


@query()
def density_topics(spark, d):
    return dense(t(spark, d, "embeddings"))


@query(
    r"""WITH texts AS (SELECT c_custkey, c_name || ' of ' || n_name || ', ' || r_name || '; ' || c_mktsegment || ' in the ' || r_name || ', not of ' || n_name || 'n' AS t FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    names AS (SELECT lower(n_name) AS name, 'GPE' AS label FROM nation UNION SELECT lower(r_name), 'LOC' FROM region),
    hits AS (SELECT c_custkey, t, name, label, unnest(range(1, length(t) - length(name) + 2)) AS i FROM texts JOIN names ON contains(lower(t), name))
    SELECT c_custkey, substr(t, i, length(name)) AS text, label, CASE label WHEN 'GPE' THEN 'Country / City / State' ELSE 'Geographic location' END AS description, CAST(i - 1 AS INT) AS start, CAST(i - 1 + length(name) AS INT) AS "end", 'gazetteer' AS source FROM hits
    WHERE substr(lower(t), i, length(name)) = name AND (i = 1 OR NOT regexp_matches(substr(t, i - 1, 1), '[0-9A-Za-z_]')) AND NOT regexp_matches(substr(t, i + length(name), 1), '[0-9A-Za-z_]')"""
)
def gazetteer_entities(spark, d):
    nation, region = t(spark, d, "nation"), t(spark, d, "region")
    names = nation.select(F.col("n_name").alias("name"), F.lit("GPE").alias("label")).unionByName(region.select(F.col("r_name").alias("name"), F.lit("LOC").alias("label")))
    told = t(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows by the schema
    line = F.concat("c_name", F.lit(" of "), "n_name", F.lit(", "), "r_name", F.lit("; "), "c_mktsegment", F.lit(" in the "), "r_name", F.lit(", not of "), "n_name", F.lit("n"))
    return gazetteer.find_names(told.select("c_custkey", line.alias("text")), names, key="c_custkey")


def _told_places(spark, d):
    """Sentences on customers and suppliers by their rows, the names that gazetteers find there, and whether a place is held out from learning."""
    nation, region = t(spark, d, "nation"), t(spark, d, "region")
    named = lambda c, label: F.struct(F.col(c).alias("name"), F.lit(label).alias("label"))
    # A nation's people and goods are named by its name with an n.
    listed = nation.select(F.explode(F.array(named("n_name", "GPE"), F.struct(F.concat("n_name", F.lit("n")).alias("name"), F.lit("NORP").alias("label")))).alias("x")).unionByName(region.select(named("r_name", "LOC").alias("x"))).select("x.*")
    rows = t(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("key"), F.col("c_name").alias("who"), F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("what"))
    rows = rows.unionByName(t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("key"), F.col("s_name").alias("who"), F.col("s_nationkey").alias("n_nationkey"), F.lit("parts").alias("what")))
    rows = spread(rows)  # sentences are few bytes and much work
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")  # 25 and 5 rows by the schema
    forms = (("{who} of {n_name} sells {what} in the {r_name}.", 0), ("In {r_name}, {n_name}n buyers pay {who} for {what}.", 1), ("{who} left {n_name} for the {r_name} with {what}", 2), ("{what}: no {n_name}n has heard of {who} or seen {n_name}", 3))
    text = F.lit(None).cast("string")
    for form, i in forms:
        pieces = [F.col(p[1:-1]) if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", form) if p]
        text = F.when(F.pmod(F.xxhash64("key"), F.lit(len(forms))) == i, F.concat(*pieces)).otherwise(text)
    docs = rows.join(F.broadcast(places), "n_nationkey").select("key", text.alias("text"), (F.col("n_nationkey") % 5 == 0).alias("held_out"))
    return docs, gazetteer.find_names(docs, listed, key="key")


def _tagged_places(spark, d):
    docs, names = _told_places(spark, d)
    return docs, names, tagger.tag(docs, tagger.train(docs.where("not held_out"), names, key="key"), key="key")


@query()
def names_learnt(spark, d):
    """Every name that the labeller sees, in sentences on places that it learnt from and in others."""
    docs, _, found = _tagged_places(spark, d)
    return found


@query()
def names_learnt_accuracy(spark, d):
    """How many names of held-out nations it finds, by type."""
    docs, names, found = _tagged_places(spark, d)
    held = docs.where("held_out").select("key")
    return tagger.agreement(found.join(held, "key", "left_semi"), names.join(held, "key", "left_semi"), "key")


@query()
def kmeans_clusters(spark, d):
    return kmeans(t(spark, d, "embeddings"), "embedding").select("vec_id", "cluster_id")


#: The test texts hold none of the rules' entities, so a sentence with some goes before each.
ENTITY_TEXT_SQL = "'Dr. Smith of Acme Inc paid $' || doc_id || ' for an AB' || doc_id % 7 || ' on 2024-01-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') || ' at 10:15 and 10:15. ' || text"


def _entity_sql() -> str:
    parts = " UNION ALL ".join(rf"SELECT doc_id, {i} AS rule, '{label}' AS label, unnest(regexp_extract_all(left({ENTITY_TEXT_SQL}, 5000), '({pattern})', 1)) AS entity FROM documents" for i, (label, pattern) in enumerate(ent.RULES))
    common = ", ".join(f"'{w}'" for w in ent.COMMON)
    return f"SELECT DISTINCT doc_id, label, lower(entity) AS entity FROM ({parts}) WHERE length(trim(entity)) >= 2 AND NOT (regexp_full_match(trim(entity), '[0-9]+') AND label IN ('PERSON', 'ORG')) AND lower(trim(entity)) NOT IN ({common})"


def _entities(spark, d):
    text = F.expr(ENTITY_TEXT_SQL.replace("VARCHAR", "STRING"))
    return spread(t(spark, d, "documents").select("doc_id", "text")).select("doc_id", ent.rule_entities(text).alias("entities"))


@query(_entity_sql())
def entity_extract(spark, d):
    return _entities(spark, d).select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.label", F.lower("e.text").alias("entity"))


@query(f"WITH e AS ({_entity_sql()}) SELECT label, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM e), 6) AS share FROM e GROUP BY label")
def entity_distribution(spark, d):
    return ent.entity_shares(_entities(spark, d))


@query(
    """SELECT a.conv_id, a.turn, coalesce(s.text, 'none') AS system, a.text AS user, b.text AS assistant FROM conversations a
    JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant'
    LEFT JOIN conversations s ON a.conv_id = s.conv_id AND s.role = 'system' AND s.turn = a.turn - 1 WHERE a.role = 'user'"""
)
def export_openai(spark, d):
    """Questions with their answers and, where it stands right before, the system text."""
    turns = t(spark, d, "conversations")
    of = lambda role, shift, name: turns.where(F.col("role") == role).select("conv_id", (F.col("turn") + shift).alias("turn"), F.col("text").alias(name))
    pairs = of("user", 0, "input").join(of("assistant", -1, "output"), ["conv_id", "turn"]).join(of("system", 1, "instruction"), ["conv_id", "turn"], "left").fillna({"instruction": "none"})
    return export.chat_examples(pairs, "conv_id", "turn").select("conv_id", "turn", *[F.get("messages", i)["content"].alias(role) for i, role in enumerate(("system", "user", "assistant"))])


@query("SELECT CAST(n AS VARCHAR) AS id, text, doc_id, lang FROM (SELECT doc_id, lang, CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE text END AS text, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) WHERE trim(text) <> ''")
def export_rag(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.col("text")).alias("text"))
    return export.rag_documents(docs, "doc_id").select("id", "text", "metadata.doc_id", "metadata.lang")


@query("""SELECT conv_id, CAST(to_json(list({'turn': turn, 'role': role, 'text': text} ORDER BY turn)) AS VARCHAR) AS turns FROM conversations GROUP BY conv_id""")
def export_csv_cells(spark, d):
    turns = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return export.csv_cells(turns)


@query(r"""SELECT event_id, regexp_extract('note ' || props || ' end', '(?s)\{.*\}') AS json FROM events WHERE contains(props, '{')""")
def json_extract(spark, d):
    text = x.outer_json(F.concat(F.lit("note "), "props", F.lit(" end")))
    return t(spark, d, "events").select("event_id", text.alias("json")).where("json is not null")


#: Answers as a model gives them: text around the object, fields that are missing or null, an unclosed object, none at all.
DESIGN_TEXT = """concat('so: ', CASE WHEN event_id % 7 = 6 THEN 'nothing' ELSE concat('{"dataset_type":"', event_type, '"', CASE WHEN event_id % 7 = 1 THEN '' ELSE ',"tasks":["t"]' END,
    ',"ideal_schema":{"f":"d"},"labeling_strategy":{"type":', CASE WHEN event_id % 7 = 2 THEN 'null' ELSE '"x"' END, ',"labels":["a"]},"optimal_format":"jsonl"', CASE WHEN event_id % 7 = 3 THEN '' ELSE '}' END) END, ' done')"""


@query(
    rf"""SELECT event_id, event_type AS dataset_type, coalesce(json_valid(j) AND json_extract_string(j, '$.dataset_type') IS NOT NULL AND json_type(j, '$.tasks') = 'ARRAY' AND json_type(j, '$.ideal_schema') = 'OBJECT'
    AND json_extract_string(j, '$.labeling_strategy.type') IS NOT NULL AND json_type(j, '$.labeling_strategy.labels') = 'ARRAY' AND json_extract_string(j, '$.optimal_format') IS NOT NULL, false) AS valid
    FROM (SELECT event_id, event_type, CASE WHEN json_valid(o) THEN o END AS j FROM (SELECT *, nullif(regexp_extract({DESIGN_TEXT}, '(?s)\{{.*\}}'), '') AS o FROM events))"""
)
def json_validate(spark, d):
    design = F.expr(DESIGN_TEXT)
    parsed = t(spark, d, "events").select("event_id", "event_type", parse_design(design).alias("r"))
    return parsed.select("event_id", F.coalesce("r.decision.dataset_type", "event_type").alias("dataset_type"), F.col("r.error").isNull().alias("valid"))


@query("SELECT event_id, unnest(map_values(CAST(CAST(props AS JSON) AS MAP(VARCHAR, VARCHAR)))) AS text FROM events")
def folder_values(spark, d):
    return t(spark, d, "events").select("event_id", F.explode(json_values("props")).alias("text"))


@query()
def auto_label(spark, d):
    decision = Decision("qa", ("classification", "ner", "intent", "sentiment", "topic", "clustering"), ("This message is a greeting", "cancel_order", "complaint"))
    done = label(t(spark, d, "conversations"), decision, Models(client=FakeClient()))
    return done.select("conv_id", "turn", "classification.label", F.size("entities").alias("n_entities"), "intent.intent", F.col("sentiment.label").alias("sentiment"), "topic_id", "cluster_id", "qa_pairs", "confidence_score", "needs_review")


#: The i-th task answers the questions whose conversation is i modulo the number of tasks.
PROMPTS_SQL = " ".join(f"WHEN {i} THEN '{task.prompt.replace('{context}', '')}'" for i, task in enumerate(GENERATIVE.values()))
GENERATED_SQL = f"""WITH p AS (SELECT conv_id, turn, replace(CASE conv_id % {len(GENERATIVE)} {PROMPTS_SQL} END, '{{text}}', text) AS prompt FROM conversations)
    SELECT conv_id, turn, 'reply to ' || length(prompt) || ' characters: ' || split_part(regexp_replace(prompt, '^\\s+|\\s+$', '', 'g'), chr(10), 1) AS answer FROM p"""


def _generated(spark, d):
    turns = t(spark, d, "conversations")
    return [(task, generate_column(turns.where(F.col("conv_id") % len(GENERATIVE) == i), task, FakeClient(), out="answer")) for i, task in enumerate(GENERATIVE)]


@query(GENERATED_SQL)
def generated_answers(spark, d):
    """Every generating task, by the deterministic client."""
    return reduce(DataFrame.unionByName, [df.select("conv_id", "turn", "answer") for _, df in _generated(spark, d)])


@query(
    f"""WITH p AS (SELECT conv_id, turn, conv_id % {len(GENERATIVE)} AS i, length(replace(CASE conv_id % {len(GENERATIVE)} {PROMPTS_SQL} END, '{{text}}', text)) AS chars FROM conversations), a AS ({GENERATED_SQL})
    SELECT CASE i {' '.join(f"WHEN {i} THEN '{task}'" for i, task in enumerate(GENERATIVE))} END AS task, count(*) AS calls, CAST(0 AS BIGINT) AS failed, CAST(sum(chars) AS BIGINT) AS prompt_chars, CAST(sum(length(answer)) AS BIGINT) AS answer_chars
    FROM p JOIN a USING (conv_id, turn) GROUP BY i"""
)
def model_usage(spark, d):
    """What the calls of each task came to."""
    return reduce(DataFrame.unionByName, [usage(df, task, out="answer").select(F.lit(task).alias("task"), "*") for task, df in _generated(spark, d)])


def _text_files(spark, d) -> str:
    """A folder with a text file for each document; a new line ends each."""
    return export.text_files(t(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("name"), "text"), scratch(spark))


FILE_TEXT_SQL = r"regexp_replace(coalesce(text, '') || chr(10), '\r\n?', chr(10), 'g')"


@query(f"SELECT 'd' || doc_id AS name, md5({FILE_TEXT_SQL}) AS text_md5 FROM documents")
def files_any_text(spark, d):
    """Every document as a file, read back as text."""
    name = F.regexp_extract("path", r"([^/]*)\.txt$", 1)
    return read_any_text(spark, _text_files(spark, d)).select(name.alias("name"), F.md5("text").alias("text_md5"))


@query(
    rf"""WITH f AS (SELECT doc_id AS n, 'd' || doc_id AS name, coalesce(text, '') || chr(10) AS raw, {FILE_TEXT_SQL} AS text FROM documents), first AS (SELECT raw, min(name || '/') AS name FROM f GROUP BY raw),
    k AS (SELECT f.* FROM f JOIN first ON f.raw = first.raw AND f.name || '/' = first.name WHERE regexp_replace(text, '\s+', '', 'g') <> ''), l AS ({_lang_sql()})
    SELECT 'doc_' || (row_number() OVER (ORDER BY k.name || '/') - 1) AS doc_id, k.name, '.txt' AS format, CAST(octet_length(encode(raw)) AS BIGINT) AS size, detected AS lang,
    CAST(len({WORDS_SQL.format('text')}) AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS char_count FROM k JOIN l ON l.doc_id = k.n"""
)
def files_ingested(spark, d):
    """Every document as a file: scanned, hashed, decoded, deduplicated, and numbered in the order of paths."""
    texts, _ = ingest_texts(scan_files(spark, _text_files(spark, d)))
    docs = with_ids(kept(texts, scratch(spark)))
    return docs.select("doc_id", F.regexp_extract("origin_path", r"([^/]*)\.txt$", 1).alias("name"), "format", "size", "lang", "words", "char_count")


@query("SELECT conv_id, turn, role, text FROM conversations")
def file_jsonl(spark, d):
    """JSON lines, written and read back."""
    turns = t(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return spark.read.schema(turns.schema).json(export.jsonl(turns, scratch(spark)))


@query("SELECT conv_id, turn, role, text FROM conversations")
def file_csv(spark, d):
    """CSV, written and read back."""
    turns = t(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return spark.read.schema(turns.schema).csv(export.csv(turns, scratch(spark)), header=True, multiLine=True, escape='"', emptyValue="")
