"""Exemplar similarity: intents, domains, zero-shot classes.

The exemplar side is a fixed or stated small set, so it travels as a literal array in the plan: no join, and
no row for each pair; the best is found within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer

from ..functions.text import blank, clean_label, col, head
from ..functions.vectors import cosines, dot
from ..providers.models import embed, embedding

# Intents with their examples, the threshold, and domains with their word templates.
INTENT_THRESHOLD = 0.55
INTENTS = {
    "cancel_order": ("I want to cancel my order", "Please cancel order 123", "Je veux annuler ma commande", "Annuler ma commande", "Stop my purchase", "Cancel it immediately"),
    "refund_request": ("I want a refund", "Give me my money back", "Je veux un remboursement", "Refund my payment", "Return my money"),
    "complaint": ("I am not satisfied", "This product is terrible", "Je ne suis pas satisfait", "Very bad service", "I am unhappy with this"),
    "greeting": ("Hello", "Hi there", "Bonjour", "Good morning", "Hey"),
    "order_status": ("Where is my order?", "Track my order", "Has my package been shipped?", "Où est ma commande ?", "Is my order delivered?"),
}
DOMAINS = {
    "news": "politics world breaking news government",
    "resume": "experience skills education cv career",
    "email": "hello regards email message reply",
    "finance": "bank loan credit investment money",
    "medical": "patient diagnosis treatment hospital",
}
CLASSIFY_CHARS = 512


def best_exemplar(vector: Column | str, exemplars: dict[str, list[list[float]]], threshold: float = INTENT_THRESHOLD, names: str = "intent") -> Column:
    """struct(<names>, confidence): the name whose nearest exemplar is most similar (cosine; ties: first declared).

    Below the threshold the name is "unknown" and the confidence is not rounded, else four digits.
    """
    every = cosines(vector, [v for vectors in exemplars.values() for v in vectors])

    def nearest(name: str, start: int, n: int, turn: int) -> Column:
        return F.struct(F.array_max(F.slice(every, start + 1, n)).alias("s"), F.lit(-turn).alias("turn"), F.lit(name).alias("name"))

    sizes = [len(vectors) for vectors in exemplars.values()]
    best = F.array_max(F.array(*[nearest(name, sum(sizes[:i]), sizes[i], i) for i, name in enumerate(exemplars)]))
    sure = best["s"] >= threshold
    return F.struct(F.when(sure, best["name"]).otherwise("unknown").alias(names), F.when(sure, F.round(best["s"], 4)).otherwise(best["s"]).alias("confidence"))


def exemplar_table(exemplars: DataFrame, name: str, vector: str, limit: int = 1000) -> dict[str, list[list[float]]]:
    """Exemplars from a table, by name; at most `limit` rows, else it stops: they are meant to be a stated set."""
    rows = exemplars.select(F.col(name).cast("string").alias("name"), F.col(vector).cast("array<double>").alias("v")).orderBy(name).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} exemplars; join them as a table instead")
    found: dict[str, list[list[float]]] = {}
    for r in rows:
        found.setdefault(r["name"], []).append(list(r["v"]))
    return found


def detect_intent(df: DataFrame, text: str = "text", out: str = "intent", embed_column=embedding, embed_text=embed, threshold: float = INTENT_THRESHOLD) -> DataFrame:
    """df with struct(intent, confidence); blank text is unknown with 0."""
    exemplars = {name: [list(embed_text(e)) for e in examples] for name, examples in INTENTS.items()}
    none = F.struct(F.lit("unknown").alias("intent"), F.lit(0.0).alias("confidence"))
    named = df.withColumn("_vector", embed_column(text))
    return named.withColumn(out, F.when(blank(text), none).otherwise(best_exemplar("_vector", exemplars, threshold))).drop("_vector")


def mean_vector(df: DataFrame, vector: str) -> DataFrame:
    """One row: vector, the element-wise mean, by partial sums."""
    from pyspark.ml.functions import vector_to_array

    return df.where(F.col(vector).isNotNull()).agg(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("m")).select(vector_to_array("m").alias(vector))


def best_domain(centroid: DataFrame, vector: str, templates: dict[str, list[float]]) -> DataFrame:
    """One row: domain, score: the template with the largest dot product; ties: first declared."""
    scored = F.array(*[F.struct(dot(vector, F.array(*[F.lit(float(x)) for x in v])).alias("s"), F.lit(-i).alias("turn"), F.lit(name).alias("name")) for i, (name, v) in enumerate(templates.items())])
    best = F.array_max(scored)
    return centroid.select(best["name"].alias("domain"), F.round(best["s"], 6).alias("score"))


def detect_domain(df: DataFrame, text: str = "text", embed_column=embedding, embed_text=embed) -> DataFrame:
    centroid = mean_vector(df.select(embed_column(text).alias("v")), "v")
    return best_domain(centroid, "v", {name: list(embed_text(t)) for name, t in DOMAINS.items()})


def classify(df: DataFrame, labels: list[str], text: str = "text", out: str = "classification", embed_column=embedding, embed_text=embed, sharpness: float = 10.0) -> DataFrame:
    """df with struct(label, confidence, all_scores): similarity of the text's head to each cleaned label, as a softmax.

    Labels that are equal when cleaned share a score, the last one's name counting. Blank text: the first label with 0; no labels: unknown.
    """
    if not labels:
        empty = F.struct(F.lit("unknown").alias("label"), F.lit(0.0).alias("confidence"), F.create_map().cast("map<string,double>").alias("all_scores"))
        return df.withColumn(out, empty)
    spark = SparkSession.active()
    cleaned = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, label string").orderBy("i").select(clean_label("label")).collect()]
    original = dict(zip(cleaned, labels))
    near = cosines("_vector", [list(embed_text(c)) for c in original])
    scored = F.array(*[F.struct(F.exp(F.lit(sharpness) * F.get(near, F.lit(i))).alias("s"), F.lit(-i).alias("turn"), F.lit(o).alias("label")) for i, o in enumerate(original.values())])
    named = df.withColumn("_vector", embed_column(head(text, CLASSIFY_CHARS))).withColumn("_scores", scored)
    total = F.aggregate("_scores", F.lit(0.0), lambda a, x: a + x["s"])
    named = named.withColumn("_total", total)
    best = F.array_max("_scores")
    full = F.struct(
        best["label"].alias("label"),
        F.round(best["s"] / F.col("_total"), 4).alias("confidence"),
        F.map_from_entries(F.transform("_scores", lambda x: F.struct(x["label"], F.round(x["s"] / F.col("_total"), 4)))).alias("all_scores"),
    )
    none = F.struct(F.lit(labels[0]).alias("label"), F.lit(0.0).alias("confidence"), F.create_map().cast("map<string,double>").alias("all_scores"))
    return named.withColumn(out, F.when(blank(text), none).otherwise(full)).drop("_vector", "_scores", "_total")
