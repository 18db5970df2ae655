"""Labelling: one plan whose columns are chosen by the tasks at hand, then confidence and review flag."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.confidence import GENERATED, confidence, needs_review
from ..functions.text import star_sentiment
from ..providers import models
from ..providers.answers import answered
from ..providers.clients import GENERATIVE, Client, generate_column
from .clustering import kmeans
from .entities import rule_entities
from .similarity import classify, detect_intent

#: Fewest rows for which a batch is clustered or given topics.
CLUSTER_ROWS, TOPIC_ROWS = 2, 10


@dataclass(frozen=True)
class Decision:
    """What to label. tasks: classification, ner, intent, sentiment, topic, clustering."""

    dataset_type: str = ""
    tasks: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    context: str = ""
    language: str = "en"

    @staticmethod
    def from_brain(decision: dict) -> Decision:
        """From a validated design: labels may be nested, and vocabulary differ in case or name."""
        names = {"summarization": "resume", "named_entity_recognition": "ner", "question_answering": "qa"}
        known = lambda x: names.get(str(x).lower(), str(x).lower())
        labels = decision.get("labels") or (decision.get("labeling_strategy") or {}).get("labels") or ()
        return Decision(known(decision.get("dataset_type", "")), tuple(map(known, decision.get("tasks", ()))), tuple(labels), decision.get("context", ""), decision.get("language", "en"))


@dataclass(frozen=True)
class Models:
    """Plug-ins: columns from a text column; the client writes generated outputs, each once if there is a `store` of answers (then with `<output>_error`)."""

    embedding: object = models.embedding
    embed: object = models.embed
    entities: object = rule_entities
    stars: object = models.star_rating
    translate: object = models.untranslated
    client: Client | None = field(default=None)
    store: str | None = None
    model: str = ""


def label(df: DataFrame, decision: Decision, plugins: Models = Models(), text: str = "text") -> DataFrame:
    """df with the columns that the decision asks for, confidence_score and needs_review.

    An empty df gives an empty result. Translation is on its own: no other task runs.
    """
    signals: dict = {}
    generated: dict = {}
    if decision.dataset_type == "translation":
        df = df.withColumn("translation", plugins.translate(text))
        generated["translation"] = F.col("translation")
    else:
        if "classification" in decision.tasks and decision.labels:
            df = classify(df, list(decision.labels), text, embed_column=plugins.embedding, embed_text=plugins.embed)
            signals["classification"] = F.col("classification.confidence")
        if "ner" in decision.tasks:
            df = df.withColumn("entities", plugins.entities(text))
            signals["entities"] = F.size("entities")
        if "intent" in decision.tasks:
            df = detect_intent(df, text, embed_column=plugins.embedding, embed_text=plugins.embed)
            signals |= {"intent": F.col("intent.confidence"), "intent_name": F.col("intent.intent")}
        if "sentiment" in decision.tasks:
            df = df.withColumn("_stars", plugins.stars(text)).withColumn("sentiment", F.struct(star_sentiment("_stars.label").alias("label"), F.col("_stars.score").alias("score"))).drop("_stars")
            signals["sentiment"] = F.col("sentiment.score")
        if {"topic", "clustering"} & {*decision.tasks}:
            rows = df.count()
            df = df.withColumn("_vector", plugins.embedding(text))
            for task, out, least, signal in (("topic", "topic_id", TOPIC_ROWS, "topic"), ("clustering", "cluster_id", CLUSTER_ROWS, "cluster")):
                if task in decision.tasks:
                    # Both are the same clusters of the same vectors: the second is not learnt again.
                    same = out == "cluster_id" and "topic" in decision.tasks and rows >= TOPIC_ROWS
                    df = df.withColumn(out, F.col("topic_id")) if same else kmeans(df, "_vector", out=out) if rows >= least else df.withColumn(out, F.lit(None).cast("int"))
                    signals[signal] = F.col(out)
            df = df.drop("_vector")
        if decision.dataset_type in GENERATIVE and plugins.client:
            out = GENERATIVE[decision.dataset_type].output
            if plugins.store:
                df = answered(df, decision.dataset_type, plugins.client, plugins.store, plugins.model, text, out, decision.context)
            else:
                df = generate_column(df, decision.dataset_type, plugins.client, text, out, decision.context)
            generated[out] = F.col(out)
    scored = df.withColumn("confidence_score", confidence(text, generated={k: v for k, v in generated.items() if k in GENERATED}, **signals))
    return scored.withColumn("needs_review", needs_review("confidence_score"))
