"""Weighted confidence of a labelled row, and whether a person should review it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip, text_quality

# Weights of the signals, base scores of generated outputs, review threshold.
WEIGHTS = {"classification": 0.30, "intent": 0.25, "sentiment": 0.20, "entities": 0.10, "topic_id": 0.10, "cluster_id": 0.05}
GENERATED = {"summary": 0.72, "chatbot_response": 0.70, "qa_pairs": 0.70, "instruction_format": 0.72, "code_samples": 0.75, "rag_answer": 0.70, "translation": 0.80}
GENERATED_WEIGHT, GENERATED_CHARS = 0.15, 20
REVIEW_BELOW = 0.50
SIGNAL_SHARE, QUALITY_SHARE, NO_SIGNAL_SHARE = 0.85, 0.15, 0.4
UNKNOWN_INTENT_MOST, NO_SCORE, TOPIC_SCORE, CLUSTER_SCORE = 0.3, 0.5, 0.6, 0.65
ENTITY_BASE, ENTITY_STEP, ENTITY_MOST = 0.5, 0.1, 0.95


def confidence(
    text: Column | str,
    classification: Column | None = None,
    intent: Column | None = None,
    intent_name: Column | None = None,
    sentiment: Column | None = None,
    entities: Column | None = None,
    topic: Column | None = None,
    topic_confidence: Column | None = None,
    cluster: Column | None = None,
    generated: dict[str, Column] | None = None,
) -> Column:
    """Score 0 to 1, four digits.

    classification, intent and sentiment are the confidences of these tasks, entities the number found, topic and
    cluster ids; null (or left out) means that the task has not run. generated maps output names to texts.
    """
    signals: list[tuple[Column, Column, float]] = []  # present, score, weight

    def signal(present: Column, score: Column, weight: float) -> None:
        signals.append((present, score, weight))

    if classification is not None:
        signal(classification.isNotNull(), classification, WEIGHTS["classification"])
    if intent is not None:
        name = F.lit(None).cast("string") if intent_name is None else intent_name
        signal(intent.isNotNull(), F.when(name.eqNullSafe("unknown"), F.least(intent, F.lit(UNKNOWN_INTENT_MOST))).otherwise(intent), WEIGHTS["intent"])
    if sentiment is not None:
        signal(sentiment.isNotNull(), sentiment, WEIGHTS["sentiment"])
    if entities is not None:
        signal(entities.isNotNull(), F.least(F.lit(ENTITY_BASE) + entities * F.lit(ENTITY_STEP), F.lit(ENTITY_MOST)), WEIGHTS["entities"])
    if topic is not None:
        signal(topic.isNotNull(), F.coalesce(topic_confidence, F.lit(TOPIC_SCORE)) if topic_confidence is not None else F.lit(TOPIC_SCORE), WEIGHTS["topic_id"])
    if cluster is not None:
        signal(cluster.isNotNull(), F.lit(CLUSTER_SCORE), WEIGHTS["cluster_id"])
    for name, base in GENERATED.items():
        if generated and name in generated:
            signal(F.coalesce(F.length(strip(generated[name])) > GENERATED_CHARS, F.lit(False)), F.lit(base), GENERATED_WEIGHT)

    quality = text_quality(text)
    alone = F.round(quality * NO_SIGNAL_SHARE, 4)
    if not signals:
        return alone
    weight = sum((F.when(p, w).otherwise(0.0) for p, _, w in signals), F.lit(0.0))
    score = sum((F.when(p, F.coalesce(s, F.lit(NO_SCORE)) * w).otherwise(0.0) for p, s, w in signals), F.lit(0.0))
    mixed = score / F.nullif(weight, F.lit(0.0)) * SIGNAL_SHARE + quality * QUALITY_SHARE
    return F.when(weight > 0, F.round(F.greatest(F.least(mixed, F.lit(1.0)), F.lit(0.0)), 4)).otherwise(alone)


def needs_review(score: Column | str) -> Column:
    return F.coalesce(col(score), F.lit(0.0)) < REVIEW_BELOW
