"""Dataset design: a profile becomes a prompt, the answer a validated schema; and the dataset's README."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col, outer_json
from .clients import Client

# Fields of a design.
DESIGN = "dataset_type string, tasks array<string>, ideal_schema map<string,string>, labeling_strategy struct<type:string,labels:array<string>>, optimal_format string"

SYSTEM = """You design NLP training datasets. You are given a corpus profile. Decide on the dataset type,
the tasks to train, the fields of a training sample, how to label it, and the storage format. Reply with a JSON object only:
{"dataset_type": string, "tasks": [string], "ideal_schema": {field: description},
"labeling_strategy": {"type": string, "labels": [string]}, "optimal_format": string}"""


def design_prompt(profile: dict) -> str:
    return f"Corpus profile:\n{json.dumps(profile, indent=2, ensure_ascii=False)}\n\nReply with the JSON object."


def parse_design(raw: Column | str) -> Column:
    """struct(decision, error): the JSON between the outermost braces if it has all required fields, else what is wrong."""
    text = outer_json(raw)
    parsed = F.from_json(text, DESIGN)
    required = (parsed["dataset_type"], parsed["tasks"], parsed["ideal_schema"], parsed["labeling_strategy"]["type"], parsed["labeling_strategy"]["labels"], parsed["optimal_format"])
    complete = F.lit(True)
    for field in required:
        complete = complete & field.isNotNull()
    error = F.when(text.isNull(), F.concat(F.lit("no JSON object in: "), F.coalesce(col(raw), F.lit("")))).when(~complete, F.concat(F.lit("not a complete design: "), text))
    return F.struct(F.when(error.isNull(), parsed).alias("decision"), error.alias("error"))


def design(spark: SparkSession, profile: DataFrame, client: Client) -> dict:
    """The design for a one-row profile, as a dict. A bad answer is a ValueError with the raw text."""
    answer = client.generate(design_prompt(json.loads(profile.limit(1).toJSON().first())), SYSTEM)
    row = spark.createDataFrame([(answer,)], "raw string").select(parse_design("raw").alias("r")).first()["r"]
    if row["error"]:
        raise ValueError(row["error"])
    return row["decision"].asDict(recursive=True)


def readme(profile: dict, decision: dict | None = None, client: Client | None = None) -> str:
    """Markdown documentation of a dataset: from a template, or from a client if there is one."""
    decision = decision or {}
    languages = profile.get("language_distribution") or {}
    facts = [
        "# NLP Dataset Report",
        "## Dataset Type\n" + str(decision.get("dataset_type") or profile.get("probable_dataset_type")),
        "## Tasks\n" + "\n".join(f"- {t}" for t in decision.get("tasks", ()) or ["none stated"]),
        "## Languages\n" + "\n".join(f"- {k}: {v}" for k, v in sorted(languages.items())),
        "## Dataset Structure\n" + "\n".join(f"- `{k}`: {v}" for k, v in (decision.get("ideal_schema") or {"text": "document text"}).items()),
        "## Classes\n" + "\n".join(f"- {x}" for x in (decision.get("labeling_strategy") or {}).get("labels", ()) or profile.get("topics_detected", ())),
        f"## Usage\nStored as {decision.get('optimal_format', 'jsonl')}; {profile.get('total_documents')} documents.",
        "## Training Example\n```json\n" + json.dumps({k: "..." for k in decision.get("ideal_schema") or {"text": ""}}, ensure_ascii=False) + "\n```",
        f"## Quality Score\nNoise ratio {profile.get('avg_noise_ratio')}.",
    ]
    text = "\n\n".join(facts) + "\n"
    return client.generate("Improve this dataset documentation; reply with Markdown only.\n" + text) if client else text
