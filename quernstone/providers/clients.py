"""Language-model clients: an interface, fallback between two, partition-wise generation, a fake for tests."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..logs import logger

# Default models, token limits and time limit.
PRIMARY_MODEL, FALLBACK_MODEL = "llama-3.1-8b-instant", "claude-haiku-4-5-20251001"
PRIMARY_URL, FALLBACK_URL = "https://api.groq.com/openai/v1", "https://api.anthropic.com/v1"
PRIMARY_KEY, FALLBACK_KEY, MESSAGES_VERSION = "GROQ_API_KEY", "ANTHROPIC_API_KEY", "2023-06-01"
FALLBACK_TOKENS, TASK_TOKENS, TIMEOUT_S = 2048, 512, 30


class Client(Protocol):
    def generate(self, prompt: str, system: str = "") -> str: ...


@dataclass(frozen=True)
class HttpClient:
    """Chat completions over HTTP in the common JSON form. The key comes from an environment variable, on the worker."""

    url: str
    model: str = PRIMARY_MODEL
    key_variable: str = PRIMARY_KEY
    max_tokens: int = TASK_TOKENS
    temperature: float = 0.0
    json_mode: bool = False

    def generate(self, prompt: str, system: str = "") -> str:
        messages = [*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": prompt}]
        body = {"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens}
        if self.json_mode:
            body["response_format"] = {"type": "json_object"}
        return _post(f"{self.url}/chat/completions", body, {"Authorization": f"Bearer {os.environ[self.key_variable]}"})["choices"][0]["message"]["content"]


@dataclass(frozen=True)
class MessagesClient:
    """The other common form: the system text stands apart, and a token limit is required."""

    url: str = FALLBACK_URL
    model: str = FALLBACK_MODEL
    key_variable: str = FALLBACK_KEY
    max_tokens: int = FALLBACK_TOKENS
    temperature: float = 0.0

    def generate(self, prompt: str, system: str = "") -> str:
        body = {"model": self.model, "max_tokens": self.max_tokens, "temperature": self.temperature, "messages": [{"role": "user", "content": prompt}]}
        if system:
            body["system"] = system
        return _post(f"{self.url}/messages", body, {"x-api-key": os.environ[self.key_variable], "anthropic-version": MESSAGES_VERSION})["content"][0]["text"]


def _post(url: str, body: dict, headers: dict[str, str]) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {**headers, "Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=TIMEOUT_S) as reply:
        return json.load(reply)


@dataclass(frozen=True)
class WithFallback:
    """The first client, else the second. Both failing is a RuntimeError, no usable client a ValueError."""

    primary: Client | None
    fallback: Client | None = None

    def generate(self, prompt: str, system: str = "") -> str:
        if self.primary:
            try:
                return self.primary.generate(prompt, system)
            except Exception as e:
                logger.warning("the primary model failed: %s", e)
                if not self.fallback:
                    raise ValueError("the primary model failed and there is no fallback") from e
        if not self.fallback:
            raise ValueError("no model client is configured")
        try:
            return self.fallback.generate(prompt, system)
        except Exception as e:
            raise RuntimeError("no model client could answer") from e


def default_client() -> WithFallback:
    """Both models, each if its key is in the environment. The primary answers in JSON."""
    primary = HttpClient(PRIMARY_URL, json_mode=True) if os.environ.get(PRIMARY_KEY) else None
    return WithFallback(primary, MessagesClient() if os.environ.get(FALLBACK_KEY) else None)


@dataclass(frozen=True)
class FakeClient:
    """A deterministic client: a reply that may name the prompt's length and first line."""

    reply: str = "reply to {chars} characters: {line}"

    def generate(self, prompt: str, system: str = "") -> str:
        return self.reply.replace("{chars}", str(len(prompt))).replace("{line}", prompt.strip().split("\n")[0])


@dataclass(frozen=True)
class Task:
    output: str
    prompt: str


#: By dataset type: the output column and the prompt.
GENERATIVE = {
    "resume": Task("summary", "Write a summary of the following text.\n{text}"),
    "chatbot_training": Task("chatbot_response", "Answer the user as a helpful chatbot.\nUser: {text}"),
    "qa": Task("qa_pairs", "Write questions with answers that the following text gives.\n{text}"),
    "instruction_tuning": Task("instruction_format", "Rewrite the following as an example for instruction tuning.\n{text}"),
    "code_dataset": Task("code_samples", "Write code samples with explanations for the following.\n{text}"),
    "rag": Task("rag_answer", "Context:\n{context}\n\nQuestion:\n{text}\n\nAnswer from the context."),
}


def usage(df: DataFrame, task: str, text: str = "text", out: str | None = None, context: str = "") -> DataFrame:
    """One row on the calls behind a generated column: calls, failed, prompt_chars, answer_chars.

    Taken from the rows themselves, so repeated tasks count once.
    """
    answer = F.col(out or GENERATIVE[task].output)
    return df.agg(
        F.count("*").alias("calls"),
        F.count(F.when(answer.isNull(), 1)).alias("failed"),
        F.coalesce(F.sum(F.length(rendered(task, text, context))), F.lit(0)).alias("prompt_chars"),
        F.coalesce(F.sum(F.length(answer)), F.lit(0)).alias("answer_chars"),
    )


def rendered(task: str, text: str = "text", context: str = "") -> Column:
    """The prompt of each row, as `render` makes it."""
    before, after = GENERATIVE[task].prompt.replace("{context}", context).split("{text}")
    return F.concat(F.lit(before), F.coalesce(text, F.lit("")), F.lit(after))


def render(task: str, text: str, context: str = "") -> str:
    return GENERATIVE[task].prompt.replace("{context}", context).replace("{text}", text)


def generate_column(df: DataFrame, task: str, client: Client, text: str = "text", out: str | None = None, context: str = "") -> DataFrame:
    """df with the client's answers, a partition at a time; a failing call gives null, so one row can't end the job."""

    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            replies = []
            for t in texts:
                try:
                    replies.append(client.generate(render(task, t or "", context)))
                except Exception:
                    replies.append(None)
            yield pd.Series(replies, dtype=object)

    answers.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out or GENERATIVE[task].output, F.pandas_udf(answers, "string")(F.col(text)))
