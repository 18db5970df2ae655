"""Entities by name: all names of given tables found in one pass over whole texts (Aho-Corasick automaton).

The automaton is built once for each block of names and broadcast; a table of names of more than BLOCK_BYTES is taken in blocks,
each of which reads the texts once. A name counts where neither end lies within a word; case is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .entities import DESCRIPTIONS

#: Bytes of names that an automaton holds (some 50 times as many in memory).
BLOCK_BYTES = 4 << 20
_FOUND = "array<struct<start:int,name:string,label:string>>"


def _lower(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def automaton(names: list[tuple[str, str]]) -> ahocorasick.Automaton:
    """Of (name, label) pairs; a name with several labels is found with each."""
    labels: dict[str, set[str]] = {}
    for name, label in names:
        labels.setdefault(_lower(name), set()).add(label)
    made = ahocorasick.Automaton()
    for name, own in labels.items():
        made.add_word(name, (len(name), sorted(own)))
    made.make_automaton()
    return made


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def occurrences(text: str, names: ahocorasick.Automaton) -> list[tuple[int, str, str]]:
    """(start, text there, label) of every name, overlapping ones too, by place and then length."""
    found = []
    for last, (size, labels) in names.iter(_lower(text)):
        start, end = last + 1 - size, last + 1
        if (start and _word(text[start - 1]) and _word(text[start])) or (end < len(text) and _word(text[end]) and _word(text[last])):
            continue
        found += [(start, text[start:end], label) for label in labels]
    return sorted(found, key=lambda x: (x[0], len(x[1]), x[2]))


def find_names(docs: DataFrame, names: DataFrame, name: str = "name", label: str = "label", text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, text, label, description, start, end, source: a row for each place of a name in each row of docs.

    start and end count characters from 0. Null or empty names, and names without a label, are no names; null and empty texts hold none; rows
    and names that repeat give their places once for each row and once for each different name.
    """
    listed = names.where(F.col(name).isNotNull() & (F.col(name) != "") & F.col(label).isNotNull()).select(F.col(name).cast("string").alias("name"), F.col(label).cast("string").alias("label")).distinct()
    size = listed.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()

    def search(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = held.value
            for batch in batches:
                rows = [[{"start": s, "name": n, "label": x} for s, n, x in occurrences(t.as_py(), known)] for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.struct({"start": pa.int32(), "name": pa.string(), "label": pa.string()})))], names=["key", "found"])

        return slim.mapInArrow(run, f"key {kind}, found {_FOUND}")

    parts = []
    for i in range(blocks):
        block = listed.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == i).orderBy("name", "label").collect()  # about block_bytes
        if block:
            parts.append(search(docs.sparkSession.sparkContext.broadcast(automaton([tuple(r) for r in block]))))
    if not parts:
        parts = [slim.select("key", F.array().cast(_FOUND).alias("found"))]
    hits = reduce(DataFrame.unionByName, parts).select("key", F.explode("found").alias("f"))
    known = F.create_map(*[F.lit(x) for pair in DESCRIPTIONS.items() for x in pair])
    return hits.select(F.col("key").alias(key), F.col("f.name").alias("text"), "f.label", F.coalesce(F.try_element_at(known, F.col("f.label")), F.col("f.label")).alias("description"), "f.start", (F.col("f.start") + F.length("f.name")).alias("end"), F.lit("gazetteer").alias("source"))
