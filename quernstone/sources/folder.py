"""Folder text loader: texts, CSV cells, JSON values and XML element texts as rows."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col
from .files import decode, scan_files


def json_values(text: Column | str) -> Column:
    """Values of a JSON object, as texts, in order."""
    return F.map_values(F.from_json(col(text), "map<string,string>"))


def _cells(text: str) -> list[str]:
    """All cells but the header's, column by column; a missing cell is "nan"."""
    header, *rows = list(csv.reader(io.StringIO(text))) or [[]]
    return [(r[i] if i < len(r) and r[i] != "" else "nan") for i in range(len(header)) for r in rows if r]


def _values(text: str) -> list[str]:
    data = json.loads(text)
    items = [x for x in data if isinstance(x, dict)] if isinstance(data, list) else [data] if isinstance(data, dict) else []
    return [str(v) for item in items for v in item.values()]


def _elements(text: str) -> list[str]:
    return [e.text for e in ElementTree.fromstring(text).iter() if e.text]


READERS = {".txt": lambda t: [t], ".csv": _cells, ".json": _values, ".xml": _elements}


def folder_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path, position, text of what a folder's .txt, .csv, .json and .xml files hold (endings in lower case only).

    A file that can't be parsed is left out. For CSV and JSON too large for one row, Spark's own readers are the way.
    """
    ending = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    files = scan_files(spark, folder, None).where(ending.isin(*READERS)).select("path", ending.alias("ending"), decode("content").alias("whole"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, kind, whole in pdf.itertuples(index=False):
                try:
                    texts = READERS[kind](whole)
                except Exception:
                    continue
                yield pd.DataFrame({"path": path, "position": range(len(texts)), "text": texts})

    return files.mapInPandas(read, "path string, position long, text string")
