"""Line dedup over range-partitioned line hashes.

A row (hash, document, positions) stands for the lines of a document that share a key. Rows are
range-partitioned by hash and document, so a line of a third of all documents is spread over many
partitions, and sorted by hash and document. Each partition streams: it counts the documents of a
hash and knows its first occurrence, holding back fewer than min_docs rows. Only hashes on partition
borders, two for each partition, can be undecided; a table of partial counts settles them. What comes
back for a document is a compressed bitmap of the lines to keep; texts are read again only to apply it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import cut, settled, shuffles, text_of

#: What is stripped from both ends of a line to get its key.
BLANKS = b" \t\n\x0b\x0c\r"
_ROWS = 1 << 15
_LINES = "doc long, twin long, h1 long, h2 long, lines array<int>"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
_NAMES = ["doc", "twin", "h1", "h2", "lines"]


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip(BLANKS).lower() for line in text.split(b"\n")]


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """From doc, twin, text: a row for each document and line key of at least min_chars code points."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES)], names=_NAMES)

        out: list[list] = [[] for _ in _NAMES]
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            for doc, twin, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                at: dict[bytes, list[int]] = {}
                for i, line in enumerate(line_keys(value.as_py())):
                    if len(line) >= min_chars and (min_chars <= 1 or len(line.decode()) >= min_chars):
                        at.setdefault(line, []).append(i)
                for line, where in at.items():
                    digest = xxhash.xxh3_128_intdigest(line)
                    for column, x in zip(out, (doc, twin, (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63), where)):
                        column.append(x)
                if len(out[0]) >= _ROWS:
                    yield made()
                    out = [[] for _ in _NAMES]
        yield made()

    return docs.select("doc", "twin", "text").mapInArrow(rows, _LINES)


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash and document: those to drop (state 0), those that the table of borders decides
    (1: enough documents? 2: is there an earlier partition?) and the border counts themselves (3)."""
    empty = pa.RecordBatch.from_arrays([pa.array([], t) for t in _TYPES], names=_NAMES)
    held, opened, first_hash, seen = empty, None, None, 0  # opened: hash whose rows went out before; seen: their documents

    def told(rows: pa.RecordBatch, state: int) -> pa.RecordBatch:
        return rows.append_column("state", pa.array(np.full(len(rows), state, dtype=np.int32))).append_column("n", pa.array(np.zeros(len(rows), dtype=np.int64)))

    def border(h: tuple[int, int], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, *h, None, 3, n), [*_TYPES, pa.int32(), pa.int64()])], names=[*_NAMES, "state", "n"])

    def without_first(rows: pa.RecordBatch, at: list[int]) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        """Rows less the first line of those at `at`, and these first lines as rows."""
        lines = rows.column(4).to_pylist()
        heads = [[lines[i][0]] for i in at]
        for i in at:
            lines[i] = lines[i][1:]
        return pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(lines, _TYPES[4])], names=_NAMES), pa.RecordBatch.from_arrays([*[c.take(pa.array(at, pa.int64())) for c in rows.columns[:4]], pa.array(heads, _TYPES[4])], names=_NAMES)

    def ended(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        nonlocal held, opened, first_hash, seen
        last = batch is None
        rows = pa.Table.from_batches([held, *([] if last else [batch])]).combine_chunks()
        rows = rows.to_batches()[0] if len(rows) else empty
        if not len(rows):
            if last and opened is not None:
                yield border(opened, seen)
            return
        doc, twin, h1, h2 = (rows.column(i).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False) for i in range(4))
        group = np.ones(len(rows), dtype=bool)
        group[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        fresh = group.copy()
        fresh[1:] |= (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1])
        starts = np.flatnonzero(group)
        counts = np.add.reduceat(fresh.astype(np.int64), starts)
        hash_of = lambda i: (int(h1[starts[i]]), int(h2[starts[i]]))
        goes_on = opened is not None and hash_of(0) == opened
        if opened is not None and not goes_on and opened == first_hash:
            yield border(opened, seen)
        if first_hash is None:
            first_hash = hash_of(0)
        if goes_on:
            counts[0] += seen
        sizes = np.diff(np.append(starts, len(rows)))
        enough = counts >= min_docs
        complete = np.ones(len(starts), dtype=bool)
        if not last and not enough[-1]:
            complete[-1] = False
        edge = np.array([hash_of(0) == first_hash, *[False] * (len(starts) - 1)])
        edge[-1] |= last
        at_edge = np.repeat(edge, sizes)
        dropped, pending = np.repeat(enough & complete, sizes), np.repeat(~enough & complete & edge, sizes)
        heads = starts if not goes_on else starts[1:]
        for state, chosen in ((0, dropped), (1, pending)):
            picked = np.flatnonzero(chosen)
            if not len(picked):
                continue
            part = rows.take(pa.array(picked))
            if keep_first:
                at = np.flatnonzero(np.isin(picked, heads))
                part, first = without_first(part, at.tolist())
                unsure = np.flatnonzero(at_edge[picked[at]])  # an earlier partition may hold the true first
                if len(unsure):
                    yield told(first.take(pa.array(unsure)), 2)
            yield told(part, state)
        for i in {0, len(starts) - 1}:
            if edge[i] and complete[i] and (i < len(starts) - 1 or last):
                yield border(hash_of(i), int(counts[i]))
        if complete[-1] and not last:
            held, opened, seen = empty, hash_of(-1), int(counts[-1])
        elif not last:
            held = rows.slice(starts[-1])
            if not (goes_on and len(starts) == 1):
                opened, seen = None, 0

    for batch in batches:
        if len(batch):
            yield from ended(batch)
    yield from ended(None)


def keep_bitmaps(docs: DataFrame, min_docs: int, min_chars: int, keep_first: bool = False) -> DataFrame:
    """From doc, twin, text: doc, twin, bitmap for each document that loses lines.

    The bitmap is zlib-compressed, a bit for each line up to the last one dropped, 1 to keep.
    """
    rows = line_rows(docs, min_chars)
    dealt = rows.repartitionByRange(shuffles(docs.sparkSession), "h1", "h2", "doc", "twin").sortWithinPartitions("h1", "h2", "doc", "twin")
    told = cut(dealt.mapInArrow(lambda it: _stream(it, min_docs, keep_first), _LINES + ", state int, n long").withColumn("part", F.spark_partition_id()))
    borders = told.where("state = 3").groupBy("h1", "h2").agg(F.sum("n").alias("total"), F.min("part").alias("begins"))  # two rows a partition at most
    open_rows = told.where("state in (1, 2)").join(F.broadcast(borders), ["h1", "h2"])
    settled = open_rows.where((F.col("total") >= min_docs) & ((F.col("state") == 1) | (F.col("begins") < F.col("part"))))
    gone = told.where("state = 0").select("doc", "twin", "lines").unionByName(settled.select("doc", "twin", "lines")).where(F.size("lines") > 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for lines in batch.column(2).to_pylist():
                bits = np.ones(max(lines) + 1, dtype=bool)
                bits[lines] = False
                packed.append(zlib.compress(np.packbits(bits).tobytes() + bytes([len(bits) % 8])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary())], names=["doc", "twin", "bitmap"])

    return gone.groupBy("doc", "twin").agg(F.flatten(F.collect_list("lines")).alias("lines")).mapInArrow(pack, "doc long, twin long, bitmap binary")


def unpack(bitmap: bytes) -> list[bool]:
    raw = zlib.decompress(bitmap)
    bits = np.unpackbits(np.frombuffer(raw[:-1], dtype=np.uint8)).astype(bool)
    return bits[: len(bits) - (8 - raw[-1] if raw[-1] else 0)].tolist()


def kept_lines(text: bytes, bitmap: bytes | None) -> tuple[list[bytes], int, int]:
    """Lines that stay, number of lines, number dropped."""
    lines = text.split(b"\n")
    if bitmap is None:
        return lines, len(lines), 0
    keep = unpack(bitmap)
    kept = [*compress(lines, keep), *lines[len(keep) :]]
    return kept, len(lines), len(lines) - len(kept)


def line_dedup(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep_first: bool = False, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """key, n_lines, n_dropped, kept_sha256 (and the kept text) for each row of docs.

    A line's key is the line stripped of blanks at both ends, A to Z lower-cased. Keys of min_chars code
    points or more that occur in min_docs documents or more lose their lines: all, or all but the first by
    key of the document and position. Null or empty text is one empty line. Rows that repeat key and text
    are one document and get the same result; rows that share a key but not the text are apart.
    Null keys are a value like others. Keys other than whole numbers stand in the order of their hashes. Other columns are ignored; no rows give no rows.
    """
    kind = docs.select(key).schema[0].dataType
    doc = F.col(key).cast("long") if isinstance(kind, IntegralType) else F.when(F.col(key).isNotNull(), F.xxhash64(key))
    named = docs.select(F.col(key).alias("key"), doc.alias("doc"), F.xxhash64(text_of(text)).alias("twin"), text_of(text).alias("text"))
    bitmaps = settled(lambda: keep_bitmaps(named, min_docs, min_chars, keep_first)).toDF("b_doc", "b_twin", "bitmap")
    joined = named.join(bitmaps, named["doc"].eqNullSafe(bitmaps["b_doc"]) & (named["twin"] == bitmaps["b_twin"]), "left").select("key", "text", "bitmap")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digests, texts = [], [], [], []
            for value, bitmap in zip(batch.column(1).cast(pa.large_binary()), batch.column(2)):
                kept, lines, dropped = kept_lines(value.as_py(), bitmap.as_py())
                joined_text = b"\n".join(kept)
                n.append(lines)
                gone.append(dropped)
                digests.append(hashlib.sha256(joined_text).hexdigest())
                if with_text:
                    texts.append(joined_text.decode())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), *([pa.array(texts, pa.string())] if with_text else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_lines", "n_dropped", "kept_sha256", "text"][: len(columns)])

    schema = f"key {kind.simpleString()}, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * with_text
    return joined.mapInArrow(apply, schema).withColumnRenamed("key", key)
