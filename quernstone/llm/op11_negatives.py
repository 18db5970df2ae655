"""Hard-negative mining by norm-bucketed search.

Candidates are sorted by norm, longest first, and searched in buckets for blocks of anchors. By
Cauchy-Schwarz no row of a bucket scores more than the anchor's norm times the longest norm of the bucket; a bucket is
passed over for each window whose lower limit, or whose k-th best score so far, lies above that.

Each search runs twice: over one row in SEED_SHARE, whose k-th scores are limits that the search of
the rest starts with. So a task of the rest gives back few rows, however many tasks there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffles

#: Bytes of the anchors that are broadcast at once; candidates are read once for each block of anchors and search.
BLOCK_BYTES = 8 << 20
#: Rows of a bucket, windows compared with a bucket at once, and the share of rows searched first.
BUCKET, WINDOWS, SEED_SHARE = 2048, 1024, 16
#: Squared norms up to which every inner product is exact in doubles.
MOST = float(1 << 53)
_NONE = np.iinfo(np.int64).max


@dataclass
class Searches:
    """What is sought for a block of anchors: a window is an anchor and limits of the score, lower and upper."""

    anchor: np.ndarray  # number of the anchor below
    slot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    row: np.ndarray  # of the anchors
    label: np.ndarray
    norm: np.ndarray
    vectors: np.ndarray
    same: bool  # whether rows of the anchor's label are sought, or those of others
    k: int


def scaled(vectors: DataFrame, key: str, label: Column, vector: str, anchor: Column, scale: int) -> DataFrame:
    """row, id, label, anchor, vec (integers), norm: the rows that take part."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = vectors.where(F.col(key).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & finite)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), whole.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return rows.withColumn("square", square).where(F.col("square") <= MOST).select("row", "id", "label", "anchor", F.col("v").cast("array<int>").alias("vec"), F.sqrt("square").alias("norm"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """A row for each vector; shorter ones end in zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    wide = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), wide))
    out[np.arange(wide) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def bucket_search(searches: Searches, batches: Iterator[pa.RecordBatch], bucket: int = BUCKET) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids) of the k best rows of each window, ties by id, and how many comparisons of a window with a bucket were made.

    batches: row, id, label, vec, norm, the longest norms first (their order changes the time only).
    """
    k, owner = searches.k, searches.anchor
    scores, ids = np.full((len(owner), k), -np.inf), np.full((len(owner), k), _NONE)
    made = 0
    for batch in batches:
        row, key, label, norm = (batch.column(n).to_numpy() for n in ("row", "id", "label", "norm"))
        vectors = _matrix(batch.column("vec"))
        width = min(vectors.shape[1], searches.vectors.shape[1])
        for a in range(0, len(row), bucket):
            need = np.maximum(searches.low, scores[:, k - 1])
            bound = searches.norm[owner] * norm[a : a + bucket].max() * (1 + 1e-9)
            alive = np.flatnonzero((bound >= need) & (searches.low <= searches.high))
            made += len(alive)
            inside = a + np.argsort(key[a : a + bucket], kind="stable")  # the first of equal scores has the smallest id
            block = vectors[inside, :width].T
            for b in range(0, len(alive), WINDOWS):
                own = alive[b : b + WINDOWS]
                which, at = np.unique(owner[own], return_inverse=True)
                found = searches.vectors[which, :width] @ block
                right = (label[inside] == searches.label[which, None]) == searches.same
                right &= row[inside] != searches.row[which, None]
                found = np.where(right, found, -np.inf)[at]
                found[(found < need[own, None]) | (found > searches.high[own, None])] = -np.inf
                hit = np.flatnonzero(found.max(axis=1, initial=-np.inf) > -np.inf)
                if not len(hit):
                    continue
                found, own, line = found[hit], own[hit], np.arange(len(hit))
                new_scores, new_ids = [scores[own]], [ids[own]]
                for _ in range(min(k, found.shape[1])):
                    best = found.argmax(axis=1)
                    value = found[line, best]
                    new_scores.append(value[:, None])
                    new_ids.append(np.where(value > -np.inf, key[inside][best], _NONE)[:, None])
                    found[line, best] = -np.inf
                both, who = np.hstack(new_scores), np.hstack(new_ids)
                order = np.lexsort((who, -both), axis=-1)[:, :k]
                scores[own], ids[own] = np.take_along_axis(both, order, 1), np.take_along_axis(who, order, 1)
    return scores, ids, made


def _search(rows: DataFrame, searches: Searches) -> DataFrame:
    """anchor_row, slot, id, score: the k best rows of each window that each task has found."""
    shared = rows.sparkSession.sparkContext.broadcast(searches)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = shared.value
        scores, ids, _ = bucket_search(searches, batches)
        window, turn = np.nonzero(scores > -np.inf)
        found = [searches.row[searches.anchor[window]], searches.slot[window], ids[window, turn], scores[window, turn].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["anchor_row", "slot", "id", "score"])

    return rows.select("row", "id", "label", "norm", "vec").mapInArrow(search, "anchor_row long, slot long, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", turn).where(F.col("rank") <= k)


def _searched(seeds: DataFrame, rest: DataFrame, searches: Searches) -> DataFrame:
    """anchor_row, slot, id, score, rank from 1 to k, of all rows."""
    first = cut(_best(_search(seeds, searches), searches.k))
    # At most one number for each window of the block.
    kth = first.where(F.col("rank") == searches.k).select("anchor_row", "slot", "score").toArrow()
    place = {(r, s): v for r, s, v in zip(*(c.to_pylist() for c in kth.columns))}
    reached = np.array([place.get(w, -np.inf) for w in zip(searches.row[searches.anchor].tolist(), searches.slot.tolist())], dtype=float)
    later = Searches(**(vars(searches) | {"low": np.maximum(searches.low, reached)}))
    return _best(first.drop("rank").unionByName(_search(rest, later)), searches.k)


def hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column | str = "label", key: str = "vec_id", vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    The score of two rows is the inner product of their vectors times `scale`, rounded down. An anchor (a row for
    which `anchor` is true) has as positives the `positives` best other rows of its label, and for each of them the
    `negatives` best rows of other labels that score from low to high hundredths of the positive; ties go by the smaller key.
    Positives and windows without such rows have none.

    Rows with a null key, label or vector, a null or non-finite component, or a squared norm over 2**53 after scaling (whose
    scores a double can't tell) take no part. Rows that repeat a key are rows of their own; a vector shorter than
    another counts as ending in zeros; other columns are ignored. Without rows or anchors the result is empty.
    Keys and labels must be integers.
    """
    label = F.col(label) if isinstance(label, str) else label
    spark = vectors.sparkSession
    rows = cut(scaled(vectors, key, label, vector, anchor, scale).repartition(shuffles(spark), "row").sortWithinPartitions(F.desc("norm"), "row"))
    early = F.pmod(F.xxhash64("row"), F.lit(SEED_SHARE)) == 0
    seeds, rest = rows.where(early), rows.where(~early)
    anchors = rows.where("anchor")
    size = anchors.agg(F.sum(F.size("vec") * 8 + 64)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    results = []
    for i in range(blocks):
        # About BLOCK_BYTES, and `positives` numbers for each of its anchors.
        held = anchors.where(F.pmod(F.xxhash64("id", "row"), F.lit(blocks)) == i).select("row", "id", "label", "norm", "vec").toArrow().sort_by([("norm", "descending"), ("row", "ascending")])
        row, ids, labels, norm = (held[n].to_numpy() for n in ("row", "id", "label", "norm"))
        all_rows = np.arange(len(row))
        found = Searches(all_rows, np.zeros_like(all_rows), np.full(len(row), -np.inf), np.full(len(row), np.inf), row, labels, norm, _matrix(held["vec"]), True, positives)
        near = _searched(seeds, rest, found).select("anchor_row", "rank", "id", "score").toArrow()
        number = dict(zip(row.tolist(), all_rows.tolist()))
        at = np.array([number[r] for r in near["anchor_row"].to_pylist()], dtype=np.int64)
        score = near["score"].to_numpy()
        windows = Searches(**(vars(found) | {"anchor": at, "slot": near["rank"].to_numpy().astype(np.int64), "low": -(-score * low // 100).astype(float), "high": (score * high // 100).astype(float), "same": False, "k": negatives}))
        told = pa.table({"anchor_row": near["anchor_row"], "slot": near["rank"].cast(pa.int64()), "anchor_id": pa.array(ids[at], pa.int64()), "positive_id": near["id"], "positive_score": near["score"]})
        pairs = spark.createDataFrame(told, "anchor_row long, slot long, anchor_id long, positive_id long, positive_score long")
        results.append(cut(_searched(seeds, rest, windows).join(F.broadcast(pairs), ["anchor_row", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
    return reduce(DataFrame.unionByName, results)
