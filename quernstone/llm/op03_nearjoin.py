"""N-gram Jaccard join by chosen paths.

1. A document is its set of hashed word 5-grams. Equal sets are one class (exact and trivially edited copies).
2. Chosen paths: a set is represented by COORDS min-wise sampled tokens. From each node of a tree a set goes
   on to the children of the coordinates that the node's hash chooses, 1 / threshold of them on average, so
   that two sets at the threshold are expected to share one child. A path is computed from the
   set alone, so the split is one pass. Trees are repeated until the recall of a pair at the threshold, which is a sum over
   what its samples can be (`recall`), reaches RECALL at START_DEPTH.
3. Buckets of up to BUCKET sets are brute-forced on the sampled tokens (a loose filter), which leaves clusters within a bucket. A larger
   bucket is first cut into cells of about BUCKET sets, each with the same set, the pivot (one that is like many of the first
   cell), and these are brute-forced. What is linked with the pivot within its cell is in the pivot's class; only pairs with the
   others, the far sets, are open. Up to FAR far
   sets are held against every cell. With more the bucket is split further, up to MAX_DEPTH, and its sets get as
   many more trees as the recall at the next depth asks for.
4. Exact check: in each distinct cluster every pair's Jaccard similarity is computed from the whole sets. Classes are the
   components of these verified links alone.
5. Links are counted, not listed: in classes of three sets or more all pairs are compared in blocks of BLOCK sets,
   so that no task holds a large class. A class of m different near copies costs m * m comparisons but m * m / BLOCK sets moved.

Tokens are compared by 32 bits of their hashes: in a pair with 1,000 tokens some two agree by chance once in 9,000 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from math import comb, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, settled, small, text_of
from .components import components
from .wordhash import U64, Words, mix64, ngrams, text_blocks, words_of

SHINGLE, THRESHOLD = 5, 0.8
COORDS, START_DEPTH, MAX_DEPTH, BUCKET, FAR, BLOCK = 64, 2, 6, 256, 4096, 512
#: Share of the pairs at the threshold that are to be found; pairs above it are found more surely.
RECALL = 0.999
#: Share of equal sampled tokens from which a pair of a small bucket is a candidate: over 4 deviations below 0.8.
LOOSE = 0.58
_ROWS = 1 << 15  # rows of a block of texts
_FACTOR = mix64(np.arange(1, COORDS + 1, dtype=U64)) | U64(1)
_SALT = mix64(np.arange(1001, 1001 + COORDS, dtype=U64))
_TOKENS = 48  # bits of a token within a block


def token_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(first, token): the distinct word n-grams of each text; a shorter text is one token, all its words."""
    n = len(words.first) - 1
    counts = words.counts()
    grams, at = ngrams(words, size)
    text = [np.searchsorted(words.first, at, side="right") - 1]
    token = [grams]
    for short in range(size):
        own = np.flatnonzero(counts == short)
        gram = np.full(len(own), short, dtype=U64)
        for i in range(short):
            gram = gram * U64(0xD6E8FEB86659FD93) + words.hashes[words.first[own] + i]
        text.append(own)
        token.append(mix64(gram))
    keyed = np.unique((np.concatenate(text).astype(U64) << U64(_TOKENS)) | (np.concatenate(token) >> U64(64 - _TOKENS)))
    first = np.searchsorted(keyed, np.arange(n + 1, dtype=U64) << U64(_TOKENS))
    return first, mix64(keyed & U64((1 << _TOKENS) - 1))


def sketch(first: np.ndarray, token: np.ndarray) -> np.ndarray:
    """COORDS min-wise samples of each set, as uint32."""
    out = np.empty((len(first) - 1, COORDS), dtype=np.uint32)
    for k in range(COORDS):
        out[:, k] = np.minimum.reduceat((token ^ _SALT[k]) * _FACTOR[k], first[:-1]) >> U64(32)
    return out


_PRINTS = "n int, k1 long, k2 long, sketch binary, tokens binary"


def fingerprints(docs: DataFrame) -> DataFrame:
    """From doc, text (lower-cased): size and 128-bit digest of each set, its samples, its tokens (32 bits each)."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), _ROWS):
                batch = whole.slice(at, _ROWS)
                for a, b, data, offsets in text_blocks(batch.column(1)):
                    first, token = token_sets(words_of(data, offsets))
                    samples, short = sketch(first, token), (token >> U64(32)).astype(np.uint32)
                    k1, k2 = (np.add.reduceat(mix64(token ^ U64(s)), first[:-1]).astype(np.int64) for s in (0x1357, 0x2468ACE))
                    columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(first), pa.int32()), pa.array(k1), pa.array(k2)]
                    columns += [pa.array([x.tobytes() for x in samples], pa.binary()), pa.array([short[i:j].tobytes() for i, j in pairwise(first)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "k1", "k2", "sketch", "tokens"])

    return docs.mapInArrow(prints, f"doc {docs.schema['doc'].dataType.simpleString()}, {_PRINTS}")


def _samples(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), COORDS)


def recall(similarity: float, runs: int, depth: int, threshold: float = THRESHOLD, loose: float = LOOSE) -> float:
    """The chance that a pair shares a node at `depth` in one of `runs` trees and passes the filter.

    A sampled token is shared with the chance `similarity`. Given the number of shared ones, the nodes that a pair shares
    are a branching process with the tree's number of children.
    """
    sure, more = floor(1 / threshold), 1 / threshold % 1
    total = 0.0
    for shared in range(int(np.ceil(loose * COORDS)), COORDS + 1):
        died = 0.0
        for _ in range(depth):
            child = 1 - shared / COORDS * (1 - died)
            died = child**sure * (1 - more + more * child)
        total += comb(COORDS, shared) * similarity**shared * (1 - similarity) ** (COORDS - shared) * (1 - died**runs)
    return total


def runs_for(depth: int, threshold: float = THRESHOLD, target: float = RECALL) -> int:
    """The fewest trees with which a pair at the threshold is found with a chance of `target`."""
    runs = 1
    while recall(threshold, runs, depth, threshold) < target:
        runs += 1
        if runs > 1000:
            raise ValueError("the filter alone loses more than the recall allows")
    return runs


def _choose(row: np.ndarray, path: np.ndarray, samples: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """One level down: for each (row, path) the children (row, path) of the coordinates that the path's hash chooses.

    Every node chooses the same number but for the fraction of 1 / threshold, so that few pairs are lost by chance.
    """
    drawn = mix64(path ^ U64(0xC0FFEE))
    count = np.full(len(path), floor(1 / threshold)) + ((drawn >> U64(32)) < U64(int((1 / threshold % 1) * (1 << 32))))
    at = np.repeat(np.arange(len(path)), count)
    turn = (np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)).astype(U64)
    step = (drawn[at] >> U64(6)) | U64(1)  # odd: no coordinate twice
    i = ((drawn[at] + turn * step) % U64(COORDS)).astype(np.int64)
    return row[at], mix64(path[at] + mix64(samples[row[at], i].astype(U64) + _SALT[i]))


def _paths(sets: DataFrame, runs: range, depth: int, threshold: float) -> DataFrame:
    """key, rep for each node at `depth` that a set (rep, sketch) reaches in each of these trees."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, samples = batch.column(0).to_numpy(), _samples(batch.column(1))
            for run in runs:
                row, path = np.arange(len(reps)), np.full(len(reps), mix64(np.array([run + 1], dtype=U64))[0])
                for _ in range(depth):
                    row, path = _choose(row, path, samples, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(path.astype(np.int64)), pa.array(reps[row])], names=["key", "rep"])

    return sets.select("rep", "sketch").mapInArrow(walk, "key long, rep long")


def _deeper(nodes: DataFrame, threshold: float) -> DataFrame:
    """key, rep of the children of nodes (key, rep, sketch)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column(1).to_numpy()
            row, path = _choose(np.arange(len(reps)), batch.column(0).to_numpy().astype(U64), _samples(batch.column(2)), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(path.astype(np.int64)), pa.array(reps[row])], names=["key", "rep"])

    return nodes.select("key", "rep", "sketch").mapInArrow(walk, "key long, rep long")


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows that agree in their first `keys` columns, as one batch for each such group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for a, b in pairwise([0, *change.tolist(), batch.num_rows]):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield _joined(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n members the first that it is connected with by the pairs a, b."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, label[side], least)
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _clusters(cells: DataFrame, loose: float) -> DataFrame:
    """cluster, rep, asks, own: sets of a cell (key, rep, asks, own, sketch) that pairs with at least `loose` equal samples connect, clusters of two or more.

    Only pairs of a set that asks with one of the cell's own are looked at. The same sets have the same cluster in whatever cell they meet.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["cluster", "rep", "asks", "own"])

        for group in groups_of(batches, 1):
            if len(group) < 2:
                continue
            reps, samples = group.column(1).to_numpy(), _samples(group.column(4))
            asks, own = (group.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            if len(reps) == 2:
                label = np.zeros(2, np.int64) if (samples[0] == samples[1]).mean() >= loose else np.arange(2)
            else:
                owned, least = np.flatnonzero(own), int(np.ceil(loose * COORDS))
                theirs = samples[owned]
                hits = [(i, owned[np.count_nonzero(theirs == samples[i], axis=1) >= least]) for i in np.flatnonzero(asks)]
                label = forest(len(reps), np.repeat([i for i, _ in hits], [len(h) for _, h in hits]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *(h for _, h in hits)]))
            for first in np.flatnonzero(np.bincount(label, minlength=len(reps)) > 1):
                at = np.flatnonzero(label == first)
                marks = mix64(reps[at].astype(U64) * U64(4) + asks[at].astype(U64) * U64(2) + own[at].astype(U64))
                out.append((np.full(len(at), marks.sum(dtype=U64).astype(np.int64)), reps[at], asks[at], own[at]))
            if len(out) >= 4096:
                yield made()
                out = []
        if out:
            yield made()

    return cells.select("key", "rep", "asks", "own", "sketch").repartition("key").sortWithinPartitions("key").mapInArrow(found, "cluster long, rep long, asks boolean, own boolean")


def _verified(clusters: DataFrame, tokens: DataFrame, threshold: float) -> DataFrame:
    """cluster, a, b: for each set a of a cluster in a table (cluster, rep, asks, own) the least b with which it is linked, if not itself: by a similarity of the whole sets of at least threshold, or by way of others."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 1):
            reps, sets = group.column(1).to_numpy(), _tokens_of(group.column(4))
            asks, own = (np.flatnonzero(group.column(i).to_numpy(zero_copy_only=False)) for i in (2, 3))
            if not len(asks) or not len(own):
                continue
            every = len(asks) == len(own) == len(reps)
            pairs = [(np.full(len(hits), asks[i]), own[hits]) for i, hits in similar_pairs([sets[x] for x in asks], None if every else [sets[x] for x in own], threshold)]
            label = forest(len(reps), *(np.concatenate(x) for x in zip(*pairs)))
            other = np.flatnonzero(label != np.arange(len(label)))
            if len(other):
                yield pa.RecordBatch.from_arrays([group.column(0).slice(0, len(other)), pa.array(reps[other]), pa.array(reps[label[other]])], names=["cluster", "a", "b"])

    rows = small(clusters).join(tokens, "rep").select("cluster", "rep", "asks", "own", "tokens")
    return rows.repartition("cluster").sortWithinPartitions("cluster", "rep").mapInArrow(compare, "cluster long, a long, b long")


def _tokens_of(column: pa.Array) -> list[np.ndarray]:
    return [np.unique(np.frombuffer(x, dtype=np.uint32)) for x in column.to_pylist()]


def _central(cells: DataFrame, threshold: float) -> DataFrame:
    """key, pivot: of the sets of each bucket (key, rep, sketch), few enough for a task, one that is like most others."""

    def central(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 1):
            samples = _samples(group.column(2))
            alike = [((samples == x).mean(axis=1) >= threshold).sum() for x in samples]
            yield pa.RecordBatch.from_arrays([group.column(i).slice(int(np.argmax(alike)), 1) for i in (0, 1)], names=["key", "pivot"])

    return cells.select("key", "rep", "sketch").repartition("key").sortWithinPartitions("key", "rep").mapInArrow(central, "key long, pivot long")


def _of(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows (rep, ...) of these sets, as a table: what is joined with it moves no others."""
    return cut(rows.join(small(cut(reps.select("rep").distinct())), "rep", "left_semi"))


def candidates(sets: DataFrame, tokens: DataFrame, threshold: float = THRESHOLD, target: float = RECALL) -> DataFrame:
    """cluster, rep, asks, own: clusters of sets (rep, sketch) that chosen paths bring together; their links connect what is linked. tokens: rep, tokens."""
    samples = sets.select("rep", "sketch")
    clusters: list[DataFrame] = []

    def counted(rows: DataFrame) -> DataFrame:
        rows = cut(rows)
        many = cut(rows.groupBy("key").count().where("count > 1"))  # a table, so that a hot key's rows can be split in the join
        return cut(rows.join(many, "key"))

    def settle(nodes: DataFrame, last: bool) -> DataFrame | None:
        """Adds the clusters of nodes (key, rep, count). Returns those that need a further split, if any (none if last)."""
        both = {"asks": F.lit(True), "own": F.lit(True)}
        clusters.append(cut(_clusters(nodes.where(F.col("count") <= BUCKET).join(samples, "rep").withColumns(both), LOOSE)))
        large = nodes.where(F.col("count") > BUCKET)
        if large.isEmpty():
            return None
        n_cells = F.ceil(F.col("count") / BUCKET).cast("int")
        cell = F.pmod(F.xxhash64("rep"), n_cells).cast("int")

        def celled(rows: DataFrame, everywhere: Column, asks: Column, own: Column) -> DataFrame:
            """Clusters of the cells of rows, some of which go to every cell; asks and own may look at `at`, the cell."""
            cells = F.when(everywhere, F.sequence(F.lit(0), n_cells - 1)).otherwise(F.array(cell))
            dealt = rows.withColumn("at", F.explode(cells)).select(F.xxhash64("key", "at").alias("key"), "rep", asks.alias("asks"), own.alias("own"))
            return cut(_clusters(dealt.join(hot, "rep"), LOOSE))

        hot = _of(samples, large)
        pivots = cut(_central(large.where(cell == 0).join(hot, "rep"), threshold))
        large = large.join(pivots, "key", "left").withColumn("pivot", F.coalesce("pivot", F.lit(-1)))  # -1: no set in the first cell
        stars = celled(large, F.col("rep") == F.col("pivot"), **both)
        clusters.append(stars)
        edges = cut(_verified(cut(stars.distinct()), _of(tokens, stars), threshold))
        label = edges.select("cluster", F.col("a").alias("rep"), F.col("b").alias("label")).unionByName(edges.select("cluster", F.col("b").alias("rep"), F.col("b").alias("label")).distinct())
        own = label.join(cut(pivots.select(F.col("pivot").alias("rep")).distinct()), "rep").withColumnRenamed("rep", "pivot")
        near = cut(label.join(own, ["cluster", "label"]).select("pivot", "rep", F.lit(True).alias("near")).distinct())
        marked = cut(large.join(near, ["pivot", "rep"], "left").select("key", "rep", "count", (F.col("near").isNull() & (F.col("rep") != F.col("pivot"))).alias("far")))
        farness = cut(marked.groupBy("key").agg(F.count_if("far").alias("n_far")).where("n_far > 0"))
        marked = marked.join(farness, "key")
        clusters.append(celled(marked if last else marked.where(F.col("n_far") <= FAR), F.col("far"), F.col("far"), F.col("at") == cell))
        deeper = marked.where(F.col("n_far") > FAR)
        return None if last or farness.where(F.col("n_far") > FAR).isEmpty() else deeper.select("key", "rep")

    depth, runs = START_DEPTH, runs_for(START_DEPTH, threshold, target)
    nodes = counted(_paths(samples, range(runs), depth, threshold))
    while (large := settle(nodes, depth == MAX_DEPTH)) is not None:
        depth, done, runs = depth + 1, runs, max(runs, runs_for(depth + 1, threshold, target))
        hot = samples.join(cut(large.select("rep").distinct()), "rep")
        nodes = counted(_deeper(large.join(samples, "rep"), threshold).unionByName(_paths(hot, range(done, runs), depth, threshold)))
    found = clusters[0]
    for c in clusters[1:]:
        found = found.unionByName(c)
    return found.distinct()


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of `left` the sets of `right` (None: later ones of left) at the threshold, by exact Jaccard similarity."""
    other = left if right is None else right
    sizes = np.array([len(x) for x in other])
    ends = np.cumsum(sizes)
    vocabulary, flat = np.unique(np.concatenate([*other, *(left if right is not None else [])]), return_inverse=True)
    own = np.split(flat[ends[-1] :], np.cumsum([len(x) for x in left])[:-1]) if right is not None else np.split(flat, ends[:-1])
    flat, starts = flat[: ends[-1]], ends - sizes
    flag = np.zeros(len(vocabulary), dtype=bool)
    sums = np.zeros(len(flat) + 1, dtype=np.int32)
    for i, mine in enumerate(own):
        flag[mine] = True
        np.cumsum(flag[flat], out=sums[1:])
        flag[mine] = False
        common = sums[ends] - sums[starts]
        hit = common >= threshold * (len(mine) + sizes - common) - 1e-9
        if right is None:
            hit[: i + 1] = False
        yield i, np.flatnonzero(hit)


def _counted(pairs: DataFrame, threshold: float) -> DataFrame:
    """rep, near from rows (g, p, q, side, sets), the sets (rep, weight, tokens) of a block of class g that meets another: rep is linked with sets of weight near."""

    def compare(group: pa.Table) -> pa.Table:
        blocks = [x.flatten() for _, x in sorted((side, group.column("sets").combine_chunks().slice(i, 1)) for i, side in enumerate(group.column("side").to_pylist()))]
        if group.column("p")[0].as_py() != group.column("q")[0].as_py() and len(blocks) < 2:
            blocks = []  # the other block got no set
        reps, weights = ([x.field(name).to_numpy() for x in blocks] for name in ("rep", "weight"))
        tokens = [_tokens_of(x.field("tokens")) for x in blocks]
        linked = [np.zeros(len(x), dtype=np.int64) for x in reps]
        for i, hits in similar_pairs(tokens[0], tokens[1] if len(blocks) > 1 else None, threshold) if blocks else ():
            linked[0][i] += weights[-1][hits].sum()
            linked[-1][hits] += weights[0][i]
        none = np.zeros(0, np.int64)
        return pa.table({"rep": np.concatenate([none, *reps]), "near": np.concatenate([none, *linked])})

    return pairs.groupBy("g", "p", "q").applyInArrow(compare, "rep long, near long")


def near_join(docs: DataFrame, threshold: float = THRESHOLD, target: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id, links, copies for each row of docs.

    class_id is the smallest key among all documents connected by links (similarity of word 5-gram sets of
    at least threshold); links counts the other documents linked with this one, copies those with the same set.
    A text of under five words is one token, all its words; null and empty texts and those
    without words have the same set. Rows that are repeated count one by one. Keys may be of any type with an order; null ones come
    last, and a class of null keys only has the class_id null. Other columns are ignored; no rows give no rows.
    """
    lower = docs.select(F.col(key).alias("doc"), F.lower(text_of(text)).alias("text"))
    prints = cut(fingerprints(lower).withColumn("row", F.monotonically_increasing_id()))
    best = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row", "sketch")).alias("best")
    classes = cut(prints.groupBy("k1", "k2", "n").agg(best, F.count("*").alias("weight")).select("k1", "k2", "n", "weight", F.col("best.doc").alias("doc"), F.col("best.row").alias("rep"), F.col("best.sketch").alias("sketch")))
    tokens = prints.select(F.col("row").alias("rep"), "tokens")
    clusters = settled(lambda: candidates(classes, tokens, threshold, target))
    tokens = _of(tokens, clusters)
    links = settled(lambda: _verified(clusters, tokens, threshold).select("a", "b"))
    group = settled(lambda: components(links))

    sizes = cut(group.groupBy("label").agg(F.count("*").alias("sets")))
    weights = classes.select("rep", "weight")
    # Two sets are linked with each other; more are compared in blocks, each pair of blocks by itself.
    dealt = group.join(sizes, "label").where("sets > 2").withColumn("blocks", F.ceil(F.col("sets") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
    members = small(cut(dealt.withColumnRenamed("vertex", "rep").join(weights, "rep"))).join(tokens, "rep")
    blocks = cut(members.groupBy("label", "own", "blocks").agg(F.collect_list(F.struct("rep", "weight", "tokens")).alias("sets")))  # about BLOCK sets each
    paired = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.col("label").alias("g"), F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.col("own").alias("side"), "sets")
    counted = _counted(paired, threshold)
    two = group.join(sizes.where("sets = 2"), "label").join(weights.withColumnRenamed("rep", "vertex"), "vertex")
    partner = two.groupBy("label").agg(F.sum("weight").alias("both"))
    twos = two.join(partner, "label").select(F.col("vertex").alias("rep"), (F.col("both") - F.col("weight")).alias("near"))

    near = counted.unionByName(twos).groupBy("rep").agg(F.sum("near").alias("near"))
    linked = cut(near.join(group.select(F.col("vertex").alias("rep"), "label"), "rep").join(classes.select("rep", "doc"), "rep"))
    lowest = linked.groupBy("label").agg(F.min("doc").alias("class_doc"))
    classed = linked.join(lowest, "label").select("rep", "near", "class_doc")
    named = classes.select("k1", "k2", "n", "weight", "rep", F.col("doc").alias("rep_doc")).join(classed, "rep", "left")
    joined = prints.select("doc", "k1", "k2", "n").join(named, ["k1", "k2", "n"])
    return joined.select(
        F.col("doc").alias(key),
        F.coalesce("class_doc", "rep_doc").alias("class_id"),
        (F.coalesce("near", F.lit(0)) + F.col("weight") - 1).alias("links"),
        (F.col("weight") - 1).alias("copies"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, target: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without near copies: of each class the document with the smallest key stays.

    Rows that repeat a key stay or go together; rows with a null key stay if their class has no other key.
    """
    classes = near_join(docs, threshold, target, key, text)
    gone = cut(classes.groupBy(F.col(key).alias("gone key")).agg(F.max(F.col(key).eqNullSafe(F.col("class_id"))).alias("stays")).where(~F.col("stays")).select("gone key"))
    return docs.join(small(gone), docs[key].eqNullSafe(gone["gone key"]), "left_anti")
