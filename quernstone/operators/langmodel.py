"""Language detection learnt from labelled texts: character trigrams with Witten-Bell back-off.

A text is its letters in lower case, other characters being one blank. The probability of a letter after two others is
mixed from trigram, bigram and letter counts of a language; what a language has seen less of falls back further. Learning is a
count of n-grams, which each task adds up for itself first; detection looks the trigrams of a whole text up in the model's tables, which are
broadcast, and adds logarithms. Models of more than BROADCAST_GRAMS trigrams are joined instead. Any number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col
from ..session import cut, small, spread

UNKNOWN = "unknown"
#: Trigrams of a model (with a number for each language) that are broadcast, and letters that a task looks up at once.
BROADCAST_GRAMS, LETTERS = 500_000, 1_000_000
#: What isn't a letter of the basic plane.
_BREAKS = r"[^\p{L}]+|[\x{10000}-\x{10FFFF}]+"


def letters(text: Column | str) -> Column:
    """Words of letters between single blanks, with one at either end; a text without letters is one blank."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), _BREAKS, " "), " +", " "))
    return F.when(plain == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), plain, F.lit(" ")))


def trigrams(text: Column | str) -> Column:
    return F.regexp_extract_all(letters(text), F.lit("(?=(...))"), F.lit(1))


def _codes(strings: pa.Array) -> np.ndarray:
    """Code points of all strings of an array, one after the other."""
    return np.frombuffer("".join(strings.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)


def _grams(letters: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, trigrams) of an array of letters(): a trigram is a number of three times 16 bits."""
    codes, sizes = _codes(letters), pc.utf8_length(letters).to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    for i in range(0, max(0, len(codes) - 2), LETTERS):
        a, own = codes[i : i + LETTERS + 2], row[i : i + LETTERS + 2]
        whole = own[:-2] == own[2:]
        yield own[:-2][whole], (a[:-2] << 32 | a[1:-1] << 16 | a[2:])[whole]


def _counted(docs: DataFrame) -> DataFrame:
    """language, gram, n of rows of language, letters: sums of a task's batches, to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            turn = names.indices.to_numpy().astype(np.int64)
            parts = [np.unique(turn[row] << 48 | gram, return_counts=True) for row, gram in _grams(batch.column(1))]
            if not parts:
                continue
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)
            points = np.stack([keys >> 32 & 0xFFFF, keys >> 16 & 0xFFFF, keys & 0xFFFF], 1).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(keys >> 48)), pa.array(points.view("<U3").ravel().tolist(), pa.string()), pa.array(n)], names=["language", "gram", "n"])

    return docs.mapInArrow(run, "language string, gram string, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))


@dataclass
class LanguageModel:
    """Tables of gram and logs (an array with the logarithm for each language): of a letter after two (`three`) and after one (`two`), and alone (`one`),
    and of what a context of two (`after_two`) or one (`after_one`) leaves to the shorter one."""

    languages: list[str]
    three: DataFrame
    two: DataFrame
    one: DataFrame
    after_two: DataFrame
    after_one: DataFrame
    floor: list[float]


def _spread(rows: DataFrame, languages: list[str], gram: str, value: str, default: list[Column]) -> DataFrame:
    """rows of language and gram as one row a gram, with an array over the languages."""
    firsts = [F.max(F.when(F.col("language") == name, F.col(value))) for name in languages]
    return rows.groupBy(F.col(gram).alias("gram")).agg(F.array(*[F.coalesce(x, d) for x, d in zip(firsts, default)]).alias("logs"))


def train(docs: DataFrame, text: str = "text", language: str = "lang") -> LanguageModel:
    """A model of the languages named in `language`; rows without one, or without letters, teach nothing.

    The tables have a row for each n-gram seen, whatever the number of texts.
    """
    known = docs.where(F.col(language).isNotNull()).select(F.col(language).cast("string").alias("language"), letters(text).alias("letters"))
    counted = cut(_counted(spread(known)))
    languages = sorted(r[0] for r in counted.select("language").distinct().collect())
    a, b, c = (F.substring("gram", i, 1) for i in (1, 2, 3))
    three = counted.select("language", "gram", "n", F.concat(a, b).alias("ab"), F.concat(b, c).alias("bc"))
    two = three.groupBy("language", F.col("bc").alias("gram")).agg(F.sum("n").alias("n")).select("*", F.substring("gram", 1, 1).alias("b"), F.substring("gram", 2, 1).alias("c"))
    one = two.groupBy("language", F.col("c").alias("gram")).agg(F.sum("n").alias("n"))
    total = one.groupBy("language").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    # Of a context: how often it was seen, and what share of it goes to shorter contexts.
    left = lambda rows, by: rows.groupBy("language", F.col(by).alias("context")).agg((F.count("*") / (F.sum("n") + F.count("*"))).alias("left"), (F.sum("n") + F.count("*")).alias("of"))
    one = one.join(F.broadcast(total), "language").withColumn("p", (F.col("n") + 1) / (F.col("all") + F.col("kinds") + 1))
    after_one, after_two = left(two, "b"), left(three, "ab")
    two = two.join(after_one.withColumnRenamed("context", "b"), ["language", "b"]).join(one.select("language", F.col("gram").alias("c"), F.col("p").alias("short")), ["language", "c"])
    two = cut(two.select("language", "gram", "b", "c", (F.col("n") / F.col("of") + F.col("left") * F.col("short")).alias("p")))
    three = three.join(after_two.withColumnRenamed("context", "ab"), ["language", "ab"]).join(two.select("language", F.col("gram").alias("bc"), F.col("p").alias("short")), ["language", "bc"])
    three = three.select("language", "gram", "ab", "bc", F.log(F.col("n") / F.col("of") + F.col("left") * F.col("short")).alias("p"))
    floors = {r["language"]: r["p"] for r in total.select("language", (-F.log(F.col("all") + F.col("kinds") + 1)).alias("p")).collect()}
    floor = [floors[name] for name in languages]
    nothing = [F.lit(0.0)] * len(languages)
    lit = [F.lit(x) for x in floor]
    one_logs = cut(_spread(one.withColumn("p", F.log("p")), languages, "gram", "p", lit))
    after_one_logs = cut(_spread(after_one.withColumn("left", F.log("left")), languages, "context", "left", nothing))
    after_two_logs = cut(_spread(after_two.withColumn("left", F.log("left")), languages, "context", "left", nothing))
    # A gram that one language has seen gets its fallen-back value in the others.
    def filled(rows: DataFrame, context: DataFrame, shorter: DataFrame, first: Column, rest: Column) -> DataFrame:
        seen = _spread(rows, languages, "gram", "p", [F.lit(None).cast("double")] * len(languages)).select("*", first.alias("first"), rest.alias("rest"))
        down = seen.join(context.select(F.col("gram").alias("first"), F.col("logs").alias("left")), "first").join(shorter.select(F.col("gram").alias("rest"), F.col("logs").alias("short")), "rest")
        return cut(down.select("gram", F.transform("logs", lambda x, i: F.coalesce(x, F.get("left", i) + F.get("short", i))).alias("logs")))

    two_logs = filled(two.withColumn("p", F.log("p")), after_one_logs, one_logs, F.substring("gram", 1, 1), F.substring("gram", 2, 1))
    three_logs = filled(three, after_two_logs, two_logs, F.substring("gram", 1, 2), F.substring("gram", 2, 2))
    return LanguageModel(languages, three_logs, two_logs, one_logs, after_two_logs, after_one_logs, floor)


def detect(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "detected") -> DataFrame:
    """docs with `out`, the likeliest language of the whole text, and `<out>_log`, its mean logarithm a letter.

    Ties go to the first name; a text without letters, or a model without languages, is "unknown" with null. Repeated rows stay.
    """
    if {out, f"{out}_log"} & set(docs.columns):
        raise ValueError(f"{out} is a column already")
    if not model.languages:
        return docs.withColumns({out: F.lit(UNKNOWN), f"{out}_log": F.lit(None).cast("double")})
    if model.three.count() > BROADCAST_GRAMS:
        return _detect_joined(docs, model, text, out)
    tables = [_Logs.of(table) for table in (model.three, model.after_two, model.two, model.after_one, model.one)]
    held = docs.sparkSession.sparkContext.broadcast((tables, np.array(model.floor)))
    packed = spread(docs).select(F.struct(*docs.columns).alias("row"), letters(text).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (three, after_two, two, after_one, one), floor = held.value

        def logs(gram: np.ndarray) -> np.ndarray:
            at = three.find(gram)
            found = three.logs[at]
            rare = np.flatnonzero(at < 0)  # only trigrams that no language has seen look into the shorter tables
            if len(rare):
                ab, bc, b, c = gram[rare] >> 16, gram[rare] & 0xFFFFFFFF, gram[rare] >> 16 & 0xFFFF, gram[rare] & 0xFFFF
                found[rare] = after_two.get(ab, 0.0) + two.get(bc, after_one.get(b, 0.0) + one.get(c, floor))
            return found

        for batch in batches:
            sums, n = np.zeros((batch.num_rows, len(floor))), np.zeros(batch.num_rows, np.int64)
            for row, gram in _grams(batch.column(1)):
                if len(row):
                    starts = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
                    sums[row[starts]] += np.add.reduceat(logs(gram), starts)
                    n += np.bincount(row, minlength=len(n))
            best, none = sums.argmax(axis=1), n == 0
            mean = sums[np.arange(len(n)), best] / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32), mask=none), pa.array(mean, mask=none)], names=["row", "best", "log"])

    told = packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("best", T.IntegerType()), T.StructField("log", T.DoubleType())]))
    name = F.get(F.array(*[F.lit(x) for x in model.languages]), "best")
    return told.select("row.*", F.coalesce(name, F.lit(UNKNOWN)).alias(out), F.col("log").alias(f"{out}_log"))


@dataclass
class _Logs:
    """Grams as rising numbers, 16 bits a letter, and their logarithms for each language."""

    grams: np.ndarray
    logs: np.ndarray

    @classmethod
    def of(cls, table: DataFrame) -> _Logs:
        rows = table.select("gram", "logs").toArrow()  # at most BROADCAST_GRAMS
        gram, logs = rows["gram"].combine_chunks(), np.array(rows["logs"].to_pylist())
        codes = _codes(gram).reshape(len(gram), -1)
        numbers = sum(codes[:, -1 - i] << 16 * i for i in range(codes.shape[1]))
        order = np.argsort(numbers)
        return cls(numbers[order], logs[order])

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Where each gram is; -1 if it isn't."""
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, at, -1)

    def get(self, grams: np.ndarray, other: np.ndarray | float) -> np.ndarray:
        """Logarithms of each gram, or else other."""
        at = self.find(grams)
        return np.where((at < 0)[:, None], other, self.logs[at])


def _detect_joined(docs: DataFrame, model: LanguageModel, text: str, out: str) -> DataFrame:
    """detect() with tables of any size."""
    n = len(model.languages)
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("id"))
    rows = packed.select("id", F.explode(trigrams(F.col("row")[text])).alias("gram"))
    found = rows.join(small(model.three.withColumnRenamed("logs", "l3")), "gram", "left")
    # Only trigrams that no language has seen have keys for the shorter tables.
    rare = lambda x: F.when(F.col("l3").isNull(), x)
    found = found.select("id", "l3", rare(F.substring("gram", 1, 2)).alias("ab"), rare(F.substring("gram", 2, 2)).alias("bc"), rare(F.substring("gram", 2, 1)).alias("b"), rare(F.substring("gram", 3, 1)).alias("c"))
    for table, key, logs in ((model.after_two, "ab", "w2"), (model.two, "bc", "l2"), (model.after_one, "b", "w1"), (model.one, "c", "l1")):
        found = found.join(small(table.select(F.col("gram").alias(key), F.col("logs").alias(logs))), key, "left")

    def log(i: int) -> Column:
        at = lambda name: F.get(name, F.lit(i))
        none = F.lit(0.0)
        shorter = F.coalesce(at("l2"), F.coalesce(at("w1"), none) + F.coalesce(at("l1"), F.lit(model.floor[i])))
        return F.coalesce(at("l3"), F.coalesce(at("w2"), none) + shorter)

    sums = found.groupBy("id").agg(F.count("*").alias("n"), *[F.sum(log(i)).alias(f"s{i}") for i in range(n)])
    best = F.array_max(F.array(*[F.struct(F.col(f"s{i}").alias("s"), F.lit(-i).alias("turn"), F.lit(name).alias("name")) for i, name in enumerate(model.languages)]))
    told = sums.select("id", best["name"].alias("name"), (best["s"] / F.col("n")).alias("log"))
    return packed.join(told, "id", "left").select("row.*", F.coalesce("name", F.lit(UNKNOWN)).alias(out), F.col("log").alias(f"{out}_log"))
