"""Language identification: known words first, shorter and shorter character n-grams for the rest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from careflow.session import cut_lineage, spread

UNKNOWN = "und"
KEPT = 200_000
LETTERS = regex.compile(r"\p{L}+")


@dataclass
class Model:
    """Log frequencies by language of words and of n-grams (scaled within their length); `prior` are document shares."""

    languages: list[str]
    prior: np.ndarray
    words: dict[str, tuple[float, ...]]
    grams: dict[str, tuple[float, ...]]
    longest: int


def letters(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return LETTERS.findall(text.lower())


class Scorer:
    """Applies a model; remembers the scores of the runs of non-blank characters it has met, up to `KEPT`."""

    def __init__(self, model: Model):
        self.model, self.zero = model, (0.0,) * len(model.languages)
        self.rows = np.zeros((KEPT, len(model.languages) + 1))
        self.slots: dict[str, int] = {}

    def word(self, word: str) -> tuple[float, ...]:
        """Scores of a word: its own if it is known, else the mean over the known n-grams of the greatest length that has any, else zero."""
        known = self.model.words.get(word)
        if known is not None:
            return known
        padded, grams = f" {word} ", self.model.grams
        for n in range(min(self.model.longest, len(padded)), 0, -1):
            found = [g for i in range(len(padded) - n + 1) if (g := grams.get(padded[i : i + n])) is not None]
            if found:
                return tuple([sum(x) / len(found) for x in zip(*found)])
        return self.zero

    def slot(self, chunk: str) -> int:
        words = letters(chunk)
        at = self.slots[chunk] = len(self.slots)
        scores = [self.word(w) for w in words]
        self.rows[at] = scores[0] + (1.0,) if len(words) == 1 else [sum(x) for x in zip(*scores)] + [len(words)] if words else 0.0
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score of a whole text. The score is the share of the best language when evidence counts for 20 words at most."""
        total = np.zeros(len(self.zero) + 1)
        chunks = text.split() if text else []
        for start in range(0, len(chunks), 4096):
            part = chunks[start : start + 4096]
            if len(self.slots) + len(part) > KEPT:
                self.slots.clear()
            find = self.slots.get
            total += self.rows[[at if (at := find(c)) is not None else self.slot(c) for c in part]].sum(axis=0)
        n = total[-1]
        if not n or not self.zero:
            return UNKNOWN, 0.0
        score = total[:-1] + self.model.prior
        best = int(np.argmax(score))
        score = total[:-1] * min(1.0, 20 / n) + self.model.prior
        return self.model.languages[best], float(1 / np.exp(np.minimum(score - score[best], 700)).sum())


def _quota(counts: dict[str, int], rows: int) -> float:
    """Rows each language may give so that all give about `rows`: those with fewer give all they have."""
    left, level = rows, 0.0
    for i, n in enumerate(sorted(counts.values())):
        level = left / (len(counts) - i)
        if n >= level:
            return level
        left -= n
    return float("inf")


def _pieces(padded: Column, size: int) -> Column:
    """All runs of `size` characters; empty for a shorter word."""
    runs = F.transform(F.sequence(F.lit(1), F.length(padded) - size + 1), lambda i: F.substring(padded, i, F.lit(size)))
    return F.when(F.length(padded) >= size, runs).otherwise(F.array().cast("array<string>"))


def _logs(counted: DataFrame, sizes: dict[str, int], every: int, languages: list[str]) -> dict[str, tuple[float, ...]]:
    """Smoothed log frequencies by language of rows (key, seen), `seen` being language numbers with counts; keys seen alike share one tuple."""
    total = np.array([sizes.get(x, 0) for x in languages], float)
    table = counted.select("key", "seen").toArrow()
    seen = table.column("seen").combine_chunks().dictionary_encode()
    rows = []
    for pairs in seen.dictionary.to_pylist():
        n = np.zeros(len(languages))
        for pair in pairs.split(","):
            at, count = pair.split(":")
            n[int(at) - 1] = int(count)
        rows.append(tuple(np.log((n + 0.5) / (total + 0.5 * every)).tolist()))
    return {key: rows[at] for key, at in zip(table.column("key").to_pylist(), seen.indices.to_pylist())}


def fit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", fit_rows: int = 10_000, longest: int = 5, seed: int = 11, id_col: str = "doc_id",
) -> Model:
    """Learn from the rows with a text and a language.

    A sample of about `fit_rows` rows is counted; it is the only bound of the model. It is drawn per language by a hash of id
    and text: languages with few rows give all, the others as many as each other, so small languages keep their words; the prior
    is the languages' shares of all rows. Every word of the sample is known, and n-grams of 1 to `longest` characters, blanks
    around the word included, are counted over all of them; those of two and more characters are used if seen three times.
    Words and n-grams are counted on Spark. No labelled rows give a model without languages.
    """
    picked = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col).cast("string")) if id_col in docs.columns else F.xxhash64(F.lit(seed), F.col(text_col).cast("string"))
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), picked.alias("picked")).where("text is not null and lang is not null")
    shares = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(1000).collect()}
    languages = sorted(shares)
    prior = np.log(np.array([shares[x] for x in languages], float) / max(1, sum(shares.values())))
    if not languages:
        return Model([], prior, {}, {}, longest)
    quota, parts = _quota(shares, fit_rows), 1 << 40
    at = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang"))
    least = F.array(*[F.lit(int(parts * min(1.0, quota / shares[x]))) for x in languages])
    sample = rows.withColumn("at", at.cast("int")).where("at > 0").where(F.pmod("picked", F.lit(parts)) < F.element_at(least, F.col("at")))

    found = sample.select("lang", "at", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("key")).where("key <> ''")
    words = cut_lineage(found.groupBy("key", "lang", "at").agg(F.count(F.lit(1)).alias("n")), "words")
    pieces = F.flatten(F.array(*[_pieces(F.concat(F.lit(" "), "key", F.lit(" ")), k) for k in range(1, longest + 1)]))
    grams = spread(words).select("lang", "at", "n", F.explode(pieces).alias("key")).groupBy("key", "lang", "at").agg(F.sum("n").alias("n"))
    counted = cut_lineage(words.select(F.lit(0).alias("kind"), "key", "lang", "at", "n").union(grams.select(F.length("key"), "key", "lang", "at", "n")), "counted")
    keys = cut_lineage(counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "at", "n"))), ",").alias("seen")), "keys")
    totals = {(r["kind"], r["lang"]): r["n"] for r in counted.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
    every = {r["kind"]: r["count"] for r in keys.groupBy("kind").count().collect()}

    def logs(kind: int, least: int) -> dict[str, tuple[float, ...]]:
        return _logs(keys.where((F.col("kind") == kind) & (F.col("n") >= least)), {x: totals.get((kind, x), 0) for x in languages}, every.get(kind, 0), languages)

    by_length: dict[str, tuple[float, ...]] = {}
    for k in range(1, longest + 1):
        by_length |= logs(k, 1 if k == 1 else 3)
    return Model(languages, prior, logs(0, 1), by_length, longest)


def annotate(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """All columns of `docs` and the language of every whole text with its score (0 to 1), under the names given.

    A null text, one without a letter, or any text under a model without languages is `und` with score 0; letters that the
    model has never seen leave the most frequent language. Ties go to the first language in order. Rows are judged one by
    one, so null and repeated ids keep their rows; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)  # of this task: nothing stays in the worker for later stages
        for part in parts:
            found = [scorer.predict(t) for t in part.column(at).cast(pa.string()).to_pylist()]
            more = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, lang_name, score_name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(lang_name, StringType()), StructField(score_name, DoubleType())]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `lang_pred` and `score` of every whole text, as `annotate` gives them; other columns are ignored."""
    return annotate(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text_")), model, "text_").drop("text_")


def fold(id_col: Column, folds: int = 5) -> Column:
    """Fold of a document, by the checksum of its id as text; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))
