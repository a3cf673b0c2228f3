"""Language of whole texts: multinomial logistic regression on TF-IDF of character n-grams.

Letters in lower case, everything else one space between words; all runs of one to three of
these characters are hashed to ``SIZE`` features. A text is its counts times the inverse
document frequencies, scaled to length one. Weights are learned with the
follow-the-regularised-leader rule, whose two penalties (absolute and squared) leave most of
them zero, on a sample of labelled texts that is bounded per language. A temperature,
fitted on a fifth of the sample that the weights never saw, calibrates the scores.

Document frequencies cover all labelled texts of the folds that may be learned from. Tasks
count features of their texts in vectors; a text of any length needs SIZE counters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.common import session
from episodica.session import durable

SIZE = 1 << 16  # features are unsigned 16-bit numbers
LONGEST = 3
PER_LANGUAGE = 800  # labelled texts of a language in the sample, at most
SAMPLE = 12_000  # of all languages together, at most
LANGUAGES = 500  # the most frequent ones are learned
PASSES = 4
ALPHA, BETA, FIRM, RIDGE = 0.5, 1.0, 0.02, 0.02  # step, its delay, absolute and squared penalty
SLAB = 1 << 20
UNKNOWN = "und"
_ODD = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]  # odd multipliers of the hash


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _points(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(_letters()[points], points, np.uint32(32))


def _slab(line: np.ndarray, old: int, longest: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Features of the runs that end after ``old`` characters, the characters the next slab needs, and whether a letter came."""
    blank = line == 32
    keep = np.ones(len(line), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])  # one space between words, also where a slab ends
    line, old = line[keep], int(keep[:old].sum())
    letters = line[old:] != 32
    hashed, parts = np.zeros(len(line), dtype=np.uint32), []
    for n in range(1, min(longest, len(line)) + 1):
        hashed = hashed[: len(line) - n + 1] * _ODD[0] + line[n - 1 :] * _ODD[1] + np.uint32(n)
        fresh = hashed[max(0, old - n + 1) :]
        parts.append(fresh[letters] if n == 1 else fresh)
    mixed = np.concatenate(parts)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * _ODD[2]
    return (mixed >> np.uint32(16)).astype(np.uint16), line[max(0, len(line) - longest + 1) :], bool(letters.any())


def counts(text: str | None, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray] | None:
    """The features of a text and how often each comes in it; null if the text has no letter."""
    if not text:
        return None
    held, total, found, at = np.array([32], dtype=np.uint32), None, False, 0
    while at < len(text):
        points, at = _points(text[at : at + SLAB]), at + SLAB
        line = np.concatenate([held, points, np.full(int(at >= len(text)), 32, dtype=np.uint32)])
        features, held, some = _slab(line, len(held), longest)
        found = found or some
        if total is None and at >= len(text):
            if not found:
                return None
            features = np.sort(features, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], features[1:] != features[:-1]]))
            return features[first].astype(np.int64), np.diff(np.append(first, len(features)))
        total = np.bincount(features, minlength=SIZE) + (0 if total is None else total)
    used = np.flatnonzero(total)
    return (used, total[used]) if found else None


@dataclass
class Model:
    """``weights`` holds the rows of the features that have any weight; ``place`` finds them."""

    names: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.ones(SIZE, dtype=np.float32))
    place: np.ndarray = field(default_factory=lambda: np.zeros(SIZE, dtype=np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), dtype=np.float32))
    temperature: float = 1.0

    def margins(self, used: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = n * self.idf[used]
        x = x / np.sqrt((x * x).sum())
        return x @ self.weights[self.place[used]]

    def predict(self, text: str | None) -> tuple[str, float]:
        seen = counts(text)
        if seen is None or not self.names:
            return UNKNOWN, 0.0
        p = _softmax(self.margins(*seen) / self.temperature)
        best = int(np.argmax(p))
        return self.names[best], float(p[best])


def _softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max())
    return e / e.sum()


def follow(
    rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, kinds: int, passes: int = PASSES,
    alpha: float = ALPHA, beta: float = BETA, firm: float = FIRM, ridge: float = RIDGE,
) -> np.ndarray:
    """Weights (size x kinds) by follow-the-regularised-leader over (features, values, class), row by row.

    A weight is zero until its summed gradient leaves the absolute penalty ``firm``.
    """
    z, n = np.zeros((size, kinds)), np.zeros((size, kinds))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        w = (np.sign(zs) * firm - zs) / ((beta + np.sqrt(ns)) / alpha + ridge)
        return np.where(np.abs(zs) <= firm, 0.0, w)

    for turn in range(passes):
        for at in np.random.default_rng(turn).permutation(len(rows)):
            used, x, kind = rows[at]
            zs, ns = z[used], n[used]
            w = weights(zs, ns)
            p = _softmax(x @ w)
            p[kind] -= 1
            g = x[:, None] * p
            squared = ns + g * g
            z[used] = zs + g - (np.sqrt(squared) - np.sqrt(ns)) / alpha * w
            n[used] = squared
    return weights(z, n)


def fit_temperature(margins: np.ndarray, kinds: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm.

    One pseudo-count of every class keeps scores of separable texts below certainty.
    """
    rows, k = margins.shape
    wanted = np.full((rows, k), 1.0 / (rows + k))
    wanted[np.arange(rows), kinds] += rows / (rows + k)

    def loss(log_t: float) -> float:
        m = margins / np.exp(log_t)
        m = m - m.max(axis=1, keepdims=True)
        return float((np.log(np.exp(m).sum(axis=1)) - (m * wanted).sum(axis=1)).mean())

    low, high, ratio = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold each feature; -1 stands for texts."""
    total, texts = np.zeros(SIZE, dtype=np.int64), 0
    for batch in batches:
        for text in batch["text"].to_pylist():
            seen = counts(text)
            if seen is not None:
                total[seen[0]] += 1
                texts += 1
    used = np.flatnonzero(total)
    schema = pa.schema([("feature", pa.int64()), ("n", pa.int64())])
    yield pa.RecordBatch.from_arrays([pa.array([*used, -1], pa.int64()), pa.array([*total[used], texts], pa.int64())], schema=schema)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("used", pa.binary()), ("n", pa.binary())])
    for batch in batches:
        rows = []
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
            seen = counts(text)
            if seen is not None:
                rows.append((lang, *[part.astype("<u4").tobytes() for part in seen]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def sample(labelled: DataFrame, per_language: int, most: int, languages: int) -> DataFrame:
    """text and lang of at most ``per_language`` rows a language and ``most`` in all, by hash of the text.

    Of a language, rows far above the last hash that can be chosen go before they are
    numbered, so no task gets more than about twice the bound.
    """
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not sizes:
        return labelled.limit(0)
    each = max(2, min(per_language, most // len(sizes)))
    named = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, 2 * each / r["n"])) for r in sizes], "__lang string, __share double")
    mark = F.pmod(F.xxhash64("text"), F.lit(1 << 32))
    some = labelled.withColumn("__mark", mark).join(F.broadcast(named), F.col("lang") == F.col("__lang"))
    some = some.where(F.col("__mark") < F.col("__share") * float(1 << 32)).dropDuplicates(["lang", "__mark"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("__mark"))
    return some.withColumn("__place", place).where(F.col("__place") <= each).select("text", "lang")


def train(
    docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = SAMPLE, languages: int = LANGUAGES,
) -> Model:
    """Learn from the rows of ``docs`` that have a text and a lang. Without such rows nothing is ever predicted.

    Equal texts of a language count once in the sample. The sample's counts (``most`` sparse
    vectors) and SIZE document frequencies reach the driver.
    """
    session(docs.sparkSession)
    labelled = docs.select("text", "lang").where("text is not null and lang is not null")
    df, texts = np.zeros(SIZE, dtype=np.int64), 0
    for r in labelled.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        if r["feature"] < 0:
            texts = r["n"]
        else:
            df[r["feature"]] = r["n"]
    idf = (np.log((1.0 + texts) / (1.0 + df)) + 1.0).astype(np.float32)
    picked = durable(sample(labelled, per_language, most, languages).mapInArrow(_sparse, "lang string, used binary, n binary"))
    rows = sorted(map(tuple, picked.collect()))
    names = sorted({r[0] for r in rows})
    if not names:
        return Model()
    vectors = []
    for lang, used, n in rows:
        at = np.frombuffer(used, dtype="<u4").astype(np.int64)
        x = np.frombuffer(n, dtype="<u4") * idf[at].astype(np.float64)
        vectors.append((at, x / np.sqrt((x * x).sum()), names.index(lang)))
    held = np.random.default_rng(0).random(len(vectors)) < 0.2
    weights = follow([v for v, h in zip(vectors, held) if not h], SIZE, len(names))
    tried = [v for v, h in zip(vectors, held) if h] or vectors
    margins = np.array([x @ weights[at] for at, x, _ in tried])
    temperature = fit_temperature(margins, np.array([k for _, _, k in tried])) if len(names) > 1 else 1.0
    some = np.flatnonzero(np.abs(weights).max(axis=1) > 0)
    place = np.zeros(SIZE, dtype=np.int32)
    place[some] = np.arange(1, len(some) + 1)
    kept = np.concatenate([np.zeros((1, len(names))), weights[some]]).astype(np.float32)
    return Model(names, idf, place, kept, temperature)


def _predicting(model: Model):
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [model.predict(t) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([f[k] for f in found], t.type) for k, t in enumerate(schema)], fields=list(schema))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "lang_pred string, score double")


def predicted(text: Column, model: Model) -> Column:
    """Struct of lang_pred and its calibrated score from 0 to 1.

    ``und`` and 0 for null texts, texts without a letter, and without a learned language. Of
    equal scores the language first in order is taken.
    """
    return _predicting(model)(text)
