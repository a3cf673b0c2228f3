"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton on folded text.

Folding turns look-alike letters, accents and digits used as letters into one plain form,
and everything that is no letter into a space. The lexicon holds words and word beginnings
with weights learned from labelled rows. A word counts with its largest matching weight,
unless the match lies in an exception phrase. The sum is normalised by the text's length,
and a logistic curve turns both into a score.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import fit_rows, per_text
from episodica.session import durable

FIT_ROWS = 20_000  # labelled rows to learn from, at most
TERMS = 5_000
PREFIXES = range(4, 9)
PRIOR = 10.0
LEAST_WEIGHT = 1.5
LEAST_TEXTS = 3
# Digits and signs written for letters, and letters of other scripts that look like Latin ones.
DIGITS = dict(zip("0134578@$", "oieastbas"))
LOOKALIKES = dict(zip("аеорсухіјѕһӏԁѡмнктвАЕОРСУХІЈЅНМКТВαοερτυικνΑΒΕΖΗΙΚΜΝΟΡΤΥΧıł", "aeopcyxijshldwmhktbaeopcyxijshmktbaoeptuikvabezhikmnoptyxil"))


class _Fold(dict):
    """Folded form of a character, worked out at its first use."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        c = LOOKALIKES.get(c) or DIGITS.get(c) or c
        base = unicodedata.normalize("NFKD", c).lower()
        base = "".join(LOOKALIKES.get(x, x) for x in base if not unicodedata.combining(x))
        if unicodedata.combining(c) or c in "­​‌‍⁠﻿":
            base = ""  # invisible or part of the letter before
        elif not base.isalpha():
            base = " "
        self[code] = base = base.replace("l", "i")  # 1, l and i are written for each other
        return base


_fold = _Fold()


def fold(text: str | None) -> str:
    """Folded text with a space before, between and after words."""
    return f" {' '.join((text or '').translate(_fold).split())} "


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)  # " word " or " begin"
    exceptions: list[str] = field(default_factory=list)  # " two words "
    curve: tuple[float, float, float] = (-3.0, 0.0, 0.0)


class Matcher:
    def __init__(self, model: Model):
        self.model, self.automaton = model, ahocorasick.Automaton()
        for term, weight in model.terms.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in model.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """Place and weight of each matching word outside of exception phrases."""
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if not len(self.automaton):
            return best
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if spared and best:
            best = {at: w for at, w in best.items() if not any(a <= at < b for a, b in spared)}
        return best

    def features(self, text: str | None) -> tuple[float, float]:
        """Summed weight, and weight per hundred words; both by logarithm."""
        folded = fold(text)
        total = sum(self.hits(folded).values())
        if not total:
            return 0.0, 0.0
        return math.log1p(total), math.log1p(100 * total / max(1, folded.count(" ") - 1))

    def score(self, text: str | None) -> float:
        a, b, c = self.model.curve
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def _terms(text: str) -> set[str]:
    out = set()
    for word in set(fold(text).split()):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in PREFIXES if len(word) >= k)
    return out


def _copies(text: str) -> int:
    """Near copies mostly share this number: the least hash of three words in a row."""
    found = fold(text).split()
    return min((xxhash.xxh64_intdigest(" ".join(found[i : i + 3])) for i in range(max(1, len(found) - 2))), default=0) >> 1


def weigh(counts: dict[str, tuple[int, int]], n_bad: int, n_good: int) -> dict[str, float]:
    """Weighted terms from the toxic and the clean texts that hold each of them."""
    if not n_bad or not n_good:
        return {}
    base = n_bad / (n_bad + n_good)
    odds = lambda p: math.log(p / (1 - p))
    weights = {}
    for term, (bad, good) in counts.items():
        w = odds((bad + PRIOR * base) / (bad + good + PRIOR)) - odds(base)
        if bad >= LEAST_TEXTS and w >= LEAST_WEIGHT:
            weights[term] = w
    # A longer beginning is of use only where it weighs more than a shorter one.
    useful = {}
    for term in sorted(weights, key=len):
        if all(weights[term] > useful.get(term[:k], 0.0) for k in range(PREFIXES.start + 1, len(term))):
            useful[term] = weights[term]
    return dict(sorted(useful.items(), key=lambda x: (-x[1] * math.log1p(counts[x[0]][0]), x[0]))[:TERMS])


def _counted(each, flush: int = 50_000):
    """Rows (item, half, toxic, n): what ``each`` finds in a text, summed in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, sums = each(), Counter()

        def out() -> pa.RecordBatch:
            keys = list(sums)
            return pa.RecordBatch.from_pydict({
                "item": pa.array([k[0] for k in keys], pa.string()), "half": pa.array([k[1] for k in keys], pa.int32()),
                "toxic": pa.array([k[2] for k in keys], pa.int32()), "n": pa.array([sums[k] for k in keys], pa.int64()),
            })

        for batch in batches:
            for text, half, toxic in zip(*(batch[c].to_pylist() for c in ("text", "half", "toxic"))):
                sums.update((item, half, toxic) for item in find(text))
                if len(sums) > flush:
                    yield out()
                    sums.clear()
        if sums:
            yield out()

    return run


def _phrases(model: Model):
    """Each match with the word before and with the word after it."""

    def make():
        match = Matcher(model)

        def find(text: str) -> set[str]:
            folded, found = fold(text), set()
            for at in match.hits(folded):
                end = folded.find(" ", at + 1)
                before, after = folded.rfind(" ", 0, at) if at else -1, folded.find(" ", end + 1)
                found |= {folded[before : end + 1]} if before >= 0 else set()
                found |= {folded[at : after + 1]} if after > 0 else set()
            return found

        return find

    return make


def features(text: Column, model: Model) -> Column:
    def make():
        match = Matcher(model)

        def work(texts: list) -> pa.Array:
            found = [match.features(t) for t in texts]
            return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)], ["x", "y"])

        return work

    return per_text(make, "struct<x:double,y:double>")(text)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Three coefficients by Newton steps with a small ridge; the slopes are never negative."""
    x = np.column_stack([np.ones(len(x)), x])
    ridge, beta = np.diag([1e-4, 1e-2, 1e-2]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), max(0.0, float(beta[1])), max(0.0, float(beta[2]))


def train(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS, exceptions: tuple[str, ...] = ()) -> Model:
    """Learn from at most ``limit`` rows of ``labels`` (doc_id, toxic), those of smallest hash.

    Whole texts are read, in tasks; the driver gets the counts of terms that at least
    LEAST_TEXTS toxic texts hold, and two numbers per sampled text. Rows without an id or a
    label are not used, and near copies count once. The curve is fitted on halves that the
    lexicon did not see. Without both kinds of labels nothing matches and the score is
    constant.
    """
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = fit_rows(known, limit, "doc_id").withColumnRenamed("doc_id", "__id")
    texts = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("__id"))
    copy = per_text(lambda: lambda ts: pa.array([_copies(t or "") for t in ts], pa.int64()), "long")
    sample = durable(
        texts.select(copy("text").alias("copy"), F.coalesce("text", F.lit("")).alias("text"), "toxic")
        .groupBy("copy", "toxic").agg(F.min("text").alias("text"))
        .withColumn("half", F.pmod("copy", F.lit(2)).cast("int"))
    )
    own = [fold(p) for p in exceptions]
    n = {(r["half"], r["toxic"]): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
    total = {t: sum(v for (_, toxic), v in n.items() if toxic == t) for t in (0, 1)}
    if not total[0] or not total[1]:
        return Model({}, own, (3.0 if total[1] else -3.0, 0.0, 0.0))
    kinds = "item string, half int, toxic int, n long"
    rows = (
        sample.mapInArrow(_counted(lambda: _terms), kinds).groupBy("item")
        .agg(*[F.sum(F.when((F.col("half") == h) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{h}{t}") for h in (0, 1) for t in (0, 1)])
        .where(F.col("n01") + F.col("n11") >= LEAST_TEXTS).collect()
    )
    half = [weigh({r["item"]: (r[f"n{h}1"], r[f"n{h}0"]) for r in rows}, n.get((h, 1), 0), n.get((h, 0), 0)) for h in (0, 1)]
    terms = weigh({r["item"]: (r["n01"] + r["n11"], r["n00"] + r["n10"]) for r in rows}, total[1], total[0])
    spared = (
        sample.mapInArrow(_counted(_phrases(Model(terms))), kinds).groupBy("item")
        .agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"))
        .where(f"good >= {LEAST_TEXTS} and bad = 0").orderBy(F.desc("good"), "item").limit(TERMS).collect()
    )
    seen = F.when(F.col("half") == 0, features(F.col("text"), Model(half[1]))).otherwise(features(F.col("text"), Model(half[0])))
    points = sorted(sample.select("toxic", seen.alias("f")).select("toxic", "f.x", "f.y").collect())  # in one order on every run
    curve = _logistic(np.array([[p["x"], p["y"]] for p in points]), np.array([float(p["toxic"]) for p in points]))
    return Model(terms, [r["item"] for r in spared] + own, curve)


def score(text: Column, model: Model) -> Column:
    """Score of a whole text from 0 to 1; null and empty texts get that of a text without matches."""

    def make():
        match = Matcher(model)
        return lambda texts: pa.array([match.score(t) for t in texts], pa.float64())

    return per_text(make, "double")(text)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0
