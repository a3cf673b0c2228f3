"""Quality rules whose cutoffs come with a guarantee.

A rule rejects a text when one measured share is above a cutoff. Cutoffs are chosen per
stratum on labelled rows so that, with confidence ``1 - error`` for all strata and rules
together, no rule rejects more than ``limit / rules`` of the good texts of a stratum, and
all rules together no more than ``limit``:

* Each rule has a fixed list of cutoffs from lax to strict. For one cutoff the number of good
  rows that it would reject is binomial, and the exact tail P(X <= seen) at a rejection
  share of ``limit / rules`` is the p-value of "this cutoff rejects too much".
* Along the list cutoffs are tested in order and testing stops at the first that is not
  proven (fixed-sequence testing needs no further correction); over strata and rules the
  error is split evenly (Bonferroni).
* A rule without a proven cutoff in a stratum does not apply there. Rows of a stratum
  that is not listed belong to the stratum ``other``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import per_text, words
from episodica.session import durable

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
STRATA = ("en", "fr", "de", "es")
LIMIT = 0.01
ERROR = 0.05
# Fixed lists, lax to strict, in shares.
CUTOFFS = {
    "symbols": [3.0, 2.0, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "dup_lines": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3],
    "repeats": [0.5, 0.4, 0.3, 0.25, 0.2],
    "capitals": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
    "long_words": [20.0, 15.0, 12.0, 11.0, 10.0, 9.5, 9.0, 8.5],
}
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long"


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words covered by windows of ``window`` words found twice or more, first ones included.

    ``ids``: one number per distinct word. Windows are numbered exactly, not hashed, by
    joining the numbers of two halves; memory is a few arrays as long as the text.
    """
    n = len(ids) - window + 1
    if n < 2:
        return 0
    size, at = 1, ids
    while size < window:  # numbers of windows of `size` words to numbers of wider ones
        step = min(size, window - size)
        pair = at[:-step] * (int(at.max()) + 1) + at[step:]
        if len(pair) > 1:
            _, at = np.unique(pair, return_inverse=True)
        else:
            at = np.zeros(1, dtype=np.int64)
        size += step
    often = np.bincount(at)[at] > 1
    if not often.any():
        return 0
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    starts = np.flatnonzero(often)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text; all 0 for null."""
    found = words(text)
    if not found:
        n_symbols = sum(text.count(c) for c in SYMBOLS) if text else 0
        return (0, 0, n_symbols, 0, 0, 0, 0)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip("\t\n\x0b\x0c\r "):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    spaces = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    capitals = sum(w.isupper() for w in map(bytes.decode, found)) if any(c.isupper() for c in text[1:]) else 0
    return (
        len(found), len(text) - spaces, sum(text.count(c) for c in SYMBOLS), dup, repeated_words(ids), lines, capitals,
    )


def counts(text: Column) -> Column:
    def make():
        names = [f.split()[0] for f in COUNTS.split(", ")]

        def work(texts: list) -> pa.Array:
            cols = zip(*map(measure, texts)) if texts else [[]] * len(names)
            return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        return work

    return per_text(make, f"struct<{COUNTS.replace(' long', ':long')}>")(text)


def shares(c: Column | str = "counts") -> dict[str, Column]:
    """The value that each rule looks at, from a struct of COUNTS."""
    c = F.col(c) if isinstance(c, str) else c
    over = lambda a, b: F.when(c[b] > 0, c[a] / c[b]).otherwise(F.lit(0.0))
    return {
        "symbols": over("n_symbols", "n_words"), "dup_lines": over("n_dup_lines", "n_lines"), "repeats": over("n_repeat_words", "n_words"),
        "capitals": over("n_capitals", "n_words"), "long_words": over("word_chars", "n_words"),
    }


def base_failed(c: Column) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])


def tail(seen: int, n: int, share: float) -> float:
    """P(X <= seen) for X binomial(n, share), summed downwards until terms vanish."""
    if seen >= n:
        return 1.0
    log = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share)
    terms, largest = [], 0.0
    for k in range(seen, -1, -1):
        terms.append(math.exp(log(k)))
        largest = max(largest, terms[-1])
        if k < n * share and terms[-1] < 1e-18 * largest:  # below the mean they only shrink
            break
    return min(1.0, math.fsum(terms))


def stratum(column: Column, strata: tuple[str, ...] = STRATA) -> Column:
    return F.when(column.isin(*strata), column).otherwise(F.lit("other"))


def choose(labelled: DataFrame, strata: tuple[str, ...] = STRATA, limit: float = LIMIT, error: float = ERROR) -> dict[str, dict[str, float]]:
    """Cutoffs per stratum and rule from ``labelled`` (stratum, quality, counts).

    The bounds hold for independent texts: rows of a stratum that are equal in all counts, as
    copies are, count once. One row per stratum reaches the driver, with a number for each
    rule and cutoff.
    """
    good = labelled.where((F.col("quality") == 1) & ~base_failed(F.col("counts"))).dropDuplicates(["stratum", "counts"])
    cols = [F.count(F.lit(1)).alias("n")]
    for rule, value in shares().items():
        cols += [F.count_if(value > cut).alias(f"{rule}_{i}") for i, cut in enumerate(CUTOFFS[rule])]
    tests = len(CUTOFFS) * (len(strata) + 1)
    chosen: dict[str, dict[str, float]] = {}
    for row in good.groupBy("stratum").agg(*cols).collect():  # at most len(strata) + 1 rows
        chosen[row["stratum"]] = {}
        for rule, cuts in CUTOFFS.items():
            for i, cut in enumerate(cuts):
                share = limit / len(CUTOFFS)
                # A share seen above the limit is never proven to lie below it.
                if row[f"{rule}_{i}"] > row["n"] * share or tail(row[f"{rule}_{i}"], row["n"], share) > error / tests:
                    break
                chosen[row["stratum"]][rule] = cut
    return chosen


def verdict(where: Column, chosen: dict[str, dict[str, float]], c: Column | str = "counts") -> Column:
    """True where the base rules and all rules of the stratum let a text pass."""
    c = F.col(c) if isinstance(c, str) else c
    bad = F.lit(False)
    for name, rules in sorted(chosen.items()):
        for rule, cut in sorted(rules.items()):
            bad = bad | ((where == name) & (shares(c)[rule] > cut))
    return ~base_failed(c) & ~bad


def labelled_counts(docs: DataFrame, labels: DataFrame, strata: tuple[str, ...] = STRATA) -> DataFrame:
    """(stratum, quality, counts) of every labelled row; ``docs`` has doc_id, lang, counts.

    An id that is labelled both ways is not used.
    """
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id")
    known = known.agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    return docs.select("doc_id", stratum(F.col("lang"), strata).alias("stratum"), "counts").join(known, "doc_id")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the struct counts of every row."""
    return docs.select("doc_id", "lang", counts(F.col("text")).alias("counts"))
