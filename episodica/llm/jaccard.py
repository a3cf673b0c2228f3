"""Exact Jaccard self-join of word n-gram sets, with set-relation skipping.

Two texts link when ``100 * common >= threshold * union`` over their distinct n-grams; a
group is what links connect. The join never compares all pairs:

* Equal sets are one set. Their rows share its answer.
* **Answer skipping.** Sets that share a sketch are compared with one set of that sketch
  only. Those that link to it form a cluster around it (the leader), and its answer
  is theirs. A set that no leader takes is a cluster of its own.
* **Index skipping.** N-grams are ordered from rare to common; two sets that link share one
  among their first few (the prefix). The index lists of an n-gram are cut into blocks by
  set size. The place of the n-gram in the probing set bounds how large a partner may be, so a
  probe meets only the blocks within that bound and skips the others, and the places in
  both sets bound the overlap that is still possible. Lists hold clusters, not sets.
* **Answers from answers.** For two clusters that meet in the index, the leaders are compared.
  If they link, the clusters link. If they are too far apart for the radii of the clusters
  (Jaccard distance obeys the triangle inequality), no members can link. Only between
  these are members compared, and of them only those whose distances to their leaders
  leave a chance.

The order of n-grams is by counts over all texts, kept in hashed buckets. Buckets that are
shared by chance make an order less good, never a result less right.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import tidied, unused, with_rows
from episodica.session import durable

BANDS, BAND_ROWS = 5, 3
BUCKETS, SLICES = 1 << 21, 64  # of the counts, and rows that they are passed on in
BROADCAST_ROWS = 2_000_000  # of one number each
SLAB = 1 << 20
KEPT_SETS = 64
_ODD = np.random.default_rng(20).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_IN_WORD = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BYTE = np.random.default_rng(21).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SIGNATURE = "row long, doc_id long, size long, sid binary, rare double, bands array<long>, prefix array<long>"


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams, A-Z in lower case.

    A word ``b0 b1 ..`` has the hash ``sum(T[bi] * B ** i)`` modulo 2**64 with random ``T`` and odd
    ``B``, mixed with its length. Differences of running sums give the hashes of all words
    at once; texts are taken in slabs, so memory beyond the text is bounded by its words.
    """

    def __init__(self, width: int):
        self.width = width
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            steps = np.full((2, max(n, 2 * len(self.up))), [[_BASE], [_INVERSE]], dtype=np.uint64)
            steps[:, 0] = 1
            self.up, self.down = np.cumprod(steps, axis=1)

    def _words(self, raw: bytes) -> np.ndarray:
        data = np.frombuffer(raw, dtype=np.uint8)
        self._powers(len(data) + 1)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], _IN_WORD[data], [False]])))
        starts, ends = edge[::2], edge[1::2]
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=sums[1:])
        found = (sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * _ODD[62]
        found ^= found >> np.uint64(32)
        found *= _ODD[61]
        return found ^ (found >> np.uint64(29))

    def all(self, text: str | None) -> np.ndarray:
        """Hashes of all n-grams in order; a shorter text is one n-gram."""
        raw, slabs, at = (text or "").encode("utf-8", "surrogatepass"), [], 0
        while at < len(raw):
            cut = _SPACE.search(raw, at + SLAB)  # a slab ends at white space
            slabs.append(self._words(raw[at : cut.start() if cut else len(raw)]))
            at = cut.start() if cut else len(raw)
        ids = np.concatenate(slabs) if slabs else np.zeros(0, dtype=np.uint64)
        if not len(ids):
            return ids
        width = min(self.width, len(ids))
        total = np.full(len(ids) - width + 1, width, dtype=np.uint64)
        for i in range(width):
            total += ids[i : len(ids) - width + 1 + i] * _ODD[40 + i % 20] + np.uint64(i)
        total ^= total >> np.uint64(29)
        total *= _ODD[63]
        return total ^ (total >> np.uint64(32))

    def __call__(self, text: str | None) -> np.ndarray:
        return np.unique(self.all(text))


def _bucket_counts(width: int, buckets: int):
    """Counts of a task, in SLICES rows of packed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = Shingler(width), np.zeros(buckets, dtype="<u4")
        for batch in batches:
            found = [shingles(text) for text in batch["text"].to_pylist()]
            if found:
                counts += np.bincount((np.concatenate(found) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets).astype("<u4")
        if counts.any():
            parts = np.split(counts, SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["slice", "counts"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by slice, row by row: a task holds its slices' sums and nothing else."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, packed in zip(batch["slice"].to_pylist(), batch["counts"].to_pylist()):
            found = np.frombuffer(packed, dtype="<u4").astype(np.uint64)
            sums[at] = sums[at] + found if at in sums else found
    for at, total in sums.items():
        low = np.minimum(total, np.uint64(2**32 - 1)).astype("<u4")
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([low.tobytes()], pa.binary())], ["slice", "counts"])


def rarity(docs: DataFrame, width: int, buckets: int = BUCKETS) -> np.ndarray:
    """Size class of each bucket over all texts; SLICES rows reach the driver."""
    kinds = "slice int, counts binary"
    found = docs.select("text").mapInArrow(tidied(_bucket_counts(width, buckets)), kinds).repartition(SLICES, "slice").mapInArrow(_add, kinds)
    counts = np.zeros((SLICES, buckets // SLICES))
    for row in found.collect():
        counts[row["slice"]] = np.frombuffer(row["counts"], dtype="<u4")
    return np.minimum(8 * np.log2(counts.ravel() + 1), 255).astype(np.uint8)


def _signatures(width: int, threshold: int, rare: np.ndarray):
    mask = np.uint64(len(rare) - 1)

    def sign(shingles: Shingler, text: str | None) -> tuple:
        found = shingles(text)
        if not len(found):
            return 0, None, None, [], []
        order = np.sort(rare[(found & mask).astype(np.int64)].astype(np.uint64) << np.uint64(55) | found >> np.uint64(9))
        least = [(found * odd).min().item() for odd in _ODD[: BANDS * BAND_ROWS]]
        bands = [hash((b, *least[b * BAND_ROWS : (b + 1) * BAND_ROWS])) for b in range(BANDS)]  # of whole numbers: the same everywhere
        sid = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
        prefix = len(found) - -(-threshold * len(found) // 100) + 1
        # Small if even the rarest n-grams are common ones: a text that others were made from.
        rare_share = -float((order[:prefix] >> np.uint64(55)).mean())
        return len(found), sid, rare_share, bands, order[:prefix].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            signed = [sign(shingles, t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch["row"], batch["doc_id"], pa.array([s[0] for s in signed], pa.int64()), pa.array([s[1] for s in signed], pa.binary()),
                pa.array([s[2] for s in signed], pa.float64()), pa.array([s[3] for s in signed], pa.list_(pa.int64())),
                pa.array([s[4] for s in signed], pa.list_(pa.int64())),
            ], ["row", "doc_id", "size", "sid", "rare", "bands", "prefix"])

    return run


def _compare(width: int):
    """(a, b, size_a, size_b, common) for rows (a, b, text_a, text_b, ...); sets met lately are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, kept = Shingler(width), OrderedDict()

        def tokens(row: int, text: str) -> np.ndarray:
            if row not in kept:
                kept[row] = shingles(text)
                if len(kept) > KEPT_SETS:
                    kept.popitem(last=False)
            else:
                kept.move_to_end(row)
            return kept[row]

        for batch in batches:
            found = [(tokens(x, s), tokens(y, t)) for x, s, y, t in zip(*(batch[c].to_pylist() for c in ("a", "text_a", "b", "text_b")))]
            common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in found]
            sizes = [pa.array([len(f[i]) for f in found], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], *sizes, pa.array(common, pa.int64())], ["a", "b", "size_a", "size_b", "common"])

    return run


def _small(df: DataFrame) -> DataFrame:
    """A hint to broadcast a table of whole numbers that was counted; else Spark decides."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class Join:
    """One self-join. A set is named by the row of a text that has it; tables go to the shared folder."""

    def __init__(self, docs: DataFrame, width: int, threshold: int):
        """``docs`` (row, doc_id, text) is a written table: rows keep their numbers in every scan."""
        if not 0 < threshold < 100:
            raise ValueError("threshold is a percentage between 0 and 100")
        self.width, self.threshold = width, threshold
        self.docs = docs
        self.signed = durable(self.docs.mapInArrow(tidied(_signatures(width, threshold, rarity(docs, width))), _SIGNATURE))
        # Rows whose set another row has already: (row, same).
        first = self.signed.where("size > 0").groupBy("sid").agg(F.min("row").alias("same"), F.count(F.lit(1)).alias("n")).where("n > 1")
        again = self.signed.select("row", "sid").join(first, "sid").where("row <> same").select("row", "same")
        self.again = durable(again)
        # One row per distinct set.
        self.sets = self.signed.where("size > 0").drop("sid", "doc_id").join(_small(self.again.select("row")), "row", "left_anti")

    def _compared(self, pairs: DataFrame) -> DataFrame:
        """(a, b, common, size_a, size_b, far) for distinct pairs of sets; ``far`` is their distance."""
        need = durable(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct())
        texts = self.docs.select("row", "text").join(_small(need), "row")
        named = lambda x: texts.select(F.col("row").alias(x), F.col("text").alias(f"text_{x}"))
        found = pairs.select("a", "b").join(named("a"), "a").join(named("b"), "b").select("a", "b", "text_a", "text_b")
        common = found.mapInArrow(tidied(_compare(self.width)), "a long, b long, size_a long, size_b long, common long")
        return durable(common.withColumn("far", 1 - F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))))

    def _links(self) -> Column:
        return 100 * F.col("common") >= self.threshold * (F.col("size_a") + F.col("size_b") - F.col("common"))

    def clusters(self) -> DataFrame:
        """(row, leader, far) for every set that has a leader; the others lead themselves.

        Among the sets of a sketch the one with the commonest n-grams leads: copies with changes
        of their own have n-grams that nobody else has, and the text they were made from
        has not. The same set leads in all its bands, so a large group has few leaders.
        """
        banded = self.sets.select(F.struct("rare", "row").alias("rank"), F.explode("bands").alias("band"))
        heads = banded.groupBy("band").agg(F.min("rank").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
        pairs = banded.join(heads, "band").where("rank <> head").groupBy(F.col("head.row").alias("a"), F.col("rank.row").alias("b")).agg(F.first("head").alias("head"))
        pairs = durable(pairs)
        near = self._compared(pairs).where(self._links()).select("a", "b", "far")
        taken = near.join(pairs, ["a", "b"]).groupBy("b").agg(F.min(F.struct("head", "far")).alias("m"))
        own = durable(taken.select(F.col("b").alias("row"), F.col("m.head.row").alias("leader"), F.col("m.far").alias("far")))
        # A leader is one that nobody before it takes.
        return durable(own.join(own.select(F.col("row").alias("leader")), "leader", "left_anti").select("row", "leader", "far"))

    def _block(self, size: Column) -> Column:
        return F.floor(F.log(size.cast("double")) / math.log(100 / self.threshold)).cast("int")

    def _postings(self, clusters: DataFrame) -> DataFrame:
        """(token, block, leader, row, far, size, rest): ``rest`` n-grams from this one to the last."""
        led = self.sets.select("row", "size", "prefix").join(_small(clusters), "row", "left")
        rows = led.select(
            "row", F.coalesce("leader", "row").alias("leader"), F.coalesce("far", F.lit(0.0)).alias("far"), F.col("size").cast("int").alias("size"),
            F.posexplode("prefix").alias("place", "token"),
        )
        return rows.withColumn("rest", F.col("size") - F.col("place")).withColumn("block", self._block(F.col("size"))).drop("place")

    def _probes(self, postings: DataFrame) -> DataFrame:
        """Postings once for each block within reach: up to the largest partner that a place allows."""
        t = self.threshold
        reach = F.least(F.floor(100 * F.col("size") / t), F.floor(F.col("rest") * (100 + t) / t) - F.col("size")).cast("long")
        ahead = postings.withColumn("reach", reach).where("reach >= size")
        return ahead.withColumn("block", F.explode(F.sequence(self._block(F.col("size")), self._block(F.col("reach"))))).drop("reach")

    def _may_link(self, x: str, y: str) -> Column:
        """Whether the overlap still possible at two places is enough."""
        t = self.threshold
        c = lambda s, n: F.col(f"{s}_{n}")
        return (100 + t) * F.least(c(x, "rest"), c(y, "rest")) >= t * (c(x, "size") + c(y, "size"))

    def _cluster_pairs(self, postings: DataFrame) -> DataFrame:
        """Pairs of leaders, a < b, whose clusters meet in the index."""
        def lists(rows: DataFrame, x: str) -> DataFrame:
            # Dealt by list, so that neither the sums nor the join need another shuffle.
            dealt = rows.select("token", "block", F.col("leader").alias(x), "size", "rest").repartition("token", "block")
            return dealt.groupBy("token", "block", x).agg(
                F.min("size").alias(f"{x}_size"), F.max("size").alias(f"{x}_most"), F.max("rest").alias(f"{x}_rest")
            )

        met = lists(self._probes(postings), "x").join(lists(postings, "y"), ["token", "block"])
        met = met.where((F.col("x") != F.col("y")) & (F.col("x_size") <= F.col("y_most")) & self._may_link("x", "y"))
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def links(self, clusters: DataFrame) -> DataFrame:
        """Pairs of leaders (a, b) of which some members link."""
        postings = self._postings(clusters)
        compared = self._compared(durable(self._cluster_pairs(postings)))
        direct = compared.where(self._links()).select("a", "b")
        radius = clusters.groupBy("leader").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"))
        side = lambda x: radius.select(F.col("leader").alias(x), F.col("radius").alias(f"radius_{x}"), F.col("n").alias(f"n_{x}"))
        reach = F.coalesce("radius_a", F.lit(0.0)) + F.coalesce("radius_b", F.lit(0.0))
        apart = compared.where(~self._links()).join(side("a"), "a", "left").join(side("b"), "b", "left")
        apart = apart.where((reach > 0) & (F.col("far") <= reach + self._slack()))
        # Clusters that are connected already need no further link.
        roots = durable(components(direct))
        root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
        apart = apart.join(root("a"), "a", "left").join(root("b"), "b", "left").where("root_a is null or root_b is null or root_a <> root_b")
        less = F.coalesce("n_a", F.lit(0)) <= F.coalesce("n_b", F.lit(0))
        apart = durable(apart.select(F.when(less, F.col("a")).otherwise(F.col("b")).alias("small"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("large"), F.col("far").alias("apart")))
        if not apart.head(1):
            return direct
        # Members of these clusters only, and only those near enough to each other by way of their
        # leaders. The smaller cluster of a pair is sent to the larger one, so a large one stays as it is.
        busy = durable(apart.select(F.explode(F.array("small", "large")).alias("leader")).distinct())
        some = durable(postings.join(_small(busy), "leader", "left_semi"))

        def met(few: DataFrame, many: DataFrame, order: str) -> DataFrame:
            row = lambda rows, s: rows.select("token", "block", *[F.col(c).alias(f"{s}_{c}") for c in ("row", "far", "size", "rest")], F.col("leader").alias(s))
            sent = row(few, "small").join(apart, "small")
            near = F.col("apart") <= F.col("small_far") + F.col("large_far") + self._slack()
            pairs = sent.join(row(many, "large"), ["token", "block", "large"]).where(F.expr(order) & self._may_link("small", "large") & near)
            return pairs.select(F.col("small_row").alias("a"), F.col("large_row").alias("b"), F.col("small").alias("la"), F.col("large").alias("lb"))

        met = met(self._probes(some), some, "small_size <= large_size").union(met(some, self._probes(some), "large_size <= small_size")).distinct()
        met = durable(met)
        good = self._compared(met.select("a", "b").distinct()).where(self._links()).select("a", "b")
        deep = met.join(good, ["a", "b"]).select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        return direct.union(deep).distinct()

    def _slack(self) -> float:
        return 1 - self.threshold / 100 + 1e-9

    def groups(self) -> DataFrame:
        """(row, doc_id, size, root) for every row; equal roots are one group, no n-gram: root null."""
        clusters = self.clusters()
        roots = components(self.links(clusters))
        # Each step finds few rows: those with a set seen before, with a leader, and with links.
        rows = self.signed.select("row", "doc_id", "size")
        rows = rows.join(_small(self.again), "row", "left").withColumn("root", F.coalesce("same", "row"))
        rows = rows.join(_small(clusters.select(F.col("row").alias("root"), "leader")), "root", "left").withColumn("root", F.coalesce("leader", "root"))
        rows = rows.join(_small(durable(roots.select(F.col("node").alias("root"), F.col("root").alias("top")))), "root", "left")
        return rows.select("row", "doc_id", "size", F.when(F.col("size") > 0, F.coalesce("top", "root")).alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected nodes of ``edges`` (a, b): root is the smallest node.

    Large-star and small-star rounds: nodes hook on to the smallest neighbour they know. The
    number of rounds grows with the logarithm of the longest chain; the driver sees one
    checksum a round.
    """
    now = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    seen = mark(now)
    while seen[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = durable(large)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = durable(small.union(down.select("u", "m")).distinct())
        last, seen = seen, mark(now)
        if seen == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def linked(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    ``threshold``: percent. component_id is the smallest doc_id of the group; nulls are left
    out of that and a group with null ids alone has null. Rows without words have no n-gram
    and link with nothing. Repeated rows link with each other; a text with fewer words than
    ``width`` is one n-gram. Only doc_id and text are read. An empty table gives no rows.
    """
    rows = durable(Join(with_rows(docs.select("doc_id", "text"), "row"), width, threshold).groups())
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    alone = rows.where("root is null").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.join(least, "root").select("doc_id", F.col("size").alias("n_shingles"), "component_id").unionByName(alone)


def one_of_each(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """``docs`` with one row of each group: that of smallest doc_id, nulls last; all columns stay."""
    own = unused(docs, "__row")
    docs = with_rows(docs, own)
    rows = durable(Join(docs.select(F.col(own).alias("row"), "doc_id", "text"), width, threshold).groups())
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    first = rows.where("root is not null").groupBy("root").agg(F.min(rank).alias("m")).select(F.col("m.row").alias(own))
    kept = durable(first.union(rows.where("root is null").select("row")))
    return docs.join(_small(kept), own, "left_semi").drop(own)
