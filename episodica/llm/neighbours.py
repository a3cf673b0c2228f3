"""Approximate nearest neighbours by inverted lists and adaptive dimension scans.

A bounded sample gives the list centres; every vector goes to the list of its nearest one. A
query probes the nearest lists, as many as the sample's own neighbours ask for. In a probed list, vectors are turned by a random rotation,
so any block of columns is a fair sample of a distance, and read column block by column
block: a candidate whose partial distance is too large, by a test with error factor
``SIGMAS``, for the 10th best so far is abandoned. What is left is compared exactly, in
double precision, on the original vectors.

Lists are cut into blocks of bounded size, so one list may hold any share of all vectors. A
vector goes to its block once; queries go to the blocks of the lists they probe, and stream
past the block that a task holds. A query that its probed lists leave short of neighbours
searches all lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.common import fit_rows
from episodica.session import durable

FIT_ROWS = 20_000  # vectors that the centres are fitted on, at most
MOST_LISTS = 4096
LIST_ROWS = 4096  # of a block
QUERY_ROWS = 1024  # looked up at a time
MOST_TASKS = 20_000  # that share the blocks of all lists, at most
TARGET = 0.97  # share of sampled neighbours that the probed lists must hold
TRIALS = 200  # sampled vectors whose neighbours in the sample are looked up, at most
COLUMNS = 16  # read at a time
STEP = 512  # candidates between two looks at the 10th best
SIGMAS = 2.1
_FOUND = pa.schema([("qrow", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(v: Column, size: int | None = None) -> Column:
    """Vectors without null or non-finite components, not all zero, of ``size`` components."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)
    return ok if size is None else ok & (F.size(v) == size)


def centres(sample: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means on a bounded sample; empty lists keep their centre."""
    made = sample[np.random.default_rng(seed).permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        near = nearest(sample, made, 1)[:, 0]
        sums = np.zeros_like(made)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(made))
        made[n > 0] = sums[n > 0] / n[n > 0, None]
    return made


def nearest(rows: np.ndarray, to: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the ``k`` nearest of ``to`` for each of ``rows``, nearest first."""
    out = np.empty((len(rows), k), dtype=np.int64)
    for i in range(0, len(rows), 4096):
        far = (to * to).sum(1) - 2 * rows[i : i + 4096] @ to.T
        out[i : i + 4096] = np.argsort(far, axis=1, kind="stable")[:, :k]
    return out


def probes_for(sample: np.ndarray, middle: np.ndarray, k: int, target: float) -> int:
    """Lists to probe so that they hold ``target`` of the true neighbours, by trial in the sample.

    In all of the data neighbours are nearer than in a sample of it, so this errs on the
    safe side. Data without clusters ask for most lists.
    """
    lists, wanted = nearest(sample, middle, 1)[:, 0], []
    trials = sample[:: max(1, len(sample) // TRIALS)][:TRIALS]
    for one, order in zip(trials, nearest(trials, middle, len(middle))):
        far = ((sample - one) ** 2).sum(1)
        true = np.argsort(far, kind="stable")[1 : k + 1]  # the first is the vector itself, or its like
        place = np.empty(len(middle), dtype=np.int64)
        place[order] = np.arange(len(middle))
        wanted += place[lists[true]].tolist()
    if not wanted:
        return len(middle)
    return int(np.sort(wanted)[min(len(wanted) - 1, math.ceil(target * len(wanted)) - 1)]) + 1


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Packed vectors as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, size)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [np.asarray(v, dtype="<f8").tobytes() for v in batch["v"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["row"], batch["vec_id"], pa.array(packed, pa.binary())], ["row", "vec_id", "v"])


def _probe(middle: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = nearest(_matrix(batch["v"], middle.shape[1]), middle, k)
                lists = pa.array(near.tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch["row"], batch["vec_id"], batch["v"], lists], ["row", "vec_id", "v", "lists"])

    return run


def scan(queries: np.ndarray, rows: np.ndarray, turn: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each query the numbers of ``rows`` that the adaptive scan did not abandon."""
    size = rows.shape[1]
    q, c = queries @ turn, rows @ turn
    ends = list(range(COLUMNS, size, COLUMNS)) + [size]
    for one in q:
        slack = 1e-12 * float(one @ one)  # rounding of the rotation
        best, left = math.inf, []
        near = np.zeros(0)
        for i in range(0, len(c), STEP):
            alive = np.arange(i, min(i + STEP, len(c)))
            part, at = np.zeros(len(alive)), 0
            for end in ends:
                part += ((c[alive, at:end] - one[at:end]) ** 2).sum(1)
                at = end
                bound = best if end == size else best * end / size * (1 + SIGMAS / math.sqrt(end)) ** 2
                keep = part <= bound + slack
                alive, part = alive[keep], part[keep]
            left.append((alive, part))
            near = np.sort(np.concatenate([near, part]))[: k + 1]  # one more: the query itself may be among them
            if len(near) > k:
                best = float(near[k])
        alive, part = np.concatenate([x for x, _ in left]), np.concatenate([x for _, x in left])
        yield alive[part <= best + slack]


def _search(turn: np.ndarray, k: int):
    """Queries against the block of a list: a block's candidates come first and are held, queries stream past."""
    size = len(turn)

    def found(rows: pa.Table, queries: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        q, c = _matrix(queries["v"], size), _matrix(rows["v"], size)
        row, ids = rows["row"].to_numpy(), rows["vec_id"].to_numpy()
        for one, own, query_id, alive in zip(q, queries["row"].to_pylist(), queries["vec_id"].to_pylist(), scan(q, c, turn, k)):
            alive = alive[row[alive] != own]
            score = np.sqrt(((c[alive] - one) ** 2).sum(1))
            top = np.lexsort((row[alive], ids[alive], score))[:k]
            out[0] += [own] * len(top)
            out[1] += [query_id] * len(top)
            out[2] += ids[alive][top].tolist()
            out[3] += score[top].tolist()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _FOUND.types)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []  # list and block of the candidates held
        for batch in batches:
            keys = np.stack([batch[name].to_numpy() for name in ("list", "block", "asks")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                if start == stop:
                    continue
                part, key = batch.slice(start, stop - start), tuple(keys[:2, start])
                if key != at:
                    at, held = key, []
                if not keys[2, start]:
                    held.append(part)
                elif held:
                    held = [pa.Table.from_batches(held).combine_chunks().to_batches()[0]] if len(held) > 1 else held
                    for i in range(0, part.num_rows, QUERY_ROWS):
                        yield found(pa.Table.from_batches(held), part.slice(i, QUERY_ROWS))

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of each query row but itself.

    ``vectors``: vec_id, embedding. Rows without an id and vectors that are not ``usable`` take
    no part, nor do vectors of another length than most have. Equal scores are in order of
    vec_id; rows that repeat an id are rows of their own. A query gets all others if there
    are fewer than ``k``. No usable vector or no query gives no rows.
    """
    v = F.col("embedding")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, n = sizes["size"], sizes["count"]
    kept = rows.where(F.size("v") == size)
    packed = kept.mapInArrow(_pack, "row long, vec_id long, v binary")
    sample = fit_rows(kept, FIT_ROWS, "vec_id", "row").mapInArrow(_pack, "row long, vec_id long, v binary").select("v").toArrow()
    lists = min(MOST_LISTS, max(1, round(math.sqrt(n) / 4)), sample.num_rows)
    fitted = _matrix(sample["v"], size)
    middle = centres(fitted, lists)
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0]

    kinds = "row long, vec_id long, v binary, lists array<int>"
    listed = durable(packed.mapInArrow(_probe(middle, 1), kinds).select("row", "vec_id", "v", F.col("lists")[0].alias("list")))
    counts = dict(listed.groupBy("list").count().collect())  # one number per list, at most MOST_LISTS
    blocks = F.array(*[F.lit(-(-counts.get(i, 0) // LIST_ROWS)) for i in range(lists)])
    queries = durable(listed.where(is_query).select("row", "vec_id", "v"))
    n_blocks = sum(-(-n // LIST_ROWS) for n in counts.values())
    block = F.pmod(F.xxhash64("row"), blocks[F.col("list")]).cast("int")
    candidates = listed.select("row", "vec_id", "v", "list", block.alias("block"), F.lit(0).alias("asks"))

    def nearest_of(some: DataFrame, probed: int) -> DataFrame:
        asked = (
            some.mapInArrow(_probe(middle, probed), kinds).withColumn("list", F.explode("lists")).drop("lists")
            .where(blocks[F.col("list")] > 0)
            .select("row", "vec_id", "v", "list", F.explode(F.sequence(F.lit(0), blocks[F.col("list")] - 1)).alias("block"), F.lit(1).alias("asks"))
        )
        # As many partitions as blocks: what counts is the pairs of a block, not its bytes.
        both = candidates.unionByName(asked).repartition(min(MOST_TASKS, n_blocks), "list", "block").sortWithinPartitions("list", "block", "asks")
        found = both.mapInArrow(_search(turn, k), "qrow long, query_id long, vec_id long, score double")
        best = Window.partitionBy("qrow").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    probed = probes_for(fitted, middle, k, TARGET)
    found = durable(nearest_of(queries, probed))
    if probed < lists:
        full = found.groupBy("qrow").count().where(F.col("count") >= min(k, n - 1))
        short = durable(queries.join(full.select(F.col("qrow").alias("row")), "row", "left_anti"))
        if short.head(1):
            rest = nearest_of(short, lists)
            found = found.join(short.select(F.col("row").alias("qrow")), "qrow", "left_anti").unionByName(rest)
    return found.select("query_id", "rank", "vec_id", "score")
