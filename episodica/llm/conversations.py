"""Repair the turn structure of conversations by cheapest edits.

A conversation is legal when the first letters of its roles read ``(s?(ua)+)?``. Its turns,
in order, are kept, given another role, deleted, or get empty turns inserted between them.
States of the edit lattice are (turns used, what the legal form expects next); edges are
edits. A forward and a reverse heap walk the lattice until no cheaper crossing is left, all
crossings of the least cost are compared, and the one of least concatenated audit wins.

Turns are range-partitioned once by conversation and turn. A task streams its partition and
solves each conversation that lies wholly in it. The first and the last one of a partition,
and long ones, come out as pieces of bounded size: each piece is solved between every pair
of states, the pieces of a conversation are chained by cost, and each is then repaired
between the states it got. So a conversation of any length runs in many tasks. Only its
SHA-256, which is a chain by nature, is taken by one task, from the bytes of whole pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import session
from episodica.session import durable

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
PIECE_ROWS, PIECE_BYTES = 2048, 4 << 20
LARGEST = (1 << 63) - 1

# States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# The turn of user or assistant that each state can take, and the state after it.
NEXT = [("u", USER), ("u", USER), ("a", ASSISTANT), ("u", USER)]
# Inserts that complete a conversation which ends in a state.
CLOSING = ["", "II", "I", ""]
LEGAL_PAIRS = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}


def code(role: str, fault: str) -> str:
    """One letter for what edits may do to a turn: its role's first letter, if legal, and its fault."""
    if fault in ("blank", "duplicate"):
        return "x"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return letter.upper() if fault == "truncated" else letter


class _Search:
    """One heap over the lattice of ``codes``, from ``ends``, forward or in reverse.

    ``best`` holds the cost and least audit found for a state, ``done`` the states whose cost
    is final. States of equal cost are taken in lattice order, so their audits are final too:
    an edge of cost 0 uses a turn up. Two audits of equal cost at one state are never
    prefixes of each other, so the least one stays least whatever is joined to it.
    """

    def __init__(self, codes: str, ends: list[tuple[int, int]], reverse: bool, tail: bool):
        self.codes, self.reverse, self.tail = codes, reverse, tail
        self.best, self.ends = {node: (0, "") for node in ends}, len(ends)
        self.done: dict[tuple[int, int], tuple[int, str]] = {}
        self.heap = [(0, -i if reverse else i, q) for i, q in ends]
        heapify(self.heap)

    def top(self) -> float:
        while self.heap and (abs(self.heap[0][1]), self.heap[0][2]) in self.done:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def step(self) -> list[tuple[tuple[int, int], int]]:
        """Take one state; gives its neighbours with the cost of reaching them."""
        cost, i, q = heappop(self.heap)
        node = (abs(i), q)
        _, audit = self.done[node] = self.best[node]
        found = []
        for other, extra, letter in (_into if self.reverse else _out_of)(self.codes, *node, self.tail):
            reached = (cost + extra, letter + audit if self.reverse else audit + letter)
            old = self.best.get(other)
            if old is None or reached < old:
                self.best[other] = reached
                if old is None or reached[0] < old[0]:
                    heappush(self.heap, (reached[0], -other[0] if self.reverse else other[0], other[1]))
            found.append((other, reached[0]))
        return found


def _edits(mark: str, q: int) -> list[tuple[int, int, str]]:
    """(state after, cost, letter) of the edits that use up a turn in state ``q``."""
    out = [(q, DELETE, "D")]
    if mark != "x":
        more = TRUNCATED if mark.isupper() else 0
        kept = AFTER.get((q, mark.lower()))
        if kept is not None:
            out.append((kept, more, "K"))
        out.append((NEXT[q][1], REROLE + more, "R"))
    return out


_OUT = {(mark, q): _edits(mark, q) for mark in "xsuaoSUAO" for q in range(4)}
_IN = {
    (mark, q): [(p, cost, letter) for p in range(4) for to, cost, letter in _OUT[mark, p] if to == q]
    for mark in "xsuaoSUAO" for q in range(4)
}
_INSERTED = [[p for p in range(4) if NEXT[p][1] == q] for q in range(4)]


def _out_of(codes: str, i: int, q: int, tail: bool):
    if i < len(codes):
        for to, cost, letter in _OUT[codes[i], q]:
            yield (i + 1, to), cost, letter
    if tail or i < len(codes):
        yield (i, NEXT[q][1]), INSERT, "I"


def _into(codes: str, i: int, q: int, tail: bool):
    if i:
        for p, cost, letter in _IN[codes[i - 1], q]:
            yield (i - 1, p), cost, letter
    if tail or i < len(codes):
        for p in _INSERTED[q]:
            yield (i, p), INSERT, "I"


def _meet(forward: _Search, reverse: _Search) -> tuple[int, str] | None:
    """Least cost between the ends of two searches, and its least audit; both may have run before."""
    for search in (forward, reverse):
        while len(search.done) < search.ends:
            search.step()
    least = min((c + reverse.best[n][0] for n, (c, _) in forward.best.items() if n in reverse.best), default=float("inf"))
    while True:
        a, b = forward.top(), reverse.top()
        if a + b > least or a + b == float("inf"):
            break
        one, two = (forward, reverse) if a <= b else (reverse, forward)
        for node, cost in one.step():
            if node in two.best:
                least = min(least, cost + two.best[node][0])
    if least == float("inf"):
        return None
    audits = []
    for node, (cost, audit) in forward.done.items():
        if node in reverse.done and cost + reverse.done[node][0] == least:
            audits.append(audit + reverse.done[node][1])
        for other, extra, letter in _out_of(forward.codes, *node, forward.tail):
            if other in reverse.done and cost + extra + reverse.done[other][0] == least:
                audits.append(audit + letter + reverse.done[other][1])
    return int(least), min(audits)


def cheapest(codes: str) -> tuple[int, str]:
    """Cost and audit of the cheapest edits that make a whole conversation legal."""
    n = len(codes)
    return _meet(_Search(codes, [(0, START)], False, True), _Search(codes, [(n, START), (n, ASSISTANT)], True, True))


_cheapest_short = lru_cache(maxsize=50_000)(cheapest)


def between(codes: str) -> dict[tuple[int, int], tuple[int, str]]:
    """The same for a piece, between every two states that edits connect; no insert after its last turn."""
    forward = [_Search(codes, [(0, p)], False, False) for p in range(4)]
    reverse = [_Search(codes, [(len(codes), q)], True, False) for q in range(4)]
    found = {(p, q): _meet(forward[p], reverse[q]) for p in range(4) for q in range(4)}
    return {k: v for k, v in found.items() if v is not None}


def applied(audit: str, turns: list[tuple[str, str]], state: int = START) -> list[tuple[str, str | None, str | None]]:
    """(edit, role, text) of each edit; a deleted turn has neither role nor text."""
    out, at = [], 0
    for letter in audit:
        if letter == "D":
            out.append(("D", None, None))
            at += 1
            continue
        role, text = turns[at] if letter != "I" else ("", "")
        if letter == "K":
            state = AFTER[state, role[:1]]
        else:
            role, state = NAMES[NEXT[state][0]], NEXT[state][1]
        at += letter != "I"
        out.append((letter, role, text))
    return out


def joined(edits: list[tuple[str, str | None, str | None]]) -> bytes:
    return "\n".join(f"{role}:{text}" for _, role, text in edits if role is not None).encode("utf-8", "surrogatepass")


def first_fault(role: str, text: str, seen: bool) -> str:
    core = text.rstrip(SPACE)
    if not core:
        return "blank"
    return "duplicate" if seen else "" if core[-1] in ".!?" else "truncated"


def _digest(role: str, text: str) -> bytes:
    """Stands for a turn's role and text wherever they are compared."""
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


class _Stats:
    """Counts over turns that come in order; joins with those of the turns that follow."""

    NAMES = ("low", "high", "distinct", "first_turn", "last_turn", "blank", "duplicate", "truncated", "illegal", "first_role", "last_role")

    def __init__(self, turns: list[int | None], roles: list[str], faults: list[str]):
        known = [t for t in turns if t is not None]
        self.low, self.high = (known[0], known[-1]) if known else (None, None)
        self.first_turn, self.last_turn = self.low, self.high
        self.distinct = len(set(known))
        self.blank, self.duplicate, self.truncated = (faults.count(f) for f in ("blank", "duplicate", "truncated"))
        self.first_role, self.last_role = (roles[0][:1], roles[-1][:1]) if roles else (None, None)
        self.illegal = sum(a[:1] + b[:1] not in LEGAL_PAIRS for a, b in zip(roles, roles[1:]))

    @classmethod
    def of(cls, values) -> _Stats:
        self = cls.__new__(cls)
        for name, value in zip(cls.NAMES, values):
            setattr(self, name, value)
        return self

    def values(self) -> list:
        return [getattr(self, n) for n in self.NAMES]

    def join(self, then: _Stats) -> _Stats:
        out = _Stats.of(self.values())
        out.illegal += then.illegal + (self.last_role + then.first_role not in LEGAL_PAIRS)
        for n in ("blank", "duplicate", "truncated"):
            setattr(out, n, getattr(self, n) + getattr(then, n))
        out.last_role = then.last_role
        if then.distinct:
            same = self.distinct and self.last_turn == then.first_turn
            out.distinct = self.distinct + then.distinct - bool(same)
            out.low = then.low if self.low is None else self.low
            out.first_turn = then.first_turn if self.first_turn is None else self.first_turn
            out.high, out.last_turn = then.high, then.last_turn
        return out

    def gaps(self) -> int:
        return min(LARGEST, self.high - self.low + 1 - self.distinct) if self.distinct else 0


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_EDIT = "array<struct<edit:string,role:string,text:string>>"


def _report(stats: _Stats, cost: int, audit: str, sha: str) -> list:
    return [stats.gaps(), stats.blank, stats.duplicate, stats.truncated, stats.illegal, cost, audit, sha]


def _whole(turns: list, roles: list[str], texts: list[str]) -> tuple[list, list]:
    """Report and edits of a conversation at hand."""
    seen, faults = set(), []
    for role, text in zip(roles, texts):
        faults.append(first_fault(role, text, (role, text) in seen))
        seen.add((role, text))
    codes = "".join(map(code, roles, faults))
    cost, audit = (_cheapest_short if len(codes) <= 64 else cheapest)(codes)
    edits = applied(audit, list(zip(roles, texts)))
    return _report(_Stats(turns, roles, faults), cost, audit, hashlib.sha256(joined(edits)).hexdigest()), edits


def _fields(spec: str) -> list[str]:
    return [f.split()[0] for f in spec.split(", ")]


def _arrow(spec: str, key: pa.DataType) -> pa.Schema:
    kinds = {
        "long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
        "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
        _EDIT: pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])),
    }
    return pa.schema([("conv_id", key), *[(f.split()[0], kinds[f.split()[1]]) for f in spec.split(", ")]])


class _Out:
    """Rows for Arrow, given out in batches of bounded size."""

    def __init__(self, spec: str, key: pa.DataType):
        self.schema, self.rows, self.weight = _arrow(spec, key), [], 0

    def add(self, row: list, weight: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.weight += weight
        if len(self.rows) >= 1000 or self.weight >= PIECE_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)]
            self.rows, self.weight = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


_CUT = f"piece long, turns array<long>, roles array<string>, texts array<string>, {_REPORT}, edits {_EDIT}"


def _cut(with_edits: bool, piece_rows: int):
    """Conversations that lie wholly in a sorted partition are finished, all others come out as pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, piece = None, TaskContext.get().partitionId() << 33
        held: tuple[list, list, list] = ([], [], [])
        current, weight, whole, bare = None, 0, False, [None] * len(_fields(_REPORT))

        def emit(complete: bool) -> Iterator[pa.RecordBatch]:
            nonlocal piece, weight
            if complete:
                report, edits = _whole(*held)
                yield from out.add([current, None, None, None, None, *report, edits if with_edits else None], weight if with_edits else 0)
            else:
                yield from out.add([current, piece, *map(list, held), *bare, None], weight)
                piece += 1
            for part in held:
                part.clear()
            weight = 0

        for batch in batches:
            key = batch.schema.field("conv_id").type
            out = out or _Out(_CUT, key)
            for conv, turn, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text"))):
                if held[0] and conv != current:
                    yield from emit(whole)
                    whole = True  # it begins after another one, so it begins here
                elif held[0] and (len(held[0]) >= piece_rows or weight >= PIECE_BYTES):
                    yield from emit(False)
                    whole = False
                current = conv
                for part, value in zip(held, (turn, role, text)):
                    part.append(value)
                weight += len(text)
        if held[0]:
            yield from emit(False)
        if out:
            yield from out.rest()

    return run


def _local_firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first place of each turn's digest in its piece; blank turns are faulty for another reason."""
    for batch in batches:
        out = _Out("digest binary, piece long, at int", batch.schema.field("conv_id").type)
        for conv, piece, roles, texts in zip(*(batch[c].to_pylist() for c in ("conv_id", "piece", "roles", "texts"))):
            first: dict[bytes, int] = {}
            for at, (role, text) in enumerate(zip(roles, texts)):
                if text.strip(SPACE):
                    first.setdefault(_digest(role, text), at)
            for digest, at in first.items():
                yield from out.add([conv, digest, piece, at])
        yield from out.rest()


_SOLVED = "piece long, codes string, stats array<long>, first_role string, last_role string, costs array<int>, ranks array<int>"


def _solve_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes, counts, and the cost between all states of each piece; ranks order the audits from one state."""
    for batch in batches:
        out = _Out(_SOLVED, batch.schema.field("conv_id").type)
        for conv, piece, turns, roles, texts, firsts in zip(*(batch[c].to_pylist() for c in ("conv_id", "piece", "turns", "roles", "texts", "firsts"))):
            fresh = set(firsts or ())
            faults = [first_fault(role, text, at not in fresh) for at, (role, text) in enumerate(zip(roles, texts))]
            codes = "".join(map(code, roles, faults))
            stats, found = _Stats(turns, roles, faults), between(codes)
            costs, ranks = [-1] * 16, [0] * 16
            for p in range(4):
                order = sorted((found[p, q][1], q) for q in range(4) if (p, q) in found)
                for rank, (_, q) in enumerate(order):
                    costs[4 * p + q], ranks[4 * p + q] = found[p, q][0], rank
            yield from out.add([conv, piece, codes, stats.values()[:9], stats.first_role, stats.last_role, costs, ranks], len(codes))
        yield from out.rest()


def chain(costs: list[list[int]], ranks: list[list[int]]) -> tuple[int, list[int]]:
    """Least cost over the pieces of a conversation, and the states between them (one more than pieces).

    Worked out from the last piece: from a state, the end state of least cost, and of those
    the one whose audit in this piece is least. Such audits are never prefixes of each other.
    """
    after, choices = [len(c) * INSERT for c in CLOSING], []
    for cost, rank in zip(reversed(costs), reversed(ranks)):
        best = [min(((cost[4 * p + q] + after[q], rank[4 * p + q], q) for q in range(4) if cost[4 * p + q] >= 0), default=None) for p in range(4)]
        choices.append([b and b[2] for b in best])
        after = [b[0] if b else 1 << 60 for b in best]
    states = [START]
    for choice in reversed(choices):
        states.append(choice[states[-1]])
    return after[START], states


_PATH = "piece long, codes string, enter int, leave int, is_last int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _chained(table: pa.Table) -> pa.Table:
    """The states each piece of one conversation runs between; the last piece carries the counts of all."""
    rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
    stats = None
    for r in rows:
        one = _Stats.of([*r["stats"], r["first_role"], r["last_role"]])
        stats = stats.join(one) if stats else one
    cost, states = chain([r["costs"] for r in rows], [r["ranks"] for r in rows])
    counts, bare, last = _report(stats, cost, "", "")[:6], [None] * 6, len(rows) - 1
    made = [
        [r["conv_id"], r["piece"], r["codes"], states[k], states[k + 1], int(k == last), *(counts if k == last else bare)]
        for k, r in enumerate(rows)
    ]
    schema = _arrow(_PATH, table.schema.field("conv_id").type)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)


_DONE = "piece long, is_last int, part_audit string, part binary, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _repair_pieces(with_edits: bool):
    spec = _DONE + f", edits {_EDIT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Out(spec, batch.schema.field("conv_id").type)
            for r in batch.to_pylist():
                codes, ends = r["codes"], [(len(r["codes"]), r["leave"])]
                _, audit = _meet(_Search(codes, [(0, r["enter"])], False, False), _Search(codes, ends, True, False))
                audit += CLOSING[r["leave"]] if r["is_last"] else ""
                edits = applied(audit, list(zip(r["roles"], r["texts"])), r["enter"])
                part = joined(edits)
                counts = [r[n] for n in _fields(_REPORT)[:6]]
                yield from out.add([r["conv_id"], r["piece"], r["is_last"], audit, part, *counts, edits if with_edits else None], len(part))
            yield from out.rest()

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a conversation in order: the audit joined, the SHA-256 run on over their bytes."""
    out, audits, sha, filled = None, [], hashlib.sha256(), False
    for batch in batches:
        out = out or _Out(_REPORT, batch.schema.field("conv_id").type)
        for r in batch.to_pylist():
            audits.append(r["part_audit"])
            if r["part"]:
                sha.update(b"\n" + r["part"] if filled else r["part"])
                filled = True
            if r["is_last"]:
                audit = "".join(audits)
                yield from out.add([r["conv_id"], *[r[n] for n in _fields(_REPORT)[:6]], audit, sha.hexdigest()], len(audit))
                audits, sha, filled = [], hashlib.sha256(), False
    if out:
        yield from out.rest()


def _in_order(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text in order of conversation and turn, one shuffle."""
    tie = {"__at": F.xxhash64("text"), "__no": F.monotonically_increasing_id()}
    keys = ["conv_id", "turn", "role", "__at", "__no"]
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    return rows.withColumns(tie).repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text")


def _solved(turns: DataFrame, with_edits: bool, piece_rows: int) -> tuple[DataFrame, DataFrame]:
    """Finished conversations, and the repaired pieces of the others."""
    session(turns.sparkSession)
    key = turns.schema["conv_id"].dataType.simpleString()
    head = f"conv_id {key}, "
    cut = durable(_in_order(turns.withColumn("turn", F.col("turn").cast("long"))).mapInArrow(_cut(with_edits, piece_rows), head + _CUT))
    finished, pieces = cut.where("piece is null"), cut.where("piece is not null").select("conv_id", "piece", "turns", "roles", "texts")
    firsts = (
        pieces.select("conv_id", "piece", "roles", "texts").mapInArrow(_local_firsts, head + "digest binary, piece long, at int")
        .groupBy("conv_id", "digest").agg(F.min(F.struct("piece", "at")).alias("first"))
        .groupBy(F.col("first.piece").alias("__piece")).agg(F.collect_list("first.at").alias("firsts"))
    )
    solved = durable(
        pieces.join(firsts, F.col("piece") == F.col("__piece"), "left").drop("__piece").mapInArrow(_solve_pieces, head + _SOLVED)
    )
    path = solved.groupBy("conv_id").applyInArrow(_chained, head + _PATH).withColumnsRenamed({"conv_id": "__conv", "piece": "__piece"})
    repaired = (
        pieces.select("conv_id", "piece", "roles", "texts").join(path, F.col("piece") == F.col("__piece")).drop("__conv", "__piece")
        .mapInArrow(_repair_pieces(with_edits), head + f"{_DONE}, edits {_EDIT}")
    )
    return finished, repaired


def report(turns: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text): faults, cost, audit, digest.

    Turns are taken in order of turn (null first; equal ones by role and the hash of the
    text), null roles and texts as one space. ``gaps`` is 0 without a turn number and stops at
    the largest long. A null conv_id is a conversation like others; an empty role is no legal
    one. Repeated rows are duplicates. Other columns are not read. An empty table gives no rows. The result does not depend on ``piece_rows``, the
    turns of a piece at most.
    """
    finished, repaired = _solved(turns, False, piece_rows)
    key = turns.schema["conv_id"].dataType.simpleString()
    order = [c for c in repaired.columns if c != "edits"]
    rest = (
        repaired.select(*order).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
        .mapInArrow(_finish, f"conv_id {key}, {_REPORT}")
    )
    return finished.select("conv_id", *_fields(_REPORT)).unionByName(rest)


def repaired_turns(turns: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The edits themselves: conv_id, piece, place, edit, role, text; deleted turns have null role and text.

    Order by conv_id, piece (null: the conversation is one piece) and place.
    """
    finished, repaired = _solved(turns, True, piece_rows)
    both = finished.select("conv_id", "piece", "edits").unionByName(repaired.select("conv_id", "piece", "edits"))
    return both.select("conv_id", "piece", F.posexplode("edits").alias("place", "e")).select("conv_id", "piece", "place", "e.*")


def _mark(conv_id: Column, turn: Column, kinds: int) -> Column:
    text = F.concat(F.coalesce(conv_id.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(kinds))


def damaged(turns: DataFrame, kinds: int = 20) -> DataFrame:
    """Turns with known damage, by the CRC-32 of ``conv_id:turn`` modulo ``kinds``.

    0 drops a turn, 1 empties its text, 2 removes ``[.!?]``, 3 repeats it, 4 sets the role user.
    Nulls are one space, also in the key.
    """
    rows = turns.select(
        "conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
        _mark(F.col("conv_id"), F.col("turn"), kinds).alias("__mark"),
    ).where("__mark <> 0")
    mark = F.col("__mark")
    text = F.when(mark == 1, F.lit("")).when(mark == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(mark == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(mark == 3, F.lit(2)).otherwise(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("__copy")).drop("__copy")


def with_lost(reports: DataFrame, turns: DataFrame) -> DataFrame:
    """``reports`` with a row of zeros for each conversation of ``turns`` that has none."""
    all_ids = turns.select(F.col("conv_id").alias("__id")).distinct()
    same = F.col("__id").eqNullSafe(F.col("conv_id"))
    bare = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    values = [F.coalesce(F.col(n), F.lit(bare.get(n, 0))).alias(n) for n in _fields(_REPORT)]
    return all_ids.join(reports, same, "left").select(F.col("__id").alias("conv_id"), *values)
