import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from episodica.llm import conversations as C
from episodica.llm import queries

sys.setrecursionlimit(20_000)  # of the plain recursion below
LEGAL = re.compile(r"(s?(ua)+)?")
EMPTY = hashlib.sha256(b"").hexdigest()


def brute_path(marks):
    """(cost, audit) by plain recursion over suffixes: ``marks`` are (role letter, must go, truncated)."""
    n = len(marks)

    @lru_cache(None)
    def best(i, q, inserted):
        found = [(0, "")] if i == n and q in ("", "a") else []
        want = "a" if q == "u" else "u"
        if inserted < 2:
            found.append(add(3, "I", best(i, want, inserted + 1)))
        if i < n:
            letter, gone, cut = marks[i]
            found.append(add(4, "D", best(i + 1, q, 0)))
            if not gone:
                if letter == want or letter == "s" and q == "":
                    found.append(add(3 * cut, "K", best(i + 1, letter, 0)))
                found.append(add(3 + 3 * cut, "R", best(i + 1, want, 0)))
        return min(found, default=(10**9, ""))

    def add(cost, letter, then):
        return (then[0] + cost, letter + then[1])

    return best(0, "", 0)


def brute(rows):
    """The report of one conversation, rows in order: (turn, role, text)."""
    white, seen, marks, faults = "\x20\t\n\x0b\x0c\r", set(), [], []
    for _, role, text in rows:
        core = text.strip(white)
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        marks.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = brute_path(tuple(marks))
    out, at, last = [], 0, ""
    for e in audit:
        if e == "I":
            out.append(("assistant:" if last == "u" else "user:"))
            last = out[-1][0]
        else:
            _, role, text = rows[at]
            at += 1
            if e == "D":
                continue
            role = role if e == "K" else "assistant" if last == "u" else "user"
            out.append(f"{role}:{text}")
            last = role[0]
    assert LEGAL.fullmatch("".join(x[0] for x in out)), (rows, audit, out)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    sha = hashlib.sha256("\n".join(out).encode("utf-8", "surrogatepass")).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def grouped(rows):
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).append((turn, role, text))
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for k, v in found.items()}


def as_dict(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def marks_of(codes):
    return tuple((c.lower() if c.lower() in "sua" else "o", c == "x", c.isupper()) for c in codes)


@pytest.mark.parametrize("seed", range(6))
def test_cheapest_is_least_of_all(seed):
    r = random.Random(seed)
    for _ in range(250):
        codes = "".join(r.choice("xsuaoSUAO") for _ in range(r.randint(0, 9)))
        assert C.cheapest(codes) == brute_path(marks_of(codes)), codes


def test_known_repairs():
    assert C.cheapest("") == (0, "")
    assert C.cheapest("sua") == (0, "KKK")
    assert C.cheapest("ua" * 400) == (0, "KK" * 400)
    assert C.cheapest("u") == (3, "KI")
    assert C.cheapest("a") == (3, "IK")
    assert C.cheapest("s") == (4, "D")
    assert C.cheapest("x") == (4, "D")


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_pieces_chain_to_the_same_path(size):
    r = random.Random(size)
    for _ in range(120):
        codes = "".join(r.choice("xsuaouauaSUAO") for _ in range(r.randint(1, 16)))
        parts = [codes[i : i + size] for i in range(0, len(codes), size)]
        found = [C.between(p) for p in parts]
        costs, ranks = [], []
        for f in found:
            costs.append([f[p, q][0] if (p, q) in f else -1 for p in range(4) for q in range(4)])
            order = {p: sorted((f[p, q][1], q) for q in range(4) if (p, q) in f) for p in range(4)}
            ranks.append([order[p].index((f[p, q][1], q)) if (p, q) in f else 0 for p in range(4) for q in range(4)])
        cost, states = C.chain(costs, ranks)
        audit = "".join(f[p, q][1] for f, p, q in zip(found, states, states[1:])) + C.CLOSING[states[-1]]
        assert (cost, audit) == brute_path(marks_of(codes)), codes


def invented(seed, n, turns=9):
    r, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(r.randint(1, turns)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool"])
            rows.append((conv, turn * r.choice([1, 1, 2]), role, r.choice(["Yes.", "No?", "what", "", " \n", "long words here!  ", "Ä."])))
    return rows


def test_reports(spark):
    rows = [r for r in invented(1, 300)]
    rows = list({(c, t): (c, t, role, text) for c, t, role, text in rows}.values())
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    assert as_dict(C.report(df)) == {k: brute(v) for k, v in grouped(rows).items()}


@pytest.mark.parametrize("size", [1, 50, 2048])
def test_long_conversations_run_in_pieces(spark, size):
    r = random.Random(5)
    rows = [(1, t, r.choice(["user", "assistant", "user", "assistant", "system", "x"]), r.choice(["a.", "b!", "c", f"{t}.", f"{t}", ""])) for t in range(600)]
    rows += [(2, t, "ua"[t % 2] + "x", f"{t}?") for t in range(50)] + [(None, t, "user", "same.") for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    want = {k: brute(v) for k, v in grouped(rows).items()}
    assert as_dict(C.report(df, size)) == want
    pieces = C._solved(df, False, size)[1].where("conv_id = 1").count()
    assert pieces >= 600 // size


def test_repaired_turns(spark):
    rows = [(c, t, role, text) for c, t, role, text in invented(3, 60) if role]
    rows = list({(c, t): (c, t, role, text) for c, t, role, text in rows}.values())
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {}
    for r in C.repaired_turns(df).orderBy("conv_id", "piece", "place").collect():
        found.setdefault(r["conv_id"], []).append(r)
    for conv, (*_, audit, sha) in {k: brute(v) for k, v in grouped(rows).items()}.items():
        got = found.get(conv, [])
        assert "".join(r["edit"] for r in got) == audit
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in got if r["role"] is not None).encode()).hexdigest() == sha


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (7, None, "user", "Hi."), (7, None, "user", "Hi."), (7, 3, "", "x."), (7, 4, "assistant", "y" * 300_000 + "."),
        (8, -5, "user", "😀".encode("utf-16", "surrogatepass").decode("utf-16") + "?"), (8, 9223372036854775807, "assistant", "z!"), (9, None, "assistant", None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", *[f"'own' as {c}" for c in ("piece", "codes", "stats", "edits", "cost", "audit", "__at", "__no", "__mark", "__copy", "firsts")])
    plain = [tuple(" " if k > 1 and v is None else v for k, v in enumerate(r)) for r in rows]
    want = {k: brute(v) for k, v in grouped(plain).items()}
    want[8] = (2**63 - 1, *want[8][1:])
    assert as_dict(C.report(df)) == want
    none = df.where("false")
    assert C.report(none).count() == C.repaired_turns(none).count() == C.with_lost(C.report(none), none).count() == 0


def test_query_is_brute_force(spark, scratch):
    r = random.Random(11)
    rows = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice(["Yes.", "No", None, "Ends here. ", f"{t}!"])) for c in [*range(200), None] for t in range(r.randint(1, 8))]
    rows += [(1000 + k, k, "user", "alone.") for k in range(60)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).write.parquet(str(scratch / "conv" / "conversations.parquet"))
    got = queries.QUERIES["op11_conversations"](spark, str(scratch / "conv"))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert dict(got.dtypes)["gaps"] == dict(got.dtypes)["cost"] == "bigint"
    kept = grouped(brute_damage(rows))
    want = {c: brute(kept[c]) if c in kept else (0, 0, 0, 0, 0, 0, "", EMPTY) for c in {r[0] for r in rows}}
    assert as_dict(got) == want
    assert any(v[-1] == EMPTY for v in want.values())
    assert got.select(F.max("cost")).first()[0] > 0
