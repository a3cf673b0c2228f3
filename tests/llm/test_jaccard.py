import random

import numpy as np
import pytest

from episodica.llm import jaccard
from tests.llm.conftest import SCHEMA, messy_rows, prose


def sets(rows, width):
    out = []
    for doc_id, text in rows:
        found = (text or "").encode().lower().split()
        grams = {tuple(found[i : i + width]) for i in range(len(found) - width + 1)} or ({tuple(found)} if found else set())
        out.append((doc_id, frozenset(grams)))
    return out


def brute(rows, width, threshold):
    """(doc_id, size, component) of all rows, by comparing all pairs."""
    own = sets(rows, width)
    root = list(range(len(own)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(own):
        for j in range(i):
            common = len(a & own[j][1])
            if a and 100 * common >= threshold * (len(a) + len(own[j][1]) - common) and common:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(own):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(own)), key=str)


def run(spark, scratch, name, rows, width, threshold):
    path = str(scratch / f"{name}.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    got = jaccard.linked(spark.read.parquet(path), width, threshold).collect()
    return sorted((tuple(r) for r in got), key=str)


def copies(seed, n, edits, length):
    """Near copies of one text, each with its own changed words; some are copies of copies."""
    r, texts = random.Random(seed), [prose(seed, length).split()]
    for _ in range(n):
        text = list(r.choice(texts[-6:] if r.random() < 0.7 else texts[:1]))
        for _ in range(r.randint(0, edits)):
            text[r.randrange(len(text))] = f"w{r.randrange(10**6)}"
        texts.append(text)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("width,threshold", [(3, 90), (5, 80), (1, 50)])
def test_groups_are_those_of_all_pairs(spark, scratch, width, threshold):
    texts = []
    for seed in range(6):
        texts += copies(seed, 25, 4, 90 + 30 * seed)
    passage = prose(77, 60)  # shared by many texts that do not link
    texts += [passage + " " + prose(500 + i, 100) for i in range(30)] + [prose(900 + i, 7) for i in range(10)]
    r = random.Random(2)
    r.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    assert run(spark, scratch, f"all-{width}-{threshold}", rows, width, threshold) == brute(rows, width, threshold)


def test_short_sets_at_the_border(spark, scratch):
    r = random.Random(8)
    rows = [(i, " ".join(r.sample("abcdefghijkl", r.randint(1, 12)))) for i in range(150)]
    assert run(spark, scratch, "border", rows, 1, 80) == brute(rows, 1, 80)
    assert run(spark, scratch, "border2", rows, 2, 60) == brute(rows, 2, 60)


def test_clusters_meet_through_members_only(spark, scratch):
    """Chains: neighbours link, leaders do not; members must be compared."""
    base = prose(31, 400).split()
    chain, text = [], list(base)
    for i in range(60):
        for k in range(5):
            text[(i * 5 + k) % 400] = f"c{i}x{k}"
        chain.append((i, " ".join(text)))
    assert run(spark, scratch, "chain", chain, 3, 90) == brute(chain, 3, 90)
    assert run(spark, scratch, "chain80", chain, 5, 80) == brute(chain, 5, 80)


def test_messy_rows(messy, empty):
    rows = [(r[0], r[1]) for r in messy_rows()]
    got = sorted((tuple(r) for r in jaccard.linked(messy, 3, 90).collect()), key=str)
    assert got == brute(rows, 3, 90)
    assert jaccard.linked(empty, 3, 90).count() == 0
    assert SCHEMA.split()[0] == "doc_id"


def test_one_of_each_keeps_every_column(messy, empty):
    out = jaccard.one_of_each(messy, 3, 90)
    assert out.columns == messy.columns
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    groups = brute(rows, 3, 90)
    assert out.count() == len({c for _, n, c in groups if n and c is not None}) + sum(not n for _, n, c in groups) + len({n for _, n, c in groups if n and c is None})
    kept = [r["doc_id"] for r in out.collect() if r["text"] and r["text"].split()]
    assert set(kept) == {c for _, n, c in groups if n}
    assert jaccard.one_of_each(empty, 3, 90).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    got = {x["node"]: x["root"] for x in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for start, other in near.items():
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        if len(seen) > 1:
            assert got[start] == min(seen)
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_do_not_depend_on_what_came_before():
    a, b = jaccard.Shingler(3), jaccard.Shingler(3)
    b("other words first, then more")
    text = "One two ONE two three É é"
    assert np.array_equal(a(text), b(text)) and len(a(text)) == 5
    assert len(a("one two")) == 1 and len(a("")) == len(a(None)) == len(a(" \n")) == 0
