import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from episodica.llm import packing, tokenizing, tokens
from episodica.llm.tokenizing import Coder, Counter, kind
from tests.llm.conftest import prose

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def plain(path, texts):
    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


ODD = [
    "a  b", " a", "a ", "\n", "a\n b", "a \nb", "a\n\n\nb", "a\t\tb  ", "it's I'LL we're", "x<|endoftext|>y <|endoftext|> z",
    "  <|endoftext|>  ", " a b　c", "\x1ca\x1d b", "᠎a ​b", "́a ́b é", "İSTANBUL ΣΣ ﬁ",
    "12 3 45.6 %%% a&b", "\U0001f600 \U0001f468‍\U0001f469", "\r\n x\r\ny", "<|startoftext|> A<|endoftext|>",
]


def test_kinds():
    assert (kind(BYTES), kind(WORDS)) == ("bytes", "words")


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_give_what_the_library_gives(path):
    texts = [*ODD, prose(1, 3000), None, ""]
    assert Counter(path)(texts) == [len(i) for i in plain(path, texts)]
    code = Coder(path)
    for _ in range(2):  # the second time from what is kept
        got = [[int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)] for b in code(texts)]
        assert got == plain(path, texts)


def test_full_store_of_pieces(monkeypatch):
    monkeypatch.setattr("episodica.llm.tokenizing.KEPT_PIECES", 50)
    texts = [prose(i, 200) for i in range(5)]
    count = Counter(BYTES)
    assert [count([t])[0] for t in texts] == [len(i) for i in plain(BYTES, texts)]


@pytest.mark.parametrize("chunk,overlap", [(300, 64), (1000, 100), (5000, 300)])
def test_huge_texts_are_spliced(spark, chunk, overlap):
    texts = [
        prose(3, 900), "word" * 3000, " " * 4000 + "x", ("ab  \n" * 900) + "<|endoftext|>" * 200, "é\U0001f600 " * 1500,
        prose(4, 300) + "1" * 2500 + prose(5, 300), "it's " * 900, "a" * 5001 + " " + "b" * 5001, "\x1c" + prose(6, 500),
    ]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, text string")
    got = {r["key"]: r["n_tokens"] for r in tokens.count_huge(df, BYTES, chunk, overlap).collect()}
    assert [got[str(i)] for i in range(len(texts))] == [len(x) for x in plain(BYTES, texts)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_white_space_around_special_strings(path):
    gaps = ["", " ", "\n", "\n\n", "  ", " \n", "\n ", "\t\t\n", "\r\n\r\n", "   \n\n\n"]
    texts = [f"abc{a}<|endoftext|>{b}d{a}<|endoftext|><|endoftext|>{b}" for a in gaps for b in gaps] + ["x <|endoftext| >\n\n<|endo", "<|<|endoftext|>."]
    ids = plain(path, texts)
    assert Counter(path)(texts) == [len(i) for i in ids]
    assert [[int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)] for b in Coder(path)(texts)] == ids


def test_special_strings_on_both_sides_of_the_switch(spark):
    some = "abc\n\n<|endoftext|> d  \n<|endoftext|>\n\n"
    texts = [(some * 2000)[:n] for n in (500, tokens.CHUNK - 1, tokens.CHUNK, tokens.CHUNK + 1, 2 * tokens.CHUNK)]
    got = tokens.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTES, 50)
    want = {i: len(x) for i, x in enumerate(plain(BYTES, texts))}
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == want


def test_messy_rows(messy, empty):
    got = tokens.token_counts(messy, BYTES, 50, chunk=2000, overlap=100).collect()
    rows = messy.select("doc_id", "text").collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(i), len(i) > 50) for r, i in zip(rows, plain(BYTES, [r["text"] for r in rows]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokens.token_counts(empty, BYTES, 50).count() == 0


def test_packing_covers_every_id_once(messy, empty):
    import zlib

    import numpy as np

    pieces = [r.asDict() for r in packing.pack(messy, WORDS, 2, length=256).collect()]
    rows = messy.select("doc_id", "text").collect()
    by_doc = {}
    for r, ids in zip(rows, plain(WORDS, [r["text"] for r in rows])):
        by_doc.setdefault((r["doc_id"], len(ids) + 1), []).append(np.array(ids + [2], dtype="<u4"))
    got = {}
    for p in pieces:
        got.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    assert got.keys() == by_doc.keys()
    for key, docs in by_doc.items():
        assert sum(p["length"] for p in got[key]) == key[1] * len(docs)
        if len(docs) == 1:
            at = 0
            for p in sorted(got[key], key=lambda p: p["start"]):
                assert p["start"] == at
                assert p["ids_crc32"] == zlib.crc32(docs[0][at : at + p["length"]].tobytes())
                at += p["length"]
    seqs = {}
    for p in pieces:
        seqs.setdefault(p["sequence_id"], []).append(p)
    for seq in seqs.values():
        at = 0
        for p in sorted(seq, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 256 and at & (at - 1) == 0
    assert packing.pack(empty, WORDS, 2).count() == 0


def test_costs_are_balanced():
    lengths = [2000, 1500, 900, 700, 650, 500, 400, 300, 200, 100, 90, 80, 70, 60, 50, 592]
    rooms = [4096, 4096]
    out = packing.assign(lengths, rooms)
    cost = [sum(packing.cost(n) for _, _, n, at in out if at == s) for s in (0, 1)]
    assert abs(cost[0] - cost[1]) < 0.2 * max(cost)
    assert all(sum(n for _, _, n, at in out if at == s) == 4096 for s in (0, 1))


@pytest.mark.parametrize("name, with_ids", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_store_forgets_only_what_does_not_come_again(name, with_ids):
    store = tokenizing.Pieces(public_tokenizers.path(name), with_ids, kept=2000)
    library, r = tokenizing.load(public_tokenizers.path(name)), random.Random(1)
    common, asked = [f"{c}xz" for c in "abcdefghij"] + [",", "x.", "|", "a|b", "", "\n", " ", "q" * 60], 0
    for _ in range(40):
        batch = common + ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) + r.choice(["", ",", "."]) for _ in range(600)]
        found = store.known([batch[:300], batch[300:]])
        for p in batch:
            ids = library.encode(p, add_special_tokens=False).ids
            assert found[p] == (np.asarray(ids, dtype="<u4").tobytes() if with_ids else len(ids)), p
        assert len(store.large.keys) <= 2000 + 1700 and len(store.old.keys) <= 2000 + 1700 and "abc" * 20 not in found
        asked += len(set(batch))
    assert store.encoded < asked
    before = store.encoded
    store.known([["axz", "bxz", ",", "x."]])
    assert store.encoded == before
