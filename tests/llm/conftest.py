import random

import pytest

EXTRA = "row shard slot place block period key counts idx at n_tokens score sid root list file span words line".split()


def prose(seed: int, n: int) -> str:
    """Invented words, so texts of different seeds share next to nothing."""
    r = random.Random(seed)
    return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))


def messy_rows():
    """Nulls, empty and very long texts, ties, repeated rows, odd characters."""
    base = [prose(i, 80) for i in range(12)]
    texts = [
        None, "", " \n\t ", "one", "a b", *base, base[0], base[0], base[1] + " extra", base[2].upper(),
        "x  y\n\n z w <|endoftext|> it's 123 é́ \U0001f600\x1cend", prose(99, 9000), "word" * 30_000, " " * 5000 + "end",
        "\n".join(["same line here"] * 40), prose(5, 30) + "\r\n" + prose(6, 30),
    ]
    rows = [(i, t, ["en", "fr", None, "xx"][i % 4], [None, "s1", "s2", "s1"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [(7, base[2], "en", "s1", 3), (7, base[2], "en", "s1", 3), (None, base[3], "en", None, 1), (None, None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def scratch(tmp_path_factory):
    return tmp_path_factory.mktemp("llm")


@pytest.fixture(scope="session")
def messy(spark, scratch):
    """A table in several files, with columns whose names operators might use themselves."""
    path = str(scratch / "messy.parquet")
    df = spark.createDataFrame(messy_rows(), SCHEMA)
    df = df.selectExpr("*", *[f"'own' as {c}" for c in EXTRA])
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, scratch):
    path = str(scratch / "empty.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
