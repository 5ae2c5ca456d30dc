from __future__ import annotations

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, verdict string, size long, n long, a long, rid long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def document(key, text, source="s"):
    """A row of documents with further columns whose names operators use themselves."""
    return (key, text, "en", source, len(text or ""), 0.5, 99, "x", 7, 8, 9, 10)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """NULLs in every column, empty, blank and very long texts, repeated rows, copies and near copies."""
    rng = random.Random(3)
    base = sentence(rng, 120)
    words = base.split(" ")
    near = [" ".join(words[:i] + ["zz"] + words[i + 1 :]) for i in (5, 40, 80, 110)]
    rows = [document(i, sentence(rng, rng.randint(1, 60)), f"s{i % 4}") for i in range(40)]
    rows += [document(100 + i, t) for i, t in enumerate(near)] + [document(90, base), document(91, base.upper())]
    rows += [document(200, base), document(200, base)]
    rows += [document(300, ""), document(301, None), document(302, " \n\t "), document(303, "one"), document(304, "One"), document(305, "two words")]
    rows += [document(306, sentence(rng, 30_000)), document(None, "no id here at all"), document(400, base, None), (401,) + (None,) * 11]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], COLUMNS)


def as_folder(tmp_path, **tables) -> str:
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
