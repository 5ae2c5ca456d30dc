"""Language identification: accuracy on rows that were held out, and the stated cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from duelframe.llm import languages
from tests.llm.conftest import as_folder

COLUMNS = "doc_id long, text string, lang string, lang_pred string, held_out string, n long"


def speech(rng: random.Random, letters: str, n: int) -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def labelled(spark, rows):
    return spark.createDataFrame([(i, t, g, "clash", "clash", 1) for i, (t, g) in enumerate(rows)], COLUMNS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    kinds = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnéß"}
    out = [(speech(rng, kinds[lang], rng.randint(3, 60)), lang) for lang in kinds for _ in range(80)]
    rng.shuffle(out)
    return out


def test_held_out_accuracy_on_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in languages.digest(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    assert all(got[d["doc_id"]]["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2) for d in docs)
    right = sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held)
    assert right >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_model_has_frequencies_of_plain_counts(spark, rows):
    docs = labelled(spark, rows)
    model = languages.fit(docs)
    kept = {(t, g) for i, (t, g) in enumerate(rows) if zlib.crc32(str(i).encode()) % 4 != 2}
    totals, words = {}, {}
    for text, lang in kept:
        for w in text.split():
            totals[lang] = totals.get(lang, 0) + 1
            words.setdefault(w, {}).setdefault(lang, 0)
            words[w][lang] += 1
    known = {w: c for w, c in words.items() if sum(c.values()) >= 2}
    assert set(model.word_rows) == set(known)
    penalty = np.log(0.5 / max(totals.values()))
    for w, counts in known.items():
        want = [np.log(counts[g] / totals[g]) if g in counts else penalty for g in model.langs]
        assert np.allclose(model.words[model.word_rows[w]], want)
    types = {}
    for w, counts in words.items():
        for lang in counts:
            for n in range(1, languages.LONGEST + 1):
                for gram in languages.grams_of(w, n):
                    key = (lang, gram)
                    types[key] = types.get(key, 0) + 1
    sizes = {}
    for (lang, gram), n in types.items():
        sizes[lang, len(gram)] = sizes.get((lang, len(gram)), 0) + n
    for gram, row in model.gram_rows.items():
        most = max(v for (_, n), v in sizes.items() if n == len(gram))
        want = [np.log(types[g, gram] / sizes[g, len(gram)]) if (g, gram) in types else np.log(0.5 / most) for g in model.langs]
        assert np.allclose(model.grams[row], want)


def test_backs_off_to_shorter_grams():
    model = languages.Model(["aa", "bb"], np.zeros(2), {"known": 0}, np.array([[-1.0, -9.0]]), {" ab": 0, "b": 1, "z": 2}, np.array([[-5.0, -1.0], [-2.0, -3.0], [-4.0, -1.0]]))
    assert model.backed_off(["ab", "bz", "q"]).tolist() == [[-5.0, -1.0], [-3.0, -2.0], [0.0, 0.0]]
    assert model.backed_off([]).shape == (0, 2)
    langs, scores = model.predict(pa.array(["known", "ab Known known", "q", None, "ab", "5 \u0301"]))
    assert langs == ["aa", "aa", "aa", "und", "bb", "und"]
    assert scores[2] == 0.5 and scores[3] == scores[5] == 0 and scores[1] == pytest.approx(1 / (1 + np.exp(-12)))


def test_words_are_runs_of_letters_in_composed_form():
    texts = pa.array(["Über u\u0308ber, x²y", None, "", " 12 ", "a", "Ab-ab\nAB"])
    words, at, counts = languages.words_of(texts)
    assert counts.tolist() == [4, 0, 0, 0, 1, 3]
    assert [words[i] for i in at] == ["über", "über", "x", "y", "a", "ab", "ab", "ab"]


def test_odd_texts(spark, rows):
    model = languages.fit(labelled(spark, rows))
    long = speech(random.Random(9), "ijklmnéß", 40_000)
    odd = [(None, "aa"), ("", None), (" \n\t", "aa"), ("12 ²³ ½ Ⅷ_!", "aa"), ("日本語", None), (long, "aa"), ("n" * 300_000, None), ("MNÉẞ²ijkl", None), ("mné ßijk", None)]
    got = [r for r in languages.identified(labelled(spark, odd), model).orderBy("doc_id").collect()]
    assert [r["lang_pred"] for r in got] == ["und"] * 4 + [got[4]["lang_pred"]] + ["cc"] * 4
    assert got[4]["lang_pred"] in ("aa", "bb", "cc")
    assert [r["lang_score"] for r in got[:4]] == [0.0] * 4
    assert [r["held_out"] for r in got] == ["clash"] * 9


def test_without_languages_or_rows(spark, tmp_path):
    none = languages.fit(labelled(spark, [("some text", None), (None, "aa")]))
    assert [r["lang_pred"] for r in languages.identified(labelled(spark, [("some text", "aa")]), none).collect()] == ["und"]
    folder = as_folder(tmp_path, documents=labelled(spark, []))
    assert languages.digest(spark, folder).count() == 0


def test_sample_is_bounded(spark):
    rows = [(f"text number {'x' * (i % 50)} {i}", "aa") for i in range(4000)] + [("copy", "aa")] * 2000
    n = languages.training_rows(labelled(spark, rows), "text", "lang", "doc_id", 300).count()
    assert 100 < n < 420
