"""Language identification, words first (after the HeLI method of Jauhiainen, Lindén and Jauhiainen, 2016).

A word that the model knows scores by its logarithmic frequency in each language. Any other word falls back to its character n-grams:
to the longest n of which the model knows any, from ``LONGEST`` down to single letters, by the mean over its known n-grams. An entry
that a language has never seen gets one penalty, the same for all languages. A document's score is the sum over all its words and the logarithm of the
language's share of the training texts; its probabilities are those sums by a softmax.

Words are runs of letters, lower-cased; texts with combining marks are composed first. N-grams are those of the different words with a space at either
end, each word counting once: words that the model does not know are rare ones.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm.common import give_back, light, small_batches, tidied
from duelframe.llm.toxicity import held_out
from duelframe.storage import materialise

#: At most about so many labelled texts of each language are used for fitting, chosen by a hash of the text; equal ones count once.
FIT_ROWS = 2_000
#: A word or n-gram is known if the training texts have it so often.
LEAST = 2
LONGEST = 5
#: Occurrences that stand for none, in the largest language.
PENALTY = 0.5
UNKNOWN = "und"

#: Bytes of text whose words are looked up together; a longer text is looked up alone.
SLICE_BYTES = 4 << 20


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words of some texts, the number of each occurring word among them, in order, and how many words each text has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    loose = pc.match_substring_regex(texts, r"\pM")
    if pc.any(loose).as_py():
        texts = pa.array([unicodedata.normalize("NFC", t) if m else t for t, m in zip(texts.to_pylist(), loose.to_pylist(), strict=True)], pa.large_string())
    apart = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"\P{L}+", " "), " ")
    lists = pc.split_pattern(apart, " ")
    coded = lists.flatten().dictionary_encode()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    if "" in words:
        # a text without letters splits into one empty word
        at = at[np.array([w != "" for w in words])[at]]
        counts[pc.equal(pc.binary_length(apart), 0).to_numpy(zero_copy_only=False)] = 0
    return words, at, counts


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in pieces of about ``SLICE_BYTES``."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        done = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + SLICE_BYTES, "right")))
        yield texts.slice(begin, end - begin)
        begin = end


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word with a space at either end; for n = 1 its letters."""
    if n == 1:
        return list(word)
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Logarithmic frequencies: a row of ``words`` or ``grams`` has one per language."""

    langs: list[str] = field(default_factory=list)
    prior: np.ndarray = field(default_factory=lambda: np.zeros(0))
    word_rows: dict[str, int] = field(default_factory=dict)
    words: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    gram_rows: dict[str, int] = field(default_factory=dict)
    grams: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def backed_off(self, words: list[str]) -> np.ndarray:
        """Scores of words that are not known, a row each. Without a known letter all languages score 0."""
        known, rows, sizes = self.gram_rows.get, [], []
        for word in words:
            size = 0
            for n in range(min(LONGEST, len(word) + 2), 0, -1):
                found = [r for r in map(known, grams_of(word, n)) if r is not None]
                if found:
                    rows += found
                    size = len(found)
                    break
            sizes.append(size)
        size = np.array(sizes, np.int64)
        word_of = np.repeat(np.arange(len(words)), size)
        out = np.zeros((len(words), len(self.langs)))
        for i in range(len(self.langs)):
            out[:, i] = np.bincount(word_of, self.grams[rows, i] if rows else None, len(words)) / np.maximum(size, 1)
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and probability of each text."""
        words, at, counts = words_of(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        row = np.fromiter((self.word_rows.get(w, -1) for w in words), np.int64, len(words))
        scores = np.empty((len(words), len(self.langs)))
        scores[row >= 0] = self.words[row[row >= 0]]
        scores[row < 0] = self.backed_off([w for w, r in zip(words, row, strict=True) if r < 0])
        text = np.repeat(np.arange(len(texts)), counts)
        total = np.empty((len(texts), len(self.langs)))
        for i in range(len(self.langs)):
            total[:, i] = self.prior[i] + np.bincount(text, scores[at, i], len(texts))
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        some = counts > 0
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, share, 0.0)


def training_rows(docs: DataFrame, text: str, lang: str, key: str, limit: int) -> DataFrame:
    """(lang, text): different labelled texts that are not held out, at most about ``limit`` of each language; stored."""
    rows = docs.where(~held_out(F.col(key)) & F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    sizes = materialise(rows.groupBy("lang").agg(F.count("*").alias("_n")), "lang-sizes")
    share = F.lit(1_000_003.0 * limit) / F.col("_n")
    chosen = rows.join(light(sizes), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < share).select("lang", "text")
    return materialise(chosen.dropDuplicates(), "lang-training")


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of (lang, text); stored."""

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            begin = 0
            for texts in slices(batch.column(1)):
                words, at, counts = words_of(texts)
                of_text = lang.indices.to_numpy()[begin : begin + len(texts)].astype(np.int64)
                begin += len(texts)
                both, n = np.unique(np.repeat(of_text, counts) * max(len(words), 1) + at, return_counts=True)
                names = pa.array(words, pa.string()).take(pa.array(both % max(len(words), 1)))
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(both // max(len(words), 1))), names, pa.array(n, pa.int64())], ["lang", "word", "n"])

    parts = rows.select("lang", "text").mapInArrow(work, "lang string, word string, n long")
    return materialise(parts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, gram, n) over the different words of each language; stored."""

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, word in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.update((lang, gram) for n in range(1, LONGEST + 1) for gram in grams_of(word, n))
            if found:
                lang, gram = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram, pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "gram", "n"])

    parts = words.select("lang", "word").mapInArrow(work, "lang string, gram string, n long")
    return materialise(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lang-grams")


def _table(counts: DataFrame, unit: str, langs: list[str], kind) -> tuple[dict[str, int], np.ndarray]:
    """Rows of the known units and their logarithmic frequencies. Shares are those among units of one ``kind``."""
    known = counts.groupBy(unit).agg(F.sum("n").alias("_all")).where(F.col("_all") >= LEAST).select(unit)
    # what the bounded training texts have more than once
    got = counts.join(known, unit).select("lang", unit, "n").toArrow()
    sizes = {(r["lang"], r["kind"]): float(r["n"]) for r in counts.groupBy("lang", kind.alias("kind")).agg(F.sum("n").alias("n")).collect()}
    names = got[unit].combine_chunks().dictionary_encode()
    rows = {name: i for i, name in enumerate(names.dictionary.to_pylist())}
    of_kind = 0 if unit == "word" else np.array([len(name) for name in rows], int)
    largest = {k: max(v for (_, kk), v in sizes.items() if kk == k) for _, k in sizes}
    penalty = {k: math.log(PENALTY / v) for k, v in largest.items()}
    kinds = np.broadcast_to(of_kind, len(rows))
    table = np.repeat(np.array([penalty[int(k)] for k in kinds], float)[:, None], len(langs), axis=1)
    at = names.indices.to_numpy()
    place = {x: i for i, x in enumerate(langs)}
    column = np.array([place[x] for x in got["lang"].to_pylist()], int)
    size = np.array([[sizes.get((x, int(k)), 1.0) for x in langs] for k in range(LONGEST + 1)])
    table[at, column] = np.log(got["n"].to_numpy() / size[kinds[at], column])
    return rows, table


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", limit: int = FIT_ROWS) -> Model:
    """The model from the rows of ``docs`` with a language that are not held out. Without any it knows no language.

    The driver holds what a bounded number of texts has: their words and n-grams that occur ``LEAST`` times.
    """
    small_batches(docs.sparkSession)
    rows = training_rows(docs, text, lang, key, limit)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model()
    langs = sorted(sizes)
    prior = np.log(np.array([sizes[x] for x in langs], float) / sum(sizes.values()))
    words = word_counts(rows)
    parts = gram_counts(words)
    return Model(langs, prior, *_table(words, "word", langs, F.lit(0)), *_table(parts, "gram", langs, F.length("gram")))


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (its probability, 0 to 1); one row per row.

    Every row is predicted alone, from all words of its text, in time linear in its length. NULL and empty texts and texts without
    a letter are "und" with score 0, as are all texts if the model knows no language. Texts whose letters are all unknown get the
    commonest language; ties go to the smallest name. Equal texts get equal results. Columns of ``docs`` with the new names are
    replaced; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            found = [shared.value.predict(some) for some in slices(pa.array(texts, pa.string(), from_pandas=True))]
            yield pd.DataFrame({"lang": [x for langs, _ in found for x in langs], "score": np.concatenate([s for _, s in found]) if found else []})
        give_back()

    predicted = F.pandas_udf(work, "lang string, score double")
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    out = docs.select(*kept, predicted(F.col(text).cast("string")).alias("lang_pred"))
    return out.select(*kept, F.col("lang_pred.lang").alias("lang_pred"), F.col("lang_pred.score").alias("lang_score"))


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """Query op11_language_id: fitted on the documents that are not held out, applied to all."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    out = identified(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
