"""Toxic passages: maximum-scoring segments over token log-odds, judged by extreme-value statistics.

Training. Each word, and each word beginning, gets its log-odds of occurring in toxic against clean documents, with a
Dirichlet prior proportional to its overall frequency (Monroe, Colaresi and Quinn, 2008). Its score is the log-odds less one standard
error. Only words that pass a likelihood-ratio test at the level of one false word among all tested are kept, all others count as 0.

Scoring. From every word's score a small drift is taken, so that ordinary text loses and runs of bad words win. One linear scan
(Ruzzo and Tompa, 1999) finds all maximal scoring segments of the whole text. By extreme-value theory (Karlin and Altschul, 1990)
a clean text of n words has K n exp(-lambda S) segments of score S or more; lambda solves sum p(s) exp(lambda s) = 1 over the scores of clean text, K is
fitted to the segments of clean documents. The best segments of a document together have a probability in clean text
(Karlin and Altschul, 1993); minus its logarithm is the document's evidence, and a logistic curve maps it to 0..1.

The words are learned on all training rows; lambda, K and the curve come from rows that a first set of words has not seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm.common import give_back, small_batches, tidied
from duelframe.llm.near_copies import shingles
from duelframe.storage import materialise

#: At most about so many labelled rows are used for fitting, chosen by a hash of their id.
FIT_ROWS = 20_000
#: At most so many words and beginnings are kept, those with the highest likelihood ratios: the size of the model that tasks receive.
MODEL_TOKENS = 50_000
#: The prior's weight as a share of all counted tokens.
PRIOR_SHARE = 0.01
#: Words in the shingles by which copies among the training texts are told.
SHINGLE = 4
BEGINNING = 5
DRIFT = 0.05
#: Segments with a higher expected number in clean text are no passages.
PASSAGE_E = 0.001
THRESHOLD = 0.3

_WORDS = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    """What scoring needs. ``scores`` has words, ``beginnings`` the first ``BEGINNING`` letters of longer words."""

    scores: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    intercept: float = -math.inf

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """Place and score of the words that have one."""
        get, begin = self.scores.get, self.beginnings.get
        out = []
        for i, w in enumerate(words):
            s = get(w)
            if s is None:
                if len(w) <= BEGINNING:
                    continue
                s = begin(w[:BEGINNING])
                if s is None:
                    continue
            out.append((i, s))
        return out

    def score(self, evidence: float) -> float:
        x = self.slope * evidence + self.intercept
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal scoring segments, as (score, first word, last word); words between hits cost ``drift`` each.

    Only hits above the drift can start or end a segment, so the scan goes over hits and takes the words between as one step.
    """
    found: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, last
    total, last = 0.0, -1
    for place, score in hits:
        total -= drift * (place - last - 1)
        last = place
        gain = score - drift
        if gain <= 0:
            total += gain
            continue
        begin, end, first = total, total + gain, place
        total = end
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= begin:
                j -= 1
            if j < 0 or found[j][1] >= end:
                # segments that started above this one's start can never be extended by it; they stay
                found.append((begin, end, first, place))
                break
            begin, first = found[j][0], found[j][2]
            del found[j:]
    return [(end - begin, first, last) for begin, end, first, last in found]


def evidence(model: Model, found: list[tuple[float, int, int]], n: int) -> float:
    """Minus the log of the probability of the best segments in clean text of ``n`` words, for the best number of them."""
    best, total = 0.0, 0.0
    shift = model.log_k + math.log(max(n, 1))
    for r, s in enumerate(sorted((f[0] for f in found), reverse=True), 1):
        total += model.rate * s - shift
        if total <= 0:
            break
        log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
        best = max(best, -log_p)
    return best


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def held_out(key: Column) -> Column:
    return _fold(key) == 2


def _fold(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """(fold, toxic, text) of labelled rows that are not held out: all, or about ``limit`` of them by hash.

    The chosen labels are at most about ``limit`` rows and are broadcast; texts are not shuffled for the join. Of texts with the same label and
    the same smallest shingle, mostly copies and near copies of each other, the one with the smallest id counts: else the plain words of a toxic
    text with many copies would look toxic.
    """
    @F.pandas_udf("long")
    def smallest(texts: pd.Series) -> pd.Series:
        seen: dict[bytes, int] = {}
        found = [shingles(t, SHINGLE, seen) for t in texts]
        return pd.Series([int(h[0].view(np.int64)) if len(h) else 0 for h in found])


    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    rows = rows.groupBy("doc_id").agg((F.max("toxic") >= 1).cast("int").alias("toxic"))
    rows = rows.where(~held_out(F.col("doc_id")))
    n = rows.count()
    if n > limit:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < 1_000_003 * limit // n)
    chosen = F.broadcast(rows.select(F.col("doc_id").alias("_id"), "toxic"))
    joined = docs.select(F.col("doc_id"), F.col("text")).join(chosen, F.col("doc_id") == F.col("_id")).where(F.length("text") > 0)
    one = F.struct(_fold(F.col("doc_id")).cast("int").alias("fold"), "text")
    kept = joined.withColumn("_least", smallest("text")).groupBy("_least", "toxic").agg(F.min_by(one, F.struct("doc_id", "text")).alias("one"))
    return kept.select("one.fold", "toxic", "one.text")


def token_counts(rows: DataFrame) -> DataFrame:
    """(token, fold, toxic, clean): documents with each word, and with each beginning (marked by a leading ^)."""

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for fold, toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = set(words_of(text))
                words |= {"^" + w[:BEGINNING] for w in words if len(w) > BEGINNING}
                seen.update((w, fold == 3, toxic) for w in words)
            if seen:
                token, late, toxic = zip(*seen, strict=True)
                n = np.array(list(seen.values()), np.int64)
                toxic = np.array(toxic, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(late), pa.array(n * toxic), pa.array(n * (1 - toxic))], ["token", "late", "toxic", "clean"])

    part = rows.select("fold", "toxic", "text").mapInArrow(count, "token string, late boolean, toxic long, clean long")
    return part.groupBy("token", "late").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(counts: DataFrame, limit: int = MODEL_TOKENS) -> tuple[dict[str, float], dict[str, float]]:
    """Scores of words and of beginnings from (token, toxic, clean)."""
    kinds = counts.withColumn("beginning", F.col("token").startswith("^"))
    totals = {r["beginning"]: r for r in kinds.groupBy("beginning").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"), F.count("*").alias("n")).collect()}
    out: tuple[dict[str, float], dict[str, float]] = ({}, {})
    for beginning, total in totals.items():
        n_t, n_c = float(total["t"]), float(total["c"])
        prior_total = PRIOR_SHARE * (n_t + n_c)
        prior = (F.col("toxic") + F.col("clean")) * PRIOR_SHARE
        t, c = F.col("toxic") + prior, F.col("clean") + prior
        delta = F.log(t / (n_t + prior_total - t)) - F.log(c / (n_c + prior_total - c))
        error = F.sqrt(1 / t + 1 / c)
        share = n_t / (n_t + n_c)
        both = F.col("toxic") + F.col("clean")

        def surprise(n: Column, expected: Column) -> Column:
            return F.when(n > 0, n * F.log(n / expected)).otherwise(F.lit(0.0))

        ratio = 2 * (surprise(F.col("toxic"), both * share) + surprise(F.col("clean"), both * (1 - share)))
        kept = kinds.where(F.col("beginning") == beginning).select("token", delta.alias("delta"), error.alias("error"), ratio.alias("ratio"))
        kept = kept.where(F.col("ratio") >= 2 * math.log(max(total["n"], 2)))
        kept = kept.orderBy(F.desc("ratio"), "token").limit(limit)
        for r in kept.collect():
            sign = 1 if r["delta"] > 0 else -1
            out[beginning][r["token"][int(beginning) :]] = sign * max(0.0, abs(r["delta"]) - r["error"])
    return out


def _clean_rate(scores: np.ndarray, words: int, drift: float = DRIFT) -> float:
    """lambda: the positive root of mean(exp(lambda * score)) = 1 over the words of clean text."""
    # one more hit of the highest score keeps the root finite where clean text has none
    scores = np.append(scores, scores.max(initial=1.0))
    rest = max(words - len(scores), 1)

    def excess(rate: float) -> float:
        return float(np.exp(rate * (scores - drift)).sum() + rest * math.exp(-rate * drift)) / (len(scores) + rest) - 1

    low, high = 1e-4, 1e-3
    while excess(high) < 0 and high < 50:
        low, high = high, high * 1.5
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, with the smoothed targets of Platt (1999) and a small ridge."""
    positive = y.sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (len(y) - positive + 2))
    design = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - target) + 1e-4 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-4 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Model:
    """The model from labelled documents. Without toxic or without clean training rows every score is 0."""
    small_batches(docs.sparkSession)
    rows = materialise(training_rows(docs, labels, limit), "toxic-training")
    counts = materialise(token_counts(rows), "toxic-counts")
    seen = {r["toxic"] for r in rows.groupBy("toxic").count().collect()}
    if seen != {0, 1}:
        return Model()
    first = Model(*log_odds(counts.where("NOT late")))

    def examine(texts: pd.Series) -> pd.Series:
        """Words, and hits, of each text."""
        found = []
        for text in texts:
            words = words_of(text)
            hits = first.hits(words)
            found.append({"n": len(words), "places": [i for i, _ in hits], "scores": [s for _, s in hits]})
        return pd.DataFrame(found, columns=["n", "places", "scores"])

    examined = F.pandas_udf(examine, "n long, places array<int>, scores array<double>")
    # a quarter of the bounded sample, reduced to its few scored words
    late = rows.where("fold = 3").select("toxic", examined("text").alias("x")).select("toxic", "x.*").collect()
    if {r["toxic"] for r in late} != {0, 1}:
        late = rows.select("toxic", examined("text").alias("x")).select("toxic", "x.*").collect()
    clean = [r for r in late if not r["toxic"]]
    rate = _clean_rate(np.array([s for r in clean for s in r["scores"]]), sum(r["n"] for r in clean))
    split = [segments(list(zip(r["places"], r["scores"], strict=True))) for r in late]
    # the i-th best of all segments in N clean words has i = K N exp(-lambda S); the median over i settles log K
    best = sorted((s[0] for r, found in zip(late, split, strict=True) if not r["toxic"] for s in found), reverse=True) or [0.0]
    log_k = float(np.median(np.log(np.arange(1, len(best) + 1)) + rate * np.array(best))) - math.log(max(sum(r["n"] for r in clean), 1))
    fitted = Model(rate=rate, log_k=log_k)
    x = np.array([evidence(fitted, found, r["n"]) for r, found in zip(late, split, strict=True)])
    slope, intercept = _logistic(x, np.array([r["toxic"] for r in late], float))
    every = counts.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return Model(*log_odds(every), rate, log_k, slope, intercept)


def judged(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``toxic_score`` (0 to 1) and ``toxic_passages``: (begin, end, score) of each significant passage, in characters.

    Every row is scored alone over its whole text, in time linear in its words. NULL and empty texts have no evidence:
    the score that any document without scored words gets. Equal texts get equal scores. Columns of ``docs`` with
    the new names are replaced; an empty table gives an empty table.
    """

    def scan(texts: pd.Series) -> pd.DataFrame:
        scores, passages = [], []
        for text in texts:
            words = words_of(text)
            found = segments(model.hits(words))
            scores.append(model.score(evidence(model, found, len(words))))
            limit = model.log_k + math.log(max(len(words), 1)) - math.log(PASSAGE_E)
            strong = [f for f in found if model.rate * f[0] >= limit]
            spans = []
            if strong:
                # places in the lower-cased text are those of the text, but for the few letters that grow by lower-casing
                lower = text.lower()
                at = [m.span() for m in _WORDS.finditer(text if len(lower) == len(text) else lower)]
                spans = [{"begin": at[a][0], "end": at[b][1], "score": s} for s, a, b in strong if b < len(at)]
            passages.append(spans)
        return pd.DataFrame({"score": scores, "passages": passages})

    def scan_all(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from map(scan, parts)
        give_back()

    small_batches(docs.sparkSession)
    scanned = F.pandas_udf(scan_all, "score double, passages array<struct<begin:int,end:int,score:double>>")
    kept = [c for c in docs.columns if c not in ("toxic_score", "toxic_passages")]
    out = docs.select(*kept, scanned(F.col(text).cast("string")).alias("_toxic"))
    return out.select(*kept, F.col("_toxic.score").alias("toxic_score"), F.col("_toxic.passages").alias("toxic_passages"))


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """Query op3_toxic_segments: fitted on the labels that are not held out, applied to all documents."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    out = judged(docs, model)
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("toxic_passages").alias("n_passages"),
    )
