"""Phrase collocation mining with stripes.

A stripe is the counter of the words that follow one prefix. Every task turns blocks of whole texts into stripes, first of
prefixes of one word, then of two, and so on. Stripes of one prefix are merged by adding them elementwise. What
the statistics need is read from them: the extensions and their counts, the total of a prefix (an end of a piece is an entry too), and the largest
extension that subsumes a phrase.

A common prefix has a stripe as long as the vocabulary. So stripes of prefixes that are common in a sample of the texts are split into ``PARTS`` by
the following word, and a part is merged by a hash aggregate that can spill: no task has to hold a stripe. The sample decides
nothing else: every place of every text is counted.

A phrase cannot be more frequent than the phrases in it. So beyond one-word prefixes a place of the text is counted
only if both shorter phrases there may be frequent, as told by a bitmap of ``BITS`` bits over all frequent ones. The bitmap has one size whatever
the input; a false hit costs an entry that is dropped after merging, a frequent phrase is never missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.llm.common import light, small_batches, tidied
from duelframe.storage import materialise

#: Stripes of prefixes with more than this share of all entries are split into ``PARTS`` by the following word.
COMMON = 1 / 2000
PARTS = 64
#: About so many texts tell which prefixes those are.
SAMPLE = 5_000
#: Bytes of text whose stripes are combined before they leave a task; a longer text is a block of its own.
BLOCK = 8 << 20
#: log2 of the bits of the map of frequent phrases.
BITS = 27
#: Groups of the first ranking of each language.
SALTS = 64

#: The marks that end a piece, and the white space between words.
MARKS = ".,;:!?\n\x0b\x0c\r"
SPACES = " \t"

_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in SPACES]] = 1
_KIND[[ord(c) for c in MARKS]] = 2
#: Numbers of prefixes and following words are kept below this.
_LARGEST = (1 << 63) - 1
_STRIPE = "lang string, prefix string, part int, total long, next array<string>, n array<int>"


class Block:
    """The words of some texts as numbers: ``word`` and ``lang`` per word, ``piece`` (equal: same piece of the same text)."""

    def __init__(self, langs: pa.Array, texts: pa.Array) -> None:
        texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        starts_of_texts = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
        kind = _KIND[data]
        inside = kind == 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        # a text also begins a word, even right after the last letter of the text before
        at = starts_of_texts[:-1][np.diff(starts_of_texts) > 0]
        begins[at] = inside[at]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | begins[1:]
        start = np.flatnonzero(begins)
        length = np.flatnonzero(stops) + 1 - start
        del begins, stops
        text = np.searchsorted(starts_of_texts, start, "right") - 1
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), start) + text
        offsets = np.zeros(len(start) + 1, np.int64)
        np.cumsum(length, out=offsets[1:])
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
        encoded = words.dictionary_encode()
        self.words = encoded.dictionary.cast(pa.string())
        self.word = encoded.indices.to_numpy().astype(np.int64)
        langs = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy().astype(np.int64)[text]

    def stripes(self, k: int, common: pa.Array, frequent: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """Stripes of prefixes of ``k`` words; for ``k`` above 1 only of places where both phrases of k words may be in ``frequent``.

        Stripes of prefixes in ``common`` (language and prefix) are split by the following word.
        """
        n, size = len(self.word), len(self.words)
        if n < k:
            return
        if k == 1:
            at = np.arange(n)
            # the end of a piece is the entry after the last word
            after = np.append(np.where(self.piece[1:] == self.piece[:-1], self.word[1:], size), size)
        else:
            same = self.piece[k:] == self.piece[:-k]
            known = _marked(frequent, self._rolling(k, len(frequent).bit_length() + 5))
            at = np.flatnonzero(same & known[:-1] & known[1:])
            after = self.word[at + k]
        if not len(at):
            return
        # a prefix is numbered word by word; ``steps`` leads back from its number to the words
        code, steps = self.lang[at], []
        for j in range(k):
            code = code * size + self.word[at + j]
            if j < k - 1 or int(code.max()) > _LARGEST // (size + 1):
                values, code = np.unique(code, return_inverse=True)
                steps.append(values)
            else:
                steps.append(None)
        entries = np.sort(code * (size + 1) + after)
        new = np.flatnonzero(np.append(True, entries[1:] != entries[:-1]))
        count = np.diff(np.append(new, len(entries))).astype(np.int32)
        code, after = np.divmod(entries[new], size + 1)
        del entries, new, at
        begins = np.append(True, code[1:] != code[:-1])
        prefixes, back = [], code[begins]
        code = np.cumsum(begins) - 1
        for values in reversed(steps):
            back = back if values is None else values[back]
            prefixes.append(self.words.take(pa.array(back % size)))
            back = back // size
        lang = self.langs.take(pa.array(back))
        prefix = prefixes[0] if k == 1 else pc.binary_join_element_wise(*reversed(prefixes), " ")
        split = pc.is_in(pc.binary_join_element_wise(lang, prefix, " "), value_set=common).to_numpy(zero_copy_only=False)
        part = np.zeros(len(code), np.int32)
        if split.any():
            part = np.where(split[code], np.append(_hash(self.words) % np.uint64(PARTS), 0).astype(np.int32)[after], part)
            order = np.argsort(code * PARTS + part, kind="stable")
            code, after, part, count = code[order], after[order], part[order], count[order]
        new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (part[1:] != part[:-1])))
        offsets = pa.array(np.append(new, len(code)), pa.int32())
        batch = pa.RecordBatch.from_arrays(
            [
                lang.take(pa.array(code[new])),
                prefix.take(pa.array(code[new])),
                pa.array(part[new], pa.int32()),
                pa.array(np.add.reduceat(count, new, dtype=np.int64), pa.int64()),
                pa.ListArray.from_arrays(offsets, self.words.take(pa.array(after, mask=after == size))),
                pa.ListArray.from_arrays(offsets, pa.array(count, pa.int32())),
            ],
            ["lang", "prefix", "part", "total", "next", "n"],
        )
        for i in range(0, batch.num_rows, 20_000):
            yield batch.slice(i, 20_000)

    def _rolling(self, k: int, bits: int) -> np.ndarray:
        """Hash of the phrase of ``k`` words at each place."""
        lang, word = _hash(self.langs)[self.lang], _hash(self.words)[self.word]
        n = len(self.word) - k + 1
        return _phrase_hash(lang[:n], [word[j : j + n] for j in range(k)], bits)


def _hash(strings: pa.Array) -> np.ndarray:
    """64 bits per string, the same everywhere."""
    return pd.util.hash_array(strings.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _phrase_hash(lang: np.ndarray, words: list[np.ndarray], bits: int) -> np.ndarray:
    """The place of a phrase in a map of 2**bits bits."""
    out = lang
    for w in words:
        out = out * np.uint64(0x9E3779B97F4A7C15) + w
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)


def _marked(frequent: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (frequent[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _gathered(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[Block]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= block_bytes:
            yield _block(held)
            held, size = [], 0
    if held:
        yield _block(held)


def _block(batches: list[pa.RecordBatch]) -> Block:
    table = pa.Table.from_batches(batches).combine_chunks()
    return Block(*(c.chunk(0) if c.num_chunks else pa.array([], pa.string()) for c in table.columns))


def stripes(docs: DataFrame, k: int, frequent: np.ndarray | None = None) -> DataFrame:
    """Stripes of prefixes of ``k`` words from (lang, text), one row per block of texts, prefix and part; stored."""
    shared, block_bytes = docs.sparkSession.sparkContext.broadcast(frequent), BLOCK

    def made(rows: DataFrame, common: pa.Array) -> DataFrame:
        @tidied
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _gathered(batches, block_bytes):
                yield from block.stripes(k, common, shared.value)

        return rows.mapInArrow(work, _STRIPE)

    # a sample only tells which stripes to split; what is counted does not depend on it
    share = min(1.0, SAMPLE / max(docs.count(), 1))
    seen = materialise(made(docs.sample(share, seed=k), pa.array([], pa.string())).groupBy("lang", "prefix").agg(F.sum("total").alias("n")), "stripes-seen")
    least = (seen.agg(F.sum("n")).first()[0] or 0) * COMMON
    common = [f"{r['lang']} {r['prefix']}" for r in seen.where(F.col("n") > least).select("lang", "prefix").collect()]
    return materialise(made(docs, pa.array(common, pa.string())), f"stripes-{k}")


def merged(parts: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, a) of the extensions that occur ``least`` times, from stripes added elementwise; stored.

    Stripes travel whole to the task of their part; entries are taken apart and added there, without a second shuffle.
    """
    dealt = parts.select("lang", "prefix", "part", "next", "n").repartition("lang", "prefix", "part")
    entries = dealt.select("lang", "prefix", "part", F.explode(F.arrays_zip("next", "n")).alias("e"))
    added = entries.groupBy("lang", "prefix", "part", F.col("e.next").alias("next")).agg(F.sum("e.n").alias("a"))
    kept = added.where(F.col("next").isNotNull() & (F.col("a") >= least))
    return materialise(kept.select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), "a"), "phrases")


def bitmap(phrases: DataFrame, k: int) -> np.ndarray:
    """The map of the phrases of ``k`` words. It has 2**BITS bits whatever their number."""
    bits = BITS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = pc.list_flatten(pc.split_pattern(batch["phrase"], " ")).to_numpy(zero_copy_only=False).reshape(-1, k)
                place = _phrase_hash(_hash(batch["lang"]), [_hash(pa.array(words[:, j])) for j in range(k)], bits)
                bit = (np.uint64(1) << (place & np.uint64(63))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array(bit)], ["slot", "bits"])

    rows = phrases.select("lang", "phrase").mapInArrow(work, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def counted(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) with the words per language, and for each length the (lang, phrase, a) that occur ``least`` times."""
    first = stripes(docs, 1)
    total = materialise(first.groupBy("lang").agg(F.sum("total").alias("n")), "phrase-words")
    words = first.groupBy("lang", "prefix").agg(F.sum("total").alias("a")).where(F.col("a") >= least)
    grams = [materialise(words.select("lang", F.col("prefix").alias("phrase"), "a"), "phrases"), merged(first, least)]
    for k in range(2, longest):
        grams.append(merged(stripes(docs, k, bitmap(grams[-1], k)), least))
    return total, grams[:longest]


def _cut_scores(grams: list[DataFrame], m: int) -> DataFrame:
    """Phrases of ``m`` words with their lowest-scoring cut."""
    out = grams[m - 1]
    words = F.split("phrase", " ")
    million = F.lit(1_000_000).cast("decimal(7,0)")
    a = F.col("a").cast("decimal(20,0)")
    cuts = []
    for k in range(1, m):
        for side, words_of_side, name in ((k, F.slice(words, 1, k), f"_l{k}"), (m - k, F.slice(words, k + 1, m - k), f"_r{k}")):
            known = light(grams[side - 1]).select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("a").alias(name))
            out = out.withColumn("_key", F.concat_ws(" ", words_of_side))
            out = out.join(known, (F.col("lang") == F.col("_lang")) & (F.col("_key") == F.col("_part"))).drop("_lang", "_part", "_key")
        product = F.col(f"_l{k}").cast("decimal(19,0)") * F.col(f"_r{k}").cast("decimal(19,0)")
        out = out.withColumn("_above", million * a * a).withColumn("_below", product)
        out = out.withColumn(f"_s{k}", F.expr("_above div _below")).drop("_above", "_below")
        cuts.append(F.struct(F.col(f"_s{k}").alias("score"), F.lit(k).alias("k"), F.col(f"_l{k}").alias("l"), F.col(f"_r{k}").alias("r")))
    best = F.array_min(F.array(*cuts))
    return out.select("lang", "phrase", "a", best.alias("_cut")).select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")


def _subsumed(grams: list[DataFrame], m: int, share: float) -> DataFrame | None:
    """(lang, phrase) of ``m`` words inside a longer phrase with at least ``share`` percent of their count."""
    largest = None
    for longer in range(m + 1, len(grams) + 1):
        words = F.split("phrase", " ")
        inner = F.explode(F.array_distinct(F.array(*[F.concat_ws(" ", F.slice(words, i, m)) for i in range(1, longer - m + 2)])))
        found = grams[longer - 1].select("lang", inner.alias("phrase"), F.col("a").alias("_longer"))
        largest = found if largest is None else largest.unionByName(found)
    if largest is None:
        return None
    largest = largest.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    return grams[m - 1].join(largest, ["lang", "phrase"]).where(100 * F.col("_longer") >= share * F.col("a")).select("lang", "phrase")


def phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, share: int = 50, top: int | None = 2000
) -> DataFrame:
    """Collocations per language: (lang, rank, phrase, a, l, r, n, score), numbers as long.

    Texts are lower-cased (A-Z), cut into pieces at ``MARKS`` and into words at ``SPACES``. Phrases of 2 to ``longest`` words that occur
    ``least`` times within pieces are scored by floor(10**6 a a / (l r)) of their lowest-scoring cut into a first part (l) and a rest (r);
    ties go to the shortest first part. Phrases inside a longer one with at least ``share`` percent of their count go. The
    ``top`` phrases of each language by score, count and phrase remain, all of them for None. Arithmetic is exact.

    * A NULL language is "und". NULL and empty texts and texts without words add nothing. Repeated rows count each time.
    * Ties in score and count are broken by the phrase, so ranks are unique.
    * Only the two columns named are read; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    total, grams = counted(slim, longest, least)
    kept = None
    for m in range(2, longest + 1):
        scored = _cut_scores(grams, m)
        inside = _subsumed(grams, m, share)
        scored = scored if inside is None else scored.join(inside, ["lang", "phrase"], "left_anti")
        kept = scored if kept is None else kept.unionByName(scored)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        # of each of some groups the best, then of their union: no task sorts all phrases of a language
        kept = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        kept = kept.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_place") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    out = ranked.join(F.broadcast(total), "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """Query op12_collocations: all texts of documents."""
    return phrases(spark.read.parquet(f"{folder}/documents.parquet"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM split, (VALUES (1), (2), (3)) sizes(m))
  GROUP BY 1, 2, 3),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w FROM grams WHERE m > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.m, c.phrase, c.f, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1 : m], ' ') AS rest
  FROM cand c, (VALUES (1), (2)) ks(k) WHERE k < m),
scored AS (
  SELECT t.lang, t.m, t.phrase, t.f AS a, l.f AS l, r.f AS r, k, (1000000::HUGEINT * t.f * t.f) // (l.f::HUGEINT * r.f) AS score
  FROM cuts t JOIN grams l ON l.lang = t.lang AND l.m = t.k AND l.phrase = t.first
    JOIN grams r ON r.lang = t.lang AND r.m = t.m - t.k AND r.phrase = t.rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner2 AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM cand WHERE m = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM cand WHERE m = 3) GROUP BY 1, 2),
kept AS (
  SELECT s.* FROM lowest s LEFT JOIN inner2 i ON s.m = 2 AND i.lang = s.lang AND i.phrase = s.phrase
  WHERE i.f IS NULL OR 100 * i.f < 50 * s.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM kept k JOIN total t ON t.lang = k.lang
QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
