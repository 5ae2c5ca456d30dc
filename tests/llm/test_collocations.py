"""Collocations against plain counting of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from duelframe.llm import collocations

COLUMNS = "doc_id long, text string, lang string, n long, prefix string, a long, rank long, score double"


def plain(rows, longest=3, least=10, share=50, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase."""
    f = defaultdict(Counter)
    n = Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        found = [p for p, a in counts.items() if len(p) > 1 and a >= least]
        kept = []
        for p in found:
            a = counts[p]
            inside = any(
                100 * counts[q] >= share * a for q in found if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            )
            if not inside:
                score, _, left, right = min(
                    (Fraction(10**6 * a * a, counts[p[:k]] * counts[p[k:]]).__floor__(), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))
                )
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, i, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts():
    rng = random.Random(4)
    words = ["the", "The", "of", "big", "Éa", "éa", "x-y", "q r", "t", "a", "b", "c"]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!?"]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(words[: 4 + i % 9]) + rng.choice(ends) for _ in range(rng.randint(0, 40)))
        rows.append((text, ("en", "fr", None, "und")[i % 4]))
    rows += [(None, "en"), ("", "en"), (" \t\n.", "en"), ("New York City new york city", "en")] + [("New York City is new york city", "en")] * 8
    # ends of texts are ends of pieces, with and without white space
    rows += [("alpha", "fr"), ("beta", "fr")] * 15 + [("one two" + " one two" * 3000, "de")]
    return rows


def as_docs(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "p", 2, 3, 0.5) for i, (t, g) in enumerate(rows)], COLUMNS)


@pytest.mark.parametrize(("longest", "block", "bits"), [(3, 1 << 24, 27), (3, 200, 27), (4, 1 << 24, 12), (2, 1 << 24, 27)])
def test_phrases_like_plain_counting(spark, monkeypatch, longest, block, bits):
    """Also with small blocks, and with a map of frequent phrases so small that it tells almost nothing."""
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "BITS", bits)
    rows = texts()
    got = collocations.phrases(as_docs(spark, rows), longest=longest)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, longest)


def test_top_and_all(spark):
    rows = texts()
    docs = as_docs(spark, rows)
    assert sorted(tuple(r) for r in collocations.phrases(docs, top=3, least=4).collect()) == plain(rows, least=4, top=3)
    assert sorted(tuple(r) for r in collocations.phrases(docs, top=None, least=4).collect()) == plain(rows, least=4, top=10**9)


def test_counts_beyond_64_bits(spark):
    """10**6 a a and l r pass 64 bits; the quotient is exact."""
    a, left, right = 9_123_456_789, 9_123_456_790, 9_123_456_791
    word = spark.createDataFrame([("en", "x", left), ("en", "y", right)], "lang string, phrase string, a long")
    pair = spark.createDataFrame([("en", "x y", a)], "lang string, phrase string, a long")
    row = collocations._cut_scores([word, pair], 2).first()
    assert row["score"] == 10**6 * a * a // (left * right)


def test_no_texts(spark):
    for rows in ([], [(None, None)], [("", "en"), (" .", "en")]):
        assert collocations.phrases(as_docs(spark, rows)).count() == 0
