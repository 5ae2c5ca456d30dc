"""The pipeline on a small corpus, each stage against what it must do to its own input."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from duelframe.llm import near_copies
from tests.llm.conftest import as_folder, document, sentence
from tests.llm.test_near import COLUMNS, brute
from tests.llm.test_texts import toxic_corpus
from tests.llm.test_tokens import check_packing, expected


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(12)
    rows, labels = toxic_corpus(spark, 600)
    base = sentence(rng, 200)
    rows += [document(7000 + i, base + " " + sentence(rng, 2), "t") for i in range(20)] + [document(7100, None), document(7101, ""), document(7000, rows[1][1])]
    docs = spark.createDataFrame(rows, COLUMNS)
    folder = as_folder(tmp_path, documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    (_, clean_stage), (_, near_stage), (_, mix_stage), (_, pack_stage) = corpus_pipeline.STAGES
    clean = clean_stage(spark, docs, folder).cache()
    left = {r["doc_id"] for r in clean.collect()}
    toxic = {k for k, _, t in labels if t}
    assert len(left & toxic) <= 0.02 * len(toxic)
    assert len({k for k, _, t in labels if not t} - left) <= 0.02 * len(labels) and {7100, 7101} <= left
    one = near_stage(spark, clean, folder).cache()
    kept = [k for k, n, _, keep in brute([(r["doc_id"], r["text"]) for r in clean.collect()], near_copies.WORDS) if keep]
    assert {r["doc_id"] for r in one.collect()} == set(kept)
    assert one.columns == docs.columns
    mixed = mix_stage(spark, one, folder).cache()
    assert mixed.columns == docs.columns and 0 < mixed.count() <= 2 * one.count()
    check_packing(pack_stage(spark, mixed, folder).collect(), expected(mixed.collect(), "byte_bpe_50k.json", 2))
    whole = corpus_pipeline.run(spark, folder)
    assert Counter(r["doc_id"] for r in whole.where("piece = 0").collect()) == Counter(r["doc_id"] for r in mixed.collect())
