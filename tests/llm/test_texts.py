"""Licences, sharding, toxicity and mixing on small tables."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.llm import licences, mixing, sharding, toxicity
from tests.llm.conftest import as_folder, document, sentence

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, verdict string, size long, n long, a long, rid long"


def test_licences_read_sequences(spark):
    apache = (
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n"
        "See the License for the specific language governing permissions and limitations under the License."
    )
    texts = {
        1: apache,
        2: "Hello.\nReleased under the MIT License.\nReleased under the MIT license",
        3: "This is licensed under terms of our own.",
        4: None,
        5: "",
        6: "nothing here",
        7: "x " * 50_000 + "\nLicensed under CC BY-NC 4.0. Released under the MIT License.",
    }
    rows = spark.createDataFrame([(k, t, "clash") for k, t in texts.items()], "doc_id long, text string, licences string")
    got = {r["doc_id"]: r for r in licences.scan(rows).collect()}
    assert got[1]["licences"] == ["Apache-2.0"]
    assert got[1]["sentence_ids"] == ["Apache2Notice", "Apache2Comply", "Apache2Copy", "Apache2Limits"]
    assert got[2]["licences"] == ["MIT"] and got[2]["sentence_ids"] == ["MitNotice", "MitNotice"]
    assert got[3]["sentence_ids"] == ["Unknown"] and got[3]["unknown_sentences"] == 1
    assert all(got[k]["licences"] == [] and got[k]["unknown_sentences"] == 0 for k in (4, 5, 6))
    assert got[7]["licences"] == ["MIT", "CC-BY-NC-4.0"]
    assert licences.scan(rows.limit(0)).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""

GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""

LGPL21 = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""

BSD2 = """All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""

BSD3 = f"""{BSD2}

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""

MPL2 = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""

CC = """This work is licensed under a
Creative Commons Attribution 4.0 International License."""


def test_licences_of_unaltered_wrapped_texts(spark):
    gpl2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
    texts = {"Apache-2.0": APACHE, "MIT": MIT, "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": gpl2, "LGPL-2.1-or-later": LGPL21}
    texts |= {"BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "MPL-2.0": MPL2, "CC-BY-4.0": CC, "Proprietary": "All rights\nreserved."}
    rows = []
    for name, text in texts.items():
        for mark in ("", "# ", " * ", "// ", ";; ", "dnl "):
            rows.append((name, mark, "Some words before\n\n" + "\n".join(mark + line for line in text.split("\n")) + "\n\nint x = 1;"))
        rows.append((name, "crlf", text.replace("\n", "\r\n")))
    got = licences.scan(spark.createDataFrame(rows, "name string, mark string, text string")).collect()
    wrong = [(r["name"], r["mark"], r["licences"], r["sentence_ids"]) for r in got if r["licences"] != [r["name"]] or r["unknown_sentences"]]
    assert not wrong, wrong[:3]


def test_hilbert_curve_visits_neighbours():
    side = np.array(np.meshgrid(*[np.arange(8)] * 3, indexing="ij")).reshape(3, -1)
    index = sharding.hilbert_index(side, 3)
    assert sorted(index) == list(range(512))
    walk = side[:, np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=1)).sum(axis=0) == 1).all()


def test_shards_are_even_and_prune(spark, tmp_path, odd_documents):
    folder = as_folder(tmp_path, documents=odd_documents)
    rows = sharding.digest(spark, folder).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in odd_documents.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    out = sharding.shards(odd_documents, ["lang", "source", "n_chars"], ["doc_id"], n=4)
    parts = sharding.manifest(out, ["source", "n_chars"]).collect()
    assert sum(p["rows"] for p in parts) == odd_documents.count()
    assert all(p["min_n_chars"] is None or p["min_n_chars"] <= p["max_n_chars"] for p in parts)


def test_shards_of_nothing(no_documents):
    assert sharding.shards(no_documents, ["lang", "n_chars"], ["doc_id"]).count() == 0


def brute_targets(sizes, weights, share, cap):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        free = total - sum(full.values())
        target = {s: free * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if target[s] > cap * sizes[s]]
        if not over:
            return full | target
        full |= {s: cap * sizes[s] for s in over}


def test_mix_meets_targets(spark):
    rng = random.Random(8)
    rows = [document(i, sentence(rng, rng.randint(0, 80)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(600)]
    rows += [document(1000, sentence(rng, 3000), "a"), document(1001, None, "e"), document(1002, "", "e"), document(None, "x y", "b"), document(5, "x y z", "c")]
    docs = spark.createDataFrame(rows, COLUMNS)
    mixed = mixing.mix(docs)
    got = mixed.collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        assert r["mix_size"] == len((r["text"] or "").split())
        sizes[r["source"]] += r["mix_size"]
        taken[r["source"]] += r["mix_size"] * r["mix_copies"]
        assert 0 <= r["mix_copies"] <= 2
    want = brute_targets(sizes, [5, 2, 1], 1.5, 2.0)
    for r in got:
        assert r["mix_target"] == pytest.approx(want[r["source"]]) and r["mix_source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3000 if s == "a" else 80, 0.02 * sizes[s])
    again = {(r["doc_id"], r["text"]): r["mix_copies"] for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["text"]): r["mix_copies"] for r in got}
    emitted = mixing.emit(mixed)
    assert emitted.columns == docs.columns and emitted.count() == sum(r["mix_copies"] for r in got)
    assert {r["mix_copies"] for r in mixing.mix(docs, seed=8).collect()} <= {0, 1, 2}


def test_mix_of_nothing(no_documents):
    assert mixing.emit(mixing.mix(no_documents)).count() == 0


def brute_segments(scores):
    """All maximal segments by their definition: the best one, then left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9:
                best, at = total, (i, j)
    i, j = at
    left, right = brute_segments(scores[:i]), brute_segments(scores[j + 1 :])
    return left + [(round(best, 6), i, j)] + [(s, a + j + 1, b + j + 1) for s, a, b in right]


def test_segments_are_the_maximal_ones():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(0, 30)
        hits = sorted((i, rng.choice([-2, 1, 2, 3]) + rng.random() / 7) for i in rng.sample(range(n), rng.randint(0, n)))
        scores = [-0.3] * n
        for i, s in hits:
            scores[i] = s - 0.3
        got = [(round(s, 6), a, b) for s, a, b in toxicity.segments(hits, 0.3)]
        assert sorted(got, key=lambda x: x[1]) == brute_segments(scores)


def toxic_corpus(spark, n=900):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = sentence(rng, rng.randint(20, 150)).split(" ")
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(3, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["grobian", "schuft", "lump", "halunke"]))
        rows.append(document(i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxic_passages_are_found(spark, tmp_path):
    rows, labels = toxic_corpus(spark)
    rows += [document(5000, ""), document(5001, None), document(5002, "a " * 30_000 + "Schuft lump halunke schuft grobian lump"), document(5003, "ok ok"), document(0, rows[0][1])]
    labels += [(3, 1, None), (None, 1, 1), (0, 1, 1)]
    docs = spark.createDataFrame(rows, COLUMNS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    folder = as_folder(tmp_path, documents=docs, labels=marks)
    got = {r["doc_id"]: r for r in toxicity.digest(spark, folder).collect()}
    assert len(got) == len(rows) - 1
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(900))
    right = sum(got[i]["predicted"] == (i % 6 == 0) for i in held)
    assert right >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert got[5000]["predicted"] == got[5001]["predicted"] == got[5003]["predicted"] == 0
    assert got[5002]["predicted"] == 1
    model = toxicity.fit(docs, marks)
    passages = toxicity.judged(docs.where("doc_id = 5002"), model).first()
    span = passages["toxic_passages"][0]
    assert passages["text"][span["begin"] : span["end"]].lower().startswith("schuft") and span["end"] == len(passages["text"])


def test_toxicity_without_labels(spark, odd_documents, no_documents):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd_documents, nothing)
    assert {r["toxic_score"] for r in toxicity.judged(odd_documents, model).collect()} == {0.0}
    assert toxicity.judged(no_documents, model).count() == 0
