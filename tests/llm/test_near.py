"""Near copies of texts and vectors, and nearest neighbours, against plain computation."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from duelframe.llm import forest, near_copies, near_vectors
from duelframe.llm.components import components
from tests.llm.conftest import document, sentence

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, verdict string, size long, n long, a long, rid long"


def union(nodes, links):
    """The smallest node of each node's component."""
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    nodes = {n for link in links for n in link}
    edges = spark.createDataFrame([(a, b) if rng.random() < 0.5 else (b, a) for a, b in links + links[:5]] + [(7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges, "t").collect()}
    assert {n: got.get(n, n) for n in nodes} == union(nodes, links)
    assert components(edges.limit(0), "t").count() == 0


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    k = min(k, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, k):
    sets = [shingle_set(t, k) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    comp = union(range(len(rows)), links)
    ids = {}
    for i, c in comp.items():
        if rows[i][0] is not None:
            ids[c] = min(ids.get(c, rows[i][0]), rows[i][0])
    return Counter((rows[i][0], len(sets[i]), ids.get(c), rows[i][0] == ids.get(c)) for i, c in comp.items())


def near_corpus():
    """A crowd of near copies around one text and chains that drift away from it, beside a frequent short opening."""
    rng = random.Random(6)
    base = sentence(rng, 150).split(" ")
    rows = [(i, " ".join(w if rng.random() > 0.03 else sentence(rng, 1) for w in base)) for i in range(60)]
    words = list(base)
    for i in range(30):
        for _ in range(4):
            words[rng.randrange(150)] = sentence(rng, 1)
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, "the same opening of many " + sentence(rng, rng.randint(1, 12))) for i in range(60)]
    return rows


@pytest.mark.parametrize("long_list", [near_copies.LONG_LIST, 20])
def test_links_are_those_of_all_pairs(spark, monkeypatch, long_list):
    monkeypatch.setattr(near_copies, "LONG_LIST", long_list)
    rows = near_corpus()
    docs = spark.createDataFrame([document(*r) for r in rows], COLUMNS)
    got = near_copies.linked(docs, words=2).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == brute(rows, 2)


@pytest.mark.parametrize("members", [120, 240])
def test_a_crowd_around_a_text_that_is_not_there_is_not_compared_in_pairs(spark, monkeypatch, members):
    """Copies of one text with some words changed: most pairs are a little less similar than required."""
    rng = random.Random(9)
    base = sentence(rng, 150).split(" ")
    rows = []
    for i in range(members):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(3, 9)):
            words[at] = sentence(rng, 1)
        rows.append((i, " ".join(words)))
    examined = Counter()
    stored = near_copies.materialise

    def counted(df, label):
        out = stored(df, label)
        if label in ("near-led", "near-within", "near-merged"):
            examined[label] += out.count()
        return out

    monkeypatch.setattr(near_copies, "materialise", counted)
    got = near_copies.linked(spark.createDataFrame([document(*r) for r in rows], COLUMNS), words=2).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == brute(rows, 2)
    assert sum(examined.values()) <= 12 * members


def test_odd_rows_and_one_of_each_group(spark, odd_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    got = near_copies.linked(odd_documents).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == brute(rows, 5)
    kept = near_copies.deduplicated(odd_documents)
    assert kept.columns == odd_documents.columns
    want = {k for k, n, _, keep in brute(rows, 5) if keep}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(k for k in want if k is not None) and ids.count(None) == 1


def test_one_of_near_copies_under_one_id_and_under_none(spark):
    rng = random.Random(7)
    rows = []
    for key in (7, None):
        words = sentence(rng, 120).split(" ")
        rows += [document(key, " ".join(words[:i] + ["zz"] + words[i + 1 :])) for i in (10, 60)]
    rows += [document(7, sentence(rng, 100)), document(None, ""), document(None, None)]
    kept = near_copies.deduplicated(spark.createDataFrame(rows, COLUMNS)).collect()
    ends = Counter((r["doc_id"], " ".join((r["text"] or "").split(" ")[-20:])) for r in kept)
    assert ends == Counter({(k, " ".join((t or "").split(" ")[-20:])): 1 for k, t, *_ in rows if t}) + Counter({(None, ""): 2})


def test_no_documents(no_documents):
    assert near_copies.linked(no_documents).count() == 0 and near_copies.deduplicated(no_documents).count() == 0


def vectors(seed=1, n=300, dimension=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dimension))
    crowd = rng.normal(size=dimension)
    x[:60] = crowd + 0.02 * rng.normal(size=(60, dimension))
    x[60:70] = x[59] * 3
    x[70:80] = x[80]
    for i in range(90, 120, 2):
        x[i + 1] = x[i] + 0.05 * rng.normal(size=dimension)
    label = [0 if i < 150 else i % 3 for i in range(n)]
    rows = [(i, v.astype(np.float32).tolist(), c, "x") for i, (v, c) in enumerate(zip(x, label, strict=True))]
    odd = [None, [0.0] * dimension, [float("nan")] * dimension, [float("inf")] * dimension, [None] * dimension, []]
    rows += [(1000 + i, v, 0, "x") for i, v in enumerate(odd)] + [(2000, rows[0][1], None, "x"), (5, rows[5][1], rows[5][2], "x"), (None, rows[0][1], 0, "x")]
    return rows + [(3000, [1.0, 2.0], 0, "x"), (3001, [2.0, 4.0], 0, "x")]


VECTOR = "vec_id long, embedding array<float>, label int, n_links string"


def usable(v):
    return bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)


def test_vector_links_are_those_of_all_pairs(spark):
    rows = vectors()
    got = near_vectors.near_vectors(spark.createDataFrame(rows, VECTOR)).collect()
    links = [
        (i, j)
        for i, (_, a, x, _) in enumerate(rows)
        for j, (_, b, y, _) in enumerate(rows[:i])
        if x is not None and x == y and usable(a) and usable(b) and len(a) == len(b)
        and np.dot(np.float64(a), np.float64(b)) / np.linalg.norm(np.float64(a)) / np.linalg.norm(np.float64(b)) >= 0.98
    ]
    degree = Counter(i for link in links for i in link)
    comp = union(range(len(rows)), links)
    least = {}
    for i, c in comp.items():
        if rows[i][0] is not None:
            least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    want = Counter((r[0], degree[i], least.get(comp[i]), r[0] == least.get(comp[i])) for i, r in enumerate(rows))
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == want
    assert near_vectors.near_vectors(spark.createDataFrame([], VECTOR)).count() == 0


@pytest.mark.parametrize("exact", [500, 1 << 15])
def test_crowds_and_rare_vector_links_of_a_large_label(spark, monkeypatch, exact):
    # pairs of groups that are closer within than across, rare near pairs among other vectors, and a crowd that has nearly all of the links
    monkeypatch.setattr(near_vectors, "EXACT", exact, raising=False)
    rng = np.random.default_rng(5)
    n, dimension = 14_000, 32

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    def beside(x, cosine):
        y = rng.normal(size=x.shape)
        y = unit(y - (x * y).sum(axis=-1, keepdims=True) * x)
        return cosine * x + np.sqrt(1 - cosine**2) * y

    x = unit(rng.normal(size=(n, dimension)))
    for at in range(400, 520, 20):
        x[at + 1 : at + 10] = unit(x[at] + 0.001 * rng.normal(size=(9, dimension)))
        x[at + 10 : at + 20] = unit(beside(x[at], 0.985) + 0.001 * rng.normal(size=(10, dimension)))
    x[1000:1200] = beside(x[1200:1400], 0.9805)
    x[2000:2600] = unit(x[2000] + 0.002 * rng.normal(size=(600, dimension)))
    x[2600] = beside(x[2000], 0.985)
    x = x.astype(np.float32)
    double = unit(x.astype(np.float64))
    links = []
    for begin in range(0, n, 2000):
        i, j = np.nonzero(double[begin : begin + 2000] @ double.T >= 0.98)
        links += [(a, b) for a, b in zip((i + begin).tolist(), j.tolist(), strict=True) if a != b]
    degree, comp = Counter(a for a, _ in links), union(range(n), links)
    assert comp[400] == comp[419] and degree[400] == 19
    rows = spark.createDataFrame([(i, v.tolist(), 0, "x") for i, v in enumerate(x)], VECTOR)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_vectors(rows).collect()}
    wrong = [i for i in range(n) if got[i] != (degree[i], comp[i])]
    assert not wrong, (len(wrong), wrong[:5])


def test_forest_recall_and_order(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[100:600] = x[0]
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(x)]
    rows += [(10_000, None, 0, "x"), (10_020, [0.0] * 24, 0, "x"), (10_040, [float("nan")] * 24, 0, "x"), (10_060, [1.0], 0, "x"), (20, rows[20][1], 0, "x"), (None, rows[3][1], 0, "x")]
    table = spark.createDataFrame(rows, VECTOR)
    found = forest.nearest(table, table["vec_id"] % 20 == 0, leaf_rows=100)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 3000, 20))
    x = x.astype(np.float64)
    hits = 0
    for q, mine in got.items():
        score = x @ x[q]
        order = [i for i in np.lexsort((np.arange(3000), -score)) if i != q][:20]
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(abs(score[i] - s) < 1e-9 for _, i, s in mine)
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(mine, mine[1:], strict=False))
        hits += len(set(order) & {m[1] for m in mine})
    assert hits >= 0.9 * 20 * len(got)
    assert [m[1] for m in got[0]][:3] == [100, 101, 102]
    assert forest.recall(table.where("vec_id < 10000").dropDuplicates(["vec_id"]), found, [0, 40, 800]) >= 0.8


def test_forest_ties_of_different_vectors_go_to_the_smaller_ids(spark):
    rng = random.Random(12)
    ids = list(range(1, 400))
    rng.shuffle(ids)
    # sums of thirds and sevenths, whose last bits depend on how they are added
    rows = [(0, [1 / 3, 1 / 7, 1 / 3, 0.0])] + [(i, [0.3, 0.7, 0.1, rng.uniform(-5, 5)]) for i in ids if i % 20]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = forest.nearest(table, table["vec_id"] % 20 == 0).orderBy("rank").collect()
    score = 0.0 + (1 / 3) * 0.3 + (1 / 7) * 0.7 + (1 / 3) * 0.1 + 0.0
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(n, i, score) for n, i in enumerate([*range(1, 20), 21], 1)]


def test_forest_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0, "x"), (1, [1.0, 1.0], 0, "x"), (20, [-1.0, 0.0], 0, "x")], VECTOR)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in forest.nearest(few, few["vec_id"] % 20 == 0).collect()]
    assert sorted(got) == [(0, 1, 1, 1.0), (0, 2, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 1, -1.0)]
    none = few.limit(0)
    assert forest.nearest(none, none["vec_id"] % 20 == 0).count() == 0


def test_long_lists_are_posted_again_only_where_components_meet(spark):
    """1 and 2 share two coordinates and differ in component; 3 shares both with its own component only, 4 shares one."""
    codes = ", ".join(f"0L AS {c}" for c in near_copies.CODES)
    skipped = spark.sql(f"""SELECT 7L AS post, rid, 5L AS n, {codes}, comp, 1L AS u, outside, true AS long, CAST(NULL AS LONG) AS pivot
        FROM VALUES (1L, 1L, true), (2L, 2L, false), (3L, 3L, true), (4L, 3L, true), (5L, 5L, true) AS t(rid, comp, outside)""")
    classes = spark.sql("""SELECT * FROM VALUES (1L, array(7L, 8L, 11L)), (2L, array(7L, 8L, 12L)), (3L, array(7L, 9L, 13L)), (4L, array(7L, 9L, 14L)), (5L, array(7L, 10L, 15L)) AS t(rid, at)""")
    rows = near_copies._on_two(skipped, classes, 3).collect()
    assert sorted((r["rid"], r["j"]) for r in rows) == [(1, 1), (2, 1)]
    assert len({r["post"] for r in rows}) == 1 and {r["rid"]: r["outside"] for r in rows} == {1: True, 2: False}


def test_sets_are_read_once_for_repeated_ids(spark):
    """Repeated rows, ids that several texts share, and NULL ids: every class in a pair gets its own set, once."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join([*base[:-1], "x"]), " ".join([*base[:-1], "y"])]
    docs = [(None, t) for t in texts] * 2 + [(1, t) for t in texts[:2]] * 2
    found = near_copies.linked(spark.createDataFrame(docs, "doc_id long, text string"), words=2).collect()
    assert len(found) == len(docs) and {r["component_id"] for r in found} == {1}
