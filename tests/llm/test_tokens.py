"""Token ids, token files and packing, against whole-text encoding and plain arrays."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duelframe.llm import packing, token_files, tokens
from tests.llm.conftest import as_folder

VOCABULARIES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
LETTERS = " \n\t.,'sStTlLvVmMdDrReE|)!?aAé\u0308Σσ1²½_\x1c\x85\xa0中İ~-\U0001f600"


@pytest.mark.parametrize("name", VOCABULARIES)
@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet=LETTERS, max_size=40))
def test_pieces_give_the_ids_of_the_whole_text(name, text):
    encode = tokens.encoder(tokens.default_path(name))
    assert encode.encode(text).tobytes() == encode._whole(text)


def test_the_cache_is_bounded_and_changes_nothing():
    encode = tokens.TextEncoder(tokens.default_path(VOCABULARIES[1]), generation=10)
    rng = random.Random(1)
    for _ in range(50):
        text = " ".join("".join(rng.choice("abcde") for _ in range(4)) for _ in range(20))
        assert encode.encode(text).tobytes() == encode._whole(text)
        assert len(encode.pieces) <= 10 + 20 * 2


def test_columns_are_encoded_like_texts(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_BYTES", 300)
    rng = random.Random(2)
    texts = ["".join(rng.choice(LETTERS + "abc abc abc") for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [None, "", "x" * 1000]
    plain = ["\n".join(" ".join("".join(rng.choice("abcdéß.,") for _ in range(4)) for _ in range(5)) for _ in range(3)) for _ in range(500)]
    for name in VOCABULARIES:
        encode = tokens.encoder(tokens.default_path(name))
        got = [ids.tobytes() for ids in encode.encode_all(pa.array(texts + plain))]
        assert got == [encode._whole(t) if t else b"" for t in texts + plain]


def test_special_strings_are_ordinary_text():
    for name in VOCABULARIES:
        encode = tokens.encoder(tokens.default_path(name))
        assert len(encode.encode("<|endoftext|>")) > 2 * 1


@settings(max_examples=200, deadline=None)
@given(values=st.lists(st.integers(0, 1 << 40), max_size=700).map(sorted))
def test_elias_fano_round_trip(values):
    coded = token_files.EliasFano.from_bytes(token_files.EliasFano.of(np.array(values, np.uint64)).to_bytes())
    assert coded.all().tolist() == values
    for i in list(range(min(len(values), 5))) + list(range(max(0, len(values) - 5), len(values))):
        assert coded.select(i) == values[i]
    with pytest.raises(IndexError):
        coded.select(len(values))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    assert len(token_files.EliasFano.of(ends).to_bytes()) * 8 < 100_000 * (2 + np.log2(ends[-1] / 100_000) + 0.5)


def expected(rows, name, end):
    encode = tokens.encoder(tokens.default_path(name))
    return [(r["doc_id"], np.frombuffer(encode._whole(r["text"]) if r["text"] else b"", encode.dtype).tolist() + [end]) for r in rows]


def test_token_files_round_trip(spark, tmp_path, odd_documents):
    path = f"{tmp_path}/files"
    name = VOCABULARIES[0]
    token_files.write(odd_documents.repartition(3), path, tokens.default_path(name), end_id=1, block_ids=500)
    got = sorted(token_files.contents(spark, path).collect(), key=lambda r: r["start"])
    want = expected(odd_documents.collect(), name, 1)
    crc = [(k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, ids in want]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(crc)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert token_files.blocks(spark, path).count() > 3
    # single documents by select, also under a key that occurs twice
    for keys in ([200], [306, 5, 999_999, -3], [r["doc_id"] for r in got if r["doc_id"] is not None]):
        found = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in token_files.find(spark, path, keys).collect())
        assert found == sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in got if r["doc_id"] in keys)
    plan = token_files.find(spark, path, [1])._jdf.queryExecution().executedPlan().toString()
    assert "ends:binary" in plan and "<ids:binary" not in plan and ",ids:binary" not in plan


def test_token_files_of_nothing(spark, tmp_path, no_documents):
    token_files.write(no_documents, f"{tmp_path}/files", tokens.default_path(VOCABULARIES[0]), end_id=1)
    assert token_files.contents(spark, f"{tmp_path}/files").count() == 0


def least_bins(sizes, length):
    """The smallest number of sequences, by trying everything."""
    best = len(sizes)

    def place(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(sizes):
            best = len(room)
            return
        for j in range(len(room)):
            if room[j] >= sizes[i]:
                place(i + 1, room[:j] + [room[j] - sizes[i]] + room[j + 1 :])
        place(i + 1, room + [length - sizes[i]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(sizes=st.lists(st.integers(1, 24), min_size=1, max_size=8))
def test_bound_and_packing_bracket_the_best(sizes):
    sizes = sorted(sizes, reverse=True)
    sequence, offset = packing.best_fit_decreasing(np.array(sizes), 24)
    best = least_bins(sizes, 24)
    assert packing.lower_bound(np.array(sizes), 24) <= best <= len(set(sequence))
    for s in set(sequence):
        inside = sorted((o, n) for q, o, n in zip(sequence, offset, sizes, strict=True) if q == s)
        assert [o for o, _ in inside] == [sum(n for _, n in inside[:i]) for i in range(len(inside))]
        assert sum(n for _, n in inside) <= 24


def check_packing(rows, documents, length=1024):
    inside, per = defaultdict(list), Counter()
    for r in rows:
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
        per[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
    want = Counter()
    for k, ids in documents:
        for i, (a, b) in enumerate(tokens.cut_points(len(ids), length)):
            want[k, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert per == want
    for places in inside.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    return len(inside)


def test_packing_places_every_piece_once(spark, tmp_path, odd_documents):
    folder = as_folder(tmp_path, documents=odd_documents)
    used = check_packing(packing.digest(spark, folder).collect(), documents := expected(odd_documents.collect(), VOCABULARIES[1], 2))
    assert used <= -(-sum(len(ids) for _, ids in documents) // 1024) + 1


def test_groups_with_gaps_are_packed_again(spark):
    rng = random.Random(5)
    rows = [(i, 0, 0, rng.randint(1, 1024), 0) for i in range(4000)]
    items = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    tokens_in = sum(r[3] for r in rows)
    once = packing.pack(items, group_tokens=20_000, rounds=0).select("sequence_id").distinct().count()
    got = packing.pack(items, group_tokens=20_000)
    again = got.select("sequence_id").distinct().count()
    assert got.count() == len(rows) and got.agg({"length": "sum"}).first()[0] == tokens_in
    assert -(-tokens_in // 1024) <= again < once


def test_packing_of_nothing(no_documents):
    assert packing.pack_documents(no_documents).count() == 0


def test_only_the_first_piece_is_short():
    assert tokens.cut_points(2500, 1024) == [(0, 452), (452, 1476), (1476, 2500)]
    assert tokens.cut_points(1024, 1024) == [(0, 1024)] and tokens.cut_points(3, 1024) == [(0, 3)]


def test_smaller_slices_hold_less_text_and_give_the_same_ids(monkeypatch):
    path = tokens.default_path("byte_bpe_50k.json")
    texts = pa.array([f"some words and {i} more\nof them" for i in range(50)] + [None, ""], pa.string())
    sizes = []
    inner = tokens.TextEncoder._slice
    monkeypatch.setattr(tokens.TextEncoder, "_slice", lambda self, part: sizes.append(len(part)) or inner(self, part))
    whole = [ids.tolist() for ids in tokens.TextEncoder(path).encode_all(texts)]
    assert sizes == [52]
    assert [ids.tolist() for ids in tokens.TextEncoder(path, slice_bytes=100).encode_all(texts)] == whole
    assert max(sizes[1:]) < 10
