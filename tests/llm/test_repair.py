"""Conversation repair against all edit sequences, and against a plain program over whole conversations."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from duelframe.llm import repair

COLUMNS = "conv_id long, turn long, role string, text string, place long, audit string, cost string"
SYMBOLS = {"system": "s", "user": "u", "assistant": "a", "tool": "x"}


def multiplied(symbols: str) -> tuple[int, str]:
    row = [[(0, ""), *[(repair.NEVER, "")] * 3]]
    for symbol in symbols:
        row = repair.product(row, repair.base(symbol))
    return min(repair.product(row, repair.closure())[0][q] for q in repair.FINAL)


def best_of_all(symbols: str) -> tuple[int, str]:
    """The least (cost, audit) over every edit of every row and up to two insertions in every gap."""
    def edits(c):
        extra = 5 * c.isupper()
        out = [("D", "", 2)]
        if c != "d":
            out += [("K", c.lower(), extra), ("R", "u", 1 + extra), ("R", "a", 1 + extra)]
        return out

    gaps = [("", ""), ("I", "u"), ("I", "a"), ("II", "ua"), ("II", "au")]
    choices = [gaps] + [x for c in symbols for x in (edits(c), gaps)]
    found = []
    for chosen in itertools.product(*choices):
        roles = "".join(x[1] for x in chosen)
        if re.fullmatch("(s?(ua)+)?", roles):
            found.append((sum(x[2] if len(x) == 3 else 5 * len(x[0]) for x in chosen), "".join(x[0] for x in chosen)))
    return min(found)


def test_products_are_best_of_all_edits():
    for n in range(4):
        cases = list(itertools.product("suaxSUAXd", repeat=n))
        for case in cases if n < 3 else random.Random(1).sample(cases, 60):
            assert multiplied("".join(case)) == best_of_all("".join(case)), case


def test_rules_have_the_products_of_their_rows():
    rng = random.Random(2)
    grammar = repair.Grammar()
    expansion = {c: c for c in "suaxSUAXd"}
    for i in range(60):
        left, right = rng.choice(list(expansion)), rng.choice(list(expansion))
        symbol = chr(0xF0000 + i)
        grammar.add(symbol, left + right)
        expansion[symbol] = expansion[left] + expansion[right]
        if len(expansion[symbol]) > 400:
            del expansion[symbol]
            continue
        plain = None
        for c in expansion[symbol]:
            plain = repair.base(c) if plain is None else repair.product(plain, repair.base(c))
        assert grammar.matrix(symbol) == plain


def plain_repair(rows: list[tuple]) -> dict:
    """A conversation's (turn, role, text) rows, read one after the other."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    out = {"blank": 0, "duplicate": 0, "truncated": 0}
    seen, symbols = set(), ""
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        who = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if not solid:
            out["blank"] += 1
            symbols += "d"
        elif (role, text) in seen:
            out["duplicate"] += 1
            symbols += "d"
        elif solid[-1] not in ".!?":
            out["truncated"] += 1
            symbols += who.upper()
        else:
            symbols += who
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    out["illegal"] = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    turns = [r[0] for r in rows if r[0] is not None]
    out["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    out["cost"], out["audit"] = multiplied(symbols)
    lines, roles, i = [], "", 0
    for edit in out["audit"]:
        if edit == "I":
            lines.append(("assistant:" if roles.endswith("u") else "user:"))
        elif edit == "K":
            lines.append(f"{rows[i][1]}:{rows[i][2]}")
        elif edit == "R":
            lines.append(("assistant:" if roles.endswith("u") else "user:") + rows[i][2])
        roles += lines[-1][0] if edit != "D" else ""
        i += edit != "I"
    assert i == len(rows) and re.fullmatch("(s?(ua)+)?", roles)
    return out | {"repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def plain_damage(conv, turn, role, text) -> list[tuple]:
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if kind == 0:
        return []
    if kind == 1:
        text = ""
    if kind == 2 and text is not None:
        text = re.sub("[.!?]", "", text)
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def conversations() -> list[tuple]:
    rng = random.Random(5)
    texts = ["Yes.", "No!", "Why?", "so", "Yes.  \n", "", " \t", "a. b", "é!", None]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User"]), rng.choice(texts)))
    rows += [(100, i, ("user", "assistant")[i % 2], f"text {i}.") for i in range(700)]
    rows += [(101, None, "user", "Hi."), (101, None, "user", "Hi."), (101, 3, None, "Hi."), (101, 3, "assistant", "Hi."), (101, 9, "assistant", None)]
    rows += [(102, None, "user", "Hi."), (102, None, None, None)]
    rows += [(c, t, "user", "Hi.") for c in range(200, 600) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    return rows


def expected(rows: list[tuple]) -> dict:
    found: dict = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).extend(plain_damage(conv, turn, role, text))
    return {conv: plain_repair(r) for conv, r in found.items()}


@pytest.mark.parametrize("block", [3, 4096])
def test_query_like_plain_program(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = conversations()
    spark.createDataFrame([(*r, 7, "x", "y") for r in rows], COLUMNS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r.asDict() for r in repair.digest(spark, str(tmp_path)).collect()}
    want = expected(rows)
    assert len(got) == len(want)
    for conv, told in want.items():
        assert {k: got[conv][k] for k in told} == told, conv


def test_given_conversations_like_plain_program(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: r.asDict() for r in repair.digest(spark, folder).collect()}
    want = expected(rows)
    assert {c: {k: got[c][k] for k in t} for c, t in want.items()} == want
    assert len(got) == len(want)


def test_repaired_rows_and_undamaged_tables(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hm."), (1, 2, "assistant", "Yes."), (2, 0, "user", "")], "conv_id string, turn int, role string, text string")
    told, lines = repair.repair(rows)
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in told.collect()} == {"1": (2, "DKK"), "2": (2, "D")}
    assert [tuple(r) for r in lines.collect()] == [("1", 0, "user", "Hm."), ("1", 1, "assistant", "Yes.")]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert repair.digest(spark, str(tmp_path)).count() == 0
