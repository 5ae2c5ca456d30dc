"""Conversation structure repair by dynamic programming over a grammar.

A conversation becomes a sequence of symbols, one per row: whose turn it is and what is wrong with it. The rows that remain after the edits
must read ``(s?(ua)+)?`` by their initials, an automaton of four states. So what a symbol can do is a 4 x 4 matrix over
(min, +): from one state to another at which cost, by which edits (the audit). A sequence's matrix is the product of those of its symbols.

Conversations are much alike. Re-Pair (Larsson and Moffat, 1999) replaces frequent pairs of symbols by rules, over all different sequences
together; the matrix of a rule is made once, from those of its two halves, and serves every conversation. Its audits are ropes:
a rule keeps the state in the middle, the text is put together only where it is compared or wanted.

Sequences are cut into blocks of ``BLOCK`` rows wherever a range of the sorted table ends or a block is full, so one
conversation may hold any share of the rows: blocks are multiplied like symbols.
"""

from __future__ import annotations

import hashlib
import operator
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.llm.common import small_batches, tidied
from duelframe.storage import materialise

#: Rows of a conversation in one block.
BLOCK = 4096
#: Pairs that become rules in a round.
RULES = 256
#: Rounds end when one shortens the sequences by less than this share. What is left is multiplied symbol by symbol.
LEAST_GAIN = 0.05

# States of (s?(ua)+)?: nothing yet, after s, after u, after a. What a state needs next, and where that leads.
STATES = range(4)
NEED = ("user", "user", "assistant", "user")
NEXT = (2, 2, 3, 2)
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
FINAL = (0, 3)
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
LEGAL = frozenset(("su", "ua", "au"))
NEVER = 1 << 60
#: The symbol of rows that have to go. Others are s, u, a and x (any other role), in capitals where truncated.
GONE = "d"
_FIRST_RULE = 0xF0000

Matrix = list[list[tuple[int, str]]]


def _least(options: Iterator[tuple[int, str]]) -> tuple[int, str]:
    return min(options, default=(NEVER, ""))


def closure() -> Matrix:
    """Inserting nothing or rows that the states need."""
    out = [[(NEVER, "")] * 4 for _ in STATES]
    for q in STATES:
        at, edits = q, ""
        while out[q][at][0] == NEVER:
            out[q][at] = (INSERT * len(edits), edits)
            at, edits = NEXT[at], edits + "I"
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    """(min, +), the least audit by ASCII where costs are equal.

    Of two audits of one cost over the same rows none begins with the other, as each further edit would be an insertion with a cost. So
    the least audit is made of least audits.
    """
    return [
        [_least((x[0] + b[j][k][0], x[1] + b[j][k][1]) for j, x in enumerate(row) if x[0] < NEVER and b[j][k][0] < NEVER) for k in STATES]
        for row in a
    ]


def base(symbol: str) -> Matrix:
    """The matrix of one row, after insertions before it."""
    ops = [[(NEVER, "")] * 4 for _ in STATES]
    for q in STATES:
        ops[q][q] = (DELETE, "D")
        if symbol != GONE:
            extra = TRUNCATED * symbol.isupper()
            ops[q][NEXT[q]] = min(ops[q][NEXT[q]], (REROLE + extra, "R"))
            kept = KEEP.get(symbol.lower(), {}).get(q)
            if kept is not None:
                ops[q][kept] = min(ops[q][kept], (extra, "K"))
    return product(closure(), ops)


class Grammar:
    """Matrices of symbols and rules. Ropes: a rule keeps its halves and, per entry, the state between them."""

    def __init__(self) -> None:
        self.cost = {}
        self.leaf = {}
        self.rope = {}
        self._text: dict[tuple[str, int, int], str] = {}
        for symbol in "suaxSUAX" + GONE:
            m = base(symbol)
            self.cost[symbol] = [[x[0] for x in row] for row in m]
            self.leaf[symbol] = [[x[1] for x in row] for row in m]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_text": {}}

    def add(self, symbol: str, pair: str) -> None:
        """A rule, from the matrices of its halves."""
        a, b = self.cost[pair[0]], self.cost[pair[1]]
        cost = [[min(a[i][j] + b[j][k] for j in STATES) for k in STATES] for i in STATES]
        middle = [[0] * 4 for _ in STATES]
        for i in STATES:
            for k in STATES:
                tied = [j for j in STATES if a[i][j] + b[j][k] == cost[i][k]]
                # only ties look at texts
                middle[i][k] = tied[0] if len(tied) == 1 or cost[i][k] >= NEVER else min(tied, key=lambda j: self.text(pair[0], i, j) + self.text(pair[1], j, k))
        self.cost[symbol] = [[min(c, NEVER) for c in row] for row in cost]
        self.rope[symbol] = (pair, middle)

    def text(self, symbol: str, i: int, k: int) -> str:
        """The audit of an entry."""
        if symbol in self.leaf:
            return self.leaf[symbol][i][k]
        key = (symbol, i, k)
        if key not in self._text:
            (left, right), middle = self.rope[symbol]
            j = middle[i][k]
            self._text[key] = self.text(left, i, j) + self.text(right, j, k)
        return self._text[key]

    def matrix(self, symbol: str) -> Matrix:
        return [[(c, self.text(symbol, i, k) if c < NEVER else "") for k, c in enumerate(row)] for i, row in enumerate(self.cost[symbol])]


def compressed(sequences: DataFrame, rules: int = RULES, least_gain: float = LEAST_GAIN) -> tuple[DataFrame, Grammar]:
    """(symbols, code): each different sequence with pairs replaced by rules, and the grammar. A round is two passes over the sequences.

    The driver holds at most ``rules`` rules per round. Any grammar gives the same products.
    """
    grammar = Grammar()
    coded = materialise(sequences.select("symbols", F.col("symbols").alias("code")), "repair-code")

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for code in batch["code"].to_pylist():
                found.update(map(operator.add, code, code[1:]))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pair", "n"])

    length = coded.agg(F.sum(F.length("code"))).first()[0] or 0
    while length:
        pairs = coded.select("code").mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        best = [r["pair"] for r in pairs.orderBy(F.desc("n"), "pair").limit(rules).collect()]
        new = []
        for pair in best:
            symbol = chr(_FIRST_RULE + len(grammar.rope))
            grammar.add(symbol, pair)
            new.append((pair, symbol))
        coded, before = materialise(_replaced(coded, new), "repair-code"), length
        length = coded.agg(F.sum(F.length("code"))).first()[0]
        if before - length < least_gain * before:
            break
    return coded, grammar


def _replaced(coded: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for code in batch["code"].to_pylist():
                for pair, symbol in rules:
                    code = code.replace(pair, symbol)
                codes.append(code)
            yield pa.RecordBatch.from_arrays([batch["symbols"], pa.array(codes, pa.string())], ["symbols", "code"])

    return coded.mapInArrow(work, "symbols string, code string")


def evaluated(coded: DataFrame, grammar: Grammar) -> DataFrame:
    """(symbols, costs, audits): the 16 entries of each sequence's matrix, row by row."""
    shared = coded.sparkSession.sparkContext.broadcast(grammar)

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Matrix] = {}
        for batch in batches:
            costs, audits = [], []
            for code in batch["code"].to_pylist():
                out = None
                for symbol in code:
                    if symbol not in known:
                        known[symbol] = shared.value.matrix(symbol)
                    out = known[symbol] if out is None else product(out, known[symbol])
                costs.append([x[0] for row in out for x in row])
                audits.append([x[1] for row in out for x in row])
            yield pa.RecordBatch.from_arrays([batch["symbols"], pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))], ["symbols", "costs", "audits"])

    return coded.mapInArrow(work, "symbols string, costs array<long>, audits array<string>")


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest, fault, symbol) of (conv_id, turn, role, text); stored. The first fault of a row counts.

    NULL roles and texts are one space. Rows stand by turn (NULL first), role and text; rows equal in all of them are alike, so their order does not matter.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("digest", _digest(F.col("text")))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first()))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
        .when(seen > 1, "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    initial = F.substring("role", 1, 1)
    who = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(who)).otherwise(who)
    return materialise(rows.withColumn("fault", fault).withColumn("symbol", symbol), "repair-rows")


def _in_order() -> list[Column]:
    """The order of rows within a conversation; rows that it leaves open are alike."""
    return [F.asc_nulls_first(c) for c in ("turn", "role", "digest")]


def blocks(marked: DataFrame) -> DataFrame:
    """Blocks of each conversation's rows in order: (conv_id, place, symbols, counts, initials and turns at the ends); stored.

    A range shuffle may cut a conversation anywhere; ``place`` orders the blocks of a conversation.
    """
    kind = marked.schema["conv_id"].dataType.simpleString()
    turn = marked.schema["turn"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, place long, symbols string, blank long, duplicate long, truncated long, illegal long, "
        f"first string, last string, low {turn}, high {turn}, turns long"
    )

    block_rows = BLOCK

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 33
        done, one, symbols = [], None, []
        fields = None

        def closed() -> None:
            nonlocal place
            if one is not None:
                done.append(one | {"symbols": "".join(symbols), "place": place})
                place += 1

        for batch in batches:
            if fields is None:
                fields = pa.schema(
                    [("conv_id", batch.schema.field("conv_id").type), ("place", pa.int64()), ("symbols", pa.string())]
                    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]
                    + [("first", pa.string()), ("last", pa.string()), ("low", batch.schema.field("turn").type), ("high", batch.schema.field("turn").type), ("turns", pa.int64())]
                )
            for conv, at, role, fault, symbol in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "fault", "symbol")), strict=True):
                initial = role[:1]
                if one is None or conv != one["conv_id"] or len(symbols) == block_rows:
                    closed()
                    one = {"conv_id": conv, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": initial, "low": at, "high": None, "turns": 0}
                    symbols = []
                elif one["last"] + initial not in LEGAL:
                    one["illegal"] += 1
                if fault:
                    one[fault] += 1
                if at is not None and at != one["high"]:
                    one["turns"] += 1
                    one["low"] = at if one["low"] is None else one["low"]
                    one["high"] = at
                one["last"] = initial
                symbols.append(symbol)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, fields)
                done = []
        closed()
        if done:
            yield pa.RecordBatch.from_pylist(done, fields)

    slim = marked.select("conv_id", "turn", "role", "digest", "fault", "symbol")
    order = [F.asc_nulls_first("conv_id"), *_in_order()]
    return materialise(slim.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(work, schema), "repair-blocks")


def report(marked: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation with rows; stored."""
    parts = blocks(marked)
    coded, grammar = compressed(parts.select("symbols").distinct())
    parts = parts.join(evaluated(coded, grammar), "symbols").drop("symbols")
    kind = marked.schema["conv_id"].dataType.simpleString()
    end = closure()

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, one = [], None

        def closed() -> None:
            if one is not None:
                last = product([one.pop("row")], end)[0]
                cost, audit = min(last[q] for q in FINAL)
                low, high, turns = one.pop("low"), one.pop("high"), one.pop("turns")
                one.pop("last")
                done.append(one | {"gaps": 0 if low is None else high - low + 1 - turns, "cost": cost, "audit": audit})

        fields = None
        for batch in batches:
            fields = fields or pa.schema(
                [("conv_id", batch.schema.field("conv_id").type)] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())]
            )
            for b in batch.to_pylist():
                if one is None or b["conv_id"] != one["conv_id"]:
                    closed()
                    one = {"conv_id": b["conv_id"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "last": None, "low": None, "high": None, "turns": 0}
                    one["row"] = [(0, ""), *[(NEVER, "")] * 3]
                for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                    one[c] += b[c]
                one["illegal"] += one["last"] is not None and one["last"] + b["first"] not in LEGAL
                one["last"] = b["last"]
                if b["low"] is not None:
                    one["turns"] -= one["high"] == b["low"]
                    one["low"] = b["low"] if one["low"] is None else one["low"]
                    one["high"] = b["high"]
                entries = list(zip(b["costs"], b["audits"], strict=True))
                one["row"] = product([one["row"]], [entries[4 * i : 4 * i + 4] for i in STATES])[0]
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, fields)
                done = []
        closed()
        if done:
            yield pa.RecordBatch.from_pylist(done, fields)

    order = [F.asc_nulls_first("conv_id"), "place"]
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return materialise(parts.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(work, schema), "repair-report")


def repaired(marked: DataFrame, told: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the rows after the edits of ``told``, each conversation in one partition and in order.

    A conversation streams through its task: the audit first, then its rows, one batch at a time.
    """
    kind = marked.schema["conv_id"].dataType.simpleString()
    empty = [F.lit(None).cast(marked.schema[c].dataType).alias(c) for c in ("turn", "role", "digest", "text")]
    rows = marked.select("conv_id", "turn", "role", "digest", "text", F.lit(None).cast("string").alias("audit"))
    both = told.select("conv_id", *empty, "audit").unionByName(rows)

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        conv, audit, at, state, place = None, "", 0, 0, 0

        def line(role: str, text: str) -> None:
            nonlocal place, size
            out.append({"conv_id": conv, "place": place, "role": role, "text": text})
            place += 1
            size += len(text)

        def inserted() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                line(NEED[state], "")
                state, at = NEXT[state], at + 1

        fields = None
        for batch in batches:
            fields = fields or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
            for row in batch.to_pylist():
                if row["audit"] is not None:
                    inserted()
                    conv, audit, at, state, place = row["conv_id"], row["audit"], 0, 0, 0
                    continue
                inserted()
                edit, at = audit[at], at + 1
                if edit == "K":
                    line(row["role"], row["text"])
                    state = KEEP[row["role"][:1]][state]
                elif edit == "R":
                    line(NEED[state], row["text"])
                    state = NEXT[state]
                if size > 4 << 20 or len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist(out, fields)
                    out, size = [], 0
        inserted()
        if out:
            yield pa.RecordBatch.from_pylist(out, fields)

    order = [F.asc_nulls_first("conv_id"), F.col("audit").isNull(), *_in_order()]
    return both.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(work, f"conv_id {kind}, place long, role string, text string")


def hashes(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) over ``role:text`` lines, from rows as ``repaired`` gives them: no shuffle, no whole conversation in memory."""
    kind = lines.schema["conv_id"].dataType.simpleString()

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, conv, done, fields = None, None, [], None

        for batch in batches:
            fields = fields or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("repaired_sha256", pa.string())])
            for c, place, role, text in zip(*(batch[n].to_pylist() for n in ("conv_id", "place", "role", "text")), strict=True):
                if place == 0:
                    if running:
                        done.append({"conv_id": conv, "repaired_sha256": running.hexdigest()})
                    running, conv = hashlib.sha256(), c
                running.update((f"{role}:{text}" if place == 0 else f"\n{role}:{text}").encode())
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, fields)
                done = []
        if running:
            done.append({"conv_id": conv, "repaired_sha256": running.hexdigest()})
            yield pa.RecordBatch.from_pylist(done, fields)

    return lines.mapInArrow(work, f"conv_id {kind}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The damage of the drill: by crc32 of ``conv_id:turn`` (NULL: one space) modulo 20 a row is dropped, emptied, stripped of ends of sentences, repeated or made the user's."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", "role", "text", (F.crc32(key.cast("binary")) % 20).alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")))
    copies = F.when(F.col("_kind") == 3, 2).otherwise(1)
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).select("conv_id", "turn", "role", "text")


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A report of each conversation, and its repaired rows (conv_id, place, role, text).

    ``rows`` are the rows to mend (default: those of ``conversations``); both have conv_id, turn (a whole number), role and text, others are not read.
    The report has conv_id, gaps, blank, duplicate, truncated, illegal, cost (long) and audit: one letter per
    edit, Keep, Rerole, Delete or Insert, at the least cost, and the least of those by ASCII.

    * Every conv_id of ``conversations`` is reported; without rows it has zeros and an empty audit, and no repaired row.
    * A NULL conv_id is one conversation of its own. NULL turns come first and count for no gap. NULL roles and texts are one space.
    * Repeated rows are duplicates of the first. Rows with equal turns stand by role and text digest.
    * Blank rows (also NULL and empty texts) and duplicates are deleted. Any other role than s..., u..., a... can be reroled or deleted.
    * An empty table gives empty tables.
    """
    small_batches(conversations.sparkSession)
    marked = faults(conversations if rows is None else rows)
    told = report(marked)
    every = conversations.select(F.col("conv_id").alias("_conv")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    full = every.join(told, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    full = full.select(F.col("_conv").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"))
    return full, repaired(marked, told)


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """Query op13_conversation_repair: all conversations, damaged and repaired."""
    conversations = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    told, lines = repair(conversations, damaged(conversations))
    marks = hashes(lines).withColumnRenamed("conv_id", "_conv")
    out = told.join(marks, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
