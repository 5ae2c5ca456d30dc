"""Near copies of texts: an inverted index over signature coordinates, collisions counted, links confirmed on full sets.

1. Each text becomes its set of word shingles, hashed to 64 bits. Equal sets collapse to one class.
2. A class has a MinHash signature of ``COORDINATES`` coordinates. It is posted under the coordinate-value pairs of a
   prefix: classes that agree in ``MATCHES`` of the first ``POSTED`` coordinates must meet in one of the first
   ``POSTED - MATCHES + 1``. One bit of every coordinate travels with a posting; where two classes meet, their agreeing codes are counted, and
   pairs below the match threshold are dropped. Thresholds are set so that a pair at the required similarity is lost
   with a probability below one in a million.
3. In each posting list every member is compared with one leader, the member whose codes agree best with the majority of the list: the text that
   the others are copies of, if there is one. A list of any length costs one comparison a member. Confirmed links are contracted to components,
   and lists with several components get another leader from outside the largest.
4. A class is grouped with the others around its pivot, the class that most others were compared with. A member is the pivot plus and minus a few shingles, its
   delta. Members whose deltas are short enough to be similar whatever they hold are linked to the shortest. Any other link needs deltas that share so many shingles
   that two of them meet under one of their rarest: these are posted, pairs that cannot share enough are dropped by places and bitmaps, and the rest is
   settled by the deltas. A crowd around one text that no member is close enough to is neither compared pair by pair nor are its sets sent anywhere.
5. Pairs of different groups in lists whose members still lie in several components are merged in full, but for pairs within one component, which need no link
   any more: members outside the list's largest component meet all others. Lists for which that would be long (a frequent
   shingle) are skipped here and merged on pairs of coordinates: classes with ``MATCHES`` agreements meet in two of the first ``POSTED - MATCHES + 2``.

No pair between different classes of a list is left open, none within a component is examined, and no list is collected anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.llm.common import small, small_batches, tidied
from duelframe.llm.components import components
from duelframe.storage import materialise

WORDS = 5
SIMILARITY_PERCENT = 80
COORDINATES = 256
POSTED = 16
#: A pair at the required similarity is lost with at most about this probability in each of the two filters.
MISS = 1e-6
#: Lists in which members outside the largest component would meet more others than this are merged on pairs of coordinates.
LONG_LIST = 50_000
#: How often lists get a leader before they are merged.
TURNS = 2
#: In lists with fewer candidates any of them may lead.
VOTERS = 8

# A product gives two coordinates, its upper and its lower half.
_ODD = np.random.default_rng(20240229).integers(0, 1 << 63, COORDINATES // 2 + 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.arange(64, dtype=np.uint64)
CODES = ("c1", "c2", "c3", "c4")


@cache
def thresholds(percent: int) -> tuple[int, int]:
    """Least agreements among the posted coordinates, and among the codes of all, for classes at the required similarity."""

    def least(n: int, p: float) -> int:
        lost, k = 0.0, 0
        while k < n:
            lost += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            if lost > MISS:
                break
            k += 1
        return max(k, 1)

    p = percent / 100
    # codes of one bit agree by chance in half of the other coordinates
    return least(POSTED, p), least(COORDINATES, p + (1 - p) / 2)


def shingles(text: str | None, words: int, seen: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; ``seen`` keeps word hashes and is emptied when large.

    Words are what ASCII white space parts, with A-Z lower-cased. Fewer words than a shingle has make one shorter shingle.
    """
    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    if len(seen) > 200_000:
        seen.clear()
    hashes = []
    for w in parts:
        h = seen.get(w)
        if h is None:
            h = seen[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(h)
    one = np.array(hashes, np.uint64)
    size = min(words, len(one))
    n = len(one) - size + 1
    mixed = np.full(n, size, np.uint64)
    for i in range(size):
        mixed = (mixed ^ (one[i : i + n] * _ODD[COORDINATES // 2 + i % 16])) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest of each of ``COORDINATES`` hashes over a set, 32 bits each, those of upper halves first."""
    smallest = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(hashes), 2048):
        products = hashes[i : i + 2048, None] * _ODD[None, : COORDINATES // 2]
        np.minimum(smallest, products.astype("<u8", copy=False).view("<u4").min(axis=0), out=smallest)
    return np.concatenate([smallest[1::2], smallest[::2]])


def codes(sign: np.ndarray) -> list[int]:
    """One bit of every coordinate, 64 coordinates to a long."""
    one = (sign.astype(np.uint64) >> np.uint64(8)) & np.uint64(1)
    return [int(np.bitwise_or.reduce(one[i : i + 64] << _SHIFTS).view(np.int64)) for i in range(0, COORDINATES, 64)]


def _class_key(hashes: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, n, k1, k2, at, c1 to c4) of every document; (k1, k2) names its set, ``at`` holds the posted coordinates."""
    types = [pa.int64()] * 5 + [pa.list_(pa.int64())] + [pa.int64()] * len(CODES)
    names = ["doc_id", "text_hash", "n", "k1", "k2", "at", *CODES]

    @tidied
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for text in batch.column(2):
                hashes = shingles(text.as_py(), words, seen)
                if len(hashes):
                    sig = signature(hashes)
                    row = (len(hashes), *_class_key(hashes), sig[:POSTED].astype(np.int64).tolist(), *codes(sig))
                else:
                    row = (0, None, None, None) + (None,) * len(CODES)
                for column, value in zip(columns[2:], row, strict=True):
                    column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(columns[2:], types[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names)

    slim = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    return slim.mapInArrow(sign, "doc_id long, text_hash long, n long, k1 long, k2 long, at array<long>, " + ", ".join(f"{c} long" for c in CODES))


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(rid, set) of the ``texts`` (text, rid, k1, k2) whose set is that of the class."""

    @tidied
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            rids, sets = [], []
            for text, rid, *key in zip(*batch.columns, strict=True):
                hashes = shingles(text.as_py(), words, seen)
                if _class_key(hashes) == tuple(k.as_py() for k in key):
                    rids.append(rid.as_py())
                    sets.append(hashes.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["rid", "set"])

    return texts.select(F.col("text").cast("string"), "rid", "k1", "k2").mapInArrow(collect, "rid long, set array<long>")


def _alike(percent: int, left: str, right: str) -> Column:
    """Whether sizes and codes of two postings allow the required similarity."""
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    differ = sum((F.bit_count(F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}"))) for c in CODES), F.lit(0))
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    return sizes & (differ <= COORDINATES - thresholds(percent)[1])


def _pairs(joined: DataFrame, left: str, right: str) -> DataFrame:
    a, b = F.col(f"{left}.rid"), F.col(f"{right}.rid")
    return joined.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def confirmed(
    pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, label: str, known: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of classes whose full sets are similar enough, and the sets (rid, set) known by then.

    Only the texts of classes in a pair whose sets are not ``known`` are read again, one per class; their sets are stored once and joined to the pairs.
    """
    ids = materialise(pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct(), f"{label}-ids")
    new = ids if known is None else ids.join(known.select("rid"), "rid", "left_anti")
    needed = materialise(classes.join(new, "rid").select("rid", "k1", "k2", "first_id", "first_text"), f"{label}-classes")
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("first_id")) & (F.xxhash64("text") == F.col("first_text"))
    sets = materialise(_sets(docs.join(small(needed), own), words), f"{label}-sets")
    if sets.count() > needed.count():  # repeated rows
        sets = materialise(sets.dropDuplicates(["rid"]), f"{label}-sets")
    used = sets
    if known is not None:
        sets = known.union(sets)
        used = sets.join(small(ids), "rid", "left_semi")
    left = used.select(F.col("rid").alias("a"), F.col("set").alias("set_a"))
    right = used.select(F.col("rid").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    return materialise(both.where(shared * 100 >= union * percent).select("a", "b"), f"{label}-links"), sets


def _led(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each list's leader with the members of other components; ``outside`` members are candidates and voters.

    The first 128 codes are voted on.
    """
    outside = rows.where("outside")
    bits = [F.sum(F.shiftrightunsigned(c, i).bitwiseAND(F.lit(1))).alias(f"{c}_{i}") for c in ("c1", "c2") for i in range(64)]
    votes = outside.where(F.col("u") >= VOTERS).groupBy("post").agg(F.count("*").alias("voters"), *bits)

    def majority(c: str) -> Column:
        total = F.lit(0).cast("long")
        for i in range(64):
            bit = F.when(2 * F.col(f"{c}_{i}") > F.col("voters"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
            total = total.bitwiseOR(bit)
        return total

    votes = votes.select("post", majority("c1").alias("v1"), majority("c2").alias("v2"))
    agree = -sum((F.bit_count(F.col(c).bitwiseXOR(F.col(v))) for c, v in (("c1", "v1"), ("c2", "v2"))), F.lit(0))
    lead = F.max(F.struct(F.coalesce(agree, F.lit(0)).alias("agree"), "rid", "n", *CODES, "comp")).alias("lead")
    leaders = outside.join(votes, "post", "left").groupBy("post").agg(lead)
    met = rows.select("post", F.struct("rid", "n", *CODES, "comp").alias("own")).join(leaders, "post")
    return _pairs(met.where((F.col("own.comp") != F.col("lead.comp")) & _alike(percent, "own", "lead")), "own", "lead")


def _unresolved(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings of lists with several components: with ``comp``, whether it is ``outside`` the largest, how many are (``u``), and whether the list is ``long``."""
    named = postings.join(labels.select(F.col("node").alias("rid"), "component"), "rid", "left")
    named = named.withColumn("comp", F.coalesce("component", "rid")).drop("component")
    counts = named.groupBy("post", "comp").agg(F.count("*").alias("k"))
    most = counts.groupBy("post").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("all"), F.count("*").alias("comps")).where("comps > 1")
    most = most.select("post", F.col("top.comp").alias("main"), (F.col("all") - F.col("top.k")).alias("u"), "all")
    found = named.join(most, "post").withColumn("outside", F.col("comp") != F.col("main"))
    return materialise(found.withColumn("long", F.col("u") * F.col("all") > LONG_LIST).drop("main", "all"), "near-rest")


def _pivots(pairs: DataFrame) -> DataFrame:
    """(rid, pivot) of every class in ``pairs``: of itself and those it was compared with, the one that was compared with most."""
    ends = pairs.select(F.col("a").alias("rid"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    degrees = ends.groupBy(F.col("rid").alias("other")).agg(F.count("*").alias("degree"))
    near = ends.union(degrees.select("other", "other")).join(degrees, "other")
    return near.groupBy("rid").agg(F.max(F.struct("degree", "other")).alias("top")).select("rid", F.col("top.other").alias("pivot"))


def _deltas(pivots: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members of pivots with several components: their shingles that the pivot lacks and the pivot's that they lack, and a ``weight``.

    Two members of a pivot are linked if their weights add up to no more than ``_unit`` times the size of what their deltas share.
    """
    named = pivots.join(labels.select(F.col("node").alias("rid"), "component"), "rid", "left")
    named = named.withColumn("comp", F.coalesce("component", "rid")).drop("component")
    several = named.groupBy("pivot").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("pivot")
    members = materialise(named.join(several, "pivot", "left_semi").join(classes.select("rid", "n", *CODES), "rid"), "near-members")
    wanted = small(members.select("rid").union(members.select("pivot")).distinct())
    used = sets.join(wanted, "rid", "left_semi")
    both = members.join(used, "rid").join(used.select(F.col("rid").alias("pivot"), F.col("set").alias("base")), "pivot")
    both = both.withColumn("delta", F.concat(F.array_except("set", "base"), F.array_except("base", "set"))).drop("set", "base")
    weight = (100 + percent) * F.size("delta").cast("long") - (100 - percent) * F.col("n")
    return materialise(both.withColumns({"d": F.size("delta").cast("long"), "weight": weight}), "near-deltas")


def _unit(percent: int) -> int:
    return 2 * (100 + percent)


def _within(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the members of each pivot as all links between them would; from the rows of ``_deltas``.

    A member is ``far`` if it is not linked to the one of the smallest weight by the weights alone. The others are one component, so a pair needs a far member, whose deltas
    then share at least ``least`` shingles: the smallest number for any partner. With rare shingles first, such a pair meets before the last ``least - 1`` of either.
    """
    unit = _unit(percent)
    first = rows.groupBy("pivot").agg(F.min(F.struct("weight", "rid", "comp")).alias("first"))
    rows = rows.join(first, "pivot").withColumn("far", F.col("weight") + F.col("first.weight") > 0)
    stars = rows.where(~F.col("far") & (F.col("comp") != F.col("first.comp"))).select(F.least("rid", "first.rid").alias("a"), F.greatest("rid", "first.rid").alias("b"))
    nearest = rows.where("far").groupBy("pivot").agg(F.min("weight").alias("far_weight"))
    partner = F.when(F.col("far"), F.col("first.weight")).otherwise(F.col("far_weight"))
    rows = rows.join(nearest, "pivot").withColumn("least", F.greatest(F.lit(1), F.ceil((F.col("weight") + partner) / unit)))
    bits = {f"b{k}": F.expr(f"aggregate(delta, 0L, (s, v) -> s | IF((shiftright(v, 6) & 3) = {k}, shiftleft(1L, CAST(v & 63 AS INT)), 0L))") for k in range(4)}
    rows = materialise(rows.withColumns(bits).drop("first", "far_weight"), "near-weighed")

    elements = rows.select("pivot", "rid", "d", "least", F.explode("delta").alias("element"))
    often = elements.groupBy("pivot", "element").agg(F.count("*").alias("often")).where("often > 1")
    # shingles that no other member has come first, and meet nobody
    own = Window.partitionBy("rid")
    place = F.col("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "element")) - 1
    posted = elements.join(often, ["pivot", "element"]).withColumn("place", place).where(F.col("place") <= F.col("d") - F.col("least"))
    posted = posted.select("rid", "element", "place").join(rows.drop("delta", "least"), "rid")
    x, y = posted.where("far").alias("x"), posted.alias("y")
    once = ~F.col("y.far") | (F.col("x.rid") < F.col("y.rid"))
    alone = lambda s, t: sum((F.bit_count(F.col(f"{s}.b{k}").bitwiseAND(F.bitwise_not(F.col(f"{t}.b{k}")))) for k in range(4)), F.lit(0))
    most = F.least(*[F.col(f"{s}.d") - other for s, t in (("x", "y"), ("y", "x")) for other in (F.col(f"{s}.place"), alone(s, t))])
    match = (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.element") == F.col("y.element")) & (F.col("x.comp") != F.col("y.comp")) & once
    match = match & (F.col("x.weight") + F.col("y.weight") <= unit * most) & _alike(percent, "x", "y")
    pairs = materialise(_pairs(x.join(y, match), "x", "y"), "near-within")
    side = lambda end: rows.select(F.col("rid").alias(end), F.col("weight").alias(f"weight_{end}"), F.col("delta").alias(f"delta_{end}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("delta_a", "delta_b"))
    found = both.where(F.col("weight_a") + F.col("weight_b") <= unit * shared).select("a", "b")
    return materialise(found.union(stars), "near-within-links")


def _merged(rows: DataFrame, percent: int, where: Column | None = None) -> DataFrame:
    """Pairs (a, b) from different components and of different pivots that meet under the same ``post``, one of them outside the largest component."""
    x, y = rows.where("outside").alias("x"), rows.alias("y")
    once = ~F.col("y.outside") | (F.col("x.rid") < F.col("y.rid"))
    once = once & F.coalesce(F.col("x.pivot") != F.col("y.pivot"), F.lit(True))
    match = (F.col("x.post") == F.col("y.post")) & (F.col("x.comp") != F.col("y.comp")) & once & _alike(percent, "x", "y")
    return _pairs(x.join(y, match if where is None else match & where), "x", "y")


def linked(docs: DataFrame, words: int = WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Two texts are linked if their shingle sets share at least ``percent`` of their union; ``component_id`` is the smallest
    doc_id reachable over links, ``kept`` says whether it is the row's own. NULL and empty texts have no shingles and no
    links. Rows with equal text belong together; repeated rows get equal results. A NULL doc_id is no candidate for the
    smallest: its row is kept only if its component has no other id. An empty table gives an empty table.
    """
    return _named(docs, words, percent).drop("comp")


def _named(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """What ``linked`` gives, and ``comp``: a number of the component itself, NULL for texts without words."""
    docs = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    rows = materialise(signatures(docs, words), "near-signatures")
    classes = rows.where("n > 0").groupBy("k1", "k2").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("one"),
        F.first("n").alias("n"), F.first("at").alias("at"), *[F.first(c).alias(c) for c in CODES]
    )
    classes = classes.withColumns({"first_id": F.col("one.doc_id"), "first_text": F.col("one.text_hash"), "rid": F.monotonically_increasing_id()})
    classes = materialise(classes.drop("one"), "near-classes")
    least = thresholds(percent)[0]
    prefix = POSTED - least + 1
    posted = classes.select("rid", "n", *CODES, F.posexplode(F.slice("at", 1, prefix)).alias("i", "value"))
    posted = posted.select("rid", "n", *CODES, (F.col("i").cast("long") * (1 << 32) + F.col("value")).alias("post"))
    lists = posted.groupBy("post").agg(F.count("*").alias("u")).where("u > 1")
    shared = materialise(posted.join(lists, "post"), "near-postings")

    links = pairs_done = labels = sets = None
    rest = shared.withColumn("comp", F.col("rid")).withColumn("outside", F.lit(True))
    for _ in range(TURNS):
        pairs = _led(rest, percent)
        if pairs_done is not None:
            pairs = pairs.join(pairs_done, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "near-led")
        found, sets = confirmed(pairs, classes, docs, words, percent, "near-led", sets)
        links = found if links is None else links.union(found)
        pairs_done = pairs if pairs_done is None else pairs_done.union(pairs)
        labels = components(links, "near-components")
        rest = _unresolved(shared.drop("u"), labels)

    pivots = materialise(_pivots(pairs_done), "near-pivots")
    links = links.union(_within(_deltas(pivots, labels, classes, sets, percent), percent))
    rest = rest.join(pivots, "rid", "left")
    pairs = _merged(rest.where("NOT long"), percent)
    skipped = rest.where("long")
    if not skipped.isEmpty():
        pairs = pairs.union(_merged(_on_two(skipped, classes, prefix + 1), percent, _first_two(prefix + 1))).distinct()
    new = materialise(pairs.join(pairs_done, ["a", "b"], "left_anti"), "near-merged")
    if not new.isEmpty():
        links = links.union(confirmed(new, classes, docs, words, percent, "near-merged", sets)[0])
    labels = components(links, "near-components")

    named = classes.select("rid", "k1", "k2", "first_id").join(labels.select(F.col("node").alias("rid"), "component"), "rid", "left")
    named = named.withColumn("comp", F.coalesce("component", "rid"))
    smallest = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = materialise(named.join(smallest, "comp").select("k1", "k2", "comp", "component_id"), "near-named")
    out = rows.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", "kept", "comp")


def _on_two(skipped: DataFrame, classes: DataFrame, upto: int) -> DataFrame:
    """Postings of long lists, posted again under their coordinate together with each later one of the first ``upto``, where several components meet.

    Most new lists have one member or one component, which shows without sizes, codes and coordinates: these go along with the others only. ``post`` is a
    hash of both coordinates; a pair that meets by its chance alone is confirmed like any other.
    """
    # 32 bits of each coordinate, as signed numbers
    values = F.transform(F.slice("at", 1, upto), lambda v: F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v).cast("int"))
    rows = skipped.select("post", "rid", "comp", "outside").join(classes.select("rid", values.alias("at")), "rid")
    nth = (F.shiftright("post", 32) + 1).cast("int")
    rows = rows.select("*", nth.alias("from"), F.posexplode(F.slice("at", nth + 1, F.lit(upto))).alias("j", "other")).withColumn("j", F.col("j") + F.col("from"))
    rows = materialise(rows.select(F.xxhash64("post", "j", "other").alias("post"), "j", "rid", "comp", "outside"), "near-on-two")
    lists = rows.groupBy("post").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.bool_or("outside").alias("any")).where("any AND low < high")
    open_ones = rows.join(lists.select("post"), "post", "left_semi")
    wide = skipped.select("rid", "n", *CODES, "pivot").dropDuplicates(["rid"]).join(classes.select("rid", values.alias("at")), "rid")
    return materialise(open_ones.join(wide, "rid"), "near-on-two")


def _first_two(upto: int) -> Column:
    """Whether a pair meets under the first two coordinates that it shares, so that it is given once.

    If the first is that of a short list, the pair is given there.
    """
    shared = [F.when((F.col("x.j") > k) & (F.col("x.at")[k] == F.col("y.at")[k]), 1).otherwise(0) for k in range(upto)]
    return sum(shared, F.lit(0)) == 1


def deduplicated(docs: DataFrame, words: int = WORDS, percent: int = SIMILARITY_PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group of near copies, with all columns of ``docs``: the row with the smallest key, NULL last,
    and among equal keys the one with the smallest hash of its text.

    Texts are not shuffled while the removed rows are few enough to broadcast. Repeated rows are one group. Texts without words stay.
    """
    found = materialise(_named(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), words, percent), "near-found")
    ids = found.groupBy("doc_id", "text_hash").agg(F.first("comp").alias("comp"), F.first("n_shingles").alias("n"), F.count("*").alias("copies"))
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    best = ids.where("n > 0").groupBy("comp").agg(F.min(row).alias("best"))
    ids = ids.join(best, "comp", "left").withColumn("kept", (F.col("n") == 0) | row.eqNullSafe(F.col("best"))).drop("best")
    ids = materialise(ids, "near-ids")

    def among(rows: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
        chosen = small(chosen.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
        return rows.join(chosen, F.col(key).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text)) == F.col("_hash")), how)

    out = among(docs, ids.where("NOT kept"), "left_anti")
    repeated = ids.where("kept AND copies > 1 AND n > 0")
    if not repeated.isEmpty():
        once = among(docs, repeated, "left_semi").dropDuplicates([key, text])
        out = among(out, repeated, "left_anti").unionByName(once)
    return out


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """Query op4_near_copies: components of all documents over shingles of two words."""
    return linked(spark.read.parquet(f"{folder}/documents.parquet"), words=2).drop("text_hash")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
items AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, unnest(s) AS shingle FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common
  FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM shared WHERE common * 100 >= (n + m - common) * 80),
either AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, e.y FROM reach r JOIN either e ON r.other = e.x)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(other) AS component_id, s.doc_id = min(other) AS kept
FROM sets s JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.s
"""
