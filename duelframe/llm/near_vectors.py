"""Near copies of vectors: links at a cosine threshold within equal labels, and their components.

1. Equal vectors of a label are one class; classes are compared, copies only counted.
2. Labels of up to ``EXACT`` vectors are compared in full, in blocks.
3. In larger ones, vectors meet that have equal signs of random projections, for so many sets of projections that a pair at the threshold
   never meets with a probability of at most ``MISSED``, whatever the data; closer pairs miss less. There are no lists to fill up.
   Sets are taken in turns, and buckets that lie in one component already are dropped, so a crowd is compared in the first turns only.
4. What meets is compared in double precision. Only one link per pair of connected parts of two blocks leaves a task.
5. The vectors of each component found so are compared in full, and only the numbers of their links leave the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm.common import small_batches
from duelframe.llm.components import components
from duelframe.llm.vectors import in_runs, matrix, numbers, runs, usable
from duelframe.storage import materialise

COSINE = 0.98
#: Labels up to this size are compared in full.
EXACT = 8192
#: A pair at the threshold, of a larger label, meets in no set of projections with at most this probability.
MISSED = 1e-6
#: Sets of projections are at most about so many, and so many in one turn; signs are fewer for low thresholds.
SETS = 128
TURN = 16
#: Vectors that are compared with as many others at once.
SIDE = 256

_LINKS = "u long, v long, links long"


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(vectors: DataFrame) -> DataFrame:
    """(rid, grp, unit, copies, first_id) of each different usable vector of a label; ``grp`` parts labels and dimensions."""
    rows = vectors.where(F.col("label").isNotNull() & usable(F.col("vec")))
    each = rows.groupBy("label", "vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    each = each.withColumn("rid", F.monotonically_increasing_id()).withColumn("grp", F.xxhash64("label", F.size("vec")))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(5).to_pylist()
            unit = [_units(np.array([v]))[0] for v in flat]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(unit, pa.list_(pa.float64()))], [*batch.schema.names, "unit"])

    kept = each.select("rid", "grp", "label", "copies", "first_id", F.col("vec").cast("array<double>").alias("vec"))
    label = kept.schema["label"].dataType.simpleString()
    return materialise(kept.mapInArrow(scaled, f"rid long, grp long, label {label}, copies long, first_id long, vec array<double>, unit array<double>"), "vector-classes")


def _double(column: pa.Array) -> np.ndarray:
    return matrix(column).astype(np.float64)


def sets_of(n: int, cosine: float) -> tuple[int, int]:
    """(signs, sets) for ``n`` vectors. A pair has one equal sign with probability 1 - angle / pi; with no signs at all, every pair meets."""
    same = 1 - math.acos(min(max(cosine, -1.0), 1.0)) / math.pi

    def sets(signs: int) -> int:
        met = same**signs
        return 1 if met == 1 else SETS + 1 if met == 0 else math.ceil(math.log(MISSED) / math.log1p(-met))

    signs = min(60, max(8, math.ceil(math.log2(max(n, 2))) + 6))
    while sets(signs) > SETS:
        signs -= 1
    return signs, sets(signs)


def _parts(linked: np.ndarray) -> np.ndarray:
    """The first vector of each vector's connected part."""
    linked = linked | np.eye(len(linked), dtype=bool)
    part = np.arange(len(linked))
    while True:
        least = np.where(linked, part[None, :], len(part)).min(axis=1)
        least = least[least]
        if (least == part).all():
            return part
        part = least


def met(rows: DataFrame, cosine: float, counted: bool, label: str) -> DataFrame:
    """What comes out of comparing the ``rows`` (key, comp, rid, unit, copies) of equal ``key``; pairs of one ``comp`` may be left out.

    A row (u, v, NULL) is a link; all of them connect what links connect. If ``counted``, every pair is compared, and a row (u, NULL, links)
    has linked copies of other classes, to be summed. A key is dealt into blocks of about ``SIDE`` vectors, a ``comp`` with as many into blocks
    of its own. Each pair of blocks is one row; a key's pairs are spread over about as many tasks as the root of its number of blocks.
    """
    if counted:
        dealt = rows.join(rows.groupBy("key").agg(F.count("*").alias("n")), "key").withColumn("own", F.lit(None).cast("long"))
    else:
        many = rows.groupBy("key", "comp").agg(F.count("*").alias("n")).withColumn("own", F.when(F.col("n") >= SIDE, F.col("comp")))
        sizes = many.groupBy(F.col("key").alias("_key"), F.col("own").alias("_own")).agg(F.sum("n").alias("n"))
        dealt = rows.join(many.drop("n"), ["key", "comp"])
        dealt = dealt.join(sizes, (F.col("key") == F.col("_key")) & F.col("own").eqNullSafe(F.col("_own")))
    dealt = dealt.withColumn("run", F.xxhash64("key", F.coalesce("own", F.lit(-1)), F.pmod(F.xxhash64("rid"), F.ceil(F.col("n") / SIDE))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "run", 4 * SIDE):
            x, ids = np.ascontiguousarray(_double(part.column(3))), part.column(2).to_numpy()
            first = _parts(x @ x.T >= cosine)
            row = [[part.column(1)[0].as_py()], [part.column(5)[0].as_py()], [int(ids.min())], [ids.tobytes()], [x.tobytes()], [part.column(4).to_numpy().tobytes()], [first.tobytes()]]
            types = [pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], ["key", "own", "least", "ids", "x", "copies", "parts"])

    schema = "key long, own long, least long, ids binary, x binary, copies binary, parts binary"
    blocks = in_runs(dealt.select("run", "key", "rid", "unit", "copies", "own"), "run").mapInArrow(pack, schema)
    blocks = materialise(blocks, f"{label}-blocks")
    salts = blocks.groupBy("key").agg(F.ceil(F.sqrt(F.count("*"))).cast("int").alias("salts"))
    spread = blocks.join(salts, "key")
    left = spread.withColumn("salt", F.pmod(F.xxhash64("least"), "salts").cast("int")).drop("salts")
    right = spread.select("key", *[F.col(c).alias(f"{c}2") for c in blocks.columns[1:]], F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(batch: pa.RecordBatch, name: str, k: int, kind=np.int64) -> np.ndarray:
            return np.frombuffer(batch.column(name)[k].as_buffer(), kind)

        def out(u: np.ndarray, v: np.ndarray | None, links: np.ndarray | None) -> pa.RecordBatch:
            columns = [pa.nulls(len(u), pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (u, v, links)]
            return pa.RecordBatch.from_arrays(columns, ["u", "v", "links"])

        for batch in batches:
            for k in range(batch.num_rows):
                a, b = of(batch, "ids", k), of(batch, "ids2", k)
                p, q = (of(batch, c, k, np.float64).reshape(n, -1) for c, n in (("x", len(a)), ("x2", len(b))))
                parts, parts2 = of(batch, "parts", k), of(batch, "parts2", k)
                one = a[0] == b[0]
                linked = p @ q.T >= cosine
                if one:
                    np.fill_diagonal(linked, False)
                    away = np.flatnonzero(parts != np.arange(len(a)))
                    if len(away):
                        yield out(a[away], a[parts[away]], None)
                elif linked.any():
                    (f, i), (g, j) = (np.unique(c, return_inverse=True) for c in (parts, parts2))
                    pairs = np.unique((i[:, None] * len(g) + j[None, :])[linked]) if len(f) * len(g) > 1 else np.zeros(1, np.int64)
                    yield out(a[f[pairs // len(g)]], b[g[pairs % len(g)]], None)
                if counted:
                    yield out(a, None, linked @ of(batch, "copies2", k))
                    if not one:
                        yield out(b, None, linked.T @ of(batch, "copies", k))

    both = left.join(right, ["key", "salt"]).where("least <= least2")
    if not counted:
        both = both.where("own IS NULL OR own2 IS NULL OR own <> own2 OR least = least2")
    both = both.select("ids", "ids2", "x", "x2", "copies", "copies2", "parts", "parts2").mapInArrow(compare, _LINKS)
    return materialise(both.groupBy("u", "v").agg(F.sum("links").alias("links")), label)


def hashed(nodes: DataFrame, n: int, cosine: float, seed: int) -> DataFrame:
    """(node, component) of ``nodes`` (rid, grp, unit, copies) by links among vectors with equal signs, for labels of up to ``n`` vectors."""
    signs, sets = sets_of(n, cosine)
    labels, begin, width = None, 0, 1
    while begin < sets:
        turn = range(begin, min(begin + width, sets))

        def code(batches: Iterator[pa.RecordBatch], turn: range = turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(2)
                sizes = np.diff(column.offsets.to_numpy())
                out = np.zeros((len(column), len(turn)), np.int64)
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    x = _double(column.take(pa.array(at)))
                    for place, number in enumerate(turn):
                        normal = np.random.default_rng([seed, number, int(size)]).normal(size=(int(size), signs))
                        out[at, place] = (x @ normal > 0) @ (1 << np.arange(signs))
                many = len(turn)
                yield numbers("rid grp number code", np.repeat(batch.column(0).to_numpy(), many), np.repeat(batch.column(1).to_numpy(), many), np.tile(np.array(turn), len(column)), out.ravel())

        posted = nodes.select("rid", "grp", "unit").mapInArrow(code, "rid long, grp long, number long, code long")
        posted = posted.select("rid", F.xxhash64("grp", "number", "code").alias("key"))
        if labels is not None:
            posted = posted.join(labels.withColumnRenamed("node", "rid"), "rid", "left").select("rid", "key", F.coalesce("component", "rid").alias("comp"))
        else:
            posted = posted.withColumn("comp", F.col("rid"))
        posted = materialise(posted, "vector-codes")
        mixed = posted.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("key")
        rows = posted.join(mixed, "key").join(nodes.select("rid", "unit", "copies"), "rid")
        new = met(rows, cosine, False, "vector-met").select(F.col("u").alias("a"), F.col("v").alias("b"))
        if labels is not None:
            new = new if new.isEmpty() else new.union(labels)
        if labels is None or not new.isEmpty():
            labels = components(new, "vector-components")
        begin, width = turn.stop, min(2 * width, TURN)
    return labels


def near_vectors(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
    seed: int = 11,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors of equal label and dimension are linked if their cosine is at least ``cosine``. Vectors that are NULL, zero, or
    hold NULL or non-finite components, and vectors without label, link with nothing: 0 links, their own component.
    Copies and repeated rows count as links of each other. A NULL id is never the smallest of its component; its row is kept only if no
    row of the component has an id. An empty table gives an empty table. Columns beyond the three are not looked at.
    """
    vectors = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vec"), F.col(label).alias("label"))
    small_batches(rows.sparkSession)
    every = classes(vectors)
    sizes = every.groupBy("grp").agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    sized = every.join(sizes, "grp").select("grp", "rid", "unit", "copies", "n")
    few = sized.where(F.col("n") <= EXACT).select(F.col("grp").alias("key"), F.col("rid").alias("comp"), "rid", "unit", "copies")
    found = met(few, cosine, True, "vector-links")
    labels = components(found.where("v IS NOT NULL").select(F.col("u").alias("a"), F.col("v").alias("b")), "vector-components")
    counts = found.where("v IS NULL")
    if largest > EXACT:
        nodes = materialise(sized.where(F.col("n") > EXACT).select("rid", "grp", "unit", "copies"), "vector-nodes")
        more = hashed(nodes, largest, cosine, seed)
        ends = more.union(more.select("component", "component").distinct().toDF("node", "component"))
        alike = nodes.join(ends.withColumnRenamed("node", "rid"), "rid").select(F.col("component").alias("key"), F.col("rid").alias("comp"), "rid", "unit", "copies")
        labels = labels.union(more)
        counts = counts.union(met(alike, cosine, True, "vector-dense").where("v IS NULL"))
    named = every.join(labels.select(F.col("node").alias("rid"), "component"), "rid", "left").withColumn("comp", F.coalesce("component", "rid"))
    named = materialise(named.select("rid", "comp", "copies", "first_id", "label", "vec"), "vector-named")
    smallest = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    per = named.join(smallest, "comp").join(counts.select(F.col("u").alias("rid"), "links"), "rid", "left")
    per = per.select(F.col("label").alias("_label"), F.col("vec").alias("_vec"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    per = materialise(per, "vector-result")
    counted = usable(F.col("vec")) & F.col("label").isNotNull()
    keyed = vectors.withColumn("_key", F.when(counted, F.col("vec").cast("array<double>")))
    out = keyed.join(per, (F.col("_key") == F.col("_vec")) & (F.col("label") == F.col("_label")), "left")
    component = F.when(F.col("_vec").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """Query op8_near_vectors: links and components of all embeddings."""
    return near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
