"""Near-duplicate embeddings by products of int8 tiles with rigorous error bounds.

Equal vectors are one class first; a class counts as often as it has rows. Each class is scaled to length one
and rounded to int8 codes with a scale of its own, and the length e of what rounding took away is kept. For
two unit vectors u, v with codes p, q, scales s, t and errors d, e the cosine lies within d + e + d e of
s t (p . q). Products of whole tiles of codes are exact whole numbers, so this bound is rigorous (plus SLACK for
rounding of the scales): pairs above the threshold even so are links, pairs below it even so are none, and only those
between are computed again from the full vectors in double precision.

Tiles hold vectors of one cell, that is with the same nearest pivot. By the triangle inequality of angles, two
cells whose pivots are further apart than both radii and the threshold's angle have no link, and their tiles
never meet. How much that saves depends on the data: on vectors without clusters, nothing. Pivots are chosen
from a bounded sample; they decide which tiles are skipped, never a result.

A pair of tiles gives one row for each vector that has a link there: how many rows it is linked with, and the
smallest vector of its component among these tiles. So a dense group costs rows in proportion to its vectors and tiles and not
to its pairs, and components over all tiles come from pointer doubling over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_batch, dropped, saved, small_batches
from .simhash import components

THRESHOLD = 0.9
#: Vectors and bytes of a tile, about; codes, scales and full vectors count.
TILE, TILE_BYTES = 4096, 4 << 20
#: Pivots, at most, and of how many vectors and bytes of a sample, at most, for each of them.
PIVOTS, SAMPLE_EACH, SAMPLE_BYTES = 1024, 8, 32 << 20
#: For rounding in single precision: the products are exact, three factors and sums are not.
SLACK = 1e-6
#: Columns of a product that is exact in single precision: 127 * 127 * 1024 < 2^24.
EXACT = 1024
#: Rows of a product at a time.
ROWS = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision. Powers of two are taken out first, so no square overflows."""
    vectors = vectors.astype(np.float64)
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0))
    vectors = np.ldexp(vectors, -exponent[:, None])
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales (single precision), and the lengths of units - scale * codes."""
    scale = (np.abs(units).max(axis=1, initial=0) / 127).astype(np.float32)
    codes = np.clip(np.rint(units / scale[:, None].astype(np.float64)), -127, 127)
    rest = units - codes * scale[:, None]
    return codes.astype(np.int8), scale, np.sqrt(np.einsum("ij,ij->i", rest, rest))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact products of all rows of two code matrices."""
    if left.shape[1] <= EXACT:
        return left.astype(np.float32) @ right.astype(np.float32).T
    return sum((products(left[:, k : k + EXACT], right[:, k : k + EXACT]).astype(np.float64) for k in range(0, left.shape[1], EXACT)))


class Tile:
    """Vectors of one tile: node, times, codes, scale, error, and the full vectors as unit rows, made when asked for."""

    def __init__(self, node: bytes, times: bytes, codes: bytes, scale: bytes, error: bytes, full: bytes, wide: bool):
        self.node, self.times = np.frombuffer(node, np.int64), np.frombuffer(times, np.int64)
        self.scale, self.error = np.frombuffer(scale, np.float32), np.frombuffer(error, np.float64)
        self.codes = np.frombuffer(codes, np.int8).reshape(len(self.node), -1)
        self.full = np.frombuffer(full, np.float64 if wide else np.float32).reshape(self.codes.shape)
        self._unit = None

    def units(self) -> np.ndarray:
        if self._unit is None:
            self._unit = unit(self.full)
        return self._unit


def linked_pairs(a: Tile, b: Tile, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) whose cosine reaches ``threshold``, some rows of ``a`` at a time."""
    right = b.codes.astype(np.float32) if b.codes.shape[1] <= EXACT else b.codes
    reach = (b.error * (1 + a.error.max())).astype(np.float32) + np.float32(SLACK)
    for k in range(0, len(a.node), ROWS):
        rows = slice(k, k + ROWS)
        near = products(a.codes[rows], right)
        near *= a.scale[rows, None]
        near *= b.scale
        need = (threshold - a.error[rows]).astype(np.float32)[:, None]
        i, j = np.nonzero(near + reach >= need)
        if not len(i):
            continue
        bound = a.error[k + i] + b.error[j] * (1 + a.error[k + i]) + SLACK
        sure = near[i, j] - bound >= threshold
        for s in range(0, len(i), 1 << 14):
            part = np.flatnonzero(~sure[s : s + (1 << 14)]) + s
            sure[part] = np.einsum("ij,ij->i", a.units()[k + i[part]], b.units()[j[part]]) >= threshold
        yield k + i[sure], j[sure]


def tile_links(a: Tile, b: Tile | None, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector with a link between two tiles (None: within ``a``): node, rows it is linked with, smallest node of its component."""
    other, shift = (a, 0) if b is None else (b, len(a.node))
    node = a.node if b is None else np.concatenate([a.node, b.node])
    links, root = np.zeros(len(node)), np.arange(len(node))
    for i, j in linked_pairs(a, other, threshold):
        if b is None:
            i, j = i[i < j], j[i < j]
        links += np.bincount(i, other.times[j], len(node)) + np.bincount(shift + j, a.times[i], len(node))
        i, j = root[i], root[shift + j]
        while len(i):  # hook larger roots to smaller ones until no pair has two
            np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
            while (root[root] != root).any():
                root = root[root]
            i, j = root[i], root[j]
            i, j = i[i != j], j[i != j]
    least = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, root, node)
    has = links > 0
    return node[has], links[has].astype(np.int64), least[root[has]]


def pivots_of(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Unit vectors of the sample, each as far as possible from those before it."""
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < wanted:
        far = int(nearest.argmin())
        if nearest[far] > 1 - 1e-9:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, sample @ sample[far])
    return sample[chosen]


def _matrix(column: pa.ListArray, dim: int, dtype) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype).reshape(-1, dim)


def _coded(classes: DataFrame, pivots: np.ndarray, wide: bool) -> DataFrame:
    """dim, cell, angle, node, times, codes, scale, error, full of the classes that have a direction."""
    full_type = np.float64 if wide else np.float32
    fields = [("dim", pa.int64()), ("cell", pa.int64()), ("angle", pa.float64()), ("node", pa.int64()), ("times", pa.int64())]
    schema = pa.schema([*fields, ("codes", pa.binary()), ("scale", pa.float32()), ("error", pa.float64()), ("full", pa.binary())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                full = _matrix(rows["embedding"], dim, full_type)
                good = np.isfinite(full).all(axis=1) & (full != 0).any(axis=1)
                if not good.any():
                    continue
                rows, full = rows.filter(pa.array(good)), full[good]
                units = unit(full)
                codes, scale, error = quantised(units)
                if dim == pivots.shape[1] and len(pivots):
                    near = units @ pivots.T
                    cell = near.argmax(axis=1)
                    angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                else:
                    cell, angle = np.zeros(len(full), np.int64), np.full(len(full), np.pi)
                split = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                columns = [pa.array([dim] * len(full), pa.int64()), pa.array(cell, pa.int64()), pa.array(angle), rows["node"], rows["times"], split(codes), pa.array(scale), pa.array(error), split(full)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return small_batches(classes).mapInArrow(code, "dim long, cell long, angle double, node long, times long, codes binary, scale float, error double, full binary")


_PACKED = ["node", "times", "codes", "scale", "error", "full"]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in order of (dim, cell, chunk): one row a tile, its columns as bytes; one tile is held at a time."""
    schema = pa.schema([("dim", pa.int64()), ("cell", pa.int64()), ("chunk", pa.int64()), *((c, pa.binary()) for c in _PACKED)])
    held: list[pa.RecordBatch] = []
    key = None

    def tile() -> pa.RecordBatch:
        def joined(name: str) -> bytes:
            parts = [b[name] for b in held]
            if name in ("codes", "full"):
                return b"".join(v for p in parts for v in p.to_pylist())
            return b"".join(p.to_numpy(zero_copy_only=False).tobytes() for p in parts)

        return pa.RecordBatch.from_pydict({"dim": [key[0]], "cell": [key[1]], "chunk": [key[2]]} | {c: [joined(c)] for c in _PACKED}, schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch[c].to_numpy() for c in ("dim", "cell", "chunk")])
        cut = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if held and tuple(keys[:, a].tolist()) != key:
                yield tile()
                held = []
            key = tuple(keys[:, a].tolist())
            held.append(batch.slice(a, b - a))
    if held:
        yield tile()


def _sampled_pivots(classes: DataFrame, tile: int, wide: bool) -> np.ndarray:
    """Pivots for the most frequent dimension, as many as it fills tiles; none if it fills one only."""
    most = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    wanted = min(PIVOTS, most.n // tile) if most else 0
    if wanted < 2:
        return np.empty((0, 0))
    size = max(wanted, min(SAMPLE_EACH * wanted, SAMPLE_BYTES // (8 * most.dim)))
    rows = classes.filter(F.col("dim") == most.dim).orderBy(F.xxhash64("embedding"), "node").select("embedding").limit(size).collect()
    full = np.array([r.embedding for r in rows], np.float64 if wide else np.float32)
    full = full[np.isfinite(full).all(axis=1) & (full != 0).any(axis=1)]
    return pivots_of(unit(full), wanted) if len(full) else np.empty((0, 0))


def vector_links(classes: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """node, links, root: rows that ``node`` is linked with in one pair of tiles, and its component's smallest node there.

    ``classes`` is a written table of node, dim, times and embedding (no null components). Classes without
    a direction (zero, or components that aren't finite) have no rows.
    """
    spark = classes.sparkSession
    wide = classes.schema["embedding"].dataType.elementType.typeName() == "double"
    pivots = _sampled_pivots(classes, tile, wide)
    coded = saved(_coded(classes, pivots, wide), "coded")
    rows = F.greatest(F.lit(1), F.least(F.lit(tile), F.expr(f"{TILE_BYTES} div (dim * {9 if wide else 5} + 32)")))
    cells = saved(coded.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).withColumn("chunks", F.ceil(F.col("n") / rows)), "cells")
    sizes = cells.select(F.col("dim").alias("dim_"), F.col("cell").alias("cell_"), "chunks")
    chunked = coded.join(sizes, (F.col("dim") == F.col("dim_")) & (F.col("cell") == F.col("cell_"))).withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))
    dealt = chunked.select("dim", "cell", "chunk", *_PACKED).repartition("dim", "cell", "chunk").sortWithinPartitions("dim", "cell", "chunk", "node")
    tiles = saved(dealt.mapInArrow(_packed, "dim long, cell long, chunk long, " + ", ".join(f"{c} binary" for c in _PACKED)), "tiles")
    dropped(coded)

    # cells that may hold links: at most PIVOTS of them have pivots, other dimensions have one cell each
    if len(pivots):
        found = cells.filter(F.col("dim") == pivots.shape[1]).select("cell", "radius").orderBy("cell").collect()  # a row a pivot
        at, radius = np.array([r.cell for r in found], np.int64), np.array([r.radius for r in found])
        apart = np.arccos(np.clip(pivots[at] @ pivots[at].T, -1, 1)) - radius[:, None] - radius
        i, j = np.nonzero(np.triu(apart <= np.arccos(threshold) + 1e-6))
        meeting = spark.createDataFrame([(pivots.shape[1], a, b) for a, b in zip(at[i].tolist(), at[j].tolist(), strict=True)], "dim_m long, cell_m long, cell_b long")
    else:
        meeting = spark.createDataFrame([], "dim_m long, cell_m long, cell_b long")
    alone = cells.filter(F.col("dim") != (pivots.shape[1] if len(pivots) else -1)).select(F.col("dim").alias("dim_m"), F.col("cell").alias("cell_m"), F.col("cell").alias("cell_b"))
    meeting = meeting.unionByName(alone)
    keys = tiles.select("dim", "cell", "chunk")
    chunks_b = cells.select(F.col("dim").alias("dim_"), F.col("cell").alias("cell_"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk_b"))
    pairs = keys.join(meeting, (F.col("dim") == F.col("dim_m")) & (F.col("cell") == F.col("cell_m"))).join(chunks_b, (F.col("dim") == F.col("dim_")) & (F.col("cell_b") == F.col("cell_")))
    pairs = saved(pairs.filter("cell <> cell_b or chunk <= chunk_b").select("dim", "cell", "chunk", "cell_b", "chunk_b"), "tile_pairs")
    right = tiles.select(F.col("dim").alias("dim_"), F.col("cell").alias("cell_"), F.col("chunk").alias("chunk_"), *(F.col(c).alias(f"{c}_b") for c in _PACKED))
    same = (F.col("dim") == F.col("dim_")) & (F.col("cell_b") == F.col("cell_")) & (F.col("chunk_b") == F.col("chunk_"))
    met = small_batches(pairs.join(tiles, ["dim", "cell", "chunk"]).join(right, same))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = {c: batch[c][k].as_py() for c in batch.schema.names}
                a = Tile(*(own[c] for c in _PACKED), wide)
                within = (own["cell"], own["chunk"]) == (own["cell_b"], own["chunk_b"])
                node, links, root = tile_links(a, None if within else Tile(*(own[f"{c}_b"] for c in _PACKED), wide), threshold)
                yield pa.RecordBatch.from_pydict({"node": node, "links": links, "root": root})

    linked = met.select("cell", "chunk", "cell_b", "chunk_b", *_PACKED, *(f"{c}_b" for c in _PACKED)).mapInArrow(multiply, "node long, links long, root long")
    return saved(linked, "linked")


def near_duplicate_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row for each row of ``embeddings`` (vec_id, embedding).

    n_links counts the other rows with a cosine of at least ``threshold``, copies included; component_id is
    the smallest vec_id reachable by links; kept: vec_id is component_id. Vectors that are null, zero, empty, or
    hold null or non-finite components link with nothing, and no vector with one of another dimension. Rows
    that repeat an id are vectors of their own; those without an id never name a component, and are kept if no
    row of theirs has one. Other columns are ignored. No rows give no rows.
    """
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    if given.schema["embedding"].dataType.elementType.typeName() not in ("float", "double"):
        given = given.withColumn("embedding", F.col("embedding").cast("array<double>"))
    usable = (F.size("embedding") > 0) & (F.array_position(F.transform("embedding", lambda x: x.isNull()), True) == 0)
    counted = given.filter(usable).groupBy("embedding").agg(F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("id"))
    classes = saved(counted.select(F.monotonically_increasing_id().alias("node"), F.size("embedding").cast("long").alias("dim"), "embedding", "times", "id"), "classes")
    linked = vector_links(classes, threshold, tile)
    summed = linked.groupBy("node").agg(F.sum("links").alias("links"))
    edges = saved(linked.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).distinct(), "edges")
    found = components(edges).withColumnsRenamed({"node": "node_c"})
    rooted = saved(
        classes.select("node", "times", "id")
        .join(summed.withColumnRenamed("node", "node_s"), F.col("node") == F.col("node_s"), "left")
        .join(found, F.col("node") == F.col("node_c"), "left")
        .select("node", "times", "id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("root")),
        "rooted",
    )
    named = rooted.groupBy("root").agg(F.min("id").alias("component_id")).withColumnRenamed("root", "root_")
    results = rooted.join(named, F.col("root") == F.col("root_")).select(F.col("node").alias("node_r"), (F.col("links") + F.col("times") - 1).alias("n_links"), "component_id")
    known = classes.select("node", F.col("embedding").alias("class")).join(results, F.col("node") == F.col("node_r"))
    joined = given.join(known, F.col("embedding") == F.col("class"), "left")
    directed = F.col("class").isNotNull() & F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return joined.select(
        "vec_id",
        F.when(directed, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(directed, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: The same rows in DuckDB's SQL, by comparing all pairs.
ORACLE_SQL = f"""
WITH RECURSIVE usable AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
reach AS (SELECT vec_id AS u, vec_id AS v FROM usable UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS v FROM reach GROUP BY u),
degree AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least.v, vec_id) AS component_id, vec_id = coalesce(least.v, vec_id) AS kept
FROM embeddings LEFT JOIN degree ON vec_id = degree.u LEFT JOIN least ON vec_id = least.u
"""
