"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius r, every bit position gets a non-zero vector of r + 1 bits; for each of the 2^(r+1) - 1
non-zero vectors v one table keeps the positions whose vector has an odd product with v. Any r
positions span at most r dimensions, so some v is orthogonal to all of them: two fingerprints that
differ in r bits or fewer agree on every position of that table, and no pair within the radius can be
missed. Positions are dealt evenly over the vectors, so each table keeps about half of the 64 bits.

Equal fingerprints are one class before anything else, and classes are the nodes. A bucket that holds too many classes is cut
by a second covering of its free positions, after which about 48 positions are fixed and at most 2^17
classes can exist, whatever the input. In a bucket, classes are joined by their exact distance, and
only a spanning star of each local component is emitted; components over all buckets come from pointer
doubling over written tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_batch, dropped, id_text, saved

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Classes in one bucket, above which it is cut once more.
BUCKET = 8192
#: Rows of ids that Spark may broadcast, if it finds their file small: equal hashes take next to no room in a file, but do in the driver.
BROADCAST_ROWS = 500_000
#: The bits of every byte value, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(raw: bytes) -> int:
    """The fingerprint of a text in UTF-8, as a signed 64-bit number."""
    words = raw.lower().split()  # bytes: only A-Z change, and only the contract's separators cut
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = (end - size)[: len(words) - SHINGLE + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start, end[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, len(start))
    parts = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(parts[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text and fp (longs), one row for each row of ``docs``; null and empty texts have fp 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("fp", pa.int64())])

    def make(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch["doc_id"], "hash": batch["hash"], "fp": pa.array([fingerprint(t) for t in batch["text"].to_pylist()], pa.int64())}

    texts = id_text(docs).select("doc_id", F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(by_batch(make, schema), "doc_id long, hash long, fp long")


def covering(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over ``positions``, as signed 64-bit numbers, that cover ``radius`` differences."""
    n = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, n + 1):
        mask = sum(1 << p for k, p in enumerate(positions) if ((k % n + 1) & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


MASKS = covering(list(range(64)))
INNER = [covering([p for p in range(64) if not m >> p & 1]) for m in MASKS]


def local_stars(fp: np.ndarray, node: np.ndarray, radius: int = RADIUS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges from each member of a component of these fingerprints to its smallest node."""
    left, ends, roots = np.arange(len(fp)), [], []
    while len(left) > 1:
        member, left = [left[:1]], left[1:]
        front = member[0]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for k in range(0, len(front), 64):
                far = ~near
                if not far.any():
                    break
                rest = np.flatnonzero(far)
                near[rest] = (np.bitwise_count(fp[front[k : k + 64], None] ^ fp[None, left[rest]]) <= radius).any(axis=0)
            front, left = left[near], left[~near]
            member.append(front)
        nodes = np.sort(node[np.concatenate(member)])
        if len(nodes) > 1:
            ends.append(nodes[1:])
            roots.append(np.repeat(nodes[:1], len(nodes) - 1))
    return ends, roots


def _bucket_edges(batches):
    """Batches sorted by (table, inner, key): edges within each bucket; one bucket is held at a time."""

    def edges(bucket: list[np.ndarray]):
        fp = np.concatenate(bucket)
        return local_stars(fp.view(np.uint64), fp)

    def batch_of(ends, roots):
        return pa.RecordBatch.from_pydict({"u": np.concatenate(ends), "v": np.concatenate(roots)})

    held, held_key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("table", "inner", "key")])
        fp = batch["fp"].to_numpy()
        cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(fp)]
        ends, roots = [], []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if held and tuple(key[:, a]) != held_key:
                for to, new in zip((ends, roots), edges(held), strict=True):
                    to += new
                held = []
            held_key = tuple(key[:, a])
            held.append(fp[a:b])
        if ends:
            yield batch_of(ends, roots)
    if held:
        ends, roots = edges(held)
        if ends:
            yield batch_of(ends, roots)


def links(classes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v), v < u, between the fingerprints ``fp`` of ``classes``: their components are those of all pairs within the radius.

    A bucket's size is counted before its classes meet (partial sums, then a join that Spark splits if a key
    is hot), so that no task ever holds more than ``bucket`` of them, or 2^17 after the second covering.
    """
    masks = F.array(*(F.struct(F.lit(t).cast("byte").alias("table"), F.lit(m).alias("mask")) for t, m in enumerate(MASKS)))
    keyed = classes.select("fp", F.explode(masks).alias("m")).select(
        F.col("m.table").alias("table"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"), "fp"
    )
    sizes = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Spark takes an exploded table to be as small as what it is made from, and would broadcast it
    shared = saved(keyed.join(sizes.hint("merge"), ["table", "key"]), "buckets")
    small = shared.filter(F.col("n") <= bucket).select("table", F.lit(0).cast("byte").alias("inner"), "key", "fp")
    inner = F.array(*(F.array(*(F.struct(F.lit(i + 1).cast("byte").alias("inner"), F.lit(m).alias("mask")) for i, m in enumerate(ms))) for ms in INNER))
    large = shared.filter(F.col("n") > bucket).select("table", "key", "fp", F.explode(inner[F.col("table")]).alias("m")).select(
        "table", F.col("m.inner").alias("inner"), F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.col("m.mask"))).alias("key"), "fp"
    )
    dealt = small.unionByName(large).repartition("table", "inner", "key").sortWithinPartitions("table", "inner", "key")
    edges = saved(dealt.mapInArrow(_bucket_edges, "u long, v long").distinct(), "links")
    dropped(shared)
    return edges


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of ``edges`` (u > v) reaches; lone nodes have no row.

    Every node points at its smallest neighbour or itself, pointers are doubled until all point at roots,
    and edges are carried over to the roots; again, until no edge is left. A node with very many neighbours
    only meets them in a pre-aggregated minimum, and in joins of written tables, which Spark can split.
    """
    labels = None
    while not edges.isEmpty():
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        roots = saved(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("root")), "pointers")
        while True:
            jump = roots.select(F.col("node").alias("at"), F.col("root").alias("further"))
            further = saved(roots.join(jump, F.col("root") == F.col("at")).select("node", "root", "further"), "pointers")
            done = further.filter("root <> further").isEmpty()
            dropped(roots)
            roots = further.select("node", F.col("further").alias("root"))
            if done:
                break
        to = lambda name: roots.select(F.col("node").alias(f"{name}_"), F.col("root").alias(f"{name}_root"))
        carried = edges.join(to("u"), F.col("u") == F.col("u_")).join(to("v"), F.col("v") == F.col("v_")).filter("u_root <> v_root")
        carried = carried.select(F.greatest("u_root", "v_root").alias("u"), F.least("u_root", "v_root").alias("v"))
        new = saved(carried.distinct(), "links")
        if labels is None:
            labels = roots
        else:
            moved = roots.select(F.col("node").alias("at"), F.col("root").alias("further"))
            labels = saved(labels.join(moved, F.col("root") == F.col("at"), "left").select("node", F.coalesce("further", "root").alias("root")), "labels")
        dropped(edges)
        edges = new
    if labels is None:
        labels = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels.select("node", F.col("root").alias("component"))


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, hash, fp, root and component_id, one row for each row of ``docs``.

    component_id is the smallest doc_id that links within the radius reach, root the component's smallest
    fingerprint: fingerprints are the nodes, so rows that repeat an id with other texts don't join their
    components. ``hash`` is the text's. Null and empty texts share fingerprint 0 and link like any other.
    Rows without an id never name a component: they get the smallest id in theirs, or null if there is
    none. No documents give no rows.
    """
    prints = saved(fingerprints(docs), "fingerprints")
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    found = components(links(classes, bucket))
    rooted = saved(classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("component", "fp").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    # a row for each document: repeated texts make its file small, not its rows in the driver
    return prints.hint("merge").join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "hash", "fp", "root", "component_id")


def _listed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written; too many rows for the driver are joined by sorting, however small their file."""
    ids = saved(df, name)
    return ids.hint("merge") if ids.count() > BROADCAST_ROWS else ids


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component, all its columns: that with the smallest id, and of those the one with the smallest hash of its text.

    Of equal ids and texts the row with the smallest hash of all columns stays, and of equal rows one.
    Rows without an id can't be named, and stay.
    """
    # those that go are joined against, not those that stay: most documents stay, and Spark picks the join by size
    found = near_duplicates(docs).filter("doc_id is not null")
    times = saved(found.groupBy("root", "doc_id", "hash").agg(F.count(F.lit(1)).alias("n")), "near")
    first = times.groupBy("root").agg(F.min(F.struct("doc_id", "hash", "n")).alias("first")).select("root", F.col("first.doc_id").alias("doc_id"), F.col("first.hash").alias("hash"), F.col("first.n").alias("n"))
    gone = _listed(times.join(first, ["root", "doc_id", "hash"], "left_anti").select("doc_id", "hash"), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id_"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash_"))
    of = lambda keys: (F.col("id_") == keys["doc_id"]) & (F.col("hash_") == keys["hash"])
    kept = rows.join(gone, of(gone), "left_anti")
    several = _listed(first.filter("n > 1").select("doc_id", "hash"), "several")
    if several.isEmpty():
        return kept.select("row.*")
    one = kept.join(several, of(several), "left_semi").groupBy("id_", "hash_").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return kept.join(several, of(several), "left_anti").select("row.*").unionByName(one.select("row.*"))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
