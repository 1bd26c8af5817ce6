"""Near-duplicate embeddings by a join of tiles on a subspace.

Unit vectors with cosine ``t`` or more are at most ``2 - 2 t`` apart (squared), in all axes and so in any subspace. The
axes of a bounded sample that vary most come first; as many of them are compared as leave few pairs of the sample over.
The sample also gives a tree of halving cuts on these axes. Its leaves deal the vectors to tiles of bounded size, each
with the box that it fills. Sample, axes and tree decide what is compared early, never what is found.

Every vector is dealt once. Pairs of tiles whose boxes come close enough meet in a product of the table of tiles with
itself, which reads tiles again and again instead of shuffling copies of vectors, so disk grows with the vectors and
not with their pairs. Of two tiles, vectors near the other's box are compared on the leading axes by one matrix
product in single precision; pairs that pass are compared by cosine in double precision. Where most pass, a product on
all axes in single precision settles those that its rounding cannot turn. Pairs are never listed: a pair of tiles
returns, per vector, how many others it links to and one link towards a common root.

Exact copies are one class with a size; classes and rows meet by 128 bits of hash, so vectors do not travel for that.
Edge cases: vectors that are null, empty, zero, or hold null or non-finite values link with nothing. Vectors of
different lengths do not link. Labels are not used. Repeated rows are copies. A null vec_id is passed on and names no
component unless all of its component are null. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shared
from plumbline.llm.components import components

COSINE = 0.9
APART = 2 - 2 * COSINE
TILE, TILE_BYTES = 8192, 4 << 20  # vectors of a tile, about, and their bytes in double precision
LEAST_TILE, LEAST_TILES = 256, 24  # a small table gets smaller tiles, so that there are tasks enough
TILE_BITS, PIECE_BITS = 15, 20  # of a class's place in its tile, and of a tile's place in its group
SAMPLE_BYTES = 16 << 20
BOX_AXES, MOST_AXES = 16, 64
PASS = 5e-5  # share of the sample's pairs that the leading axes may leave over, besides those that link
PART_BYTES = 12 << 20  # of tiles that a partition of the table of tiles holds
LEFT_PARTS = 32  # partitions of the left side of the product
BLOCK = 512  # rows and columns of a matrix product: its result stays in the cache
KEPT_TILES = 8  # that a task keeps ready
SEED = 20
FAST_SLACK = 1e-4  # rounding of squared distances in single precision


@dataclass
class Plan:
    """Vectors of a tile, axes (columns, the leading ``near`` are compared), tree of cuts in heap order, tile groups of each leaf."""

    tile: int
    axes: np.ndarray
    near: int
    axis: np.ndarray
    cut: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        turned, node = unit @ self.axes, np.zeros(len(unit), dtype=np.int64)
        for _ in range(len(self.parts).bit_length() - 1):
            node = 2 * node + 1 + (turned[np.arange(len(unit)), self.axis[node]] > self.cut[node])
        return node - len(self.axis)


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """In double precision; what has no length there becomes zero and so links with nothing."""
    vectors = vectors.astype(np.float64)
    with np.errstate(all="ignore"):
        unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    unit[~np.isfinite(unit).all(axis=1)] = 0
    return unit


def vectors_by_length(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    sizes = np.diff(batch.column("vector").offsets.to_numpy())
    for dims in np.unique(sizes):
        part = batch.filter(pa.array(sizes == dims))
        yield part, part.column("vector").flatten().to_numpy().reshape(-1, dims)


def keyed(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector, k, l) per row; k and l are 128 bits of hash, null unless the vector is valid."""
    element = embeddings.schema["embedding"].dataType.elementType.typeName()
    vector = F.col("embedding") if element == "float" else F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = finite & F.exists("vector", lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).withColumn("valid", valid)
    return rows.select("vec_id", "vector", F.when(F.col("valid"), F.xxhash64("vector")).alias("k"),
                       F.when(F.col("valid"), F.xxhash64(F.lit(SEED), F.size("vector"), "vector")).alias("l"))


def _tree(turned: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Axis and cut of each inner node, rows of each leaf: halves by the axis that varies most in a node."""
    axis, cut, held = np.zeros(leaves - 1, dtype=np.int64), np.full(leaves - 1, np.inf), [np.arange(len(turned))]
    for node in range(leaves - 1):
        rows = held[node]
        if len(rows) > 1:
            axis[node] = np.argmax(turned[rows].var(axis=0))
            cut[node] = np.median(turned[rows, axis[node]])
        right = turned[rows, axis[node]] > cut[node]
        held += [rows[~right], rows[right]]
    return axis, cut, np.array([len(x) for x in held[leaves - 1:]])


def plan_of(dims: int, count: int, sample: np.ndarray, first: int, tile: int) -> Plan:
    """How ``count`` vectors become groups of about ``tile``, numbered from ``first``; ``sample`` has distinct unit vectors."""
    tile = max(1, min(tile, TILE_BYTES // (8 * dims)))
    if not len(sample):
        sample = np.eye(1, dims)
    centred = sample - sample.mean(axis=0)
    _, spread, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:MOST_AXES].T.copy()
    some = centred[np.random.default_rng(SEED).permutation(len(sample))[:1500]]
    squares = (some * some).sum(1)
    linked = np.mean(squares[:, None] + squares - 2 * some @ some.T <= APART)
    for near in (*range(8, axes.shape[1], 4), axes.shape[1]):
        turned = some @ axes[:, :near]
        squares = (turned * turned).sum(1)
        if near >= axes.shape[1] or np.mean(squares[:, None] + squares - 2 * turned @ turned.T <= APART) <= linked + PASS:
            break
    axes = axes[:, :max(near, BOX_AXES)]
    wanted = min(-(-count // tile), max(1, len(sample) // 8))
    axis, cut, held = _tree(sample @ axes[:, :BOX_AXES], 1 << (wanted - 1).bit_length())
    parts = np.maximum(1, np.round(held * (count / len(sample) / tile)).astype(np.int64))
    return Plan(tile, axes, near, axis, cut, first + np.cumsum(parts) - parts, parts)


def plans_of(rows: DataFrame) -> tuple[dict[int, Plan], int]:
    """Plan of each length, and bytes of all vectors; the sample that reaches the driver has a fixed size."""
    sized = rows.where("k IS NOT NULL").select(F.size("vector").alias("dims"), "vector", "k")
    counts = {r["dims"]: r["count"] for r in sized.groupBy("dims").count().toLocalIterator()}
    total = sum(8 * d * n for d, n in counts.items())
    tile = min(TILE, max(LEAST_TILE, -(-sum(counts.values()) // LEAST_TILES)))
    sample = sized.where(F.rand(SEED) <= min(1.0, SAMPLE_BYTES / max(total, 1))).dropDuplicates(["k"]).select("vector").toArrow()
    found = {dims: [] for dims in counts}
    for batch in sample.to_batches():
        for _, vectors in vectors_by_length(batch):
            found[vectors.shape[1]].append(unit_vectors(vectors))
    plans: dict[int, Plan] = {}
    groups = 0
    for dims, count in sorted(counts.items()):
        plans[dims] = plan_of(dims, count, np.concatenate([np.empty((0, dims)), *found[dims]]), groups, tile)
        groups += int(plans[dims].parts.sum())
    return plans, total


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    data = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), len(data), [
        None, pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32) * np.int32(data.itemsize * data.shape[1])), pa.py_buffer(data)])


def tiles_of(rows: DataFrame, plans: dict[int, Plan], total: int) -> DataFrame:
    """(dims, tile, low, high, vectors, k, l, size, least) of each tile of distinct vectors: its box, and lists by class."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, vectors in vectors_by_length(batch):
                k, l = part.column("k").to_numpy(), part.column("l").to_numpy()
                known = part.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
                ids = part.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy()
                order = np.lexsort((l, k))
                k, l = k[order], l[order]
                starts = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (l[1:] != l[:-1])))  # copies in a batch travel once
                at, k, l = order[starts], k[starts], l[starts]
                plan = plans[vectors.shape[1]]
                leaf = plan.leaves(unit_vectors(vectors[at]))
                with np.errstate(over="ignore"):
                    group = plan.first[leaf] + (shared.mixed(l.astype(np.uint64)) % plan.parts[leaf].astype(np.uint64)).astype(np.int64)
                least = pa.array(np.minimum.reduceat(ids[order], starts), mask=~np.logical_or.reduceat(known[order], starts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group), pa.array(np.full(len(at), vectors.shape[1], dtype=np.int32)), _binary(vectors[at] + vectors.dtype.type(0)),
                     pa.array(k), pa.array(l), pa.array(np.diff(np.append(starts, len(order)))), least],
                    names=["group", "dims", "vector", "k", "l", "size", "least"])

    kind = np.float32 if rows.schema["vector"].dataType.elementType.typeName() == "float" else np.float64

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dims, group = table["dims"][0].as_py(), table["group"][0].as_py()
        axes, most = plans[dims].axes[:, :BOX_AXES], 2 * plans[dims].tile
        pieces = []
        for piece, begin in enumerate(range(0, len(table), most)):
            part = table.slice(begin, most)
            data = b"".join(part["vector"].to_pylist())
            turned = (unit_vectors(np.frombuffer(data, dtype=kind).reshape(-1, dims)) @ axes).astype(np.float32)
            pieces.append({"dims": dims, "tile": group << PIECE_BITS | piece, "low": turned.min(axis=0), "high": turned.max(axis=0), "vectors": data,
                           **{c: part[c].to_pylist() for c in ("k", "l", "size", "least")}})
        return pa.Table.from_pylist(pieces, schema=pa.schema(
            {"dims": pa.int32(), "tile": pa.int64(), "low": pa.list_(pa.float32()), "high": pa.list_(pa.float32()), "vectors": pa.binary(),
             **{c: pa.list_(pa.int64()) for c in ("k", "l", "size", "least")}}))

    groups = sum(int(p.parts.sum()) for p in plans.values())
    dealt = rows.where("k IS NOT NULL").mapInArrow(deal, "group long, dims int, vector binary, k long, l long, size long, least long")
    together = dealt.repartition(max(1, min(groups, 12), total // PART_BYTES), "group")
    classes = together.groupBy("group", "dims", "vector").agg(
        F.max("k").alias("k"), F.max("l").alias("l"), F.sum("size").alias("size"), F.min("least").alias("least"))
    lists = ", ".join(f"{c} array<long>" for c in ("k", "l", "size", "least"))
    return shared.written(classes.groupBy("group").applyInArrow(
        pack, f"dims int, tile long, low array<float>, high array<float>, vectors binary, {lists}"))


@dataclass
class Tile:
    """A tile ready for comparison: unit vectors, their leading axes, sizes."""

    number: int
    unit: np.ndarray
    turned: np.ndarray
    size: np.ndarray

    def near(self, other: Tile) -> np.ndarray:
        """Places of the vectors that are near enough to the box of the other's."""
        low, high = other.turned.min(axis=0), other.turned.max(axis=0)
        out = np.maximum(low - self.turned, 0) + np.maximum(self.turned - high, 0)
        return np.flatnonzero((out * out).sum(1) <= APART + FAST_SLACK)


class Roots:
    """Groups of places joined by links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for u, v in set(zip(self.root[a].tolist(), self.root[b].tolist())):
            u, v = self.find(u), self.find(v)
            if u != v:
                self.root[max(u, v)] = min(u, v)


def _linked(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (x[a], y[b]) have a cosine of COSINE or more."""
    found = [np.einsum("ij,ij->i", x[a[at:at + 4096]], y[b[at:at + 4096]]) >= COSINE for at in range(0, len(a), 4096)]
    return np.concatenate(found) if found else np.empty(0, dtype=bool)


def _dense(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Matrix of the pairs that have a cosine of COSINE or more; pairs that single precision cannot settle are settled in double."""
    slack = (x.shape[1] + 8) * 2.0 ** -22
    cosine = x.astype(np.float32) @ y.astype(np.float32).T
    linked = cosine >= COSINE + slack
    a, b = np.nonzero(~linked & (cosine >= COSINE - slack))
    linked[a, b] = _linked(x, y, a, b)
    return linked


def _stars(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and for the columns of a matrix of links the first row that is in their component; -1 for columns without links."""
    n = len(linked)
    row = np.arange(n, dtype=np.int32)
    while True:
        column = np.where(linked, row[:, None], n).min(axis=0)
        least = np.minimum(row, np.where(linked, column, n).min(axis=1))
        if (least == row).all():
            return row, np.where(column < n, column, -1)
        row = least


def tile_links(x: Tile, y: Tile) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector of ``x`` and then, unless they are the same tile, of ``y``; a common root of linked ones, as places."""
    same = x.number == y.number
    shift = 0 if same else len(x.unit)
    links, roots = np.zeros(shift + len(y.unit), dtype=np.int64), Roots(shift + len(y.unit))
    p, q = (np.arange(len(x.unit)),) * 2 if same else (x.near(y), y.near(x))
    ones = np.ones((len(p), 1), dtype=np.float32), np.ones((len(q), 1), dtype=np.float32)
    square = [np.einsum("ij,ij->i", t, t)[:, None] for t in (x.turned[p], y.turned[q])]
    left = np.hstack([x.turned[p], square[0], ones[0]])
    right = np.ascontiguousarray(np.hstack([-2 * y.turned[q], ones[1], square[1]]).T)
    pending: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def settle() -> None:
        nonlocal waiting
        a, b = (np.concatenate([pair[k] for pair in pending]) for k in (0, 1))
        pending.clear()
        waiting = 0
        if same:
            a, b = a[a < b], b[a < b]
        linked = _linked(x.unit, y.unit, a, b)
        a, b = a[linked], b[linked]
        np.add.at(links, a, y.size[b])
        np.add.at(links, shift + b, x.size[a])
        roots.join(a, shift + b)

    apart, close = np.empty(BLOCK * BLOCK, dtype=np.float32), np.empty(BLOCK * BLOCK, dtype=bool)
    for i in range(0, len(p), BLOCK):
        for j in range(i if same else 0, len(q), BLOCK):
            u, v = p[i:i + BLOCK], q[j:j + BLOCK]
            size = len(u) * len(v)
            np.dot(left[i:i + BLOCK], right[:, j:j + BLOCK], out=apart[:size].reshape(len(u), len(v)))
            np.less_equal(apart[:size], APART + FAST_SLACK, out=close[:size])
            passed = np.flatnonzero(close[:size])
            if len(passed) * 64 < size:
                a, b = np.divmod(passed, len(v))
                pending.append((u[a], v[b]))
                waiting += len(a)
                if waiting >= 32_768:
                    settle()
            else:
                linked = _dense(x.unit[u], y.unit[v])
                if same:
                    linked &= u[:, None] < v
                weights = linked.astype(np.float64)
                links[u] += (weights @ y.size[v]).astype(np.int64)
                links[shift + v] += (x.size[u] @ weights).astype(np.int64)
                row, column = _stars(linked)
                roots.join(u, u[row])
                roots.join(shift + v[column >= 0], u[column[column >= 0]])
    if pending:
        settle()
    return links, np.array([roots.find(k) for k in range(len(links))])


def links_of(tiles: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """(class, links, root) for the classes of each pair of tiles that have links in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[int, Tile] = {}

        def tile(row: dict, side: str) -> Tile:
            number = row[f"{side}_tile"].as_py()
            if number not in ready:
                if len(ready) == KEPT_TILES:
                    del ready[next(iter(ready))]
                dims, size, data = row["dims"].as_py(), row[f"{side}_size"].values.to_numpy(), row[f"{side}_vectors"].as_buffer()
                unit = unit_vectors(np.frombuffer(data, dtype=f"f{data.size // (dims * len(size))}").reshape(-1, dims))
                ready[number] = Tile(number, unit, (unit @ plans[dims].axes[:, :plans[dims].near]).astype(np.float32), size)
            return ready[number]

        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                x = tile(row, "a")
                y = tile(row, "b")
                links, root = tile_links(x, y)
                number = np.concatenate([(t.number << TILE_BITS) + np.arange(len(t.unit)) for t in ([x] if x is y else [x, y])])
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(number[some]), pa.array(links[some]), pa.array(number[root[some]])], names=["class", "links", "root"])

    a, b = (tiles.select(F.col("dims").alias(f"{s}_dims"), *[F.col(c).alias(f"{s}_{c}") for c in ("tile", "low", "high", "vectors", "size")]) for s in "ab")
    apart = F.aggregate(F.zip_with(
        F.zip_with("a_low", "b_high", lambda x, y: x - y), F.zip_with("b_low", "a_high", lambda x, y: x - y),
        lambda x, y: F.pow(F.greatest(x, y, F.lit(0.0)), 2.0)), F.lit(0.0), lambda s, x: s + x)
    # one length only, said without an equality, which would deal all tiles of a length to one task
    meet = (F.col("a_tile") <= F.col("b_tile")) & (F.col("a_dims") <= F.col("b_dims")) & (F.col("a_dims") >= F.col("b_dims")) & (apart <= APART + FAST_SLACK)
    met = a.coalesce(LEFT_PARTS).join(b.hint("shuffle_replicate_nl"), meet).select(
        F.col("a_dims").alias("dims"), "a_tile", "b_tile", "a_vectors", "b_vectors", "a_size", "b_size")
    return shared.written(met.mapInArrow(run, "class long, links long, root long"))


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of ``embeddings``."""
    rows = keyed(embeddings)
    plans, total = plans_of(rows)
    tiles = tiles_of(rows, plans, total)
    found = links_of(tiles, plans)
    roots = components(found.select(F.col("class").alias("u"), F.col("root").alias("v")))
    linked = found.groupBy("class").agg(F.sum("links").alias("links")).join(roots, F.col("class") == F.col("node"), "left").select(
        "class", "links", F.coalesce("root", "class").alias("group"))
    places = tiles.select("tile", F.posexplode(F.arrays_zip("k", "l", "size", "least")).alias("place", "c"))
    classes = places.select((F.shiftleft("tile", TILE_BITS) + F.col("place")).alias("class"), "c.*")
    known = shared.written(classes.join(linked, "class", "left"))
    groups = known.where("group IS NOT NULL")
    least = groups.groupBy("group").agg(F.min("least").alias("component"))
    result = [F.col("k").alias("nk"), F.col("l").alias("nl"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component"]
    alone = known.where("group IS NULL").withColumn("component", F.col("least"))
    named = shared.written(groups.join(least, "group").select(*result).unionByName(alone.select(*result)))
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id", "k", "l").join(named, (F.col("k") == F.col("nk")) & (F.col("l") == F.col("nl")), "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
