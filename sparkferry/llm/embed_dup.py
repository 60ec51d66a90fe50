"""Near-duplicate embeddings: exact threshold pairs by dual traversal of cover trees.

Equal vectors of a label are one node. Each label's vectors make a tree in two parts:
* above, cells: a cell that is too large is split by pivots, far from each other, that a sample of it gives; each vector goes to its
  nearest pivot, and a cell knows its pivot and its covering radius. Levels go on until cells are small, so their number
  grows with the logarithm of a label's size, and all cells of a level are split at once, in a pass over their vectors;
* below, a cover tree for each small cell, a block: nested nets, each level's radius half the last one's, from one farthest-first
  order. It is built once and kept as one row.

Pairs are followed down both parts from the roots. A pair of cells, or of tree nodes, whose covering radii rule out a link is
pruned; a pair of nodes whose radii make every link certain is taken as a whole, so that dense groups cost no listing of their
pairs. Blocks meet only in pairs that are left. What is left at the leaves is compared exactly, by cosine in double precision.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkferry.llm._frames import Held, pick, ship
from sparkferry.llm.components import components, join_hubs

COSINE = 0.93
#: Vectors of a block, about; a cell of more than twice as many is split. Vectors of the sample that a cell's pivots are chosen
#: from, about; a cell's pivots, at most; and levels of cells, at most. A cell that is still too large then is cut by hash.
BLOCK, SAMPLE, PIVOTS, LEVELS = 2048, 512, 32, 12
#: Distances are told apart from the threshold only beyond rounding.
SLACK = 1e-7


class CoverTree:
    """Nested nets of unit vectors x with weights. Level i's net is the first sizes[i] vectors of one farthest-first order, with radius
    2 / 2^i; the last level holds all. up[i]: each net member's parent in the level above; over[i]: each vector's
    ancestor; reach[i]: how far a member's vectors are from it at most; weight[i]: their weight."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, least: float):
        n = len(x)
        order, gap = np.empty(n, np.int64), np.empty(n)
        far, now = np.full(n, np.inf), 0
        for k in range(n):
            order[k], gap[k] = now, far[now]
            if far[now] <= least:  # the rest lies close to the net: its order doesn't matter
                rest = np.ones(n, bool)
                rest[order[:k]] = False
                order[k:], gap[k:] = np.flatnonzero(rest), 0
                break
            far = np.minimum(far, chord(x @ x[now]))
            far[now] = -1
            now = int(far.argmax())
        self.order, self.x, self.w = order, x[order], weight[order].astype(float)
        self.sizes, radius = [1], 1.0
        while radius > least and self.sizes[-1] < n:
            size = int(np.searchsorted(-gap, -radius, "left"))
            if size > self.sizes[-1]:
                self.sizes.append(size)
            radius /= 2
        if self.sizes[-1] < n:
            self.sizes.append(n)
        self.up = [np.zeros(1, np.int64)]
        for above, size in zip(self.sizes, self.sizes[1:], strict=False):
            parent = np.arange(size)
            for at in range(above, size, 512):
                parent[at : min(size, at + 512)] = (self.x[at : min(size, at + 512)] @ self.x[:above].T).argmax(axis=1)
            self.up.append(parent)
        self.over = [np.arange(n)]
        for up in reversed(self.up[1:]):
            self.over.insert(0, up[self.over[0]])
        self.reach, self.weight = [], []
        for size, over in zip(self.sizes, self.over, strict=True):
            reach = np.zeros(size)
            if size < n:
                np.maximum.at(reach, over, chord(np.einsum("ij,ij->i", self.x, self.x[over])))
            self.reach.append(reach)
            self.weight.append(np.bincount(over, self.w, size))

    def packed(self, node: np.ndarray) -> bytes:
        """The tree with its vectors' node numbers (in their order before the tree's), as one row's bytes."""
        out = io.BytesIO()
        np.savez(out, x=self.x, w=self.w, node=node[self.order], sizes=np.array(self.sizes), **{f"up{i}": u.astype(np.int32) for i, u in enumerate(self.up)}, **{f"reach{i}": r for i, r in enumerate(self.reach)})
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> CoverTree:
        """A tree as `packed` made it; `node` has its vectors' node numbers."""
        got, tree = np.load(io.BytesIO(data)), cls.__new__(cls)
        tree.x, tree.w, tree.node, tree.sizes = got["x"], got["w"], got["node"], got["sizes"].tolist()
        tree.up, tree.reach = ([got[f"{kind}{i}"] for i in range(len(tree.sizes))] for kind in ("up", "reach"))
        tree.over = [np.arange(len(tree.x))]
        for up in reversed(tree.up[1:]):
            tree.over.insert(0, up[tree.over[0]])
        tree.weight = [np.bincount(over, tree.w, size) for size, over in zip(tree.sizes, tree.over, strict=True)]
        return tree


def chord(dot: np.ndarray) -> np.ndarray:
    """Distance of unit vectors by their product."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * dot))


def dual(a: CoverTree, b: CoverTree, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked weight of a's vectors and of b's, in the trees' order, and links (i, j) enough to connect all that are linked;
    vectors of b count from len(a.x) on."""
    bound = float(chord(np.float64(cosine)))
    n = len(a.x)
    got_a, got_b = np.zeros(n), np.zeros(len(b.x))
    links: list[np.ndarray] = []
    alive = np.ones((1, 1), bool)
    for level in range(max(len(a.sizes), len(b.sizes))):
        i, j = min(level, len(a.sizes) - 1), min(level, len(b.sizes) - 1)
        if level:
            alive = alive[a.up[i]] if i == level else alive
            alive = alive[:, b.up[j]] if j == level else alive
        if not alive.any():
            break
        p, q = a.sizes[i], b.sizes[j]
        last = p == n and q == len(b.x)
        rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        dots = a.x[rows] @ b.x[columns].T
        part = alive[np.ix_(rows, columns)]
        if last:
            sure = part & (dots >= cosine)
        else:
            dist, reach = chord(dots), a.reach[i][rows][:, None] + b.reach[j][columns][None]
            sure = part & (dist + reach <= bound - SLACK)
            part &= (dist - reach <= bound + SLACK) & ~sure
        if sure.any():
            take_a, take_b = np.zeros(p), np.zeros(q)
            take_a[rows] = sure @ b.weight[j][columns]
            take_b[columns] = a.weight[i][rows] @ sure
            got_a += take_a[a.over[i]]
            got_b += take_b[b.over[j]]
            u, v = np.nonzero(sure)
            links.append(np.column_stack([rows[u], n + columns[v]]))
            if not last:
                for take, over, offset in ((take_a, a.over[i], 0), (take_b, b.over[j], n)):
                    under = np.flatnonzero(take[over] > 0)
                    links.append(np.column_stack([under + offset, over[under] + offset]))
        alive = np.zeros((p, q), bool)
        if last:
            break
        alive[np.ix_(rows, columns)] = part
    return got_a, got_b, np.concatenate(links) if links else np.zeros((0, 2), np.int64)


def smallest_label(n: int, links: np.ndarray) -> np.ndarray:
    """For each of n places, the smallest that links connect it to."""
    label = np.arange(n)
    u, v = links[:, 0], links[:, 1]
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            return label
        label = new


def normalized(column: pa.Array, wanted: np.ndarray) -> tuple[list[bytes | None], np.ndarray]:
    """Each vector's unit vector as bytes of doubles, or None where it has no direction or isn't wanted, and each one's length.
    Vectors of one length are one matrix; those of any row are made alike, so that equal vectors have equal bytes."""
    column = column.cast(pa.list_(pa.float64()))
    values, ends = column.values, column.offsets.to_numpy()
    flat = values.to_numpy(zero_copy_only=False)  # nulls are nan
    dims = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
    units: list[bytes | None] = [None] * len(column)
    for dim in np.unique(dims[dims > 0]):
        rows = np.flatnonzero((dims == dim) & wanted)
        x = flat[ends[rows][:, None] + np.arange(dim)[None]]
        most = np.abs(x).max(axis=1)
        fine = np.isfinite(most) & (most > 0)  # a nan makes the maximum nan
        x, most, rows = x[fine], most[fine], rows[fine]
        odd = (most <= 1e-100) | (most >= 1e100)
        x[odd] /= most[odd][:, None]  # squares stay within range
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        for row, unit in zip(rows.tolist(), x, strict=True):
            units[row] = unit.tobytes()
    return units, dims


def _units(df: DataFrame) -> DataFrame:
    """Rows with rid, unit (doubles, null for a vector without a direction), dim and key (of label and vector)."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name != "v"], *T._parse_datatype_string("rid long, unit binary, dim int, key binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyspark import TaskContext

        rid = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for b in batches:
            units, dims = normalized(b.column("v"), b.column("label").is_valid().to_numpy(zero_copy_only=False))
            salts: dict = {}
            keys = []
            for unit, label in zip(units, b.column("label").to_pylist(), strict=True):
                if unit is not None and label not in salts:
                    salts[label] = hashlib.blake2b(repr(label).encode(), digest_size=16).digest()
                keys.append(hashlib.blake2b(unit, digest_size=16, salt=salts[label]).digest() if unit is not None else None)
            made = [pa.array(np.arange(rid, rid + b.num_rows)), pa.array(units, pa.binary()), pa.array(dims, pa.int32()), pa.array(keys, pa.binary())]
            rid += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), *made], schema.names)

    return df.mapInArrow(run, schema)


def _cells(members: DataFrame) -> Held:
    """The cells of members: (cell, up, center, reach, n), where up is the cell that it was cut from, or itself."""
    return Held(members.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("reach"), F.first("center").alias("center"), F.first("up").alias("up")))


def _split(members: DataFrame, cells: DataFrame, level: int) -> Held:
    """Members in new cells, where theirs were too large.

    A sample that is bounded for each cell gives its pivots, one row for each cell; vectors meet them in chunks of about a block.
    """
    marked = join_hubs(members.drop("up"), cells.select("cell", "n"), "cell", members.count())
    place = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def choose(t: pa.Table) -> pa.Table:
        x = np.stack([np.frombuffer(u) for u in sorted(t.column("unit").to_pylist())])
        most = max(2, min(PIVOTS, -(-t.column("n")[0].as_py() // BLOCK)))
        pivots = x[CoverTree(x, np.ones(len(x)), 0.0).order[:most]]
        return pa.table({"cell": t.column("cell").slice(0, 1), "pivots": pa.array([pivots.tobytes()], pa.binary())})

    pivots = Held(marked.where((F.col("n") > 2 * BLOCK) & (place < SAMPLE / F.col("n"))).select("cell", "unit", "n").groupBy("cell").applyInArrow(choose, "cell string, pivots binary"))
    chunks = F.ceil(F.col("n") / BLOCK).cast("int")
    todo = marked.where(F.col("n") > 2 * BLOCK).withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int"))
    each = pivots.df.join(cells.select("cell", "n"), "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("n")

    def assign(t: pa.Table, p: pa.Table) -> pa.Table:
        keep = t.select(["node", "w", "unit", "dim"])
        if not t.num_rows or not p.num_rows:  # chance may leave a cell without a sample: it waits for the next level
            return pa.Table.from_arrays([*keep.columns, *[t.column(c) for c in ("cell", "gap", "center", "cell")]], [*keep.schema.names, "cell", "gap", "center", "up"])
        x = np.stack([np.frombuffer(u) for u in t.column("unit").to_pylist()])
        table = np.frombuffer(p.column("pivots")[0].as_py()).reshape(-1, x.shape[1])
        dots = x @ table.T
        near = dots.argmax(axis=1)
        name, centers = t.column("cell")[0].as_py(), [c.tobytes() for c in table]
        made = [pa.array([f"{name}/{k}" for k in near.tolist()]), pa.array(chord(dots.max(axis=1))), pa.array([centers[k] for k in near.tolist()], pa.binary()), t.column("cell")]
        return pa.Table.from_arrays([*keep.columns, *made], [*keep.schema.names, "cell", "gap", "center", "up"])

    split = todo.groupBy("cell", "chunk").cogroup(each.groupBy("cell", "chunk")).applyInArrow(assign, "node long, w long, unit binary, dim int, cell string, gap double, center binary, up string")
    out = Held(marked.where(F.col("n") <= 2 * BLOCK).withColumn("up", F.col("cell")).select(*split.columns).unionByName(split))
    pivots.drop()
    return out


def _open_pairs(pairs: DataFrame, bound: float) -> DataFrame:
    """Of pairs of cells (a, b, ca, cb, reach: both together), those that their covering radii leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for i, (x, y, reach) in enumerate(zip(b.column("ca").to_pylist(), b.column("cb").to_pylist(), b.column("reach").to_pylist(), strict=True)):
                if x is not None and y is not None and x != y:
                    keep[i] = chord(np.float64(np.frombuffer(x) @ np.frombuffer(y))) - reach <= bound + SLACK
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a string, b string")


def grouped(df: DataFrame, vector: str = "embedding", label: str = "label", key: str = "vec_id", cosine: float = COSINE) -> DataFrame:
    """A row for each row: key, n_links (other rows of the same label with at least that cosine), component_id (the smallest key that
    links lead to, itself included) and kept (key = component_id).

    A null label, and a vector that is null, empty or zero, or has a null or non-finite part, links with nothing; so do
    vectors of different lengths. Equal vectors link; repeated rows are such. Null keys are their own component's only
    where it has no other. An empty table gives an empty one; other columns may have any name. 0 < cosine <= 1.
    """
    ship(df.sparkSession)
    rows = Held(_units(pick(df, id=key, label=label, v=vector)))
    h = rows.df
    none = F.col("id").isNull().alias("none")
    nodes = Held(
        h.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct(none, "id", "rid")).alias("rep"), F.count("*").alias("n"), F.first(F.struct("label", "dim", "unit")).alias("v"))
        .select("key", F.col("rep.rid").alias("node"), F.col("rep.none").alias("none"), F.col("rep.id").alias("id"), "n", "v.label", "v.dim", "v.unit")
    )
    total = nodes.df.count()
    bound = float(chord(np.float64(cosine)))
    cell = F.concat_ws(":", "dim", F.sha2(F.col("label").cast("string"), 256))
    members = Held(nodes.df.select("node", F.col("n").alias("w"), "unit", "dim", cell.alias("cell"), F.lit(2.0).alias("gap"), F.lit(None).cast("binary").alias("center"), cell.alias("up")))
    cells, before = _cells(members.df), float("inf")
    pairs = Held(cells.df.select(F.col("cell").alias("a"), F.col("cell").alias("b")))
    for level in range(LEVELS):
        largest = cells.df.agg(F.max("n")).first()[0] or 0
        if largest <= 2 * BLOCK or largest > 0.9 * before:  # pivots that hardly cut it again never will
            break
        before, old = largest, (members, cells, pairs)
        members = _split(members.df, cells.df, level)
        cells = _cells(members.df)
        one, two = (cells.df.select(F.col("up").alias(s), F.col("cell").alias(f"{s}2"), F.col("center").alias(f"c{s}"), F.col("reach").alias(f"r{s}")) for s in "ab")
        children = pairs.df.join(one, "a").join(two, "b").where((F.col("a") != F.col("b")) | (F.col("a2") <= F.col("b2")))
        pairs = Held(_open_pairs(children.select(F.col("a2").alias("a"), F.col("b2").alias("b"), "ca", "cb", (F.col("ra") + F.col("rb")).alias("reach")), bound))
        for used in old:
            used.drop()

    # Blocks: small cells as they are; a cell that no pivots made small is cut by hash.
    parts = F.when(F.col("n") > 2 * BLOCK, F.ceil(F.col("n") / BLOCK)).otherwise(1).cast("int")
    sized = join_hubs(members.df.drop("gap", "center", "up"), cells.df.select("cell", "n"), "cell", total)
    named = sized.withColumn("block", F.concat_ws(":", F.pmod(F.xxhash64("node"), parts), "cell")).select("block", "node", "w", "unit")

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        x = np.stack([np.frombuffer(u) for u in t.column("unit").to_pylist()])
        tree = CoverTree(x, t.column("w").to_numpy(), bound / 8)
        return pa.table({"block": t.column("block").slice(0, 1), "tree": pa.array([tree.packed(t.column("node").to_numpy())], pa.binary())})

    blocks = Held(named.groupBy("block").applyInArrow(build, "block string, tree binary"))
    numbers = cells.df.select("cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("k")).select("cell", F.concat_ws(":", "k", "cell").alias("block"))
    left, right = (numbers.select(F.col("cell").alias(s), F.col("block").alias(f"block{s}")) for s in "ab")
    met = pairs.df.join(left, "a").join(right, "b").where((F.col("a") != F.col("b")) | (F.col("blocka") < F.col("blockb"))).select("blocka", "blockb")

    def found_in(a: CoverTree, b: CoverTree | None) -> pa.RecordBatch:
        got_a, got_b, links = dual(a, a if b is None else b, cosine)
        if b is None:
            every, got = a.node, got_a - a.w
            links = np.where(links >= len(every), links - len(every), links)
        else:
            every, got = np.concatenate([a.node, b.node]), np.concatenate([got_a, got_b])
        root = every[smallest_label(len(every), links)]
        use = (got > 0.5) | (root != every)
        return pa.RecordBatch.from_arrays([pa.array(every[use]), pa.array(np.rint(got[use]).astype(np.int64)), pa.array(root[use])], ["node", "links", "root"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column("tree"):
                yield found_in(CoverTree.unpacked(row.as_py()), None)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column("treea"), batch.column("treeb"), strict=True):
                yield found_in(CoverTree.unpacked(one.as_py()), CoverTree.unpacked(two.as_py()))

    both = met.join(blocks.df.select(F.col("block").alias("blocka"), F.col("tree").alias("treea")), "blocka").join(blocks.df.select(F.col("block").alias("blockb"), F.col("tree").alias("treeb")), "blockb")
    schema = "node long, links long, root long"
    found = Held(blocks.df.select("tree").mapInArrow(within, schema).unionByName(both.select("treea", "treeb").mapInArrow(across, schema)))
    for used in (members, cells, pairs, blocks):
        used.drop()
    roots = components(found.df.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.df.groupBy("node").agg(F.sum("links").alias("links"))
    of = nodes.df.select("key", "node", "none", "id", F.col("n").alias("copies")).join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = of.groupBy("root").agg(F.min(F.struct("none", "id")).alias("best"), F.count("*").alias("n"))
    of = join_hubs(of, best, "root", total).select("key", F.col("copies").alias("n"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("best.id").alias("component_id"))
    linked = join_hubs(h.where(F.col("key").isNotNull()).select("id", "key"), of, "key", h.count())
    linked = linked.select("id", "n_links", "component_id")
    out = linked.unionByName(h.where(F.col("key").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
