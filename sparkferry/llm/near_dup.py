"""Near-duplicate documents by ProbMinHash signatures, banding, and exact verification.

Shingles are five words in a row (lower case; a text of fewer words is one shingle), weighted by their count. Each
shingle is a Poisson process whose rate is its weight, with times and registers from its hash; a register keeps its first
arrival; an element stops as soon as its next arrival is after the last register's. The share of equal registers estimates the
probability Jaccard similarity J, which for weights of 1 is the Jaccard similarity of the shingle sets.

Two measures can be asked for. `dice` (the default) is 2 J / (1 + J): the share of both texts' shingle weight that they have
in common, for sets Dice's coefficient. `jaccard` is J itself. One is a function of the other, so bands and verification work on
J in either case; a `dice` of 0.8 is a J of 2 / 3.

Texts with the same counted shingles are one class. Classes that agree in all registers of a band share a bucket. Buckets'
candidates are verified by their exact similarity, in three turns, so that a bucket's pairs are never all listed:
1. each class with one pivot (a bucket's first class): enough to gather most groups;
2. in small buckets all pairs, in large ones each class with two pivots, unless already gathered;
3. in large buckets that still hold several groups, the largest group with all others and those among themselves, block by
   block of bounded size, by products of the blocks' shingle matrices; only links that join groups leave the task.
Only links within a group already gathered are left out; groups are the same as by verifying every candidate pair.

There is one plan for every size. Whole texts meet lists of row ids twice (whose shingles are needed, which rows go); there a filter of
a fixed 8 MB goes before the shuffle, so that only rows that may be on the list are moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkferry.llm._frames import Held, pick, release, ship, slices, text_offsets, with_ids, without_ids
from sparkferry.llm._words import folded, mix, words
from sparkferry.llm.components import components, join_hubs

WORDS, SIMILAR = 5, 0.8
#: Registers of a band, and bands: a pair of Dice similarity 0.8 shares none of them with probability 1.5e-4, one of Jaccard similarity 0.8 with 6e-10.
BAND, BANDS = 4, 40
REGISTERS = BAND * BANDS
#: Buckets up to this size list all their pairs, which is linear in the table; blocks of larger ones have about so many classes.
SMALL, BLOCK = 16, 512
_GOLD, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: What the words of a shingle are multiplied by.
_PLACES = np.arange(1, 2 * WORDS, 2, dtype=np.uint64) * _ODD


def least_jaccard(similar: float, measure: str) -> float:
    """The probability Jaccard similarity at which a measure reaches `similar`."""
    if measure not in ("dice", "jaccard"):
        raise ValueError(f"unknown measure {measure!r}")
    return similar / (2 - similar) if measure == "dice" else similar


def shingles(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sorted distinct shingle hashes and their counts, of each text."""
    text, _, _, h = words(data, offsets)
    n = len(offsets) - 1
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * n
    if not len(h):
        return out
    whole = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        whole += h[k : len(h) - WORDS + 1 + k] * _PLACES[k]
    whole = mix(whole)
    ends = np.searchsorted(text, np.arange(n), "right")
    begin = 0
    for d in range(n):
        end = int(ends[d])
        count = end - begin
        if count >= WORDS:
            out[d] = np.unique(whole[begin : end - WORDS + 1], return_counts=True)
        elif count:
            out[d] = (mix(np.sum(h[begin:end] * _PLACES[:count], dtype=np.uint64, keepdims=True) + np.full(1, count, np.uint64)), np.ones(1, np.int64))
        begin = end
    return out


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], counted: bool = False, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash: texts x registers of element hashes; zeros for empty sets."""
    n = len(sets)
    out = np.zeros((n, registers), np.uint64)
    h = np.concatenate([s[0] for s in sets]) if n else np.zeros(0, np.uint64)
    if not len(h):
        return out
    doc = np.repeat(np.arange(n), [len(s[0]) for s in sets])
    rate = np.concatenate([s[1] for s in sets]).astype(float) if counted else None
    first = np.full(n * registers, np.inf)
    flat = out.reshape(-1)
    time, drawn = np.zeros(len(h)), 0
    while len(h):
        # Few elements that still run draw many arrivals at once.
        k = int(np.clip(4096 // len(h), 1, 64)) if drawn else 1
        step = mix(h[:, None] + np.arange(drawn + 1, drawn + k + 1, dtype=np.uint64)[None] * _GOLD)
        gaps = -np.log(((step >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52)
        times = time[:, None] + np.cumsum(gaps, axis=1)
        at = doc[:, None] * registers + (mix(step ^ _ODD) % np.uint64(registers)).astype(np.int64)
        real = times if rate is None else times / rate[:, None]
        np.minimum.at(first, at.reshape(-1), real.reshape(-1))
        won = real == first[at]
        flat[at[won]] = np.broadcast_to(h[:, None], at.shape)[won]
        time, drawn = times[:, -1], drawn + k
        last = first.reshape(n, registers).max(axis=1)
        going = real[:, -1] < last[doc]
        h, doc, time = h[going], doc[going], time[going]
        rate = rate[going] if rate is not None else None
    return out


def bands_of(signature: np.ndarray) -> np.ndarray:
    """Texts x BANDS: a hash of each band's number and registers."""
    parts = signature.reshape(len(signature), BANDS, BAND)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD, parts.shape[:2])
    for k in range(BAND):
        h = mix(h ^ parts[:, :, k]) + _ODD
    return mix(h)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], counted: bool = False) -> float:
    """Exact: Jaccard, or with counts probability Jaccard, sum over common i of 1 / sum over j of max(a_j / a_i, b_j / b_i)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    if not counted or (a[1] == 1).all() and (b[1] == 1).all():
        both = len(np.intersect1d(a[0], b[0], assume_unique=True))
        return both / (len(a[0]) + len(b[0]) - both)
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])], y[np.searchsorted(every, b[0])] = a[1], b[1]
    common = np.flatnonzero((x > 0) & (y > 0))
    # Sorted by x / y, the maximum is x_j / x_i up to a place and y_j / y_i from it on.
    order = np.argsort(np.divide(x, y, out=np.full(len(x), np.inf), where=y > 0), kind="stable")
    sx, sy = np.cumsum(x[order][::-1])[::-1], np.cumsum(y[order])
    ratio = np.divide(x, y, out=np.full(len(x), np.inf), where=y > 0)[order]
    place = np.searchsorted(ratio, x[common] / y[common], "right")
    tail = np.append(sx, 0)[place] / x[common]
    head = np.concatenate([[0], sy])[place] / y[common]
    return float(np.sum(1 / (tail + head)))


def _signed(df: DataFrame, counted: bool) -> DataFrame:
    """Rows with rid, key (of the shingle set), n, bands."""
    fields = df.schema.fields
    schema = T.StructType([*fields, *T._parse_datatype_string("rid long, key binary, n int, bands array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyspark import TaskContext

        rid = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for whole in batches:
            for b in slices(whole, "text__"):
                data, offsets = text_offsets(b.column("text__"))
                sets = shingles(*text_offsets(folded(b.column("text__"))))
                bands = bands_of(signatures(sets, counted)).view(np.int64)
                keys, found = [], []
                for i, (h, w) in enumerate(sets):
                    if len(h):
                        keys.append(hashlib.blake2b(h.tobytes() + (w.tobytes() if counted else b""), digest_size=16).digest())
                        found.append(bands[i])
                    else:  # without a word only equal texts are alike
                        raw = data[offsets[i] : offsets[i + 1]].tobytes()
                        keys.append(hashlib.blake2b(raw, digest_size=16, person=b"no words").digest() if raw else None)
                        found.append(bands[i][:0])
                made = [
                    pa.array(np.arange(rid, rid + b.num_rows)), pa.array(keys, pa.binary()), pa.array([len(h) for h, _ in sets], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32()), pa.array(np.concatenate(found), pa.int64())),
                ]
                rid += b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(f.name)) for f in fields] + made, schema.names)

    return df.mapInArrow(run, schema)


def _shingle_sets(rows: DataFrame) -> DataFrame:
    """(node, h, w): the sorted shingle hashes and counts of texts, as bytes."""
    schema = "node long, h binary, w binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text__"):
                sets = shingles(*text_offsets(folded(b.column("text__"))))
                yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array([h.tobytes() for h, _ in sets], pa.binary()), pa.array([w.astype("<i4").tobytes() for _, w in sets], pa.binary())], ["node", "h", "w"])

    return rows.mapInArrow(run, schema)


def _verified(pairs: DataFrame, sets: DataFrame, counted: bool) -> DataFrame:
    """pairs (a, b) with their exact similarity s. A pivot's many pairs are split by adaptive execution's skew join."""
    schema = "a long, b long, s double"
    columns = ["h", *["w"] * counted]
    left = sets.select(F.col("node").alias("a"), *[F.col(c).alias(f"a{c}") for c in columns])
    right = sets.select(F.col("node").alias("b"), *[F.col(c).alias(f"b{c}") for c in columns])
    both = pairs.join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int, tuple] = (-1, ())
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                rows = whole.slice(at, 256).to_pydict()
                out = []
                for i in range(len(rows["a"])):
                    if known[0] != rows["a"][i]:
                        known = (rows["a"][i], _set(rows, "a", i, counted))
                    out.append(similarity(known[1], _set(rows, "b", i, counted), counted))
                yield pa.RecordBatch.from_arrays([pa.array(rows["a"], pa.int64()), pa.array(rows["b"], pa.int64()), pa.array(out, pa.float64())], ["a", "b", "s"])

    return both.mapInArrow(run, schema)


def _set(rows: dict, side: str, i: int, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(rows[f"{side}h"][i], np.uint64), np.frombuffer(rows[f"{side}w"][i], "<i4") if counted else np.zeros(0)


def _joining_pairs(sets: list[tuple[np.ndarray, np.ndarray]], root: np.ndarray, least: float, counted: bool) -> list[tuple[int, int]]:
    """Index pairs of similar sets, enough to join all roots that similar pairs join.

    With P the share of a's weight on shingles that b has too, and Q that of b's on a's, probability Jaccard is at most
    1 / (1/P + 1/Q - 1): harmonic means are concave, so the sum over common shingles is at most that of their sums. P and Q of all
    pairs are one product of matrices, over the shingles that several sets have; only pairs that the bound leaves are verified.
    """
    n, sizes = len(sets), np.array([len(h) for h, _ in sets])
    _, where, times = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True, return_counts=True)
    share = np.concatenate([w / w.sum() if counted else np.full(len(h), 1 / len(h)) for h, w in sets]).astype(np.float32)
    row, shared = np.repeat(np.arange(n), sizes), times[where] > 1
    place = np.cumsum(times > 1)[where[shared]] - 1
    on = np.zeros((n, n), np.float32)
    order = np.argsort(place, kind="stable")
    row, place, share = row[shared][order], place[order], share[shared][order]
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):  # so many shingles at a time
        low, high = np.searchsorted(place, (at, at + 4096))
        weight, there = np.zeros((n, 4096), np.float32), np.zeros((n, 4096), np.float32)
        weight[row[low:high], place[low:high] - at] = share[low:high]
        there[row[low:high], place[low:high] - at] = 1
        on += weight @ there.T
    with np.errstate(divide="ignore"):
        bound = 1 / (1 / on + 1 / on.T - 1)
    found = np.argwhere(np.triu((bound >= least - 1e-3) & (root[:, None] != root), 1))
    found = found[np.argsort(-bound[found[:, 0], found[:, 1]], kind="stable")]
    group = {r: r for r in root.tolist()}

    def top(r: int) -> int:
        while group[r] != r:
            group[r] = group[group[r]]
            r = group[r]
        return r

    out = []
    for i, j in found.tolist():
        a, b = top(int(root[i])), top(int(root[j]))
        if a != b and similarity(sets[i], sets[j], counted) >= least:
            group[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _blocks(rows: DataFrame) -> DataFrame:
    """Entries (band, node, root, and of the bucket n, top: its largest group, n_top) dealt to pairs of blocks (band, kind, i, j), so that each
    pair of different groups meets. Kind `top`: block i of the largest group with block j of the others; kind `rest`: two
    blocks of the others. So copies of an entry grow with the others, not with the bucket."""
    top, others = F.col("root") == F.col("top"), F.col("n") - F.col("n_top")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    mine, facing = F.when(top, blocks(F.col("n_top"))).otherwise(blocks(others)), F.when(top, blocks(others)).otherwise(blocks(F.col("n_top")))
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    met = rows.select("band", "node", "root", top.alias("is_top"), place(mine).alias("block"), F.explode(F.sequence(F.lit(0), facing - 1)).alias("other"))
    met = met.select("band", "node", "root", F.lit("top").alias("kind"), F.when(F.col("is_top"), F.col("block")).otherwise(F.col("other")).alias("i"), F.when(F.col("is_top"), F.col("other")).otherwise(F.col("block")).alias("j"))
    rest = rows.where(~top & (others > 1)).select("band", "node", "root", place(blocks(others)).alias("block"), F.explode(F.sequence(F.lit(0), blocks(others) - 1)).alias("other"))
    rest = rest.select("band", "node", "root", F.lit("rest").alias("kind"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return met.unionByName(rest)


def _cross_links(rows: DataFrame, least: float, counted: bool) -> DataFrame:
    """Links (a, b) enough to join all groups that are similar across or within (band, kind, i, j), a pair of blocks."""

    def run(t: pa.Table) -> pa.Table:
        node, root = t.column("node").to_numpy(), t.column("root").to_numpy()
        w = t.column("w").to_pylist() if counted else [b""] * len(node)
        sets = [(np.frombuffer(h, np.uint64), np.frombuffer(x, "<i4")) for h, x in zip(t.column("h").to_pylist(), w, strict=True)]
        pairs = np.array(_joining_pairs(sets, root, least, counted), np.int64).reshape(-1, 2)
        links = np.unique(np.sort(root[pairs], axis=1), axis=0) if len(pairs) else np.zeros((0, 2), np.int64)
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    return rows.groupBy("band", "kind", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _groups(h: DataFrame, least: float, counted: bool) -> DataFrame:
    """For each key (a counted shingle set) of signed rows: n (its rows), class_id, component_id, and the rid of the component's row that stays."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid"))
    classes = Held(
        h.where(F.col("key").isNotNull()).groupBy("key").agg(first.alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands"))
        .select("key", F.col("rep.rid").alias("node"), F.col("rep.none").alias("none"), F.col("rep.id").alias("id"), "n", "bands")
    )
    entries = classes.df.select(F.explode("bands").alias("band"), "node")
    buckets = entries.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("p1"), F.max("node").alias("p2")).where("n > 1")
    total = classes.df.count()
    shared = Held(join_hubs(entries, buckets, "band", total * BANDS))
    m = shared.df

    # Shingle sets of the classes that share a bucket.
    sets = Held(_shingle_sets(with_ids(h.select("rid", "text__"), m.select(F.col("node").alias("rid")), "rid")))

    pairs = m.where("node != p1").groupBy("node").agg(F.min("p1").alias("a")).select("a", F.col("node").alias("b"))
    done = Held(_verified(pairs, sets.df, counted))
    links = done.df.where(F.col("s") >= least).select("a", "b")
    roots = components(links)

    def rooted(rows: DataFrame, column: str, as_: str) -> DataFrame:
        """rows with a class's root: itself where it has no link."""
        found = rows.join(roots.select(F.col("node").alias(column), F.col("root").alias("__r")), column, "left")
        return found.withColumn(as_, F.coalesce("__r", column)).drop("__r")

    low, high = m.where(F.col("n") <= SMALL), m.where(F.col("n") > SMALL)
    small = low.select("band", F.col("node").alias("a")).join(low.select("band", F.col("node").alias("b")), "band").where("a < b").select("a", "b").distinct()
    stars = high.select(F.col("p1").alias("a"), F.col("node").alias("b")).unionByName(high.select(F.col("node").alias("a"), F.col("p2").alias("b"))).where("a < b").distinct()
    open_ = rooted(rooted(small, "a", "ra"), "b", "rb").where("ra != rb").select("a", "b").unionByName(stars).distinct().join(done.df.select("a", "b"), ["a", "b"], "left_anti")
    more = Held(_verified(open_, sets.df, counted))
    release(roots)
    links = done.df.unionByName(more.df).where(F.col("s") >= least).select("a", "b")
    roots = components(links)

    # Large buckets that hold several groups: what is in the largest one is compared with all others, but not within itself.
    big = rooted(high, "node", "root")
    groups = big.groupBy("band", "root").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    mixed = Held(groups.groupBy("band").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("groups"), F.first("n").alias("n")).where("groups > 1").select("band", F.col("m.root").alias("top"), F.col("m.c").alias("n_top"), "n"))
    if not mixed.df.isEmpty():
        last = Held(_cross_links(_blocks(join_hubs(big.select("band", "node", "root"), mixed.df, "band", total * BANDS)).join(sets.df, "node"), least, counted))
        final = components(links.unionByName(last.df))
        release(roots)
        roots = final
        last.drop()
    for used in (shared, sets, done, more, mixed):
        used.drop()

    of_class = rooted(classes.df.select("node", "none", "id", F.col("n").alias("copies"), "key"), "node", "root")
    best = of_class.groupBy("root").agg(F.min(F.struct("none", "id", "node")).alias("best"), F.count("*").alias("n"))
    return join_hubs(of_class, best, "root", total).select("key", F.col("copies").alias("n"), F.col("id").alias("class_id"), F.col("best.id").alias("component_id"), F.col("best.node").alias("keeper"))


def grouped(df: DataFrame, text: str = "text", key: str = "doc_id", similar: float = SIMILAR, counted: bool = True, measure: str = "dice") -> DataFrame:
    """A row for each row: the key, class_id (the smallest key of the rows with the same counted shingles), component_id (the
    smallest key that links of at least `similar` lead to), n_class (rows of its class) and kept (true for one row of each
    component: the one of the smallest key).

    Words are runs of letters, digits and underscores, in lower case; punctuation and blanks of all alphabets part them. Texts
    without a word are alike if they are equal. Null and empty texts link with nothing: each is kept, its ids are its
    own key. Null keys come after others, and repeated rows are copies of each other; an empty table gives an empty one;
    other columns may have any name. counted: shingles weigh their count, else 1. measure: `dice` or `jaccard`.
    """
    ship(df.sparkSession)
    h = Held(_signed(pick(df, id=key, text__=text), counted)).df
    classes = _groups(h, least_jaccard(similar, measure), counted)
    alike = join_hubs(h.where(F.col("key").isNotNull()).select("id", "rid", "key"), classes, "key", h.count())
    alike = alike.select(F.col("id").alias(key), "class_id", "component_id", F.col("n").alias("n_class"), (F.col("keeper") == F.col("rid")).alias("kept"))
    alone = h.where(F.col("key").isNull()).select(F.col("id").alias(key), F.col("id").alias("class_id"), F.col("id").alias("component_id"), F.lit(1).cast("long").alias("n_class"), F.lit(True).alias("kept"))
    return alike.unionByName(alone)


def deduplicated(df: DataFrame, text: str = "text", key: str = "doc_id", similar: float = SIMILAR, counted: bool = True, measure: str = "dice") -> DataFrame:
    """The rows of df that `grouped` would keep, with all columns. Rows that nothing is like are not shuffled."""
    ship(df.sparkSession)
    names = {f"k{i}": c for i, c in enumerate(df.columns)}
    places = {c: k for k, c in names.items()}
    wide = pick(df, **names).withColumns({"id": F.col(places[key]), "text__": F.col(places[text])})
    h = Held(_signed(wide.drop(places[text]), counted)).df
    classes = _groups(h, least_jaccard(similar, measure), counted).select("key", "n", "keeper")
    gone = Held(join_hubs(h.where(F.col("key").isNotNull()).select("rid", "key"), classes, "key", h.count()).where("keeper != rid").select("rid"))
    release(classes)
    return without_ids(h, gone.df, "rid").select(*[F.col("text__" if c == text else k).alias(c) for k, c in names.items()])
