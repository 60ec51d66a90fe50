import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkferry.llm import components as cc
from sparkferry.llm import embed_dup, near_dup
from sparkferry.llm.queries import QUERIES
from tests.llm.helpers import ODD, clashing, empty, odd


def united(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("seed,n,m", [(0, 30, 20), (1, 200, 190), (2, 200, 400)])
def test_components(spark, seed, n, m):
    r = random.Random(seed)
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n, n + 100)] + [(n + 200, n + 201 + i) for i in range(150)]
    want = united(n + 400, pairs)
    got = {x.node: x.root for x in cc.components(spark.createDataFrame(pairs, "a long, b long").repartition(4)).collect()}
    assert got == {x: want[x] for p in pairs if p[0] != p[1] for x in p}


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(cc, "max", lambda *a: 3, raising=False)  # nearly all nodes are hubs
    pairs = [(i, i % 7) for i in range(100)]
    want = united(100, pairs)
    assert {x.node: x.root for x in cc.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == {x: want[x] for p in pairs if p[0] != p[1] for x in p}


def test_components_of_nothing(spark):
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


BLANKS = re.compile("[\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7\u1680\u2000-\u206f\u3000-\u303f\ufeff\uff01-\uff0f]")


def shingle_counts(text):
    words = re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", BLANKS.sub(" ", text.lower()))
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else collections.Counter()


def probability_jaccard(p, q):
    """By its definition, over all shingles of both."""
    common = p.keys() & q.keys()
    if min(sum(p[g] for g in common) / sum(p.values()), sum(q[g] for g in common) / sum(q.values())) < 0.3:
        return 0.0  # it is at most either share
    if max(p.values()) == max(q.values()) == 1:
        return len(common) / len(p | q)
    every = list(p | q)
    x, y = np.array([p[g] for g in every], float), np.array([q[g] for g in every], float)
    return sum(1 / np.maximum(x / p[g], y / q[g]).sum() for g in common)


def brute_groups(texts, similar=0.8, measure="dice"):
    sets = [shingle_counts(t or "") for t in texts]
    pairs = []
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                s = probability_jaccard(sets[i], sets[j])
                if (2 * s / (1 + s) if measure == "dice" else s) >= similar - 1e-12:
                    pairs.append((i, j))
            elif texts[i] and texts[i] == texts[j]:
                pairs.append((i, j))
    return united(len(texts), pairs)


def check(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in near_dup.grouped(df, **options).collect()}
    want = brute_groups(texts, measure=options.get("measure", "dice"))
    assert {i: r.component_id for i, r in got.items()} == dict(enumerate(want))
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    kept = sorted(r.doc_id for r in near_dup.deduplicated(df, **options).collect())
    assert kept == sorted(set(want))


def varied(r, words, changes):
    out = list(words)
    for _ in range(changes):
        out[r.randrange(len(out))] = f"w{r.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("small,block,measure", [(16, 128, "dice"), (2, 4, "dice"), (2, 4, "jaccard")])
def test_groups_like_brute_force(spark, monkeypatch, small, block, measure):
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    r = random.Random(7)
    shared = [f"s{i}" for i in range(120)]
    texts = []
    for g in range(12):
        base = shared[: 10 * g] + [f"g{g}x{i}" for i in range(150 - 10 * g)]
        texts += [varied(r, base, r.randrange(9)) for _ in range(15)]
    chain = [f"c{i}" for i in range(400)]
    texts += [" ".join(chain[12 * k : 12 * k + 150]) for k in range(20)]  # each near the next, far from the others
    texts += ["one two", "One, two!", "one two three", "", "", None, "%%%", "%%%", "%%", texts[0], texts[0].upper()]
    for g in range(4):  # repeated lines: sets of unlike size, and weights that outvote them
        line = " ".join(f"l{g}x{i}" for i in range(6))
        texts += [" ".join([line] * r.randrange(3, 60) + [f"t{r.randrange(10**6)}" for _ in range(r.randrange(40))]) for _ in range(8)]
    check(spark, texts, measure=measure)


def test_groups_of_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r.component_id for r in QUERIES["op7_probminhash_near_dup"](spark, "/root/testdata/sf0.001").collect()}
    ids = [r.doc_id for r in rows]
    want = brute_groups([r.text for r in rows])
    assert got == {ids[i]: ids[w] for i, w in enumerate(want)}


def test_words_beyond_ascii(spark):
    text = "L\u2019\u00e9t\u00e9 \u00e0 Gen\u00e8ve \u00ab\u00a0o\u00f9 l\u2019\u00c9glise est belle\u00a0\u00bb \u2014 \u00f1and\u00fa \u00dcber allen Gipfeln ist Ruh " * 2
    check(spark, [text, text.upper(), text.replace("\u2014", "\u2013").replace("\u2019", "'"), "\u03a3\u03cd\u03bd\u03bf\u03bb\u03bf \u03b1 \u03b2 \u03b3 \u03b4 \u03b5", "\u0416\u0418\u0417\u041d\u042c \u0430 \u0431 \u0432 \u0433", "\u0436\u0438\u0437\u043d\u044c \u0410 \u0411 \u0412 \u0413"])


@pytest.mark.parametrize("bits", [1 << 26, 1 << 15, 64])
def test_rows_by_ids(spark, monkeypatch, bits):
    from sparkferry.llm import _frames

    monkeypatch.setattr(_frames, "FILTER_BITS", bits)
    rows = spark.range(5000).select(F.col("id").alias("rid"), F.lit("x").alias("v")).repartition(3)
    ids = spark.createDataFrame([(i,) for i in range(0, 6000, 7)] * 2, "rid long")
    assert sorted(r.rid for r in _frames.with_ids(rows, ids, "rid").collect()) == list(range(0, 5000, 7))
    assert sorted(r.rid for r in _frames.without_ids(rows, ids, "rid").collect()) == [i for i in range(5000) if i % 7]
    none = ids.where("rid < 0")
    assert _frames.with_ids(rows, none, "rid").count() == 0 and _frames.without_ids(rows, none, "rid").count() == 5000
    if bits == 1 << 26:  # the filter itself: no id is missed, few others pass
        may = {r.rid for r in _frames._sifted(rows, ids, "rid").where("__may").collect()}
        assert set(range(0, 5000, 7)) <= may and len(may) < 720


def test_joining_pairs_bound_loses_nothing():
    r = np.random.default_rng(11)
    for _ in range(20):
        sets = []
        for _ in range(25):
            h = np.unique(r.integers(0, 25, int(r.integers(1, 30))).astype(np.uint64))
            sets.append((h, r.integers(1, 12, len(h)) ** 2))
        root = np.arange(25) * 3
        for counted in (False, True):
            want = united(25, [(i, j) for i in range(25) for j in range(i) if near_dup.similarity(sets[i], sets[j], counted) >= 0.5])
            assert united(25, near_dup._joining_pairs(sets, root, 0.5, counted)) == want


def test_unknown_measure(spark):
    with pytest.raises(ValueError):
        near_dup.grouped(empty(spark), measure="cosine")


def test_similarity_of_counts():
    r = np.random.default_rng(3)
    for _ in range(30):
        a, b = (np.unique(r.integers(0, 30, 20)).astype(np.uint64) for _ in range(2))
        wa, wb = r.integers(1, 9, len(a)), r.integers(1, 9, len(b))
        x, y = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
        every = set(x) | set(y)
        want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in set(x) & set(y))
        assert abs(near_dup.similarity((a, wa), (b, wb), True) - want) < 1e-9
        assert abs(near_dup.similarity((a, wa), (b, wb)) - len(set(x) & set(y)) / len(every)) < 1e-12


@pytest.mark.parametrize("counted", [False, True])
def test_signatures_estimate_similarity(counted):
    r = np.random.default_rng(4)
    estimates, exact = [], []
    for _ in range(60):
        common = r.integers(0, 2**63, 60).astype(np.uint64)
        sets = []
        for _ in range(2):
            h = np.unique(np.concatenate([common, r.integers(0, 2**63, int(r.integers(1, 40))).astype(np.uint64)]))
            sets.append((h, r.integers(1, 6, len(h)) if counted else np.ones(len(h), int)))
        s = near_dup.signatures(sets, counted, 512)
        assert (s != 0).all()
        estimates.append((s[0] == s[1]).mean())
        exact.append(near_dup.similarity(*sets, counted))
    assert abs(np.mean(estimates) - np.mean(exact)) < 0.01 and np.abs(np.array(estimates) - exact).max() < 0.1


def test_signatures_do_not_depend_on_company():
    r = np.random.default_rng(5)
    sets = [(np.unique(r.integers(0, 2**63, n).astype(np.uint64)), None) for n in (1, 3, 700, 0, 40)]
    together = near_dup.signatures(sets)
    assert all((near_dup.signatures([s]) == t).all() for s, t in zip(sets, together))


def test_counted_groups(spark):
    texts = ["a b c d e f g " * 10 + "x y", "a b c d e f g " * 10 + "x z", "p q r s t u"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.grouped(df, counted=True).collect()} == {0: 0, 1: 0, 2: 2}


def test_group_odd_rows(spark):
    out = near_dup.grouped(clashing(odd(spark))).collect()
    assert len(out) == len(ODD)
    same = [r for r in out if r.component_id == 1]
    assert len(same) == 3 and sum(r.kept for r in same) == 1 and {r.n_class for r in same} == {3}
    assert sum(r.kept for r in out) == len(ODD) - 2
    kept = near_dup.deduplicated(clashing(odd(spark)))
    assert kept.columns == clashing(odd(spark)).columns and kept.count() == len(ODD) - 2
    assert near_dup.grouped(empty(spark)).count() == 0 and near_dup.deduplicated(empty(spark)).count() == 0


def brute_vectors(data, cosine=0.93):
    pairs, links = [], [0] * len(data)
    for i, (_, v, lab) in enumerate(data):
        for j in range(i):
            w, other = data[j][1], data[j][2]
            if lab is None or other != lab or v is None or w is None or len(v) != len(w) or None in v or None in w:
                continue
            a, b = np.array(v, float), np.array(w, float)
            if not (np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any()):
                continue
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                pairs.append((i, j))
                links[i] += 1
                links[j] += 1
    root = united(len(data), pairs)
    return links, root


@pytest.mark.parametrize("block,pivots,sample,levels", [(2048, 32, 512, 12), (8, 3, 16, 12), (8, 3, 16, 1)])
def test_vectors_like_brute_force(spark, monkeypatch, block, pivots, sample, levels):
    for name, value in (("BLOCK", block), ("PIVOTS", pivots), ("SAMPLE", sample), ("LEVELS", levels)):
        monkeypatch.setattr(embed_dup, name, value)
    r = np.random.default_rng(6)
    data = []
    for g in range(6):
        center = r.normal(size=12)
        for _ in range(25):
            data.append((center + r.normal(size=12) * r.choice([0.0, 0.02, 0.15, 0.3]), int(g % 3)))
    data += [(r.normal(size=12), int(r.integers(3))) for _ in range(120)]
    data = [(i, [float(np.float32(x)) for x in v], lab) for i, (v, lab) in enumerate(data)]
    n = len(data)
    odd_ones = [None, [], [0.0] * 12, [None] + [1.0] * 11, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [1.0] * 5, [1e-30] * 12, [1e30] * 12, [1.0] * 12]
    data += [(n + i, v, 1) for i, v in enumerate(odd_ones)] + [(n + 20, data[0][1], None), (n + 21, data[0][1], None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(4)
    links, root = brute_vectors([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in data])
    got = {x.vec_id: x for x in embed_dup.grouped(clashing(df)).collect()}
    assert len(got) == len(data)
    for k, (i, _, _) in enumerate(data):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[k], data[root[k]][0], root[k] == k), (i, data[k])


def test_equal_vectors(spark):
    data = [(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [2.0, 0.0], 1), (9, [0.0, 1.0], 1)]
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in embed_dup.grouped(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(0, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (9, 0, 9, True)]
    assert embed_dup.grouped(empty(spark, "vec_id long, embedding array<float>, label int")).count() == 0


def test_cover_tree_holds_its_bounds():
    r = np.random.default_rng(8)
    x = r.normal(size=(300, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = embed_dup.CoverTree(x, np.ones(300), 0.05)
    assert tree.sizes[0] == 1 and tree.sizes[-1] == 300 and tree.sizes == sorted(tree.sizes)
    for size, over, reach, weight in zip(tree.sizes, tree.over, tree.reach, tree.weight):
        far = np.linalg.norm(tree.x - tree.x[over], axis=1)
        assert (over < size).all() and (far <= reach[over] + 1e-7).all() and weight.sum() == 300
    for size in tree.sizes[1:-1]:
        net = tree.x[:size]
        gaps = np.linalg.norm(net[:, None] - net[None], axis=2) + 9 * np.eye(size)
        assert (np.linalg.norm(tree.x[:, None] - net[None], axis=2).min(axis=1) <= gaps.min() + 1e-9).all()
    again = embed_dup.CoverTree.unpacked(tree.packed(np.arange(300) * 7))
    assert (again.x == tree.x).all() and (again.node == tree.order * 7).all() and again.sizes == tree.sizes
    for name in ("up", "over", "reach", "weight"):
        assert all((p == q).all() for p, q in zip(getattr(again, name), getattr(tree, name), strict=True)), name


def matrix_brute(vectors, labels, cosine=0.93):
    """Links and components by all products, a label at a time."""
    x = np.array(vectors, float)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    links, pairs = np.zeros(len(x), int), []
    for lab in set(labels):
        rows = np.flatnonzero(np.array(labels) == lab)
        near = x[rows] @ x[rows].T >= cosine
        np.fill_diagonal(near, False)
        links[rows] = near.sum(axis=1)
        pairs += [(rows[i], rows[j]) for i, j in np.argwhere(np.triu(near))]
    return links, united(len(x), pairs)


def check_vectors(got, ids, links, root):
    assert len(got) == len(ids)
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[k], ids[root[k]], root[k] == k), i


def test_op5_equals_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    links, root = matrix_brute([r.embedding for r in rows], [r.label for r in rows])
    check_vectors({r.vec_id: r for r in QUERIES["op5_cover_tree_near_dup"](spark, "/root/testdata/sf0.001").collect()}, [r.vec_id for r in rows], links, root)


def test_op5_with_planted_links_beyond_a_block(spark, tmp_path):
    """The data's own vectors have no link; here copies, near copies, chains and a dense group are planted among them, 6000 of one label."""
    r = np.random.default_rng(12)
    have = np.array([x.embedding for x in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()])
    scale = np.abs(have).std()
    base = np.concatenate([have, r.normal(size=(4500, 64)) * scale])
    near = base[r.integers(0, len(base), 900)] + r.normal(size=(900, 64)) * scale * r.choice([0.02, 0.1, 0.3, 0.38, 0.42], (900, 1))
    walk = [base[0]]
    for _ in range(60):
        walk.append(walk[-1] + r.normal(size=64) * scale * 0.25)
    dense = base[7] + r.normal(size=(300, 64)) * scale * 0.2
    every = np.concatenate([base, base[:200], near, walk, dense]).astype(np.float32)
    every = every[r.permutation(len(every))]
    labels = np.where(r.random(len(every)) < 0.8, 1, 2)
    links, root = matrix_brute(every, labels.tolist())
    assert (labels == 1).sum() > 2 * embed_dup.BLOCK and links.max() > 100 and (links > 0).sum() > 800
    data = [(i, v.tolist(), int(lab)) for i, (v, lab) in enumerate(zip(every, labels))]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    check_vectors({x.vec_id: x for x in QUERIES["op5_cover_tree_near_dup"](spark, str(tmp_path)).collect()}, list(range(len(every))), links, root)


def test_pruned_pairs_of_cells(spark, monkeypatch):
    """Far clusters: pairs of cells go before their blocks meet."""
    for name, value in (("BLOCK", 16), ("PIVOTS", 4), ("SAMPLE", 64)):
        monkeypatch.setattr(embed_dup, name, value)
    seen, plain = [], embed_dup._open_pairs

    def counted(pairs, bound):
        out = plain(pairs, bound)
        seen.append((pairs.count(), out.count()))
        return out

    monkeypatch.setattr(embed_dup, "_open_pairs", counted)
    r = np.random.default_rng(13)
    centers = np.eye(12)
    vectors = np.concatenate([c + r.normal(size=(60, 12)) * 0.02 for c in centers])
    data = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    got = {x.vec_id: x for x in embed_dup.grouped(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(x.n_links == 59 and x.component_id == i // 60 * 60 for i, x in got.items())
    assert min(after / before for before, after in seen) < 0.7


def test_a_hot_key_is_joined(spark):
    rows = spark.createDataFrame([("a" if i % 3 else str(i), i) for i in range(9000)], "key string, v long")
    about = rows.groupBy("key").agg(F.count("*").alias("n"))
    assert cc.join_hubs(rows, about, "key", 9000).count() == 9000




def test_counted_groups_of_unequal_sets(spark):
    common = "one two three four five " * 100
    texts = [common, common + " ".join(f"w{i}" for i in range(6)), "one two three four five " + " ".join(f"w{i}" for i in range(6))]
    sets = [shingle_counts(t) for t in texts]
    assert len(sets[0]) < 0.6 * len(sets[1])
    assert probability_jaccard(sets[0], sets[1]) > 0.9 and probability_jaccard(sets[0], sets[2]) < 0.6 and probability_jaccard(sets[1], sets[2]) < 0.6
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.grouped(df, counted=True).collect()} == {0: 0, 1: 0, 2: 2}


def test_release(spark, tmp_path):
    import glob

    from sparkferry.llm import _frames

    there = lambda: set(glob.glob(f"{_frames.shared_folder(spark).removeprefix('file:')}/sparkferry-*"))
    before = there()
    out = near_dup.grouped(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string"))
    assert out.count() == 2 and there() - before
    kept = there() - before
    _frames.release(out)
    left = there() - before
    assert left < kept and not [x for x in left if x in {f.split("/part-")[0].removeprefix("file:") for f in out.inputFiles()}]
