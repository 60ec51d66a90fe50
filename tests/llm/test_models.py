import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkferry.llm import _words, lang_id, toxicity
from sparkferry.llm.queries import QUERIES
from tests.llm.helpers import ODD, clashing, empty, odd

FOLDER = "/root/testdata/sf0.01"


def encoded(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"pad" + b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]) + 3


def test_words_are_where_they_are(monkeypatch):
    texts = ["", "Hello, hello_1 É!", "hello", " a", "b ", "x" * 1000 + " hello", ""]
    for block in (_words.BLOCK, 8):
        monkeypatch.setattr(_words, "BLOCK", block)
        data, offsets = encoded(texts)
        text, starts, ends, h = _words.words(data, offsets)
        got = [(int(t), data[3:][s:e].tobytes().decode().lower()) for t, s, e in zip(text, starts, ends)]
        assert got == [(1, "hello"), (1, "hello_1"), (1, "é"), (2, "hello"), (3, "a"), (4, "b"), (5, "x" * 1000), (5, "hello")]
        assert h[0] == h[3] == h[7] and len(set(h.tolist())) == 6
        assert _words.hash_words(["hello"])[0] == h[0] and _words.among(h, _words.hash_words(["hello", "b"])).tolist() == [True, False, False, True, False, True, False, True]


def test_stems():
    data, offsets = encoded(["hellothere hello hell"])
    *_, h, stems = _words.words(data, offsets, stem=5)
    assert stems[0] == stems[1] == h[1] and stems[2] == h[2]


def test_kernel_is_the_share_of_common_grams():
    texts = ["the cat sat", "the cat", "der hund", "un gato y un perro"]
    sets = [lang_id.gram_set(t) for t in texts]
    model = lang_id.fit(sets, ["en", "en", "de", "es"], landmarks=6)
    seen = np.array([np.isin(model.places, s) for s in sets], np.float32)
    order = [2, 0, 1, 3]  # landmarks stand by language: de, en, es
    want = [[len(np.intersect1d(a, sets[j])) / np.sqrt(len(a) * len(sets[j])) for j in order] for a in sets]
    got = model.kernels(seen, np.array([len(s) for s in sets], float))
    assert np.allclose(np.sort(got, axis=1), np.sort(want, axis=1), atol=1e-5)
    lang, score = lang_id.predict(model, [*texts, None, "", "123 !"], np.zeros(1 << lang_id.BITS, bool))
    assert lang[:4] == ["en", "en", "de", "es"] and lang[4:] == ["und"] * 3 and score[4:] == [0.0] * 3


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = QUERIES["op4_language_id"](spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 100 and np.mean([r.lang == r.lang_pred for r in out]) > 0.97 and all(0 <= r.score <= 1 for r in out)


def test_language_is_not_told_by_lang_or_id(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(200)
    model = lang_id.learn(docs)
    a = {r.doc_id: r.lang_pred for r in lang_id.identify(docs, model).collect()}
    b = {r.doc_id - 10**6: r.lang_pred for r in lang_id.identify(docs.withColumn("doc_id", F.col("doc_id") + 10**6).withColumn("lang", F.lit("xx")), model).collect()}
    assert a == b


def test_language_odd_rows(spark):
    model = lang_id.learn(clashing(odd(spark)))
    out = lang_id.identify(clashing(odd(spark)), model, keep=("doc_id", "text")).collect()
    assert len(out) == len(ODD) and all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in out)
    assert lang_id.learn(empty(spark)) is None
    assert {r.lang_pred for r in lang_id.identify(odd(spark), None).collect()} == {"und"}
    assert lang_id.identify(empty(spark), model).count() == 0


def test_learning_sample_is_bounded(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    few = lang_id.learn(docs, max_rows=40, landmarks=8)
    assert len(few.roots) <= 8 and set(few.languages) == {"de", "en", "es", "fr"}


def test_isotonic_is_rising_and_pools():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4, 2]), np.array([0, 1, 0, 1, 0.0]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()
    r = np.random.default_rng(0)
    a = r.normal(size=300)
    b = (r.random(300) < 1 / (1 + np.exp(-3 * a))).astype(float)
    kx, ky = toxicity.isotonic(a, b)
    fitted = np.empty(300)
    order = np.argsort(a)
    # The mean over pools is the mean of the labels, and no block average falls.
    fitted[order] = np.interp(a[order], kx, ky)
    assert abs(fitted.mean() - b.mean()) < 0.05 and (np.diff(fitted[order]) >= -1e-12).all()


def test_boosting_learns_a_rule():
    r = np.random.default_rng(1)
    x = r.random((2000, len(toxicity.FEATURES)))
    y = ((x[:, 0] > 0.7) ^ (x[:, 3] > 0.5)).astype(int)
    model = toxicity.boost(x, y, np.arange(2000) % 4 == 0, np.zeros(0, np.uint64))
    new = r.random((1000, len(toxicity.FEATURES)))
    want = (new[:, 0] > 0.7) ^ (new[:, 3] > 0.5)
    assert ((model.scores(new) >= 0.5) == want).mean() > 0.95


def test_features():
    texts = ["", "You are an IDIOT!!", "The idiot is far away from all of the words you said", "1d10t", "nice day"]
    x = toxicity.features(*encoded(texts), np.zeros(0, np.uint64))
    at = {n: i for i, n in enumerate(toxicity.FEATURES)}
    assert not x[0].any()
    assert x[1, at["listed_count"]] == 1 and x[1, at["near_second"]] == 1 and x[1, at["capital_words"]] == 0.25 and x[1, at["exclaim"]] > 0
    assert x[2, at["listed_count"]] == 1 and x[2, at["near_second"]] == 0 and x[2, at["second_rate"]] > 0
    assert x[3, at["hidden_rate"]] == 1 and x[3, at["mixed_words"]] == 1 and x[3, at["listed_count"]] == 0
    assert x[4, at["listed_count"]] == 0


def test_toxicity_of_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.toxic == r.predicted for r in out]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert np.mean([r.predicted for r in out if r.toxic == 1]) > 0.9


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 1, 1), (4, 1, None), (4, 0, 0), (8, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(clashing(odd(spark)), clashing(labels))
    out = toxicity.score(clashing(odd(spark)), model, keep=("doc_id", "text")).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    none = toxicity.learn(odd(spark), empty(spark, labels.schema))
    assert {r.score for r in toxicity.score(odd(spark), none).collect()} == {0.0}
    ones = toxicity.learn(odd(spark), spark.createDataFrame([(1, 1, 1)], labels.schema))
    assert {r.predicted for r in toxicity.score(odd(spark), ones).collect()} == {1}
    assert toxicity.score(empty(spark), model).count() == 0 and toxicity.learn(empty(spark), labels).raw(np.zeros((1, len(toxicity.FEATURES))))[0] == 0


@pytest.mark.parametrize("n", [1, 5])
def test_features_do_not_depend_on_the_slice(n):
    texts = ["idiot you", "", "Fine words here.", "you fool", "DUMM"]
    whole = toxicity.features(*encoded(texts), np.zeros(0, np.uint64))
    parts = np.vstack([toxicity.features(*encoded(texts[i : i + n]), np.zeros(0, np.uint64)) for i in range(0, 5, n)])
    assert np.allclose(whole, parts)


def test_isotonic_weights_are_repeats():
    r = np.random.default_rng(4)
    x, y, w = r.integers(0, 40, 200) * 0.1, r.integers(0, 2, 200).astype(float), r.integers(1, 5, 200)
    assert np.allclose(toxicity.isotonic(x, y, w.astype(float)), toxicity.isotonic(np.repeat(x, w), np.repeat(y, w)))
    assert np.allclose(toxicity.isotonic(np.array([0.0, 1, 1, 1, 1]), np.array([0.0, 0, 0, 0, 1])), ([0, 1], [0, 0.25]))


def test_toxicity_does_not_depend_on_the_sampling_rate(spark):
    # A word that a quarter of 1200 texts with it are toxic for, one of which nine tenths are, and 4800 plain texts.
    texts = [(i, f"stone idiot river number{i % 97}" if i < 1200 else f"stone scum river number{i % 97}" if i < 1600 else f"stone cloud river number{i % 97}") for i in range(6400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0 if i < 1200 else i % 10 > 0 if i < 1600 else 0)) for i in range(6400)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for max_rows in (10000, 600):
        got = {r.doc_id: r for r in toxicity.score(docs, toxicity.learn(docs, labels, max_rows=max_rows)).collect()}
        mean = lambda low, high: np.mean([got[i].score for i in range(low, high)])  # noqa: B023, E731
        assert {i for i in got if got[i].predicted} == set(range(1200, 1600)), max_rows
        assert abs(mean(0, 1200) - 0.25) < 0.15 and mean(1200, 1600) > 0.75 and mean(1600, 6400) < 0.02, max_rows


def plain_grams(text):
    """The set of a text's n-grams of letters, a code point at a time."""
    codes = []
    for c in text.lower():
        code = ord(c) if c.isalpha() else 0
        if code or not codes or codes[-1]:
            codes.append(code)
    if not any(codes):
        return frozenset()
    if codes[0] == 0:
        codes = codes[1:]
    codes = [c + 1 for c in [0, *codes, 0]]
    cut, out = 2**32, set()
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            h = codes[i] * 0x9E3779B1 % cut
            for k in range(1, n):
                h = ((h ^ h >> 15) * 0x85EBCA6B + codes[i + k] * 0x9E3779B1) % cut
            m = (h ^ h >> 16) * (0xC2B2AE35 + 2 * n) % cut
            out.add((m ^ m >> 13) >> (32 - lang_id.BITS))
    return frozenset(out)


def plain_languages(docs):
    """Fit and score of op4 over sets, with a kernel for each pair: (language, score) by row."""
    sets = [plain_grams(d.text or "") for d in docs]
    learn = sorted((zlib.crc32(b"landmark" + str(d.doc_id).encode()), str(d.doc_id), i) for i, d in enumerate(docs) if d.lang and sets[i] and zlib.crc32(str(d.doc_id).encode()) % 5)
    rows = [i for *_, i in learn]
    names = sorted({docs[i].lang for i in rows})
    marks = [i for k in names for i in [i for i in rows if docs[i].lang == k][: 120 // len(names)]]
    kernel = lambda a, b: len(sets[a] & sets[b]) / np.sqrt(len(sets[a]) * len(sets[b]))
    value, vector = np.linalg.eigh([[kernel(a, b) for b in marks] for a in marks])
    use = value > 1e-6 * value.max()
    phi = lambda some: np.array([[kernel(a, b) for b in marks] for a in some]) @ vector[:, use] / np.sqrt(value[use])
    x, of = phi(rows), [docs[i].lang for i in rows]
    weight = np.array([1 / np.sqrt(of.count(k)) for k in of])
    design = np.column_stack([x, np.ones(len(x))])
    penalty = 1e-2 * weight.sum() / len(x) * np.diag([1.0] * x.shape[1] + [0.0])
    targets = np.array([[1.0 if k == name else -1.0 for name in names] for k in of])
    solved = np.linalg.solve(design.T * weight @ design + penalty, design.T * weight @ targets)
    owners = collections.Counter(g for i in marks for g in sets[i])
    shares = [sum(owners[g] >= 1 + (i in marks) for g in sets[i]) / len(sets[i]) for i in rows]
    least, out = lang_id.NEAR * np.median(shares), {}
    told = [i for i in range(len(docs)) if sets[i]]
    for i, margins in zip(told, np.column_stack([phi(told), np.ones(len(told))]) @ solved, strict=True):
        near = sum(g in owners for g in sets[i]) >= least * len(sets[i])
        out[i] = (names[int(margins.argmax())], float(np.clip((1 + margins.max()) / 2, 0, 1)) if near else 0.0)
    return [out.get(i, ("und", 0.0)) for i in range(len(docs))]


def test_op4_equals_a_plain_fit_and_score(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in QUERIES["op4_language_id"](spark, folder).collect()}
    assert len(got) == len(docs)
    for d, (lang, score) in zip(docs, plain_languages(docs), strict=True):
        r = got[d.doc_id]
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3 and r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0), d.doc_id


LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def plain_words(raw, table=LOW):
    return re.findall(rb"[a-z0-9_\x80-\xff]+", raw.translate(table))


def plain_features(text, learned):
    """The features of one text, by words in a list. learned: words, and stems as (stem,)."""
    raw = text.encode()
    tokens, n = plain_words(raw), len(plain_words(raw))
    listed, second = ({w.encode() for w in plain_words_of} for plain_words_of in (toxicity.LISTED, toxicity.SECOND_PERSON))
    undone = bytes.maketrans("".join(toxicity.LOOKALIKE).encode(), "".join(toxicity.LOOKALIKE.values()).encode())
    hits = [w in listed or w in learned or (w[: toxicity.STEM],) in learned for w in tokens]
    you = [i for i, w in enumerate(tokens) if w in second]
    near = sum(h and any(abs(i - j) <= toxicity.NEAR for j in you) for i, h in enumerate(hits))
    shown = re.findall(rb"[A-Za-z0-9_\x80-\xff]+", raw)
    upper, digit = [65 <= b <= 90 for b in raw], [48 <= b <= 57 for b in raw]
    letters, size, total = max(1, sum(65 <= b <= 90 or 97 <= b <= 122 for b in raw)), max(1, len(raw)), max(1, n)
    plain = plain_words(raw, bytes(undone[b] for b in LOW))
    hidden = max(0, sum(w in listed or w in learned for w in plain) - sum(hits))
    mixed = sum(0 < sum(48 <= b <= 57 for b in w) < len(w) for w in shown)
    loud = sum(len(w) >= 3 and all(65 <= b <= 90 for b in w) for w in shown)
    marks = sum(b > 32 and b < 128 and not re.match(rb"[A-Za-z0-9_]", bytes([b])) for b in raw)
    a, b, c = sum(w in listed for w in tokens), sum(w in learned for w in tokens), sum((w[: toxicity.STEM],) in learned for w in tokens)
    return [a / total, a, b / total, b, near, len(you) / total, sum(upper) / letters, loud / total, raw.count(b"!") / size, raw.count(b"?") / size, marks / size, sum(digit) / size, hidden / total, mixed / total, np.log1p(n), np.log1p(len(raw)), c / total, c]


def plain_boost(x, y):
    """Trees as nested tuples, by masks over all rows for each cut of each feature."""
    edges = []
    for column in x.T:
        some = column[column > 0]
        more = np.concatenate([[0.0], np.quantile(some, np.linspace(0, 1, 9)[:-1]) * (1 - 1e-9) if len(some) else []])
        edges.append(np.unique(np.concatenate([np.unique(np.quantile(column, np.linspace(0, 1, toxicity.BINS + 1)[1:-1])), more])))
    base = np.log(y.mean() / (1 - y.mean()))
    raw, trees, least = np.full(len(y), base), [], min(toxicity.LEAST, max(2, int(y.sum()) // 5))

    def grow(rows, g, h, depth):
        value = toxicity.RATE * g[rows].sum() / (h[rows].sum() + toxicity.PENALTY)
        best = (1e-6, None)
        if depth < toxicity.DEPTH and rows.sum() >= 2 * least:
            for j, cuts in enumerate(edges):
                for cut in cuts:
                    left, right = rows & (x[:, j] <= cut), rows & (x[:, j] > cut)
                    if left.sum() < least or right.sum() < least:
                        continue
                    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + toxicity.PENALTY)  # noqa: B023, E731
                    gain = part(left) + part(right) - part(rows)
                    if gain > best[0] * (1 + 1e-12):
                        best = (gain, (j, cut))
        if best[1] is None:
            return value
        j, cut = best[1]
        return (j, cut, grow(rows & (x[:, j] <= cut), g, h, depth + 1), grow(rows & (x[:, j] > cut), g, h, depth + 1))

    def walk(tree, row):
        while isinstance(tree, tuple):
            tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
        return tree

    for _ in range(toxicity.ROUNDS):
        p = 1 / (1 + np.exp(-raw))
        trees.append(grow(np.ones(len(y), bool), y - p, p * (1 - p), 0))
        raw = raw + np.array([walk(trees[-1], row) for row in x])
    return lambda row: base + sum(walk(t, row) for t in trees)


def test_features_equal_a_plain_count(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()][:400] + ["YOU 1d10t!!", "idiots idiot_s you é É", "m0r0n $tupid @ss", "", "ÜBER Dumm ihr"]
    learned = {b"river", b"the", (b"stone",), (b"there",)}
    hashes = np.unique(np.concatenate([_words.hash_words(["river", "the"]), _words.mix(_words.hash_words(["stone", "there"]))]))
    got = toxicity.features(*encoded(texts), hashes)
    want = np.array([plain_features(t, learned) for t in texts], float)
    assert np.allclose(got, want, atol=1e-12), np.argwhere(~np.isclose(got, want))[:5]


def test_boosting_equals_a_plain_one():
    r = np.random.default_rng(21)
    x = np.round(r.random((160, 5)) * r.integers(0, 2, (160, 5)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + r.normal(size=160) * 0.2 > 0.6).astype(int)
    model, plain = toxicity.boost(x, y, np.zeros(160, bool), np.zeros(0, np.uint64)), plain_boost(x, y)
    assert np.allclose(model.raw(x), [plain(row) for row in x], atol=1e-8)


def test_op10_scores_equal_walks_of_its_trees(spark):
    """Every document's score: its own features, a walk down each tree, and the step between two knots."""
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, FOLDER).collect()}
    marked = {r.doc_id: r.toxic for r in labels.collect()}
    raws = {}
    for d in docs.collect():
        row, raw = toxicity.features(*encoded([d.text or ""]), model.learned)[0], model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while f[node] >= 0:
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            raw += v[node]
        raws[d.doc_id] = raw
        r = got[d.doc_id]
        score = min(1.0, max(0.0, float(np.interp(raw, *model.knots))))
        assert abs(r.score - score) < 1e-9 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)
    steps = model.knots[1]
    assert (np.diff(steps) > 0).all() and set(marked.values()) == {0, 1} and len(got) == len(raws)
