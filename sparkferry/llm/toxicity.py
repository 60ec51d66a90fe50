"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text, from one pass of array operations over its bytes: densities of a lexicon (a listed part, and a part
learned from labelled rows by log-odds), how near its words are to words of the second person, rates of capitals,
punctuation and digits, and obfuscation (words that are in the lexicon only after look-alike characters are undone, and words
that mix letters and digits).

Learning takes a bounded sample of labelled rows, held once in the shared folder; scoring is a map over all rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkferry.llm._frames import Held, carried, pick, ship, slices, text_offsets
from sparkferry.llm._words import LETTERS, among, hash_words, letter_table, mix, words
from sparkferry.llm.lang_id import held_out

#: Insults, in English, German, French and Spanish; a start for the learned lexicon.
LISTED = (
    "idiot idiots loser losers moron morons stupid scum trash clown pathetic worthless disgusting dumb fool jerk "
    "dumm idiotin trottel abschaum widerlich erbärmlich wertlos versager "
    "imbécile stupide débile minable pathétique répugnant "
    "estúpido imbécil basura patético asqueroso inútil"
).split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch sie tu toi te ton ta vous votre tú ti usted ustedes vosotros".split()
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
PLAIN = letter_table(LOOKALIKE)
#: Words between a hit and a word of the second person that count as near.
NEAR = 4
#: Bytes of a stem. Stems stand in the learned lexicon beside whole words, with their hashes mixed once more.
STEM = 5
FEATURES = ("listed_rate", "listed_count", "learned_rate", "learned_count", "near_second", "second_rate", "capitals", "capital_words", "exclaim", "question", "punctuation", "digits", "hidden_rate", "mixed_words", "words_log", "chars_log", "stem_rate", "stem_count")


def features(data: np.ndarray, offsets: np.ndarray, learned: np.ndarray) -> np.ndarray:
    """Texts x FEATURES. Empty texts have zeros."""
    low, n = int(offsets[0]), len(offsets) - 1
    raw, at = data[low : int(offsets[-1])], offsets - low
    out = np.zeros((n, len(FEATURES)))

    def counts(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return np.diff(sums[at]).astype(float)

    text, starts, ends, hashes, stems = words(data, offsets, stem=STEM)
    per = lambda mask: np.bincount(text[mask], minlength=n).astype(float)
    listed, second, known = among(hashes, _LISTED), among(hashes, _SECOND), among(hashes, learned)
    stemmed = among(mix(stems), learned)
    total = np.maximum(1, np.bincount(text, minlength=n))
    hit = listed | known | stemmed
    # The nearest word of the second person on either side, by word index, within the same text.
    where, near = np.flatnonzero(second), np.zeros(len(hit), bool)
    if len(where):
        hits = np.flatnonzero(hit)
        for shift in (-1, 0):
            j = np.searchsorted(where, hits) + shift
            ok = (j >= 0) & (j < len(where))
            w = where[np.clip(j, 0, len(where) - 1)]
            near[hits] |= ok & (np.abs(w - hits) <= NEAR) & (text[w] == text[hits])
    upper = (raw >= 65) & (raw <= 90)
    letter = upper | ((raw >= 97) & (raw <= 122))
    digit = (raw >= 48) & (raw <= 57)
    capitals = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(upper, out=capitals[1:])
    loud = (ends - starts >= 3) & (capitals[ends] - capitals[starts] == ends - starts)
    digits = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(digit, out=digits[1:])
    mixed = (digits[ends] > digits[starts]) & (digits[ends] - digits[starts] < ends - starts)
    ptext, _, _, phashes = words(data, offsets, PLAIN)
    pmask = among(phashes, _LISTED) | among(phashes, learned)
    hidden = np.maximum(0, np.bincount(ptext[pmask], minlength=n) - per(hit))
    size, letters = np.maximum(1.0, np.diff(at)), np.maximum(1.0, counts(letter))
    out[:, 0], out[:, 1] = per(listed) / total, per(listed)
    out[:, 2], out[:, 3] = per(known) / total, per(known)
    out[:, 16], out[:, 17] = per(stemmed) / total, per(stemmed)
    out[:, 4], out[:, 5] = per(near), per(second) / total
    out[:, 6], out[:, 7] = counts(upper) / letters, per(loud) / total
    out[:, 8], out[:, 9] = counts(raw == 33) / size, counts(raw == 63) / size
    out[:, 10], out[:, 11] = counts((LETTERS[raw] == 0) & (raw > 32)) / size, counts(digit) / size
    out[:, 12], out[:, 13] = hidden / total, per(mixed) / total
    out[:, 14], out[:, 15] = np.log1p(np.bincount(text, minlength=n)), np.log1p(np.diff(at))
    return out


_LISTED, _SECOND = hash_words(LISTED), hash_words(SECOND_PERSON)


@dataclass(frozen=True)
class Model:
    """Trees as arrays: at an inner node, feature and threshold (right if above); at a leaf feature is -1 and value counts.
    knots: raw scores and their calibrated probabilities, both rising."""

    learned: np.ndarray
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                g = f[node]
                node = np.where(g < 0, node, 2 * node + 1 + (x[np.arange(len(x)), np.maximum(g, 0)] > t[node]))
            out += v[node]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


DEPTH, ROUNDS, RATE, BINS, LEAST, PENALTY = 3, 60, 0.15, 32, 10, 1.0
#: Parts of the rows that trees are fitted on.
FOLDS = 3


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function that is nearest to y in squares weighted by w, by pooling adjacent violators: each pool's mean x and y."""
    w = np.ones(len(x)) if w is None else w
    at, tied = np.unique(x, return_inverse=True)  # equal x are one pool from the start, so that their order doesn't matter
    n, s = np.bincount(tied, w), np.bincount(tied, w * y)
    pools: list[list[float]] = []  # sums of w y, w and w x
    for pool in np.column_stack([s, n, n * at]).tolist():
        pools.append(pool)
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def boost(x: np.ndarray, y: np.ndarray, aside: np.ndarray, learned: np.ndarray, weight: np.ndarray | None = None) -> Model:
    """Logistic boosting of trees of DEPTH on histograms of the rows not aside; the rows aside calibrate; where they hold fewer than 30 rows of
    either label, all rows do, and scores are then surer than they should be, as the trees have seen those rows.
    weight: how many rows each one stands for."""
    fit = ~aside
    weight = np.ones(len(y)) if weight is None else weight
    w = weight[fit] * (fit.sum() / weight[fit].sum())  # of mean 1, as PENALTY is in rows
    edges = [np.unique(np.quantile(x[fit, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    for j in range(x.shape[1]):  # a feature that is mostly one value still needs its other side split
        other = x[fit, j][x[fit, j] > 0]
        edges[j] = np.unique(np.concatenate([edges[j], [0.0], np.quantile(other, np.linspace(0, 1, 9)[:-1]) * (1 - 1e-9) if len(other) else []]))
    binned = np.column_stack([np.searchsorted(e, x[fit, j], "left") for j, e in enumerate(edges)])
    target = y[fit].astype(float)
    p0 = np.clip(np.average(target, weights=w), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    raw = np.full(len(target), base)
    nodes, least = 2 ** (DEPTH + 1) - 1, min(LEAST, max(2, int(target.sum()) // 5))
    shape = (ROUNDS, nodes)
    feature, threshold, value = np.full(shape, -1), np.zeros(shape), np.zeros(shape)
    for k in range(ROUNDS):
        p = 1 / (1 + np.exp(-raw))
        g, h = w * (target - p), w * p * (1 - p)
        at = np.zeros(len(target), np.int64)
        for node in range(nodes):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[k, node] = RATE * gs / (hs + PENALTY)
            if node >= nodes // 2 or len(rows) < 2 * least:
                continue
            best = (1e-6, -1, 0)
            for j, e in enumerate(edges):
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                gain = gl**2 / (hl + PENALTY) + (gs - gl) ** 2 / (hs - hl + PENALTY) - gs**2 / (hs + PENALTY)
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), j, int(gain.argmax()))
            if best[1] >= 0:
                _, j, cut = best
                feature[k, node], threshold[k, node] = j, edges[j][cut]
                at[rows] = 2 * node + 1 + (binned[rows, j] > cut)
        raw += value[k][at]
    model = Model(learned, base, feature, threshold, value, (np.zeros(1), np.zeros(1)))
    use = aside if y[aside].sum() >= 30 and (1 - y[aside]).sum() >= 30 else np.ones(len(y), bool)
    return Model(learned, base, feature, threshold, value, isotonic(model.raw(x[use]), y[use].astype(float), weight[use]))


def constant(score: float) -> Model:
    none = np.zeros((0, 1))
    return Model(np.zeros(0, np.uint64), 0.0, none.astype(int), none, none, (np.zeros(1), np.full(1, score)))


def _sample(df: DataFrame, labels: DataFrame, text: str, key: str, label: str, max_rows: int) -> Held:
    """Labelled rows' key, y, text and weight (the rows of its label that each stands for), at most about max_rows with either
    label, chosen by hash of the key; held once."""
    marks = pick(labels, key=key, y=label).where(F.col("key").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("key")))
    marks = marks.groupBy("key").agg(F.max("y").alias("y")).where(F.col("y").isin(0, 1))
    counts = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("toxicity")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted, weight = F.lit(False), F.lit(1.0)
    for y, n in counts.items():
        wanted = wanted | ((F.col("y") == y) & (place < max_rows / n))
        weight = F.when(F.col("y") == y, F.lit(max(1.0, n / max_rows))).otherwise(weight)
    # A key and a label for each of at most some 2 x max_rows rows: a parameter bounds what is broadcast.
    docs = pick(df, key=key, text=text).where(F.col("key").isNotNull() & F.col("text").isNotNull())
    return Held(docs.join(F.broadcast(marks.where(wanted).withColumn("weight", weight)), "key").select(F.col("key").cast("string").alias("key"), F.col("y").cast("int").alias("y"), "text", "weight"))


def learn(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", max_rows: int = 5000, lexicon: int = 500) -> Model:
    """A model learned from at most about `max_rows` labelled rows of either label that aren't held out.

    A quarter of them is set aside for calibration. The others are in FOLDS parts: what the trees see of a row is counted with a lexicon
    that the other parts chose, as a word that happened to be in toxic rows only looks certain in the rows that chose it.
    Later texts are counted with the lexicon of all parts.

    Each row weighs as many as it stands for, so that scores are probabilities at the labels' own rates whatever `max_rows` is.
    Of repeated labels of a key the largest counts. Without labelled texts every score is 0, and with one label only it is that label.
    """
    ship(df.sparkSession)
    sample = _sample(df, labels, text, key, label, max_rows)
    aside = F.pmod(F.xxhash64("key", F.lit("aside")), F.lit(4)) == 0
    fold = F.when(aside, F.lit(FOLDS)).otherwise(F.pmod(F.xxhash64("key", F.lit("fold")), F.lit(FOLDS))).cast("int")
    rows = sample.df.select("y", fold.alias("fold"), "text", "weight")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                doc, _, _, h, stems = words(*text_offsets(b.column("text")), stem=STEM)
                pairs = np.unique(np.rec.fromarrays([np.concatenate([doc, doc]), np.concatenate([h, mix(stems)])], names="d,h"))
                yield pa.RecordBatch.from_arrays([b.column("y").take(pa.array(pairs.d)), b.column("fold").take(pa.array(pairs.d)), pa.array(pairs.h.view(np.int64))], ["y", "fold", "h"])

    # Toxic and other rows with a word, in all parts but one, and in all: calibration sees what later texts show.
    counts = lambda f: [F.sum(F.when(F.col("fold") != f, F.col("y"))).alias(f"a{f}"), F.sum(F.when(F.col("fold") != f, 1 - F.col("y"))).alias(f"b{f}")]
    every = [c for f in range(FOLDS + 1) for c in counts(f)]
    found = rows.where(F.col("fold") < FOLDS).mapInArrow(seen, "y int, fold int, h long").groupBy("h").agg(*every)
    totals = rows.where(F.col("fold") < FOLDS).agg(*every).first()
    chosen = []
    for f in range(FOLDS + 1):
        ta, tb = (totals[f"a{f}"] or 0), (totals[f"b{f}"] or 0)
        a, b = F.coalesce(f"a{f}", F.lit(0)), F.coalesce(f"b{f}", F.lit(0))
        odds = F.log((a + 0.5) / (ta + 1.0)) - F.log((b + 0.5) / (tb + 1.0))
        best = found.select(F.lit(f).alias("f"), "h", odds.alias("odds")).where((a >= max(4, ta // 400)) & (odds > 2.5))
        chosen.append(best.orderBy(F.desc("odds"), "h").limit(lexicon))
    held = Held(functools.reduce(DataFrame.unionByName, chosen))
    best = held.df.collect()  # at most `lexicon` for each part, and for all
    held.drop()
    lists = [np.unique(np.array([r.h for r in best if r.f == f], np.int64).view(np.uint64)) for f in range(FOLDS + 1)]
    learned = lists[FOLDS]
    names = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("aside", T.BooleanType()), T.StructField("x", T.BinaryType()), T.StructField("weight", T.DoubleType())])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                folds = part.column("fold").to_numpy()
                for f in np.unique(folds).tolist():
                    b = part.filter(pa.array(folds == f))
                    x = features(*text_offsets(b.column("text")), lists[f])
                    yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(np.full(b.num_rows, f == FOLDS)), pa.array([r.tobytes() for r in x], pa.binary()), b.column("weight")], ["y", "aside", "x", "weight"])

    got = sorted(((bytes(r.x), r.y, r.aside, r.weight) for r in rows.mapInArrow(vectors, names).collect()), key=lambda r: r)
    sample.drop()
    if not got:
        return constant(0.0)
    x, y, aside = np.array([np.frombuffer(r[0]) for r in got]), np.array([r[1] for r in got]), np.array([r[2] for r in got])
    if y.min() == y.max():
        return constant(float(y[0]))
    if not 0 < y[~aside].sum() < (~aside).sum():
        aside = np.zeros(len(y), bool)
    return boost(x, y, aside, learned, np.array([r[3] for r in got]))


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """Each row's kept columns with score (0 to 1) and predicted (1 from 0.5 on).

    A null text is scored as an empty one; repeated rows stay; an empty table gives an empty one; other columns may have
    any name. Only the text is looked at.
    """
    ship(df.sparkSession)
    rows, kept, back = carried(df, text, keep, (f"{prefix}score", f"{prefix}predicted"))
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "in__"):
                s = model.scores(features(*text_offsets(b.column("in__")), model.learned))
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(f.name)) for f in kept] + [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], schema.names)

    out = rows.mapInArrow(run, schema)
    return out.select(*back, F.col("score").alias(f"{prefix}score"), F.col("predicted").alias(f"{prefix}predicted"))
