"""Language identification with a string kernel.

Kernel: blended spectrum of presence, the share of distinct character n-grams (n = 1, 2, 3) that two texts have in common,
normalised by the root of the product of their counts. Characters are letters in lower case; each run of others is one
boundary. n-grams are numbered by a hash into 2^18 places. Nyström: a text's features are its kernels with some landmark
texts times the inverse root of the landmarks' own kernel matrix. One ridge regression for each language against the rest.

Learning takes a bounded sample (its bound is a parameter, its languages in equal parts) of labelled rows, as sets of n-gram
numbers; scoring is a map over all rows, whole texts, by batched matrix products. Nothing that is shuffled or sent grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkferry.llm._frames import carried, pick, ship, slices

BITS, LENGTHS = 18, 3
UNKNOWN = "und"
#: A text is in a learned language if landmarks have this part of the share of its n-grams that they have of the median learned text's.
NEAR = 0.7
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Each code point, or 0 where it is no letter."""
    global _letters
    if _letters is None:
        _letters = np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)
    return _letters


def grams(text: str) -> tuple[np.ndarray, bool]:
    """The numbers of a text's n-grams, with repeats, and whether it has a letter."""
    seq = letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not seq.any():
        return np.zeros(0, np.int64), False
    keep = seq != 0
    keep[1:] |= seq[:-1] != 0
    seq = np.concatenate([np.zeros(1, np.uint32), seq[keep], np.zeros(1, np.uint32)]) + np.uint32(1)
    h, out = seq * np.uint32(0x9E3779B1), []
    first = h
    for n in range(1, LENGTHS + 1):
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + first[n - 1 :]
        m = (h ^ (h >> np.uint32(16))) * np.uint32(0xC2B2AE35 + 2 * n)
        out.append((m ^ (m >> np.uint32(13))) >> np.uint32(32 - BITS))
    return np.concatenate(out).astype(np.int64), True


def gram_set(text: str | None) -> np.ndarray:
    return np.unique(grams(text)[0]).astype(np.int32) if text else np.zeros(0, np.int32)


@dataclass(frozen=True)
class Model:
    """places: the n-gram numbers that landmarks have; marks: places x landmarks; weights: landmarks x languages;
    least: the share of a text's n-grams among places from which on it is in one of the languages."""

    languages: tuple[str, ...]
    places: np.ndarray
    marks: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    least: float = 0.0

    def kernels(self, seen: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Kernels of texts with the landmarks. seen: texts x places; counts: the texts' distinct n-grams."""
        return (seen @ self.marks) / (np.sqrt(np.maximum(counts, 1))[:, None] * self.roots)

    def margins(self, seen: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.kernels(seen, counts) @ self.weights + self.bias

    def strange(self, seen: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Which texts are in none of the languages. Margins can't tell: a text's add up to 2 - K, so the best of K is never below 2 / K - 1."""
        return seen.sum(axis=1) < self.least * counts


def fit(sets: list[np.ndarray], langs: list[str], landmarks: int = 120, ridge: float = 1e-2) -> Model | None:
    """A model of labelled n-gram sets; None without any. With one language it always says that one."""
    have = [i for i, s in enumerate(sets) if len(s)]
    if not have:
        return None
    names = tuple(sorted({langs[i] for i in have}))
    by = [[i for i in have if langs[i] == k] for k in names]
    chosen = [i for group in by for i in group[: max(1, landmarks // len(names))]]
    places = np.unique(np.concatenate([sets[i] for i in chosen]))
    marks = np.zeros((len(places), len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        marks[np.searchsorted(places, sets[i]), j] = 1
    roots = np.sqrt(np.array([len(sets[i]) for i in chosen], np.float64))
    plain = Model(names, places, marks, roots, np.zeros(0), np.zeros(0))
    owners, marked = marks.sum(axis=1), set(chosen)

    def kernels(rows):
        out, shares = [], []
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            seen = np.zeros((len(part), len(places)), np.float32)
            for r, i in enumerate(part):
                where = np.searchsorted(places, sets[i])
                where[where == len(places)] = 0
                seen[r, where[places[where] == sets[i]]] = 1
            counts = np.array([len(sets[i]) for i in part], np.float64)
            out.append(plain.kernels(seen, counts))
            own = np.array([i in marked for i in part])[:, None]  # a landmark's n-grams count where another landmark has them
            shares.append((seen * (owners >= 1 + own)).sum(axis=1) / counts)
        return np.vstack(out), np.concatenate(shares)

    # Nyström: the inverse root of the landmarks' kernel matrix, without its near-empty directions.
    value, vector = np.linalg.eigh(kernels(chosen)[0])
    use = value > 1e-6 * value.max()
    root = vector[:, use] / np.sqrt(value[use])
    kernel, shares = kernels(have)
    phi = kernel @ root
    y = np.where(np.array([langs[i] for i in have])[:, None] == np.array(names)[None], 1.0, -1.0)
    weight = 1 / np.sqrt(np.array([len(by[names.index(langs[i])]) for i in have], np.float64))  # languages count alike
    mean, ymean = np.average(phi, axis=0, weights=weight), np.average(y, axis=0, weights=weight)
    x = phi - mean
    solved = np.linalg.solve((x * weight[:, None]).T @ x + ridge * weight.sum() / len(x) * np.eye(x.shape[1]), (x * weight[:, None]).T @ (y - ymean))
    return Model(names, places.astype(np.int64), marks, roots, root @ solved, ymean - mean @ solved, NEAR * float(np.median(shares)))


def predict(model: Model | None, texts: list[str | None], scratch: np.ndarray) -> tuple[list[str], list[float]]:
    """Languages and scores of texts. scratch: 2^18 bools, all false, before and after."""
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return lang, score
    for at in range(0, len(texts), 256):
        part = texts[at : at + 256]
        seen, counts, has = np.zeros((len(part), len(model.places)), np.float32), np.zeros(len(part)), []
        for r, s in enumerate(part):
            if not s:
                continue
            codes, any_letter = grams(s)
            if any_letter:
                scratch[codes] = True
                seen[r], counts[r] = scratch[model.places], np.count_nonzero(scratch)
                scratch[codes] = False
                has.append(r)
        if has:
            got = model.margins(seen[has], counts[has])
            best, strange = got.argmax(axis=1), model.strange(seen[has], counts[has])
            for r, b, m, none in zip(has, best, got[np.arange(len(has)), best], strange, strict=True):
                lang[at + r], score[at + r] = model.languages[b], 0.0 if none else float(min(1.0, max(0.0, (1 + m) / 2)))
    return lang, score


def held_out(key: Column) -> Column:
    """True where crc32 of the key as text is divisible by 5; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_rows: int = 2400, landmarks: int = 120, max_languages: int = 256) -> Model | None:
    """A model learned from at most about `max_rows` rows of those that aren't held out and have a text, a language and a key.

    Each language gives an equal share: the rows whose key's hash is below the fraction that its count calls for, so the
    choice is the same however the table is partitioned. Of more than `max_languages` languages the most frequent are learned (ties by
    name). None where no row may be learned from.
    """
    ship(df.sparkSession)
    rows = pick(df, key=key, lang=lang, text=text)
    fit_for = rows.where(F.col("key").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("key")))
    counts = {r.lang: r.n for r in fit_for.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}  # this scan leaves the texts alone
    if not counts:
        return None
    share = max(1, max_rows // len(counts))
    place = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = F.lit(False)
    for k, n in counts.items():
        wanted = wanted | ((F.col("lang") == k) & (place < share / n))
    sample = fit_for.where(wanted & F.col("text").isNotNull()).select("key", "lang", "text")
    schema = "key string, lang string, grams binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                sets = [gram_set(s).astype("<i4").tobytes() for s in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("key").cast(pa.string()), b.column("lang").cast(pa.string()), pa.array(sets, pa.binary())], ["key", "lang", "grams"])

    got = sorted(((r.key, r.lang, bytes(r.grams)) for r in sample.mapInArrow(run, schema).collect()), key=lambda r: (_order(r[0]), r))
    return fit([np.frombuffer(g, "<i4") for _, _, g in got], [k for _, k, _ in got], landmarks)


def _order(s: str) -> int:
    import zlib

    return zlib.crc32(b"landmark" + s.encode())


def identify(df: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """Each row's kept columns with lang_pred and score (0 to 1; 1 is the margin of a learned example).

    A null text, or one without a letter, is `und` with score 0, and so is every text without a model. A text whose n-grams
    aren't those of learned texts (Model.strange) has score 0 beside the language that is least far. Ties go to the first
    language by name; repeated rows stay; an empty table gives an empty one; other columns may have any name.
    """
    ship(df.sparkSession)
    rows, kept, back = carried(df, text, keep, (f"{prefix}lang_pred", f"{prefix}score"))
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = np.zeros(1 << BITS, bool)
        for whole in batches:
            for b in slices(whole, "in__"):
                lang, score = predict(model, b.column("in__").to_pylist(), scratch)
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(f.name)) for f in kept] + [pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema.names)

    out = rows.mapInArrow(run, schema)
    return out.select(*back, F.col("lang_pred").alias(f"{prefix}lang_pred"), F.col("score").alias(f"{prefix}score"))
