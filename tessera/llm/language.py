"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The classifier is fitted on the driver from a sample of labelled documents whose size is a parameter (SAMPLE_PER_LANGUAGE
for each language on average, twice that in all at most): follow-the-regularised-leader with elastic-net penalties, then one
temperature that minimises the log loss of the fifth of the sample that the fit didn't see. Inverse document frequencies are
those of all labelled documents. Prediction is a pass over whole texts: the mean, over all positions and orders, of a table
of weights by hashed n-gram. Long texts are taken in parts of bounded size, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.reduce import sum_vectors
from tessera.plans.shipping import ships

from .common import map_text, slices, tidy

#: Production parameters: orders of n-grams, buckets that they are hashed to, documents of the fit.
ORDERS = (1, 2, 3)
BUCKETS = 1 << 18
SAMPLE_PER_LANGUAGE = 800
#: Of the fit: passes, learning rate and its offset, penalties; features are term frequencies times SCALE.
EPOCHS, ALPHA, BETA, L1, L2, SCALE = 3, 0.3, 1.0, 0.002, 0.001, 32.0
UNKNOWN = "und"
#: Bytes of texts, and characters of a long one, that are hashed at a time; languages whose table (1 MB each) is broadcast at most.
TEXT_BYTES, PART, MOST_LANGUAGES = 1 << 18, 1 << 19, 200


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def hashed(texts: list[str | None], before: np.ndarray | None = None, within: bool = False) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams at each place of the texts put in a row (one array for each order), the texts' bounds there, the letters of each, and the last code points.

    Text is lower-cased; a run of anything but letters counts as one space, and each text has a space at either end. Of
    the only text, before: the code points that stand in place of the first space; within: there is no last space.
    """
    raw = [f" {t.lower()} " if t else "  " for t in texts]
    codes = np.frombuffer("".join(raw).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(r) for r in raw], np.int64)
    row = np.repeat(np.arange(len(raw)), sizes)
    is_letter = letters()[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of a run of other characters
    keep[np.cumsum(sizes) - sizes] = True
    keep &= ~(~is_letter & np.concatenate(([False], ~is_letter[:-1])) & np.concatenate(([False], row[1:] == row[:-1])))
    codes, row = np.where(is_letter, codes, 32)[keep].astype(np.uint64), row[keep]
    n_letters = np.bincount(row, codes != 32, len(raw)).astype(np.int64)
    bounds = np.searchsorted(row, np.arange(len(raw) + 1))
    if within:
        codes, bounds = codes[:-1], bounds - np.array([0, 1])
    if before is not None:
        codes = np.concatenate([before, codes[1:]])
        bounds = np.array([0, len(codes)])
    out, key = [], np.zeros(len(codes), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        key = key[: max(0, len(codes) - order + 1)] * np.uint64(0x200003) + codes[order - 1 :] + np.uint64(1)
        if order in ORDERS:
            mixed = key * np.uint64(0x9E3779B97F4A7C15)
            bucket = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)
            out.append(bucket)
    return out, bounds, n_letters, codes[-max(ORDERS) :]


def spans(bounds: np.ndarray, order: int, size: int, seen: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Start and end, for each text, of the places whose n-gram of this order lies within it, and not within its first seen code points."""
    first = bounds[:-1] + max(0, seen - order + 1)
    return np.minimum(first, size), np.minimum(np.maximum(bounds[1:] - order + 1, first), size)


def parts(text: str) -> Iterator[tuple[str, bool]]:
    """The text in parts of about PART characters, and whether a part ends within a word, which it does only if there is no other place."""
    at = 0
    while len(text) - at > PART:
        window = text[at + PART : at + 2 * PART]
        other = np.flatnonzero(~letters()[np.frombuffer(window.encode("utf-32-le"), np.uint32)])
        end = window.find(" ") if " " in window else int(other[0]) if len(other) else 0
        yield text[at : at + PART + end], not len(other) and text[at + PART - 1].isalpha()
        at += PART + end
    yield text[at:], False


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]]:
    """Rows of texts, for each order the buckets with each row's start and end there, and each row's letters. A long text comes alone and in several parts, whose n-grams add up to its own."""
    short = np.array([i for i, t in enumerate(texts) if not t or len(t) <= PART], np.int64)
    if len(short):
        buckets, bounds, n_letters, _ = hashed([texts[i] for i in short])
        yield short, [(b, *spans(bounds, order, len(b))) for order, b in zip(ORDERS, buckets)], n_letters
    for i, text in enumerate(texts):
        if text and len(text) > PART:
            before = None
            for part, within in parts(text):
                seen = 0 if before is None else len(before)
                buckets, bounds, n_letters, last = hashed([part], before, within)
                yield np.array([i]), [(b, *spans(bounds, order, len(b), seen)) for order, b in zip(ORDERS, buckets)], n_letters
                before = last


@dataclass
class Model:
    """languages: their names, sorted; table: weights times inverse document frequencies, a row for each language; bias; temperature."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, places, n_letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for rows, found, letters_of in grams(texts):
            n_letters[rows] += letters_of
            for bucket, a, b in found:
                places[rows] += b - a
                for k, weights in enumerate(self.table):
                    got = np.append(weights[bucket].astype(float), 0.0)
                    summed = np.add.reduceat(got, np.stack([a, b], 1).ravel())[::2]
                    total[rows, k] += np.where(b > a, summed, 0.0)
        score = (SCALE * total / np.maximum(places, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        known = n_letters > 0
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, known)], np.where(known, p.max(1), 0.0)


def counts(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text with their term frequencies."""
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    for rows, found, _ in grams(texts):
        for j, i in enumerate(rows):
            held[i].append(np.unique(np.concatenate([bucket[a[j] : b[j]] for bucket, a, b in found]), return_counts=True))
    out = []
    for own in held:
        ids, n = own[0]
        if len(own) > 1:
            n = np.bincount(np.concatenate([x for x, _ in own]), np.concatenate([y for _, y in own]))
            ids = np.flatnonzero(n).astype(np.int32)
            n = n[ids]
        out.append((ids, n / max(1, n.sum())))
    return out


def frequencies(texts: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many texts of the column each bucket occurs, and how many texts there are (nulls aside). The vector's size is fixed."""
    pieces = 16

    def run(batches):
        total, place, n = np.zeros(BUCKETS, np.int64), np.empty(BUCKETS, np.int64), 0
        for batch in slices(batches, text_col, TEXT_BYTES):
            texts = batch[text_col].drop_null().to_pylist()
            n += len(texts)
            seen: dict[int, np.ndarray] = {}
            for rows, found, _ in grams(texts):
                for j, i in enumerate(rows.tolist()):
                    own = np.concatenate([bucket[a[j] : b[j]] for bucket, a, b in found])
                    number = np.arange(len(own))
                    place[own] = number
                    own = own[place[own] == number]  # each bucket once: where it was written last
                    if len(texts[i] or "") > PART:
                        own = np.setdiff1d(own, seen.get(i, own[:0]))
                        seen[i] = np.union1d(seen.get(i, own[:0]), own)
                    total[own] += 1
        parts = [np.append(n, x).tobytes() for x in np.split(total, pieces)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int64()), pa.array(parts, pa.binary())], names=["k", "v"])
        tidy()

    sums = {r.k: np.frombuffer(r.v, "<i8") for r in sum_vectors(texts.select(text_col).mapInArrow(run, "k long, v binary"), "<i8", "<i8").collect()}
    if not sums:
        return np.zeros(BUCKETS, np.int64), 0
    return np.concatenate([sums[k][1:] for k in range(pieces)]), int(sums[0][0])


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], often: np.ndarray, documents: int) -> Model:
    """From (language, buckets, term frequencies) of the sample, and the document frequencies of buckets among so many documents. Without rows the model predicts UNKNOWN."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0), 1.0)
    held = [r for i, r in enumerate(rows) if i % 5 == 4]
    seen = [r for i, r in enumerate(rows) if i % 5 != 4] if {r[0] for i, r in enumerate(rows) if i % 5 != 4} == set(languages) else rows
    idf = np.where(often > 0, np.log((1 + documents) / (1 + often)) + 1, 0.0)
    number, k = {x: i for i, x in enumerate(languages)}, len(languages)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(at):
        return np.where(np.abs(z[at]) > L1, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for i in order.permutation(len(seen)):
            language, ids, tf = seen[i]
            at, x = np.append(ids, BUCKETS), np.append(SCALE * tf * idf[ids], 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[number[language]] -= 1
            g = x[:, None] * p
            root = np.sqrt(n[at] + g * g)
            z[at] += g - (root - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    whole = weights(np.arange(BUCKETS + 1))
    table, bias = np.ascontiguousarray((whole[:-1] * idf[:, None]).T, np.float32), whole[-1]
    scores = np.array([SCALE * (table[:, ids].astype(float) @ tf) + bias for _, ids, tf in held]).reshape(len(held), k)
    truth = np.array([number[r[0]] for r in held], int)

    def loss(t):
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), truth]))

    grid = np.exp(np.linspace(np.log(0.2), np.log(5), 60))
    return Model(languages, table, bias, float(min(grid, key=loss)) if held else 1.0)


@ships
def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fits on labelled rows (lang_col and text not null). A hash of id and text decides which documents the sample holds; document frequencies cover all.

    Raises if there are more than MOST_LANGUAGES languages, whose table would be too large to broadcast."""
    labelled = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    sizes = {r["l"]: r["count"] for r in labelled.groupBy("l").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return fit([], np.zeros(BUCKETS), 0)
    rate = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))))
    sample = labelled.filter(F.pmod(F.xxhash64("i", "t", F.lit(7)), F.lit(1 << 30)) < rate[F.col("l")] * (1 << 30)).limit(2 * per_language * len(sizes))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = counts(batch["t"].to_pylist())
        return pa.RecordBatch.from_arrays([batch["i"], batch["l"], pa.array([x.astype("<i4").tobytes() for x, _ in found]), pa.array([x.astype("<f4").tobytes() for _, x in found])], names=["i", "l", "ids", "tf"])

    rows = map_text(sample, ["i", "l"], "t", f, f"i {labelled.schema['i'].dataType.simpleString()}, l string, ids binary, tf binary").toPandas()
    rows = rows.sort_values(["i", "l", "ids", "tf"], kind="stable", na_position="first")
    model = fit([(lang, np.frombuffer(ids, "<i4"), np.frombuffer(tf, "<f4").astype(float)) for lang, ids, tf in zip(rows["l"], rows["ids"], rows["tf"])], *frequencies(labelled, "t"))
    del rows
    tidy()  # of the driver, which goes on
    return model


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns keep, lang_pred, score of every whole text; UNKNOWN with score 0 if the text is null or has no letter.

    The score is the calibrated probability of lang_pred. Rows map one to one; equal texts get equal results; of equal
    scores the language that sorts first wins. The table (1 MB a language, MOST_LANGUAGES at most) is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [id_col, *keep]

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = shared.value.predict(batch[text_col].to_pylist())
        return pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return map_text(df, names, text_col, f, ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names) + ", lang_pred string, score double", TEXT_BYTES)
