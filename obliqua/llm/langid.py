"""Language ID: multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased and everything else becomes a space; the n-grams of one
to three characters are hashed into a table for each length.  A feature is the
n-gram's share of the text times its inverse document frequency.  Weights are
learned on the driver by follow-the-regularised-leader with L1 and L2 penalties
from a bounded sample of labelled rows (``most_rows``), whose features the
executors compute; a fifth of the sample sets the softmax temperature.  The
finished tables (fixed size) go to the executors, where scoring is one gather
per character and length over whole texts.

Defined cases: a null text or one without a letter is ``und`` with score 1; with
no learned language every text is ``und`` with score 0; rows are never dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, text_slices

ORDERS, BITS = 3, 16
SIZE = 1 << BITS
SCALE = 20.0
_FOLD: list[np.ndarray] = []


def fold(text: str) -> np.ndarray:
    """Code points in lower case, non-letters as spaces."""
    if not _FOLD:
        table = np.full(0x2000, 32, np.uint32)
        for i in range(0x2000):
            if chr(i).isalpha():
                low = chr(i).lower()
                table[i] = ord(low) if len(low) == 1 else i
        _FOLD.append(table)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 0x2000, _FOLD[0][np.minimum(points, 0x1FFF)], np.where(points < 0x2070, 32, points)).astype(np.uint32)


def grams(points: np.ndarray) -> list[np.ndarray]:
    """For each order the bucket of the n-gram that starts at each position."""
    out = []
    for n in range(1, ORDERS + 1):
        if len(points) < n:
            out.append(np.zeros(0, np.int64))
            continue
        h = np.zeros(len(points) - n + 1, np.uint32)
        for k in range(n):
            h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        out.append((h & np.uint32(SIZE - 1)).astype(np.int64) + (n - 1) * SIZE)
    return out


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of one text."""
    found, shares = [], []
    for each in grams(fold(text)):
        if len(each):
            buckets, counts = np.unique(each, return_counts=True)
            found.append(buckets)
            shares.append(counts / len(each))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(found), np.concatenate(shares)


@dataclass
class Model:
    """``table[b]`` holds, for each language, weight times inverse document frequency of a bucket."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(logits, has a letter) of texts, over all of their characters."""
        sums = np.tile(self.bias, (len(texts), 1)).astype(np.float64)
        letter = np.zeros(len(texts), bool)
        points = fold("".join(texts))
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        full = np.flatnonzero(ends > starts)
        if len(full):
            letter[full] = np.maximum.reduceat((points != 32) & (points < 0x2000), starts[full])
        for n, each in enumerate(grams(points), 1):
            fit = np.flatnonzero(ends - starts >= n)
            if not len(fit):
                continue
            rows = self.table[each]
            # the last n - 1 positions of a text begin n-grams that reach into the next text
            inner = np.stack([starts[fit], ends[fit] - n + 1], 1).ravel()
            if inner[-1] >= len(rows):
                rows = np.concatenate([rows, np.zeros((1, rows.shape[1]), rows.dtype)])
            sums[fit] += np.add.reduceat(rows, inner, axis=0, dtype=np.float64)[::2] / (ends[fit] - starts[fit] - n + 1)[:, None]
        for i in np.flatnonzero(~letter):
            letter[i] = any(c.isalpha() for c in texts[i])
        return sums, letter


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3, seed: int = 5) -> Model:
    """Fits a model to (language, buckets, shares) rows."""
    languages = sorted({r[0] for r in rows})
    width, number = ORDERS * SIZE, {x: i for i, x in enumerate(languages)}
    if not languages:
        return Model([], np.zeros((width, 1), np.float32), np.zeros(1), 1.0)
    order = np.random.default_rng(seed).permutation(len(rows))
    held, learned = order[: len(rows) // 5], order[len(rows) // 5 :]
    seen = np.zeros(width)
    for i in learned:
        seen[rows[i][1]] += 1
    idf = np.log((1 + len(learned)) / (1 + seen)) + 1
    z, n = np.zeros((width, len(languages))), np.zeros((width, len(languages)))
    bias_z, bias_n = np.zeros(len(languages)), np.zeros(len(languages))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in learned:
            language, at, share = rows[i]
            x = (share * idf[at] * SCALE)[:, None]
            za, na = z[at], n[at]
            w, b = weights(za, na), weights(bias_z, bias_n)
            error = softmax((x * w).sum(0) + b)
            error[number[language]] -= 1
            g = x * error
            n[at] = na + g * g
            z[at] = za + g - (np.sqrt(n[at]) - np.sqrt(na)) / alpha * w
            grown = bias_n + error * error
            bias_z = bias_z + error - (np.sqrt(grown) - np.sqrt(bias_n)) / alpha * b
            bias_n = grown
    model = Model(languages, (weights(z, n) * idf[:, None] * SCALE).astype(np.float32), weights(bias_z, bias_n), 1.0)
    if len(held):
        logits = np.stack([(model.table[rows[i][1]] * rows[i][2][:, None]).sum(0) + model.bias for i in held])
        truth = [number[rows[i][0]] for i in held]
        losses = {t: -np.log(softmax(logits / t)[np.arange(len(held)), truth] + 1e-12).mean() for t in np.geomspace(0.2, 8, 60)}
        model.temperature = float(min(losses, key=losses.get))
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        found = [features(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([s.astype(np.float32).tobytes() for _, s in found], pa.binary())], names=["lang", "at", "share"])


def fit(labelled: DataFrame, most_rows: int = 3000) -> Model:
    """Learns from ``labelled`` (doc_id, text, lang), of which about ``most_rows`` are taken, whole."""
    sample = bounded_sample(labelled.filter("lang is not null").select("doc_id", "lang", "text"), "doc_id", most_rows, "language")
    rows = sample.filter("text is not null").select("lang", "text").mapInArrow(_features, "lang string, at binary, share binary").collect()
    rows = [(r["lang"], np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["share"], np.float32).astype(np.float64)) for r in rows]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    return train([r for r in rows if len(r[1])])


def predict(docs: DataFrame, model: Model, lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """All columns of ``docs`` with the predicted language and its score; columns of the two names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(lang_name, score_name)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1 << 18):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            logits, letter = shared.value.logits([t or "" for t in texts])
            chance = softmax(logits / shared.value.temperature)
            best = chance.argmax(1)
            if shared.value.languages:
                names = [shared.value.languages[b] if ok else "und" for b, ok in zip(best, letter, strict=True)]
                score = np.where(letter, chance.max(1), 1.0)
            else:
                names, score = ["und"] * len(texts), np.where(letter, 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, lang_name, score_name])

    return docs.mapInArrow(run, schema)


def is_learned_from(column, modulus: int = 4, held: int = 2):
    from .common import id_remainder

    return id_remainder(column, modulus) != F.lit(held)
