"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts and
digits or signs that stand for a letter (only right before letters) become
plain letters, ``l`` counts as ``i``, every other sign is a space.  The lexicon
holds words and beginnings of words with a weight each; a word counts with the
heaviest entry that it matches, unless the match lies inside an exception phrase.  The sum over
a text, divided by its length in words, goes through a logistic curve.

Lexicon, exceptions and curve are learned from a bounded sample of labelled
rows (``most_rows``), near copies in it counted once: terms of toxic texts are
counted on the executors, those of enough texts become candidates, and the
hits of the candidates in the sample (not the texts) reach the driver.  Exceptions are
phrases of a matched word and its neighbours, one space apart, that ``least_clean`` texts
labelled clean have and none labelled toxic has.

Defined cases: null text is empty; an empty text has the curve's value at 0; no
labelled rows give an empty lexicon and score 0 for every text; repeated rows are each scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, text_slices

# Letters that look like a Latin one, and digits and signs that stand for one.
LOOK_ALIKE = dict(zip("аеорсухіјѕԁһԛԝкмтвнαβεικνορτυχ", "aeopcyxijsdhqwkmtbhabeiknoptux", strict=True))
STAND_IN = dict(zip("0134578@$!|", "oieastbasii", strict=True))
SEPARATOR = "\x01"
_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(letter of each code point or 32, stand-in letter or 0) below 0x600."""
    if not _TABLES:
        letters, stand_in = np.full(0x600, 32, np.uint32), np.zeros(0x600, np.uint32)
        for i in range(0x600):
            low = chr(i).lower()[:1]
            low = LOOK_ALIKE.get(low, low)
            if low.isalpha():
                letters[i] = ord("i" if low == "l" else low)
        letters[1] = 1
        for sign, letter in STAND_IN.items():
            stand_in[ord(sign)] = ord(letter)
        _TABLES.append((letters, stand_in))
    return _TABLES[0]


def fold(text: str) -> str:
    """The text letter by letter, as long as it was."""
    letters, stand_in = _tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = (points >= 0xFF01) & (points <= 0xFF5E)
    points = np.where(wide, points - 0xFEE0, points)
    low = np.minimum(points, 0x5FF)
    out = np.where(points < 0x600, letters[low], np.where(points < 0x2070, 32, points))
    signs = np.where(points < 0x600, stand_in[low], 0)
    ahead = np.concatenate([out > 32, [False, False]])
    more = np.concatenate([signs > 0, [False]])
    stands = (signs > 0) & (ahead[1:-1] | (more[1:] & ahead[2:]))
    return np.where(stands, signs, out).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def terms(text: str) -> set[str]:
    """Words (closed by a space) and beginnings of words (open) of a text."""
    found = set()
    for word in set(fold(text).replace(SEPARATOR, " ").split()):
        if len(word) <= 40:
            found.add(f" {word} ")
            found.update(f" {word[:n]}" for n in range(4, min(8, len(word)) + 1))
    return found


def _outside(found: dict[int, float], spared: list[tuple[int, int]]) -> dict[int, float]:
    """What lies in none of the stretches (from, to), by one sweep over both in order of place."""
    if not spared:
        return found
    waiting, reach, out = iter(sorted(spared)), -1, {}
    ahead = next(waiting)
    for at in sorted(found):
        while ahead is not None and ahead[0] <= at:
            reach, ahead = max(reach, ahead[1]), next(waiting, None)
        if at >= reach:
            out[at] = found[at]
    return out


@dataclass
class Lexicon:
    """Entries begin with a space; those that end with one match whole words only."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.0
    shift: float = -40.0

    def __post_init__(self):
        self._machine = None

    def machine(self):
        import ahocorasick

        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._machine.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                entry = " " + " ".join(fold(phrase).split()) + " "
                self._machine.add_word(entry, (len(entry), -1.0))
            if len(self._machine):
                self._machine.make_automaton()
        return self._machine

    def hits(self, folded: str) -> dict[int, float]:
        """Position of each counted word and its heaviest weight."""
        if not len(self.machine()):
            return {}
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in self.machine().iter(folded):
            at = end - length + 1
            if weight < 0:
                spared.append((at, end))
            else:
                found[at] = max(weight, found.get(at, 0.0))
        return _outside(found, spared)

    def phrases(self, text: str) -> set[str]:
        """Each counted word with the word before, the word after, and both."""
        folded, found = f" {fold(text).replace(SEPARATOR, ' ')} ", set()
        for at in self.hits(folded):
            end = folded.index(" ", at + 1)
            word, before, after = folded[at + 1 : end], folded[folded.rfind(" ", 0, at) + 1 : at], folded[end + 1 : max(end + 1, folded.find(" ", end + 1))]
            if len(before) + len(word) + len(after) <= 120:
                found.update([f"{before} {word}"] * bool(before) + [f"{word} {after}"] * bool(after) + [f"{before} {word} {after}"] * bool(before and after))
        return found

    def density(self, texts: list[str]) -> np.ndarray:
        """Weight per word of each text, from one walk over all of them."""
        gap = f" {SEPARATOR} "
        joined = gap + gap.join(texts) + gap
        starts = np.cumsum([len(gap), *(len(t) + len(gap) for t in texts)])
        folded = fold(joined)
        total = np.zeros(len(texts))
        for at, weight in self.hits(folded).items():
            total[np.searchsorted(starts, at + 1, "right") - 1] += weight
        return total / (10.0 + np.array([t.count(" ") + t.count("\n") + 1 for t in texts]))

    def scores(self, density: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(200 * density) + self.shift, -50, 50)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two min-hashes of the words' trigrams, by which near copies in the sample fall together."""
    import xxhash

    for batch in text_slices(batches):
        rows = []
        for text in batch.column("text").to_pylist():
            words = (text or "").split()
            codes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))], np.uint64)
            rows.append([int((codes * np.uint64(k)).min() >> np.uint64(1)) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=[*batch.schema.names, "h1", "h2"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    counts: Counter[str] = Counter()
    for batch in text_slices(batches):
        for text in batch.column("text").to_pylist():
            counts.update(terms(text or ""))
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])


def fit(labelled: DataFrame, most_rows: int = 6000, least_texts: int = 5, least_weight: float = 2.5, most_terms: int = 5000, least_clean: int = 3) -> Lexicon:
    """Learns from ``labelled`` (doc_id, text, toxic), of which about ``most_rows`` are taken, whole."""
    from .common import checkpointed

    sample = bounded_sample(labelled.filter("toxic is not null").select("doc_id", "toxic", "text"), "doc_id", most_rows, "toxicity")
    sketched = sample.mapInArrow(_sketch, "doc_id long, toxic int, text string, h1 long, h2 long")
    sample = checkpointed(sketched.dropDuplicates(["toxic", "h1"]).dropDuplicates(["toxic", "h2"]).select("toxic", "text"))
    common = sample.filter("toxic = 1").mapInArrow(_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_texts)
    candidates = {r["term"]: 1.0 for r in common.orderBy(F.desc("n"), "term").limit(20 * most_terms).collect()}
    probe = sample.sparkSession.sparkContext.broadcast(sorted(candidates))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {t: i for i, t in enumerate(probe.value)}
        for batch in text_slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            hits = [sorted(wanted[t] for t in terms(text) if t in wanted) for text in texts]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(hits, pa.list_(pa.int32()))], names=["toxic", "hits"])

    seen = sample.mapInArrow(find, "toxic int, hits array<int>").collect()
    counts = np.zeros((2, len(candidates)))
    sizes = np.zeros(2)
    for row in seen:
        sizes[int(row["toxic"] == 1)] += 1
        counts[int(row["toxic"] == 1), row["hits"]] += 1
    odds = np.log((counts[1] + 0.5) / (sizes[1] + 1)) - np.log((counts[0] + 0.5) / (sizes[0] + 1))
    heavy = sorted((i for i in np.flatnonzero((odds >= least_weight) & (counts[1] >= least_texts))), key=lambda i: (-counts[1, i], probe.value[i]))[:most_terms]
    lexicon = Lexicon({probe.value[i]: float(odds[i]) for i in heavy})
    weights = sample.sparkSession.sparkContext.broadcast(lexicon.weights)

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(weights.value)
        for batch in text_slices(batches):
            around = [(p, toxic == 1) for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True) for p in own.phrases(text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in around], pa.string()), pa.array([t for _, t in around], pa.bool_())], names=["phrase", "toxic"])

    spared = sample.mapInArrow(surround, "phrase string, toxic boolean").groupBy("phrase").agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean")).filter((F.col("toxic") == 0) & (F.col("clean") >= least_clean))
    lexicon.exceptions = [r["phrase"] for r in spared.orderBy(F.desc("clean"), "phrase").limit(most_terms).collect()]
    machine = sample.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*machine.value)
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(own.density([t or "" for t in batch.column("text").to_pylist()]), pa.float64())], names=["toxic", "density"])

    points = sample.mapInArrow(measure, "toxic int, density double").collect()
    if points:
        lexicon.slope, lexicon.shift = _curve(np.array([p["density"] for p in points]), np.array([p["toxic"] == 1 for p in points], float))
    return lexicon


def _curve(density: np.ndarray, truth: np.ndarray, penalty: float = 1e-3) -> tuple[float, float]:
    """Logistic regression of the label on the logarithm of the density, by Newton's method."""
    x = np.stack([np.log1p(200 * density), np.ones(len(density))], 1)
    w = np.array([1.0, -2.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (p - truth) / len(x) + penalty * w
        hess = (x.T * (p * (1 - p))) @ x / len(x) + penalty * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 5 / (1e-9 + float(np.abs(step).max())))
        if math.isclose(float(np.abs(step).max()), 0, abs_tol=1e-9):
            break
    return max(float(w[0]), 0.0), float(w[1])


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.slope, lexicon.shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*shared.value)
        for batch in text_slices(batches, 1 << 18):
            got = own.scores(own.density([t or "" for t in batch.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64()), pa.array((got >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
