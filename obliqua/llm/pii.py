"""Personal data by weak supervision.

Base spans follow four fixed patterns (emails, IP addresses, card and phone
numbers) and always stay.  Beyond them, looser shapes give candidates, most of which are none: addresses
spelt out with "at" and "dot" or without an ending, dotted numbers of any size and count (versions), long runs of digits
(serial and order numbers), groups of digits without a country code (dates).  Labelers (the base pattern, shape, a checksum or range, gazetteers,
words around, edges, dullness) vote for, against or not at all on every span, base spans too; votes and a
few coarse features make a pattern, and patterns are counted over all
documents.  Expectation-maximisation on those counts estimates for each kind how often it is personal data and how
each labeler votes where it is and where it is not; nothing is held fixed, and a small prior says only that labelers are more often right than wrong.  A logistic span
classifier is trained on the resulting probabilities; candidates that it accepts become spans.

Only counts of patterns (a few thousand at most) reach the driver.

Defined cases: null or empty text has no spans; spans of one kind never overlap, and
an added span overlaps no base span; repeated rows are each searched; every row is returned.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, text_slices

KINDS = ("email", "ip", "card", "phone")
# Characters of an email's first part, and the base patterns of the other kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Looser shapes of candidates.
AT = re.compile(r" ?[\[({] ?at ?[\])}] ?| at (?=[A-Za-z0-9-]{1,63} dot )|@", re.IGNORECASE)
HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?[\[({] ?dot ?[\])}] ?| dot |\.)[A-Za-z0-9-]{1,63}){0,5}", re.IGNORECASE)
DOTTED = re.compile(r"(?<![0-9.])[0-9]{1,9}(?:\.[0-9]{1,9}){2,7}(?![0-9])")
RUN = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,21}(?![0-9])")
GROUPS = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[-./ ])[0-9]{2,4}[-./ ][0-9]{2,4}(?:[-./ ][0-9]{2,4})?(?![0-9A-Za-z-])|(?<![0-9A-Za-z+.-])[0-9]{10,12}(?![0-9A-Za-z-])")
LABELERS = ("base", "shape", "valid", "listed", "cue", "edge", "dull")
# Gazetteers of the labelers.
CUES = {
    "email": ("mail", "contact", "write", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "master", "credit", "carte", "tarjeta", "karte", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact", "appel", "anruf"),
}
AGAINST = ("version", "token", "isbn", "doi", "order", "hash", "sha", "serial", "ref", "id", "no.")
ENDINGS = frozenset("com org net edu gov io de fr es uk eu info biz co us ca".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|3[068]|35")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from each @, so that long runs cost no more than once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base spans by start, then kind."""
    spans = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    spans += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end()))
    if "+" in text:
        spans += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidate_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of looser shapes that overlap no base span and none before them."""
    found = []
    for m in AT.finditer(text):
        start = m.start()
        while start > 0 and m.start() - start < 64 and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, m.end()) if start < m.start() else None
        if host:
            found.append(("email", start, host.end()))
    found += [("ip", m.start(), m.end()) for m in DOTTED.finditer(text)]
    found += [("card", m.start(), m.end()) for m in RUN.finditer(text)]
    found += [("phone", m.start(), m.end()) for m in GROUPS.finditer(text)]
    out: list[tuple[str, int, int]] = []
    # base spans of different kinds may overlap: where the furthest end so far lies past a start, they do
    taken, at, reach, furthest = sorted((a, b) for _, a, b in base), 0, -1, -1
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        while at < len(taken) and taken[at][0] < b:
            furthest = max(furthest, taken[at][1])
            at += 1
        if a >= reach and furthest <= a:
            out.append((kind, a, b))
            reach = b
    return out


def votes(kind: str, text: str, a: int, b: int, known: bool) -> str:
    """One sign for each of ``LABELERS``: ``+`` for, ``-`` against, ``0`` silent."""
    span, before = text[a:b], text[max(0, a - 40) : a].lower()
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "email":
        ending = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
        shape, valid, listed = "@" in span or span.count("(") + span.count("[") > 0, not ending.isdigit() and len(ending) < 8, ending in ENDINGS
    elif kind == "card":
        shape, valid, listed = len(digits) in (15, 16), 14 <= len(digits) <= 19 and luhn(digits), ISSUERS.match(digits) is not None
    elif kind == "ip":
        parts = span.split(".")
        shape, valid, listed = len(parts) == 4, all(len(p) < 4 and int(p) <= 255 for p in parts), not span.startswith(("0.", "127.", "255."))
    else:
        shape, valid, listed = len(digits) in (10, 11, 12), 10 <= len(digits) <= 15, span[:1] in "+("
    words = re.split(r"[^a-z.]+", before)[-6:]
    cue = any(w.startswith(c) for w in words for c in CUES[kind])
    rival = any(w in AGAINST for w in words)
    edge = text[a - 1 : a].isalnum() or text[b : b + 1].isalnum()
    dull = bool(digits) and len(set(digits)) <= 2
    signs = ("+" if known else "-", "+" if shape else "-", "+" if valid else "-", "+" if listed else "-", "+" if cue else "-" if rival else "0", "-" if edge else "+", "-" if dull else "0")
    return "".join(signs)


def pattern(kind: str, text: str, a: int, b: int, known: bool) -> str:
    """The kind, the votes and coarse features of a span: its length and what stands before it."""
    before = text[a - 1 : a]
    side = "s" if not before or before.isspace() else "d" if before.isdigit() else "a" if before.isalpha() else "p"
    return f"{kind}|{votes(kind, text, a, b, known)}|{min((b - a) // 4, 12)}|{side}|{int(' ' in text[a:b])}"


WIDTH = 1 + 4 + 3 * len(LABELERS) + 13 + 4 + 1


def _inputs(patterns: list[str]) -> np.ndarray:
    """0/1 features of patterns."""
    rows = np.zeros((len(patterns), WIDTH))
    for row, text in zip(rows, patterns, strict=True):
        kind, signs, size, side, spaced = text.split("|")
        row[0] = 1
        row[1 + KINDS.index(kind)] = 1
        for k, s in enumerate(signs):
            row[5 + 3 * k + "+0-".index(s)] = 1
        row[26 + int(size)] = 1
        row[39 + "sdap".index(side)] = 1
        row[43] = int(spaced)
    return rows


@dataclass
class Model:
    weights: np.ndarray
    reliability: dict[str, list[float]]

    def probability(self, patterns: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_inputs(patterns) @ self.weights, -50, 50))) if patterns else np.zeros(0)


def train(counts: dict[tuple[str, bool], int], rounds: int = 100, prior: float = 4.0) -> Model:
    """EM over the labelers' votes of (pattern, is a base span) counts, then the classifier.

    A kind starts from the majority of its votes.  Each labeler's votes have ``prior`` made-up spans on either side, on
    which it is right three times of four.  ``reliability`` is how often a labeler that votes is right, the two sides weighing the same.
    """
    items = sorted(counts)
    if not items:
        weights = np.zeros(WIDTH)
        weights[0] = -5.0
        return Model(weights, {})
    n = np.array([counts[i] for i in items], float)
    kinds = np.array([KINDS.index(i[0].split("|")[0]) for i in items])
    signs = np.array([["+0-".index(s) for s in i[0].split("|")[1]] for i in items])
    truth = np.clip(0.5 + 0.15 * ((signs == 0).sum(1) - (signs == 2).sum(1)), 0.05, 0.95)
    right, wrong = prior * np.array([0.6, 0.2, 0.2]), prior * np.array([0.2, 0.2, 0.6])
    reliability: dict[str, list[float]] = {}
    for k, kind in enumerate(KINDS):
        rows = np.flatnonzero(kinds == k)
        for _ in range(rounds if len(rows) else 0):
            yes, no = (n * truth)[rows], (n * (1 - truth))[rows]
            log_odds = np.full(len(rows), np.log((yes.sum() + prior) / (no.sum() + prior)))
            reliability[kind] = []
            for j in range(signs.shape[1]):
                for_yes = np.bincount(signs[rows, j], yes, 3) + right
                for_no = np.bincount(signs[rows, j], no, 3) + wrong
                log_odds += (np.log(for_yes / for_yes.sum()) - np.log(for_no / for_no.sum()))[signs[rows, j]]
                reliability[kind].append(float(for_yes[0] / (for_yes[0] + for_yes[2]) + for_no[2] / (for_no[0] + for_no[2])) / 2)
            before, truth[rows] = truth[rows], 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
            if np.abs(before - truth[rows]).max() < 1e-6:
                break
    x, w = _inputs([i[0] for i in items]), np.zeros(WIDTH)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (n * (p - truth)) + 0.1 * w
        hess = (x.T * (n * p * (1 - p) + 1e-9)) @ x + 0.1 * np.eye(WIDTH)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 4 / (1e-12 + float(np.abs(step).max())))
        if float(np.abs(step).max()) < 1e-8:
            break
    return Model(w, reliability)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("pattern", pa.string()), ("base", pa.bool_())])
FOUND_SCHEMA = "doc_id long, spans array<struct<kind string, start long, stop long, pattern string, base boolean>>"


def _spans(text: str) -> list[dict]:
    base = base_spans(text)
    both = [(s, True) for s in base] + [(s, False) for s in candidate_spans(text, base)]
    return [{"kind": k, "start": a, "stop": b, "pattern": pattern(k, text, a, b, known), "base": known} for (k, a, b), known in both]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_spans(t) if t else [] for t in batch.column(1).to_pylist()], pa.list_(SPAN))], names=["doc_id", "spans"])


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id and every base span and candidate with its pattern; no text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_find, FOUND_SCHEMA)


def fit(found: DataFrame) -> Model:
    """A model from the patterns of all of ``found``."""
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.pattern", "s.base").count().collect()
    return train({(r["pattern"], r["base"]): r["count"] for r in rows})


def accepted(spans: list[dict], model: Model, threshold: float) -> list[tuple[str, int, int, bool]]:
    extra = [s for s in spans if not s["base"]]
    chance = model.probability([s["pattern"] for s in extra])
    chosen = [s for s in spans if s["base"]] + [s for s, p in zip(extra, chance, strict=True) if p >= threshold]
    return sorted(((s["kind"], s["start"], s["stop"], s["base"]) for s in chosen), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


DIGEST_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def digest(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts and hash of the base spans, and all spans, of every row of ``docs``."""
    found = checkpointed(find_spans(docs))
    shared = docs.sparkSession.sparkContext.broadcast(fit(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, texts = [], [], []
            for spans in batch.column(1).to_pylist():
                chosen = accepted(spans, shared.value, threshold)
                base = [f"{k}:{a}:{b}" for k, a, b, known in chosen if known]
                number = Counter(k for k, _, _, known in chosen if known)
                counts.append([number[k] for k in KINDS])
                hashes.append(hashlib.sha256(",".join(base).encode()).hexdigest())
                texts.append(",".join(f"{k}:{a}:{b}" for k, a, b, _ in chosen))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(hashes, pa.string()), pa.array(texts, pa.string())], names=[c.split()[0] for c in DIGEST_SCHEMA.split(", ")])

    return found.mapInArrow(run, DIGEST_SCHEMA)


def mask(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The columns of ``docs`` with every span in ``text`` replaced by its kind in brackets."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(find_spans(docs)))
    place, schema = docs.columns.index("text"), T.StructType(docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = []
            for text in batch.column(place).to_pylist():
                if text:
                    parts, at = [], 0
                    for kind, a, b, _ in accepted(_spans(text), shared.value, threshold):
                        if b > at:
                            parts += [text[at : max(a, at)], f"[{kind.upper()}]"] if a >= at else []
                            at = b
                    text = "".join(parts) + text[at:]
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, c.type) if k == place else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, schema)
