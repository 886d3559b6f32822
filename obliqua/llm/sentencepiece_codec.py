"""SentencePiece encoding and decoding by a batched Viterbi in array operations.

Pieces and scores come from a public model file.  Spaces become U+2581, one is put in
front of a text, and no piece goes on past a word's end, so distinct words are
encoded, each once a batch.  Words of equal length advance together: at each
position the hashes of all substrings that end there probe the sorted hashes of
pieces, a vectorised maximum picks the best way to arrive, and backpointers
store it.  Characters without a piece fall back to byte pieces.

What "best" means follows the model's kind.  For a unigram model it is the
largest sum of scores.  For a merge-trained (BPE) model sums of scores do not give the
library's ids; there the lattice keeps only steps between pieces that merging
would leave side by side, of which exactly one path reaches every position, so the maximum
over the steps is that path.  Whether merging leaves two pieces side by side is worked out once
for each pair that occurs and remembered.

Defined cases: null text is empty and has no ids; an empty list of ids decodes to an empty text;
ids of bytes that are no valid UTF-8 decode to U+FFFD; ids outside the vocabulary
raise ValueError; control pieces (``<s>``, ``</s>``) decode to nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

MARK = "▁"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
NEVER = -1e18
TOP = 18
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceModel:
    """Pieces of a model file, sorted by the hash of their characters."""

    def __init__(self, path: str):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        count = processor.get_piece_size()
        self.pieces = [processor.id_to_piece(i) for i in range(count)]
        self.scores = np.array([processor.get_score(i) for i in range(count)])
        self.unknown = processor.unk_id()
        self.control = {i for i in range(count) if processor.is_control(i)}
        self.bytes = np.full(256, self.unknown, np.int64)
        self.byte_of = {}
        usable = []
        for i, piece in enumerate(self.pieces):
            if processor.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value], self.byte_of[i] = i, value
            elif i not in self.control and i != self.unknown and not processor.is_unused(i):
                usable.append(i)
        self.merges = self._is_merge_trained()
        self.by_text = {self.pieces[i]: i for i in usable}
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        self.crossing = any(MARK in p.lstrip(MARK) for p in self.by_text)
        self.keys, self.ids = self._index(usable)
        self.pairs, self.apart = np.zeros(0, np.int64), np.zeros(0, bool)
        self.fresh: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        #: what each id spells
        self.spelt = [b"" if i in self.control else " ⁇ ".encode() if i == self.unknown else bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]

    def _is_merge_trained(self) -> bool:
        """Merge-trained files score pieces by their rank: 0, -1, -2 and so on, alone among the kinds."""
        normal = [s for i, s in enumerate(self.scores) if i not in self.control and i != self.unknown and i not in self.byte_of and s > -1e8]
        steps = np.diff(np.array(normal[:-1] if len(normal) > 1 else normal))
        return len(steps) > 10 and float(np.mean(steps == -1.0)) > 0.95

    @staticmethod
    def _extend(hashes: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Hashes of strings that go on by one character each."""
        h = (hashes + points.astype(np.uint64) + np.uint64(1)) * _FACTOR
        return h ^ (h >> np.uint64(29))

    def _index(self, usable: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of all beginnings of pieces, each with the id of the piece it is, or -1."""
        keys, ids = [], []
        for length in range(1, self.longest + 1):
            long = [i for i in usable if len(self.pieces[i]) >= length]
            points = np.frombuffer("".join(self.pieces[i][:length] for i in long).encode("utf-32-le"), np.uint32).reshape(-1, length)
            h = np.zeros(len(long), np.uint64)
            for k in range(length):
                h = self._extend(h, points[:, k])
            keys.append(h)
            ids.append(np.array([i if len(self.pieces[i]) == length else -1 for i in long], np.int64))
        hashes, number = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((-number, hashes))
        hashes, number = hashes[order], number[order]
        first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        hashes, number = hashes[first], number[first]
        # where the keys with the same top bits begin: a probe looks at those few only
        self.begins = np.searchsorted(hashes, np.arange(1 << TOP, dtype=np.uint64) << np.uint64(64 - TOP)).astype(np.int64)
        self.crowd = int(np.diff(np.append(self.begins, len(hashes))).max())
        hashes = np.concatenate([hashes, np.zeros(self.crowd, np.uint64)])
        return hashes, np.concatenate([number, np.full(self.crowd, -2)])

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Id of the piece with each hash; -1 for a beginning only, -2 for neither."""
        at = self.begins[(hashes >> np.uint64(64 - TOP)).astype(np.int64)]
        found = np.full(len(hashes), -2, np.int64)
        todo = np.arange(len(hashes))
        for _ in range(self.crowd):
            key = self.keys[at]
            hit = key == hashes[todo]
            found[todo[hit]] = self.ids[at[hit]]
            going = key < hashes[todo]  # past its place in the order a hash is not there
            todo, at = todo[going], at[going] + 1
            if not len(todo):
                break
        return found

    def merged(self, text: str) -> list[str]:
        """The pieces (or single characters) that merging leaves of a short text: best score first, then leftmost."""
        parts = list(text)
        while True:
            best, where = -np.inf, -1
            for i in range(len(parts) - 1):
                piece = self.by_text.get(parts[i] + parts[i + 1])
                if piece is not None and self.scores[piece] > best:
                    best, where = self.scores[piece], i
            if where < 0:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def side_by_side(self, left: np.ndarray, right: np.ndarray, texts) -> np.ndarray:
        """Whether merging leaves each two parts apart; ``texts`` gives the parts of a place, for pairs not yet known.

        A left part of -1 stands for a word's beginning: there the right part must merge into one.
        """
        wanted = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, wanted), max(len(self.pairs) - 1, 0))
        known = self.pairs[at] == wanted if len(self.pairs) else np.zeros(len(wanted), bool)
        out = np.zeros(len(wanted), bool)
        out[known] = self.apart[at[known]]
        for k in np.flatnonzero(~known).tolist():
            pair = int(wanted[k])
            answer = self.fresh.get(pair)
            if answer is None:
                a, b = texts(k)
                answer = self.fresh[pair] = self.merged(a + b) == ([a, b] if a else [b])
            out[k] = answer
        if len(self.fresh) > max(2000, len(self.pairs) // 8):
            if len(self.pairs) > 2_000_000:  # a bound on memory: all is worked out anew
                self.pairs, self.apart = np.zeros(0, np.int64), np.zeros(0, bool)
            pairs = np.concatenate([self.pairs, np.fromiter(self.fresh, np.int64, len(self.fresh))])
            apart = np.concatenate([self.apart, np.fromiter(self.fresh.values(), bool, len(self.fresh))])
            order = np.argsort(pairs)
            self.pairs, self.apart = pairs[order], apart[order]
            self.fresh.clear()
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word; words of equal length are encoded together."""
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        out: list[list[int]] = [[] for _ in words]
        for length, places in by_length.items():
            most = max(1, 400_000 // max(1, length))
            for k in range(0, len(places), most):
                part = places[k : k + most]
                for i, ids in zip(part, self._viterbi([words[p] for p in part], length), strict=True):
                    out[i] = ids
        return out

    def _viterbi(self, words: list[str], length: int) -> list[list[int]]:
        if not length:
            return [[] for _ in words]
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)
        n, rows = len(words), np.arange(len(words))
        best = np.full((length + 1, n), NEVER)
        best[0] = 0
        step = np.zeros((length + 1, n), np.int64)  # characters of the piece that ends here
        piece = np.full((length + 1, n), -1, np.int64)
        lowest, count = float(self.scores.min()) - 10, len(self.pieces)
        columns = np.ascontiguousarray(points.T)
        for start in range(length):
            going = np.flatnonzero(best[start] > NEVER)
            hashes = np.zeros(len(going), np.uint64)
            for size in range(1, min(self.longest, length - start) + 1):
                end = start + size
                hashes = self._extend(hashes, columns[end - 1, going])
                found = self.probe(hashes)
                ids = found
                if size == 1:
                    # a character without a piece stands for its bytes; its "id" is past all ids
                    ids = np.where(found < 0, count + columns[start, going].astype(np.int64), found)
                hit = np.flatnonzero(ids >= 0)
                live, at = going[hit], ids[hit]
                if len(live):
                    if self.merges:
                        fits = self.side_by_side(piece[start, live], at, lambda k, live=live, end=end: (words[live[k]][start - int(step[start, live[k]]) : start], words[live[k]][start:end]))
                        live, at = live[fits], at[fits]
                        total = best[start, live]
                    else:
                        total = best[start, live] + np.where(at < count, self.scores[np.minimum(at, count - 1)], lowest)
                    better = total > best[end, live]
                    live = live[better]
                    best[end, live], step[end, live], piece[end, live] = total[better], size, at[better]
                goes_on = found > -2
                going, hashes = going[goes_on], hashes[goes_on]
                if not len(going):
                    break
        step, piece = step.T, piece.T
        out: list[list[int]] = [[] for _ in words]
        at = np.full(n, length)
        while (at > 0).any():
            going = rows[at > 0]
            for r, p in zip(going.tolist(), piece[going, at[going]].tolist(), strict=True):
                if p < len(self.pieces):
                    out[r].append(p)
                else:
                    out[r].extend(int(self.bytes[b]) for b in reversed(chr(p - len(self.pieces)).encode("utf-8", "replace")))
            at[going] -= step[going, at[going]]
        for ids in out:
            ids.reverse()
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts; every distinct word of the batch is encoded once."""
        return [np.frombuffer(x, "<i4").tolist() for x in self.encode_packed(texts)]

    def encode_packed(self, texts: list[str], most_words: int = 600_000) -> list[bytes]:
        """The ids of texts as little-endian 32-bit numbers.

        Up to ``most_words`` words are remembered; when half of them is full, those of the half before are forgotten.
        """
        cut = [self._words(t) for t in texts]
        if len(self.words) > most_words // 2:
            self.before, self.words = self.words, {}
        new = set().union(*cut).difference(self.words)
        for word in new & self.before.keys():
            self.words[word] = self.before[word]
        fresh = list(new.difference(self.words))
        for word, ids in zip(fresh, self.encode_words(fresh), strict=True):
            self.words[word] = np.array(ids, "<i4").tobytes()
        return [b"".join(itemgetter(*words)(self.words)) if len(words) > 1 else b"".join(self.words[w] for w in words) for words in cut]

    def _words(self, text: str) -> list[str]:
        """Runs of marks each with what follows up to the next mark; the whole text where pieces cross words."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if self.crossing:
            return [marked]
        return _WORDS.findall(marked)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the bytes of all pieces in a row, read as UTF-8."""
        if len(ids) and (min(ids) < 0 or max(ids) >= len(self.pieces)):
            raise ValueError("an id is not of this model")
        if not len(ids):
            return ""
        text = b"".join(itemgetter(*ids)(self.spelt) if len(ids) > 1 else (self.spelt[ids[0]],)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids of every row of ``docs``; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in text_slices(batches, 2 << 20):
            ids = model.encode_packed([t or "" for t in batch.column(1).to_pylist()])
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            flat = np.frombuffer(b"".join(ids), "<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of every row of ``encoded`` (doc_id, ids); null ids are an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGEST_SCHEMA = "doc_id long, n_ids long, ids_crc32 long, n_distinct long, decoded_bytes long, decoded_sha256 string"


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """Of every row of ``docs``: how many ids, their unsigned crc32 (little-endian 32-bit), distinct ids, and the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in text_slices(batches, 2 << 20):
            packed = model.encode_packed([t or "" for t in batch.column(1).to_pylist()])
            ids = [np.frombuffer(x, "<i4") for x in packed]
            back = [model.decode(x.tolist()).encode("utf-8", "surrogatepass") for x in ids]
            columns = [[len(x) for x in ids], [zlib.crc32(x) for x in packed], [len(set(x.tolist())) for x in ids], [len(b) for b in back]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string())], names=[c.split()[0] for c in DIGEST_SCHEMA.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, DIGEST_SCHEMA)
