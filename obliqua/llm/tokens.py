"""Token ids by the ``tokenizers`` library, remembered word by word.

A file's pre-tokenizer cuts a text into words that are encoded independently.
For texts made of plain characters (ASCII and printable Latin-1) this module
cuts the words itself and asks the library only for words it has not met
lately; every other text goes to the library whole.  The ids are the library's
in both cases.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from operator import itemgetter

import numpy as np

from .common import give_back

#: Texts of these characters need no Unicode normalisation and have the same
#: classes of characters in every library: tab, newline, return, printable
#: ASCII and Latin-1 without the no-break space and the soft hyphen.
PLAIN = re.compile("[\t\n\r -~¡-¬®-ÿ]*")

#: Letters and numbers among the plain characters; with the rest they make up the
#: word patterns of the two public vocabulary files for plain texts.
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
OTHER = f"[^{LETTER}{NUMBER}\\t\\n\\r ]"
WORDS_LOWER = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|{OTHER}+"
WORDS_BYTES = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?{OTHER}+|\\s+(?!\\S)|\\s+"

FILES = {"word_bpe_49k.json": (WORDS_LOWER, True), "byte_bpe_50k.json": (WORDS_BYTES, False)}


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    Words of letters that are new are encoded many at a time, as one text, and
    the ids are dealt back to them.  ``most_words`` bounds the memory of remembered words;
    when half of it is full, the words of the half before are forgotten.
    Unknown vocabulary files always take the library's way.
    """

    def __init__(self, path: str, most_words: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pattern, self.lower = FILES.get(os.path.basename(path), (None, False))
        self.find = re.compile(pattern).findall if pattern else None
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.most_words = most_words
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        #: by id: bytes of a token, or for the file with word ends whether a word ends there
        self.sizes = np.array([x.endswith("</w>") if self.lower else len(x) for x in names], np.int64)

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def many(self, words: list[str], at_once: int = 512) -> list[bytes]:
        """The ids of words of letters (behind a space, for the file of bytes)."""
        out: list[bytes] = []
        gap = " " if self.lower else ""
        parts = [words[i : i + at_once] for i in range(0, len(words), at_once)]
        for part, got in zip(parts, self.tokenizer.encode_batch_fast([gap.join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.asarray(got.ids, "<u4")
            if self.lower:
                ends = np.flatnonzero(self.sizes[ids]) + 1
            else:  # each word begins with the one space that it has
                starts = np.flatnonzero(np.frombuffer("".join(part).encode(), np.uint8) == 32)
                ends = np.append(np.searchsorted(np.cumsum(self.sizes[ids]), starts[1:]) + 1, len(ids))
            raw, at = ids.tobytes(), 0
            for end in (4 * ends).tolist():
                out.append(raw[at:end])
                at = end
        return out

    def learn(self, words: set[str]) -> None:
        if len(self.words) > self.most_words // 2:
            self.before, self.words = self.words, {}
        new = words.difference(self.words)
        known = new & self.before.keys()
        for word in known:
            self.words[word] = self.before[word]
        new -= known
        letters = [w for w in new if (w.isalpha() if self.lower else w[0] == " " and w[1:].isalpha())]
        rest = list(new.difference(letters))
        self.words.update(zip(letters, self.many(letters), strict=True))
        self.words.update(zip(rest, self.library(rest), strict=True))

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text, packed."""
        texts = list(texts)
        out: list[bytes] = [b""] * len(texts)
        cut: list[tuple[int, list[str]]] = []
        odd: list[int] = []
        for i, text in enumerate(texts):
            if self.find and PLAIN.fullmatch(text) and "<|" not in text:
                cut.append((i, self.find(text.lower() if self.lower else text)))
            else:
                odd.append(i)
        for i, ids in zip(odd, self.library([texts[i] for i in odd]) if odd else [], strict=True):
            out[i] = ids
        self.learn(set().union(*(words for _, words in cut)))
        for i, words in cut:
            # an itemgetter looks up all words of a text in one call; of two words at least it makes a tuple
            out[i] = b"".join(itemgetter(*words)(self.words)) if len(words) > 1 else b"".join(self.words[w] for w in words)
        return out


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, most_words: int = 250_000) -> WordEncoder:
    """This worker's encoder of a vocabulary file, kept from task to task."""
    key = (path, most_words)
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, most_words)
    return _encoders[key]


def forget() -> None:
    """Drops this worker's encoders, some 100 MB each; for tasks of other stages that need the room."""
    _encoders.clear()
    give_back()
