import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from obliqua.llm import periodic


def brute(words, least=6, times=4):
    """Every stretch by definition: each start and period, extended word by word."""
    n, out = len(words), set()
    for s in range(n):
        for q in range(1, (n - s) // times + 1):
            if s and words[s - 1] == words[s - 1 + q]:
                continue
            e = s + q
            while e < n and words[e] == words[e - q]:
                e += 1
            length = e - s
            smaller = any(all(words[i] == words[i - p] for i in range(s + p, e)) for p in range(1, q))
            if length >= max(least, times * q) and not smaller:
                out.add((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc, words):
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha(told), sha(kept))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("abcd"), max_size=20).map(lambda w: w * 5) | st.tuples(st.lists(st.sampled_from("abc"), max_size=8), st.integers(0, 9), st.lists(st.sampled_from("abc"), max_size=9)).map(lambda x: x[2] + x[0] * x[1] + x[2]))
def test_runs_equal_their_definition(words):
    ids = periodic.word_ids([w.encode() for w in words])
    assert list(map(tuple, periodic.runs_of(ids).tolist())) == brute(words)


@pytest.mark.parametrize("least,times,block", [(6, 4, 16), (1, 2, 1 << 20), (30, 3, 50), (2, 5, 7)])
def test_other_bounds_and_small_blocks(monkeypatch, least, times, block):
    monkeypatch.setattr(periodic, "BLOCK", block)
    for seed in range(20):
        r = random.Random(seed)
        words = [r.choice("ab") for _ in range(50)] + ["x", "y", "z"] * r.randrange(9) + [r.choice("abc") for _ in range(20)]
        got = periodic.runs_of(periodic.word_ids([w.encode() for w in words]), least, times)
        assert list(map(tuple, got.tolist())) == brute(words, least, times)


def test_many_words_keep_numbers_of_their_own():
    words = [b"%d" % k for k in range(70_000)]
    ids = periodic.word_ids(words + words[:5] * 6)
    assert ids.dtype == np.int32 and len(set(ids[:70_000].tolist())) == 70_000
    assert periodic.stretches(ids, 5, 5).tolist() == [[70_000, 30, 5]]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = [" ".join(r.choice("abc") for _ in range(n)) for n in (0, 1, 5, 30, 80)]
    return [None, "", " \n\t", "one", "x " * 6, "x " * 5, "so so so so\tso\nso", "a b a b " * 4, "ü 漢 " * 9, *base, *base, "p q r s " * 40 + "p q", "w" * 5000]


@pytest.mark.parametrize("split,unit", [(1 << 16, 1 << 31), (20, 1 << 31), (0, 64)])
def test_query_equals_brute_force_on_every_path(spark, frame, texts, split, unit):
    ids = [*range(len(texts) - 2), 3, None]
    docs = frame(texts, ids).withColumn("row", F.lit("x")).withColumn("runs", F.lit(0)).repartition(3)
    got = [tuple(r) for r in periodic.periodic_runs(docs, split_bytes=split, unit=unit).collect()]
    want = [expected(i, [w.decode() for w in (t or "").encode().split()]) for i, t in zip(ids, texts, strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_passages_are_repeated_as_told(spark, frame):
    texts = [" ".join(f"w{k}" for k in range(n)) for n in (0, 1, 2, 9, 40, 200) * 10]
    got = periodic.periodic_runs(frame(texts), prepare=periodic.repeated_tail).orderBy("doc_id").collect()
    changed = 0
    for doc, text in enumerate(texts):
        words = [w.encode() for w in text.split()]
        made = periodic.repeated_tail(doc, words)
        changed += made != words
        assert tuple(got[doc]) == expected(doc, [w.decode() for w in made])
    assert changed > 1 and periodic.repeated_tail(None, [b"a"]) == [b"a"]


def test_empty_table(spark, frame):
    assert periodic.periodic_runs(frame([]), split_bytes=0).count() == 0
