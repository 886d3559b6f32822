"""Joins against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from obliqua.llm import line_dedup, queries
from obliqua.llm.components import components
from obliqua.llm.edit_distance import _plain, _strides, within
from obliqua.llm.jaccard_join import keep_one, prefix_length, similar_classes
from obliqua.llm.lattice_dedup import nearest_e8, near_duplicates
from obliqua.llm.common import Scratch
from obliqua.llm.line_dedup import decisions, keyed_rows, near_lines, remove_repeated_lines
from obliqua.llm.shingles import text_shingles

from .conftest import words


def least_reachable(n, links):
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def family(seed, n, size=60, edits=2):
    """Near copies of one text, each with a few words replaced."""
    r, base = random.Random(seed), words(seed, size).split()
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(r.randrange(edits + 1)):
            copy[r.randrange(size)] = words(r.random(), 1)
        out.append(" ".join(copy))
    return out


def shingle_set(text, width):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(found)] if 0 < len(found) < width else [tuple(found[i : i + width]) for i in range(len(found) - width + 1)])


def brute(texts, width, percent):
    sets = [shingle_set(t, width) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [len(s) for s in sets], least_reachable(len(texts), links)


@pytest.mark.parametrize(("crowd", "block"), [(32, 256), (2, 3)])
def test_similar_classes_equal_brute_force(frame, odd_texts, crowd, block):
    texts = [*odd_texts, *family(1, 25), *family(2, 25, edits=5), *family(3, 12, size=6), "THE same", "the SAME", *(f"common passage that many share in all documents {words(9, 30)} {words(i, 12)}" for i in range(20))]
    random.Random(0).shuffle(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_classes(frame(texts), 4, 85, crowd, block).collect()}
    sizes, low = brute(texts, 4, 85)
    assert got == {i: (sizes[i], low[i]) for i in range(len(texts))}


def test_similar_classes_of_odd_tables(frame):
    assert similar_classes(frame([])).count() == 0
    assert similar_classes(frame([None, "", " "])).filter("component_id = doc_id and n_shingles = 0").count() == 3
    nulls = similar_classes(frame(["a b c d e", "a b c d e", "a b c d e"], ids=[None, 4, 9])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in nulls) == [("4", "4"), ("9", "4"), ("None", "None")]
    assert similar_classes(frame(["a b c d e"] * 3, ids=[2, 2, 2])).filter("component_id = 2").count() == 3


def test_keep_one_keeps_all_columns(frame):
    docs = frame(["a b c d e f", "a b c d e f", "x"], ids=[5, 3, 1])
    kept = keep_one(docs.withColumn("component_id", docs.doc_id * 0), 5, 80)
    assert kept.columns == [*docs.columns, "component_id"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


@given(st.integers(1, 400), st.integers(50, 100))
def test_prefix_length_meets_every_similar_set(n, percent):
    least_overlap = -(-percent * n // 100)
    assert prefix_length(n, percent) == n - least_overlap + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abA é \n\t\x0b漢")), max_size=30), min_size=1, max_size=6))
def test_shingles_are_those_of_the_words(texts):
    raw = [t.encode() for t in texts]
    got = text_shingles(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 3)
    assert [len(x) for x in got] == [len(shingle_set(t, 3)) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(shingle_set(texts[i], 3) & shingle_set(texts[j], 3))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(edges.filter("u < 0")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=14).map(lambda b: bytes(97 + x % 3 for x in b)), st.binary(max_size=14).map(lambda b: bytes(97 + x % 3 for x in b))), max_size=30), st.integers(0, 5))
def test_bounded_edit_distance(pairs, bound):
    left, right = [p[0] for p in pairs], [p[1] for p in pairs]
    wanted = [_plain(a, b) <= bound for a, b in pairs]
    assert within(left, right, bound).tolist() == [_strides(a, b, bound) for a, b in pairs] == wanted


def line_brute(texts, edits, least):
    first, places = {}, []
    for d, text in enumerate(texts):
        for k, line in enumerate((text or "").split("\n")):
            raw = line.encode()
            if len(raw) >= least and raw.strip(b" \t\n\r\x0b\x0c"):
                first.setdefault(raw, (d, k))
                places.append((d, k, raw))
    distinct = list(first)
    late = {max(a, b, key=first.get) for i, a in enumerate(distinct) for b in distinct[:i] if abs(len(a) - len(b)) <= edits and _plain(a, b) <= edits}
    out = {}
    for d, k, raw in places:
        if raw in late or first[raw] != (d, k):
            out.setdefault(d, []).append(k)
    return out


def test_repeated_lines_equal_brute_force(frame, odd_texts):
    r = random.Random(5)
    base = [words(i, 5) for i in range(12)]
    texts = list(odd_texts)
    for _ in range(40):
        lines = []
        for _ in range(r.randrange(1, 5)):
            line = list(r.choice(base))
            for _ in range(r.randrange(4)):
                line[r.randrange(len(line))] = r.choice(["", "é", "q", "zz"])
            lines.append("".join(line))
        texts.append("\n".join(lines))
    got = {x["doc_id"]: x["dropped"] for x in decisions(frame(texts), 2, 12).collect()}
    assert {d: v for d, v in got.items() if v} == line_brute(texts, 2, 12)
    assert len(got) == len(texts)


def test_line_dedup_of_odd_tables(frame):
    line = "a line that is long enough"
    assert decisions(frame([])).count() == 0
    docs = frame([f"{line}\nshort", f"{line}\nshort", line, None, "", f"{line}s"], ids=[1, 2, 3, 4, 5, None])
    assert {(r["doc_id"], r["text"]) for r in remove_repeated_lines(docs.withColumn("line", docs.doc_id)).collect()} == {(1, f"{line}\nshort"), (2, "short"), (4, None), (5, ""), (None, f"{line}s")}


def test_short_lines_repeat_in_the_query_and_the_pipeline(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Wh the.\nWh the.\n\n \nWh the.\nx"), (2, "Wh the.\nWh tha.\n\n "), (3, "x")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["dropped"] for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: [1, 4], 2: [0], 3: [0]}
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_deduplication(spark, docs, "").collect()}
    assert kept == {1: "Wh the.\n\n \nx", 2: "Wh tha.\n\n "}


def test_near_lines_with_changed_words_equal_brute_force(spark, tmp_path):
    r, texts = random.Random(11), []
    base = [words(i, n) for i, n in enumerate([4, 9, 10, 11, 26, 28, 30, 60, 66, 70, 72, 130, 150, 200])]
    base += ["ab" * 45, "漢字" * 40 + words(3, 9), "é" * 79, words(8, 70).replace(" ", "")]
    for _ in range(140):
        line = r.choice(base)
        for _ in range(r.choice([0, 1, 1, 2])):
            at, long = r.randrange(len(line)), r.randrange(9)
            line = line[:at] + "".join(r.choice("abcxyz é") for _ in range(r.randrange(9))) + line[at + long :]
        for _ in range(r.choice([0, 3, 9])):  # spread over the line
            at = r.randrange(max(1, len(line)))
            line = line[:at] + r.choice(["", "q", "zz"]) + line[at + 1 :]
        texts.append(line)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"] for x in queries.op3_line_dedup(spark, str(tmp_path)).filter("n_dropped > 0").collect()}
    raw = [t.encode() for t in texts]
    bound = lambda n: max(2, min(15, n * 5 // 100))
    near = lambda a, b: min(len(a), len(b)) >= 20 and abs(len(a) - len(b)) <= bound(min(len(a), len(b))) and _plain(a, b) <= bound(min(len(a), len(b)))
    wanted = {i for i, b in enumerate(raw) if b.strip() and any(a == b or near(a, b) for a in raw[:i])}
    few = {i for i, b in enumerate(raw) if b.strip() and any(a == b or min(len(a), len(b)) >= 20 and abs(len(a) - len(b)) <= 2 and within([a], [b], 2)[0] for a in raw[:i])}
    assert got == wanted and len(wanted - few) > 10


@pytest.mark.parametrize("part, hot_lines, lead_lines", [(2048, 1 << 40, 1 << 14), (2048, 1 << 40, 9), (7, 1 << 40, 1 << 14), (5, 40, 9)])
def test_near_lines_by_every_route(spark, frame, part, hot_lines, lead_lines):
    """Sets as they are, leads dealt to several tasks, sets cut into parts, and keys that are dealt to several buckets find the same lines."""
    r = random.Random(3)
    start, end = words(1, 4), words(2, 3)
    texts = [start + words(100 + r.randrange(30), 3) + r.choice(["", "x", "yz"]) + end for _ in range(150)]  # all share their ends
    docs = keyed_rows(frame(texts))
    with Scratch(spark) as scratch:
        got = {x["doc_id"] for x in near_lines(docs, scratch, 150, 2, 12, 0, part, hot_lines, lead_lines).collect()}
    first = {t: texts.index(t) for t in texts}
    wanted = {first[b] for b in first if any(first[a] < first[b] and a != b and _plain(a.encode(), b.encode()) <= 2 for a in first)}
    assert got == wanted and len(wanted) > 20


def test_a_family_of_near_lines_takes_a_row_a_set(spark, frame):
    r, base = random.Random(4), words(5, 40)
    texts = [base]
    for i in range(1999):
        at = r.randrange(len(base))
        texts.append(base[:at] + f"{i}" + base[at + 4 :])
    got = decisions(frame(texts), 2, 20, 1, 5).filter("n_near > 0").count()
    assert got == 1999


def test_a_family_over_many_parts_takes_rows_in_proportion(spark):
    """20 parts of one set: their pairs would be 210 groups, 4,000 lines here; nearly all lines are met beside the first part."""
    ids = list(range(400))
    parts = spark.createDataFrame([(5, k, True, ids[20 * k : 20 * k + 20]) for k in range(20)], "unit long, part long, cut boolean, ids array<long>")
    texts = spark.createDataFrame([(i, "t", (i, 0, 0)) for i in ids], "id long, text string, place struct<doc_id: long, row: long, line: int>")
    near = spark.createDataFrame([(i, 0, 0) for i in ids if i not in (0, 77, 301)], "doc_id long, row long, line int")
    first = line_dedup._beside_the_first(parts)
    assert first.count() == 20 + 19 * 40 and first.groupBy("a").count().count() == 20
    rest = line_dedup._left_to_compare(parts, texts, near, 20)
    assert rest.filter("side = 1").count() == 400 and {r["id"] for r in rest.filter("side = 0").collect()} == {0, 77, 301}
    assert line_dedup._left_to_compare(parts.filter("part < 2"), texts, near, 20).count() == 0


def test_lines_with_one_first_hash_are_both_sent():
    h1, h2 = np.array([7, 7, 3, 7], np.uint64), np.array([1, 2, 5, 1], np.int64)
    one, seen = line_dedup._new_lines(h1, h2, (h1[:0], h2[:0]))
    assert sorted(zip(h1[one].tolist(), h2[one].tolist(), strict=True)) == [(3, 5), (7, 1), (7, 2)] and (np.diff(seen[0]) >= 0).all()
    one, seen = line_dedup._new_lines(np.array([3, 4, 7], np.uint64), np.array([5, 9, 3], np.int64), seen)
    assert sorted(one.tolist()) == [1, 2] and seen[0].tolist() == [3, 4, 7, 7, 7]


def test_rows_that_share_an_id_lose_only_their_own_lines(spark):
    line = "a line that many documents hold"
    rows = [(1, line), (2, f"{line}\nrest"), (2, "only text of the second row\nunique"), (2, f"{line}\nrest"), (3, f"{line}s\nown")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in remove_repeated_lines(docs, least_equal=1).collect())
    assert got == [(1, line), (2, "only text of the second row\nunique"), (2, "rest"), (2, "rest"), (3, "own")]


def test_one_long_line_does_not_widen_the_others():
    import tracemalloc

    short, long = [(words(i, 8).encode(), words(i, 8).replace("a", "b", 1).encode()) for i in range(2000)], words(7, 220_000).encode()
    pairs = [*short, (b"x" + long, long + b"y")]
    tracemalloc.start()
    good = within([a for a, _ in pairs], [b for _, b in pairs], 2)
    assert good.all() and tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_nearest_lattice_points():
    r = np.random.default_rng(0)
    y = r.standard_normal((200, 8)) * 2
    point = nearest_e8(y)
    assert (np.abs(np.rint(2 * point) - 2 * point) < 1e-9).all()
    assert (((y - point) ** 2).sum(1) <= 1 + 1e-9).all()  # the covering radius of the lattice is 1
    for shift in np.eye(8)[:4] + np.eye(8)[4:]:
        assert (((y - point) ** 2).sum(1) <= ((y - point - shift) ** 2).sum(1) + 1e-9).all()


def test_near_duplicates_find_nearly_all_links(spark):
    r = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centres = unit(r.standard_normal((60, 64)))
    vectors = [c * r.uniform(0.5, 3) for c in centres]
    for k in range(300):
        c = centres[k % 60]
        cos = r.uniform(0.90, 0.99)
        side = r.standard_normal(64)
        side = unit(side - (side @ c) * c)
        vectors.append(cos * c + np.sqrt(1 - cos * cos) * side)
    vectors += [vectors[0]] * 5
    labels = [int(i % 60 % 2) for i in range(len(vectors))]
    rows = [(i, [float(x) for x in v], g) for i, (v, g) in enumerate(zip(vectors, labels, strict=True))]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=16).toPandas().set_index("vec_id").sort_index()
    cosine = unit(np.array(vectors)) @ unit(np.array(vectors)).T
    linked = (cosine >= 0.93) & (np.array(labels)[:, None] == np.array(labels)) & ~np.eye(len(vectors), dtype=bool)
    assert (got.n_links.to_numpy() <= linked.sum(1)).all()
    assert got.n_links.sum() >= 0.97 * linked.sum()
    low = least_reachable(len(vectors), np.argwhere(linked).tolist())
    assert (got.component_id.to_numpy() == low).mean() > 0.97
    assert (got.kept == (got.component_id == got.index)).all()


def test_invalid_vectors_link_with_nothing(spark):
    good = [1.0, 2.0]
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [float("nan"), 1.0], 0), (6, good, None), (7, good, 0), (8, good, 0), (9, good, 1), (10, [1.0, 2.0, 3.0], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (0, i) for i in (1, 2, 3, 4, 5, 6, 9, 10)} | {7: (1, 7), 8: (1, 7)}
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_a_key_makes_sets_of_lines_of_like_lengths_only():
    """Lengths 20, 22 and 24 may be near one another one by one, 40 is near none, 60 and 61 are a set of their own; 700 stands alone."""
    sizes = np.array([20, 24, 22, 40, 61, 60, 700])
    ids = np.sort(line_dedup._numbers(np.arange(7, dtype=np.int64) * 7919, sizes))
    n, key = len(ids), np.uint64(5 << 20)
    block = line_dedup._pack(np.full(n, key), ids, np.full(n, 1 + line_dedup.POST, np.uint8), np.zeros(n, np.uint8))
    columns = {"bucket": [0], "hot": pa.array([None], pa.int64()), "salt": [0], "n": [n], "block": [block]}
    lengths = lambda x: sorted(i >> line_dedup.HASHED for i in x)
    assert sorted(lengths(x) for x in line_dedup._sets(100, 2, 0)(pa.table(columns)).column("ids").to_pylist()) == [[20, 22, 24], [60, 61]]
    cut = line_dedup._sets(2, 2, 0)(pa.table(columns)).filter(pc.field("cut"))
    assert len(set(cut.column("unit").to_pylist())) == 1 and cut.column("part").to_pylist() == [0, 1]
    hot = line_dedup._sets(100, 2, 0)(pa.table(columns | {"hot": [5]})).column("ids").to_pylist()
    assert [lengths(x) for x in hot] == [sorted(sizes.tolist())]


def test_a_line_goes_once_to_the_sets_of_a_lead(spark):
    units = spark.createDataFrame([(1, u, 0, 0, 0, i) for u in range(5) for i in (7, 8)] + [(2, 9, 0, 0, 0, 7)], "lead long, unit long, a long, b long, side int, id long")
    got = {(r.lead, r.id): sorted(x.unit for x in r.sets) for r in line_dedup._sets_of_lines(units).collect()}
    assert got == {(1, 7): [0, 1, 2, 3, 4], (1, 8): [0, 1, 2, 3, 4], (2, 7): [9]}


@pytest.mark.parametrize("most_bytes", [1, 200, 1 << 24])
def test_a_lead_beyond_the_bytes_is_walked_some_sets_at_a_time(most_bytes):
    texts = [b"one line of some bytes %d" % i for i in range(10, 16)] + [b"and a line that is like none"]
    sets = [[{"unit": u, "a": 0, "b": 0, "side": 0} for u in range(3) if (i + u) % 2 or u == 0] for i in range(len(texts))]
    kind = pa.list_(pa.struct([("unit", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("side", pa.int32())]))
    rows = pa.RecordBatch.from_arrays([pa.array([1] * 7), pa.array(sets, kind), pa.array(range(7)), pa.array([0] * 7), pa.array([0] * 7, pa.int32()), pa.array(texts, pa.binary())], names=["lead", "sets", "doc_id", "row", "line", "text"])
    batches = [rows.slice(k, 3) for k in (0, 3, 6)]
    assert {d for out in line_dedup._walk(2, 0, most_bytes)(iter(batches)) for d in out.column("doc_id").to_pylist()} == {1, 2, 3, 4, 5}


def test_the_sets_of_a_family_are_compared_as_one(spark):
    """Each line goes once to a task that asks about it, however many sets of the family hold it."""
    sets = [(u, [i for i in range(40) if (i * 7 + u) % 5], True) for u in range(1, 13)]  # 12 sets of 32 of 40 lines, not all with the same least line
    sets += [(99, [500 + i for i in range(3)], False)]
    once = spark.createDataFrame([(u, ids) for u, ids, _ in sets], "unit long, ids array<long>")
    led = line_dedup._led_sets(once)
    assert {r.unit: r.lead for r in led.collect()} == {u: 0 if family else 500 for u, _, family in sets}
    rows = [r for r in line_dedup._whole_sets(led, 64).distinct().collect() if r.id < 500]
    assert len({(r.lead, r.unit) for r in rows}) == 1 and sorted(r.id for r in rows if r.side == 0) == list(range(40))
    parted = line_dedup._whole_sets(led, 16).filter("id < 500").distinct().collect()
    tasks = {r.lead for r in parted}
    assert len(tasks) == 7 and len(parted) == 7 * 40  # 40 * 40 pairs, 16 * 16 a task
    assert sorted(r.id for r in parted if r.side == 0) == list(range(40))


@pytest.mark.parametrize("length", [30, 90, 200])
def test_edit_distance_of_longer_texts_within_every_bound(length):
    r, left, right = random.Random(length), [], []
    for _ in range(150):
        text = bytes(r.choice(b"abc") for _ in range(length + r.randrange(9)))
        other = bytearray(text)
        for _ in range(r.randrange(12)):
            at, much = r.randrange(len(other)), r.choice([1, 1, 2, 5])
            other[at : at + r.choice([0, much])] = bytes(r.choice(b"abcd") for _ in range(r.choice([0, much])))
        left.append(text)
        right.append(bytes(other))
    exact = np.array([_plain(a, b) for a, b in zip(left, right, strict=True)])
    for bound in range(16):
        assert (within(left, right, bound) == (exact <= bound)).all()
    assert exact.min() < 2 and exact.max() > 15


def test_the_filter_of_lines_grows_with_them():
    assert [line_dedup.filter_words(n) // line_dedup.FILTER_WORDS for n in (0, 4_000_000, 30_000_000, 1 << 40)] == [1, 1, 8, 16]
