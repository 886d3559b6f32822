"""N-gram Jaccard join: a grouped prefix join over sets of word shingles.

Equal sets fall together first (only hashes of sets are shuffled).  Shingles
have one order for all documents: those met seldom before those met often, as far as a
bounded list of the most frequent ones tells, else by hash.  Two sets that are
similar enough share a shingle among the first few of each (the prefix), so
sets with equal prefix and size form a group, and only groups meet in the
buckets of prefix shingles, where sizes and positions rule out most pairs.

The links need not all be known for the components.  First, every group of a
crowded bucket meets the bucket's smallest group, and every member of a group
the group's smallest, which joins large families of copies by a number of pairs
in proportion to them.  Second, shared prefix shingles of all other buckets are counted by
pair of groups; only pairs with as many as the threshold demands go on.  Third
and exact: in crowded buckets and groups that still hold more than one
component, the members outside the largest meet every member of another
component, in blocks, and only pairs that size and counts allow leave a block.
Pairs are verified on the whole texts.

Defined cases: null, empty or wordless texts have an empty set, link with
nothing and are components of their own; equal ``doc_id`` rows are told apart by
nothing and count as one document only in ``component_id``; a null ``doc_id`` has
null component; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, by_ids, checkpointed, string_bytes, text_slices
from .components import components
from .shingles import mix, text_shingles
from .tokens import forget

SLICE = 1 << 19


def _sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    return text_shingles(*string_bytes(batch.column(batch.schema.get_field_index("text"))), width)


def _frequent(width: int, least: int, most: int):
    """For each task its most frequent shingles, each with the number of documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # a worker may have packed sequences before
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting: list[np.ndarray] = []
        size = 0

        def fold() -> None:
            nonlocal size
            if waiting:
                found, counts = np.unique(np.concatenate(waiting), return_counts=True)
                held.append((found[counts > 1], counts[counts > 1]))
                waiting.clear()
                size = 0

        for batch in text_slices(batches, SLICE):
            waiting.extend(_sets(batch, width))
            size = sum(map(len, waiting))
            if size > 1_000_000:
                fold()
        fold()
        if held:
            found, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([c for _, c in held]), len(found)).astype(np.int64)
            top = np.argsort(-counts, kind="stable")[:most]
            top = top[counts[top] >= least]
            yield pa.RecordBatch.from_arrays([pa.array(found[top].view(np.int64)), pa.array(counts[top])], names=["token", "n"])

    return run


def frequent_shingles(docs: DataFrame, width: int, least: int = 3, most_each: int = 4096, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """(tokens in ascending order, rank of each by frequency): at most ``most``, a bound that the list's use needs no exactness for.

    Any order of shingles gives the same links; this one only keeps buckets small.
    """
    seen = docs.select("text").mapInArrow(_frequent(width, least, most_each), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = seen.orderBy(F.desc("n"), "token").limit(most).collect()
    tokens = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.arange(len(rows), 0, -1, dtype=np.int64)[order]


def prefix_length(n: int, percent: int) -> int:
    """How many first shingles a set of ``n`` must show to meet every set similar to ``percent`` per cent."""
    return n - -(-percent * n // 100) + 1


def _signatures(width: int, percent: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        tokens, ranks = frequent.value
        for batch in text_slices(batches, SLICE):
            sets, prefixes = _sets(batch, width), []
            first, second, packed = [], [], []
            for s in sets:
                first.append(int(s.sum(dtype=np.uint64)) - (1 << 63))
                second.append(int(mix(s).sum(dtype=np.uint64)) - (1 << 63) if len(s) else 0)
                if not len(s):
                    prefixes.append(s.view(np.int64))
                    continue
                ordered = s
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    often = tokens[at] == s
                    if often.any():
                        late = s[often]
                        ordered = np.concatenate([s[~often], late[np.argsort(ranks[at[often]], kind="stable")]])
                prefixes.append(ordered[: prefix_length(len(s), percent)].view(np.int64))
            for p in prefixes:
                packed.append(int(mix(p.view(np.uint64) * np.arange(1, 2 * len(p), 2, dtype=np.uint64)).sum(dtype=np.uint64)) - (1 << 63) if len(p) else 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(packed, pa.int64()), lists],
                names=["doc_id", "n", "h1", "h2", "ph", "prefix"],
            )

    return run


def _verify(width: int, percent: int):
    """Keeps the pairs (a, b) whose texts are similar; a's text often stays the same from row to row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for batch in [whole.slice(i, 256) for i in range(0, whole.num_rows, 256)]:
                known: dict[int, np.ndarray] = {}
                for ids, texts in (("a", "text_a"), ("b", "text_b")):
                    numbers = batch.column(batch.schema.get_field_index(ids)).to_pylist()
                    new = {x: i for i, x in enumerate(numbers) if x not in known}
                    if new:
                        column = batch.column(batch.schema.get_field_index(texts)).take(pa.array(list(new.values()), pa.int32()))
                        known.update(zip(new, text_shingles(*string_bytes(column), width), strict=True))
                a, b = (batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("a", "b"))
                good = []
                for x, y in zip(a, b, strict=True):
                    s, t = known[x], known[y]
                    at = np.searchsorted(t, s) if len(t) else np.zeros(0, int)
                    common = int((t[np.minimum(at, len(t) - 1)] == s).sum()) if len(t) else 0
                    good.append(common > 0 and 100 * common >= percent * (len(s) + len(t) - common))
                keep = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(keep), pa.array(b, pa.int64()).filter(keep)], names=["u", "v"])

    return run


def _bounds(percent: int):
    """(sizes allow it, shared prefix shingles that a pair must have) of columns n_a, n_b.

    Of two prefixes one ends first in the order; that set's prefix is known in
    full against the other's, so the sets share no more than the shared prefix
    shingles and the rest of the set beyond its prefix.
    """
    n_a, n_b = F.col("n_a"), F.col("n_b")
    overlap = F.ceil((n_a + n_b) * percent / (100 + percent))
    beyond = lambda n: F.ceil(n * percent / 100) - 1
    sizes = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent
    return sizes, overlap - F.greatest(beyond(n_a), beyond(n_b))


COLUMNS = 4096


def _apart(percent: int, block: int):
    """Pairs of members of different components that one bucket cannot rule out, from blocks of its members.

    A block of outsiders (members not of the bucket's largest component) meets a
    block of all members; rows come sorted by bucket and pair of blocks.
    """

    def work(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        left, item, n, often, component, marks = rows
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        small, large = np.minimum(n[a][:, None], n[b]), np.maximum(n[a][:, None], n[b])
        total = n[a][:, None] + n[b]
        need = -(-total * percent // (100 + percent)) - (-(-large * percent // 100) - 1)
        fits = (component[a][:, None] != component[b]) & (100 * small >= percent * large) & (np.minimum(often[a][:, None], often[b]) >= need)
        if fits.any() and marks[a[0]] is not None:
            # how many crowded shingles two prefixes really share; equal marks of different ones only add to it
            known, place = np.unique(np.concatenate(marks), return_inverse=True)
            owner, common = np.repeat(np.arange(len(marks)), [len(m) for m in marks]), np.zeros(fits.shape, np.float32)
            for low in range(0, len(known), COLUMNS):  # so many different shingles at a time, whatever their number
                some = (place >= low) & (place < low + COLUMNS)
                held = np.zeros((len(marks), min(COLUMNS, len(known) - low)), np.float32)
                np.add.at(held, (owner[some], place[some] - low), 1)
                common += held[a] @ held[b].T
            fits &= common >= need
        x, y = np.nonzero(fits)
        x, y = item[a[x]], item[b[y]]
        return np.minimum(x, y), np.maximum(x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            now = now if held is None else [np.concatenate([h, c]) for h, c in zip(held, now, strict=True)]
            cut = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]) | (now[2][1:] != now[2][:-1]) | (now[3][1:] != now[3][:-1])) + 1
            edges = [0, *cut.tolist()]
            found = [work([c[x:y] for c in now[4:]]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
            held = [c[edges[-1] :] for c in now]  # the last bucket may go on in the next batch
            yield from pairs(found)
        if held is not None and len(held[0]):
            yield from pairs([work(held[4:])])

    def pairs(found) -> Iterator[pa.RecordBatch]:
        if found:
            both = np.unique(np.stack([np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])], 1).astype(np.int64), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return run


def similar_classes(docs: DataFrame, width: int = 4, percent: int = 85, crowd: int = 32, block: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Buckets of more than ``crowd`` groups are crowded: they are compared with their
    smallest group first, then in blocks of ``block`` members.
    """
    with Scratch(docs.sparkSession) as scratch:
        return _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scratch.keep, width, percent, crowd, block)


def _classes(docs: DataFrame, stored, width: int, percent: int, crowd: int, block: int) -> DataFrame:
    spark = docs.sparkSession

    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, width))
    signed = stored(docs.mapInArrow(_signatures(width, percent, frequent), "doc_id long, n long, h1 long, h2 long, ph long, prefix array<long>"), "signatures")

    # equal sets: one document stands for each; equal prefixes and sizes: one set stands for each group
    full = signed.filter("n > 0 and doc_id is not null")
    sets = stored(full.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("item"), F.first("ph").alias("ph")), "sets")
    members = stored(sets.join(sets.groupBy("n", "ph").agg(F.min("item").alias("grp")), ["n", "ph"]).select("item", "grp", "n"), "groups")
    heads = members.filter("item = grp").select(F.col("item").alias("doc_id"))
    entries = full.select("doc_id", "n", "prefix").join(heads, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("grp"), F.explode("prefix").alias("token"))
    shared = entries.groupBy("token").agg(F.count("*").alias("k"), F.min("grp").alias("hub")).filter("k > 1")
    bucketed = stored(entries.join(shared, "token").select("token", "k", "hub", "grp"), "buckets")
    few, many = bucketed.filter(F.col("k") <= crowd), bucketed.filter(F.col("k") > crowd)
    mark = F.col("token").bitwiseAND((1 << 31) - 1).cast("int")  # no more than a prefix of them in a group
    often = stored(many.groupBy("grp").agg(F.count("*").alias("often"), F.collect_list(mark).alias("marks")), "often")
    sized = members.filter("item = grp").select("grp", "n").join(often.select("grp", "often"), "grp", "left").select("grp", "n", F.coalesce("often", F.lit(0)).alias("often"))

    def verified(pairs: DataFrame) -> DataFrame:
        texts = by_ids(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), "left_semi").dropDuplicates(["doc_id"])
        with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        both = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        with arrow_rows(spark, 1000):
            return checkpointed(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(width, percent), "u long, v long"))

    def end_sizes(pairs: DataFrame) -> DataFrame:
        """Pairs of groups with the size of both and how many of their prefix shingles are crowded."""
        a, b = (sized.select(F.col("grp").alias(x), F.col("n").alias(f"n_{x}"), F.col("often").alias(f"often_{x}")) for x in "ab")
        return pairs.join(a, "a").join(b, "b")

    fits, need = _bounds(percent)
    # one: the smallest group of each crowded bucket with the others, the head of each group with its members
    stars = many.filter("grp <> hub").select(F.col("hub").alias("a"), F.col("grp").alias("b")).distinct()
    inside = members.filter("item <> grp").select(F.col("grp").alias("a"), F.col("item").alias("b"))
    tried = checkpointed(end_sizes(stars).filter(fits & (F.least("often_a", "often_b") + crowd >= need)).select("a", "b").union(inside))
    links = verified(tried)

    # two: the pairs of groups that share enough shingles, counted over the buckets that are not crowded
    mine, other = few.select("token", F.col("grp").alias("a")), few.select("token", F.col("grp").alias("b"))
    counted = mine.join(other, "token").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    close = end_sizes(counted).filter(fits & (F.col("c") + F.least("often_a", "often_b") >= need)).select("a", "b")
    by_group = members.select("grp", "item")
    spread = close.join(by_group.select(F.col("grp").alias("a"), F.col("item").alias("x")), "a").join(by_group.select(F.col("grp").alias("b"), F.col("item").alias("y")), "b")
    labels = checkpointed(components(links))
    named = lambda old: labels.select(F.col("node").alias(old), F.col("component").alias(f"{old}_component"))
    open_pairs = spread.join(named("x"), "x", "left").join(named("y"), "y", "left").filter(F.coalesce("x_component", "x") != F.coalesce("y_component", "y"))
    fresh = checkpointed(open_pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
    labels = _joined(labels, verified(fresh))

    # three: what is still apart within crowded buckets and within groups, block by block
    placed = checkpointed(members.join(labels.select(F.col("node").alias("item"), "component"), "item", "left").join(often.drop("marks"), "grp", "left").select("item", "grp", "n", F.coalesce("often", F.lit(0)).cast("long").alias("often"), F.coalesce("component", "item").alias("component")))
    crowded = many.select("token", "grp").join(placed, "grp").select(F.col("token").alias("key"), F.lit(0).alias("kind"), "item", "grp", "n", "often", "component")
    # members of one group share their whole prefix, so nothing but their sizes counts
    in_groups = placed.select(F.col("grp").alias("key"), F.lit(1).alias("kind"), "item", F.lit(None).cast("long").alias("grp"), "n", F.lit(1 << 40).alias("often"), "component")
    rows = stored(crowded.union(in_groups), "crowded")
    sizes = rows.groupBy("key", "kind", "component").agg(F.count("*").alias("size"))
    kept = sizes.groupBy("key", "kind").agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.sum("size").alias("all"), F.max("size").alias("most")).filter("all > most")
    # marks come in where a bucket still holds several components: a row of it has a whole prefix of them
    dealt = rows.join(kept, ["key", "kind"]).join(often.select("grp", "marks"), "grp", "left").withColumn("outside", F.col("component") != F.col("largest"))
    part = lambda count: F.pmod(F.xxhash64("item"), F.ceil(F.col(count) / block)).cast("int")
    dealt = dealt.withColumn("few", F.col("all") - F.col("most"))
    count_of = lambda count: F.sequence(F.lit(0), F.ceil(F.col(count) / block).cast("int") - 1)
    ours = dealt.filter("outside").select("key", "kind", part("few").alias("i"), F.explode(count_of("all")).alias("j"), F.lit(True).alias("left"), "item", "n", "often", "component", "marks")
    theirs = dealt.select("key", "kind", F.explode(count_of("few")).alias("i"), part("all").alias("j"), F.lit(False).alias("left"), "item", "n", "often", "component", "marks")
    by = ["key", "kind", "i", "j"]
    possible = ours.union(theirs).repartition(*by).sortWithinPartitions(*by).mapInArrow(_apart(percent, block), "a long, b long").distinct()
    last = checkpointed(possible.join(tried, ["a", "b"], "left_anti").join(fresh, ["a", "b"], "left_anti"))
    labels = _joined(labels, verified(last))

    items = sets.select("n", "h1", "h2", "item").join(labels.select(F.col("node").alias("item"), "component"), "item", "left").select("n", "h1", "h2", F.coalesce("component", "item").alias("component"))
    return checkpointed(signed.select("doc_id", "n", "h1", "h2").join(items, ["n", "h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links."""
    if links.isEmpty():
        return labels
    return checkpointed(components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links)))


def keep_one(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component.

    Of rows with one ``doc_id``, or with none, those with equal texts stay once (any of them); a text without an id is
    compared with no other.
    """
    classes = similar_classes(docs, width, percent)
    kept = by_ids(docs, classes.filter("component_id <> doc_id"), "left_anti").select(docs.columns)
    again = checkpointed(kept.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    twice = by_ids(kept.filter("doc_id is not null"), again, "left_semi").select(docs.columns).unionByName(kept.filter("doc_id is null"))
    once = by_ids(kept.filter("doc_id is not null"), again, "left_anti").select(docs.columns)
    return once.unionByName(twice.dropDuplicates(["doc_id", "text"]))
