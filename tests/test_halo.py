"""Stencils, labels and growth by blocks: the same as over the whole volume, for every size of block."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from obliqua.operators import filters, halo, labels
from obliqua.sources.volume import KEYS
from tests.test_operators import dense, frame

SHAPE = (9, 11, 10)
RAW = np.where(np.random.default_rng(8).random(SHAPE) < 0.5, np.random.default_rng(9).integers(1, 90, SHAPE), 0).astype(float)
SIZES = [(2, 3, 4), (4, 4, 4), (1, 20, 3), (64, 128, 128)]


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("sigma", [0.6, 1.4])
def test_gaussian(spark, size, sigma):
    weights = filters.gaussian_weights(sigma)
    want = RAW
    for axis in range(3):
        want = np.apply_along_axis(lambda line: np.convolve(np.pad(line, len(weights) // 2), weights, "valid"), axis, want)
    made = filters.gaussian(frame(spark, RAW).repartition(3), sigma, SHAPE, size)
    assert np.allclose(dense(made, SHAPE), want) and made.count() == made.select("z", "y", "x").distinct().count()


def test_gaussian_tells_the_places_in_reach_only(spark):
    one = np.zeros((40, 9, 9))
    one[20, 4, 4] = 1
    got = filters.gaussian(frame(spark, one), 1.0, one.shape, (7, 5, 5))
    assert got.count() == 9 * 9 * 9 and got.agg(F.min("z"), F.max("z")).first() == (16, 24)


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("radius", [1, 2])
def test_median(spark, size, radius, monkeypatch):
    monkeypatch.setattr(filters, "MOST_NEIGHBOURS", 2000)
    ball = [d for d in itertools.product(range(-radius, radius + 1), repeat=3) if sum(k * k for k in d) <= radius * radius]
    wide = np.pad(RAW, radius)
    near = np.stack([wide[tuple(slice(radius + d, radius + d + n) for d, n in zip(o, SHAPE, strict=True))] for o in ball])
    want = np.sort(near, 0)[::-1][len(ball) // 2]
    assert (dense(filters.median(frame(spark, RAW), radius, SHAPE, size), SHAPE) == want).all()


def test_a_wide_stencil_sends_voxels_little_more_than_once(spark):
    voxels = spark.range(64 * 64 * 256).select(F.lit(0).alias("image_id"), F.lit(0).alias("t"), F.lit(0).alias("c"), (F.col("id") / 16384).cast("int").alias("z"), ((F.col("id") / 256) % 64).cast("int").alias("y"), (F.col("id") % 256).cast("int").alias("x"), F.lit(1.0).alias("v"))
    sent = halo.block_packed(voxels, (5, 5, 5), halo.SIZE, (128, 256, 256)).agg(F.sum(F.size("vs")), F.count("*")).first()
    assert sent[0] <= 1.5 * 64 * 64 * 256 and sent[1] <= 100


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("share", [0.1, 0.25, 0.6])
def test_labels_are_those_of_the_whole_volume(spark, size, share):
    mask = np.random.default_rng(int(100 * share)).random(SHAPE) < share
    got = dense(labels.label_blocks(frame(spark, mask.astype(float)).repartition(4), size).withColumn("v", F.col("label")), SHAPE)
    assert (got == labels.label_array(mask)).all()


def test_a_part_across_eight_blocks_and_a_long_chain(spark):
    mask = np.zeros((8, 8, 8), bool)
    mask[3:5, 3:5, 3:5] = True
    found = labels.label_blocks(frame(spark, mask.astype(float)), (4, 4, 4))
    assert {r.label for r in found.collect()} == {1} and found.count() == 8
    snake = np.zeros((1, 13, 40), bool)
    snake[0, ::2] = True
    snake[0, 1::4, -1] = snake[0, 3::4, 0] = True
    apart = np.zeros((1, 13, 40), bool)
    apart[0, ::3] = True
    both = frame(spark, snake.astype(float), t=1).unionByName(frame(spark, apart.astype(float), c=1))
    got = labels.label_blocks(both, (1, 2, 3)).groupBy(*KEYS).agg(F.countDistinct("label").alias("n"), F.max("label").alias("top")).collect()
    assert {(r.t, r.c): (r.n, r.top) for r in got} == {(1, 0): (1, 1), (0, 1): (5, 5)}


def test_no_voxels_no_labels(spark):
    assert labels.label_blocks(frame(spark, np.zeros(SHAPE))).count() == 0
    assert filters.gaussian(frame(spark, np.zeros(SHAPE)), 1.0, SHAPE).count() == 0


def grown(seeds, mask):
    """Step by step over the whole volume."""
    out = np.where(mask, seeds, 0)
    while True:
        wide = np.pad(out, 1)
        near = np.maximum.reduce([wide[1 + a : 1 + a + SHAPE[0], 1 + b : 1 + b + SHAPE[1], 1 + c : 1 + c + SHAPE[2]] for a, b, c in labels.AROUND])
        new = np.where(mask & (out == 0), near, out)
        if (new == out).all():
            return out
        out = new


@pytest.mark.parametrize("size", SIZES[:2])
def test_growth_over_borders(spark, size, monkeypatch):
    monkeypatch.setattr(labels, "STEPS", 2)
    mask = np.random.default_rng(2).random(SHAPE) < 0.45
    seeds = np.zeros(SHAPE)
    for k, p in enumerate(np.argwhere(mask)[:: mask.sum() // 5], 1):
        seeds[tuple(p)] = k
    made = labels.grow(frame(spark, seeds).withColumn("label", F.col("v").cast("long")), frame(spark, mask.astype(float)), SHAPE, size)
    assert (dense(made.withColumn("v", F.col("label")), SHAPE) == grown(seeds, mask)).all()


@pytest.mark.parametrize("size", [(3, 4, 5), (64, 128, 128)])
def test_seeded_parts_are_split_between_their_maxima(spark, size):
    z, y, x = np.indices(SHAPE)
    two = sum(100 * np.exp(-((z - 4) ** 2 + (y - 5) ** 2 + (x - m) ** 2) / 6) for m in (2, 7))
    image = np.where(two > 10, two, 0)
    made = filters.seeded_components(frame(spark, image), SHAPE, 1.0, 20.0, size=size)
    got = dense(made.withColumn("v", F.col("label")), SHAPE)
    assert set(np.unique(got)) == {0, 1, 2} and ((got > 0) == (image >= 20)).all()
    assert (got[4, 5, :5][got[4, 5, :5] > 0] == 1).all() and (got[4, 5, 5:][got[4, 5, 5:] > 0] == 2).all()
    level = filters.otsu(frame(spark, image), image.size).first()["threshold"]
    own = filters.seeded_components(frame(spark, image), SHAPE, 1.0, size=size)
    assert own.count() == (image >= level).sum()
    blurred = filters.seeded_components(frame(spark, image), SHAPE, 1.0, 20.0, outline_sigma=1.0, size=size)
    smooth = dense(filters.gaussian(frame(spark, image), 1.0, SHAPE), SHAPE)
    assert blurred.count() == (smooth >= 20).sum()
