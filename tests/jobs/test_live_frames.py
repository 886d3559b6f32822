"""The live job over a folder that grows, against arithmetic over all that has come so far."""

import numpy as np
import pytest

from jobs import common, live_frames

SCHEMA = "image_id int, t int, c int, z int, pixels binary, note string"
DEPTH, CHANNELS = 3, 2


def plane(image, t, c, z, seed=0, size=40):
    return (image, t, c, z, np.random.default_rng([image, t, c, z, seed]).integers(0, 256, size, np.uint8).tobytes(), "x")


def job(folder, **more):
    return common.settings(
        live_frames.Settings,
        {"schema": SCHEMA, "planes": {k: k for k in ("image_id", "t", "c", "z", "pixels")}, "channels": CHANNELS, "depth": DEPTH, "saturated": 250, "images_per_block": 2, "files_at_once": 100} | more,
        input=str(folder / "in"), output=str(folder / "out"), checkpoint=str(folder / "check"),
    )


@pytest.fixture
def arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def add(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return add


def expected(planes):
    """Frames of the latest of each plane, last times that lack planes left out."""
    held = {p[:4]: p[4] for p in planes}
    out = {}
    for image, t, c in {k[:3] for k in held}:
        last = max(k[1] for k in held if k[0] == image)
        if t == last and len([k for k in held if k[:2] == (image, t)]) < CHANNELS * DEPTH:
            continue
        own = {k[3]: np.frombuffer(p, np.uint8).astype(int) for k, p in held.items() if k[:3] == (image, t, c)}
        px = np.concatenate(list(own.values()))
        edges = {z: int((np.diff(v) ** 2).sum()) for z, v in own.items()}
        ends = (int(px.min()), int(px.max())) if len(px) else (None, None)
        mean = round(px.sum() / len(px), 6) if len(px) else None
        out[image, t, c] = (len(own), len(px), int(px.sum()), *ends, int((px >= 250).sum()), mean, min(edges, key=lambda z: (-edges[z], z)), image // 2)
    return out


def got(spark, s):
    return {(r.image_id, r.t, r.c): pytest.approx(tuple(r)[3:], abs=1e-5) for r in live_frames.result(spark, s).collect()}


def whole(image, t):
    return [plane(image, t, c, z) for c in range(CHANNELS) for z in range(DEPTH)]


def test_runs_over_growing_input_take_only_what_is_new(spark, arrive, tmp_path):
    s = job(tmp_path)
    assert live_frames.run(spark, s) == {"rows_read": 0, "planes_written": 0, "rows_left_out": 0, "batches": 0}
    assert live_frames.result(spark, s).count() == 0

    first = whole(0, 0) + whole(0, 1)[:-2] + whole(1, 0) + whole(7, 0)[:-1]
    arrive(first)
    told = live_frames.run(spark, s)
    assert (told["rows_read"], told["planes_written"]) == (len(first), len(first))
    assert got(spark, s) == expected(first) and (0, 1, 0) not in expected(first)

    # planes that complete a frame, one out of order, one that comes again with other pixels, a new image, and rows that are no planes
    late = whole(0, 1)[-2:] + whole(0, 3)[:1] + [plane(1, 0, 0, 1, seed=9)] + whole(4, 2)
    arrive([*late, (None, 0, 0, 0, b"abc", "x"), (5, 0, 0, 0, None, "x")])
    told = live_frames.run(spark, s)
    assert (told["rows_read"], told["planes_written"], told["rows_left_out"]) == (len(late) + 2, len(late), 2)
    assert got(spark, s) == expected(first + late)
    assert {(0, 1, 0), (0, 1, 1), (4, 2, 0)} <= expected(first + late).keys()

    before = sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "out").rglob("*.parquet"))
    assert live_frames.run(spark, s)["batches"] == 0
    assert sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "out").rglob("*.parquet")) == before


def test_only_blocks_with_new_planes_are_made_anew(spark, arrive, tmp_path):
    s = job(tmp_path)
    arrive(whole(0, 0) + whole(8, 0))
    live_frames.run(spark, s)
    before = {p.parent.name: p.name for p in (tmp_path / "out/frames").rglob("*.parquet")}
    arrive(whole(8, 1))
    live_frames.run(spark, s)
    after = {p.parent.name: p.name for p in (tmp_path / "out/frames").rglob("*.parquet")}
    assert before["image_block=0"] == after["image_block=0"] and before["image_block=4"] != after["image_block=4"]


def test_many_batches_give_what_one_gives(spark, arrive, tmp_path):
    s, rows = job(tmp_path, files_at_once=1), []
    for k in range(4):
        part = [plane(i, t, c, z, seed=k) for i in range(3) for t in (0, k) for c in range(CHANNELS) for z in range(DEPTH) if (i + z + k) % 4]
        rows += part
        arrive(part)
    assert live_frames.run(spark, s)["batches"] == 4
    again = tmp_path / "again"
    (again).mkdir()
    (tmp_path / "in").rename(again / "in")
    assert live_frames.run(spark, job(again))["batches"] == 1
    keys = lambda x: {(r.image_id, r.t, r.c, r.n_planes) for r in live_frames.result(spark, x).collect()}
    assert keys(s) == keys(job(again)) == {(*k, v[0]) for k, v in expected(rows).items()}


def test_a_batch_that_is_repeated_after_a_failure_counts_once(spark, arrive, tmp_path, monkeypatch):
    s, rows = job(tmp_path), whole(0, 0) + whole(1, 0)
    arrive(rows)
    with monkeypatch.context() as patch:
        patch.setattr(live_frames, "frames", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="division by zero"):
            live_frames.run(spark, s)
    assert live_frames.run(spark, s)["planes_written"] == len(rows)
    assert got(spark, s) == expected(rows)
    assert spark.read.parquet(f"{s.output}/planes").count() == len(rows)


def test_odd_planes(spark, arrive, tmp_path):
    s = job(tmp_path)
    empty = [(2, 0, c, z, b"", "x") for c in range(CHANNELS) for z in range(DEPTH)]
    big = [plane(3, 0, c, z, size=300_000) for c in range(CHANNELS) for z in range(DEPTH)]
    twice = whole(5, 0) + whole(5, 0)
    arrive(empty + big + twice)
    live_frames.run(spark, s)
    assert got(spark, s) == expected(empty + big + twice)
