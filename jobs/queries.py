"""The jobs as registered queries: each runs its job twice into a folder of its own and returns the output.

The SQL for DuckDB works the same tables out in one go: it gathers where the operators scatter, and knows no blocks or batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from obliqua.queries import _shear_sql, lit

from . import live_frames, region_growth
from .common import new_folder, settings, shipped


def job1_region_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = settings(region_growth.Settings, shipped("region_growth"), input=f"{sf_dir}/lineitem.parquet", regions=f"{sf_dir}/nation.parquet", output=new_folder(spark, "job1"))
    for _ in range(2):
        region_growth.run(spark, s)
    return region_growth.result(spark, s)


def job2_live_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job2")
    s = settings(live_frames.Settings, shipped("live_frames"), input=f"{sf_dir}/documents*.parquet", output=f"{folder}/out", checkpoint=f"{folder}/checkpoint")
    for _ in range(2):
        live_frames.run(spark, s)
    return live_frames.result(spark, s)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_region_growth, job2_live_frames)}


def _growth_sql() -> str:
    s = settings(region_growth.Settings, shipped("region_growth"), input="", regions="", output="")
    a = s.acquisition
    (dz, dy, dx), (z0, z1) = (a.new_dz, *s.pixel_sizes[1:]), s.z_range
    n = (z1 - z0) * 12 * 12
    return f"""WITH raw AS (SELECT CAST(l_orderkey // 4000 AS INT) AS image_id, CAST(l_linenumber % 4 AS INT) AS t, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS c, CAST(l_orderkey % 24 AS INT) AS z, CAST(l_partkey % 40 AS INT) AS y, CAST(l_suppkey % 32 AS INT) AS x,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6), {_shear_sql(a)},
      b AS (SELECT n_nationkey AS roi_index, (n_nationkey * 3) % 40 AS y0, (n_nationkey * 5) % 16 AS x0 FROM nation),
      cut AS (SELECT image_id, t, c, CAST(roi_index AS INT) AS roi_index, z - {z0} AS z, y - y0 AS y, x - x0 AS x, round(v, 6) AS v FROM made JOIN b ON z >= {z0} AND z < {z1} AND y >= y0 AND y < y0 + 12 AND x >= x0 AND x < x0 + 12 WHERE round(v, 6) > 0),
      m AS (SELECT image_id, t, c, roi_index, max(v) AS top, count(*) AS known FROM cut GROUP BY ALL),
      bins AS (SELECT image_id, t, c, roi_index, top, CAST(least(floor(v * 256 / top), 255) AS INT) AS bin, 1 AS n FROM cut JOIN m USING (image_id, t, c, roi_index) UNION ALL SELECT image_id, t, c, roi_index, top, 0, {n} - known FROM m),
      h AS (SELECT image_id, t, c, roi_index, top, bin, (bin + CAST(0.5 AS DOUBLE)) * top / 256 AS mid, CAST(sum(n) AS DOUBLE) AS n FROM bins GROUP BY image_id, t, c, roi_index, top, bin),
      w AS (SELECT *, sum(n) OVER u AS w0, sum(n * mid) OVER u AS s0, sum(n) OVER p AS w, sum(n * mid) OVER p AS s FROM h WINDOW u AS (PARTITION BY image_id, t, c, roi_index ORDER BY bin), p AS (PARTITION BY image_id, t, c, roi_index)),
      q AS (SELECT *, round(w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)), 3) AS spread FROM w WHERE w > w0 AND w0 > 0),
      o AS (SELECT image_id, t, c, roi_index, mid AS threshold FROM q QUALIFY row_number() OVER (PARTITION BY image_id, t, c, roi_index ORDER BY spread DESC, bin) = 1),
      f AS (SELECT image_id, t, c, roi_index, threshold, count(*) AS area, avg(z) * {lit(dz)} AS zu, avg(y) * {lit(dy)} AS yu, avg(x) * {lit(dx)} AS xu, avg(v) AS mean FROM cut JOIN o USING (image_id, t, c, roi_index) WHERE v >= threshold GROUP BY ALL),
      d AS (SELECT *, area - lag(area) OVER k AS grown, sqrt(pow(zu - lag(zu) OVER k, 2) + pow(yu - lag(yu) OVER k, 2) + pow(xu - lag(xu) OVER k, 2)) AS moved FROM f WINDOW k AS (PARTITION BY image_id, c, roi_index ORDER BY t))
      SELECT image_id, t, c, roi_index, round(threshold, 6) AS threshold, CAST(area AS BIGINT) AS area, round(area * {lit(dz)} * {lit(dy)} * {lit(dx)}, 6) AS volume_um3, round(zu, 6) AS z_um, round(yu, 6) AS y_um, round(xu, 6) AS x_um,
        round(mean, 3) AS intensity_mean, CAST(grown AS BIGINT) AS grown, round(moved, 6) AS moved_um, CAST(image_id // {s.images_per_block} AS INT) AS image_block FROM d"""


def _frames_sql() -> str:
    s = settings(live_frames.Settings, shipped("live_frames"), input="", output="", checkpoint="")
    return f"""WITH p AS (SELECT CAST(doc_id // 64 AS INT) AS image_id, CAST(doc_id % 64 // 16 AS INT) AS t, CAST(doc_id % 16 // 8 AS INT) AS c, CAST(doc_id % 8 AS INT) AS z, strlen(text) AS n, hex(encode(text)) AS x FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
      b AS (SELECT image_id, t, c, z, n, list_transform(range(n), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)) AS px FROM p),
      e AS (SELECT image_id, t, c, z, n, list_sum(px) AS total, list_min(px) AS least, list_max(px) AS brightest, len(list_filter(px, lambda v: v >= {s.saturated})) AS saturated, coalesce(list_sum(list_transform(range(1, n), lambda i: (px[i + 1] - px[i]) * (px[i + 1] - px[i]))), 0) AS edges FROM b),
      l AS (SELECT image_id, max(t) AS t FROM e GROUP BY 1),
      bad AS (SELECT image_id, t FROM l JOIN e USING (image_id, t) GROUP BY 1, 2 HAVING count(*) < {s.channels * s.depth}),
      k AS (SELECT e.* FROM e LEFT JOIN bad USING (image_id, t) WHERE bad.t IS NULL)
      SELECT image_id, t, c, count(*) AS n_planes, CAST(sum(n) AS BIGINT) AS n_pixels, CAST(coalesce(sum(total), 0) AS BIGINT) AS total, CAST(min(least) AS INT) AS least, CAST(max(brightest) AS INT) AS brightest, CAST(sum(saturated) AS BIGINT) AS saturated,
        CASE WHEN sum(n) > 0 THEN round(CAST(sum(total) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) END AS intensity_mean, CAST(arg_min(z, {{'a': -edges, 'b': z}}) AS INT) AS sharpest_z, CAST(image_id // {s.images_per_block} AS INT) AS image_block FROM k GROUP BY image_id, t, c"""


def oracle_sql() -> dict[str, str]:
    return {"job1_region_growth": _growth_sql(), "job2_live_frames": _frames_sql()}
