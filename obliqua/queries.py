"""Registered queries of the imaging operators, with the SQL that DuckDB checks them by.

The driver's tables hold no images, so a volume of fixed size is derived from
``lineitem`` and regions from ``nation``; both sides build them alike.  The SQL
gathers (output grid, four taps, join) where the operators scatter, so the two
ways of computing check each other.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns, dtypes
from .functions.geometry import Acquisition, Box, crop_plan, region_box
from .operators import crop as cropping
from .operators import decon, estimate, filters, labels, mip, rois
from .operators.deskew import deskew
from .plans.workflow import Workflow, run_workflow
from .sources import images, naming, volume

NZ, NY, NX = 24, 40, 32
DZ, DY, DX = 2.0, 1.04, 1.04
SHEAR_Y = Acquisition(NZ, NY, NX, DZ, DY, DX, 45.0, "Y", "shear")
SHEAR_X = Acquisition(NZ, NY, NX, DZ, DY, DX, 45.0, "X", "shear")
OBJECTIVE_Y = Acquisition(NZ, NY, NX, DZ, DY, DX, 30.0, "Y", "objective")
OBJECTIVE_X = Acquisition(NZ, NY, NX, DZ, DY, DX, 30.0, "X", "objective")
ISOTROPIC = Acquisition(NZ, NY, NX, 1.0, 1.0, 1.0, 30.0, "Y", "objective")
CROPS = {0: Box((2, 10), (20, 40), (4, 16)), 1: Box((0, 6), (5, 25), (10, 30)), 2: Box((3, 8), (30, 44), (0, 12))}

RAW_SQL = """SELECT CAST(0 AS INT) AS image_id, CAST(l_linenumber % 2 AS INT) AS t, CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS INT) AS c,
  CAST(l_orderkey % 24 AS INT) AS z, CAST(l_partkey % 40 AS INT) AS y, CAST(l_suppkey % 32 AS INT) AS x, CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS v
  FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6"""
ROIS_SQL = """SELECT CAST(n_nationkey AS INT) AS roi_index, CAST((n_nationkey * 3) % 40 AS DOUBLE) AS "top", CAST((n_nationkey * 5) % 16 AS DOUBLE) AS "left",
  CAST((n_nationkey * 3) % 40 + 12 AS DOUBLE) AS bottom, CAST((n_nationkey * 5) % 16 + 12 AS DOUBLE) AS "right" FROM nation"""

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(query: Query) -> Query:
        _QUERIES[query.__name__] = query
        if sql is not None:
            _SQL[query.__name__] = sql
        return query

    return add


def lit(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def term(a: Acquisition, name: str) -> str:
    """A constant of the geometry, from the angle and the voxel sizes alone."""
    turned, step = f"radians({lit(a.angle)})", f"({lit(a.dz)} / {lit(a.dy if a.skew == 'Y' else a.dx)})"
    return {"sin": f"sin({turned})", "cos": f"cos({turned})", "tan": f"tan({turned})", "step": step, "rise": f"(sin({turned}) * {step})", "run": f"(cos({turned}) * {step})"}[name]


def extent(a: Acquisition, name: str) -> str:
    """The depth or the lateral size of the deskewed volume: in the shear frame as far as the last voxel, else as far apart as the turned corners."""
    n = a.ny if a.skew == "Y" else a.nx
    if a.frame == "shear":
        size = f"ceil({a.nz - 1} * {term(a, 'rise')})" if name == "depth" else f"ceil({a.nz - 1} * {term(a, 'run')} + {n - 1})"
        return f"CAST({size} + 1 AS BIGINT)"
    scale, lean = f"({term(a, 'sin')} * {term(a, 'step')})", f"(sin(radians({lit(90 - a.angle)})) * {term(a, 'step')})"
    p, q = (f"(cos(radians({lit(a.angle)})) * {scale} - {term(a, 'sin')} * {lean})", f"(-{term(a, 'sin')})") if name == "depth" else (f"({term(a, 'sin')} * {scale} + {term(a, 'cos')} * {lean})", term(a, "cos"))
    corners = f"0, {p} * {a.nz}, {q} * {n}, {p} * {a.nz} + {q} * {n}"
    return f"CAST(round_even(greatest({corners}) - least({corners}), 0) AS BIGINT)"


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet")


def raw_volume(spark: SparkSession, d: str) -> DataFrame:
    """The voxels of both times and channels; the columns that it needs of ``lineitem`` are six."""
    made = lineitem(spark, d).select(
        F.lit(0).alias("image_id"),
        (F.col("l_linenumber") % 2).cast("int").alias("t"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("c"),
        (F.col("l_orderkey") % NZ).cast("int").alias("z"),
        (F.col("l_partkey") % NY).cast("int").alias("y"),
        (F.col("l_suppkey") % NX).cast("int").alias("x"),
        F.col("l_quantity").cast("long").alias("q"),
    )
    return made.groupBy("image_id", "t", "c", "z", "y", "x").agg(F.sum("q").cast("double").alias("v"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    top, left = (n * 3) % 40, (n * 5) % 16
    return spark.read.parquet(f"{d}/nation.parquet").select(n.cast("int").alias("roi_index"), top.cast("double").alias("top"), left.cast("double").alias("left"), (top + 12).cast("double").alias("bottom"), (left + 12).cast("double").alias("right"))


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Sums in another order differ in their last bits; -0.0 becomes 0.0."""
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


def with_raw(sql: str) -> str:
    return f"WITH raw AS ({RAW_SQL}) {sql}"


# Sources and selections


@register(with_raw("SELECT image_id, t, c, z, y, x, v FROM raw"))
def volume_normalised(spark, d):
    return volume.normalise(raw_volume(spark, d).drop("image_id"))


@register("SELECT CAST(n_regionkey AS INT) AS image_id, n_name AS scene_key, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS INT) AS scene_index FROM nation")
def scene_mapping(spark, d):
    return volume.scene_numbers(spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_regionkey").cast("int").alias("image_id"), F.col("n_name").alias("scene_key")))


@register("SELECT n AS channel_name FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'Channel:0:' || CAST(n_nationkey AS VARCHAR) ELSE n_name END AS n FROM nation) WHERE NOT regexp_full_match(n, 'Channel:[0-9]+:[0-9]+')")
def channel_names(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Channel:0:"), F.col("n_nationkey").cast("string"))).otherwise(F.col("n_name"))
    return volume.named_channels(n.select(name.alias("channel_name")))


@register(with_raw("SELECT c, t, count(*) AS n, sum(v) AS total FROM (SELECT t, c, v FROM raw WHERE z < 12 UNION ALL SELECT t + 2, c, v FROM raw WHERE z >= 12) GROUP BY 1, 2"))
def stacked_layers(spark, d):
    raw = raw_volume(spark, d)
    return volume.stack([raw.filter("z < 12"), raw.filter("z >= 12")], "t").groupBy("c", "t").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@register(with_raw(f""", cut AS (SELECT * FROM raw WHERE image_id = 0 AND NOT (t = 1 AND c = 1 AND z = 7) UNION ALL SELECT 1, t, c, z, y, x, v FROM raw),
  last AS (SELECT image_id, max(t) AS t FROM cut GROUP BY 1),
  bad AS (SELECT image_id, t FROM last JOIN cut USING (image_id, t) GROUP BY 1, 2 HAVING count(DISTINCT c * {NZ} + z) < 2 * {NZ})
  SELECT r.* FROM cut r LEFT JOIN bad b USING (image_id, t) WHERE b.t IS NULL"""))
def complete_frames(spark, d):
    """One image lacks a plane of its last time, the other none."""
    raw = raw_volume(spark, d)
    whole = raw.withColumn("image_id", F.lit(1).cast("int"))
    return volume.complete_frames(raw.filter("not (t = 1 and c = 1 and z = 7)").unionByName(whole), 2, NZ)


@register(with_raw("SELECT * FROM raw WHERE t >= 0 AND t < 1"))
def time_range(spark, d):
    return volume.select(raw_volume(spark, d), times=volume.span((0, 1), 2))


@register(with_raw("SELECT * FROM raw WHERE c >= 1 AND c < 2"))
def channel_range(spark, d):
    return volume.select(raw_volume(spark, d), channels=volume.span((1, 2), 2))


@register(with_raw("SELECT * FROM raw WHERE t = 1 AND c = 0"))
def one_slice(spark, d):
    return volume.one_slice(raw_volume(spark, d), 1, 0, 2, 2)


@register(with_raw(f"SELECT image_id, t, c, CAST({NZ - 1} - z AS INT) AS z, y, x, v FROM raw"))
def scan_flip(spark, d):
    return volume.flip_scan(raw_volume(spark, d), NZ)


@register(with_raw("SELECT * FROM raw WHERE z >= 3 AND z < 9 AND y >= 5 AND y < 20 AND x >= 8 AND x < 30"))
def raw_block(spark, d):
    return volume.block(raw_volume(spark, d), Box((3, 9), (5, 20), (8, 30)))


@register(with_raw("SELECT image_id, t, c, z, y, x, v FROM raw WHERE v <> 0"))
def rows_round_trip(spark, d):
    return volume.from_rows(volume.to_rows(raw_volume(spark, d), NX))


# Regions


@register(f"WITH r AS ({ROIS_SQL}), v AS (SELECT roi_index * 4 + k AS row_id, 100 - roi_index AS index, CASE WHEN k < 2 THEN \"top\" ELSE bottom END AS a0, CASE WHEN k % 2 = 0 THEN \"left\" ELSE \"right\" END AS a1 FROM r, (SELECT unnest([0, 1, 2, 3]) AS k)) SELECT CAST(row_number() OVER (ORDER BY min(row_id)) - 1 AS INT) AS roi_index, min(a0) AS \"top\", min(a1) AS \"left\", max(a0) AS bottom, max(a1) AS \"right\" FROM v GROUP BY index")
def shapes_boxes(spark, d):
    k = F.col("k")
    corners = regions(spark, d).withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    vertices = corners.select((F.col("roi_index") * 4 + k).alias("row_id"), (100 - F.col("roi_index")).alias("index"), F.when(k < 2, F.col("top")).otherwise(F.col("bottom")).alias("a0"), F.when(k % 2 == 0, F.col("left")).otherwise(F.col("right")).alias("a1"))
    return rois.shapes_boxes(vertices)


@register(f"WITH r AS ({ROIS_SQL}) SELECT * FROM r WHERE roi_index IN (2, 5, 7)")
def roi_subset(spark, d):
    return rois.subset(regions(spark, d), "2,5,7", 25)


@register(f"WITH r AS ({ROIS_SQL}) SELECT roi_index, \"top\" / {lit(DY)} AS \"top\", \"left\" / {lit(DY)} AS \"left\", bottom / {lit(DY)} AS bottom, \"right\" / {lit(DY)} AS \"right\" FROM r")
def rois_in_pixels(spark, d):
    return rois.in_pixels(regions(spark, d), DY)


@register(f"WITH r AS ({ROIS_SQL}) SELECT roi_index, \"top\" * {lit(DY)} AS \"top\", \"left\" * {lit(DY)} AS \"left\", bottom * {lit(DY)} AS bottom, \"right\" * {lit(DY)} AS \"right\" FROM r")
def rois_in_microns(spark, d):
    return rois.in_microns(regions(spark, d), DY)


@register("SELECT path, CASE WHEN lower(path) LIKE '%.csv' THEN 'Microns' ELSE 'Pixels' END AS units FROM (SELECT n_name || CASE WHEN n_nationkey % 3 = 0 THEN '.CSV' WHEN n_nationkey % 3 = 1 THEN '.csv' ELSE '.zip' END AS path FROM nation)")
def roi_units(spark, d):
    k = F.col("n_nationkey") % 3
    files = spark.read.parquet(f"{d}/nation.parquet").select(F.concat("n_name", F.when(k == 0, ".CSV").when(k == 1, ".csv").otherwise(".zip")).alias("path"))
    return files.select("path", rois.units_column(F.col("path")).alias("units"))


@register(f"WITH r AS ({ROIS_SQL}) SELECT roi_index FROM r WHERE bottom > 40 OR \"right\" > 26 OR \"top\" < 0 OR \"left\" < 0")
def rois_outside(spark, d):
    return rois.outside(regions(spark, d), 40, 26)


@register(f"WITH r AS ({ROIS_SQL}), s AS (SELECT roi_index, \"top\" / {lit(DY)} - 1 AS a, \"left\" / {lit(DY)} AS b, bottom / {lit(DY)} - 1 AS p, \"right\" / {lit(DY)} AS q FROM r) SELECT roi_index, CAST(greatest(round_even(a, 0), 0) AS INT) AS y0, CAST(greatest(round_even(p, 0), 0) AS INT) AS y1, CAST(greatest(round_even(b, 0), 0) AS INT) AS x0, CAST(greatest(round_even(q, 0), 0) AS INT) AS x1 FROM s")
def roi_pixel_boxes(spark, d):
    moved = rois.in_pixels(regions(spark, d), DY).withColumns({"top": F.col("top") - 1, "bottom": F.col("bottom") - 1})
    return rois.pixel_boxes(moved)


@register(f"WITH r AS ({ROIS_SQL}), s AS (SELECT DISTINCT t, c FROM ({RAW_SQL})) SELECT roi_index, t, c, CAST(dense_rank() OVER (PARTITION BY roi_index ORDER BY t) - 1 AS INT) AS time_index, CAST(dense_rank() OVER (PARTITION BY roi_index ORDER BY c) - 1 AS INT) AS channel_index FROM r, s")
def roi_iteration(spark, d):
    return rois.iteration(regions(spark, d), raw_volume(spark, d).select("t", "c").distinct())


# Geometry as columns


def _forward_sql(a: Acquisition) -> str:
    lat, other = a.lateral, a.other
    if a.frame == "shear":
        depth, moved = f"{term(a, "rise")} * z", f"{term(a, "run")} * z + {lat}"
    else:
        depth, moved = f"{a.n_lateral} * {term(a, "sin")} - {term(a, "sin")} * {lat}", f"{term(a, "step")} * z + {term(a, "cos")} * {lat}"
    return f"SELECT z, y, x, round({depth}, 9) + 0.0 AS zc, round({moved}, 9) + 0.0 AS lc, CAST({other} AS DOUBLE) AS oc FROM (SELECT DISTINCT z, y, x FROM raw)"


def _forward(spark, d, a: Acquisition) -> DataFrame:
    """The map of places as columns: a preview of the deskewed volume without a pixel."""
    lat = F.col(a.lateral)
    if a.frame == "shear":
        depth, moved = F.lit(a.rise) * F.col("z"), F.lit(a.run) * F.col("z") + lat
    else:
        depth, moved = F.lit(a.n_lateral * a.sin) - F.lit(a.sin) * lat, F.lit(a.step) * F.col("z") + F.lit(a.cos) * lat
    return raw_volume(spark, d).select("z", "y", "x").distinct().select("z", "y", "x", (F.round(depth, 9) + F.lit(0.0)).alias("zc"), (F.round(moved, 9) + F.lit(0.0)).alias("lc"), F.col(a.other).cast("double").alias("oc"))


for _name, _a in (("shear_y", SHEAR_Y), ("shear_x", SHEAR_X), ("objective_y", OBJECTIVE_Y), ("objective_x", OBJECTIVE_X)):
    _QUERIES[f"forward_map_{_name}"] = lambda spark, d, a=_a: _forward(spark, d, a)
    _SQL[f"forward_map_{_name}"] = with_raw(_forward_sql(_a))


@register(f"SELECT z, lc, round(z / {term(SHEAR_Y, "rise")}, 9) AS scan, round(lc - z / {term(SHEAR_Y, "tan")}, 9) + 0.0 AS lateral FROM (SELECT CAST(n_nationkey AS INT) AS z, CAST(n_regionkey AS INT) AS lc FROM nation)")
def inverse_map_shear(spark, d):
    places = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("z"), F.col("n_regionkey").cast("int").alias("lc"))
    return places.select("z", "lc", F.round(F.col("z") / F.lit(SHEAR_Y.rise), 9).alias("scan"), (F.round(F.col("lc") - F.col("z") / F.lit(SHEAR_Y.tan), 9) + F.lit(0.0)).alias("lateral"))


# Acquisitions of many sizes, voxels and angles, one for each part: the catalogue that sizes and estimates are made for.
ACQUISITIONS_SQL = """SELECT p_partkey, CAST(5 + p_size AS INT) AS nz, CAST(8 + p_partkey % 40 AS INT) AS ny, CAST(6 + p_partkey % 37 AS INT) AS nx, CAST(3 + p_partkey % 7 AS DOUBLE) / 10 AS dz, CAST(10 + p_partkey % 3 AS DOUBLE) / 64 AS dy, CAST(10 + p_partkey % 4 AS DOUBLE) / 64 AS dx,
  CAST(25 + (p_partkey % 9) * 5 AS DOUBLE) + CAST(p_partkey % 4 AS DOUBLE) / 4 AS angle, CASE WHEN p_partkey % 2 = 0 THEN 'Y' ELSE 'X' END AS skew, CASE WHEN p_partkey // 2 % 2 = 0 THEN 'shear' ELSE 'objective' END AS frame FROM part"""


def acquisitions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    whole = lambda c: c.cast("int")
    return spark.read.parquet(f"{d}/part.parquet").select(
        k, whole(5 + F.col("p_size")).alias("nz"), whole(8 + k % 40).alias("ny"), whole(6 + k % 37).alias("nx"), ((3 + k % 7).cast("double") / 10).alias("dz"), ((10 + k % 3).cast("double") / 64).alias("dy"), ((10 + k % 4).cast("double") / 64).alias("dx"),
        ((25 + (k % 9) * 5).cast("double") + (k % 4).cast("double") / 4).alias("angle"), F.when(k % 2 == 0, "Y").otherwise("X").alias("skew"), F.when(F.floor(k / 2) % 2 == 0, "shear").otherwise("objective").alias("frame"),
    )


_PLACED = f"""a AS (SELECT *, CASE WHEN skew = 'Y' THEN ny ELSE nx END AS n, CASE WHEN skew = 'Y' THEN dy ELSE dx END AS d, sin(radians(angle)) AS s, cos(radians(angle)) AS c FROM ({ACQUISITIONS_SQL})),
  h AS (SELECT *, dz / d AS step, s * dz / d AS scale, sin(radians(90 - angle)) * (dz / d) AS lean FROM a), m AS (SELECT *, c * scale + -s * lean AS t00, -s AS t01, s * scale + c * lean AS t10, c AS t11 FROM h),
  g AS (SELECT *, CAST(CASE WHEN frame = 'shear' THEN ceil((nz - 1) * (s * step)) + 1 ELSE round_even(greatest(0, t01 * n, t00 * nz, t00 * nz + t01 * n) - least(0, t01 * n, t00 * nz, t00 * nz + t01 * n), 0) END AS INT) AS depth,
    CAST(CASE WHEN frame = 'shear' THEN ceil((nz - 1) * (c * step) + (n - 1)) + 1 ELSE round_even(greatest(0, t11 * n, t10 * nz, t10 * nz + t11 * n) - least(0, t11 * n, t10 * nz, t10 * nz + t11 * n), 0) END AS INT) AS moved FROM m),
  o AS (SELECT *, depth AS out_z, CASE WHEN skew = 'Y' THEN moved ELSE ny END AS out_y, CASE WHEN skew = 'Y' THEN nx ELSE moved END AS out_x FROM g)"""
_SHAPES = "p_partkey, nz, angle, skew, out_z, out_y, out_x"


@register(f"WITH {_PLACED} SELECT {_SHAPES} FROM o WHERE frame = 'shear'")
def shear_shapes(spark, d):
    return columns.with_geometry(acquisitions(spark, d)).filter("frame = 'shear'").select(*_SHAPES.split(", "))


@register(f"WITH {_PLACED} SELECT {_SHAPES} FROM o WHERE frame = 'objective'")
def objective_shapes(spark, d):
    return columns.with_geometry(acquisitions(spark, d)).filter("frame = 'objective'").select(*_SHAPES.split(", "))


@register(f"SELECT p_partkey, frame, skew, round(CASE WHEN frame = 'objective' THEN sin(radians(angle)) * dz WHEN skew = 'Y' THEN dy ELSE dx END, 9) AS new_dz FROM ({ACQUISITIONS_SQL})")
def output_voxel(spark, d):
    return columns.with_geometry(acquisitions(spark, d)).select("p_partkey", "frame", "skew", F.round("new_dz", 9).alias("new_dz"))


def _matrix_sql() -> str:
    """The map of places with the scan turned back: z counts down from the last plane."""
    depth = "CASE WHEN frame = 'shear' THEN s * step * {z} ELSE n * s * {one} - s * {l} END"
    moved = "CASE WHEN frame = 'shear' THEN c * step * {z} + {l} ELSE step * {z} + c * {l} END"
    cells = []
    for j, (z, y, x, one) in enumerate((("-1", "0", "0", "0"), ("0", "1", "0", "0"), ("0", "0", "1", "0"), ("(nz - 1)", "0", "0", "1"))):
        lat, other = (f"(CASE WHEN skew = 'Y' THEN {p} ELSE {q} END)" for p, q in ((y, x), (x, y)))
        put = lambda text, z=z, lat=lat, one=one: text.format(z=z, l=lat, one=one)
        rows = (put(depth), f"CASE WHEN skew = 'Y' THEN {put(moved)} ELSE {other} END", f"CASE WHEN skew = 'Y' THEN {other} ELSE {put(moved)} END", one)
        cells += [f"SELECT p_partkey, CAST({i} AS INT) AS i, CAST({j} AS INT) AS j, round(CAST({v} AS DOUBLE), 9) + 0.0 AS v FROM h" for i, v in enumerate(rows)]
    return f"WITH {_PLACED} {' UNION ALL '.join(cells)}"


@register(_matrix_sql())
def display_matrix_flipped(spark, d):
    return columns.display_matrices(acquisitions(spark, d), flipped=True).select("p_partkey", "i", "j", (F.round("v", 9) + 0.0).alias("v"))


def _crop_geometry_sql() -> str:
    """The raw blocks of regions by mapping the eight corners of each in SQL."""
    a = OBJECTIVE_Y
    height = f"{a.n_lateral} * {term(a, 'sin')}"
    corners = f"SELECT roi_index, zz, yy, xx FROM b, (SELECT unnest([0, 8]) AS zz), LATERAL (SELECT unnest([y0, y1]) AS yy), LATERAL (SELECT unnest([x0, x1]) AS xx)"
    back = f"SELECT roi_index, (yy - {term(a, "cos")} * ({height} - zz) / {term(a, "sin")}) / {term(a, "step")} AS z, ({height} - zz) / {term(a, "sin")} AS y, xx AS x FROM k"
    clip = lambda f, c, n: f"CAST(least(greatest(round_even({f}({c}), 0), 0), {n}) AS INT)"
    spans = ", ".join(f"{clip('min', c, n)} AS r{c}0, {clip('max', c, n)} AS r{c}1" for c, n in zip("zyx", (NZ, NY, NX), strict=True))
    return f"WITH r AS ({ROIS_SQL}), b AS (SELECT roi_index, CAST(\"top\" AS INT) AS y0, CAST(bottom AS INT) AS y1, CAST(\"left\" AS INT) AS x0, CAST(\"right\" AS INT) AS x1 FROM r), k AS ({corners}), m AS ({back}), s AS (SELECT roi_index, {spans} FROM m GROUP BY roi_index) SELECT s.roi_index, rz0, rz1, ry0, ry1, rx0, rx1, CAST(greatest(round_even(b.y0 - (least({term(a, "step")} * rz0, {term(a, "step")} * rz1) + {term(a, "cos")} * least(ry0, ry1)), 0), 0) AS INT) AS excess FROM s JOIN b USING (roi_index)"


def _boxes(spark, d, z: tuple[int, int] = (0, 8)) -> dict[int, Box]:
    """Regions are a short list, so plans for them are made on the driver."""
    return {r["roi_index"]: region_box([(r["top"], r["left"]), (r["bottom"], r["right"])], *z) for r in regions(spark, d).collect()}


@register(_crop_geometry_sql())
def crop_geometry(spark, d):
    rows = []
    for index, box in _boxes(spark, d).items():
        plan = crop_plan(OBJECTIVE_Y, box)
        rows.append((index, *plan.raw.z, *plan.raw.y, *plan.raw.x, plan.excess))
    return spark.createDataFrame(rows, "roi_index int, rz0 int, rz1 int, ry0 int, ry1 int, rx0 int, rx1 int, excess int")


# Deskewing


def _shear_sql(a: Acquisition) -> str:
    lat, other = a.lateral, a.other
    grid = f"""SELECT zc, lc, CAST(floor(zc / {term(a, "rise")}) AS BIGINT) AS p, zc / {term(a, "rise")} - floor(zc / {term(a, "rise")}) AS fp,
      CAST(floor(lc - zc / {term(a, "tan")}) AS BIGINT) AS q, (lc - zc / {term(a, "tan")}) - floor(lc - zc / {term(a, "tan")}) AS fl FROM (SELECT unnest(range({extent(a, "depth")})) AS zc), (SELECT unnest(range({extent(a, "lateral")})) AS lc)"""
    taps = " UNION ALL ".join(f"SELECT zc, lc, p + {i} AS z, q + {j} AS l, {'fp' if i else '(1 - fp)'} * {'fl' if j else '(1 - fl)'} AS w FROM ok" for i in (0, 1) for j in (0, 1))
    return f"""grid AS ({grid}), ok AS (SELECT * FROM grid WHERE p >= 0 AND p + 1 < {a.nz} AND q >= 0 AND q + 1 < {a.n_lateral}), taps AS ({taps}),
      made AS (SELECT image_id, t, c, CAST(zc AS INT) AS z, CAST(lc AS INT) AS {lat}, r.{other}, sum(w * v) AS v FROM taps JOIN raw r ON taps.z = r.z AND taps.l = r.{lat} GROUP BY 1, 2, 3, 4, 5, 6)"""


def _objective_sql(a: Acquisition) -> str:
    lat, other = a.lateral, a.other
    return f"""g0 AS (SELECT z, lc, lc - z / {term(a, "tan")} AS vp FROM (SELECT unnest(range({extent(a, "depth")})) AS z), (SELECT unnest(range({extent(a, "lateral")})) AS lc)),
      g1 AS (SELECT *, CAST(floor(vp / {term(a, "step")}) AS BIGINT) AS pb FROM g0), g2 AS (SELECT *, vp - pb * {term(a, "step")} AS lb, {term(a, "step")} - (vp - pb * {term(a, "step")}) AS la, z / {term(a, "sin")} AS za FROM g1),
      g3 AS (SELECT *, za + lb * {term(a, "cos")} AS vb, za - la * {term(a, "cos")} AS va FROM g2), g4 AS (SELECT *, CAST(floor(vb) AS BIGINT) AS qb, CAST(floor(va) AS BIGINT) AS qa FROM g3),
      ok AS (SELECT * FROM g4 WHERE pb >= 0 AND pb + 1 < {a.nz} AND qb >= 0 AND qa >= 0 AND qb < {a.n_lateral - 1} AND qa < {a.n_lateral - 1}),
      taps AS (SELECT z, lc, pb + 1 AS rz, qa + 1 AS rl, lb * (va - qa) AS w FROM ok UNION ALL SELECT z, lc, pb + 1, qa, lb * (1 - (va - qa)) FROM ok UNION ALL SELECT z, lc, pb, qb + 1, la * (vb - qb) FROM ok UNION ALL SELECT z, lc, pb, qb, la * (1 - (vb - qb)) FROM ok),
      made AS (SELECT image_id, t, c, CAST({extent(a, "depth")} - 1 - taps.z AS INT) AS z, CAST(lc AS INT) AS {lat}, r.{other}, sum(w / {term(a, "step")} * v) AS v FROM taps JOIN raw r ON taps.rz = r.z AND taps.rl = r.{lat} GROUP BY 1, 2, 3, 4, 5, 6)"""


def _deskew_sql(a: Acquisition) -> str:
    return f"WITH raw AS ({RAW_SQL}), {_shear_sql(a) if a.frame == 'shear' else _objective_sql(a)}"


_VOXELS = "image_id, t, c, z, y, x, round(v, 6) + 0.0 AS v"


@register(f"{_deskew_sql(SHEAR_Y)} SELECT {_VOXELS} FROM made")
def deskew_shear_y(spark, d):
    return rounded(deskew(raw_volume(spark, d), SHEAR_Y), "v")


@register(f"{_deskew_sql(SHEAR_X)} SELECT {_VOXELS} FROM made")
def deskew_shear_x(spark, d):
    return rounded(deskew(raw_volume(spark, d), SHEAR_X), "v")


@register(f"{_deskew_sql(OBJECTIVE_Y)} SELECT {_VOXELS} FROM made")
def deskew_objective_y(spark, d):
    return rounded(deskew(raw_volume(spark, d), OBJECTIVE_Y), "v")


@register(f"{_deskew_sql(OBJECTIVE_X)} SELECT {_VOXELS} FROM made")
def deskew_objective_x(spark, d):
    return rounded(deskew(raw_volume(spark, d), OBJECTIVE_X), "v")


@register(f"{_deskew_sql(SHEAR_Y)} SELECT {_VOXELS} FROM made WHERE z >= 2 AND z < 6")
def deskew_z_range(spark, d):
    _, ny, nx = SHEAR_Y.output_shape
    return rounded(deskew(raw_volume(spark, d), SHEAR_Y, Box((2, 6), (0, ny), (0, nx))), "v")


def _crop_sql(a: Acquisition, dense: bool = False) -> str:
    values = ", ".join(f"({i}, {b.z[0]}, {b.z[1]}, {b.y[0]}, {b.y[1]}, {b.x[0]}, {b.x[1]})" for i, b in CROPS.items())
    cut = f"""{_deskew_sql(a)}, b(roi_index, z0, z1, y0, y1, x0, x1) AS (VALUES {values}), cut AS (SELECT image_id, t, c, CAST(roi_index AS INT) AS roi_index, CAST(z - z0 AS INT) AS z, CAST(y - y0 AS INT) AS y, CAST(x - x0 AS INT) AS x, v
      FROM made JOIN b ON z >= z0 AND z < z1 AND y >= y0 AND y < y1 AND x >= x0 AND x < x1)"""
    if not dense:
        return f"{cut} SELECT image_id, t, c, roi_index, z, y, x, round(v, 6) + 0.0 AS v FROM cut"
    return f"""{cut}, whole AS (SELECT image_id, t, c, CAST(roi_index AS INT) AS roi_index, CAST(z AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT DISTINCT image_id, t, c FROM raw), b, LATERAL (SELECT unnest(range(z1 - z0)) AS z), LATERAL (SELECT unnest(range(y1 - y0)) AS y), LATERAL (SELECT unnest(range(x1 - x0)) AS x))
      SELECT g.*, round(coalesce(v, 0), 6) + 0.0 AS v FROM whole g LEFT JOIN cut USING (image_id, t, c, roi_index, z, y, x)"""


@register(_crop_sql(OBJECTIVE_Y))
def crop_objective(spark, d):
    return rounded(cropping.crop(raw_volume(spark, d), OBJECTIVE_Y, CROPS), "v")


@register(_crop_sql(SHEAR_Y))
def crop_shear(spark, d):
    return rounded(cropping.crop(raw_volume(spark, d), SHEAR_Y, CROPS), "v")


@register(_crop_sql(SHEAR_X, dense=True))
def crop_shear_dense(spark, d):
    return rounded(cropping.crop(raw_volume(spark, d), SHEAR_X, CROPS, dense=True), "v")


# Projections


def _mip_objective_sql(a: Acquisition, linear: bool, rows: int) -> str:
    lat, other = a.lateral, a.other
    grid = f"SELECT lc, j, (lc - {term(a, "cos")} * j) / {term(a, "step")} AS nf FROM (SELECT unnest(range({rows})) AS lc), (SELECT unnest(range({a.n_lateral})) AS j) WHERE j >= floor((lc - {a.nz} * {term(a, "step")}) / {term(a, "cos")}) AND j < ceil(lc / {term(a, "cos")}) + 1"
    if not linear:
        return f"WITH raw AS ({RAW_SQL}), g AS ({grid}) SELECT image_id, t, c, CAST(lc AS INT) AS {lat}, r.{other}, max(v) AS v FROM g JOIN raw r ON r.{lat} = j AND r.z = trunc(nf + 0.5) WHERE v > 0 GROUP BY 1, 2, 3, 4, 5"
    taps = f"SELECT lc, j, floor(nf) AS n, CASE WHEN floor(nf) + 1 < {a.nz} THEN 1 - (nf - floor(nf)) ELSE 1.0 END AS w FROM g WHERE nf >= 0 UNION ALL SELECT lc, j, floor(nf) + 1, nf - floor(nf) FROM g WHERE floor(nf) >= 0"
    return f"WITH raw AS ({RAW_SQL}), g AS ({grid}), taps AS ({taps}), s AS (SELECT image_id, t, c, lc, j, r.{other}, sum(w * v) AS v FROM taps JOIN raw r ON r.{lat} = j AND r.z = n GROUP BY 1, 2, 3, 4, 5, 6) SELECT image_id, t, c, CAST(lc AS INT) AS {lat}, {other}, round(max(v), 6) AS v FROM s WHERE v > 0 GROUP BY 1, 2, 3, 4, 5"


@register(_mip_objective_sql(OBJECTIVE_Y, False, OBJECTIVE_Y.mip_shape()[0]))
def mip_objective_y(spark, d):
    return mip.project(raw_volume(spark, d), OBJECTIVE_Y)


@register(_mip_objective_sql(OBJECTIVE_X, False, OBJECTIVE_X.mip_shape()[1]))
def mip_objective_x(spark, d):
    return mip.project(raw_volume(spark, d), OBJECTIVE_X)


@register(_mip_objective_sql(ISOTROPIC, False, ISOTROPIC.mip_shape()[0]))
def mip_objective_isotropic(spark, d):
    return mip.project(raw_volume(spark, d), ISOTROPIC)


@register(_mip_objective_sql(OBJECTIVE_Y, True, OBJECTIVE_Y.mip_shape()[0]))
def mip_objective_linear(spark, d):
    return rounded(mip.project(raw_volume(spark, d), OBJECTIVE_Y, "linear"), "v")


@register(f"{_deskew_sql(SHEAR_Y)} SELECT image_id, t, c, y, x, round(max(v), 6) AS v FROM made WHERE v > 0 GROUP BY 1, 2, 3, 4, 5")
def mip_shear_y(spark, d):
    return rounded(mip.project(raw_volume(spark, d), SHEAR_Y, "linear"), "v")


@register(f"{_deskew_sql(SHEAR_X)} SELECT image_id, t, c, y, x, round(max(v), 6) AS v FROM made WHERE v > 0 GROUP BY 1, 2, 3, 4, 5")
def mip_shear_x(spark, d):
    return rounded(mip.project(raw_volume(spark, d), SHEAR_X, "linear"), "v")


@register(f"{_deskew_sql(SHEAR_Y)} SELECT image_id, t, c, CAST(lc AS INT) AS y, r.x, max(v) AS v FROM ok JOIN raw r ON r.z = p + CASE WHEN fp >= 0.5 THEN 1 ELSE 0 END AND r.y = q + CASE WHEN fl >= 0.5 THEN 1 ELSE 0 END WHERE v > 0 GROUP BY 1, 2, 3, 4, 5")
def mip_shear_nearest(spark, d):
    return mip.project(raw_volume(spark, d), SHEAR_Y, "nearest")


@register(f"{_deskew_sql(SHEAR_Y)} SELECT image_id, t, c, y, x, CAST(floor(round(max(v), 6)) AS DOUBLE) AS v FROM made WHERE v > 0 GROUP BY 1, 2, 3, 4, 5")
def mip_shear_whole_numbers(spark, d):
    made = rounded(mip.project(raw_volume(spark, d), SHEAR_Y, "linear"), "v")
    return made.withColumn("v", F.floor("v").cast("double"))


@register(with_raw(", s AS (SELECT image_id, t, c, z, sum(v) AS total FROM raw GROUP BY 1, 2, 3, 4) SELECT image_id, t, c, z, total FROM s QUALIFY row_number() OVER (PARTITION BY image_id, t, c ORDER BY total DESC, z) = 1"))
def best_plane(spark, d):
    return mip.best_plane(raw_volume(spark, d))


@register(f"SELECT roi_index, t, c FROM (SELECT roi_index, t, c, row_number() OVER (PARTITION BY roi_index ORDER BY t, c) AS k FROM (SELECT DISTINCT x % 5 AS roi_index, t, c FROM ({RAW_SQL}))) WHERE k = 1")
def first_images(spark, d):
    return mip.first_images(raw_volume(spark, d).select((F.col("x") % 5).alias("roi_index"), "t", "c"))


# Pixel types, filters and measurements


@register(with_raw("SELECT image_id, t, c, z, y, x, CAST(least(greatest(round_even(v * 1.5 - 20, 0), 0), 255) AS SMALLINT) AS v FROM raw"))
def cast_uint8(spark, d):
    return raw_volume(spark, d).withColumn("v", dtypes.saturate(F.col("v") * 1.5 - 20, "uint8"))


@register(with_raw("SELECT image_id, t, c, z, y, x, CAST(CASE WHEN x = 0 THEN 0 ELSE least(greatest(round_even(v * 900.5 - 20000, 0), -32768), 32767) END AS SMALLINT) AS v FROM raw"))
def cast_int16_nan(spark, d):
    value = F.when(F.col("x") == 0, F.lit(float("nan"))).otherwise(F.col("v") * 900.5 - 20000)
    return raw_volume(spark, d).withColumn("v", dtypes.saturate(value, "int16"))


@register(with_raw("SELECT image_id, t, c, count(*) FILTER (x = 0) AS nan_count FROM raw GROUP BY 1, 2, 3"))
def nan_count(spark, d):
    return filters.nan_count(raw_volume(spark, d).withColumn("v", F.when(F.col("x") == 0, F.lit(float("nan"))).otherwise(F.col("v"))))


@register(with_raw("SELECT * FROM raw WHERE v >= 40"))
def threshold(spark, d):
    return filters.above(raw_volume(spark, d), 40.0)


@register(with_raw("SELECT * FROM raw WHERE v > 40"))
def threshold_strict(spark, d):
    return filters.above(raw_volume(spark, d), 40.0, strict=True)


def _gaussian_sql(sigma: float) -> str:
    weights = filters.gaussian_weights(sigma)
    values = ", ".join(f"({k - len(weights) // 2}, {lit(w)})" for k, w in enumerate(weights))
    parts, before = [f"raw AS ({RAW_SQL})", f"g(d, w) AS (VALUES {values})"], "raw"
    for axis, size in (("z", NZ), ("y", NY), ("x", NX)):
        place = ", ".join(f"CAST({k} + d AS INT) AS {k}" if k == axis else k for k in "zyx")
        parts.append(f"blur_{axis} AS (SELECT image_id, t, c, {place}, sum(v * w) AS v FROM {before}, g WHERE {axis} + d >= 0 AND {axis} + d < {size} GROUP BY 1, 2, 3, 4, 5, 6)")
        before = f"blur_{axis}"
    return f"WITH {', '.join(parts)} SELECT image_id, t, c, z, y, x, round(v, 6) AS v FROM {before}"


@register(_gaussian_sql(1.0))
def gaussian_blur(spark, d):
    return rounded(filters.gaussian(raw_volume(spark, d), 1.0, (NZ, NY, NX)), "v")


_BALL = [o for o in itertools.product((-1, 0, 1), repeat=3) if sum(k * k for k in o) <= 1]


@register(with_raw(f", n(dz, dy, dx) AS (VALUES {', '.join(map(str, _BALL))}), s AS (SELECT image_id, t, c, z + dz AS z, y + dy AS y, x + dx AS x, list(v ORDER BY v DESC) AS a FROM raw, n WHERE z + dz BETWEEN 0 AND {NZ - 1} AND y + dy BETWEEN 0 AND {NY - 1} AND x + dx BETWEEN 0 AND {NX - 1} GROUP BY 1, 2, 3, 4, 5, 6) SELECT image_id, t, c, z, y, x, a[{len(_BALL) // 2 + 1}] AS v FROM s WHERE len(a) > {len(_BALL) // 2}"))
def median_filter(spark, d):
    return filters.median(raw_volume(spark, d), 1, (NZ, NY, NX))


@register(with_raw(f""", m AS (SELECT image_id, t, c, max(v) AS top, count(*) AS known FROM raw GROUP BY 1, 2, 3), b AS (SELECT image_id, t, c, top, CAST(least(floor(v * 256 / top), 255) AS INT) AS bin FROM raw JOIN m USING (image_id, t, c)),
  h AS (SELECT image_id, t, c, top, bin, sum(n) AS n FROM (SELECT image_id, t, c, top, bin, count(*) AS n FROM b GROUP BY 1, 2, 3, 4, 5 UNION ALL SELECT image_id, t, c, top, 0, {NZ * NY * NX} - known FROM m) GROUP BY 1, 2, 3, 4, 5),
  k AS (SELECT image_id, t, c, bin, (bin + CAST(0.5 AS DOUBLE)) * top / 256 AS mid, CAST(n AS DOUBLE) AS n FROM h), w AS (SELECT image_id, t, c, bin, mid, sum(n) OVER a AS w0, sum(n * mid) OVER a AS s0, sum(n) OVER p AS w, sum(n * mid) OVER p AS s FROM k WINDOW a AS (PARTITION BY image_id, t, c ORDER BY bin), p AS (PARTITION BY image_id, t, c)),
  q AS (SELECT image_id, t, c, bin, mid, round(w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)), 3) AS v FROM w WHERE w > w0) SELECT image_id, t, c, mid AS threshold FROM q QUALIFY row_number() OVER (PARTITION BY image_id, t, c ORDER BY v DESC, bin) = 1"""))
def otsu_threshold(spark, d):
    return filters.otsu(raw_volume(spark, d), NZ * NY * NX, bright=True)


_BINS = f"""m AS (SELECT image_id, t, c, max(v) AS top, count(*) AS known FROM raw GROUP BY 1, 2, 3), b AS (SELECT image_id, t, c, top, CAST(least(floor(v * 256 / top), 255) AS INT) AS bin FROM raw JOIN m USING (image_id, t, c)),
  h AS (SELECT image_id, t, c, top, bin, CAST(sum(n) AS BIGINT) AS n FROM (SELECT image_id, t, c, top, bin, count(*) AS n FROM b GROUP BY 1, 2, 3, 4, 5 UNION ALL SELECT image_id, t, c, top, 0, {NZ * NY * NX} - known FROM m) GROUP BY 1, 2, 3, 4, 5 HAVING sum(n) > 0)"""


@register(with_raw(f""", {_BINS}, p AS (SELECT image_id, t, c, arg_max(bin, n * 1000 - bin) AS pb, max(n) AS pn, min(bin) AS lb, arg_min(n, bin) AS ln, max(bin) AS hb, arg_max(n, bin) AS hn FROM h GROUP BY 1, 2, 3),
  e AS (SELECT *, CASE WHEN hb - pb >= pb - lb THEN hb ELSE lb END AS eb, CASE WHEN hb - pb >= pb - lb THEN hn ELSE ln END AS en FROM p),
  d AS (SELECT h.*, pb, pn, eb, en, abs(bin - pb) AS away, pn * abs(eb - pb) - abs(bin - pb) * (pn - en) - n * abs(eb - pb) AS under FROM h JOIN e USING (image_id, t, c) WHERE (bin - pb) * (eb - pb) >= 0)
  SELECT image_id, t, c, (bin + CAST(0.5 AS DOUBLE)) * top / 256 AS threshold FROM d QUALIFY row_number() OVER (PARTITION BY image_id, t, c ORDER BY under DESC, away) = 1"""))
def triangle_threshold(spark, d):
    return filters.triangle(raw_volume(spark, d), NZ * NY * NX)


@register(with_raw("SELECT image_id, t, c, CAST(z // 2 AS INT) AS z, CAST(y // 4 AS INT) AS y, CAST(x // 4 AS INT) AS x, sum(v) / CAST(32 AS DOUBLE) AS v FROM raw GROUP BY 1, 2, 3, 4, 5, 6"))
def pyramid_level(spark, d):
    return filters.pyramid_level(raw_volume(spark, d), (2, 4, 4))


@register(with_raw(f"SELECT image_id, max(t) + 1 AS size_t, max(c) + 1 AS size_c, max(z) + 1 AS size_z, max(y) + 1 AS size_y, max(x) + 1 AS size_x, {lit(DZ)} AS dz, {lit(DY)} AS dy, {lit(DX)} AS dx, 'uint16' AS logical_dtype FROM raw GROUP BY 1"))
def image_meta(spark, d):
    return volume.image_meta(raw_volume(spark, d), (DZ, DY, DX), "uint16")


@register(with_raw("SELECT image_id, t, c, z FROM raw GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (v > 45) > 0"))
def differing_planes(spark, d):
    raw = raw_volume(spark, d)
    return filters.same_planes(raw, raw.withColumn("v", F.when(F.col("v") > 45, 45.0).otherwise(F.col("v"))))


@register()
def seeded_labels(spark, d):
    return rounded(filters.measures(filters.seeded_components(raw_volume(spark, d), (NZ, NY, NX), 1.0, 45.0)), "centroid_z", "centroid_y", "centroid_x", "intensity_mean")


def _pad_sql() -> str:
    parts, before = [f"raw AS ({RAW_SQL})"], "raw"
    for axis, size in (("z", NZ), ("y", NY), ("x", NX)):
        target = -(-size // 16) * 16
        mirrored = ", ".join(f"CAST({2 * (size - 1)} - {k} AS INT) AS {k}" if k == axis else k for k in "zyx")
        parts.append(f"p{axis} AS (SELECT * FROM {before} UNION ALL SELECT image_id, t, c, {mirrored}, v FROM {before} WHERE {2 * (size - 1)} - {axis} BETWEEN {size} AND {target - 1})")
        before = f"p{axis}"
    return f"WITH {', '.join(parts)} SELECT image_id, t, c, z, y, x, v FROM {before}"


@register(_pad_sql())
def reflect_pad(spark, d):
    return filters.pad_reflect(raw_volume(spark, d), (NZ, NY, NX), 16)


@register(f"WITH p AS (SELECT z, y, x, sum(v) AS w FROM ({RAW_SQL}) GROUP BY 1, 2, 3), s AS (SELECT min(z) z0, max(z) z1, min(y) y0, max(y) y1, min(x) x0, max(x) x1 FROM p WHERE w > {lit(0.5)} * (SELECT max(w) FROM p)) SELECT z, y, x, w FROM p, s WHERE z >= z0 AND z < z1 AND y >= y0 AND y < y1 AND x >= x0 AND x < x1")
def psf_crop(spark, d):
    return filters.crop_psf(raw_volume(spark, d).groupBy("z", "y", "x").agg(F.sum("v").alias("w")), 0.5)


@register(with_raw("SELECT image_id, t, c, label, count(*) AS area, min(z) AS min_z, max(z) + 1 AS max_z, min(y) AS min_y, max(y) + 1 AS max_y, min(x) AS min_x, max(x) + 1 AS max_x, round(avg(z), 6) AS centroid_z, round(avg(y), 6) AS centroid_y, round(avg(x), 6) AS centroid_x, round(avg(v), 6) AS intensity_mean FROM (SELECT *, CAST(1 + (z // 8) * 4 + y // 10 AS BIGINT) AS label FROM raw WHERE v > 20) GROUP BY 1, 2, 3, 4"))
def region_measures(spark, d):
    parted = raw_volume(spark, d).filter("v > 20").withColumn("label", (1 + F.floor(F.col("z") / 8) * 4 + F.floor(F.col("y") / 10)).cast("long"))
    return rounded(filters.measures(parted), "centroid_z", "centroid_y", "centroid_x", "intensity_mean")


def _components_sql(level: float) -> str:
    """``parts``: the voxels of each connected part with its number in scan order; least places spread along touching voxels until nothing changes."""
    around = "SELECT dz, dy, dx FROM (SELECT unnest([-1, 0, 1]) AS dz), (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) WHERE dz <> 0 OR dy <> 0 OR dx <> 0"
    return f"""WITH RECURSIVE raw AS ({RAW_SQL}), m AS (SELECT *, (z * {NY} + y) * {NX} + x AS id FROM raw WHERE v >= {level}), o AS ({around}),
      e AS (SELECT a.image_id, a.t, a.c, a.id AS a, b.id AS b FROM (SELECT m.*, z + dz AS nz, y + dy AS ny, x + dx AS nx FROM m, o) a JOIN m b ON a.image_id = b.image_id AND a.t = b.t AND a.c = b.c AND b.z = nz AND b.y = ny AND b.x = nx),
      r(image_id, t, c, id, least) USING KEY (image_id, t, c, id) AS (SELECT image_id, t, c, id, id FROM m UNION
        SELECT e.image_id, e.t, e.c, e.b, min(r.least) FROM r JOIN e ON e.image_id = r.image_id AND e.t = r.t AND e.c = r.c AND e.a = r.id JOIN recurring.r AS k ON k.image_id = e.image_id AND k.t = e.t AND k.c = e.c AND k.id = e.b WHERE r.least < k.least GROUP BY e.image_id, e.t, e.c, e.b),
      parts AS (SELECT m.image_id, m.t, m.c, z, y, x, v, dense_rank() OVER (PARTITION BY m.image_id, m.t, m.c ORDER BY least) AS label FROM m JOIN r USING (image_id, t, c, id))"""


@register(_components_sql(45.0) + " SELECT image_id, t, c, CAST(label AS BIGINT) AS label, count(*) AS area, min(z) AS min_z, max(z) + 1 AS max_z, min(y) AS min_y, max(y) + 1 AS max_y, min(x) AS min_x, max(x) + 1 AS max_x, round(avg(z), 6) AS centroid_z, round(avg(y), 6) AS centroid_y, round(avg(x), 6) AS centroid_x, round(avg(v), 6) AS intensity_mean FROM parts GROUP BY image_id, t, c, label")
def component_labels(spark, d):
    labelled = labels.label_blocks(filters.above(raw_volume(spark, d), 45.0))
    return rounded(filters.measures(labelled), "centroid_z", "centroid_y", "centroid_x", "intensity_mean")


@register()
def component_axes(spark, d):
    return rounded(filters.axis_lengths(labels.label_blocks(filters.above(raw_volume(spark, d), 45.0))), "axis_major_length", "axis_minor_length")


@register(with_raw("SELECT image_id, t, c, z, min(v) AS least, max(v) AS greatest, count(*) AS n FROM raw GROUP BY 1, 2, 3, 4"))
def plane_summary(spark, d):
    raw = raw_volume(spark, d)
    return filters.plane_checksums(raw).drop("mark").join(raw.groupBy(*volume.KEYS, "z").agg(F.count("*").alias("n")), [*volume.KEYS, "z"])


# Estimates and naming


@register("SELECT text, CASE WHEN regexp_matches(text, '^[0-9]+(\\.[0-9]+)?[KMGT]?$') AND CAST(floor(CAST(regexp_extract(text, '^([0-9.]+)', 1) AS DOUBLE) * f) AS BIGINT) > 0 THEN CAST(floor(CAST(regexp_extract(text, '^([0-9.]+)', 1) AS DOUBLE) * f) AS BIGINT) END AS bytes FROM (SELECT text, CASE right(text, 1) WHEN 'K' THEN 1024 WHEN 'G' THEN 1073741824 WHEN 'T' THEN 1099511627776 ELSE 1048576 END AS f FROM (SELECT CAST(n_nationkey * 100 AS VARCHAR) || CASE n_nationkey % 5 WHEN 0 THEN 'K' WHEN 1 THEN 'M' WHEN 2 THEN 'G' WHEN 3 THEN '' ELSE 'X' END AS text FROM nation))")
def memory_texts(spark, d):
    k = F.col("n_nationkey") % 5
    texts = spark.read.parquet(f"{d}/nation.parquet").select(F.concat((F.col("n_nationkey") * 100).cast("string"), F.when(k == 0, "K").when(k == 1, "M").when(k == 2, "G").when(k == 3, "").otherwise("X")).alias("text"))
    return texts.select("text", estimate.slurm_bytes_column(F.col("text")).alias("bytes"))


def _estimate_sql() -> str:
    """Raw blocks in SQL; the deskewed block's size follows from the block's own corners."""
    a = OBJECTIVE_Y
    return f"""WITH s AS ({_crop_geometry_sql()}), k AS (SELECT roi_index, greatest(rz1 - rz0, 0) AS z, greatest(ry1 - ry0, 0) AS y, greatest(rx1 - rx0, 0) AS x FROM s),
      m AS (SELECT *, CASE WHEN z * y * x = 0 THEN 0 ELSE CAST(round_even({term(a, "sin")} * y, 0) AS BIGINT) * CAST(round_even({term(a, "step")} * z + {term(a, "cos")} * y, 0) AS BIGINT) * x END AS mid FROM k)
      SELECT roi_index, CAST(z * y * x * 2 AS BIGINT) AS host_input, CAST(z * y * x * 4 AS BIGINT) AS device_input, CAST(mid * 4 AS BIGINT) AS device_middle, CAST(greatest(z * y * x * 4, mid * 4) AS BIGINT) AS largest_buffer, CAST(floor((z * y * x * 4 + mid * 4) * 1.5) AS BIGINT) AS device_set, CAST(floor(z * y * x * 2 * 1.5) AS BIGINT) AS host_set FROM m"""


@register(_estimate_sql())
def roi_memory(spark, d):
    return estimate.region_estimate(estimate.region_shapes(spark, OBJECTIVE_Y, _boxes(spark, d)), 2)


_LIMITS = estimate.Limits(device_total=(512 << 20) + 200_000, device_buffer=10**9, host_free=10**6, cpus=16)


@register(f"WITH e AS ({_estimate_sql()}), p AS (SELECT count(*) AS n_rois, max(device_set) AS device_peak, max(host_set) AS host_peak, max(largest_buffer) AS buffer_peak FROM e) SELECT n_rois, device_peak, host_peak, buffer_peak, CAST(greatest(1, least(n_rois, 16, 200000 // device_peak, 1000000 // host_peak)) AS BIGINT) AS workers FROM p")
def recommended_workers(spark, d):
    return estimate.workers(estimate.region_estimate(estimate.region_shapes(spark, OBJECTIVE_Y, _boxes(spark, d)), 2), _LIMITS)


@register(f"""WITH {_PLACED}, e AS (SELECT p_partkey, CAST(nz AS BIGINT) * ny * nx AS n, CAST(out_z AS BIGINT) * out_y * out_x AS m FROM o)
  SELECT p_partkey, n AS voxels_in, m AS voxels_out, greatest(n, m) * 4 AS largest_buffer, (n + m) * 6 AS device_set, n * 2 + m * 6 AS host_peak, greatest(n, m) * 4 > 1000000000 AS exceeds_buffer, (n + m) * 6 <= 200000 AS fits_device, n * 2 + m * 6 <= 1000000 AS fits_host FROM e""")
def volume_memory(spark, d):
    made = columns.volume_estimates(acquisitions(spark, d).select("p_partkey", "nz", "ny", "nx", "dz", "dy", "dx", "angle", "skew", "frame"), dtypes.ITEM_SIZES["uint16"], dtypes.ITEM_SIZES["uint16"])
    fits = {"exceeds_buffer": F.col("largest_buffer") > _LIMITS.device_buffer, "fits_device": F.col("device_set") <= _LIMITS.device_budget, "fits_host": F.col("host_peak") <= _LIMITS.host_free}
    return made.select("p_partkey", "voxels_in", "voxels_out", "largest_buffer", "device_set", "host_peak").withColumns(fits)


@register(f"SELECT CAST(chunk AS INT) AS chunk, list(roi_index ORDER BY roi_index) AS rois FROM (SELECT roi_index, (row_number() OVER (ORDER BY roi_index) - 1) % 4 AS chunk FROM ({ROIS_SQL})) GROUP BY chunk")
def roi_chunks(spark, d):
    return estimate.chunks(regions(spark, d), 4, 25)


@register("SELECT n_nationkey, concat_ws('_', CASE WHEN n_nationkey % 2 = 0 THEN n_name END, 'ROI_' || CAST(n_nationkey AS VARCHAR), CASE WHEN n_nationkey % 3 = 0 THEN 'C' || CAST(n_regionkey AS VARCHAR) END, 'T' || CAST(n_nationkey % 4 AS VARCHAR)) AS suffix FROM nation")
def file_suffixes(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    key = F.col("n_nationkey")
    return n.select(key, naming.suffix_column(F.when(key % 2 == 0, F.col("n_name")), key, F.when(key % 3 == 0, F.col("n_regionkey")), key % 4).alias("suffix"))


@register(f"WITH r AS ({ROIS_SQL}) SELECT roi_index, CAST(0 AS DOUBLE) AS z, \"top\" AS y, \"left\" AS x FROM r")
def crop_origins(spark, d):
    rows = [(i, *crop_plan(SHEAR_Y, b).origin) for i, b in _boxes(spark, d).items()]
    return spark.createDataFrame(rows, "roi_index int, z double, y double, x double")


@register("SELECT CAST(i - 1 AS INT) AS row, l_orderkey, a[i] AS quantity, b[i] AS line FROM (SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber) AS a, list(CAST(l_linenumber AS BIGINT) ORDER BY l_linenumber) AS b FROM (SELECT DISTINCT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey), LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)")
def exploded_table(spark, d):
    lines = lineitem(spark, d).groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    cells = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("line"), F.col("q").cast("long").alias("q")))).alias("s"))
    return images.explode_lists(cells.select("l_orderkey", F.col("s.q").alias("quantity"), F.col("s.line").alias("line")), ["quantity", "line"])


_CONFIG = {"angle": 45.0, "skew": "Y", "time_range": range(0, 2)}


@register(f"WITH r AS ({ROIS_SQL}) SELECT roi_index, '{{\"schema_version\":\"1.0\",\"output\":{{\"path\":\"crop_ROI_' || CAST(roi_index AS VARCHAR) || '.ome.tif\",\"roi_index\":' || CAST(roi_index AS VARCHAR) || ',\"origin_zyx_px\":[0.0,' || CAST(\"top\" AS VARCHAR) || ',' || CAST(\"left\" AS VARCHAR) || ']}},\"config\":' || CAST(to_json('{json.dumps(images.jsonable(_CONFIG))}') AS VARCHAR) || '}}' AS document FROM r")
def sidecars(spark, d):
    origins = regions(spark, d).select("roi_index", F.concat(F.lit("crop_ROI_"), F.col("roi_index").cast("string"), F.lit(".ome.tif")).alias("path"), F.lit(0.0).alias("z"), F.col("top").alias("y"), F.col("left").alias("x"))
    return origins.select("roi_index", images.sidecar_column(_CONFIG).alias("document"))


@register()
def deconvolved(spark, d):
    psf = np.full((3, 3, 3), 0.02)
    psf[1, 1, 1] = 1.0
    made = decon.deconvolve(raw_volume(spark, d), {0: psf, 1: psf}, (NZ, NY, NX), iterations=3, block=(16, 24, 24))
    return rounded(made, "v", places=3)


@register()
def workflow_measures(spark, d):
    flow = Workflow().set("mask", "threshold", "deskewed_image", 30.0).set("labels", "label", "mask").set("table", "regionprops", "labels", "deskewed_image")
    crops = cropping.crop(raw_volume(spark, d), SHEAR_Y, CROPS)
    slices = crops.select("roi_index", "t", "c", F.col("t").alias("time_index"), F.col("c").alias("channel_index"), "z", "y", "x", "v")
    shape = tuple(max(b.shape[k] for b in CROPS.values()) for k in range(3))
    return rounded(run_workflow(slices, flow, shape)[1], "value", places=3)


@register(f"{_crop_sql(SHEAR_Y).replace('SELECT image_id, t, c, roi_index, z, y, x, round(v, 6) + 0.0 AS v FROM cut', '')} SELECT roi_index, 'T' || CAST(t AS VARCHAR) AS \"time\", 'C' || CAST(c AS VARCHAR) AS channel, count(*) AS area, round(max(v), 6) AS brightest FROM cut GROUP BY 1, 2, 3")
def slice_table(spark, d):
    made = cropping.crop(raw_volume(spark, d), SHEAR_Y, CROPS)
    label = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    return made.groupBy("roi_index", label("T", "t").alias("time"), label("C", "c").alias("channel")).agg(F.count("*").alias("area"), F.round(F.max("v"), 6).alias("brightest"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
