"""A run from settings: read, select, flip, deconvolve, deskew, crop, project or analyse, write.

Each method returns DataFrames that nothing has computed yet; ``save`` acts.
"""

from __future__ import annotations

import contextlib
import math
import re
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dtypes
from ..functions.geometry import Acquisition, Box, region_box
from ..operators import crop as cropping
from ..operators import decon, estimate, mip, rois
from ..operators.deskew import deskew
from ..sources import images, layouts, naming, volume
from ..sources.reader import Opened, open_image
from .config import Settings, checked
from .workflow import Workflow, split_results, workflow_results


_warned: set[tuple[int, int, int]] = set()


def warn_if_large(a: Acquisition, dtype: str, limits: estimate.Limits) -> bool:
    """Warns, once for each deskewed size, of a volume that the given limits do not hold."""
    need = math.prod(a.output_shape) * (estimate.DEVICE_ITEM + dtypes.ITEM_SIZES[dtypes.written_type(dtype)])
    if limits.host_free is None or need <= limits.host_free or a.output_shape in _warned:
        return False
    _warned.add(a.output_shape)
    warnings.warn(f"the deskewed volume {a.output_shape} needs {need} bytes, more than {limits.host_free}; crop it, or write blocks", stacklevel=2)
    return True


@contextlib.contextmanager
def sized_errors(a: Acquisition):
    """Turns an executor's lack of memory into an error that names the volume's size; other errors pass."""
    try:
        yield
    except Exception as error:
        if re.search(r"OutOfMemory|MemoryError|exit code 137|Container killed", str(error)):
            raise MemoryError(f"out of memory at a deskewed size of {a.output_shape} (z, y, x); crop to regions, or give executors more memory") from error
        raise


#: Images in one run that saves files.
MOST_IMAGES = 10_000
SIZES = ("size_t", "size_c", "size_z", "size_y", "size_x")


def open_settings(spark: SparkSession, values: dict) -> tuple[Settings, Opened]:
    """Settings whose sizes, pixel sizes and type come from the image where the document leaves them out."""
    opened = open_image(spark, values["input_image"], values.get("scene", 0))
    known = dict(zip(SIZES, opened.sizes, strict=True))
    if all(opened.pixel_sizes):
        known["pixel_sizes"] = opened.pixel_sizes
    if opened.dtype in dtypes.ITEM_SIZES and opened.dtype != "float64":
        known["dtype"] = opened.dtype
    return checked(Settings, known | {k: v for k, v in values.items() if v is not None and k != "scene"}), opened


class Pipeline:
    """A run over the image that the settings name, or over the given voxels (or an opened image)."""

    def __init__(self, spark: SparkSession, settings: Settings, voxels: DataFrame | Opened | None = None):
        self.spark, self.settings = spark, settings
        opened = open_image(spark, settings.input_image, sizes=tuple(getattr(settings, k) for k in SIZES)) if voxels is None else voxels
        self._images = [0] if isinstance(opened, Opened) and opened.one_image else None
        self.planes = opened.planes if isinstance(opened, Opened) else None
        self.voxels = volume.normalise(opened.voxels if isinstance(opened, Opened) else opened)
        if self.planes is not None:  # the reader knows what the file lacks
            self.voxels = volume.complete_frames(self.voxels, settings.size_c, settings.size_z, self.planes)
        if settings.mip and (settings.crop is not None or settings.workflow is not None):
            warnings.warn("a projection is made of the whole volume: crop and workflow are left out", stacklevel=2)

    def images(self) -> list[int]:
        """The numbers of the images, a short list as each gives files of its own; a file holds one."""
        if self._images is None:
            found = [r[0] for r in volume.select(self.voxels, self.settings.times, self.settings.channels).select("image_id").distinct().limit(MOST_IMAGES + 1).collect()]
            if len(found) > MOST_IMAGES:
                raise ValueError(f"more than {MOST_IMAGES} images: save them in several runs, or as one Parquet table")
            self._images = sorted(found) or [0]
        return self._images

    def raw(self) -> DataFrame:
        """The voxels to process, flipped and deconvolved as told; ranges reach the files."""
        s = self.settings
        chosen = volume.select(self.voxels, s.times, s.channels)
        psfs = self._psfs()
        out = chosen
        if s.crop is not None and not s.mip and (s.invert_scan or psfs):  # no more than the regions' raw blocks and what the functions reach
            reach = [max((f.shape[k] for f in psfs.values()), default=0) for k in range(3)]
            raw = [cropping.safe_raw_box(s.acquisition, b) for b in self.boxes().values()]
            ends = [(min(getattr(b, k)[0] for b in raw), max(getattr(b, k)[1] for b in raw)) for k in "zyx"]
            z, y, x = [(max(0, low - r), high + r) for (low, high), r in zip(ends, reach, strict=True)]
            out = volume.block(out, Box(volume.flipped_range(z, s.size_z) if s.invert_scan else z, y, x))
        if s.invert_scan:
            out = volume.flip_scan(out, s.size_z)
        if psfs:
            background = s.deconvolution.background
            plane, medians = decon.background_plane(background, s.size_z), None
            if plane is not None:
                stored = s.size_z - 1 - plane if s.invert_scan else plane
                medians = decon.plane_medians(chosen.filter(F.col("z") == stored), s.size_y * s.size_x)
            out = decon.without_background(out, background, medians)
            out = decon.deconvolve(out, psfs, (s.size_z, s.size_y, s.size_x), s.deconvolution.iterations)
        return out

    def _psfs(self) -> dict:
        """The point-spread function of each channel, if there is a deconvolution."""
        s = self.settings
        if s.deconvolution is None:
            return {}
        files = s.deconvolution.psf
        if len(files) != s.size_c:
            raise ValueError(f"{s.size_c} channels need as many point-spread functions, not {len(files)}")
        psfs = {c: layouts.read_psf(p) for c, p in enumerate(files)}
        decon.check_psfs(psfs, s.size_c)
        return psfs

    def boxes(self) -> dict[int, Box]:
        """The output box of each chosen region, in pixels; region files are read on the driver."""
        s, found = self.settings, []
        assert s.crop is not None
        units = rois.units_of(list(s.crop.roi_files), s.crop.roi_units)
        factor = 1 / s.pixel_sizes[1] if units == "Microns" else 1.0
        for path in s.crop.roi_files:
            found += [tuple(v * factor for v in box) for box in rois.read_regions(path)]
        z = volume.span(s.crop.z_range, s.acquisition.output_shape[0])
        wanted = s.crop.roi_subset if s.crop.roi_subset is not None else tuple(range(len(found)))
        if bad := [i for i in wanted if not 0 <= i < len(found)]:
            raise ValueError(f"no regions {bad} among {len(found)}")
        boxes = {i: region_box([found[i][:2], found[i][2:]], z.start, z.stop) for i in wanted}
        _, height, width = s.acquisition.output_shape
        if outside := [i for i, b in boxes.items() if b.y[0] < 0 or b.x[0] < 0 or b.y[1] > height or b.x[1] > width]:
            warnings.warn(f"regions {outside} reach outside the deskewed volume of {height} x {width}", stacklevel=2)
        return boxes

    def process(self) -> DataFrame:
        """Projection, else crops, else the whole deskewed volume: (image_id, t, c, roi_index, z, y, x, v), pixels in the written type's range."""
        s, a = self.settings, self.settings.acquisition
        if s.mip:
            made = mip.project(self.raw(), a, s.mip_interpolation, a.output_shape[1:], truncate=not s.dtype.startswith("float")).withColumn("z", F.lit(0)).withColumn("roi_index", F.lit(None).cast("int"))
        elif s.crop is not None:
            made = cropping.crop(self.raw(), a, self.boxes())
        else:
            made = deskew(self.raw(), a).withColumn("roi_index", F.lit(None).cast("int"))
        kind = dtypes.output_type(s.dtype, s.deconvolution is not None and not s.mip)
        return made.select(*volume.KEYS, "roi_index", "z", "y", "x", dtypes.saturate(F.col("v"), kind).cast("double").alias("v"))

    def process_both(self) -> tuple[DataFrame, DataFrame]:
        """The result with deconvolution and the same without."""
        if self.settings.deconvolution is None:
            raise ValueError("no deconvolution is set")
        return self.process(), Pipeline(self.spark, self.settings.copy_with(deconvolution=None), self.voxels).process()

    def process_workflow(self) -> tuple[DataFrame, DataFrame]:
        """(image voxels, measurements) of the workflow on every slice."""
        return split_results(self._workflow_results())

    def _workflow_results(self) -> DataFrame:
        s = self.settings
        if s.workflow is None:
            raise ValueError("no workflow is set")
        flow = Workflow()
        for name, (function, *arguments) in s.workflow.items():
            flow.set(name, function, *arguments)
        made = self.process().select("image_id", F.coalesce("roi_index", F.lit(0)).alias("roi_index"), "t", "c", (F.col("t") - s.times.start).alias("time_index"), (F.col("c") - s.channels.start).alias("channel_index"), "z", "y", "x", "v")
        shapes = [b.shape for b in self.boxes().values()] if s.crop is not None else [s.acquisition.output_shape]
        return workflow_results(made, flow, tuple(max(x[k] for x in shapes) for k in range(3)))

    def shapes(self) -> dict[int, tuple[int, int, int]]:
        s = self.settings
        if s.mip:
            return {0: (1, *s.acquisition.output_shape[1:])}
        return {i: b.shape for i, b in self.boxes().items()} if s.crop is not None else {0: s.acquisition.output_shape}

    def save(self) -> DataFrame:
        """Writes the result and its sidecars; (image_id, roi_index, path, error) of each output, RuntimeError if one failed.

        Every image gets files of its own, but for the tables (Parquet, CSV), which hold them all; names that are taken get a number; a
        volume that the executors' hosts may not hold is warned of.
        """
        s = self.settings
        warn_if_large(s.acquisition, s.dtype, estimate.Limits())
        made, regions = self.process(), list(self.boxes()) if s.crop is not None and not s.mip else []
        if s.save_type in ("parquet", "csv"):
            volume_path = str(naming.free_path(s.save_dir, s.name, s.save_type))
            writer = made.write if s.save_type == "parquet" else made.write.option("header", True)
            with sized_errors(s.acquisition):
                getattr(writer.partitionBy("t", "c"), s.save_type)(volume_path)
            rows = [(None, None, volume_path, None)]
            sidecars = [(i, volume_path, f"{naming.stem(volume_path)}_ROI_{i}") for i in regions] or [(None, volume_path, None)]
        else:
            kind = dtypes.output_type(s.dtype, s.deconvolution is not None)
            shapes = {(m, i): shape for m in self.images() for i, shape in self.shapes().items()}
            paths = {(m, i): self._free(f"{self._name(m)}_ROI_{i}") for m, i in shapes}
            status = images.save_groups(self._numbered(made), ["image_id", "roi_index"], s.save_type, paths, shapes, len(s.times), len(s.channels), kind, self._voxel(), s.zarr_packing)
            with sized_errors(s.acquisition):
                rows = [tuple(r) for r in status.collect()]  # a row for each file
            sidecars = [(roi if regions else None, path, None) for _, roi, path, error in rows if error is None]
        boxes = self.boxes() if regions else {}
        for roi, target, name in sidecars:
            origin = (None, 0.0, 0.0) if s.mip else tuple(float(getattr(boxes[roi], k)[0]) for k in "zyx") if roi is not None else (0.0, 0.0, 0.0)
            images.write_sidecar(target, images.sidecar(target, s, origin, self._voxel(), roi, s.mip), name)
        return self._told(rows, "image_id int, roi_index int, path string, error string")

    def save_workflow(self) -> DataFrame:
        """Writes the workflow's results: one CSV for each image, region and output that is a table, one image for each time of those that are images.

        (image_id, roi_index, output_index, path, error) of each file; images, regions and outputs are a short list on the driver.
        The workflow's functions run once for each slice.
        """
        s = self.settings
        results = self._workflow_results().persist()
        try:
            pixels, measures = split_results(results)
            name = lambda image, roi, output, time=None: naming.suffix(self._name(image), roi, None, time) + f"_output_{output}"
            tables = [tuple(r) for r in measures.select("image_id", "roi_index", "output_index").distinct().collect()]
            rows = [tuple(r) for r in images.save_tables(measures, {k: str(naming.free_path(s.save_dir, name(*k), "csv")) for k in tables}).collect()] if tables else []
            pictures = [tuple(r) for r in pixels.select("image_id", "roi_index", "output_index", "t").distinct().collect()]
            if pictures:
                shapes, ending = self.shapes(), s.save_type if s.save_type in images.WRITERS else "tiff"
                paths = {(m, i, o, t): self._free(name(m, i, o, t - s.times.start), ending) for m, i, o, t in pictures}
                numbered = pixels.withColumn("time", F.col("t")).withColumn("t", F.lit(0)).withColumn("c", F.col("c") - s.channels.start)
                status = images.save_groups(numbered, ["image_id", "roi_index", "output_index", "time"], ending, paths, {k: shapes[k[1]] for k in pictures}, 1, len(s.channels), "float32", self._voxel(), s.zarr_packing)
                rows += [tuple(r) for r in status.drop("time").collect()]
        finally:
            results.unpersist()
        return self._told(rows, "image_id int, roi_index int, output_index int, path string, error string")

    def _name(self, image: int) -> str:
        """The name of an image's files: with its number only where there are several."""
        return self.settings.name if len(self.images()) == 1 else f"{self.settings.name}_image_{image}"

    def _numbered(self, made: DataFrame) -> DataFrame:
        s = self.settings
        return made.withColumn("roi_index", F.coalesce("roi_index", F.lit(0))).withColumn("t", F.col("t") - s.times.start).withColumn("c", F.col("c") - s.channels.start)

    def _free(self, name: str, save_type: str | None = None) -> str:
        return str(naming.free_path(self.settings.save_dir, name, naming.EXTENSIONS[save_type or self.settings.save_type]))

    def _voxel(self) -> tuple[float, float, float]:
        return (self.settings.acquisition.new_dz, *self.settings.pixel_sizes[1:])

    def _told(self, rows: list[tuple], schema: str) -> DataFrame:
        if failed := [r for r in rows if r[-1] is not None]:
            raise RuntimeError(f"{len(failed)} of {len(rows)} outputs failed: {failed}")
        return self.spark.createDataFrame(rows, schema)

    def estimate(self, limits: estimate.Limits | None = None) -> DataFrame:
        """Memory of every region, or of the whole volume without regions."""
        s, limits = self.settings, limits or estimate.Limits()
        if s.crop is None:
            return estimate.volume_estimate(self.spark, s.acquisition, s.dtype, limits, s.deconvolution is not None)
        return estimate.region_estimate(estimate.region_shapes(self.spark, s.acquisition, self.boxes()), dtypes.ITEM_SIZES[s.dtype])
