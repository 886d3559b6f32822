"""Configuration of a run, and what follows from it.

``Settings`` is frozen and checks itself when made; ``Settings.copy_with`` checks again.  Mappings
from JSON (or a YAML file where that package is there) and the command line merge
key by key; the same single value given twice is an error.
"""

from __future__ import annotations

import importlib.util
import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from ..functions.dtypes import written_type
from ..functions.geometry import DEFAULT_ANGLE, DEFAULT_DX, DEFAULT_DY, DEFAULT_DZ, FRAMES, SKEWS, Acquisition
from ..operators.mip import INTERPOLATIONS
from ..sources.images import PACKINGS
from ..sources.naming import EXTENSIONS
from ..sources.volume import span


@dataclass(frozen=True)
class CropSettings:
    roi_files: tuple[str, ...] = ()
    roi_units: str = "Auto"
    roi_subset: tuple[int, ...] | None = None
    z_range: tuple[int, int] | None = None

    def __post_init__(self):
        object.__setattr__(self, "roi_files", (self.roi_files,) if isinstance(self.roi_files, str) else tuple(self.roi_files))
        if isinstance(self.roi_subset, str):
            object.__setattr__(self, "roi_subset", tuple(int(x) for x in self.roi_subset.split(",")))


@dataclass(frozen=True)
class DeconvolutionSettings:
    psf: tuple[str, ...] = ()
    iterations: int = 10
    background: float | str = 0.0  # taken off before; a word: the median of each slice's last plane ("auto") or the one before ("second_last")

    def __post_init__(self):
        if self.iterations < 1:
            raise ValueError("deconvolution takes at least one iteration")
        if isinstance(self.background, str) and self.background not in ("auto", "second_last"):
            raise ValueError(f"background is a number, 'auto' or 'second_last', not {self.background!r}")


@dataclass(frozen=True)
class Settings:
    input_image: str
    save_dir: str
    size_t: int
    size_c: int
    size_z: int
    size_y: int
    size_x: int
    save_name: str = "image"
    save_suffix: str = "_deskewed"
    save_type: str = "parquet"
    dtype: str = "uint16"
    angle: float = DEFAULT_ANGLE
    skew: str = "Y"
    frame: str = "objective"
    pixel_sizes: tuple[float, float, float] = (DEFAULT_DZ, DEFAULT_DY, DEFAULT_DX)
    invert_scan: bool = False
    time_range: tuple[int, int] | None = None
    channel_range: tuple[int, int] | None = None
    mip: bool = False
    mip_interpolation: str = "nearest"
    zarr_packing: str = "zlib"
    crop: CropSettings | None = None
    deconvolution: DeconvolutionSettings | None = None
    workflow: dict[str, list] | None = field(default=None, hash=False)

    def __post_init__(self):
        for name, kind in (("crop", CropSettings), ("deconvolution", DeconvolutionSettings)):
            if isinstance(getattr(self, name), dict):
                object.__setattr__(self, name, checked(kind, getattr(self, name)))
        if self.save_type not in EXTENSIONS:
            raise ValueError(f"unknown save type {self.save_type!r}; one of {sorted(EXTENSIONS)}")
        if self.zarr_packing not in PACKINGS:
            raise ValueError(f"unknown packing {self.zarr_packing!r} of OME-Zarr chunks; one of {sorted(PACKINGS)}")
        if self.save_type == "h5" and importlib.util.find_spec("h5py") is None:
            raise ValueError("saving h5 needs the h5py package; tiff and omezarr need nothing")
        if self.skew not in SKEWS or self.frame not in FRAMES or self.mip_interpolation not in INTERPOLATIONS:
            raise ValueError("unknown skew, frame or interpolation")
        if len(self.pixel_sizes) != 3 or min(self.pixel_sizes) < 0:
            raise ValueError("pixel sizes are three numbers (z, y, x), not negative")
        written_type(self.dtype)
        span(self.time_range, self.size_t)
        span(self.channel_range, self.size_c)
        if self.crop is not None and not self.crop.roi_files:
            raise ValueError("cropping needs at least one region file")
        if self.crop is not None and self.crop.z_range is not None:
            span(self.crop.z_range, self.acquisition.output_shape[0])

    @property
    def acquisition(self) -> Acquisition:
        return Acquisition(self.size_z, self.size_y, self.size_x, *self.pixel_sizes, self.angle, self.skew, self.frame)

    times = property(lambda self: span(self.time_range, self.size_t))
    channels = property(lambda self: span(self.channel_range, self.size_c))

    @property
    def name(self) -> str:
        return self.save_name if self.save_name.endswith(self.save_suffix) else self.save_name + self.save_suffix

    @property
    def slice_count(self) -> int:
        return len(self.times) * len(self.channels)

    def copy_with(self, **changes: Any) -> Settings:
        return replace(self, **changes)


def checked(kind: type, values: dict[str, Any]) -> Any:
    """An instance of a settings class; names that it does not know are refused."""
    known = {f.name for f in fields(kind)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"{kind.__name__} has no {unknown}")
    return kind(**{k: tuple(v) if isinstance(v, list) and k != "workflow" else v for k, v in values.items()})


def merge(*documents: dict[str, Any]) -> dict[str, Any]:
    """Mappings merged key by key at every depth; a single value in two of them is an error."""
    out: dict[str, Any] = {}
    for document in documents:
        for key, value in document.items():
            if key in out and isinstance(out[key], dict) and isinstance(value, dict):
                out[key] = merge(out[key], value)
            elif key in out:
                raise ValueError(f"{key!r} is given twice")
            else:
                out[key] = value
    return out


def read_document(path: str) -> dict[str, Any]:
    text = Path(path).read_text()
    if path.lower().endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as error:
            raise ValueError("reading YAML needs the yaml package; JSON needs nothing") from error
        return yaml.safe_load(text) or {}
    return json.loads(text)


def schema_of(kind: type = Settings) -> dict[str, str]:
    return {f.name: str(f.type) for f in fields(kind)}
