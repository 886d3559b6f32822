"""Command line: ``python -m obliqua process|estimate`` with options or a JSON or YAML document."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields

from .plans.config import CropSettings, Settings, checked, merge, read_document, schema_of

NESTED = {"roi_files": ("crop", str, "+"), "roi_units": ("crop", str, None), "roi_subset": ("crop", str, None), "psf": ("deconvolution", str, "+"), "iterations": ("deconvolution", int, None), "background": ("deconvolution", str, None)}
RANGES = ("time_range", "channel_range")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="obliqua", description=__doc__)
    out.add_argument("command", nargs="?", choices=["process", "estimate"], default="process")
    out.add_argument("--config", action="append", default=[], help="a JSON or YAML document; may repeat")
    out.add_argument("--show-schema", action="store_true")
    for f in fields(Settings):
        flag = f"--{f.name.replace('_', '-')}"
        if f.name in ("crop", "deconvolution", "workflow"):
            continue
        if f.type == "bool":
            out.add_argument(flag, action="store_true", default=None)
        elif f.name in RANGES:
            out.add_argument(flag, nargs=2, type=int)
        elif f.name == "pixel_sizes":
            out.add_argument(flag, nargs=3, type=float)
        else:
            out.add_argument(flag, type={"int": int, "float": float}.get(str(f.type), str))
    for name, (_, kind, count) in NESTED.items():
        if name == "background":
            continue
        out.add_argument(f"--{name.replace('_', '-')}", type=kind, nargs=count)
    out.add_argument("--z-range", nargs=2, type=int)
    out.add_argument("--background", help="a number, auto or second_last")
    out.add_argument("--scene", type=int, help="number of the scene among those of the file")
    return out


def settings_from(arguments: argparse.Namespace) -> dict:
    given: dict = {}
    for name, value in vars(arguments).items():
        if value is None or name in ("command", "config", "show_schema"):
            continue
        if name in NESTED:
            given.setdefault(NESTED[name][0], {})[name] = float(value) if name == "background" and value not in ("auto", "second_last") else value
        elif name == "z_range":
            given.setdefault("crop", {})[name] = value
        else:
            given[name] = value
    return merge(*map(read_document, arguments.config), given)


def main(argv: list[str] | None = None) -> int:
    arguments = parser().parse_args(argv)
    if arguments.show_schema:
        print(json.dumps(schema_of(), indent=2))
        return 0
    try:
        values = settings_from(arguments)
        missing = {"input_image", "save_dir"} - set(values)
        if missing:
            raise ValueError(f"{sorted(missing)} must be given")
        # what does not depend on the image is checked before Spark starts
        checked(Settings, {"size_t": 1 << 20, "size_c": 1 << 20, "size_z": 1, "size_y": 1, "size_x": 1} | {k: v for k, v in values.items() if k not in ("scene", "crop")})
        if "crop" in values:
            checked(CropSettings, values["crop"])
    except (ValueError, TypeError) as error:
        print(f"settings: {error}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from .plans.pipeline import Pipeline, open_settings

    spark = SparkSession.builder.appName("obliqua").getOrCreate()
    settings, opened = open_settings(spark, values)
    pipeline = Pipeline(spark, settings, opened)
    if arguments.command == "estimate":
        pipeline.estimate().show(truncate=False)
    else:
        (pipeline.save_workflow() if settings.workflow is not None and not settings.mip else pipeline.save()).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
