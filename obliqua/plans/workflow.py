"""User workflows: named tasks in a graph, run on each deskewed slice.

A task is a registered function and its arguments; a string argument that names
another task or a context value takes its result, the first free argument of a task without any takes the
image.  Functions come from a registry, never from code in a file.  One group
is one (region, time, channel) slice, so a slice must fit a worker.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.labels import label_array

ROOT = "deskewed_image"
CONTEXT = ("channel", "channel_index", "time", "time_index", "roi_index")
FUNCTIONS: dict[str, Callable] = {}


def task(name: str):
    def add(function: Callable) -> Callable:
        FUNCTIONS[name] = function
        return function

    return add


@task("threshold")
def _threshold(image: np.ndarray, level: float = 0.5) -> np.ndarray:
    return (image >= level).astype(np.uint8)


@task("label")
def _label(mask: np.ndarray) -> np.ndarray:
    return label_array(mask > 0)


@task("regionprops")
def _regionprops(labels: np.ndarray, image: np.ndarray | None = None) -> dict[str, list]:
    found = [n for n in np.unique(labels) if n]
    at = [np.argwhere(labels == n) for n in found]
    out: dict[str, list] = {"label": [int(n) for n in found], "area": [len(p) for p in at]}
    for k in range(3):
        out[f"centroid-{k}"] = [float(p[:, k].mean()) for p in at]
    if image is not None:
        out["intensity_mean"] = [float(image[labels == n].mean()) for n in found]
    return out


@dataclass
class Workflow:
    """``tasks``: name -> (function's name, arguments…); ``functions`` go with it to the workers, which need not know the registry."""

    tasks: dict[str, tuple] = field(default_factory=dict)
    functions: dict[str, Callable] = field(default_factory=dict)

    def set(self, name: str, function: str, *arguments: Any) -> Workflow:
        if function not in FUNCTIONS:
            raise ValueError(f"no registered function {function!r}")
        self.tasks[name] = (function, *arguments)
        self.functions[function] = FUNCTIONS[function]
        return self

    def sources(self, name: str) -> list[str]:
        return [a for a in self.tasks[name][1:] if isinstance(a, str) and (a in self.tasks or a == ROOT)]

    def leaf(self) -> str:
        """The one task that nothing else uses; a workflow must use the image and have one leaf."""
        used = {s for name in self.tasks for s in self.sources(name)}
        if ROOT not in used:
            raise ValueError(f"no task takes {ROOT!r}")
        leaves = [n for n in self.tasks if n not in used]
        if len(leaves) != 1:
            raise ValueError(f"a workflow has one last task, not {leaves}")
        return leaves[0]

    def ancestors(self, name: str) -> set[str]:
        out, todo = set(), [name]
        while todo:
            n = todo.pop()
            if n in self.tasks and n not in out:
                out.add(n)
                todo += self.sources(n)
        return out

    def run(self, image: np.ndarray, context: dict[str, Any]) -> Any:
        """The leaf's result; only its ancestors are computed, each once."""
        values = {ROOT: image, **context}

        def value(name: str, path: tuple[str, ...] = ()) -> Any:
            if name in path:
                raise ValueError(f"tasks form a ring: {' > '.join([*path, name])}")
            if name not in values:
                function, *arguments = self.tasks[name]
                values[name] = self.functions[function](*[value(a, (*path, name)) if isinstance(a, str) and (a in self.tasks or a in values) else a for a in arguments])
            return values[name]

        return value(self.leaf())


def table(result: Any, time: str, channel: str) -> pd.DataFrame:
    """Rows of a result that is no image: a mapping's lists side by side, a table as it is, a list or a number as one column."""
    if isinstance(result, pd.DataFrame):
        rows = result.reset_index(drop=True)
    elif isinstance(result, dict):
        most = max((len(v) for v in result.values() if isinstance(v, (list, tuple))), default=1)
        rows = pd.DataFrame({k: pd.Series(list(v) if isinstance(v, (list, tuple)) else [v] * most) for k, v in result.items()})
    elif isinstance(result, (list, tuple)):
        rows = pd.DataFrame([list(result)], columns=[str(i) for i in range(len(result))])
    else:
        rows = pd.DataFrame({"0": [result]})
    rows.insert(0, "channel", channel)
    rows.insert(0, "time", time)
    return rows


MEASURES = "image_id int, roi_index int, output_index int, time string, channel string, name string, place int, row int, value double, text string"
IMAGES = "image_id int, roi_index int, output_index int, t int, c int, z int, y int, x int, v double"
#: Rows of both kinds: a cell of a table has a name, a voxel has none.
RESULTS = f"{IMAGES}, time string, channel string, name string, place int, row int, value double, text string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def workflow_results(slices: DataFrame, workflow: Workflow, shape: tuple[int, int, int]) -> DataFrame:
    """Voxels and cells of every slice of (image_id, roi_index, t, c, time_index, channel_index, z, y, x, v), in one pass; see ``split_results``.

    Slices without ``image_id`` are of image 0.  Measurements come in long form: one row for each cell, so that any workflow has one schema.
    """
    workflow.leaf()
    keys = ["image_id", "roi_index", "t", "c", "time_index", "channel_index"]
    whole, texts = ([n for n, kind in (x.split() for x in RESULTS.split(", ")) if kind == wanted] for wanted in ("int", "string"))
    if "image_id" not in slices.columns:
        slices = slices.withColumn("image_id", F.lit(0))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        image, roi, t, c, time_index, channel_index = map(int, key)
        pixels = np.zeros(shape)
        pixels[tuple(pdf[["z", "y", "x"]].to_numpy().T)] = pdf["v"].to_numpy()
        out = workflow.run(pixels, dict(zip(("roi_index", "time", "channel", "time_index", "channel_index"), (roi, t, c, time_index, channel_index), strict=True)))
        parts = []
        for index, result in enumerate(out if isinstance(out, tuple) else [out]):
            same = {"image_id": image, "roi_index": roi, "output_index": index}
            if isinstance(result, np.ndarray):
                at = np.argwhere(result != 0)
                parts.append(pd.DataFrame({**same, "t": t, "c": c, "z": at[:, 0], "y": at[:, 1], "x": at[:, 2], "v": result[tuple(at.T)].astype(float)}))
                continue
            frame, cells = table(result, f"T{time_index}", f"C{channel_index}"), []
            for place, name in enumerate(frame.columns[2:]):
                for i, (time, channel, v) in enumerate(zip(frame["time"], frame["channel"], frame[name], strict=True)):
                    if not pd.api.types.is_scalar(v) or pd.notna(v):
                        number = isinstance(v, (int, float, np.number, np.bool_))
                        cells.append((time, channel, str(name), place, i, float(v) if number else None, None if number else str(v)))
            parts.append(pd.DataFrame(cells, columns=["time", "channel", "name", "place", "row", "value", "text"]).assign(**same))
        made = [p for p in parts if len(p)]
        rows = (pd.concat(made, ignore_index=True) if made else pd.DataFrame()).reindex(columns=_names(RESULTS))
        return rows.astype({c: "Int32" for c in whole} | {c: object for c in texts})  # each kind of row lacks columns of the other

    return slices.groupBy(*keys).applyInPandas(run, RESULTS)


def split_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(image voxels, measurements); keep ``results`` if both are used, as each computes it otherwise."""
    return results.filter("name is null").select(*_names(IMAGES)), results.filter("name is not null").select(*_names(MEASURES))


def run_workflow(slices: DataFrame, workflow: Workflow, shape: tuple[int, int, int]) -> tuple[DataFrame, DataFrame]:
    """(image voxels, measurements) of every slice; see ``workflow_results``, and ``pivot`` for the table of one output."""
    return split_results(workflow_results(slices, workflow, shape))


def pivot(measures: DataFrame, output_index: int, names: list[str], texts: bool = False) -> DataFrame:
    """One output as a table: image, region, time, channel, row and a column for each name; all cells as text if ``texts``."""
    return measures.filter(F.col("output_index") == output_index).groupBy("image_id", "roi_index", "time", "channel", "row").pivot("name", names).agg(F.first(F.coalesce("value", "text") if texts else "value"))
