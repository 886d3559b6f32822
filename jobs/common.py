"""What the jobs share: configuration, the command line's session, scratch folders of the registered queries."""

from __future__ import annotations

import argparse
import json
import logging
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import fields
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HERE = Path(__file__).resolve().parent


def settings(kind: type, document: dict[str, Any], **paths: str) -> Any:
    """A job's settings from its document and the paths given beside it; unknown or missing names are refused."""
    known = {f.name for f in fields(kind)}
    if unknown := set(document) - known:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return kind(**document | {k: v for k, v in paths.items() if v is not None})


def shipped(name: str) -> dict[str, Any]:
    """The configuration file that lies beside a job."""
    return json.loads((HERE / f"{name}.json").read_text())


def named_columns(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns that a configuration names, each by its SQL expression."""
    return table.select(*[F.expr(text).alias(name) for name, text in columns.items()])


def command_line(name: str, kind: type, run: Callable[[SparkSession, Any], dict[str, int]], paths: tuple[str, ...], arguments: list[str] | None = None) -> None:
    """Runs a job in a session of its own, from a configuration file and paths that take precedence over it."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=(run.__doc__ or "").split("\n")[0])
    parser.add_argument("--config", default=str(HERE / f"{name}.json"))
    for path in paths:
        parser.add_argument(f"--{path}", help="takes precedence over the configuration file")
    given = vars(parser.parse_args(arguments))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    job = settings(kind, json.loads(Path(given.pop("config")).read_text()), **given)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, job)
    finally:
        spark.stop()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses, under ``spark.checkpoint.dir``; a temporary one where a session on one machine names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="obliqua-jobs-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
