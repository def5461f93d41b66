"""What the jobs share: config files, command lines, logs."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import fields
from typing import TypeVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quire.errors import ValidationError

Config = TypeVar("Config")


def load_config(kind: type[Config], path: str | None) -> tuple[Config, dict[str, str]]:
    """(``kind`` from the JSON file ``path``, Spark settings under its key ``spark``); unknown keys are an error."""
    raw = {}
    if path:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
    spark = raw.pop("spark", {})
    unknown = sorted(set(raw) - {f.name for f in fields(kind)})
    if unknown:
        raise ValidationError(f"Unknown settings in {path}: {', '.join(unknown)}")
    return kind(**raw), {k: str(v) for k, v in spark.items()}


def command_line(name: str, kind: type[Config], paths: tuple[str, ...], job: Callable[..., dict], argv: list[str] | None = None) -> dict:
    """Parse ``--config`` and one option for each of ``paths``, run ``job(spark, *paths, config)`` in a session of its own."""
    parser = argparse.ArgumentParser(prog=name, description=job.__doc__)
    parser.add_argument("--config", help="JSON file with settings of the job")
    for path in paths:
        parser.add_argument(f"--{path}", required=True)
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config, settings = load_config(kind, args.config)
    spark = SparkSession.builder.appName(name).config(map={"spark.sql.session.timeZone": "UTC"} | settings).getOrCreate()
    try:
        return job(spark, *[getattr(args, path) for path in paths], config)
    finally:
        spark.stop()


def observed(df: DataFrame, **counts) -> tuple[DataFrame, Observation]:
    """``df`` and an observation of its rows and of further aggregates, filled by the first action on it."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in counts.items()]), seen
