"""What the jobs share: settings from a file, a log, and a session that only a command line makes."""

from __future__ import annotations

import argparse
import logging
import tomllib
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def read_config(spark: SparkSession, path: str) -> dict[str, Any]:
    """A TOML file, read by Spark, as the path may be remote."""
    return tomllib.loads(spark.read.text(path, wholetext=True).first()[0])


def with_defaults(given: Mapping[str, Any] | None, defaults: Mapping[str, Any]) -> dict[str, Any]:
    """Settings with defaults; names that no setting has, and values of another type, are errors."""
    given = given or {}
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    for name, value in given.items():
        kind = type(defaults[name])
        if not isinstance(value, (int, float) if kind is float else kind) or (isinstance(value, bool) and kind is not bool):
            raise ValueError(f"{name} must be {kind.__name__}, not {value!r}")
    return {**defaults, **given}


def command(name: str, about: str, paths: Mapping[str, str], run: Callable[..., Any]) -> None:
    """The command line of a job: a path for every name, an optional config file, and a session that ends with the job."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    for path, said in paths.items():
        parser.add_argument(f"--{path}", required=True, help=said)
    parser.add_argument("--config", help="a TOML file of settings")
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        config = args.pop("config")
        run(spark, **args, config=read_config(spark, config) if config else None)
    finally:
        spark.stop()
