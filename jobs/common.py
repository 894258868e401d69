"""What the jobs share: config files, the log, and the session of a command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def settings(name: str, path: str | None = None) -> dict[str, Any]:
    """The config beside a job, and over it that of ``path``; keys that the job's own lacks are an error."""
    own = json.loads(Path(__file__).with_name(f"{name}.json").read_text("utf-8"))
    given = json.loads(Path(path).read_text("utf-8")) if path else {}
    if unknown := sorted(set(given) - set(own)):
        raise ValueError(f"{path}: unknown settings {', '.join(unknown)}")
    return own | given


def command_line(name: str, said: str, run: Callable[..., DataFrame], argv: list[str] | None = None) -> None:
    """Run a job from the command line: ``--data``, ``--out`` and, if wanted, ``--config``; the session is made and stopped here alone."""
    parser = argparse.ArgumentParser(prog=name, description=said)
    parser.add_argument("--data", required=True, help="path of the input, any that Spark reads")
    parser.add_argument("--out", required=True, help="path of the output, any that Spark writes")
    parser.add_argument("--config", help="a JSON file that changes some settings")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, args.data, args.out, settings(name, args.config))
    finally:
        spark.stop()
