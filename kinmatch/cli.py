"""Command line: review queues, label exchange by CSV, thresholds, reproduction bundles."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.functions.text import without_controls
from kinmatch.operators import curate, metrics
from kinmatch.plans import experiment
from kinmatch.sources import logs


def _review(spark: SparkSession, a: argparse.Namespace) -> int:
    """Append the items that most need a verdict to a review queue."""
    rows = curate.review(_ordered(logs.read_judgements(spark, a.log)), a.limit, a.audit)
    logs.append(rows.withColumn("v", F.lit(1)), a.queue, logs.REVIEW)
    return 0


def _ordered(log: DataFrame) -> DataFrame:
    """A log with verdicts and the order of its times."""
    return log.withColumn("verdict", F.coalesce("decision", "verdict")).withColumn("pos", F.coalesce("timestamp", F.lit("")))


def _show(spark: SparkSession, a: argparse.Namespace) -> int:
    """Print the first items of a queue, without control characters."""
    items = logs.read(spark, a.queue, logs.REVIEW)
    for r in items.select(*[without_controls(F.col(c).cast("string")).alias(c) for c in ("left_id", "right_id", "score", "reason")]).orderBy("left_id", "right_id").limit(a.limit).collect():
        print(" | ".join("" if v is None else v for v in r))
    return 0


def _export(spark: SparkSession, a: argparse.Namespace) -> int:
    logs.export_review(logs.read(spark, a.queue, logs.REVIEW), a.csv)
    return 0


def _import(spark: SparkSession, a: argparse.Namespace) -> int:
    logs.append(logs.import_labels(spark, a.csv, logs.read(spark, a.queue, logs.REVIEW)), a.corrections, logs.CORRECTIONS)
    return 0


def _threshold(spark: SparkSession, a: argparse.Namespace) -> int:
    """Print the threshold that logged scores and corrections give."""
    fixed = logs.read(spark, a.corrections, logs.CORRECTIONS).withColumn("pos", F.coalesce("timestamp", F.lit("")))
    value, warned = metrics.threshold_from_pairs(curate.harvest(_ordered(logs.read_judgements(spark, a.log)), fixed))
    for w in warned:
        print(w, file=sys.stderr)
    print(value)
    return 0


def _verify(spark: SparkSession, a: argparse.Namespace) -> int:
    """Run a bundle again with ``module:function`` as what runs a cell; 1 if anything differs."""
    module, _, name = a.runner.partition(":")
    wrong = experiment.verify_bundle(spark, a.bundle, getattr(importlib.import_module(module), name), a.code)
    print("\n".join(wrong) if wrong else "equal")
    return int(bool(wrong))


def parser() -> argparse.ArgumentParser:
    """All commands and their arguments."""
    p = argparse.ArgumentParser(prog="kinmatch", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable[[SparkSession, argparse.Namespace], int], *paths: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=run.__doc__)
        for x in paths:
            c.add_argument(x)
        c.set_defaults(run=run)
        return c

    c = command("review", _review, "log", "queue")
    c.add_argument("--limit", type=int, default=20)
    c.add_argument("--audit", type=float, default=0.0, help="share of items drawn at random")
    command("show", _show, "queue").add_argument("--limit", type=int, default=20)
    command("export-csv", _export, "queue", "csv")
    command("import-csv", _import, "csv", "queue", "corrections")
    command("threshold", _threshold, "log", "corrections")
    command("verify", _verify, "bundle", "runner").add_argument("--code", default="unversioned")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(SparkSession.builder.appName("kinmatch").getOrCreate(), a)


if __name__ == "__main__":
    raise SystemExit(main())
