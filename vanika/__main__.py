"""python -m vanika: a project's steps from the shell. Paths are any that Spark reads; the session is spark-submit's, or a local one."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vanika.operators import manifest
from vanika.plans import flows
from vanika.plans.project import Project
from vanika.sources import files, media, settings, srt


def _name(path: str) -> Column:
    """A file's own name."""
    return F.substring_index(F.col(path), "/", -1)


def _project(spark: SparkSession, root: str) -> Project:
    return Project(spark, f"{root.rstrip('/')}/tables", settings.read(settings.ProjectPaths(root).config))


def add_sources(spark: SparkSession, root: str, urls: str, transcripts: str) -> dict:
    """The n-th URL of a list with the n-th subtitle file of a folder, by name."""
    lines = manifest.rank(files.read_urls(spark, urls).withColumnRenamed("ord", "line"), "line").select("ord", "url")
    listed = manifest.rank(files.list_files(spark, transcripts, "*.srt").select(_name("path").alias("path")), "path").select("ord", "path")
    return {"added": _project(spark, root).register(lines, listed)}


def prepare(spark: SparkSession, root: str, sounds: str, transcripts: str, words: str | None = None, heard: str | None = None, skip_qc: bool = False) -> dict:
    """A run over WAV files (named by source id), subtitle files, and tables of word times and of what was heard; then the splits, the vocabulary and the quality report as files."""
    own, paths = _project(spark, root), settings.ProjectPaths(root)
    waves = media.read_sounds(spark, sounds).select(F.regexp_replace(_name("path"), r"(?i)\.wav$", "").alias("source_id"), "rate", "samples")
    scripts = srt.read(spark, transcripts).select(_name("path").alias("path"), "value")
    found = own.run(waves, scripts, spark.read.parquet(words) if words else None, spark.read.parquet(heard) if heard else None, skip_qc)
    own.export(paths.of("training_set"), skip_qc)
    return found


def status(spark: SparkSession, root: str) -> dict:
    """How many sources have each flag, and what went wrong with how many."""
    rows = _project(spark, root).sources()
    counts = manifest.stage_rollup(rows, ["downloaded", "aligned", "segmented", "qc_passed"]).first().asDict()
    return counts | {"errors": {x["error"]: x["count"] for x in rows.filter("error IS NOT NULL").groupBy("error").count().orderBy(F.desc("count"), "error").limit(20).collect()}}


def ready(spark: SparkSession, root: str) -> dict:
    """What training would start with."""
    def part(split: str) -> DataFrame:
        return _project(spark, root).training().filter(F.col("split") == split)

    return flows.prepare(part("train"), part("val")).first().asDict()


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m vanika", description=__doc__)
    steps = parser.add_subparsers(dest="step", required=True)
    new = steps.add_parser("new", help="folders and settings of a new project")
    new.add_argument("folder")
    new.add_argument("name")
    add = steps.add_parser("add-sources", help=add_sources.__doc__)
    add.add_argument("root")
    add.add_argument("urls")
    add.add_argument("transcripts")
    run = steps.add_parser("prepare", help=prepare.__doc__)
    run.add_argument("root")
    run.add_argument("sounds")
    run.add_argument("transcripts")
    run.add_argument("--words")
    run.add_argument("--heard")
    run.add_argument("--skip-qc", action="store_true")
    for step, of in (("status", status), ("ready", ready)):
        steps.add_parser(step, help=of.__doc__).add_argument("root")
    given = vars(parser.parse_args(arguments))
    step = given.pop("step")
    try:
        if step == "new":
            found = {"root": settings.create(given["folder"], given["name"]).root}
        else:
            spark = SparkSession.builder.getOrCreate()
            found = {"add-sources": add_sources, "prepare": prepare, "status": status, "ready": ready}[step](spark, **given)
    except (ValueError, FileNotFoundError) as wrong:
        print(wrong, file=sys.stderr)
        return 1
    print(json.dumps(found, ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
