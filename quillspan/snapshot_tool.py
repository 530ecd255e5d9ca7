"""``python -m quillspan.snapshot_tool``: build and publish versions, list them, go back to one."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from .operators import snapshots as s

Action = Callable[[argparse.Namespace, SparkSession | None], tuple[int, list[str]]]


def listed(args: argparse.Namespace, spark: SparkSession | None) -> tuple[int, list[str]]:
    """Every version, a mark after the current one."""
    marks = {s.get_current_version(args.snapshots_dir): " (current)"}
    return 0, [v + marks.get(v, "") for v in s.list_snapshot_versions(args.snapshots_dir)] or [f"{args.snapshots_dir} holds no version"]


def rolled_back(args: argparse.Namespace, spark: SparkSession | None) -> tuple[int, list[str]]:
    """The pointer moved to a version that is there."""
    if args.rollback not in s.list_snapshot_versions(args.snapshots_dir):
        return 1, [f"{args.rollback} is not a version in {args.snapshots_dir}; nothing was changed"]
    s.set_current_version(args.snapshots_dir, args.rollback)
    return 0, [f"{args.rollback} is current again"]


def published(args: argparse.Namespace, spark: SparkSession | None) -> tuple[int, list[str]]:
    """A new version of the archive's lines, made current."""
    try:
        return 0, [f"{s.publish_snapshot(spark or SparkSession.builder.getOrCreate(), args.zip, args.snapshots_dir)} is built and current"]
    except s.SnapshotValidationError as problem:
        return 1, [f"refused: {problem}; the current version stays"]


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs one action and prints its lines; the exit code is 1 if it was refused."""
    flags = argparse.ArgumentParser(description=__doc__)
    flags.add_argument("--snapshots-dir", default="snapshots", help="folder of the versions, which readers follow")
    flags.add_argument("--zip", default="Archive.zip", help="archive whose text files become a version")
    other = flags.add_mutually_exclusive_group()
    other.add_argument("--list", dest="action", action="store_const", const=listed, default=published, help="show the versions, build none")
    other.add_argument("--rollback", metavar="VERSION", help="make a version current, build none")
    args = flags.parse_args(argv)
    action: Action = rolled_back if args.rollback else args.action
    code, lines = action(args, spark)
    print(*lines, sep="\n")
    return code


if __name__ == "__main__":
    raise SystemExit(main())
