"""``python -m quillspan``: a session at the terminal, over the current snapshot or an archive."""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from . import logs
from .operators import generation, session
from .operators.snapshots import HotReloadableIndex


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, read: Callable[[str], str] = input, write: Callable[[str], None] = print) -> int:
    parser = argparse.ArgumentParser(description="Type the beginning of a line; the best completions are shown.")
    parser.add_argument("--snapshots-dir", help="folder whose current snapshot is followed")
    parser.add_argument("--zip", help="archive to use while there is no snapshot")
    parser.add_argument("--cache", default="index-cache", help="where the archive's index is stored")
    parser.add_argument("--basic", action="store_true", help="the older session, without modes")
    args = parser.parse_args(argv)
    logs.configure()
    spark = spark or SparkSession.builder.getOrCreate()
    index = HotReloadableIndex(spark, args.snapshots_dir, zip_path=args.zip, cache_path=args.cache)
    search = session.search_over(index.sentences)
    translator = generation.TranslationService() if os.environ.get("GOOGLE_CLOUD_PROJECT") else None
    if args.basic:
        session.run_basic(search, translator, read, write)
    else:
        session.run(search, generation.SuggestionClient(), translator, read, write)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
