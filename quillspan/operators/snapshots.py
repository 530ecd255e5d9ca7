"""Versions of an index: built aside, checked, published by moving a pointer, followed by readers as it moves."""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from .. import storage
from ..logs import logger
from .index import CorpusIndex

POINTER, WHOLE = "CURRENT", "_SUCCESS"
INTERVAL_SECONDS = 2.0


class SnapshotValidationError(ValueError):
    """A corpus that must not be published."""


def version_id(zip_path: str) -> str:
    """UTC time to the second, and 12 digits of the archive's SHA-256: the same bytes in the same second are one version."""
    digest = hashlib.sha256()
    with open(zip_path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return f"{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{digest.hexdigest()[:12]}"


def build_snapshot(spark: SparkSession, zip_path: str, snapshots_dir: str, version: str | None = None, posting_tables: bool = True) -> str:
    """A new version from an archive; the pointer stays. No lines: an error, before any folder is made. A version that is
    there already is used as it is. Written aside and renamed, so a version is whole or absent."""
    version = version or version_id(zip_path)
    place = f"{snapshots_dir}/{version}"
    if storage.is_folder(place):
        return version
    index = CorpusIndex.build_from_zip(spark, zip_path)
    if index.sentences.limit(1).isEmpty():
        raise SnapshotValidationError(f"no sentences in {zip_path}")
    aside = f"{snapshots_dir}/.build-{version}-{uuid.uuid4().hex[:8]}"
    try:
        index.save(aside, posting_tables)
        storage.write_text(f"{aside}/{WHOLE}", "")
        if not storage.move_folder(aside, place):
            storage.remove_folder(aside)
    except BaseException:
        storage.remove_folder(aside)
        raise
    return version


def set_current_version(snapshots_dir: str, version: str) -> None:
    """Moves the pointer, in one step; a version that isn't there raises ``FileNotFoundError``."""
    if not storage.is_folder(f"{snapshots_dir}/{version}"):
        raise FileNotFoundError(f"no snapshot {version} under {snapshots_dir}")
    storage.write_text(f"{snapshots_dir}/{POINTER}", version)


def get_current_version(snapshots_dir: str) -> str | None:
    return (storage.read_text(f"{snapshots_dir}/{POINTER}") or "").strip() or None


def load_snapshot(spark: SparkSession, snapshots_dir: str, version: str) -> CorpusIndex:
    """Any version, also one that isn't current."""
    return CorpusIndex.load(spark, f"{snapshots_dir}/{version}")


def list_snapshot_versions(snapshots_dir: str) -> list[str]:
    """Whole versions, sorted."""
    return [v for v in storage.folders_in(snapshots_dir) if not v.startswith(".") and storage.read_text(f"{snapshots_dir}/{v}/{WHOLE}") is not None]


def publish_snapshot(spark: SparkSession, zip_path: str, snapshots_dir: str) -> str:
    version = build_snapshot(spark, zip_path, snapshots_dir)
    set_current_version(snapshots_dir, version)
    return version


class HotReloadableIndex:
    """The current version, followed as the pointer moves.

    The pointer is read at most once per interval. A version that cannot be loaded leaves the old one in place (and
    raises only if there is none); a pointer that vanishes changes nothing. Plans made from an older version keep
    reading its files. Without a pointer the index of an archive is built or loaded, and has no version.
    """

    def __init__(
        self,
        spark: SparkSession,
        snapshots_dir: str | None = None,
        check_interval_seconds: float | None = None,
        zip_path: str | None = None,
        cache_path: str | None = None,
        clock: Callable[[], float] = time.monotonic,
    ) -> None:
        self.spark = spark
        self.dir = snapshots_dir or os.environ.get("QUILLSPAN_SNAPSHOTS_DIR") or "snapshots"
        self.interval = float(os.environ.get("QUILLSPAN_RELOAD_SECONDS", INTERVAL_SECONDS)) if check_interval_seconds is None else check_interval_seconds
        self.zip_path, self.cache_path, self.clock = zip_path, cache_path, clock
        self._index: CorpusIndex | None = None
        self._version: str | None = None
        self._checked: float | None = None

    @property
    def current_version(self) -> str | None:
        return self._version

    def get(self) -> CorpusIndex:
        now = self.clock()
        if self._index is None or self._checked is None or now - self._checked >= self.interval:
            self._checked = now
            self._refresh()
        assert self._index is not None
        return self._index

    def sentences(self) -> DataFrame:
        return self.get().sentences

    def _refresh(self) -> None:
        version = get_current_version(self.dir)
        if version is None:
            if self._index is None:
                if self.zip_path is None or self.cache_path is None:
                    raise FileNotFoundError(f"no current snapshot under {self.dir}, and no archive")
                self._index = CorpusIndex.load_or_build(self.spark, self.zip_path, self.cache_path)
            return
        if version == self._version:
            return
        try:
            index = load_snapshot(self.spark, self.dir, version)
        except Exception:
            if self._index is None:
                raise
            logger("snapshots").exception("snapshot %s can't be loaded; keeping %s", version, self._version)
            return
        self._index, self._version = index, version


_providers: dict[str, tuple[HotReloadableIndex, dict[str, object]]] = {}


def default_index(spark: SparkSession, **options: object) -> HotReloadableIndex:
    """One provider per application, made by the first call; other options later are an error, not ignored."""
    key = spark.sparkContext.applicationId
    if key not in _providers:
        _providers[key] = (HotReloadableIndex(spark, **options), options)
    provider, made_with = _providers[key]
    if options and options != made_with:
        raise ValueError(f"the application's index was made with {made_with}")
    return provider
