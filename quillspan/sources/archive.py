"""Sources of text files: zip archives (a Python data source, members by size), folders, document tables."""

from __future__ import annotations

import glob
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES = "text string, source_path string, file_ord long"


def decode(data: bytes) -> str:
    """UTF-8, else the whole file as Latin-1; a byte order mark is kept."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


#: Text of the members that one task reads (more, if a single member is larger).
TASK_BYTES = 32 << 20


class _Members(InputPartition):
    """Members of one archive, with the number of the first of them."""

    def __init__(self, path: str, names: list[str], first: int) -> None:
        self.path, self.names, self.first = path, names, first


class _ZipReader(DataSourceReader):
    def __init__(self, path: str, task_bytes: int) -> None:
        self.paths, self.task_bytes = sorted(glob.glob(path)) or [path], task_bytes

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        count = 0
        for path in self.paths:
            held, size = [], 0
            with zipfile.ZipFile(path) as z:
                members = [i for i in z.infolist() if not i.is_dir() and i.filename.lower().endswith(".txt")]
            for i in members:
                if held and size + i.file_size > self.task_bytes:
                    out.append(_Members(path, held, count - len(held)))
                    held, size = [], 0
                held.append(i.filename)
                size, count = size + i.file_size, count + 1
            if held:
                out.append(_Members(path, held, count - len(held)))
        return out or [_Members("", [], 0)]

    def read(self, partition: _Members) -> Iterator[tuple[str, str, int]]:
        if partition.names:
            with zipfile.ZipFile(partition.path) as z:
                for n, name in enumerate(partition.names):
                    yield decode(z.read(name)), name, partition.first + n


class ZipTextSource(DataSource):
    """``spark.read.format("zip_text").load(path)``: the ``.txt`` members (any case of the ending, any depth) in archive
    order, one row each; a task takes members of some 32 MiB and opens the archive once. ``path`` may be a pattern for
    several archives, taken in the order of their names. They must be readable under the same path on every executor."""

    @classmethod
    def name(cls) -> str:
        return "zip_text"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: object) -> DataSourceReader:
        return _ZipReader(self.options["path"], int(self.options.get("taskBytes", TASK_BYTES)))


def read_zip(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The text members of an archive, or of several: ``(text, source_path, file_ord)``."""
    spark.dataSource.register(ZipTextSource)
    return spark.read.format("zip_text").option("taskBytes", task_bytes).load(path)


def decoded(content: Column) -> Column:
    """``decode`` as an expression over bytes."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """The ``.txt`` files of a folder at any depth: ``(text, source_path, file_ord)``; paths relative to it, in their order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][xX][tT]").load(path)
    # binaryFile reports file:/... or file:///...; what follows the folder's own path is the relative name
    base = "/" + path.split(":", 1)[-1].strip("/") + "/"
    name = F.expr("substring_index(path, :base, -1)".replace(":base", "'" + base.replace("\\", "\\\\").replace("'", "\\'") + "'"))
    from ..operators.lines import first_numbers

    paths = files.select(name.alias("source_path")).withColumn("_n", F.lit(1))
    numbers = first_numbers(paths, ["source_path"], "_n").withColumnRenamed("first", "file_ord")
    return files.select(decoded(F.col("content")).alias("text"), name.alias("source_path")).join(numbers, "source_path").select("text", "source_path", "file_ord")


def from_documents(documents: DataFrame) -> DataFrame:
    """A table of documents as an archive: ``source_path`` is ``<source>/<doc_id>.txt``, the order that of ``doc_id``."""
    return documents.select("text", F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_path"), F.col("doc_id").cast("long").alias("file_ord"))
