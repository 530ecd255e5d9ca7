import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def archive(tmp_path):
    """Writes {path: text or bytes} into a zip archive."""

    def make(files, name="corpus.zip"):
        path = tmp_path / name
        with zipfile.ZipFile(path, "w") as z:
            for member, content in files.items():
                z.writestr(member, content)
        return str(path)

    return make


@pytest.fixture
def sentences(spark):
    """A sentences table from a list of lines."""
    from quillspan.functions.text import normalize
    from pyspark.sql import functions as F

    def make(lines):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "sentence_id long, original_text string")
        return rows.select("sentence_id", "original_text", normalize(F.col("original_text")).alias("normalized_text"), F.lit("synthetic.txt").alias("source_path"), F.col("sentence_id").cast("int").alias("offset"))

    return make
