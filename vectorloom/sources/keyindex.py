"""Which (id, fingerprint) keys a vector table holds, kept in buckets beside it.

The keys of a space (model, build, task, width) are a bucketed table below ``<path>.keys``. Every
run adds its keys in the same buckets, so a join by key reads each bucket where it lies: stored
keys are never shuffled, only the incoming ones are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

ON = ("id", "text_hash")


class KeyIndex:
    """The keys of one space of the vector table at ``path``.

    ``begin`` notes a run before its vectors are written, ``finish`` adds its keys and removes the
    note. A run that dies in between is found by its note (``pending``) and finished by the next.
    A key may stand in the index twice, which changes no answer.
    """

    def __init__(self, spark: SparkSession, path: str, space: dict[str, object], buckets: int | None = None):
        self.spark = spark
        self.home = f"{path.rstrip('/')}.keys/" + "/".join(f"{k}={v}" for k, v in space.items())
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        held = self._children(self.home, "buckets=")
        self.buckets = int(held[0]) if held else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.exists = bool(held)
        self.location = f"{self.home}/buckets={self.buckets}"

    def _folder(self, path: str):
        folder = self._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self._conf), folder

    def _children(self, path: str, start: str) -> list[str]:
        files, folder = self._folder(f"{path}/{start}*")
        return [f.getPath().getName()[len(start) :] for f in files.globStatus(folder) or []]

    def _register(self) -> str:
        """Tell the session's catalog of the folder; the name under which it stands there."""
        files, folder = self._folder(self.location)
        files.mkdirs(folder)
        place = files.makeQualified(folder).toString()
        name = "vectorloom_keys_" + hashlib.md5(place.encode()).hexdigest()
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (id BIGINT, text_hash BINARY) USING parquet "
            f"CLUSTERED BY ({', '.join(ON)}) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )
        self.spark.catalog.refreshTable(name)
        return name

    def table(self) -> DataFrame:
        """``id, text_hash``, in buckets by both."""
        return self.spark.table(self._register())

    def dealt(self, keys: DataFrame) -> DataFrame:
        """``keys`` in the buckets of the index."""
        return keys.repartition(self.buckets, *ON)

    def add(self, keys: DataFrame) -> None:
        """Append ``id, text_hash``, one file a bucket."""
        name = self._register()
        self.dealt(keys.select(*ON).distinct()).write.insertInto(name)
        self.exists = True

    def begin(self, run: str) -> None:
        files, folder = self._folder(f"{self.home}/run={run}")
        files.mkdirs(folder)

    def pending(self) -> list[str]:
        """Runs that began and did not end."""
        return self._children(self.home, "run=")

    def finish(self, run: str, keys: DataFrame) -> None:
        """Add what a run wrote. The note goes last, so a run that dies here is finished again."""
        self.add(keys)
        files, folder = self._folder(f"{self.home}/run={run}")
        files.delete(folder, True)
