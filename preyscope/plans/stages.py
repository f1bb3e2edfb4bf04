"""Runs that leave whole results only, and that go on where an earlier one was stopped."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFEST = "MANIFEST.json"


def finished(spark: SparkSession, folder: str) -> bool:
    """Whether a run has put its results in place there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/results/{MANIFEST}")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class StagedRun:
    """The stages and results of one run in a folder that the driver and all executors share.

    Each stage is a table with a manifest of what it was made from, its schema and its rows. Both are written beside the
    stage and take its place by one rename, so a stage is whole or absent. A later run with the same inputs rereads it;
    a changed parameter, or a file of another size or time, makes all stages anew. publish() puts the
    results in place in the same way, then removes all stages.
    """

    def __init__(self, spark: SparkSession, folder: str, parameters: dict[str, object], files: list[str] = ()) -> None:
        self.spark, self.folder, self.made = spark, folder.rstrip("/"), []
        self._jvm = spark._jvm
        about = [[p, *self._status(p)] for p in files]
        self._print = hashlib.sha256(json.dumps([parameters, about], sort_keys=True, default=str).encode()).hexdigest()

    def _path(self, path: str):  # noqa: ANN202
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _status(self, path: str) -> tuple[int, int]:
        at, fs = self._path(path)
        return fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime()

    def _manifest(self, path: str) -> dict | None:
        at, fs = self._path(f"{path}/{MANIFEST}")
        return json.loads(self.spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()[0]) if fs.exists(at) else None

    def _replace(self, new: str, path: str, manifest: dict) -> None:
        at, fs = self._path(f"{new}/{MANIFEST}")
        out = fs.create(at)
        out.write(bytearray(json.dumps(manifest, indent=1).encode()))
        out.close()
        self.remove(path)
        if not fs.rename(at.getParent(), self._path(path)[0]):
            raise OSError(f"{path} can't be put in place")

    def remove(self, path: str) -> None:
        at, fs = self._path(path)
        fs.delete(at, True)

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table: reread if a run with the same inputs left one, else built, perhaps from other stages."""
        path, own = f"{self.folder}/stages/{name}", hashlib.sha256(f"{self._print} {name}".encode()).hexdigest()
        done = self._manifest(path)
        if not done or done["made_from"] != own:
            df, new = build(), f"{self.folder}/stages/.new-{uuid.uuid4().hex}"
            df.write.parquet(f"{new}/rows")
            done = {"made_from": own, "schema": json.loads(df.schema.json())}
            done["rows"] = self.spark.read.schema(df.schema).parquet(f"{new}/rows").count()
            self._replace(new, path, done)
            self.made.append(name)
        return self.spark.read.schema(StructType.fromJson(done["schema"])).parquet(f"{path}/rows")

    def publish(self, write: Callable[[str], None], about: dict[str, object]) -> str:
        """The results' folder, filled by write(folder) and put in place as a whole; the stages go."""
        new, path = f"{self.folder}/.new-{uuid.uuid4().hex}", f"{self.folder}/results"
        write(new)
        self._replace(new, path, {"made_from": self._print, **about})
        self.remove(f"{self.folder}/stages")
        return path
