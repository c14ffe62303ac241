"""Output that is replaced whole: written beside the old one, checked, then renamed into its place."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_manifest.json"


class Folder:
    """A path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, jvm = spark, spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def beside(self, suffix: str) -> Folder:
        """A hidden sibling: readers of the parent folder skip names that start with a dot."""
        return Folder(self.spark, f"{self.path.getParent()}/.{self.path.getName()}.{suffix}")

    def siblings(self, suffix: str) -> list[str]:
        """The paths of beside(suffix + anything), in order of name."""
        if not self.system.exists(self.path.getParent()):
            return []
        start = f".{self.path.getName()}.{suffix}"
        found = (s.getPath() for s in self.system.listStatus(self.path.getParent()))
        return sorted(p.toString() for p in found if p.getName().startswith(start))

    def exists(self) -> bool:
        return self.system.exists(self.path)

    def move(self, other: Folder) -> None:
        if not self.system.rename(self.path, other.path):
            raise OSError(f"cannot rename {self.path} to {other.path}")

    def remove(self) -> None:
        self.system.delete(self.path, True)

    def read_text(self, name: str) -> str | None:
        file = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path, name)
        if not self.system.exists(file):
            return None
        stream = self.system.open(file)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        stream = self.system.create(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path, name), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of the output at path; None where there is no whole output."""
    recover(spark, path)
    text = Folder(spark, path).read_text(MANIFEST)
    return None if text is None else json.loads(text)


def recover(spark: SparkSession, path: str) -> None:
    """Put the old output back where a job died between the two renames, and remove what such jobs left.

    One writer per path at a time is the caller's business, as with any output.
    """
    target = Folder(spark, path)
    for old in target.siblings("old-"):
        if target.exists():
            Folder(spark, old).remove()
        else:
            Folder(spark, old).move(target)
    for new in target.siblings("new-"):
        Folder(spark, new).remove()


def publish(rows: DataFrame, path: str, expected: int | None = None, force: bool = False,
            write: Callable[[DataFrame, str], None] = lambda rows, path: rows.write.parquet(path)) -> bool:
    """Replace the output at path by rows; False if a whole output of `expected` rows is there already.

    The rows are written to a sibling folder, counted there against `expected` and listed in a manifest. Only then the old
    output moves aside and the new one into its place. A job that dies or fails while it writes leaves the old
    output as it was; one that dies between the renames leaves both, and the next call puts the old one back.
    """
    spark = rows.sparkSession
    done = manifest(spark, path)
    if done is not None and expected is not None and done["rows"] == expected and not force:
        return False
    target, mark = Folder(spark, path), uuid.uuid4().hex
    new, old = target.beside(f"new-{mark}"), target.beside(f"old-{mark}")
    try:
        write(rows, new.path.toString())
        count = spark.read.parquet(new.path.toString()).count()  # from the footers
        if expected is not None and count != expected:
            raise ValueError(f"{path}: {count} rows written, {expected} expected")
        new.write_text(MANIFEST, json.dumps({"rows": count, "schema": rows.schema.simpleString()}))
    except BaseException:
        new.remove()
        raise
    if target.exists():
        target.move(old)
    new.move(target)
    old.remove()
    return True
