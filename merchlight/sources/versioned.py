"""Tables that are replaced part by part, with readers on a committed version.

``data/version=N/<part>=value`` holds the parts that version N wrote, and
``manifest/version=N`` says which version each part is at, in one small table that is
written last. A reader picks the newest manifest that is complete, so it never sees
half a write; a writer that is run again for the same version starts from the version
before and overwrites its own folders, so a replay changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


class VersionedTable:
    """A table under ``path`` in parts of the text column ``part``.

    ``schema`` is that of the rows, with ``part``. A manifest has a row for every part
    (their number, such as months, must be small) and may carry ``notes`` of a part.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str,
                 part: str = "month", notes: str = ""):
        self.spark, self.path, self.part = spark, path.rstrip("/"), part
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.notes = notes
        self.manifest_schema = f"{part} string, version long" + (f", {notes}" if notes else "")

    # -- versions ---------------------------------------------------------------------

    def versions(self) -> list[int]:
        """Versions whose manifest is complete, ascending."""
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        files = folder.getFileSystem(context._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        done = []
        for entry in files.listStatus(folder):
            name = entry.getPath().getName()
            marker = context._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
            if name.startswith("version=") and files.exists(marker):
                done.append(int(name.split("=")[1]))
        return sorted(done)

    def manifest(self, before: int | None = None) -> list:
        """One row for each part, of the newest version (below ``before``)."""
        found = [v for v in self.versions() if before is None or v < before]
        if not found:
            return []
        return self.spark.read.schema(self.manifest_schema) \
            .parquet(f"{self.path}/manifest/version={found[-1]}").collect()

    # -- reading ----------------------------------------------------------------------

    def read(self, parts: Sequence[str] | None = None, before: int | None = None) -> DataFrame:
        """The rows of all or some parts; opens the folders of these parts only."""
        rows = [r for r in self.manifest(before) if parts is None or r[self.part] in parts]
        return self._open([(r["version"], r[self.part]) for r in rows])

    def _open(self, places: list[tuple[int, str]]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        folders = [f"{self.path}/data/version={v}/{self.part}={p}" for v, p in sorted(places)]
        stored = T.StructType([f for f in self.schema if f.name != self.part] +
                              [T.StructField("version", T.LongType()),
                               T.StructField(self.part, T.StringType())])
        return self.spark.read.schema(stored).option("basePath", f"{self.path}/data") \
            .parquet(*folders).select(*self.schema.names)

    # -- writing ----------------------------------------------------------------------

    def replace(self, rows: DataFrame, version: int, gone: Sequence[str] = (),
                notes: dict[str, tuple] | None = None) -> list[str]:
        """Replace the parts that ``rows`` have, and drop those ``gone``; the parts written.

        Rows without a part are an error. ``version`` must exceed all others, or be
        that of a write to be repeated.
        """
        folder = f"{self.path}/data/version={version}"
        rows.select(*self.schema.names).withColumn(self.part, F.coalesce(
            self.part, F.raise_error(F.lit(f"a row has no {self.part}")))) \
            .hint("rebalance", self.part).write.mode("overwrite").partitionBy(self.part) \
            .parquet(folder)
        # the parts are the folders just written
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = place.getFileSystem(context._jsc.hadoopConfiguration())
        prefix = f"{self.part}="
        written = sorted(name[len(prefix):] for name in (
            e.getPath().getName() for e in files.listStatus(place)) if name.startswith(prefix))
        kept = [tuple(r) for r in self.manifest(before=version)
                if r[self.part] not in written and r[self.part] not in gone]
        width = len(T.StructType.fromDDL(self.manifest_schema)) - 2
        made = [(p, version, *((notes or {}).get(p) or (None,) * width)) for p in written]
        self.spark.createDataFrame(kept + made, self.manifest_schema).coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        return written

    def upsert(self, rows: DataFrame, version: int, keys: Sequence[str],
               staged: bool = False) -> list[str]:
        """Rows replace those of equal keys (null equals null) and the others stay.

        Only the parts that ``rows`` touch are read and written. ``rows`` are written
        aside first, so that a stream's batch is computed once, unless they are
        ``staged``: read from files that stay as they are.
        """
        new = rows.select(*self.schema.names)
        if not staged:
            aside = f"{self.path}/incoming/version={version}"
            new.write.mode("overwrite").parquet(aside)
            new = self.spark.read.schema(self.schema).parquet(aside)
        parts = [r[0] for r in new.select(self.part).distinct().collect()]
        old = self.read(parts, before=version)
        same = reduce(lambda a, b: a & b, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
                                           for k in keys))
        kept = old.alias("o").join(new.select(*keys).alias("n"), same, "left_anti")
        return self.replace(kept.unionByName(new), version)

    def vacuum(self, keep: int = 2) -> None:
        """Delete the folders that none of the newest ``keep`` versions reads."""
        context = self.spark.sparkContext
        versions = self.versions()
        used = {(r["version"], r[self.part]) for v in versions[-keep:]
                for r in self.manifest(before=v + 1)}
        path = context._jvm.org.apache.hadoop.fs.Path
        files = path(self.path).getFileSystem(context._jsc.hadoopConfiguration())
        for v in versions[:-keep]:
            files.delete(path(f"{self.path}/manifest/version={v}"), True)
            for kind in ("version", "batch"):
                files.delete(path(f"{self.path}/incoming/{kind}={v}"), True)
            folder = path(f"{self.path}/data/version={v}")
            if not files.exists(folder):
                continue
            for entry in files.listStatus(folder):
                name = entry.getPath().getName()
                if "=" in name and (v, name.split("=", 1)[1]) not in used:
                    files.delete(entry.getPath(), True)
