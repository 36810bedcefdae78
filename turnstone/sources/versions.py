"""Tables that change by whole Parquet folders, in any store that Spark writes.

Every write goes to a folder of its own, ``<part>/version=n``; nothing is overwritten that a reader may hold. A manifest,
written last and as one file, names the folders (and, of partitioned ones, the days) that make up each part of the table
from then on. A writer that dies before its manifest leaves the table as it was; a run that is repeated under the same
number writes the same folders again.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

MANIFEST = "number long, part string, day date, version long"
#: Spark's name for the folder of rows without a day.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
Entry = tuple[str, date | None, int]


class VersionedTable:
    """Parts of a table below one folder; ``number`` is the last version that is complete."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.number, self.entries = self._newest()

    def _newest(self) -> tuple[int, list[Entry]]:
        try:
            rows = self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.path}/manifest")
            last = rows.agg(F.max("number")).first()[0]
        except AnalysisException:  # nothing was written yet
            return -1, []
        if last is None:
            return -1, []
        found = rows.filter(F.col("number") == last).filter("part is not null").collect()
        return last, [(r.part, r.day, r.version) for r in found]

    def folder(self, part: str, version: int) -> str:
        return f"{self.path}/{part}/version={version}"

    def write(self, rows: DataFrame, part: str, version: int, by_day: str | None = None) -> list[Entry]:
        """Writes one part under a version; the entries for the manifest. Days are kept apart and balanced by size."""
        if by_day is None:
            rows.write.mode("overwrite").parquet(self.folder(part, version))
            return [(part, None, version)]
        days = rows.hint("rebalance", by_day).write.mode("overwrite").partitionBy(by_day)
        days.parquet(self.folder(part, version))
        written = self.spark.read.schema(f"{by_day} date").parquet(self.folder(part, version))
        return [(part, r[0], version) for r in written.select(by_day).distinct().collect()]

    def commit(self, version: int, entries: Iterable[Entry]) -> None:
        """Makes the entries the table."""
        rows = [(version, *e) for e in entries] or [(version, None, None, None)]
        frame = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.path}/manifest/number={version}")
        self.number, self.entries = version, [e[1:] for e in rows if e[1] is not None]

    def read(self, part: str, schema: StructType | str, day: str | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
        """The part as it is now. Of a part kept by days only the folders of the asked days are opened."""
        inside = lambda d: (start is None or d is not None and d >= start) and (end is None or d is not None and d <= end)
        own = [(d, v) for p, d, v in self.entries if p == part and inside(d)]
        if not own:
            return self.spark.createDataFrame([], schema)
        paths = [self.folder(part, v) + (f"/{day}={d.isoformat() if d else NO_DAY}" if day else "") for d, v in sorted(own, key=str)]
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/{part}")
        return reader.parquet(*paths).drop("version")
