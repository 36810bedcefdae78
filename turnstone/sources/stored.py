"""Tables that sinks change: every change is a numbered version, and the same number again does nothing."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from turnstone.sources.versions import VersionedTable


class StoredTables:
    """Named tables below one folder that change together: a version holds all changes of a call, or none of them."""

    def __init__(self, spark: SparkSession, path: str, schemas: Mapping[str, str]):
        self.table, self.schemas = VersionedTable(spark, path), dict(schemas)

    def read(self, name: str) -> DataFrame:
        return self.table.read(name, self.schemas[name])

    def _commit(self, number: int, written: list, replaced: set[str]) -> None:
        self.table.commit(number, [*[e for e in self.table.entries if e[0] not in replaced], *written])

    def append(self, number: int, **rows: DataFrame) -> bool:
        """Adds rows to tables: only the new rows are written."""
        if number <= self.table.number:
            return False
        self._commit(number, [e for name, df in rows.items() for e in self.table.write(self._shaped(name, df), name, number)], set())
        return True

    def change(self, number: int, **changes: Callable[[DataFrame], DataFrame] | DataFrame) -> bool:
        """Replaces tables by frames, or by what functions make of them as they are."""
        if number <= self.table.number:
            return False
        written = []
        for name, change in changes.items():
            new = change(self.read(name)) if callable(change) else change
            written += self.table.write(self._shaped(name, new), name, number)
        self._commit(number, written, set(changes))
        return True

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        wanted = rows.sparkSession.createDataFrame([], self.schemas[name]).schema
        return rows.select(*[rows[f.name].cast(f.dataType) for f in wanted])

