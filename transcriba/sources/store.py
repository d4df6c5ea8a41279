"""Tables of Parquet under one folder, with a ledger of schema versions: columns that come later have defaults in earlier files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CreateTable:
    """A table and its first columns, name and type."""

    table: str
    columns: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class AddColumn:
    """A column more; rows written before it read as default, a SQL literal."""

    table: str
    column: str
    kind: str
    default: str = "NULL"


Migration = tuple[int, tuple[CreateTable | AddColumn, ...]]
LEDGER = "schema_migrations"
_KINDS = "version int, table string, column string, kind string, default string"


class Store:
    """A folder of tables. Rows lie under the version at which they were written, so old files are never rewritten."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def ledger(self) -> DataFrame:
        """version, table, column, kind, default: a row for each column, in the version that brought it."""
        path = f"{self.folder}/{LEDGER}"
        return self.spark.read.schema(_KINDS).parquet(path) if self._exists(path) else self.spark.createDataFrame([], _KINDS)

    def version(self) -> int:
        return self.ledger().agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first().v

    def migrate(self, migrations: list[Migration]) -> list[int]:
        """Applies the versions that the ledger does not have, in order, and says which; a second time it does nothing.

        A version is entered by one write, after all its steps are known to be sound: a table must exist to get a column, and have none of that name.
        """
        have = {(r.table, r.column) for r in self.ledger().collect()}  # a row for each column of the schema
        done, entered = {r.version for r in self.ledger().select("version").distinct().collect()}, []
        for version, steps in sorted(migrations):
            if version in done:
                continue
            rows = []
            for s in steps:
                columns = [(c, k, "NULL") for c, k in s.columns] if isinstance(s, CreateTable) else [(s.column, s.kind, s.default)]
                exists = any(t == s.table for t, _ in have)
                if exists == isinstance(s, CreateTable) or any((s.table, c) in have for c, _, _ in columns):
                    raise ValueError(f"version {version} cannot change {s.table}")
                rows += [(version, s.table, *c) for c in columns]
                have |= {(s.table, c) for c, _, _ in columns}
            self.spark.createDataFrame(rows, _KINDS).coalesce(1).write.mode("append").parquet(f"{self.folder}/{LEDGER}")
            entered.append(version)
        return entered

    def _columns(self, table: str) -> list:
        rows = self.ledger().where(F.col("table") == table).collect()
        if not rows:
            raise ValueError(f"unknown table: {table}")
        return sorted(rows, key=lambda r: r.version)

    def append(self, table: str, rows: DataFrame) -> None:
        """Adds rows under the present version; columns that rows lack take their defaults."""
        cols = [(F.col(c.column) if c.column in rows.columns else F.expr(c.default)).cast(c.kind).alias(c.column) for c in self._columns(table)]
        rows.select(*cols).write.mode("append").parquet(f"{self.folder}/{table}/written={self.version()}")

    def read(self, table: str) -> DataFrame:
        """All rows under the present schema: a column that came after a row was written has its default there, a null written since stays null."""
        cols = self._columns(table)
        kinds = ", ".join(f"`{c.column}` {c.kind}" for c in cols)
        if not self._exists(f"{self.folder}/{table}"):
            return self.spark.createDataFrame([], kinds)
        rows = self.spark.read.schema(f"{kinds}, written int").parquet(f"{self.folder}/{table}")
        return rows.select(*[F.when(F.col("written") < c.version, F.expr(c.default).cast(c.kind)).otherwise(F.col(c.column)).alias(c.column) for c in cols])
