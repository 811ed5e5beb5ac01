"""Table reads and writes with the data model's contracts: scans, upserts, deletes, logs, migration."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t


def scan(spark: SparkSession, path: str, keep: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """Filters and columns reach the file scan. Row order is undefined; sort where it matters."""
    df = spark.read.parquet(path)
    df = df.where(keep) if keep is not None else df
    return df.select(*columns) if columns else df


def by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids, "id", "left_semi")


def exists(df: DataFrame) -> bool:
    return not df.isEmpty()


def dimension_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.trim(F.coalesce(column, F.lit(""))) != "").select(column).distinct().orderBy(column)


def ensure_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Additive evolution: columns that are missing get a default."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns}) if any(c not in df.columns for c in defaults) else df


def check_dimension(df: DataFrame, column: str, dim: int) -> DataFrame:
    """Rows as they are; a vector of another length is an error when it is read."""
    ok = F.col(column).isNull() | (F.size(column) == dim)
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{column}: {dim} numbers expected, found "), F.size(column).cast("string"))).cast("boolean")))


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """New rows replace old ones of their key; among new rows of one key the last (by ``order``) wins."""
    if order:
        new = new.groupBy(*key).agg(F.max_by(F.struct(*new.columns), F.struct(*order)).alias("_r")).select("_r.*")
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of unknown keys are added, one of each (the least); known keys keep their row."""
    first = new.groupBy(*key).agg(F.min(F.struct(*new.columns)).alias("_r")).select("_r.*")
    return old.unionByName(first.join(old.select(*key), key, "left_anti"))


def delete(df: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row with the number deleted); a null predicate keeps the row."""
    drop = F.coalesce(gone, F.lit(False))
    return df.where(~drop), df.agg(F.count_if(drop).alias("deleted"))


def cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return children.join(deleted.select(F.col("id").alias(key)), key, "left_anti")


def updated(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Point updates: columns take the value in changes where there is one."""
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in columns])
    return df.join(c, key, "left").withColumns({x: F.coalesce(f"_{x}", x) for x in columns}).drop(*[f"_{x}" for x in columns])


class Staged:
    """A table that is replaced as a whole: versions are written beside each other, and a pointer row names the live one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def live(self) -> str | None:
        try:
            rows = self.spark.read.schema("version string, seq long").json(f"{self.path}/pointer").orderBy(F.desc("seq")).limit(1).collect()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return rows[0].version if rows else None

    def read(self) -> DataFrame | None:
        v = self.live()
        return None if v is None else self.spark.read.parquet(f"{self.path}/{v}")

    def replace(self, df: DataFrame) -> None:
        """Write a new version (which may read the old one), then point to it."""
        v = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{v}")
        seq = 0
        if self.live() is not None:
            seq = self.spark.read.schema("version string, seq long").json(f"{self.path}/pointer").agg(F.max("seq")).first()[0] + 1
        self.spark.createDataFrame([(v, seq)], "version string, seq long").coalesce(1).write.mode("append").json(f"{self.path}/pointer")

    def append(self, df: DataFrame) -> None:
        old = self.read()
        self.replace(df if old is None else old.unionByName(df, allowMissingColumns=True))


def migrate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the old table whose id the new one lacks, appended."""
    return new.unionByName(old.join(new.select("id"), "id", "left_anti"), allowMissingColumns=True)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: t.StructType | str, keep: Column | None = None) -> DataFrame:
    """JSON lines, newest first; blank lines are skipped, a bad line is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return (rows.where(keep) if keep is not None else rows).orderBy(F.desc("ts"))


def legacy_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    """One text file a partition (reports)."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def in_set(column: str, values: list[str]) -> str:
    """A disjunction of equalities with quoted values."""
    if not _NAME.match(column):
        raise ValueError(f"no column name: {column}")
    return " OR ".join(f"{column} = {quoted(v)}" for v in values) or "false"
