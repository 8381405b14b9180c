"""Tables at rest: merges by key, versioned publishing, exports.

There is no table format here, only Parquet: a new version is written beside the old one, and
readers follow a pointer that changes once the version has passed its checks.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmart.schemas import SCHEMAS, align


# ---------------------------------------------------------------- merges
def union_sources(frames: Iterable[DataFrame]) -> DataFrame:
    """All source batches as raw_posts rows, with the order they arrived in."""
    out = None
    for i, frame in enumerate(frames):
        batch = align(frame, "raw_posts").withColumn("_batch", F.lit(i))
        out = batch if out is None else out.unionByName(batch)
    return out


def one_per_post(rows: DataFrame, batch: str = "_batch") -> DataFrame:
    """Rows with text, one per id: the last batch that holds the id wins.

    An aggregate keeps one row per id and combines map-side, so an id repeated without end
    is no hot spot; within a batch the greatest row decides.
    """
    fields = [c for c in rows.columns if c not in ("source_id", batch)]
    best = F.max(F.struct(batch, *fields)).alias("b")
    return (rows.filter(F.coalesce("text", F.lit("")) != "").groupBy("source_id").agg(best)
            .select("source_id", *[F.col(f"b.{c}").alias(c) for c in fields]))


def insert_new(stored: DataFrame, rows: DataFrame, key) -> DataFrame:
    """Rows whose key is not stored yet (to be appended)."""
    return rows.join(stored.select(key), key, "left_anti")


def upsert(stored: DataFrame, rows: DataFrame, key) -> DataFrame:
    """Stored rows without the incoming keys, plus the incoming rows. ``key`` may be a list."""
    keys = [key] if isinstance(key, str) else list(key)
    return stored.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def patch(stored: DataFrame, updates: DataFrame, key: str, columns) -> DataFrame:
    """SET column = COALESCE(new, old) for the given columns, by key."""
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = stored.join(new, key, "left")
    return joined.select(*[
        F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns])


# ---------------------------------------------------------------- versioned tables
class Warehouse:
    """A folder of tables. ``root/v=<run>/<table>`` holds a build; ``root/_CURRENT`` names the
    build that readers see. Only a passed gate moves the pointer, so a failed build leaves the
    last good one in place and there is nothing to restore."""

    POINTER = "_CURRENT"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def current(self) -> str | None:
        fs, p = self._fs(f"{self.root}/{self.POINTER}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()

    def path(self, table: str, version: str) -> str:
        return f"{self.root}/v={version}/{table}"

    def write(self, table: str, df: DataFrame, version: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write one table of a build and return it as read back."""
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(table, version))
        return self.read(table, version)

    def read(self, table: str, version: str | None = None) -> DataFrame:
        version = version or self.current()
        if version is None:
            raise FileNotFoundError(f"nothing is published below {self.root}")
        return self.spark.read.parquet(self.path(table, version))

    def publish(self, version: str, checks: DataFrame) -> bool:
        """Point readers at ``version`` if every check passed."""
        if checks.filter(~F.col("ok")).limit(1).count():
            return False
        staged = f"{self.root}/{self.POINTER}.{version}"
        fs, tmp = self._fs(staged)
        out = fs.create(tmp, True)
        out.write(bytearray(version.encode()))
        out.close()
        _, final = self._fs(f"{self.root}/{self.POINTER}")
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(tmp, final, overwrite)
        return True

    def append(self, table: str, df: DataFrame) -> None:
        """Append-only tables (audit, history) live outside the versions."""
        df.write.mode("append").parquet(f"{self.root}/log/{table}")

    def log(self, table: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/log/{table}")


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: rows, columns, column list."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"),
            F.lit(", ".join(df.columns)).alias("column_list"))
        out = row if out is None else out.unionByName(row)
    return out


def masked(rows: DataFrame) -> DataFrame:
    """Readable columns hold the masked text only: what leaves must not carry personal data."""
    if "text_masked" not in rows.columns:
        return rows
    for column in ("text", "clean_text"):
        if column in rows.columns:
            rows = rows.withColumn(column, F.col("text_masked"))
    return rows


def export_csv(rows: DataFrame, path: str, at, actor: str, what: str) -> DataFrame:
    """Write the masked rows as CSV parts and return the audit row that describes it."""
    from voxmart.operators.worklists import audit_entry

    out = masked(rows)
    flat = out.select(*[
        F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in out.dtypes])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    n = rows.sparkSession.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).count()
    return audit_entry(rows.sparkSession, at, actor, "export", f"{n} rows :: {what[:120]}")


def copy_table(rows: DataFrame, table: str, path: str) -> None:
    """Bulk copy into a contract: missing columns added, NaN stored as NULL."""
    align(rows, table).write.mode("overwrite").parquet(path)
