"""A stored order mart that follows its source files: only the months that changed files touch are built again.

Beside the mart lies a manifest of the source files (size and time of each) and of the months each has rows for. A
refresh compares it with the files as they are. A new, altered or missing file makes stale the months it touched before
and those it touches now; these are built from all files and written over, month by month, and the rest stays. A
change to products, translation or sellers makes every month stale. The manifest is written last, so a refresh that breaks
off is done again by the next one; without a readable manifest all is built.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from starling.functions import month_of
from starling.plans.master import order_master, read_mart
from starling.session import settled
from starling.sources.tables import Tables, landed_table, parquet_tables

KEY, MOMENT, MONTH = "order_id", "order_purchase_timestamp", "purchase_month"
FACTS, DIMENSIONS = ("orders", "items", "reviews"), ("products", "translation", "sellers")
#: Stands for the month of orders without a purchase time.
NO_MONTH = "0001-01-01"


@dataclass(frozen=True)
class Refreshed:
    """What a refresh did: the months written anew, those that are left without an order, and the number of all files
    that had changed."""
    written: tuple[str, ...]
    emptied: tuple[str, ...]
    n_changed: int


def _month() -> Column:
    return F.coalesce(month_of(MOMENT).cast("date"), F.lit(NO_MONTH).cast("date"))


def _files(spark: SparkSession, source: str) -> DataFrame:
    """``kind`` (the table), ``file``, ``size`` and ``time`` of every source file; contents are not read."""
    def of(kind):
        about = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{source}/{kind}")
        return about.select(F.lit(kind).alias("kind"), F.col("_metadata.file_path").alias("file"),
                            F.col("_metadata.file_size").alias("size"),
                            F.col("_metadata.file_modification_time").alias("time"))
    return reduce(DataFrame.unionByName, map(of, (*FACTS, *DIMENSIONS)))


def _manifest(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """The files of the last refresh, and kind, file and month of what they touched."""
    try:
        return tuple(settled(spark.read.parquet(f"{folder}/manifest/{part}")) for part in ("files", "touched"))
    except AnalysisException:
        return None


def _with_file(spark: SparkSession, source: str, kind: str, *columns: str) -> DataFrame:
    return landed_table(spark, source, kind).select(*columns, F.col("_metadata.file_path").alias("file"))


def _touched(spark: SparkSession, source: str, orders: DataFrame) -> DataFrame:
    """Kind, file and month of all rows that belong to ``orders`` (order_id, month, file)."""
    own = orders.select(F.lit("orders").alias("kind"), "file", "month")
    parts = [_with_file(spark, source, kind, KEY).join(orders.select(KEY, "month"), KEY)
             .select(F.lit(kind).alias("kind"), "file", "month") for kind in FACTS[1:]]
    return reduce(DataFrame.unionByName, parts, own).distinct()


def _stale_months(spark: SparkSession, source: str, changed: DataFrame, gone: DataFrame, touched: DataFrame,
                  orders: DataFrame) -> list[str]:
    """The months of changed and missing files, as they were and as they are. One value a month comes to the driver."""
    before = touched.join(changed.unionByName(gone), ["kind", "file"], "left_semi").select("month")
    now = orders.join(changed.where("kind = 'orders'").select("file"), "file", "left_semi").select("month")
    rows = [_with_file(spark, source, kind, KEY).join(changed.where(F.col("kind") == kind).select("file"), "file", "left_semi")
            .select(KEY) for kind in FACTS[1:]]
    of_rows = orders.join(reduce(DataFrame.unionByName, rows).distinct(), KEY, "left_semi").select("month")
    return sorted(str(r[0]) for r in before.unionByName(now).unionByName(of_rows).distinct().collect())


def _remove(spark: SparkSession, *folders: str) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _partition(folder: str, month: str) -> str:
    return f"{folder}/months/{MONTH}={'__HIVE_DEFAULT_PARTITION__' if month == NO_MONTH else month}"


def refresh_mart(spark: SparkSession, source: str, folder: str) -> Refreshed:
    """Brings the mart in ``folder`` up to date with the tables landed in ``source`` (``write_tables`` or ``add_files``)."""
    files = settled(_files(spark, source))
    known = _manifest(spark, folder)
    if known is None:
        _remove(spark, f"{folder}/months")                  # no telling what it was built from
        known = files.limit(0), files.limit(0).select("kind", "file", F.current_date().alias("month"))
    old, touched = known
    same = files.join(old, ["kind", "file", "size", "time"], "left_semi").select("kind", "file")
    changed = settled(files.select("kind", "file").join(same, ["kind", "file"], "left_anti"))
    gone = settled(old.select("kind", "file").join(files, ["kind", "file"], "left_anti"))
    every = changed.unionByName(gone)
    n_changed = every.count()
    if not n_changed:
        return Refreshed((), (), 0)

    orders = _with_file(spark, source, "orders", KEY, MOMENT).select(KEY, _month().alias("month"), "file")
    tables = parquet_tables(spark, source)
    if whole := bool(every.where(F.col("kind").isin(*DIMENSIONS)).count()):
        months = sorted(str(r[0]) for r in touched.select("month").unionByName(orders.select("month")).distinct().collect())
    else:
        months = _stale_months(spark, source, changed, gone, touched, orders)
    stale = [F.lit(m).cast("date") for m in months]
    rebuilt, part = orders, tables
    if not whole:
        # Where all months are stale, no row would be left out by these joins, which move every item unreduced.
        rebuilt = orders.where(F.col("month").isin(*stale))
        ids = rebuilt.select(KEY).where(F.col(KEY).isNotNull()).distinct()
        part = tables.with_table(orders=tables.orders.where(_month().isin(*stale)),
                                 items=tables.items.join(ids, KEY, "left_semi"),
                                 reviews=tables.reviews.join(ids, KEY, "left_semi"))
    built = settled(order_master(part).withColumn(MONTH, month_of(MOMENT).cast("date")))
    (built.hint("rebalance", F.col(MONTH)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(MONTH).parquet(f"{folder}/months"))
    filled = {str(r[0]) for r in built.select(F.coalesce(MONTH, F.lit(NO_MONTH).cast("date"))).distinct().collect()}
    emptied = [m for m in months if m not in filled]
    # Writing month by month does not touch a month that no order is left in.
    _remove(spark, *[_partition(folder, m) for m in emptied])

    # Files that did not change keep what they touched, for an order may have left their month meanwhile.
    kept = touched.join(every, ["kind", "file"], "left_anti")
    now = settled(kept.unionByName(_touched(spark, source, rebuilt)).distinct())
    now.write.mode("overwrite").parquet(f"{folder}/manifest/touched")
    files.write.mode("overwrite").parquet(f"{folder}/manifest/files")
    return Refreshed(tuple(m for m in months if m in filled), tuple(emptied), n_changed)


def refreshed_mart(spark: SparkSession, folder: str) -> DataFrame:
    return read_mart(spark, f"{folder}/months")


def add_files(tables: Tables, source: str, *names: str) -> None:
    """Lands further rows of the named tables as new files."""
    for name in names:
        getattr(tables, name).write.mode("append").parquet(f"{source}/{name}")
