"""Orders, items and reviews landed in buckets of ``order_id``, so that the order mart needs no shuffle and no sort on it.

Each bucket is one file sorted by ``order_id``: the roll-ups and the joins to the orders run where the files are
read. A bucket is never split, so an order that holds more than ``most_rows`` items or reviews is landed apart, with
all its rows, in tables without buckets; there its partial aggregates are merged as usual. Rows without an order id
go there too. Every order lies on one of the two sides, so the mart is the union of theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from starling.plans.master import order_master
from starling.session import settled
from starling.sources.tables import Tables

KEY = "order_id"
BUCKETED, PLAIN = ("orders", "items", "reviews"), ("products", "translation", "sellers")
#: An order with more items or reviews than this is landed apart from the buckets.
MOST_ROWS = 100_000
#: Rows of a table that a bucket holds on average, at most: a task sorts and joins them at some 220 bytes each.
BUCKET_ROWS = 2_000_000

LAYOUT = "buckets int, n_crowded bigint, columns map<string, string>"

# A bucket is one sorted file: the scan may say so, and aggregates may rely on the order instead of hashing it away.
ORDERED_SCAN = {
    "spark.sql.sources.bucketing.enabled": "true",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.execution.replaceHashWithSortAgg": "true",
}


def crowded_orders(tables: Tables, most_rows: int = MOST_ROWS) -> DataFrame:
    """``order_id`` of the orders with more than ``most_rows`` items or reviews."""
    def beyond(df):
        return (df.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
                .where(F.col("n") > most_rows).select(KEY))
    return beyond(tables.items).unionByName(beyond(tables.reviews)).distinct()


def _files(folder: str, side: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{side}/{name}"


def _table(path: str) -> str:
    """The catalog's name for the table in ``path``."""
    return "bucketed_" + hashlib.md5(path.encode()).hexdigest()


def bucket_count(tables: Tables, least: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """How many buckets the tables need so that one of them fits a task however large they are, but at least ``least``."""
    return max(least, *[-(-getattr(tables, name).count() // bucket_rows) for name in BUCKETED])


def land_bucketed(tables: Tables, folder: str, buckets: int, most_rows: int = MOST_ROWS) -> None:
    """Writes the six tables under ``folder``. Choose ``buckets`` so that one of them fits a task with ease: ``bucket_count``."""
    spark = tables.orders.sparkSession
    crowded = settled(crowded_orders(tables, most_rows))
    for name in BUCKETED:
        df = getattr(tables, name)
        # As many shuffle partitions as buckets, by the same hash: each task writes the one file of its bucket.
        apart = df.join(crowded, KEY, "left_anti").where(F.col(KEY).isNotNull()).repartition(buckets, KEY)
        path = _files(folder, "bucketed", name)
        spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")
        (apart.select(*df.columns).write.mode("overwrite").bucketBy(buckets, KEY).sortBy(KEY)
         .option("path", path).saveAsTable(_table(path)))
        (df.join(crowded, KEY, "left_semi").unionByName(df.where(F.col(KEY).isNull())).select(*df.columns)
         .write.mode("overwrite").parquet(_files(folder, "apart", name)))
    for name in PLAIN:
        getattr(tables, name).write.mode("overwrite").parquet(_files(folder, "plain", name))
    # An empty table leaves no file that would tell its columns.
    columns = {name: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in getattr(tables, name).schema)
               for name in BUCKETED}
    (spark.createDataFrame([(buckets, crowded.count(), columns)], LAYOUT).coalesce(1).write.mode("overwrite")
     .parquet(_files(folder, "plain", "layout")))


def bucketed_parts(spark: SparkSession, folder: str) -> list[Tables]:
    """The landed tables as one set, or as two with disjoint orders: those in buckets, and those landed apart if there
    are any. Known to the session's catalog as temporary entries; sets the session's ``ORDERED_SCAN``."""
    for key, value in ORDERED_SCAN.items():
        spark.conf.set(key, value)
    layout = spark.read.parquet(_files(folder, "plain", "layout")).first()
    plain = {name: spark.read.parquet(_files(folder, "plain", name)) for name in PLAIN}

    def in_buckets(name: str) -> DataFrame:
        path = _files(folder, "bucketed", name)
        spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")                      # the entry; files stay
        spark.sql(f"CREATE TABLE {_table(path)} ({layout['columns'][name]}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) "
                  f"INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
        return spark.table(_table(path))

    parts = [Tables(**plain, **{name: in_buckets(name) for name in BUCKETED})]
    if layout["n_crowded"]:
        parts.append(Tables(**plain, **{name: spark.read.parquet(_files(folder, "apart", name)) for name in BUCKETED}))
    return parts


def order_master_of(parts: Sequence[Tables], salts: int = 1) -> DataFrame:
    """The order mart over parts with disjoint orders."""
    return reduce(DataFrame.unionByName, (order_master(part, salts) for part in parts))
