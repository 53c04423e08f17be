"""The six input tables: their schemas, and readers for CSV and Parquet."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

ORDER_MOMENTS = (
    "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
    "order_delivered_customer_date", "order_estimated_delivery_date",
)

# Spellings that a CSV field counts as missing (the documented pandas defaults).
MISSING_SPELLINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Types of the columns the operators use. Any other column of a file is kept as text. Moments are read as
# text too and cast afterwards, so that a bad one stops the job instead of going missing.
CSV_COLUMNS = {
    "orders": {"order_id": "string", "order_status": "string", **{c: "string" for c in ORDER_MOMENTS}},
    "items": {"order_id": "string", "order_item_id": "int", "product_id": "string", "seller_id": "string",
              "price": "double", "freight_value": "double"},
    "reviews": {"review_id": "string", "order_id": "string", "review_score": "int",
                "review_comment_message": "string"},
    "products": {"product_id": "string", "product_category_name": "string"},
    "translation": {"product_category_name": "string", "product_category_name_english": "string"},
    "sellers": {"seller_id": "string", "seller_state": "string"},
}


@dataclass(frozen=True)
class Tables:
    orders: DataFrame
    items: DataFrame
    reviews: DataFrame
    products: DataFrame
    translation: DataFrame
    sellers: DataFrame

    def named(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def with_table(self, **changes: DataFrame) -> Tables:
        return replace(self, **changes)


def missing_to_null(df: DataFrame) -> DataFrame:
    """NULL in every text column for each spelling of a missing value."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(*MISSING_SPELLINGS), F.col(c)) for c in texts})


def read_csv(spark: SparkSession, path: str, columns: dict[str, str], multi_line: bool = False,
             strict: bool = True) -> DataFrame:
    """CSV files with a header and doubled quotes inside quoted fields, columns found by name.

    Only a header line is read ahead, never the data: types come from ``columns``. Every file must have that header.
    ``multi_line`` lets quoted text span lines; such a file cannot be split, so only the reviews use it, and a large
    delivery of them must come as many files. All fields are read as text, so that a missing value's spelling is not
    taken for a bad number. Strict: a bad number or a row with too few or too many fields stops the job.
    Otherwise ``bad_fields`` lists the columns that became NULL, with ``row`` where the number of fields is off.
    """
    layout = {"header": True, "quote": '"', "escape": '"'}
    header = spark.read.options(**layout).csv(path).columns
    absent = sorted(set(columns) - set(header))
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    schema = ", ".join(f"`{c}` string" for c in header)
    reader = spark.read.options(**layout, multiLine=multi_line, enforceSchema=False, columnPruning=False)
    if strict:
        rows = missing_to_null(reader.schema(schema).option("mode", "FAILFAST").csv(path))
        return rows.withColumns({c: F.col(c).cast(t) for c, t in columns.items() if t != "string"})
    rows = missing_to_null(reader.schema(f"{schema}, _bad_row string")
                           .option("columnNameOfCorruptRecord", "_bad_row").csv(path))
    numbers = {c: F.col(c).try_cast(t) for c, t in columns.items() if t != "string"}
    bad = [F.when(F.col(c).isNotNull() & number.isNull(), F.lit(c)) for c, number in numbers.items()]
    return (rows.withColumn("bad_fields", F.array_compact(F.array(*bad, F.when(F.col("_bad_row").isNotNull(), "row"))))
            .withColumns(numbers).drop("_bad_row"))


def parse_moments(df: DataFrame, columns=ORDER_MOMENTS, strict: bool = True) -> DataFrame:
    """Text to timestamps without a zone. Strict: a bad value stops the job. Otherwise it becomes NULL
    and ``bad_moments`` lists the columns it stood in."""
    if strict:
        return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})
    parsed = {c: F.col(c).try_cast("timestamp_ntz") for c in columns}
    bad = [F.when(F.col(c).isNotNull() & parsed[c].isNull(), F.lit(c)) for c in columns]
    return df.withColumn("bad_moments", F.array_compact(F.array(*bad))).withColumns(parsed)


def csv_tables(spark: SparkSession, files: dict[str, str], strict: bool = True) -> Tables:
    """The tables from CSV files; ``files`` gives a path (file, folder or glob) for each table name."""
    found = {name: read_csv(spark, files[name], columns, multi_line=name == "reviews", strict=strict)
             for name, columns in CSV_COLUMNS.items()}
    found["orders"] = parse_moments(found["orders"], strict=strict)
    return Tables(**found)


def write_tables(tables: Tables, folder: str) -> None:
    """Land the tables as Parquet, once, so that later jobs get splits, pruning and pushed filters."""
    for name, df in tables.named().items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def landed_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One landed table, narrowed to the columns the operators use."""
    path = f"{folder.rstrip('/')}/{name}"
    columns = ", ".join(f"{c} {'timestamp_ntz' if c in ORDER_MOMENTS else t}" for c, t in CSV_COLUMNS[name].items())
    return spark.read.schema(columns).parquet(path)


def parquet_tables(spark: SparkSession, folder: str) -> Tables:
    """The landed tables, narrowed to the columns the operators use."""
    return Tables(**{name: landed_table(spark, folder, name) for name in CSV_COLUMNS})


# Parquet read by the newer source, which answers counts from the files' footers.
FROM_FOOTERS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


@contextmanager
def counting_from_footers(spark: SparkSession) -> Iterator[None]:
    """Session options under which a count of a Parquet table reads no row, put back afterwards. Tables must be opened and
    counted inside."""
    before = {key: spark.conf.get(key) for key in FROM_FOOTERS}
    for key, value in FROM_FOOTERS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def footer_profile(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Rows and columns of each Parquet table (a path for each name), from footers alone. One number a table comes to the
    driver; all tables are counted in one job. (A table without a row has no footer to count.)"""
    with counting_from_footers(spark):
        opened = {name: spark.read.parquet(path) for name, path in files.items()}
        counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
                  for name, df in opened.items()]
        found = {r["table_name"]: r["n_rows"] for r in reduce(DataFrame.unionByName, counts).collect()}
    return spark.createDataFrame([(name, found[name] or 0, len(df.columns)) for name, df in opened.items()],
                                 "table_name string, n_rows bigint, n_columns int")


def region_codes(spark: SparkSession, path: str) -> DataFrame:
    """One ``seller_state`` row per feature of a GeoJSON file; shapes are not read."""
    schema = "features array<struct<properties: struct<sigla: string>>>"
    return (spark.read.schema(schema).option("multiLine", True).json(path)
            .select(F.explode("features").alias("f"))
            .select(F.col("f.properties.sigla").alias("seller_state")))
