"""Reference tables and page rows stored once, bucketed by the key that every run joins them on.

A run that loads them exchanges its own side only: the stored side is read bucket by bucket, sorted by its key.  The
number of buckets is part of a table's folder name, so a second session finds tables and layout without a metastore of
its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import flow

#: The bucket column of each table of :class:`flow.References`.
REFERENCE_KEYS = {"sensitive": "norm", "entities": "norm", "vn": "norm", "routing": "key", "translations": "src"}


class BucketedTables:
    """Bucketed Parquet tables below one folder; ``name`` keeps the tables of several stores apart in the catalog."""

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int | None = None):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _at(self, table: str) -> tuple[str, str]:
        return f"{self.name}_{table}_{self.buckets}", f"{self.path}/{table}-{self.buckets}"

    def save(self, table: str, df: DataFrame, key: str, *sort: str) -> None:
        name, path = self._at(table)
        self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")  # an external table: its files stay until they are overwritten
        # one task per bucket, so a bucket is one sorted file
        (df.repartition(self.buckets, key).write.mode("overwrite").option("path", path)
         .bucketBy(self.buckets, key).sortBy(key, *sort).saveAsTable(name))

    def load(self, table: str, key: str, *sort: str) -> DataFrame | None:
        """The stored table, or None where it was never saved."""
        name, path = self._at(table)
        if not self.spark.catalog.tableExists(name):
            try:
                schema = self.spark.read.parquet(path).schema
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                return None
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            self.spark.sql(f"CREATE TABLE `{name}` ({columns}) USING parquet CLUSTERED BY (`{key}`) "
                           f"SORTED BY ({', '.join(f'`{c}`' for c in (key, *sort))}) INTO {self.buckets} BUCKETS "
                           f"LOCATION '{path}'")
        return self.spark.table(name)


def stored_references(tables: BucketedTables, build, canonical: dict[str, str] | None = None) -> flow.References:
    """The references below ``tables``; ``build()`` is called only where they were never saved."""
    found = {t: tables.load(t, key) for t, key in REFERENCE_KEYS.items()}
    if any(df is None for t, df in found.items() if t != "translations"):
        refs = build()
        for t, key in REFERENCE_KEYS.items():
            if (df := getattr(refs, t)) is not None:
                tables.save(t, df, key)
        found = {t: tables.load(t, key) for t, key in REFERENCE_KEYS.items()}
        canonical = canonical or refs.canonical
    return flow.References(**found, canonical=canonical)


def save_pages(tables: BucketedTables, page_signals: DataFrame, page_fields: DataFrame) -> None:
    """Readings of a run, bucketed by bundle and sorted by page."""
    tables.save("page_signals", page_signals, "pdf_id", "page_idx")
    tables.save("page_fields", page_fields, "pdf_id", "page_idx")


def load_pages(tables: BucketedTables) -> tuple[DataFrame | None, DataFrame | None]:
    return tables.load("page_signals", "pdf_id", "page_idx"), tables.load("page_fields", "pdf_id", "page_idx")
