"""Tables as Parquet directories or JDBC tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def parquet_tables(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    """name -> the table folder/name.parquet, read lazily; a table's schema is read once."""
    held: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name not in held:
            held[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        return held[name]

    return get


def jdbc_tables(spark: SparkSession, url: str, partitions: dict[str, tuple[str, int, int, int]] | None = None, **options: str) -> Callable[[str], DataFrame]:
    """name -> a table of a database. partitions: table -> (column, lower, upper, count) for parallel reads."""

    def get(name: str) -> DataFrame:
        reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
        if partitions and name in partitions:
            column, lower, upper, count = partitions[name]
            reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=count)
        return reader.load()

    return get


def schemas(tables: Callable[[str], DataFrame], names: Iterable[str]) -> dict:
    return {n: tables(n).schema for n in names}


def jdbc_declaration(spark: SparkSession, url: str, names: Iterable[str], catalog: str | None = None, schema: str | None = None, **options: str) -> dict[str, Any]:
    """What a database says of its tables' keys and of columns that it fills itself, in the form of a catalog's declaration."""
    jvm = spark._jvm
    properties = jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        meta = connection.getMetaData()

        def rows(found: Any, *columns: str) -> list[tuple[str | None, ...]]:
            out = []
            while found.next():
                out.append(tuple(found.getString(c) for c in columns))
            found.close()
            return out

        tables: dict[str, Any] = {}
        for name in names:
            primary = rows(meta.getPrimaryKeys(catalog, schema, name), "KEY_SEQ", "COLUMN_NAME")
            keys: dict[str, dict[str, Any]] = {}
            for key, parent, _, own, other in sorted(rows(meta.getImportedKeys(catalog, schema, name), "FK_NAME", "PKTABLE_NAME", "KEY_SEQ", "FKCOLUMN_NAME", "PKCOLUMN_NAME"), key=lambda r: (r[0] or "", int(r[2]))):
                one = keys.setdefault(key or f"{name}_{own}", {"name": key or f"{name}_{own}", "columns": [], "references": parent, "ref_columns": []})
                one["columns"].append(own)
                one["ref_columns"].append(other)
            columns: dict[str, dict[str, Any]] = {}
            for column, auto, default, generated in rows(meta.getColumns(catalog, schema, name, "%"), "COLUMN_NAME", "IS_AUTOINCREMENT", "COLUMN_DEF", "IS_GENERATEDCOLUMN"):
                if auto == "YES":
                    columns[column] = {"auto_increment": True}
                elif generated == "YES":
                    columns[column] = {"generated": True}
                elif default is not None:
                    columns[column] = {"default": default.strip("'")}
            tables[name] = {"primary_key": [c for _, c in sorted(primary, key=lambda r: int(r[0]))], "foreign_keys": list(keys.values()), "columns": columns}
        return {"tables": tables}
    finally:
        connection.close()
