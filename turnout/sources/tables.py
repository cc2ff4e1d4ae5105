"""Schemas, readers, sinks and foreign-key checks for the eight input tables."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.functions.scalars import denan

# What the columns of each input resource are called and hold.
SCHEMAS = {
    "users": "user_id STRING, email STRING, phone STRING, first_name STRING, last_name STRING, "
    "city STRING, has_membership BOOLEAN",
    "profile": "user_id STRING, use_rate DOUBLE",
    "history": "user_id STRING, type STRING, created_at TIMESTAMP, used BOOLEAN, date_used TIMESTAMP",
    "social": "user_id STRING, friends_count INT",
    "artists": "artist_id STRING, artist_name STRING",
    "events": "event_id STRING, artist_id STRING, artist_name STRING, title STRING, month STRING, "
    "starts_at TIMESTAMP, capacity INT, venue STRING, city STRING, weekday STRING, "
    "is_residency BOOLEAN, is_paid BOOLEAN",
    "sales": "sale_id STRING, buyer_email STRING, buyer_phone STRING, buyer_name STRING, "
    "channel STRING, qty INT, purchased_at TIMESTAMP",
    "tickets": "ticket_id STRING, sale_id STRING, event_id STRING, ticket_type STRING, price DOUBLE, "
    "checked_in BOOLEAN, checked_in_at TIMESTAMP",
}

# Foreign keys, child(column) -> parent(column).
FOREIGN_KEYS = [
    ("tickets", "sale_id", "sales", "sale_id"),
    ("tickets", "event_id", "events", "event_id"),
    ("history", "user_id", "users", "user_id"),
]


@dataclass
class Tables:
    """The input tables as DataFrames; only the first five are needed by the pipeline."""

    users: DataFrame
    history: DataFrame
    events: DataFrame
    sales: DataFrame
    tickets: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.extra[name] if name in self.extra else getattr(self, name)

    def register(self, prefix: str = "") -> None:
        """Expose every table to SQL as a temporary view."""
        for name in ("users", "history", "events", "sales", "tickets", *self.extra):
            self[name].createOrReplaceTempView(prefix + name)


def read_json(
    spark: SparkSession, name: str, path: str, rename: dict[str, str] | None = None
) -> DataFrame:
    """Scan one raw resource: a file or folder of JSON arrays or JSON lines.

    `rename` maps our column names to those used in the files, so that a schema is
    always applied and nothing is inferred.
    """
    rename = rename or {}
    parts = [c.strip().split(" ", 1) for c in SCHEMAS[name].split(", ")]
    ddl = ", ".join(f"`{rename.get(c, c)}` {t}" for c, t in parts)
    multiline = not path.rstrip("/").endswith((".jsonl", ".ndjson"))
    raw = spark.read.schema(ddl).json(path, multiLine=multiline)
    cols = []
    for c, t in parts:
        src = F.col(f"`{rename.get(c, c)}`")
        cols.append((denan(src) if t == "DOUBLE" else src).alias(c))
    return raw.select(*cols)


def snapshot(
    spark: SparkSession, name: str, source: str, folder: str, force: bool = False,
    rename: dict[str, str] | None = None,
) -> DataFrame:
    """Materialise a raw resource once as Parquet; reuse the snapshot unless forced."""
    target = os.path.join(folder, name)
    df = read_json(spark, name, source, rename)
    df.write.mode("overwrite" if force else "ignore").parquet(target)
    return spark.read.schema(SCHEMAS[name]).parquet(target)


def load_snapshot(spark: SparkSession, folder: str) -> Tables:
    got = {}
    for name, ddl in SCHEMAS.items():
        got[name] = spark.read.schema(ddl).parquet(os.path.join(folder, name))
    core = {k: got.pop(k) for k in ("users", "history", "events", "sales", "tickets")}
    return Tables(**core, extra=got)


def read_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Typed scan of an earlier stage's deliverable."""
    return spark.read.schema(ddl).csv(path, header=True)


def write_csv(df: DataFrame, path: str, columns: dict[str, str] | None = None) -> None:
    """Deliverable with a header; `columns` maps output names to ours, in order."""
    if columns:
        df = df.select(*[F.col(ours).alias(name) for name, ours in columns.items()])
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_document(doc: DataFrame, path: str) -> None:
    """Write the rows of a one-column text DataFrame, one JSON document per row."""
    doc.write.mode("overwrite").text(path)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child keys without a parent, with the number of child rows behind each.

    The child is reduced to distinct keys before the join, so a hot key costs one row.
    """
    keys = child.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
    owners = parent.select(F.col(parent_key).alias("key"))
    return keys.join(owners, "key", "left_anti")


def fk_violations(t: Tables) -> DataFrame:
    """One row per foreign key: distinct dangling keys and child rows behind them."""
    out = None
    for child, key, parent, pkey in FOREIGN_KEYS:
        one = (
            dangling(t[child], key, t[parent], pkey)
            .agg(F.count(F.lit(1)).alias("dangling_keys"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("dangling_rows"))
            .select(F.lit(child).alias("child"), F.lit(key).alias("fk"), F.lit(parent).alias("parent"),
                    "dangling_keys", "dangling_rows")
        )
        out = one if out is None else out.unionByName(one)
    return out


def require_no_dangling(t: Tables) -> None:
    """Fail loudly, naming the relation, when a ticket points nowhere."""
    for child, key, parent, pkey in FOREIGN_KEYS[:2]:
        bad = dangling(t[child], key, t[parent], pkey).limit(3).collect()
        if bad:
            raise ValueError(f"{child}.{key} without {parent}: {[r['key'] for r in bad]} ...")
