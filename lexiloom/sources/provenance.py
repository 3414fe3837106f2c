"""Registered source files, the gate before a read, and the store of relations.

The registry is a JSON file of a few entries, kept by the driver. Hashes are taken
by Spark from the bytes of the files, wherever they are stored.
"""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RegistryError(ValueError):
    """A source is missing, not registered, or not what was registered."""


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """file and the SHA-256 of its bytes."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))


def load_registry(path: str) -> list[dict]:
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def save_registry(path: str, entries: list[dict]) -> None:
    temporary = f"{path}.new"
    with open(temporary, "w", encoding="utf-8") as f:
        json.dump(sorted(entries, key=lambda e: e["path"]), f, indent=2, ensure_ascii=False)
        f.write("\n")
    os.replace(temporary, path)


def _hash(spark: SparkSession, source: str) -> str:
    try:
        found = file_hashes(spark, source).select("sha256").first()
    except Exception as error:
        raise RegistryError(f"no such source: {source}") from error
    if found is None:
        raise RegistryError(f"no such source: {source}")
    return found["sha256"]


def register(spark: SparkSession, registry: str, source: str, url: str, license: str, note: str | None = None, at: str | None = None) -> dict:
    """Add ``source`` to the registry, or replace its entry."""
    source = os.path.normpath(source)
    entry = {"path": source, "sha256": _hash(spark, source), "url": url, "downloaded_at": at or datetime.now(UTC).isoformat(), "license": license}
    entry |= {"note": note} if note else {}
    save_registry(registry, [e for e in load_registry(registry) if e["path"] != source] + [entry])
    return entry


def require_registered(spark: SparkSession, registry: str, source: str) -> dict:
    """The entry of ``source``; raises if it has none or its bytes have changed."""
    source = os.path.normpath(source)
    entry = next((e for e in load_registry(registry) if e["path"] == source), None)
    if entry is None:
        raise RegistryError(f"not registered: {source}")
    if _hash(spark, source) != entry["sha256"]:
        raise RegistryError(f"changed since it was registered: {source}")
    return entry


def save_relations(relations: dict[str, DataFrame], folder: str, meta: dict[str, str] | None = None) -> None:
    """Write every relation anew, and the metadata last, which marks the store as whole."""
    spark = next(iter(relations.values())).sparkSession
    for name, df in relations.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    rows = list((meta or {}).items()) + [("relations", ",".join(sorted(relations)))]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/ingest_meta")


def load_relations(spark: SparkSession, folder: str, views: bool = False) -> dict[str, DataFrame]:
    """The relations of a store; with ``views`` also as temporary views."""
    meta = read_meta(spark.read.parquet(f"{folder}/ingest_meta"))
    out = {name: spark.read.parquet(f"{folder}/{name}") for name in meta["relations"].split(",")}
    if views:
        for name, df in out.items():
            df.createOrReplaceTempView(name)
    return out


def read_meta(meta: DataFrame) -> dict[str, str]:
    """Key and value rows as one record."""
    row = meta.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m")).first()
    return dict(row["m"])


def run_ingest(spark: SparkSession, registry: str, source: str, folder: str) -> dict[str, str]:
    """Gate, parse, and replace the store; raises on any fault of the markup before anything is written."""
    from lexiloom.sources.markup import ingest, read_files

    entry = require_registered(spark, registry, source)
    parts = ingest(read_files(spark, source))
    fault = parts["errors"].orderBy("file", "line").first()
    if fault:
        raise RegistryError(f"line {fault['line']}: {fault['message']}")
    meta = {"source": entry["path"], "sha256": entry["sha256"]}
    save_relations({k: parts[k] for k in ("header", "pages", "loci", "tokens")}, folder, meta)
    return meta


def write_markdown(path: str, title: str, tables: dict[str, DataFrame], rows: int = 200) -> None:
    """Small result tables as one markdown file; of a table of more than ``rows`` rows the first are shown, and how many are not."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in df.limit(rows).collect()]
        more = max(0, df.count() - rows)
        out += [*(["", f"{more} more rows."] if more else []), ""]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(out))


def read_markdown(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The table under the heading ``name`` of a markdown file, as strings."""
    with open(path, encoding="utf-8") as f:
        lines = f.read().splitlines()
    at = lines.index(f"## {name}")
    rows = []
    for line in lines[at + 1 :]:
        if line.startswith("## "):
            break
        if line.startswith("|"):
            rows.append([x.strip() for x in line.strip("|").split("|")])
    return spark.createDataFrame(rows[2:], ", ".join(f"`{c}` string" for c in rows[0]))
