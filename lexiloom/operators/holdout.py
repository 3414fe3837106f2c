"""The held-out draw: a seeded, stratified choice of leaves."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom import policy
from lexiloom.functions.prng import Stream, permutation
from lexiloom.functions.text import folio_of


def leaves(pages: DataFrame) -> DataFrame:
    """folio and stratum, section/language of the leaf's first page, with ``?`` for what is unset."""
    name = F.concat_ws("/", F.coalesce("illustration_type", F.lit("?")), F.coalesce("currier_language", F.lit("?")))
    rows = pages.select(folio_of(F.col("name")).alias("folio"), "seq", name.alias("stratum"))
    return rows.groupBy("folio").agg(F.min_by("stratum", "seq").alias("stratum"))


def _choose(batches):
    for batch in batches:
        out = []
        for folios, seed, start, n in zip(*(batch.column(c).to_pylist() for c in ("folios", "seed", "start", "n")), strict=True):
            order = permutation(len(folios), Stream(seed, start))
            out.append([folios[k] for k in order[:n]])
        yield pa.RecordBatch.from_arrays([batch.column("stratum"), pa.array(out, pa.list_(pa.string()))], ["stratum", "chosen"])


def draw(pages: DataFrame, seed: int = policy.HOLDOUT_SEED, fraction: float = policy.HOLDOUT_FRACTION) -> DataFrame:
    """stratum and folio of the leaves held out.

    Strata take their draws from one stream in sorted order. A permutation of n
    takes n - 1, so that each stratum knows where it starts, and all are drawn in
    parallel; the exchanges of one are a chain and stay together.
    """
    strata = leaves(pages).groupBy("stratum").agg(F.array_sort(F.collect_list("folio")).alias("folios"))
    before = Window.partitionBy(F.lit(0)).orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)  # a row a stratum
    strata = strata.withColumn("start", F.coalesce(F.sum(F.size("folios") - 1).over(before), F.lit(0)).cast("long"))
    strata = strata.withColumn("n", F.floor(F.size("folios") * F.lit(fraction) + 0.5).cast("int")).withColumn("seed", F.lit(seed).cast("long"))
    chosen = strata.mapInArrow(_choose, "stratum string, chosen array<string>")
    return chosen.select("stratum", F.explode("chosen").alias("folio"))


def held_pages(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """The pages of the chosen leaves."""
    return pages.withColumn("folio", folio_of(F.col("name"))).join(chosen.select("folio"), "folio", "left_semi")


def freeze(path: str, chosen: DataFrame, seed: int = policy.HOLDOUT_SEED, fraction: float = policy.HOLDOUT_FRACTION, at: str | None = None) -> dict:
    """Write the record of a draw once; later calls verify it and refuse another draw."""
    folios = sorted(r["folio"] for r in chosen.select("folio").collect())
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            record = json.load(f)
        if (record["seed"], record["fraction"], record["folios"]) != (seed, fraction, folios):
            raise ValueError("the frozen held-out set differs from this draw")
        return record
    record = {"seed": seed, "fraction": fraction, "folios": folios, "frozen_at": at or datetime.now(UTC).isoformat()}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(record, f, indent=2)
        f.write("\n")
    return record
