"""Version pairs and accepted files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def version_pairs(snapshots: DataFrame, doc: str = "doc_id", version: str = "version") -> DataFrame:
    """Latest version and the one before it per document; `side` is `new` or `old`.

    Versions are made distinct before they are ranked, and Spark keeps only the top two of each
    map task's rows per document, so a document with very many rows costs one row per version.
    """
    latest = Window.partitionBy(doc).orderBy(F.col(version).desc())
    ranked = snapshots.select(doc, version).distinct().withColumn("rn", F.row_number().over(latest)).filter("rn <= 2")
    sides = ranked.select(doc, version, F.when(F.col("rn") == 1, "new").otherwise("old").alias("side"))
    return snapshots.join(sides, [doc, version])


def route_files(manifest: DataFrame, path: str, suffix: str = ".pdf") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by a suffix, whatever its case."""
    fits = F.coalesce(F.endswith(F.lower(path), F.lit(suffix.lower())), F.lit(False))
    return manifest.filter(fits), manifest.filter(~fits)
