"""The formula report: extraction, images, cache and guidance in one pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import tex
from paperloom.operators.lookup import cached_formulas, match_images, unreferenced


def extracted(documents: DataFrame) -> DataFrame:
    """Formulas of LaTeX texts (file_id, latex_text): a row each, with pos and hash (null for graphics)."""
    rows = documents.select("file_id", F.posexplode(tex.formulas(F.col("latex_text"))).alias("pos", "f")).select("file_id", "pos", "f.*")
    return rows.withColumn("hash", F.when(F.col("latex") != "", tex.formula_hash(F.col("latex"))))


def formula_report(documents: DataFrame, media: DataFrame, cache: DataFrame) -> DataFrame:
    """All formulas of the texts with image, status, cached and guidance, and the media that none refers to.

    No LaTeX program is called: a formula that isn't in the cache (hash, path, exists) is source_only. Graphics without
    LaTeX have no status; images of their own are image_only with status fallback_image.
    """
    found = match_images(extracted(documents), media)
    known = cached_formulas(found, cache).withColumn("status", F.when(F.col("hash").isNotNull(), F.col("status"))).withColumn("cached", F.coalesce(F.col("cached") & F.col("hash").isNotNull(), F.lit(False)))
    alone = unreferenced(media, found).select("file_id", F.lit("image_only").alias("type"), F.lit("").alias("latex"), F.col("filename").alias("image_filename"), F.lit("fallback_image").alias("status"), F.lit(False).alias("cached"))
    return known.unionByName(alone, allowMissingColumns=True).withColumn("guidance", F.when(F.col("status").isNotNull(), tex.guidance(F.col("status"))))


def updated_cache(cache: DataFrame, compiled: DataFrame) -> DataFrame:
    """The cache index with newly compiled formulas (hash, path, latex, size, created_at); the newest entry of a hash stays."""
    new = compiled.select("hash", "path", F.substring("latex", 1, 50).alias("latex_preview"), "created_at", "size", F.lit(True).alias("exists"))
    both = cache.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c != "hash"]
    return both.groupBy("hash").agg(F.max_by(F.struct(*rest), F.coalesce("created_at", F.lit("1970-01-01").cast("timestamp"))).alias("e")).select("hash", "e.*")


def purge_cache(spark: SparkSession, path: str) -> None:
    """Empty the cache index stored at ``path``; its columns stay."""
    columns = spark.read.parquet(path).schema
    spark.createDataFrame([], columns).write.mode("overwrite").parquet(path)
