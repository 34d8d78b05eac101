"""Versioned index tables and data-set snapshots."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from vocarium.operators.indexing import orderless_digest
from vocarium.schemas import GENERATIONS


def read_generations(spark: SparkSession, root: str) -> DataFrame:
    """Current state of every generation: its last manifest row, the later status at equal times."""
    rows = spark.read.schema(GENERATIONS).parquet(f"{root}/manifest")
    newest = rows.groupBy("id").agg(F.max_by(
        F.struct(*[c for c in rows.columns if c != "id"]), F.struct("activated_at", "status")).alias("g"))
    return newest.select("id", "g.*")


def active_generation(generations: DataFrame) -> DataFrame:
    """Newest generation that is active."""
    return generations.filter("status = 'active'").orderBy(F.desc("id")).limit(1)


def publish(spark: SparkSession, root: str, points: DataFrame, generation_id: int, name: str, config_hash: str,
            expected: int) -> int:
    """Write an isolated index table, check its count, then make it the active generation.

    Readers follow the manifest, so they see the old table until the new row is there. With that row
    the generations that were active are retired; their tables stay for a rollback. A count that is
    not the expected one leaves the old generation active and raises.
    """
    path = f"{root}/gen={generation_id}"
    points.write.mode("overwrite").parquet(path)
    written = spark.read.parquet(path).count()
    status = "active" if written == expected else "failed"
    row = spark.range(1).select(
        F.lit(generation_id).cast("bigint").alias("id"), F.lit(name).alias("name"), F.lit(status).alias("status"),
        F.lit(path).alias("path"), F.lit(config_hash).alias("config_hash"),
        F.lit(expected).cast("bigint").alias("expected_chunks"), F.lit(written).cast("bigint").alias("indexed_chunks"),
        F.current_timestamp().alias("activated_at"))
    if status == "active" and (others := active_others(spark, root, generation_id)) is not None:
        row = row.unionByName(others.withColumns({"status": F.lit("retired"), "activated_at": F.current_timestamp()}))
    row.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    if status == "failed":
        raise ValueError(f"generation {generation_id} holds {written} points, expected {expected}")
    return written


def active_others(spark: SparkSession, root: str, generation_id: int) -> DataFrame | None:
    """Manifest rows of the other active generations; None before the first publication."""
    try:
        known = read_generations(spark, root)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return known.filter((F.col("status") == "active") & (F.col("id") != generation_id))


def read_active(spark: SparkSession, root: str) -> DataFrame:
    """Index table of the active generation."""
    row = active_generation(read_generations(spark, root)).select("path").head()
    if row is None:
        raise ValueError(f"no active generation below {root}")
    return spark.read.parquet(row["path"])


def snapshot(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count and order-free digest of every table."""
    out = None
    for name, df in tables.items():
        row = orderless_digest(df).withColumn("table", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def validate_snapshot(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """All differences between two snapshots; empty when they agree."""
    a = expected.select("table", F.struct("rows", "hash_xor", "hash_sum").alias("want"))
    b = actual.select("table", F.struct("rows", "hash_xor", "hash_sum").alias("got"))
    problem = (
        F.when(F.col("got").isNull(), "table missing").when(F.col("want").isNull(), "table unexpected")
        .when(F.col("got.rows") != F.col("want.rows"), "row count differs")
        .when(~F.col("got").eqNullSafe(F.col("want")), "content differs"))
    return a.join(b, "table", "full_outer").select("table", problem.alias("problem")).filter("problem IS NOT NULL")
