"""Records of jobs as JSON files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

JOBS = "job_id STRING, status STRING, progress DOUBLE, created_at STRING, started_at STRING, completed_at STRING, error STRING, results STRING"
TIMES = ("created_at", "started_at", "completed_at")


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs of JSON files; what is no job record is left out."""
    rows = spark.read.schema(JOBS).option("mode", "DROPMALFORMED").option("multiLine", "true").json(path).where("job_id IS NOT NULL")
    return rows.withColumns({t: F.try_to_timestamp(F.col(t)) for t in TIMES})


def write_finished(jobs: DataFrame, path: str) -> None:
    """Completed and failed jobs, a folder a status."""
    jobs.where("status IN ('completed', 'failed')").write.mode("append").partitionBy("status").json(path)


def upserted(held: DataFrame, changes: DataFrame, now, hours: int = 24) -> DataFrame:
    """Held rows with changes (of the same columns, later ``updated_at``) laid over them; members that a change
    leaves null keep their value, rows not touched for ``hours`` go."""
    by = Window.partitionBy("job_id").orderBy(F.desc("updated_at"))
    all_ = held.unionByName(changes)
    rest = [c for c in held.columns if c not in ("job_id", "updated_at")]
    filled = all_.select("job_id", "updated_at", *(F.first(c, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing)).alias(c) for c in rest), F.row_number().over(by).alias("_n"))
    return filled.where((F.col("_n") == 1) & (F.col("updated_at") >= now - F.expr(f"INTERVAL {hours} HOURS"))).select(*held.columns)


def listed(jobs: DataFrame, status: str | None = None, most: int = 50) -> DataFrame:
    """The latest jobs, of one status if named, and how many there are of any (total). The limit is the feature: a page of a listing."""
    rows = jobs.where(F.col("status") == status) if status else jobs
    return rows.orderBy(F.desc("created_at"), "job_id").limit(most).withColumn("total", jobs.agg(F.count("*")).scalar())
