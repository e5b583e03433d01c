"""The job table: url, actual_url, previsiting_done, all_done, ord."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest height of a page that is measured without a warning.
MAX_HEIGHT = 2**13.5


def first_of(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Of equal keys the row that comes first (J1, J2). Partial aggregation keeps one row a key and task."""
    rest = [c for c in df.columns if c != key]
    made = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return made.select(*[F.col("_r")[c].alias(c) if c != key else F.col(key) for c in df.columns])


def create_jobs(urls: DataFrame) -> DataFrame:
    """Jobs for distinct URLs (url, ord)."""
    return first_of(urls.select("url", "ord"), "url").select("url", F.lit(None).cast("string").alias("actual_url"), F.lit(False).alias("previsiting_done"), F.lit(False).alias("all_done"), "ord")


def update(jobs: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs with the changes' non-null values by url, and the changes whose url is unknown."""
    fields = [c for c in changes.columns if c != "url"]
    new = changes.select("url", *[F.col(c).alias(f"_{c}") for c in fields])
    made = jobs.join(new, "url", "left").select(*[F.coalesce(F.col(f"_{c}"), jobs[c]).alias(c) if c in fields else jobs[c] if c != "url" else F.col("url") for c in jobs.columns])
    return made, changes.join(jobs.select("url"), "url", "left_anti")


def remove(jobs: DataFrame, urls: DataFrame) -> DataFrame:
    return jobs.join(urls.select("url"), "url", "left_anti")


def pending_previsits(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.col("previsiting_done"))


def next_job(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.col("all_done")).orderBy("ord", "url").limit(1)


def progress(jobs: DataFrame) -> DataFrame:
    """How many jobs are open and done, and whether all are."""
    return jobs.agg(F.count_if(~F.col("all_done")).alias("n_open"), F.count_if("all_done").alias("n_done"), F.coalesce(F.bool_and("all_done"), F.lit(True)).alias("finished"))


def drop_failed(pages: DataFrame, status: str = "status") -> DataFrame:
    return pages.where(F.coalesce(F.col(status), F.lit(0)) < 400)


def warnings(scroll_height: Column, scroll_width: Column, width: Column, height: Column, framesets: Column) -> dict[str, Column]:
    return {"too_high": scroll_height > MAX_HEIGHT, "too_wide": scroll_width > width, "too_low": scroll_height < height + 5, "has_frameset": framesets > 0}


def reset(jobs: DataFrame, hosts: DataFrame) -> DataFrame:
    """Jobs whose URL's host is listed are open again."""
    from lumeno.functions.text import url_host

    marked = jobs.withColumn("_h", url_host(F.col("url"))).join(hosts.select(F.col("host").alias("_h"), F.lit(True).alias("_hit")).distinct(), "_h", "left")
    return marked.withColumn("all_done", F.col("all_done") & F.col("_hit").isNull()).select(*jobs.columns)


def resume(work: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """Work that has no output yet."""
    return work.join(done.select(key), key, "left_anti")


def sample_first(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group (O6: deterministic)."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_k") <= n).drop("_k")
