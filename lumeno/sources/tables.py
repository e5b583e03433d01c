"""Files in and out: URL lists, job tables, matrices, tab-separated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

JOBS = "array<struct<url:string,actualUrl:string,previsitingDone:boolean,allDone:boolean>>"


def urls_of(lines: DataFrame, column: str = "value") -> DataFrame:
    """URLs from lines: those that contain http, up to the first tab."""
    return lines.where(F.contains(F.col(column), F.lit("http"))).withColumn("url", F.substring_index(F.trim(F.col(column)), "\t", 1))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """url, ord of a list file; ord follows the lines."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("ord"))
    return urls_of(lines).select("url", "ord")


def jobs_text(jobs: DataFrame) -> DataFrame:
    """The job table as one human-editable text (K2): JSON with a tab for each ',"' and a line for each '},'. A report of one row; the jobs of a list are few."""
    rows = jobs.select("ord", F.struct("url", F.col("actual_url").alias("actualUrl"), F.col("previsiting_done").alias("previsitingDone"), F.col("all_done").alias("allDone")).alias("j"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", "j"))), lambda x: x["j"])
    return rows.agg(F.replace(F.replace(F.to_json(ordered), F.lit(',"'), F.lit("\t")), F.lit("},"), F.lit("\n")).alias("text"))


def parse_jobs(texts: DataFrame, column: str = "text") -> DataFrame:
    """The inverse of jobs_text (S3)."""
    json = F.replace(F.replace(F.col(column), F.lit("\n"), F.lit("},")), F.lit("\t"), F.lit(',"'))
    rows = texts.select(F.posexplode(F.from_json(json, JOBS)).alias("ord", "j"))
    return rows.select(F.col("j.url").alias("url"), F.col("j.actualUrl").alias("actual_url"), F.col("j.previsitingDone").alias("previsiting_done"), F.col("j.allDone").alias("all_done"), F.col("ord").cast("long").alias("ord"))


def write_tsv(df: DataFrame, path: str, by: str | None = None) -> None:
    """Tab-separated files with header, NA for null (K1); by: a folder for each value."""
    out = df.write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", "NA").option("emptyValue", "").option("quote", "")
    (out.partitionBy(by) if by else out).csv(path)


def tsv_lines(df: DataFrame, order: str) -> DataFrame:
    """ord, line of the table as the legacy export has it: the header, then the rows from last to first."""
    cols = [c for c in df.columns if c != order]
    line = F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), "\t")
    head = df.sparkSession.createDataFrame([(-1, "\t".join(cols))], "ord long, line string")
    return head.unionByName(df.select((F.lit(1 << 40) - F.col(order)).cast("long").alias("ord"), line.alias("line"))).orderBy("ord")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """metric, a_id, b_id, value of matrix files (S14): a header of element ids plus rowElId, NA on the diagonal. Matrices of fewer than three rows are dropped."""
    wide = spark.read.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)
    names = [c for c in wide.columns if c != "rowElId"]
    long = wide.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("metric"), "rowElId", *names).unpivot(["metric", "rowElId"], names, "b_id", "value")
    big = long.groupBy("metric").agg(F.count_distinct("rowElId").alias("n")).where("n >= 3").select("metric")
    return long.where(F.col("value").isNotNull()).join(big, "metric").select("metric", F.col("rowElId").alias("a_id"), "b_id", F.col("value").cast("double").alias("value"))


def primitive_sets(files: DataFrame, column: str = "path") -> DataFrame:
    """Distinct prefixes, up to the first _, of the names of .txt files."""
    name = F.substring_index(F.col(column), "/", -1)
    return files.where(F.endswith(name, F.lit(".txt"))).select(F.substring_index(name, "_", 1).alias("prim_set")).distinct()


def wide_membership(members: DataFrame) -> DataFrame:
    """One row a group, one boolean column an element (export only)."""
    return members.groupBy("group_id").pivot("el_id").agg(F.lit(True)).na.fill(False)


def ordered(df: DataFrame, order: str, by: str) -> DataFrame:
    return df.withColumn("ord", F.row_number().over(Window.partitionBy(by).orderBy(order)))
