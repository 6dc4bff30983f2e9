"""Reading and writing record files: JSON lines (plain or gzip), globs, looked-up rows, sharded output with a manifest, postings.

Readers take an explicit schema and fail on malformed lines; writers refuse to overwrite unless told to, and Spark's commit
protocol makes a folder visible only when it is whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import char_ngrams

RECORD = "id string, text string, lang string, spans array<struct<start_char:int,end_char:int,label:string,source_label:string>>, metadata map<string,string>"


def scan_jsonl(spark: SparkSession, paths: str | list[str], schema: str = RECORD, required: str = "text") -> DataFrame:
    """Rows of JSON lines, gzip by the file's name. Malformed lines fail the job; rows without the required field fail ``check_required``."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def scan_named(spark: SparkSession, inputs: dict[str, str], schema: str = RECORD) -> DataFrame:
    """Union of several inputs (name -> folder, file or glob), tagged with their names."""
    out = None
    for name, path in sorted(inputs.items()):
        one = scan_jsonl(spark, path, schema).withColumn("dataset", F.lit(name)).withColumn("file", F.input_file_name())
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no inputs")
    return out


def check_required(df: DataFrame, column: str) -> DataFrame:
    """The same rows; the job fails at the first one where the column is null."""
    return df.withColumn(column, F.coalesce(F.col(column), F.raise_error(F.lit(f"{column} is missing")).cast(df.schema[column].dataType)))


def check_unique(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of repeated keys; an empty table means the key is unique."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def lookup(df: DataFrame, wanted: DataFrame, key: str, digest: str | None = None, text_col: str = "text") -> DataFrame:
    """Rows of the wanted keys; with ``digest``, only those whose text has the wanted SHA-256."""
    if digest is None:
        return df.join(wanted.select(key).distinct(), key, "left_semi")
    return df.join(wanted.select(key, F.lower(digest).alias("_digest")).distinct(), key).where(F.sha2(text_col, 256) == F.col("_digest")).drop("_digest")


def write_shards(df: DataFrame, path: str, by: list[str], fmt: str = "json", overwrite: bool = False, rows_per_file: int = 1_000_000) -> None:
    """One folder per value of the columns; files are bounded in rows, so a hot value becomes many files instead of one task."""
    w = df.write.partitionBy(*by).mode("overwrite" if overwrite else "errorifexists").option("maxRecordsPerFile", rows_per_file)
    (w.option("compression", "gzip") if fmt == "json" else w).format(fmt).save(path)


def manifest(df: DataFrame, by: list[str], id_col: str, text_col: str) -> DataFrame:
    """Per shard: rows, and a digest of its rows that doesn't depend on their order (sums of hashes of id and text)."""
    h = F.xxhash64(id_col, text_col).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), F.sum(h).cast("string").alias("digest"))


def check_manifest(df: DataFrame, saved: DataFrame, by: list[str], id_col: str, text_col: str) -> DataFrame:
    """Shards that are missing, new or changed against a saved manifest."""
    now = manifest(df, by, id_col, text_col).select(*by, F.col("records").alias("records_now"), F.col("digest").alias("digest_now"))
    j = saved.join(now, by, "full")
    return j.where(~F.col("digest").eqNullSafe(F.col("digest_now")) | ~F.col("records").eqNullSafe(F.col("records_now")))


def postings(df: DataFrame, id_col: str, text_col: str, orders: tuple[int, ...] = (4, 5, 6), buckets: int = 1 << 24) -> DataFrame:
    """(bucket, id): hashed character n-grams, each once per row, to be written by bucket."""
    grams = F.concat(*[char_ngrams(F.col(text_col), n) for n in orders])
    return df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(buckets))))).alias("bucket"))
