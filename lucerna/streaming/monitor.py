"""Incremental keyword monitoring of new records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phrases looked for and the label of each.
KEYWORDS = {
    "globular cluster": "球状星团", "dwarf galaxy": "矮星系", "dwarf galaxies": "矮星系", "stellar stream": "星流", "near-field cosmology": "近场宇宙学",
    "galactic archaeology": "星系考古学", "open cluster": "疏散星团", "stellar population": "星族",
    "球状星团": "球状星团", "矮星系": "矮星系", "星流": "星流", "近场宇宙学": "近场宇宙学", "星系考古学": "星系考古学", "疏散星团": "疏散星团", "星族": "星族",
}


def keyword_labels(text: Column, keywords: dict[str, str] = KEYWORDS) -> Column:
    """The label of every phrase a text holds, in any case, in the order of the phrases."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(phrase.lower())), F.lit(label)) for phrase, label in keywords.items()]))


def matched(records: DataFrame, text: Column, at: str, cutoff: str | None = None) -> DataFrame:
    """Records with ``labels``, newer than ``cutoff``, that hold a keyword; works on batches and streams."""
    df = records.withColumn("labels", keyword_labels(text)).where(F.size("labels") > 0)
    return df.where(F.col(at) >= F.lit(cutoff)) if cutoff else df


def merge_by_id(records: DataFrame, key: str, at: str) -> DataFrame:
    """One row per id: its latest time and the union of its labels."""
    # labels are few, so each is kept once a task before the shuffle
    seen = records.groupBy(key).agg(F.max(at).alias(at), F.count("*").alias("seen"))
    labels = records.select(key, F.explode("labels").alias("label")).groupBy(key).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return seen.join(labels, key)


def upsert_batches(stream: DataFrame, write, checkpoint: str):
    """Sink of a monitor: ``write(batch, number)`` for each batch; a batch that comes again has the same number, so writing it twice must change nothing."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_of(spark, path: str, schema: str) -> DataFrame:
    """A file, or the files of a folder, as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        folder, name = path.rsplit("/", 1)  # a stream reads folders
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_available(spark, path: str, schema: str, build, late: str, at: str, key: str, checkpoint: str) -> DataFrame:
    """Run a monitor over all files now present, each id once within the watermark, and return what it kept."""
    once = build(stream_of(spark, path, schema)).withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    out = f"{checkpoint}/out"
    q = once.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    return spark.read.parquet(out)


def newest(df: DataFrame, at: str, key: str, most: int = 20_000) -> DataFrame:
    """The ``most`` newest rows of a bounded cache."""
    return df.orderBy(F.desc(at), F.col(key)).limit(most)
