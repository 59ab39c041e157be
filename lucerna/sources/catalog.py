"""Tables of a library: schemas, readers, evolution and snapshot writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "papers": "id long, arxiv_id string, bibcode string, title string, abstract string, authors_json string, categories array<string>, matched_keywords array<string>, published string, source string, pdf_relpath string, created_at timestamp, updated_at timestamp, pub_version string, pdf_fetched_at timestamp, source_text_relpath string, source_kind string, source_backend string, arxiv_source_relpath string, source_fetched_at timestamp",
    "paper_references": "from_paper_id long, ref_bibcode string, created_at timestamp",
    "paper_chunks": "id long, paper_id long, chunk_ord int, char_start int, char_end int, text string, text_hash string, created_at timestamp",
    "paper_tags": "id long, paper_id long, tag_key string, tag_value string, source string, created_at timestamp",
    "extraction_runs": "id long, topic string, schema_json string, result_json string, created_at timestamp",
}


class Catalog:
    """Parquet tables under one folder; every mutation is written as a new snapshot."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}.parquet")

    def register(self, *names: str) -> None:
        for n in names:
            self.table(n).createOrReplaceTempView(n)

    def write(self, df: DataFrame, name: str, snapshot: str) -> str:
        """Write a snapshot next to the tables and return its path; readers of older ones are not disturbed."""
        path = f"{self.base}/_snapshots/{snapshot}/{name}.parquet"
        df.write.mode("errorifexists").parquet(path)
        return path


def evolve(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the schema of table ``name``: missing columns are null, further ones are dropped."""
    empty = df.sparkSession.createDataFrame([], SCHEMAS[name])
    return empty.unionByName(df, allowMissingColumns=True).select(*[F.col(f.name).cast(f.dataType) for f in empty.schema])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines of text files without blank lines and ``#`` comments."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """``path, length, content`` of files below ``path``, recursively."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def printable_runs(content: str = "content", least: int = 4) -> Column:
    """Printable character runs of binary files, one a line."""
    text = F.decode(F.col(content), "ISO-8859-1")
    return F.array_join(F.regexp_extract_all(text, F.lit(rf"([\x20-\x7e]{{{least},}})"), F.lit(1)), "\n")


def read_record_map(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON document ``{"entries": {id: record}}`` as rows ``key, record``."""
    kind = "entries map<string, struct<id:string,title:string,summary:string,published:string,authors:array<string>,categories:array<string>,matched_kw:array<string>,cached_at:string>>, last_updated string"
    return spark.read.schema(kind).json(path, multiLine=True).select(F.explode("entries").alias("key", "record"))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Section side files as rows ``file, char_start, level, title``; malformed rows are skipped."""
    kind = "sections array<struct<char_start:int,level:int,title:string>>, backend string, arxiv_id string"
    df = spark.read.schema(kind).json(path, multiLine=True, mode="PERMISSIVE").select(F.input_file_name().alias("file"), F.explode("sections").alias("s"))
    return df.select("file", "s.*").where("char_start is not null and title is not null")
