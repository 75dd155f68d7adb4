"""Readers and writers by name: the store's tables, JSON documents, JSON lines, CSV, markdown trees, frontmatter."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import documents

Reader = Callable[..., DataFrame]
_READERS: dict[str, Reader] = {}

PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.StringType(), False), T.StructField("path", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("space_key", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("parent_id", T.StringType()),
    T.StructField("ancestors", T.ArrayType(T.StringType())), T.StructField("last_modified", T.TimestampType()),
])


def reader(kind: str) -> Callable[[Reader], Reader]:
    def add(f: Reader) -> Reader:
        _READERS[kind] = f
        return f

    return add


def load(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """Read ``path`` by a registered kind; what is not supported is refused by name."""
    if kind not in _READERS:
        raise ValueError(f"no reader for {kind!r}; there are {', '.join(sorted(_READERS))}")
    return _READERS[kind](spark, path, **options)


@reader("parquet")
def _parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@reader("json")
def json_store(spark: SparkSession, path: str, table: str = "pages", schema: T.StructType = PAGE_SCHEMA, parts: bool = False) -> DataFrame:
    """One table of a JSON document that holds arrays of rows by table name; with ``parts`` each line is such a document."""
    doc = spark.read.schema(T.StructType([T.StructField(table, T.ArrayType(schema))])).json(path, multiLine=not parts)
    return doc.select(F.explode(table).alias("r")).select("r.*")


@reader("jsonl")
def json_lines(spark: SparkSession, path: str, schema: str = "timestamp timestamp, level string, type string, data string") -> DataFrame:
    """Log lines; a line that is no JSON is left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter("type is not null")


@reader("csv")
def csv_issues(spark: SparkSession, path: str) -> DataFrame:
    """Quoted fields may hold commas, doubled quotes and line ends."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True)


@reader("issues-json")
def json_issues(spark: SparkSession, path: str) -> DataFrame:
    """An array of issues, or an object with one; read-only fields are dropped and objects become their names."""
    text = spark.read.text(path, wholetext=True)
    issue = "array<struct<key:string,fields:map<string,string>>>"
    rows = F.coalesce(F.from_json(F.get_json_object("value", "$.issues"), issue), F.from_json("value", issue))
    named = F.map_from_entries(F.transform(
        F.filter(F.map_entries("i.fields"), lambda e: ~e["key"].isin("created", "updated", "creator", "reporter", "resolution", "status", "worklog")),
        lambda e: F.struct(e["key"], F.coalesce(F.get_json_object(e["value"], "$.name"), F.get_json_object(e["value"], "$.id"), F.get_json_object(e["value"], "$.accountId"), e["value"])),
    ))
    return text.select(F.explode(rows).alias("i")).select("i.key", named.alias("fields"))


@reader("markdown")
def markdown_tree(spark: SparkSession, path: str, pattern: str = "*.md", ignore: Sequence[str] = ()) -> DataFrame:
    """path (below the folder), frontmatter (a map), title and body of each markdown file; ``ignore`` lists patterns as
    for version control (``*.log``, ``drafts/``, ``!keep.md``). Ignored files are not read: the paths are judged first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    below = F.regexp_replace(F.substring_index("path", f"{path.rstrip('/')}/", -1), "^/+", "")
    return _markdown(files, below, F.decode("content", "utf-8"), ignore)


@reader("markdown-packs")
def markdown_packs(spark: SparkSession, path: str, ignore: Sequence[str] = ()) -> DataFrame:
    """The same of a tree that :func:`write_markdown_packs` wrote. A markdown file's path is that of its pack's folder with its own name."""
    packs = spark.read.schema("file string, text string").option("recursiveFileLookup", True).parquet(path)
    folder = F.regexp_replace(F.substring_index(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), f"{path.rstrip('/')}/", -1), "^/+|[^/]*$", "")
    return _markdown(packs, F.concat(folder, "file"), F.col("text"), ignore)


def write_markdown_packs(files: DataFrame, path: str, *folders: str) -> None:
    """``files`` (file, text and a column for each level of folders) as packs: tables of many markdown files in each
    folder, as a folder of a file a document costs a listing, a task's opening and a renaming for each of them."""
    files.select(*folders, "file", "text").write.partitionBy(*folders).parquet(path)


def _markdown(files: DataFrame, path: Column, text: Column, ignore: Sequence[str]) -> DataFrame:
    if ignore:
        rules = list(ignore)
        files = files.filter(~documents.column(lambda p: documents.ignored(p, rules), "boolean")(path))
    read = files.select(path.alias("path"), text.alias("text"))
    return read.select("path", frontmatter(F.col("text")).alias("frontmatter"), body(F.col("text")).alias("body"), heading(F.col("text")).alias("title"))


_FRONT = r"(?s)^---\n(.*?)\n---\n?(.*)$"


def frontmatter(text: Column) -> Column:
    """The ``key: value`` lines between leading dashes; an empty map where there are none."""
    lines = F.filter(F.split(F.regexp_extract(text, _FRONT, 1), "\n"), lambda x: x.rlike(r"^[A-Za-z0-9_-]+:"))
    pair = lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), "^[\"']|[\"']$", ""))
    return F.map_from_entries(F.transform(lines, pair))


def body(text: Column) -> Column:
    return F.when(text.rlike(r"(?s)^---\n.*?\n---"), F.regexp_extract(text, _FRONT, 2)).otherwise(text)


def heading(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(body(text), r"(?m)^#\s+(.+)$", 1)), F.lit(""))


def write_table(df: DataFrame, path: str) -> None:
    """Write a new version beside the others and then point to it: a reader sees the old one or the new one, never half."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/v-{version}")
    df.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/current")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.schema("version string").json(f"{path}/current").first()["version"]
    return spark.read.parquet(f"{path}/v-{version}")


def export_store(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines below ``path``; :func:`import_store` replaces all of them."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def import_store(spark: SparkSession, path: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def write_csv(df: DataFrame, path: str) -> None:
    """Columns in order of their names; fields are quoted where they must be."""
    df.select(*sorted(df.columns)).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def append_logs(logs: DataFrame, path: str) -> None:
    """Log rows as JSON lines by day."""
    logs.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").json(path)


def logs_from(spark: SparkSession, path: str, before: str | None = None) -> DataFrame:
    """Logged rows; ``before`` leaves out older days by pruning their folders."""
    logs = spark.read.json(path)
    return logs.filter(F.col("day") >= F.lit(before).cast("date")) if before else logs


def migrate_state(spark: SparkSession, document: str) -> DataFrame:
    """Pages of one legacy state document; see :func:`migrate_states`."""
    return migrate_states(spark.createDataFrame([(document,)], "doc string"), "doc")


def migrate_states(documents_: DataFrame, column: str) -> DataFrame:
    """Pages of legacy state documents (an object by page id each), with defaults for what they do not hold."""
    entry = "struct<path:string,title:string,spaceKey:string,version:int,lastSyncedAt:string,localHash:string,remoteHash:string,baseHash:string,syncState:string>"
    doc = documents_.select(F.from_json(column, f"pages map<string,{entry}>").alias("d"))
    return doc.select(F.explode("d.pages").alias("page_id", "p")).select(
        "page_id", F.coalesce("p.path", F.concat(F.col("page_id"), F.lit(".md"))).alias("path"), F.coalesce("p.title", F.lit("Untitled")).alias("title"), F.coalesce("p.spaceKey", F.lit("")).alias("space_key"),
        F.coalesce("p.version", F.lit(1)).alias("version"), F.coalesce("p.syncState", F.lit("synced")).alias("sync_state"), F.coalesce("p.baseHash", F.lit("")).alias("base_hash"),
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames over the union of their columns; what a frame lacks is null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
