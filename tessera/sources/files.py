"""Sources: folders, file lists, tables, query logs, stopwords, settings."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import written

TEXT = (".txt", ".md", ".markdown")
#: One list for every scan, so that a later comparison doesn't take formats for vanished.
EXTENSIONS = (*TEXT, ".pdf", ".doc", ".docx")

#: Text of a binary format, by extension; pdf and doc need a converter to be registered here.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {}


def _docx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "replace")
    return re.sub("<[^>]+>", "", re.sub("</w:p>", "\n", xml))


EXTRACTORS[".docx"] = _docx


def _text_of(extension: str, data: bytes) -> str:
    extract = EXTRACTORS.get(extension)
    try:
        return extract(data) if extract else data.decode("utf-8", "replace")
    except (OSError, ValueError, KeyError, zipfile.BadZipFile):
        return ""


def numbered(docs: DataFrame, order: str = "path") -> DataFrame:
    """With doc_id = place in the order, from 0.

    Ranges are sorted in parallel and each gets the number of rows before it, so
    that no single task has to see all rows.  They are written, since their borders
    come from a sample and need not be the same when they are made again.
    """
    spread = docs.repartitionByRange(F.col(order)).withColumn("__p", F.spark_partition_id())
    spread = written(spread.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(order))), "numbered")
    sizes = spread.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return spread.join(F.broadcast(before), "__p").withColumn("doc_id", (F.col("__before") + F.col("__r") - 1).cast("long")).drop("__p", "__r", "__before")


def folder(spark: SparkSession, path: str, recursive: bool = True, only: str | None = None) -> DataFrame:
    """(doc_id, path, size_bytes, mtime, content) of a folder's documents, empty ones too; without recursion, Word formats are left out.

    Endings are told apart by case.  Files of other kinds are not read.
    """
    known = EXTENSIONS if recursive else tuple(e for e in EXTENSIONS if e not in (".doc", ".docx"))
    wanted = [e for e in known if only in (None, e)]
    return _documents(spark, [path], "*{" + ",".join(wanted or ["/"]) + "}", recursive)


def file_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _documents(spark, paths, None, False)


def _listed(spark: SparkSession, paths: list[str], glob: str | None, recursive: bool) -> list[tuple[str, int]]:
    """Path and seconds of change of the files of no bytes, which Spark's file sources pass over; from the listing alone."""
    hadoop, out = spark._jvm.org.apache.hadoop.fs, []
    pattern = glob and hadoop.GlobPattern(glob)
    for p in paths:
        at = hadoop.Path(p)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.getFileStatus(at).isDirectory() and not recursive:
            files = iter(fs.listStatus(at))
        else:
            each = fs.listFiles(at, recursive)
            files = iter(lambda: each.next() if each.hasNext() else None, None)
        for f in files:
            name = f.getPath().getName()
            if f.isFile() and not f.getLen() and name[:1] not in "._" and (pattern is None or pattern.matches(name)):
                out.append((f.getPath().toString(), f.getModificationTime() // 1000))
    return out


def _documents(spark: SparkSession, paths: list[str], glob: str | None, recursive: bool) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    rows = reader.load(paths).select("path", F.col("length").alias("size_bytes"), F.unix_timestamp("modificationTime").alias("mtime"), ending.alias("ending"), "content")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_text_of(e, d or b"") for e, d in zip(b.column("ending").to_pylist(), b.column("content").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("size_bytes"), b.column("mtime"), pa.array(texts, pa.string())], ["path", "size_bytes", "mtime", "content"])

    found = rows.mapInArrow(extract, "path string, size_bytes long, mtime long, content string")  # every file is read once, whatever its kind
    empty = spark.createDataFrame([(p, 0, t, "") for p, t in _listed(spark, paths, glob, recursive)], "path string, size_bytes long, mtime long, content string")
    return numbered(found.unionByName(empty)).select("doc_id", "path", "size_bytes", "mtime", "content")


def table_documents(rows: DataFrame, order: str = "id") -> DataFrame:
    """A documents table (path, content, size_bytes, mtime), read by JDBC or otherwise, numbered in its order."""
    return numbered(rows, order).select("doc_id", "path", "size_bytes", "mtime", "content")


def jdbc_documents(spark: SparkSession, url: str, table: str = "documents", **options: str) -> DataFrame:
    """Read by as many connections as partitionColumn, lowerBound, upperBound and numPartitions say, if they are given."""
    return table_documents(spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load())


def query_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("query")).where(F.length("query") > 0)


def stopwords(path: str) -> frozenset[str]:
    """One a line, lower-cased, not trimmed; none if there is no such file."""
    try:
        return frozenset(w.lower() for w in Path(path).read_text().split("\n") if w)
    except OSError:
        return frozenset()


@dataclass
class Settings:
    docs_folder: str = "docs"
    index_file: str = "index"
    wal_file: str = "wal"
    scoring: str = "bm25"
    use_stopwords: bool = True
    use_stemming: bool = False
    use_wal: bool = False
    max_threads: int = 4
    shard_count: int = 8
    ext_filter: str = ""


def settings(text: str) -> Settings:
    """key=value lines; # and ; open comments, keys in any case; what can't be read keeps its default."""
    out = Settings()
    kinds = {f.name.replace("_", ""): f for f in fields(Settings)}
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in "#;" or "=" not in line:
            continue
        key, value = (x.strip() for x in line.split("=", 1))
        f = kinds.get(key.lower())
        if f is None:
            continue
        if f.type == "bool":
            setattr(out, f.name, value.lower() in ("1", "true", "yes", "on"))
        elif f.type == "int":
            if re.fullmatch(r"-?\d+", value):
                setattr(out, f.name, int(value))
        else:
            setattr(out, f.name, value)
    return out
