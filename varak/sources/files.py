"""Readers and writers: text, corpus folders, PDF files through an injected converter, reports."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS_FILE = "osmanlıca.txt"


@dataclass(frozen=True)
class ExtractionOptions:
    """What a PDF converter is told."""

    dpi: int = 300
    margins: tuple[int, int, int, int] = (50, 50, 0, 0)
    table_strategy: str = "lines_strict"
    fontsize_limit: int = 4


#: Takes the bytes of a PDF and the options, returns Markdown. The library that does it is the caller's choice.
Converter = Callable[[bytes, ExtractionOptions], str]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, local mode gets a folder of its own (as in
    tests); on a cluster that is an error, as each machine would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="varak-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def spread(rows: DataFrame) -> DataFrame:
    """The rows in one part a core, if they lie in fewer: a table of one file would keep one core busy. Tables in more parts,
    such as large ones, stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def library_converter(content: bytes, options: ExtractionOptions) -> str:
    """The converter used where none is given: the pymupdf4llm package, which executors must have."""
    try:
        import pymupdf
        import pymupdf4llm
    except ModuleNotFoundError as e:
        raise RuntimeError("PDF files need a converter: install pymupdf4llm or pass your own") from e
    with pymupdf.open(stream=content, filetype="pdf") as pdf:
        return pymupdf4llm.to_markdown(pdf, dpi=options.dpi, margins=options.margins, table_strategy=options.table_strategy, fontsize_limit=options.fontsize_limit)


def read_whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row a file: path, text, with line ends made \\n."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """The corpus file of every immediate subfolder: folder, text."""
    rows = read_whole(spark, f"{root.rstrip('/')}/*/{CORPUS_FILE}")
    return rows.select(F.element_at(F.split(F.url_decode(F.regexp_replace("path", "\\+", "%2B")), "/"), -2).alias("folder"), "text")


def hadoop(spark: SparkSession, path: str | Path):
    """(file system, path) of Hadoop for a place on any file system that Spark knows."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def list_folder(spark: SparkSession, path: str | Path) -> list[tuple[str, bool]]:
    """(path, is it a folder) of what lies directly in a folder, sorted."""
    fs, place = hadoop(spark, path)
    return sorted((str(x.getPath().toString()), bool(x.isDirectory())) for x in fs.listStatus(place))


def folders_without_corpus(spark: SparkSession, root: str) -> list[str]:
    """Immediate subfolders that lack the corpus file."""
    inside = [p for p, is_folder in list_folder(spark, root) if is_folder]
    return sorted(p.rsplit("/", 1)[1] for p in inside if not hadoop(spark, p)[0].exists(hadoop(spark, f"{p}/{CORPUS_FILE}")[1]))


def validate_files(spark: SparkSession, paths: list[str]) -> None:
    """FileNotFoundError for a missing path, ValueError for one that isn't a regular file."""
    for p in paths:
        fs, place = hadoop(spark, p)
        if not fs.exists(place):
            raise FileNotFoundError(p)
        if not fs.getFileStatus(place).isFile():
            raise ValueError(f"not a regular file: {p}")


def is_pdf(content: Column) -> Column:
    """Do the bytes begin with the PDF signature?"""
    return F.coalesce(F.substring(content, 1, 5) == F.lit(b"%PDF-"), F.lit(False))


def extract_pdfs(files: DataFrame, converter: Converter = library_converter, options: ExtractionOptions | None = None, on_error: str = "keep") -> DataFrame:
    """Convert binaryFile rows: path, text, error (struct of message, file_path, error_type, details; null if well).

    on_error: ``keep`` failures as rows without text, ``drop`` them, or ``fail`` at the first. Paths count once.
    """
    options = options or ExtractionOptions()
    schema = "path string, text string, error struct<message:string,file_path:string,error_type:string,details:map<string,string>>"

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content, ok in zip(pdf["path"], pdf["content"], pdf["ok"]):
                try:
                    if not ok:
                        raise ValueError(f"not a PDF file: {path}")
                    out.append((path, converter(bytes(content), options), None))
                except Exception as e:
                    if on_error == "fail":
                        raise
                    out.append((path, None, {"message": str(e), "file_path": path, "error_type": type(e).__name__, "details": None}))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    rows = files.dropDuplicates(["path"]).select("path", "content", is_pdf(F.col("content")).alias("ok"))
    done = rows.mapInPandas(convert, schema)
    return done.where(F.col("text").isNotNull()) if on_error == "drop" else done


def read_pdfs(spark: SparkSession, paths: list[str], converter: Converter = library_converter, options: ExtractionOptions | None = None, on_error: str = "keep", partitions: int | None = None) -> DataFrame:
    """Check all paths, then convert them in parallel. Spread a few large files over partitions."""
    validate_files(spark, paths)
    files = spark.read.format("binaryFile").load(paths)
    return extract_pdfs(files.repartition(partitions) if partitions else files, converter, options, on_error)


def write_markdown(texts: DataFrame, folder: str) -> None:
    """Text files under a hash of the path, so inputs of one name don't overwrite each other."""
    texts.where(F.col("text").isNotNull()).select(F.md5("path").alias("file"), "text").write.partitionBy("file").mode("overwrite").option("lineSep", "\n").text(folder)


def write_text(text: str, path: str | Path, spark: SparkSession | None = None) -> None:
    """One text to one file, with its folders: a local one, or with a session one on any file system that Spark knows."""
    if spark is None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
        return
    fs, place = hadoop(spark, path)
    out = fs.create(place, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def pair_report(pairs: DataFrame) -> DataFrame:
    """Each pair as four labelled lines and a rule; the similarity has three places, ties to even as Python has them."""

    @F.pandas_udf("string")
    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if pd.isna(x) else f"{x:.3f}")

    return pairs.select(
        F.concat_ws(
            "\n",
            F.concat(F.lit("Original: "), "original"),
            F.concat(F.lit("Translation: "), "translation"),
            F.concat(F.lit("Similarity: "), places("similarity")),
            F.concat(F.lit("Type: "), "pair_type"),
            F.lit("-" * 80),
        ).alias("value")
    )


def _lines(labels: dict[str, str]) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.col(c).cast("string")) for label, c in labels.items()])


def folder_info(stats: DataFrame, id_col: str = "folder") -> DataFrame:
    """Each folder's statistics as text: folder, value."""
    labels = {"Token count": "tokens", "Sentence count": "sentences", "Word count": "words", "Character count": "characters"}
    return stats.na.fill("-").select(id_col, F.concat(F.lit(f"File: {CORPUS_FILE}\n"), _lines(labels)).alias("value"))


def total_info(total: DataFrame) -> DataFrame:
    """The whole corpus's statistics as text."""
    labels = {"Files processed": "files_processed", "Total token count": "tokens", "Total sentence count": "sentences", "Total word count": "words", "Total character count": "characters"}
    return total.select(F.concat(F.lit(f"Total Statistics for all {CORPUS_FILE} files\n{'=' * 43}\n"), _lines(labels)).alias("value"))


def repair_records(repaired: DataFrame, sentence_col: str = "sentence") -> DataFrame:
    """Original, correction and cleanliness of each corrected sentence, as text."""

    @F.pandas_udf("string")
    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if pd.isna(x) else f"{x:.2f}")

    kept = repaired.where("was_corrected")
    return kept.select(F.concat(F.lit("Original: "), sentence_col, F.lit("\nCorrected: "), "corrected", F.lit("\nCleanliness: "), places("cleanliness"), F.lit("\n")).alias("value"))
