"""Extension: the text operators over streams. They are row by row, so they run unchanged on readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varak.operators.pairs import mine_pairs
from varak.operators.stats import text_stats
from varak.sources.files import Converter, ExtractionOptions, is_pdf


def stream_texts(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """New text files of a folder, whole: path, text."""
    rows = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def stream_pairs(texts: DataFrame, min_similarity: float = 0.3) -> DataFrame:
    return mine_pairs(texts, "path", "text", min_similarity)


def stream_stats(texts: DataFrame) -> DataFrame:
    return text_stats(texts, "path", "text")


def stream_pdfs(spark: SparkSession, folder: str, converter: Converter, options: ExtractionOptions | None = None) -> DataFrame:
    """New PDF files of a folder as path, text; files that fail or aren't PDF have a null text."""
    told = options or ExtractionOptions()
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(folder)

    def convert(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path, content, ok in zip(pdf["path"], pdf["content"], pdf["ok"]):
                try:
                    out.append((path, converter(bytes(content), told) if ok else None))
                except Exception:
                    out.append((path, None))
            yield pd.DataFrame(out, columns=["path", "text"])

    return files.select("path", "content", is_pdf(F.col("content")).alias("ok")).mapInPandas(convert, "path string, text string")


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that is there now as Parquet, exactly once, and stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
