"""Word lists (markers) as a long table: source, category, subcategory, marker."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path
from urllib.request import url2pathname

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varak.functions.text import word_set
from varak.sources.files import hadoop, list_folder, write_text

SCHEMA = "source string, category string, subcategory string, marker string"
KEY = ("category", "subcategory")
#: The subcategories that a complete set of lists has.
REQUIRED = {
    "stopwords": ("particles_and_conjunctions",),
    "suffixes": ("verbal", "possessive", "case_markers"),
    "genre": ("honorifics", "arabic_patterns", "persian_compounds"),
    "semantics": ("economic", "political", "cultural", "religious"),
    "formality": ("informal_markers", "formal_markers"),
}
#: A small list of our own, for tests and as a start: common Turkish words and endings.
STARTER = {
    "formality": {"formal_markers": ["arz", "hazret", "zat"], "informal_markers": ["abi", "ha", "lan", "ya"]},
    "semantics": {"religious": ["cami", "dua", "namaz"], "cultural": ["sanat", "el"], "political": ["devlet", "la"], "economic": ["akçe", "para"]},
    "genre": {"persian_compounds": ["dil", "en"], "arabic_patterns": ["kitab", "der"], "honorifics": ["bey", "des"]},
    "stopwords": {"particles_and_conjunctions": ["ama", "de", "ile", "ki", "on", "ve"]},
    "suffixes": {"case_markers": ["da", "den", "in"], "possessive": ["im", "un"], "verbal": ["er", "ti", "y"]},
}


def rows_of(data: dict, source: str) -> list[tuple[str, str, str, str]]:
    """Flat lists (the source is the category), two-level ones, and mixtures of both."""
    out = []
    for key, value in data.items():
        if isinstance(value, dict):
            out += [(source, key, sub, m) for sub, markers in value.items() for m in markers]
        else:
            out += [(source, source, key, m) for m in value]
    return list(dict.fromkeys(out))


def starter(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([r for source, data in STARTER.items() for r in rows_of(data, source)], SCHEMA)


def load_lexicon(spark: SparkSession, path: str | Path) -> DataFrame:
    """A JSON file, or all JSON files of a folder, on any file system that Spark knows. Missing or malformed files have no rows."""
    rows = []
    fs, place = hadoop(spark, path)
    if fs.exists(place):
        found = [p for p, inside in list_folder(spark, path) if p.endswith(".json") and not inside] if fs.getFileStatus(place).isDirectory() else [str(path)]
        for file in found:
            try:
                text = spark.read.text(file, wholetext=True).first()
                rows += rows_of(json.loads(text["value"] if text else ""), url2pathname(file.rsplit("/", 1)[-1]).removesuffix(".json"))
            except (ValueError, TypeError, AttributeError, PySparkException):
                continue
    return spark.createDataFrame(rows, SCHEMA)


def save_lexicon(lexicon: DataFrame, folder: str | Path) -> None:
    """One JSON file a source, two levels deep, sorted; written beside and moved into place, on any file system."""
    spark, data = lexicon.sparkSession, {}
    for r in sorted(lexicon.distinct().collect()):  # word lists are small by nature and owned by one process
        data.setdefault(r.source, {}).setdefault(r.category, {}).setdefault(r.subcategory, []).append(r.marker)
    for source, lists in data.items():
        fs, fresh = hadoop(spark, f"{folder}/{source}.json.new")
        write_text(json.dumps(lists, indent=2), f"{folder}/{source}.json.new", spark)
        final = hadoop(spark, f"{folder}/{source}.json")[1]
        fs.delete(final, False)
        fs.rename(fresh, final)


def get_markers(lexicon: DataFrame, category: str, subcategory: str) -> DataFrame:
    """The distinct markers; none if the list is missing."""
    return lexicon.where((F.col("category") == category) & (F.col("subcategory") == subcategory)).select("marker").distinct()


def add_markers(lexicon: DataFrame, category: str, subcategory: str, markers: Iterable[str], source: str | None = None) -> DataFrame:
    """The lexicon with the markers added to one list, which may be new; each marker once. Nothing is written."""
    fresh = lexicon.sparkSession.createDataFrame([(source or category, category, subcategory, m) for m in dict.fromkeys(markers)], SCHEMA)
    return lexicon.unionByName(fresh).distinct()


def stopwords(lexicon: DataFrame) -> DataFrame:
    return get_markers(lexicon, "stopwords", "particles_and_conjunctions")


def missing_lists(lexicon: DataFrame, required: dict = REQUIRED) -> DataFrame:
    """The required (category, subcategory) pairs that the lexicon lacks; valid if none is."""
    wanted = lexicon.sparkSession.createDataFrame([(c, s) for c, subs in required.items() for s in subs], "category string, subcategory string")
    return wanted.join(lexicon.select(*KEY).distinct(), list(KEY), "left_anti")


def is_valid(lexicon: DataFrame, required: dict = REQUIRED) -> bool:
    return missing_lists(lexicon, required).isEmpty()


def marker_counts(docs: DataFrame, lexicon: DataFrame, category: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Extension: how many distinct words of each text are markers of each list of the category.

    A marker in several lists counts in each. Texts without any have no row. The lists, small by nature, go to the words:
    these are made distinct per text and only counts are shuffled.
    """
    found = docs.select(id_col, F.explode(word_set(F.col(text_col))).alias("marker"))
    lists = lexicon.where(F.col("category") == category).select("subcategory", "marker").distinct()
    return found.join(F.broadcast(lists), "marker").groupBy(id_col, "subcategory").agg(F.count("*").alias("n_markers"))


def without_stopwords(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Extension: how many distinct words of each text aren't stopwords; texts without any have no row."""
    found = docs.select(id_col, F.explode(word_set(F.col(text_col))).alias("marker"))
    return found.join(F.broadcast(stopwords(lexicon)), "marker", "left_anti").groupBy(id_col).agg(F.count("*").alias("n_words"))
