"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

STOP_WORDS = tuple(
    sorted(
        set(
            (
                "the of and to in is that it for was with as by on are this be at from or an a "
                "der die und den von zu das mit sich des auf für ist im dem nicht ein eine "
                "de la le et les un du une que est pour qui dans par pas au sur "
                "el en y los se las por con no su al es lo para"
            ).split()
        )
    )
)
#: (name, counted, per, least, most): 100 * counted must lie within least and most times per; None is open.
RULES = (
    ("length", "n_words", None, 20, None),
    ("mean_word_length", "word_chars", "n_words", 300, 700),
    ("symbols", "n_symbols", "n_words", None, 10),
    ("stop_words", "n_stop_words", "n_words", 6, None),
    ("repeated_lines", "n_dup_lines", "n_lines", None, 40),
    ("echoed_words", "n_echo_words", "n_words", None, 30),
)
SYMBOLS = "#*$%&|<>"
SPACE = "\t\n\x0b\x0c\r "
WINDOW = 8


def words_of(text: Column) -> Column:
    """The runs of characters outside \\x20 and \\x09-\\x0D; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def _covered(starts: Column) -> Column:
    """Words covered by windows at these increasing positions."""
    none = F.struct(F.lit(0).cast("int").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, i: Column) -> Column:
        return F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"))

    return F.aggregate(starts, none, step, lambda acc: acc["n"])


def _repeat_words(words: Column) -> Column:
    """Words inside WINDOW-word windows that occur at least twice in the text, the first occurrence included."""

    def by_hash(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return let(F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])), by_window)

    def by_window(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            twin = lambda x, k: F.coalesce(F.get(s, k)["w"] == x["w"], F.lit(False))
            return _covered(F.sort_array(F.transform(F.filter(s, lambda x, k: twin(x, k - 1) | twin(x, k + 1)), lambda x: x["i"])))

        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(pairs, repeated))

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda x: F.xxhash64(x)), by_hash))


def _measures(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")

    def of(words: Column) -> Column:
        stops = F.filter(words, lambda w: F.btrim(F.lower(w), F.lit(".,;:!?")).isin(*STOP_WORDS))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(whole, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(stops).cast("long").alias("n_stop_words"),
            F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))).cast("long").alias("n_echo_words"),
        )

    return let(words_of(text), of)


def compile_rules(rules: tuple, names: dict[str, Column]) -> Column:
    """The whole threshold table as one boolean: every rule holds. All comparisons are between whole numbers."""

    def one(rule: tuple) -> Column:
        _, counted, per, least, most = rule
        value, unit = (names[counted], F.lit(1)) if per is None else (100 * names[counted], names[per])
        bounds = [value >= least * unit] if least is not None else []
        return reduce(lambda a, b: a & b, bounds + ([value <= most * unit] if most is not None else []), F.lit(True))

    return reduce(lambda a, b: a & b, map(one, rules))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """Measure every whole text and judge it: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, kept (boolean), n_stop_words, n_lines, n_echo_words (long; equal to the word before).

    A document is kept if it passes the base test (at least 20 words, and at most 30 % of its words inside 8-word
    windows that recur in it) and all rules. The stop words are English, German, French and Spanish, so ordinary text
    in any other language fails that rule; pass other rules for it. A null text has no words and fails. Rows are judged alone: null or
    repeated ids, other columns and empty tables need no care. One narrow stage of built-in functions.
    """
    m = docs.select(F.col(id_col), _measures(F.col(text_col)).alias("_m"))
    flat = m.select(
        id_col, "_m.n_words", "_m.word_chars", "_m.n_symbols", F.col("_m.lines.dup").alias("n_dup_lines"),
        "_m.n_repeat_words", "_m.n_stop_words", F.col("_m.lines.n").alias("n_lines"), "_m.n_echo_words",
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    names = {c: F.col(c) for c in flat.columns}
    return flat.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & compile_rules(rules, names)).alias("kept"), "n_stop_words", "n_lines", "n_echo_words",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents."""
    return quality(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def one(rule: tuple) -> str:
        _, counted, per, least, most = rule
        value, unit = (counted, "1") if per is None else (f"100 * {counted}", per)
        return " AND ".join(([f"{value} >= {least} * {unit}"] if least is not None else []) + ([f"{value} <= {most} * {unit}"] if most is not None else []))

    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    failed = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"
    return rf"""
    WITH base AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
    ), cut AS (
      SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base
    ), windows AS (
      SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM cut)
    ), twice AS (
      SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, s) > 1
    ), covered AS (
      SELECT r, count(DISTINCT i + k) AS n FROM twice, range({WINDOW}) AS x(k) GROUP BY r
    ), m AS (
      SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(covered.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: trim(lower(x), '.,;:!?') IN ({stops}))) AS n_stop_words,
             len(lines) AS n_lines, len(list_filter(w, lambda x, i: x = w[i - 1])) AS n_echo_words FROM cut LEFT JOIN covered USING (r)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed,
           NOT {failed} AND {" AND ".join(map(one, RULES))} AS kept, n_stop_words, n_lines, n_echo_words FROM m"""


SQL = _sql()
