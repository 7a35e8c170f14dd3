"""Registered queries over the text-mining operators and their DuckDB SQL.

Texts with paragraphs are made from conversations: a user's turns followed, between underscores, by the replies.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varak.functions import text as T
from varak.functions.sql import register
from varak.operators import lexicon as L
from varak.operators import pairs as P
from varak.operators import sentences as S
from varak.operators import stats as A
from varak.sources import files as X
from varak.streaming import streams


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.mine_pairs(_docs(spark, sf_dir)).where("pair_type = 'poetic'")
    return found.select("doc_id", "pair_idx", "original", "translation", "similarity", "pair_type")


def _conversation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    part = F.when(F.col("role") == "user", F.col("text")).otherwise(F.concat(F.lit("_"), "text", F.lit("_")))
    turns = turns.select("conv_id", F.struct("turn", part.alias("part")).alias("s"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return ordered.select("conv_id", F.array_join(F.transform("s", lambda x: x["part"]), "\n\n").alias("text"))


def _direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.mine_pairs(_conversation_texts(spark, sf_dir), "conv_id", min_similarity=0.05).where("pair_type = 'direct_pair'")
    return found.select("conv_id", "pair_idx", "original", "translation", "similarity", "pair_type")


def _line_couples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every couplet of lines of a document, unjudged: doc_id, couple, a, b."""
    lines = F.transform(F.split("text", "\n"), T.strip)
    couple = F.transform(F.col("l"), lambda x, i: F.when(i % 2 == 0, F.struct((i / 2).cast("long").alias("couple"), x.alias("a"), F.get("l", i + 1).alias("b"))))
    made = _docs(spark, sf_dir).select("doc_id", lines.alias("l")).select("doc_id", F.inline(F.filter(couple, lambda c: c.isNotNull() & c["b"].isNotNull())))
    return made


def _similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_couples(spark, sf_dir).select("doc_id", "couple", T.similarity(F.col("a"), F.col("b")).alias("similarity"))


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_couples(spark, sf_dir).select("doc_id", "couple", T.is_valid_pair(F.col("a"), F.col("b")).alias("is_valid"))


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.text_stats(_docs(spark, sf_dir)).drop("tokens")


def _benchmark_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.text_stats(_table(spark, sf_dir, "benchmark"), "item_id").drop("tokens")


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.totals(A.text_stats(_docs(spark, sf_dir))).drop("tokens")


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sentences(_docs(spark, sf_dir))


SQL_SIGNS = ("bracketed_number", "digit_inside_word", "very_long_word", "number_in_parentheses", "hyphen_chain", "blank_before_mark", "no_blank_after_mark")


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    signs = [T.repair_sign(F.col("sentence"), n).alias(n) for n in SQL_SIGNS]
    return _sentences(spark, sf_dir).select("doc_id", "line_idx", "sent_idx", *signs)


def _one_flag(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _sentences(spark, sf_dir).select("doc_id", "line_idx", "sent_idx", T.repair_sign(F.col("sentence"), name).alias(name))


def _all_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.flag_sentences(_sentences(spark, sf_dir)).drop("sentence")


def _post(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).select("doc_id", "line_idx", "sent_idx", T.post_process(F.col("sentence")).alias("processed"))


def _cleanliness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sentences(spark, sf_dir).withColumn("processed", T.post_process(F.col("sentence")))
    return rows.select("doc_id", "line_idx", "sent_idx", T.cleanliness(F.col("sentence"), F.col("processed")).alias("cleanliness"))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = A.repair_report(S.repair(_sentences(spark, sf_dir)))  # sums of doubles depend on their order
    return report.withColumns({c: F.round(c, 9) for c in report.columns if c.endswith("_cleanliness")})


def _corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.correct_texts(_docs(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.repair_records(S.repair(_sentences(spark, sf_dir)))


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair by a corrector that swaps two letters and fails for sentences with a question mark."""

    def corrector(texts: list[str]) -> list[str | None]:
        return [None if "?" in t else t.replace("e", "i") for t in texts]

    return S.repair(_sentences(spark, sf_dir), corrector).drop("sentence")


def _report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.report_text(A.repair_report(S.repair(_sentences(spark, sf_dir))))


def _cleanliness_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cleanliness_histogram(S.repair(_sentences(spark, sf_dir)))


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.words_per_sentence(_docs(spark, sf_dir))


def _markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.get_markers(L.starter(spark), "formality", "formal_markers")


def _added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.add_markers(L.starter(spark), "formality", "formal_markers", ["zat", "efendim"])


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.missing_lists(L.starter(spark).where("category <> 'suffixes' or subcategory = 'verbal'"))


def _marker_counts(category: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: L.marker_counts(_docs(spark, sf_dir), L.starter(spark), category)


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.without_stopwords(_docs(spark, sf_dir), L.starter(spark))


def _paired_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation a text with both kinds of pairs: each turn and a longer version of it between underscores, then a stanza."""
    turns = _table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", F.struct("turn", "text").alias("s"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    pairs = F.transform("s", lambda x: F.concat(x["text"], F.lit("\n\n_"), x["text"], F.lit(" ve sonra_")))
    stanza = F.concat(F.get("s", F.lit(0))["text"], F.lit("\nbir iki\n"), F.get("s", F.lit(0))["text"], F.lit(" ile\nbir iki"))
    return ordered.select("conv_id", F.concat(F.array_join(pairs, "\n\n"), F.lit("\n\n"), stanza).alias("text"))


def _all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.mine_pairs(_paired_texts(spark, sf_dir), "conv_id").drop("metadata")


def _pair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pair_report(_all_pairs(spark, sf_dir))


def _shared(spark: SparkSession) -> str:
    """A new folder in the one that all executors share."""
    return f"{X.shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _item_files(spark: SparkSession, sf_dir: str, text: Column) -> str:
    """Each benchmark item as a file item_id=N/part-*; the folder. The file ends with a line break."""
    folder = _shared(spark)
    _table(spark, sf_dir, "benchmark").select("item_id", text.alias("value")).repartition(1).write.partitionBy("item_id").text(folder)
    return folder


def _item() -> Column:
    return F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long").alias("item_id")


def _pdf() -> Column:
    """Of three items one isn't a PDF file, one can be converted and one can't."""
    kind, text = F.col("item_id") % 3, F.col("text")
    return F.when(kind == 0, text).when(kind == 1, F.concat(F.lit("%PDF-1.7 "), text)).otherwise(F.concat(F.lit("%PDF-!"), text))


def _convert(content: bytes, options: X.ExtractionOptions) -> str:
    """A stand-in for a PDF library: the bytes after the signature; fails where they begin with an exclamation mark."""
    text = content.decode("utf-8")
    if text[5] == "!":
        raise RuntimeError("this one can't be converted")
    return f"{options.dpi}: {text[9:]}"


def _whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files with line ends of two kinds, read whole."""
    return X.read_whole(spark, _item_files(spark, sf_dir, F.concat("text", F.lit("\r\nend\rof it")))).select(_item(), "text")


def _pdf_files(spark: SparkSession, sf_dir: str, on_error: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_item_files(spark, sf_dir, _pdf()))
    paths = [r.path for r in files.select("path").collect()]  # the caller names the files
    return X.read_pdfs(spark, paths, _convert, X.ExtractionOptions(dpi=72), on_error)


def _pdfs_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pdf_files(spark, sf_dir, "keep").select(_item(), "text", F.col("error.error_type").alias("error_type"), F.coalesce(F.col("error.message").startswith("this"), F.lit(False)).alias("by_converter"))


def _pdfs_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pdf_files(spark, sf_dir, "drop").select(_item(), "text")


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_item_files(spark, sf_dir, _pdf()))
    return files.select(_item(), X.is_pdf(F.col("content")).alias("is_pdf"), F.col("length"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus folder for each benchmark item, and one without the file."""
    folder = _shared(spark)
    for r in _table(spark, sf_dir, "benchmark").toLocalIterator():
        X.write_text(r["text"] or "", f"{folder}/b{r['item_id']}/{X.CORPUS_FILE}", spark)
    X.write_text("another", f"{folder}/none/other.txt", spark)
    if X.folders_without_corpus(spark, folder) != ["none"]:
        raise AssertionError("the folder without a corpus file is reported")
    return A.text_stats(X.read_corpus(spark, folder), "folder")


def _corpus_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.folder_info(_corpus(spark, sf_dir).withColumn("tokens", F.col("tokens").cast("string")))


def _corpus_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.total_info(A.totals(_corpus(spark, sf_dir)))


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of inputs that share one name, written as Markdown and read again."""
    folder = _shared(spark)
    items = _table(spark, sf_dir, "benchmark").select(F.concat(F.lit("/in/"), F.col("item_id").cast("string"), F.lit("/same.pdf")).alias("path"), "text")
    X.write_markdown(items, folder)
    return X.read_whole(spark, folder).select(F.regexp_extract("path", "file=([0-9a-f]+)", 1).alias("file"), "text")


def _saved_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists with one more marker, saved as JSON and loaded again."""
    folder = _shared(spark)
    L.save_lexicon(L.add_markers(L.starter(spark), "genre", "honorifics", ["paşa", "bey"]), folder)
    X.write_text("{", f"{folder}/broken.json", spark)
    return L.load_lexicon(spark, folder)


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a byte-pair encoding that has the single bytes and no pairs."""
    ranks = "\n".join(f"{base64.b64encode(bytes([b])).decode()} {b}" for b in range(256))
    path = f"{_shared(spark)}/bytes.ranks"
    X.write_text(ranks, path, spark)
    counter = A.bpe_counter(path.removeprefix("file://"), r"\S+|\s+")
    return A.text_stats(_table(spark, sf_dir, "benchmark"), "item_id", counter=counter)


def _by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text functions called from SQL."""
    register(spark)
    _docs(spark, sf_dir).createOrReplaceTempView("varak_docs")
    return spark.sql(
        "SELECT doc_id, varak_word_count(text) AS words, varak_sentence_count(text) AS sentences, varak_clean_text(text) AS cleaned,"
        " varak_set_similarity(varak_word_set(text), varak_word_set(substring(text, 1, 200))) AS similarity, varak_needs_correction(varak_strip_space(substring(text, 1, 80))) AS flagged FROM varak_docs"
    )


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of text files that arrive as a stream."""
    folder, out = _item_files(spark, sf_dir, F.col("text")), _shared(spark)
    streams.drain(streams.stream_stats(streams.stream_texts(spark, f"{folder}/*")), out, f"{out}-state")
    return spark.read.parquet(out).select(_item(), "sentences", "words", "characters")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "poetic_pairs": _pairs,
        "poetic_pairs_verified": lambda spark, sf_dir: P.verify_pairs(_pairs(spark, sf_dir)),
        "direct_pairs_conversations": _direct,
        "all_pairs": _all_pairs,
        "pair_report": _pair_report,
        "clean_text": _clean,
        "pair_similarity": _similarity,
        "valid_pair_flags": _valid,
        "doc_stats": _stats,
        "benchmark_stats": _benchmark_stats,
        "corpus_totals": _totals,
        "sentences": _sentences,
        "sentence_flags": _flags,
        "sentence_flag_short_words": _one_flag("short_words"),
        "sentence_flag_repeat": _one_flag("repeated_chunk"),
        "sentence_flags_all": _all_flags,
        "post_process": _post,
        "cleanliness": _cleanliness,
        "repair_report": _report,
        "repair_report_text": _report_text,
        "repair_records": _records,
        "repair_by_corrector": _repaired,
        "corrected_text": _corrected,
        "cleanliness_hist": _cleanliness_bins,
        "words_per_sentence_hist": _histogram,
        "source_whole_files": _whole_files,
        "source_pdf_signature": _signatures,
        "source_pdfs": _pdfs_kept,
        "source_pdfs_without_failures": _pdfs_dropped,
        "source_corpus_folders": lambda spark, sf_dir: _corpus(spark, sf_dir).drop("tokens"),
        "sink_folder_info": _corpus_info,
        "sink_total_info": _corpus_total,
        "sink_markdown": _markdown,
        "lexicon_save_and_load": _saved_lexicon,
        "token_counts": _tokens,
        "ext_sql_functions": _by_sql,
        "ext_stream_stats": _streamed,
        "lexicon_markers": _markers,
        "lexicon_add_markers": _added,
        "lexicon_validate": _missing,
        "ext_marker_counts_formality": _marker_counts("formality"),
        "ext_marker_counts_semantics": _marker_counts("semantics"),
        "ext_marker_counts_genre": _marker_counts("genre"),
        "ext_suffix_counts": _marker_counts("suffixes"),
        "ext_stopword_filtered_counts": _filtered,
    }


# DuckDB. Its \s and \w are ASCII, hence the classes; the replacement of İ makes its lower() agree with Unicode.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_W = r"[\p{L}\p{N}_]"


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_WS}+'), lambda w: w <> '')"


def _sql_clean(x: str) -> str:
    return rf"lower(replace(trim(regexp_replace(regexp_replace({x}, '[^{T.LETTERS}\s\x0b]', ' ', 'g'), '[\s\x0b]+', ' ', 'g')), 'İ', 'i' || chr(775)))"


def _sql_set(x: str) -> str:
    return f"list_distinct(list_filter(string_split({_sql_clean(x)}, ' '), lambda w: w <> ''))"


#: From a relation c(keys, a, b) to one with sim and valid lengths.
def _sql_scored(keys: str, source: str) -> str:
    return f"""
    sets AS (SELECT {keys}, a, b, {_sql_set("a")} AS wa, {_sql_set("b")} AS wb, len({_sql_words("a")}) AS na, len({_sql_words("b")}) AS nb FROM {source}),
    scored AS (
      SELECT {keys}, a, b, na >= 2 AND nb >= 2 AND 2 * least(na, nb) >= greatest(na, nb) AND a <> '' AND b <> '' AS fair,
             CASE WHEN len(wa) > 0 AND len(wb) > 0 THEN CAST(len(list_intersect(wa, wb)) AS DOUBLE) / len(list_distinct(list_concat(wa, wb))) ELSE 0.0 END AS sim FROM sets
    )"""


_LINES = f"""
    stanza AS (SELECT doc_id, {_sql_strip("string_split(text, chr(10) || chr(10))[-1]")} AS p FROM documents),
    split AS (SELECT doc_id, string_split(p, chr(10)) AS l FROM stanza),
    couples AS (SELECT doc_id, l, unnest(range(0, len(l) // 2)) AS i FROM split),
    lines AS (SELECT doc_id, i, {_sql_strip("l[2 * i + 1]")} AS a, {_sql_strip("l[2 * i + 2]")} AS b FROM couples)"""

_COUPLES = f"""
    split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    couples AS (SELECT doc_id, l, unnest(range(0, len(l) // 2)) AS couple FROM split),
    lines AS (SELECT doc_id, couple, {_sql_strip("l[2 * couple + 1]")} AS a, {_sql_strip("l[2 * couple + 2]")} AS b FROM couples)"""


def _sql_poetic(least: float) -> str:
    return f"""
    WITH {_LINES}, {_sql_scored("doc_id, i", "lines")}, kept AS (SELECT * FROM scored WHERE fair AND sim >= 0.2)
    SELECT * FROM (
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pair_idx, a AS original, b AS translation, sim AS similarity, 'poetic' AS pair_type FROM kept
    ) WHERE similarity >= {least}"""


_DIRECT = f"""
    WITH text AS (
      SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN text ELSE '_' || text || '_' END, chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id
    ), cut AS (SELECT conv_id, list_transform(string_split(t, chr(10) || chr(10)), lambda x: {_sql_strip("x")}) AS p FROM text),
    places AS (SELECT conv_id, p, unnest(range(1, len(p))) AS i FROM cut),
    next AS (SELECT conv_id, i, p[i] AS a, {_sql_strip("trim(p[i + 1], '_')")} AS b FROM places WHERE p[i] <> '' AND prefix(p[i + 1], '_') AND suffix(p[i + 1], '_')),
    {_sql_scored("conv_id, i", "next")}
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS pair_idx, a AS original, b AS translation, sim AS similarity, 'direct_pair' AS pair_type
    FROM scored WHERE fair AND sim >= 0.05"""


def _sql_stats(id_col: str, table: str) -> str:
    sentence = rf"len(regexp_extract_all(text, '{_W}+[.!?](?:{_WS}|$)'))"
    return f"SELECT {id_col}, {sentence} AS sentences, len({_sql_words('text')}) AS words, length(text) AS characters FROM {table}"


_MARK = chr(1)
_SENTENCES = rf"""
    line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS line_idx FROM documents),
    marked AS (SELECT doc_id, line_idx, string_split(regexp_replace({_sql_strip("l")}, '([.!?]){_WS}+', '\1{_MARK}', 'g'), '{_MARK}') AS s FROM line),
    sentence AS (SELECT doc_id, line_idx, unnest(range(0, len(s))) AS sent_idx, unnest(s) AS sentence FROM marked)"""

_SQL_SIGNS = {
    "bracketed_number": rf"\p{{Nd}}{_WS}*\]{_WS}*,{_WS}*\p{{Nd}}",
    "digit_inside_word": rf"{_W}\p{{Nd}}{_W}",
    "very_long_word": "[a-zA-Z]{20}",
    "number_in_parentheses": r"\([^)]*\p{Nd}[^)]*\)",
    "hyphen_chain": rf"{_W}{_WS}*-{_WS}*{_W}+{_WS}*-{_WS}*{_W}",
    "blank_before_mark": rf"{_WS}[.,;:!?]",
    "no_blank_after_mark": r"[.,;:!?][^\s\x0b\x1c-\x1f\x{85}\p{Z}]",
    "abbreviations": rf"(?:^|[^\p{{L}}\p{{N}}_])[A-Z][a-z]*\.{_WS}+[A-Z][a-z]*\.",
    "sultan_number": rf"Sultan{_WS}+[IVX]+\.{_WS}*\n",
    "short_words": rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{_W}{{1,2}}{_WS}+){{3}}",
}


def _sql_post(x: str) -> str:
    kept = rf"regexp_replace({x}, '[^{T.LETTERS}\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}\p{{Nd}}.,;:!?()\-]', '', 'g')"
    spaced = rf"regexp_replace(regexp_replace({kept}, '([.,;:!?])', '\1 ', 'g'), '{_WS}+', ' ', 'g')"
    return _sql_strip(spaced)


def _sql_cleanliness(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) > 0 THEN len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: {a}[i] = {b}[i])) / CAST(greatest(length({a}), length({b})) AS DOUBLE) END"


#: A chunk of word characters, at once followed by itself and then, after white space or not, twice more. It lies in one word,
#: or ends a word and goes on in the next ones.
_REPEATS = rf"""
    word_ AS (
      SELECT doc_id, line_idx, sent_idx, w, k FROM (SELECT doc_id, line_idx, sent_idx, x, unnest(x) AS w, unnest(range(1, len(x) + 1)) AS k FROM (SELECT *, {_sql_words("sentence")} AS x FROM sentence))
    ), near_ AS (
      SELECT doc_id, line_idx, sent_idx, w, coalesce(lead(w) OVER o, '') AS n1, coalesce(lead(w, 2) OVER o, '') AS n2 FROM word_ WINDOW o AS (PARTITION BY doc_id, line_idx, sent_idx ORDER BY k)
    ), chunk_ AS (
      SELECT *, len(list_filter(range(1, length(w) // 4 + 1), lambda l: len(list_filter(range(1, length(w) - 4 * l + 2), lambda i:
                  w[i:i + 3 * l - 1] = w[i + l:i + 4 * l - 1] AND regexp_matches(w[i:i + l - 1], '^{_W}+$'))) > 0)) > 0 AS inside,
             list_transform(list_filter(range(1, length(w) // 2 + 1), lambda l: right(w, l) = w[length(w) - 2 * l + 1:length(w) - l] AND regexp_matches(right(w, l), '^{_W}+$')), lambda l: right(w, l)) AS cs FROM near_
    ), repeats_ AS (
      SELECT DISTINCT doc_id, line_idx, sent_idx FROM chunk_
      WHERE inside OR len(list_filter(cs, lambda c: prefix(n1, c || c) OR (suffix(w, c || c || c) AND prefix(n1, c)) OR (n1 = c AND prefix(n2, c)))) > 0
    )"""
_FLAGGED = f"""{_SENTENCES}, {_REPEATS}, flagged AS (
      SELECT s.*, {", ".join(f"regexp_matches(sentence, '{sign}') AS {name}" for name, sign in _SQL_SIGNS.items())}, r.doc_id IS NOT NULL AS repeated_chunk
      FROM sentence s LEFT JOIN repeats_ r ON s.doc_id = r.doc_id AND s.line_idx = r.line_idx AND s.sent_idx = r.sent_idx
    ), judged AS (SELECT *, {" OR ".join(T.REPAIR_SIGNS)} AS needs_correction FROM flagged), repaired AS (
      SELECT doc_id, line_idx, sent_idx, sentence, needs_correction, CASE WHEN needs_correction THEN {_sql_post("sentence")} ELSE sentence END AS corrected FROM judged
    ), clean_ AS (SELECT *, CASE WHEN needs_correction THEN {_sql_cleanliness("sentence", "corrected")} ELSE 1.0 END AS cleanliness FROM repaired)"""


def _sql_side(side: str, c: str) -> str:
    pieces = f"list_filter(regexp_split_to_array({c}, '[.!?]+'), lambda x: x <> '')"
    return f"""CAST(coalesce(sum(len({_sql_words(c)})), 0) AS BIGINT) AS {side}_tokens, CAST(coalesce(sum(length({c})), 0) AS BIGINT) AS {side}_characters,
        CAST(coalesce(sum(len({pieces})), 0) AS BIGINT) AS {side}_sentences, coalesce(sum(list_sum(list_transform({pieces}, lambda x: len({_sql_words("x")})))), 0) AS {side}_words"""


_REPORT = f"""WITH {_FLAGGED}, sums AS (
      SELECT {_sql_side("original", "sentence")}, {_sql_side("corrected", "corrected")}, round(avg(cleanliness), 9) AS avg_cleanliness, round(min(cleanliness), 9) AS min_cleanliness,
             round(max(cleanliness), 9) AS max_cleanliness FROM clean_ WHERE needs_correction
    )
    SELECT original_tokens, original_characters, original_sentences, corrected_tokens, corrected_characters, corrected_sentences,
           {", ".join(f"original_{n} - corrected_{n} AS difference_{n}" for n in ("tokens", "characters", "sentences"))},
           {", ".join(f"CAST({s}_words AS DOUBLE) / nullif({s}_sentences, 0) AS {s}_words_per_sentence" for s in ("original", "corrected"))},
           avg_cleanliness, min_cleanliness, max_cleanliness FROM sums"""

_REPORT_TEXT = f"""SELECT 'Sentence repair' || chr(10) || chr(10)
        || {" || chr(10) || ".join(f"printf('{t}: %d before, %d after, %d fewer', original_{n}, corrected_{n}, difference_{n})" for t, n in (("Tokens", "tokens"), ("Characters", "characters"), ("Sentences", "sentences")))}
        || chr(10) || printf('Words a sentence: %.2f before, %.2f after', original_words_per_sentence, corrected_words_per_sentence)
        || chr(10) || printf('Cleanliness: %.2f on average, %.2f to %.2f', avg_cleanliness, min_cleanliness, max_cleanliness) AS value FROM ({_REPORT})"""

_BY_CORRECTOR = rf"""WITH {_FLAGGED}, tried AS (
      SELECT doc_id, line_idx, sent_idx, sentence, needs_correction, needs_correction AND NOT contains(sentence, '?') AS was_corrected, replace(sentence, 'e', 'i') AS raw FROM judged
    ), fixed AS (SELECT *, CASE WHEN was_corrected THEN {_sql_post("raw")} ELSE sentence END AS corrected FROM tried)
    SELECT doc_id, line_idx, sent_idx, corrected, CASE WHEN was_corrected THEN {_sql_cleanliness("sentence", "corrected")} WHEN needs_correction THEN 0.0 ELSE 1.0 END AS cleanliness, was_corrected FROM fixed"""

_PAIRED = f"""
    turn_ AS (SELECT conv_id, list(text ORDER BY turn) AS s FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
    text_ AS (
      SELECT conv_id, array_to_string(list_transform(s, lambda x: x || chr(10) || chr(10) || '_' || x || ' ve sonra_'), chr(10) || chr(10)) || chr(10) || chr(10)
             || s[1] || chr(10) || 'bir iki' || chr(10) || s[1] || ' ile' || chr(10) || 'bir iki' AS t FROM turn_
    ), para_ AS (SELECT conv_id, list_transform(string_split(t, chr(10) || chr(10)), lambda x: {_sql_strip("x")}) AS p FROM text_),
    place_ AS (SELECT conv_id, p, unnest(range(1, len(p))) AS i FROM para_),
    stanza_ AS (SELECT conv_id, string_split(p[-1], chr(10)) AS l FROM para_),
    couple_ AS (SELECT conv_id, l, unnest(range(0, len(l) // 2)) AS i FROM stanza_),
    both_ AS (
      SELECT conv_id, 0 AS kind, i, p[i] AS a, {_sql_strip("trim(p[i + 1], '_')")} AS b FROM place_ WHERE p[i] <> '' AND prefix(p[i + 1], '_') AND suffix(p[i + 1], '_')
      UNION ALL SELECT conv_id, 1 AS kind, i, {_sql_strip("l[2 * i + 1]")} AS a, {_sql_strip("l[2 * i + 2]")} AS b FROM couple_
    )"""
_ALL_PAIRS = f"""WITH {_PAIRED}, {_sql_scored("conv_id, kind, i", "both_")}
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY kind, i) - 1 AS pair_idx, a AS original, b AS translation, sim AS similarity,
           CASE kind WHEN 0 THEN 'direct_pair' ELSE 'poetic' END AS pair_type FROM scored WHERE fair AND sim >= CASE kind WHEN 0 THEN 0.3 ELSE 0.2 END"""
_PAIR_REPORT = f"""SELECT 'Original: ' || original || chr(10) || 'Translation: ' || translation || chr(10) || 'Similarity: ' || printf('%.3f', similarity) || chr(10)
        || 'Type: ' || pair_type || chr(10) || repeat('-', 80) AS value FROM ({_ALL_PAIRS})"""

_LEXICON = ", ".join(f"('{s}', '{c}', '{sub}', '{m}')" for source, data in L.STARTER.items() for s, c, sub, m in L.rows_of(data, source))
_LEX = f"lexicon(source, category, subcategory, marker) AS (VALUES {_LEXICON})"
_WORDS = f"word AS (SELECT doc_id, unnest({_sql_set('text')}) AS marker FROM documents)"


def _sql_counts(category: str) -> str:
    return f"""WITH {_LEX}, {_WORDS}
    SELECT doc_id, subcategory, count(*) AS n_markers FROM word JOIN (SELECT DISTINCT subcategory, marker FROM lexicon WHERE category = '{category}') USING (marker)
    GROUP BY doc_id, subcategory"""


def oracle_sql() -> dict[str, str]:
    flags = ", ".join(f"regexp_matches(sentence, '{_SQL_SIGNS[n]}') AS {n}" for n in SQL_SIGNS)
    required = ", ".join(f"('{c}', '{s}')" for c, subs in L.REQUIRED.items() for s in subs)
    stats = _sql_stats("doc_id", "documents")
    return {
        "poetic_pairs": _sql_poetic(0.2),
        "poetic_pairs_verified": _sql_poetic(0.3),
        "direct_pairs_conversations": _DIRECT,
        "clean_text": f"SELECT doc_id, {_sql_clean('text')} AS cleaned FROM documents",
        "pair_similarity": f"WITH {_COUPLES}, {_sql_scored('doc_id, couple', 'lines')} SELECT doc_id, couple, sim AS similarity FROM scored",
        "valid_pair_flags": f"WITH {_COUPLES}, {_sql_scored('doc_id, couple', 'lines')} SELECT doc_id, couple, fair AND sim >= 0.2 AS is_valid FROM scored",
        "doc_stats": stats,
        "benchmark_stats": _sql_stats("item_id", "benchmark"),
        "corpus_totals": f"""SELECT CAST(sum(sentences) AS BIGINT) AS sentences, CAST(sum(words) AS BIGINT) AS words, CAST(sum(characters) AS BIGINT) AS characters,
            count(*) AS files_processed FROM ({stats})""",
        "sentences": f"WITH {_SENTENCES} SELECT doc_id, line_idx, sent_idx, sentence FROM sentence",
        "sentence_flags": f"WITH {_SENTENCES} SELECT doc_id, line_idx, sent_idx, {flags} FROM sentence",
        "sentence_flag_short_words": f"WITH {_SENTENCES} SELECT doc_id, line_idx, sent_idx, regexp_matches(sentence, '{_SQL_SIGNS['short_words']}') AS short_words FROM sentence",
        "post_process": f"WITH {_SENTENCES} SELECT doc_id, line_idx, sent_idx, {_sql_post('sentence')} AS processed FROM sentence",
        "cleanliness": f"""WITH {_SENTENCES}, both_ AS (SELECT doc_id, line_idx, sent_idx, sentence AS a, {_sql_post("sentence")} AS b FROM sentence)
            SELECT doc_id, line_idx, sent_idx, {_sql_cleanliness("a", "b")} AS cleanliness FROM both_""",
        "sentence_flag_repeat": f"WITH {_FLAGGED} SELECT doc_id, line_idx, sent_idx, repeated_chunk FROM flagged",
        "sentence_flags_all": f"WITH {_FLAGGED} SELECT doc_id, line_idx, sent_idx, {', '.join(T.REPAIR_SIGNS)}, needs_correction FROM judged",
        "repair_report": _REPORT,
        "repair_report_text": _REPORT_TEXT,
        "repair_by_corrector": _BY_CORRECTOR,
        "repair_records": f"""WITH {_FLAGGED} SELECT 'Original: ' || sentence || chr(10) || 'Corrected: ' || corrected || chr(10) || 'Cleanliness: '
            || printf('%.2f', cleanliness) || chr(10) AS value FROM clean_ WHERE needs_correction""",
        "cleanliness_hist": f"""WITH {_FLAGGED} SELECT CAST(least(floor(cleanliness * 20), 19) AS BIGINT) AS bin, count(*) AS n_sentences FROM clean_ WHERE needs_correction GROUP BY 1""",
        "corrected_text": f"""WITH {_FLAGGED}, lines_ AS (SELECT doc_id, line_idx, string_agg(corrected || ' ', '' ORDER BY sent_idx) || chr(10) AS t FROM repaired GROUP BY doc_id, line_idx)
            SELECT doc_id, string_agg(t, '' ORDER BY line_idx) AS text FROM lines_ GROUP BY doc_id UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL""",
        "all_pairs": _ALL_PAIRS,
        "pair_report": _PAIR_REPORT,
        "source_whole_files": "SELECT item_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') || chr(10) || 'end' || chr(10) || 'of it' || chr(10) AS text FROM benchmark",
        "source_pdf_signature": """SELECT item_id, item_id % 3 > 0 OR prefix(text, '%PDF-') AS is_pdf, CAST(strlen(text) + CASE item_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 9 ELSE 6 END + 1 AS BIGINT) AS length FROM benchmark""",
        "source_pdfs": """SELECT item_id, CASE item_id % 3 WHEN 1 THEN '72: ' || text || chr(10) END AS text, CASE item_id % 3 WHEN 0 THEN 'ValueError' WHEN 2 THEN 'RuntimeError' END AS error_type,
            item_id % 3 = 2 AS by_converter FROM benchmark""",
        "source_pdfs_without_failures": "SELECT item_id, '72: ' || text || chr(10) AS text FROM benchmark WHERE item_id % 3 = 1",
        "source_corpus_folders": f"SELECT 'b' || item_id AS folder, sentences, words, characters FROM ({_sql_stats('item_id', 'benchmark')})",
        "sink_folder_info": f"""SELECT 'b' || item_id AS folder, 'File: osmanlıca.txt' || chr(10) || 'Token count: -' || chr(10) || 'Sentence count: ' || sentences || chr(10) || 'Word count: ' || words
            || chr(10) || 'Character count: ' || characters AS value FROM ({_sql_stats("item_id", "benchmark")})""",
        "sink_total_info": f"""SELECT 'Total Statistics for all osmanlıca.txt files' || chr(10) || repeat('=', 43) || chr(10) || 'Files processed: ' || count(*) || chr(10) || 'Total token count: 0' || chr(10)
            || 'Total sentence count: ' || sum(sentences) || chr(10) || 'Total word count: ' || sum(words) || chr(10) || 'Total character count: ' || sum(characters) AS value FROM ({_sql_stats("item_id", "benchmark")})""",
        "sink_markdown": "SELECT md5('/in/' || item_id || '/same.pdf') AS file, text || chr(10) AS text FROM benchmark",
        "lexicon_save_and_load": f"WITH {_LEX} SELECT * FROM lexicon UNION SELECT * FROM (VALUES ('genre', 'genre', 'honorifics', 'paşa'), ('genre', 'genre', 'honorifics', 'bey'))",
        "token_counts": f"SELECT item_id, CAST(strlen(text) AS BIGINT) AS tokens, sentences, words, characters FROM ({_sql_stats('item_id, text', 'benchmark')})",
        "ext_sql_functions": rf"""WITH d AS (SELECT doc_id, text, {_sql_set("text")} AS x, {_sql_set("left(text, 200)")} AS y, {_sql_strip("left(text, 80)")} AS s FROM documents),
            sentence AS (SELECT doc_id, 0 AS line_idx, 0 AS sent_idx, s AS sentence FROM d), {_REPEATS}
            SELECT d.doc_id, len({_sql_words("text")}) AS words, len(regexp_extract_all(text, '{_W}+[.!?](?:{_WS}|$)')) AS sentences, {_sql_clean("text")} AS cleaned,
                   CASE WHEN len(x) > 0 AND len(y) > 0 THEN CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))) ELSE 0.0 END AS similarity,
                   {" OR ".join(f"regexp_matches(s, '{sign}')" for sign in _SQL_SIGNS.values())} OR r.doc_id IS NOT NULL AS flagged FROM d LEFT JOIN repeats_ r ON d.doc_id = r.doc_id""",
        "ext_stream_stats": _sql_stats("item_id", "(SELECT item_id, text || chr(10) AS text FROM benchmark)"),
        "words_per_sentence_hist": f"""SELECT len({_sql_words("s")}) AS n_words, count(*) AS n_sentences
            FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: x <> '')) AS s FROM documents) GROUP BY 1""",
        "lexicon_markers": f"WITH {_LEX} SELECT DISTINCT marker FROM lexicon WHERE category = 'formality' AND subcategory = 'formal_markers'",
        "lexicon_add_markers": f"WITH {_LEX} SELECT * FROM lexicon UNION SELECT * FROM (VALUES ('formality', 'formality', 'formal_markers', 'zat'), ('formality', 'formality', 'formal_markers', 'efendim'))",
        "lexicon_validate": f"""WITH {_LEX} SELECT category, subcategory FROM (VALUES {required}) AS r(category, subcategory)
            ANTI JOIN (SELECT * FROM lexicon WHERE category <> 'suffixes' OR subcategory = 'verbal') USING (category, subcategory)""",
        "ext_marker_counts_formality": _sql_counts("formality"),
        "ext_marker_counts_semantics": _sql_counts("semantics"),
        "ext_marker_counts_genre": _sql_counts("genre"),
        "ext_suffix_counts": _sql_counts("suffixes"),
        "ext_stopword_filtered_counts": f"""WITH {_LEX}, {_WORDS}
            SELECT doc_id, count(*) AS n_words FROM word ANTI JOIN (SELECT marker FROM lexicon WHERE category = 'stopwords') USING (marker) GROUP BY doc_id""",
    }
