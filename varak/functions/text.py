"""Text functions as pure Column expressions.

White space, digits and word characters are Python's: ``(?U)`` makes Java's classes follow Unicode, the separators
``\\x1c-\\x1f`` count as white space too, and word characters are spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS, NOT_WS = "[\\s\\x1c-\\x1f]", "[^\\s\\x1c-\\x1f]"
#: Word characters as Python has them: letters and numbers of all kinds, no combining marks.
WORD = "[\\p{L}\\p{N}_]"
LETTERS = "a-zA-ZğĞıİöÖşŞüÜçÇ"
#: All but LETTERS. Java asks the parts of a nested class one after the other and those of a flat one, negated or not, all
#: the way down, so this takes a third of the time: blanks are settled by the first part, ASCII letters by four cheap ones.
NOT_LETTER = "[\\x00-@[\\[-`[{-\\x7f[\\x80-\\x{10ffff}&&[^ğĞıİöÖşŞüÜçÇ]]]]]"


def let(value: Column, body) -> Column:
    """Evaluate value once and hand it to body as a variable."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Without white space at both ends, in the Unicode sense (trim() strips blanks only)."""
    return F.regexp_replace(text, f"(?U)^{WS}+|{WS}+$", "")


def words(text: Column) -> Column:
    """The runs of characters that aren't white space."""
    return F.filter(F.split(text, f"(?U){WS}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"(?U){NOT_WS}+")).cast("long")


def char_count(text: Column) -> Column:
    """Code points."""
    return F.char_length(text).cast("long")


def sentence_count(text: Column) -> Column:
    """Words that end in exactly one mark, before white space or the end; runs of marks count as none."""
    return F.regexp_count(text, F.lit(f"(?U){WORD}[.!?](?:{WS}|\\z)")).cast("long")


def clean_text(text: Column) -> Column:
    """Letters of the modern Turkish alphabet only, single blanks, lower case.

    Circumflex letters, digits and punctuation become blanks. Lower-casing knows no locale: ``I`` becomes ``i``.
    """
    return F.lower(F.trim(F.regexp_replace(text, f"{NOT_LETTER}+", " ")))


def word_set(text: Column) -> Column:
    """The distinct words of the cleaned text."""
    return F.array_remove(F.array_distinct(F.split(clean_text(text), " ")), "")


def similarity_of_sets(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets, 0.0 if either is empty or null."""
    both = F.size(F.array_intersect(a, b))
    score = both / (F.size(a) + F.size(b) - both)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), score).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the word sets of two texts; null counts as empty."""
    return let(word_set(F.coalesce(a, F.lit(""))), lambda x: let(word_set(F.coalesce(b, F.lit(""))), lambda y: similarity_of_sets(x, y)))


def fair_lengths(original: Column, translation: Column, min_words: int = 2) -> Column:
    """Both texts are given, have min_words raw words, and the shorter has at least half the words of the longer."""

    def of(a: Column, b: Column) -> Column:
        return (a >= min_words) & (b >= min_words) & (2 * F.least(a, b) >= F.greatest(a, b))

    counts = let(word_count(F.coalesce(original, F.lit(""))), lambda a: let(word_count(F.coalesce(translation, F.lit(""))), lambda b: of(a, b)))
    return counts & F.coalesce((original != "") & (translation != ""), F.lit(False))


def is_valid_pair(original: Column, translation: Column, min_similarity: float = 0.2, min_words: int = 2) -> Column:
    """A plausible pair: fair lengths and at least the similarity. The cheap test comes first."""
    return F.when(fair_lengths(original, translation, min_words), similarity(original, translation) >= min_similarity).otherwise(F.lit(False))


def post_process(corrected: Column) -> Column:
    """Tidy a corrected sentence: drop foreign characters, one blank after each mark, single blanks.

    Most sentences are tidy already, which one look tells.
    """
    untidy = corrected.rlike(f"(?U)[^{LETTERS} \\d.,;:!?()\\-]|[.,;:!?][^ ]|  |^ | \\z")
    kept = F.regexp_replace(corrected, f"(?U)[^{LETTERS}{WS[1:-1]}\\d.,;:!?()\\-]", "")
    spaced = F.regexp_replace(kept, f"(?U)([.,;:!?])(?={NOT_WS})", "$1 ")
    return F.when(untidy, strip(F.regexp_replace(spaced, f"(?U){WS}+", " "))).otherwise(corrected)


def cleanliness(original: Column, corrected: Column) -> Column:
    """Share of places, of the longer text, at which both texts have the same character; null if both are empty."""
    spelled = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))
    equal = F.aggregate(F.zip_with(spelled(original), spelled(corrected), lambda x, y: x.eqNullSafe(y).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    longest = F.greatest(F.char_length(original), F.char_length(corrected))
    return F.when((original == corrected) & (original != ""), F.lit(1.0)).when(longest > 0, equal / longest)


#: Signs that a sentence needs repair, by name, each in the shortest form that is found exactly when the full one is.
REPAIR_SIGNS = {
    name: sign.replace("\\w", WORD).replace("\\s", WS).replace("\\S", NOT_WS)
    for name, sign in {
        "bracketed_number": "\\d\\s*\\]\\s*,\\s*\\d",
        "digit_inside_word": "\\w\\d\\w",
        "very_long_word": "[a-zA-Z]{20}",
        "repeated_chunk": "(\\w+)(?:\\1\\s*){3}",
        "number_in_parentheses": "\\([^)]*\\d[^)]*\\)",
        "hyphen_chain": "\\w\\s*-\\s*\\w+\\s*-\\s*\\w",
        "short_words": "(?:^|[^\\p{L}\\p{N}_])(?:\\w{1,2}\\s+){3}",
        "abbreviations": "(?:^|[^\\p{L}\\p{N}_])[A-Z][a-z]*\\.\\s+[A-Z][a-z]*\\.",
        "sultan_number": "Sultan\\s+[IVX]+\\.\\s*\\n",
        "blank_before_mark": "\\s[.,;:!?]",
        "no_blank_after_mark": "[.,;:!?]\\S",
    }.items()
}
#: The cheap ones, of which one look at the sentence finds any; the others follow if it finds none.
_CHEAP = ("no_blank_after_mark", "blank_before_mark", "digit_inside_word", "bracketed_number", "short_words", "number_in_parentheses", "very_long_word")


def repair_sign(sentence: Column, name: str) -> Column:
    return sentence.rlike("(?U)" + REPAIR_SIGNS[name])


def needs_correction(sentence: Column) -> Column:
    """Any of the eleven signs."""
    found = sentence.rlike("(?U)" + "|".join(REPAIR_SIGNS[name] for name in _CHEAP))
    for name in REPAIR_SIGNS:
        if name not in _CHEAP:
            found = found | repair_sign(sentence, name)
    return found


def line_sentences(line: Column) -> Column:
    """Sentences of a line, cut at white space after a mark; a blank line is one empty sentence."""
    return F.split(strip(line), f"(?U)(?<=[.!?]){WS}+")


def report_sentences(text: Column) -> Column:
    """Pieces between runs of marks, without the empty ones; pieces of blanks stay."""
    return F.filter(F.split(text, "[.!?]+"), lambda s: s != "")
