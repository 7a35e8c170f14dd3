import random
import re

import pytest
from pyspark.sql import functions as F

from varak.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Şu, kısa bir cümledir! Birkaç da işaret var...", "şu kısa bir cümledir birkaç da işaret var"),
        ("kâr I İ", "k r i i̇"),
        ("a b\x1cc d", "a b c d"),
        ("12 .. ", ""),
        ("", ""),
        (None, None),
    ],
)
def test_clean_text(spark, text, expected):
    assert one(spark, T.clean_text(F.col("t")), t=text) == expected


@pytest.mark.parametrize(
    "a, b, expected",
    [
        ("Şu bir yeni metin", "Şu bir eski yazı", 2 / 6),
        ("a b", "b a a", 1.0),
        ("", "a", 0.0),
        ("1 2", "1 2", 0.0),
        (None, "a", 0.0),
        ("a", None, 0.0),
    ],
)
def test_similarity(spark, a, b, expected):
    assert one(spark, T.similarity(F.col("a"), F.col("b")), a=a, b=b) == expected


@pytest.mark.parametrize(
    "a, b, least, expected",
    [
        ("Şu bir ev", "Şu bir evdi", 0.2, True),
        ("", "", 0.2, False),
        ("Single", "Word", 0.2, False),
        ("a b", "a b c d", 0.2, True),  # half as long passes
        ("a b", "a b c d e", 0.2, False),
        ("a b c", "a d e", 0.2, True),  # 1 of 5: the bound itself passes
        ("a b c", "a d e", 0.21, False),
        (None, "a b", 0.2, False),
    ],
)
def test_is_valid_pair(spark, a, b, least, expected):
    assert one(spark, T.is_valid_pair(F.col("a"), F.col("b"), min_similarity=least), a=a, b=b) is expected


def test_strip_and_words_follow_unicode(spark):
    text = " \x1c a b \t\n\x1f"
    assert one(spark, T.strip(F.col("t")), t=text) == text.strip() == "a b"
    assert one(spark, T.words(F.col("t")), t=text) == text.split()
    assert one(spark, T.word_count(F.col("t")), t="  ") == 0


@pytest.mark.parametrize("text, expected", [("Ab. Cd! e", 2), ("so... what!? no", 0), ("x.", 1), ("şğ. é? z", 2), ("", 0)])
def test_sentence_count(spark, text, expected):
    assert one(spark, T.sentence_count(F.col("t")), t=text) == expected == len(re.findall(r"\w[!.?](?!\S)", text))


@pytest.mark.parametrize("text, expected", [("3.14", "3. 14"), ("...", ". . ."), ("a ›b‹ \n c", "a b c"), ("kâr #1", "kr 1"), ("(a-b)", "(a-b)"), ("", "")])
def test_post_process(spark, text, expected):
    assert one(spark, T.post_process(F.col("t")), t=text) == expected


@pytest.mark.parametrize("a, b, expected", [("abc", "abd", 2 / 3), ("ab", "a", 0.5), ("", "", None), ("", "a", 0.0), ("\U0001f600a", "\U0001f600b", 0.5)])
def test_cleanliness(spark, a, b, expected):
    assert one(spark, T.cleanliness(F.col("a"), F.col("b")), a=a, b=b) == expected


def word(c):
    return c.isalnum() or c == "_"


def skip(s, i):
    while i < len(s) and s[i].isspace():
        i += 1
    return i


def at(s, i, test):
    return i < len(s) and test(s[i])


def run(s, i, test):
    while i < len(s) and test(s[i]):
        i += 1
    return i


def bracketed_number(s):
    for i, c in enumerate(s):
        if c.isdecimal() and at(s, j := skip(s, i + 1), "]".__eq__) and at(s, j := skip(s, j + 1), ",".__eq__) and at(s, skip(s, j + 1), str.isdecimal):
            return True
    return False


def repeated_chunk(s):
    for i in range(len(s)):
        for n in range(1, run(s, i, word) - i + 1):
            chunk, j = s[i : i + n], i + n
            for _ in range(3):
                if not s.startswith(chunk, j):
                    break
                j = skip(s, j + n)
            else:
                return True
    return False


def hyphen_chain(s):
    for i, c in enumerate(s):
        if word(c) and at(s, j := skip(s, i + 1), "-".__eq__) and (k := run(s, j := skip(s, j + 1), word)) > j:
            if at(s, j := skip(s, k), "-".__eq__) and at(s, skip(s, j + 1), word):
                return True
    return False


def short_words(s):
    for i in range(len(s)):
        j = i
        for _ in range(3):
            k = run(s, j, word)
            if not 1 <= k - j <= 2 or skip(s, k) == k:
                break
            j = skip(s, k)
        else:
            if i == 0 or not word(s[i - 1]):
                return True
    return False


def capital(s, i):
    """The end of a capitalised word with a full stop, from i, or None."""
    if at(s, i, lambda c: "A" <= c <= "Z"):
        j = run(s, i + 1, lambda c: "a" <= c <= "z")
        if at(s, j, ".".__eq__):
            return j + 1


def abbreviations(s):
    starts = [i for i in range(len(s)) if i == 0 or not word(s[i - 1])]
    return any((j := capital(s, i)) and skip(s, j) > j and capital(s, skip(s, j)) for i in starts)


def sultan_number(s):
    for i in range(len(s)):
        if s.startswith("Sultan", i) and (j := skip(s, i + 6)) > i + 6 and (k := run(s, j, "IVX".__contains__)) > j:
            if at(s, k, ".".__eq__) and "\n" in s[k + 1 : skip(s, k + 1)]:
                return True
    return False


#: What each sign means, without regular expressions.
SIGNS = {
    "bracketed_number": bracketed_number,
    "digit_inside_word": lambda s: any(word(a) and b.isdecimal() and word(c) for a, b, c in zip(s, s[1:], s[2:])),
    "very_long_word": lambda s: any(all(c.isascii() and c.isalpha() for c in s[i : i + 20]) for i in range(len(s) - 19)),
    "repeated_chunk": repeated_chunk,
    "number_in_parentheses": lambda s: any(c == "(" and ")" in s[i:] and any(d.isdecimal() for d in s[i : s.index(")", i)]) for i, c in enumerate(s)),
    "hyphen_chain": hyphen_chain,
    "short_words": short_words,
    "abbreviations": abbreviations,
    "sultan_number": sultan_number,
    "blank_before_mark": lambda s: any(a.isspace() and b in ".,;:!?" for a, b in zip(s, s[1:])),
    "no_blank_after_mark": lambda s: any(a in ".,;:!?" and not b.isspace() for a, b in zip(s, s[1:])),
}


def fuzz():
    rng = random.Random(13)
    pieces = [*"aabB1²½٣.,!?-()] _ı\x1c\x1f\x85\xa0\u2028\u0301\n\U0001d7d9", "e\u0301", "Sultan IV. ", "Ab. ", "xx", "12", " , ", "x²y1²", "a1² b", "one.\x1ctwo", "word ,\x1cx", "end.\x1dnext"]
    fixed = ["1037 senesinde", "12 ay", "la la la la", "haha ha ha", "aaaa", "1 ] , 2", "a-b - c", "ab - cd", "end .", "3.14", "x" * 20, "ş" * 25, "", 'a."', "o bu şu ev", "e. ", "iki, üç", "½. z", "x². y"]
    return fixed + ["".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(3000)]


def test_signs_and_counts_equal_plain_python(spark):
    signs = {n: T.repair_sign(F.col("t"), n) for n in SIGNS}
    df = spark.createDataFrame([(s,) for s in fuzz()], "t string").select(
        "t", *[c.alias(n) for n, c in signs.items()], T.needs_correction(F.col("t")).alias("any"), T.sentence_count(F.col("t")).alias("sentences"), T.words(F.col("t")).alias("words"),
        T.word_count(F.col("t")).alias("n"), T.strip(F.col("t")).alias("bare"), T.post_process(F.col("t")).alias("tidy"),
    )
    assert set(SIGNS) == set(T.REPAIR_SIGNS)
    for r in df.collect():
        want = {n: bool(sign(r.t)) for n, sign in SIGNS.items()}
        assert {n: r[n] for n in SIGNS} == want, r.t
        assert r["any"] == any(want.values())
        ends = sum(word(a) and b in ".!?" and (not c or c.isspace()) for a, b, c in zip(r.t, r.t[1:], [*r.t[2:], ""]))
        assert r.sentences == ends and r.words == r.t.split() and r.n == len(r.words) and r.bare == r.t.strip(), repr(r.t)
        kept = "".join(c for c in r.t if c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZçÇğĞıİöÖşŞüÜ.,;:!?()-" or c.isspace() or c.isdecimal())
        spaced = "".join(c + " " * (c in ".,;:!?") for c in kept)
        assert r.tidy == " ".join(spaced.split()), repr(r.t)


def test_short_words_survive_long_input(spark):
    assert one(spark, T.needs_correction(F.col("t")), t="ab " * 50_000) is True
