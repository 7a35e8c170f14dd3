"""URL filter: host/path rules first, then a bit-parallel wildcard automaton over the canonical URL.

Every glob is laid out as consecutive states of one Shift-And automaton packed into 64-bit words; all globs advance
together on each character, for a whole Arrow batch of URLs at a time. State j of a glob means that its first j
symbols matched; a ``*`` is a self-loop on the state where it stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (verdict, host, path): fits the host and its subdomains when the path starts with path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Globs that block, over the canonical URL (host, path and query). ``*``: any run; ``?``: one character.
GLOBS = (
    "*casino*", "*free-bets*", "*betting-*", "*slot-machine*", "*poker-online*", "*jackpot-*",
    "*ads-track*", "*adserver.*", "*doubleclick.*", "*/ads/*", "*/banners/*", "*?utm_medium=spam*",
    "*viagra*", "*cialis*", "*cheap-pills*", "*online-pharmacy*", "*weight-loss-*", "*xxx-*", "*porn*", "*escort-*",
    "*spam-farm*", "*link-farm*", "*seo-links*", "*payday-loan*", "*replica-watch*", "*get-rich-*", "*warez*", "*phishing*", "*/wp-login.php*",
)


class ShiftAnd:
    """All globs as one automaton. matches() returns, per text, whether any glob matches the whole of it."""

    def __init__(self, globs: tuple[str, ...]):
        symbols: list[tuple[int, str]] = []  # (state entered, symbol)
        first, last, loops, at = [], [], [], 0
        for glob in globs:
            first.append(at)
            for ch in glob:
                if ch == "*":
                    loops.append(at)
                else:
                    at += 1
                    symbols.append((at, ch))
            last.append(at)
            at += 1
        self.words = max(1, -(-at // 64))
        self.start, self.final, self.loop = self._mask(first), self._mask(last), self._mask(loops)
        self.literals = np.array(sorted({ord(ch) for _, ch in symbols if ch != "?"}), dtype=np.uint32)
        anything = [s for s, ch in symbols if ch == "?"]
        rows = [self._mask(anything + [s for s, ch in symbols if ch != "?" and ord(ch) == c]) for c in self.literals]
        self.masks = np.stack([*rows, self._mask(anything)])  # the last row: any other character

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, dtype=np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return out

    def _classes(self, flat: np.ndarray) -> np.ndarray:
        if not len(self.literals):
            return np.zeros(len(flat), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.literals, flat), len(self.literals) - 1)
        return np.where(self.literals[at] == flat, at, len(self.literals))

    def matches(self, texts: list[str]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = self._classes(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4"))
        begin = (np.cumsum(lengths) - lengths)[order]
        falling = -lengths[order]
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        for step in range(int(lengths.max(initial=0))):
            k = int(np.searchsorted(falling, -step, side="left"))  # the texts longer than step
            now = state[:k]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:k] = (moved & self.masks[flat[begin[:k] + step]]) | (now & self.loop)
        out = np.empty(len(texts), dtype=bool)
        out[order] = (state & self.final).any(axis=1)
        return out


def glob_matcher(globs: tuple[str, ...] = GLOBS):
    """A vectorised boolean function of a string column: does any glob match? Null counts as the empty text."""

    @F.pandas_udf("boolean")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ShiftAnd(globs)
        for urls in batches:
            yield pd.Series(automaton.matches(urls.fillna("").tolist()))

    return match


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """From after the first :// up to / ? # or the end, A-Z lowered; empty for null or without ://."""
    return _ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host, path and query, A-Z lowered; no scheme and no fragment."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.concat(host_of(url), _ascii_lower(rest))


def url_verdicts(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, globs: tuple[str, ...] = GLOBS
) -> DataFrame:
    """Judge every URL: id, host, path, rule (like ``net/``; null if none fits) and verdict.

    The longest fitting rule wins; without one, a URL matched by a glob is blocked and any other allowed. Null URLs and
    those without ``://`` have empty host and path, fit no rule and are judged as the empty text. Ids may be null or
    repeat; each row is judged alone. Other columns are ignored, whatever their names. One narrow stage, no shuffle.
    """
    rows = pages.select(F.col(id_col), F.col(url_col).alias("_url"))
    rows = rows.select(id_col, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), glob_matcher(globs)(canonical(F.col("_url"))).alias("_glob"))
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def first_fit(value, otherwise: Column) -> Column:
        def step(rest: Column, rule: tuple[str, str, str]) -> Column:
            fits = ((F.col("host") == rule[1]) | F.col("host").endswith("." + rule[1])) & F.col("path").startswith(rule[2])
            return F.when(fits, F.lit(value(rule))).otherwise(rest)

        return reduce(step, reversed(ranked), otherwise)

    return rows.select(
        id_col, "host", "path",
        first_fit(lambda r: r[1] + r[2], F.lit(None).cast("string")).alias("rule"),
        first_fit(lambda r: r[0], F.when(F.col("_glob"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts on the URLs of all pages."""
    return url_verdicts(table(spark, sf_dir, "pages"))


def _sql() -> str:
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ranked = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}')" for _, h, p in ranked]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, ranked))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, ranked))
    globs = ", ".join(f"'{g}'" for g in GLOBS)
    return f"""
    WITH cut AS (
      SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), parts AS (
      SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{up}', '{low}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM cut
    )
    SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule,
           CASE {verdict} WHEN len(list_filter([{globs}], lambda g: (host || translate(tail, '{up}', '{low}')) GLOB g)) > 0 THEN 'block' ELSE 'allow' END AS verdict
    FROM parts"""


SQL = _sql()
