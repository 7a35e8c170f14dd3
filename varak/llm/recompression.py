"""Substring dedup by recompression.

Words get global names (64-bit hashes). In each round the names fall into a left and a right class by one bit of a
round-specific hash, and every left symbol followed by a right one becomes a pair, whose name is made from theirs: equal
stretches of words are parsed alike but for a bounded margin, in all documents and without any communication. In the last
round symbols longer than a limit are not formed, so that every window of the wanted length has a symbol boundary
whose whole margin lies inside the window. The symbols of all rounds that surely lie alike within that margin, the highest
that fit, name the boundary; the least name of a window stands for it. Names are shared by equal windows, so names found
in one document only can't belong to a repeat. Runs of equal names count once.

1. Reveal: names meet in one shuffle; those that occur again become hits of their documents.
2. Verify: windows around hits meet in a second shuffle, by 128-bit names of all their words; a window that starts in a
   document with a smaller id is marked.
3. Remove: marks return to their documents.

Both shuffles are combined per chunk of documents first: what repeats inside a chunk is settled there and only one row
of each name travels on under that name, so a hot name costs a row a chunk. Copies of a whole text are settled by
the hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, cut, table

WINDOW = 13
#: Bytes of text that a task parses at once.
CHUNK = 2 << 20
NO_ID = (1 << 63) - 1  # the place of null ids: after all others
NO_MARK = (1 << 31) - 1
_U = np.uint64
_B1, _B2, _B3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _B3
    return x ^ (x >> _U(29))


def levels(window: int) -> tuple[int, int]:
    """(rounds, longest symbol): a boundary after k rounds depends on 2^(k-1) words on either side."""
    k = 1
    while window - (1 << (k + 1)) + 1 >= 1 << k:
        k += 1
    return k, window - (1 << k) + 1


def _names(names: np.ndarray, at: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """One name for the width words from each position."""
    out = np.zeros(len(at), dtype=_U)
    for k in range(width):
        out = out * base + names[at + k]
    return _mix(out)


class Chunk:
    """Some documents, their words and the parse."""

    def __init__(self, texts: list[bytes | None]):
        import xxhash

        self.words = [(t or b"").split() for t in texts]  # bytes: splits at \x20 and \x09-\x0D only
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        n = int(self.ends[-1]) if len(self.ends) else 0
        digest = xxhash.xxh64_intdigest
        self.names = np.fromiter((digest(w) for own in self.words for w in own), dtype=_U, count=n)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)

    def parse(self, window: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(positions where a symbol starts after the last round; per round before it, by position, the name of the symbol
        that starts there and its number of words, 0 inside a symbol)."""
        rounds, longest = levels(window)
        names, at, size, doc = self.names, np.arange(len(self.names)), np.ones(len(self.names), dtype=np.int64), self.doc
        symbols = []
        for r in range(rounds):
            left = (_mix(names + _U((r + 1) * int(_B2) % (1 << 64))) >> _U(40)) & _U(1) == 1
            pair = np.zeros(len(names), dtype=bool)
            pair[:-1] = left[:-1] & ~left[1:] & (doc[:-1] == doc[1:])
            if r == rounds - 1:
                pair[:-1] &= size[:-1] + size[1:] <= longest
            first = np.flatnonzero(pair)
            names, size = names.copy(), size.copy()
            names[first] = _mix(names[first] * _B1 + names[first + 1] * _B2 + _U(r))
            size[first] += size[first + 1]
            keep = np.ones(len(names), dtype=bool)
            keep[first + 1] = False
            names, at, size, doc = names[keep], at[keep], size[keep], doc[keep]
            if r < rounds - 1:
                name, words = np.zeros(len(self.names), dtype=_U), np.zeros(len(self.names), dtype=np.int8)
                name[at], words[at] = names, size
                symbols.append((name, words))
        return at, symbols

    def boundary_names(self, at: np.ndarray, symbols: list[tuple[np.ndarray, np.ndarray]], margin: int) -> np.ndarray:
        """One name for each boundary, made from the symbols within margin words of it.

        A boundary of round r depends on 2^(r-1) words on either side, so symbols of that round that keep this distance to
        the ends of the margin are the same wherever the margin's words occur. The highest such symbol is taken at every
        place; words stand for themselves where there is none.
        """
        out, due = np.zeros(len(at), dtype=_U), np.full(len(at), -margin, dtype=np.int64)  # due: next place not yet covered
        for k in range(-margin, margin):
            here = due == k
            part, words = self.names[at + k], np.ones(len(at), dtype=np.int64)
            for r, (name, size) in enumerate(symbols, 1):
                reach = margin - (1 << (r - 1))
                if k >= -reach:
                    n = size[at + k]
                    fits = (n > 0) & (k + n <= reach)
                    part, words = np.where(fits, name[at + k], part), np.where(fits, n, words)
            out = np.where(here, out * _B1 + part, out)
            due = np.where(here, k + words, due)
        return _mix(out)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, names) such that every window holds one whole anchor, the same in equal windows."""
        n, margin = len(self.names), 1 << (levels(window)[0] - 1)
        at, symbols = self.parse(window)
        begin = (self.ends - self.sizes)[self.doc[at]] if n else at
        at = at[(at - begin >= margin) & (self.ends[self.doc[at]] - at >= margin)] if n else at
        reach = window - 2 * margin + 1  # places in a window where its anchor may be
        if not len(at) or n < window:
            return at[:0], np.zeros(0, dtype=_U)
        name = np.full(n + reach, ~_U(0), dtype=_U)
        name[at] = self.boundary_names(at, symbols, margin)
        least = np.lib.stride_tricks.sliding_window_view(name, reach).min(axis=1)[:n]  # of the places p .. p + reach - 1
        start = np.arange(n) - margin
        fits = (start >= 0) & (start + window <= n)
        fits[fits] = self.doc[start[fits]] == self.doc[start[fits] + window - 1]
        least = np.concatenate([np.zeros(reach - 1, dtype=_U), np.where(fits, least, _U(0))])
        chosen = np.lib.stride_tricks.sliding_window_view(least, reach).max(axis=1)
        at = at[chosen[at] == name[at]]
        return at, name[at]

    def starts_near(self, at: np.ndarray, window: int) -> np.ndarray:
        """Starts of the windows that wholly hold the anchors at these positions."""
        margin = 1 << (levels(window)[0] - 1)
        spread = (at[:, None] + np.arange(margin - window, 1 - margin)[None, :]).ravel()
        spread = np.unique(spread[(spread >= 0) & (spread + window <= len(self.names))])
        return spread[self.doc[spread] == self.doc[spread + window - 1]]

    def window_names(self, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that name each window."""
        return _names(self.names, starts, window, _B1), _names(self.names, starts, window, _B2)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.RecordBatch]]:
    """(texts as bytes, rows) of bounded size; the text column comes last."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        upto, begin = np.cumsum(sizes), 0
        while begin < len(upto):
            done = upto[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(upto, done + CHUNK, side="right")))
            rows = batch.slice(begin, stop - begin)
            yield rows.column(rows.num_columns - 1).cast(pa.large_binary()).to_pylist(), rows
            begin = stop


def _numbers(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column(k).to_numpy(zero_copy_only=False)


#: How a row travels: under its name; settled, spread by document; settled, but under its name too.
OPEN, SETTLED, BOTH = 0, 1, 2


def reveal(window: int):
    """(id, mark, text) rows to (name, id, mark, kind) of the anchors, combined per chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, rows in _chunks(batches):
            ids, marks = _numbers(rows, 0), _numbers(rows, 1)
            first: dict = {}
            copies = np.zeros(len(texts), dtype=bool)  # of a text with no larger id in this chunk: settled elsewhere
            for i in np.argsort(ids, kind="stable").tolist():
                copies[i] = first.setdefault(texts[i], i) != i
            chunk = Chunk([None if c else t for t, c in zip(texts, copies)])
            at, name = chunk.anchors(window)
            own, mark = ids[chunk.doc[at]], marks[chunk.doc[at]]
            order = np.lexsort((mark, own, name))
            name, own, mark = name[order], own[order], mark[order]
            fresh = np.ones(len(name), dtype=bool)
            fresh[1:] = (name[1:] != name[:-1]) | (own[1:] != own[:-1]) | (mark[1:] != mark[:-1])
            name, own, mark = name[fresh], own[fresh], mark[fresh]
            head = np.ones(len(name), dtype=bool)
            head[1:] = name[1:] != name[:-1]
            lone = head & np.append(head[1:], True)
            kind = np.where(lone, OPEN, np.where(head, BOTH, SETTLED)).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(own), pa.array(mark), pa.array(kind)], names=["name", "id", "mark", "kind"])

    return run


def recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by name to (id, mark, name) of the settled ones and those whose name comes again."""
    last, pending, again = None, None, False

    def out(i, m, n):
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(m), pa.array(n)], names=["id", "mark", "name"])

    for batch in batches:
        name, own, mark, kind = (_numbers(batch, k) for k in range(4))
        free = kind != SETTLED
        hit = ~free | (kind == BOTH)
        where = np.flatnonzero(free)
        if len(where):
            n = name[where]
            same = np.zeros(len(n), dtype=bool)
            same[1:] = n[1:] == n[:-1]
            if last is not None and n[0] == last:
                same[0] = True
                if pending is not None and not again:
                    yield out(*pending)
            twice = same.copy()
            twice[:-1] |= same[1:]
            hit[where] |= twice
            again = bool(hit[where[-1]])
            last, tail = n[-1], where[-1]
            pending = (own[tail : tail + 1].copy(), mark[tail : tail + 1].copy(), name[tail : tail + 1].copy())
        if hit.any():
            yield out(own[hit], mark[hit], name[hit])


def verify(window: int):
    """(id, mark, hits, text) rows to (w1, w2, id, mark, kind) of the windows around hits, combined per chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, rows in _chunks(batches):
            ids, marks = _numbers(rows, 0), _numbers(rows, 1)
            chunk = Chunk(texts)
            at, name = chunk.anchors(window)
            hits = rows.column(2)
            flat = hits.flatten().to_numpy(zero_copy_only=False).view(_U)
            of = np.repeat(np.arange(len(texts)), hits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            known = np.unique(_mix(flat) + of.astype(_U) * _B1)  # hits count for their own document only
            at = at[np.isin(_mix(name) + chunk.doc[at].astype(_U) * _B1, known)]
            starts = chunk.starts_near(at, window)
            w1, w2 = chunk.window_names(starts, window)
            own, mark = ids[chunk.doc[starts]], marks[chunk.doc[starts]]
            order = np.lexsort((mark, own, w2, w1))
            w1, w2, own, mark = w1[order], w2[order], own[order], mark[order]
            new = np.ones(len(w1), dtype=bool)
            new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
            fresh = new.copy()
            fresh[1:] |= (own[1:] != own[:-1]) | (mark[1:] != mark[:-1])
            least = own[np.flatnonzero(new)][np.cumsum(new) - 1] if len(w1) else own
            kind = np.where(own > least, SETTLED, OPEN).astype(np.int8)
            columns = [w1.view(np.int64), w2.view(np.int64), own, mark, kind]
            yield pa.RecordBatch.from_arrays([pa.array(c[fresh]) for c in columns], names=["w1", "w2", "id", "mark", "kind"])

    return run


def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by window and id to (id, mark, w1) of those that a smaller id has too."""
    held = None
    for batch in batches:
        w1, w2, own, mark, kind = (_numbers(batch, k) for k in range(5))
        late = kind == SETTLED
        where = np.flatnonzero(~late)
        if len(where):
            a, b, o = w1[where], w2[where], own[where]
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            least = o[np.flatnonzero(new)][np.cumsum(new) - 1]
            if held is not None and (a[0], b[0]) == held[:2]:
                least[np.cumsum(new) == 1] = held[2]
            late[where] = o > least
            held = (a[-1], b[-1], least[-1])
        if late.any():
            yield pa.RecordBatch.from_arrays([pa.array(own[late]), pa.array(mark[late]), pa.array(w1[late])], names=["id", "mark", "w1"])


def remove(window: int):
    """(carried columns, windows, copy, text) rows to (carried columns, n_words, n_removed, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, rows in _chunks(batches):
            k = rows.num_columns - 3
            copied = rows.column(k + 1).to_pylist()
            gone, sizes, kept = [], [], []
            marked = [i for i, v in enumerate(rows.column(k).is_valid().to_pylist()) if v and not copied[i]]
            drop: dict[int, np.ndarray] = {}
            if marked:
                chunk = Chunk([texts[i] for i in marked])
                starts = np.arange(max(0, len(chunk.names) - window + 1))
                starts = starts[chunk.doc[starts] == chunk.doc[starts + window - 1]]
                w1 = chunk.window_names(starts, window)[0]
                lists = rows.column(k).take(pa.array(marked))
                of = np.repeat(np.arange(len(marked)), lists.value_lengths().to_numpy(zero_copy_only=False))
                known = np.unique(_mix(lists.flatten().to_numpy(zero_copy_only=False).view(_U)) + of.astype(_U) * _B1)
                late = starts[np.isin(_mix(w1) + chunk.doc[starts].astype(_U) * _B1, known)]
                edge = np.zeros(len(chunk.names) + 1, dtype=np.int64)
                np.add.at(edge, late, 1)
                np.add.at(edge, late + window, -1)
                covered = np.cumsum(edge)[:-1] > 0
                drop = {i: part for i, part in zip(marked, np.split(covered, chunk.ends[:-1]))}
            for i, t in enumerate(texts):
                words = (t or b"").split()
                sizes.append(len(words))
                if copied[i] and len(words) >= window:
                    gone.append(len(words))
                    words = []
                elif i in drop:
                    gone.append(int(drop[i].sum()))
                    words = [w for w, d in zip(words, drop[i].tolist()) if not d]
                else:
                    gone.append(0)
                kept.append(b" ".join(words))
            columns = [rows.column(j) for j in range(k)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*rows.schema.names[:k], "n_words", "n_removed", "kept"]
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """Per document: the carried columns (default: the id), n_words, n_removed and kept, the words left, joined by blanks.

    A word goes if a window of consecutive words of its document covers it that also starts in a document with a smaller id.
    Windows are judged on the input. Ids are whole numbers; null ids come after all others, and rows that share an id
    don't remove each other's words. Null texts have no words. Texts of any length are parsed whole, in memory
    that grows with the longest; an empty table gives an empty result.
    """
    carry = [id_col] if carry is None else carry
    mine = [f"_c{i}" for i in range(len(carry))]
    place = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id")
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.coalesce(F.pmod(F.xxhash64(text), F.lit(NO_MARK)).cast("int"), F.lit(0)).alias("mark")  # tells rows that share an id apart; never null, so joins add no filter
    rows = docs.select(place, mark, F.col(text_col).alias("text"))
    by_document = lambda c: F.when(F.col("kind") == SETTLED, F.col("id")).otherwise(F.col(c))

    names = rows.mapInArrow(reveal(window), "name long, id long, mark int, kind byte").repartition(by_document("name")).sortWithinPartitions("name")
    hits = names.mapInArrow(recurring, "id long, mark int, name long")
    texts = cut(docs.select(place, mark, F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("h2"), text).alias("h2")))
    groups = cut(texts.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("first")))
    count = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    copies = attach(texts, groups.where("n > 1"), ["h1", "h2"], "n", count).where("id > first").select("id", "mark").distinct()
    copies = cut(copies)
    marks = hits.select("id", "mark", "name", F.lit(False).alias("copy")).unionAll(copies.select("id", "mark", F.lit(None).cast("long").alias("name"), F.lit(True).alias("copy")))
    hits = cut(marks.groupBy("id", "mark").agg(F.collect_list("name").alias("hits"), F.max("copy").alias("copy")).where("not copy").drop("copy"))

    whole = docs.select(place, mark, F.col(text_col).alias("text"), *[F.col(c).alias(m) for c, m in zip(carry, mine)])
    found = whole.join(hits, ["id", "mark"]).select("id", "mark", "hits", *mine, "text")  # all of whole, so that its shuffle is reused
    windows = found.mapInArrow(verify(window), "w1 long, w2 long, id long, mark int, kind byte").repartition(by_document("w1")).sortWithinPartitions("w1", "w2", "id")
    late = windows.mapInArrow(later, "id long, mark int, w1 long")
    ends = late.select("id", "mark", "w1", F.lit(False).alias("copy")).unionAll(copies.select("id", "mark", F.lit(None).cast("long").alias("w1"), F.lit(True).alias("copy")))
    ends = ends.groupBy("id", "mark").agg(F.collect_list("w1").alias("windows"), F.max("copy").alias("copy"))
    final = whole.join(ends, ["id", "mark"], "left").select(*mine, "windows", F.coalesce("copy", F.lit(False)).alias("copy"), "text")
    kinds = ", ".join(f"{m} {docs.schema[c].dataType.simpleString()}" for c, m in zip(carry, mine))
    done = final.mapInArrow(remove(window), f"{kinds}, n_words long, n_removed long, kept string")
    return done.select(*[F.col(m).alias(c) for c, m in zip(carry, mine)], "n_words", "n_removed", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats of earlier documents all documents hold."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)
), late AS (
  SELECT r, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id
), gone AS (
  SELECT DISTINCT r, i + k AS i FROM late, range({WINDOW}) AS x(k)
), word AS (
  SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d
), kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""
