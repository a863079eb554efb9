"""Benchmark decontamination by winnowing (operator 3).

Documents and benchmark items become word sequences (A-Z lower-cased; words are runs of
0-9, a-z and anything beyond ASCII).  Of every ``window`` consecutive words the smallest
hash of its k-grams is a fingerprint, so any shared span of at least ``window`` words
shares a fingerprint.  Fingerprints of documents are joined with those of the benchmark;
each hit is extended word by word to both sides, and counts if it reaches a whole window
(an item shorter than a window must occur whole: its k-gram is the item itself).

Only document fingerprints that pass a Bloom filter of the benchmark's are shuffled; its
size is fixed by a parameter, and false positives fall out in the join.  The hit carries
the words around it, at most ``window - 1`` on each side, so nothing is fetched again.
Hashes only propose: every hit compares the words themselves.

Null texts and texts without words have no words, no hits and are not contaminated; null
item ids are listed as ''.  Rows that repeat an id give a row each, by their own text.  Empty tables
(documents or benchmark) give empty results or no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bloom_bits, col, fresh, may_hold, row_keys, slices, split_by_keys, stored, utf8

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = {}


def _powers(n: int, base: np.uint64) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept for the largest length seen (a slice's bytes)."""
    known = _POWERS.get(int(base))
    if known is None or len(known) <= n:
        known = np.full(n + 1, base, np.uint64)
        known[0] = 1
        known = _POWERS[int(base)] = np.multiply.accumulate(known)
    return known


class Words:
    """Word boundaries and hashes of the texts of one slice."""

    def __init__(self, offs: np.ndarray, raw: np.ndarray):
        self.text = _LOWER[raw]
        is_word = _WORD[self.text]
        before = np.empty(len(raw), bool)
        before[1:] = is_word[:-1]
        before[:1] = False
        heads = offs[:-1][offs[:-1] < len(raw)]
        before[heads] = False  # a text's first byte starts a word
        self.start = np.flatnonzero(is_word & ~before)
        after = np.empty(len(raw), bool)
        after[:-1] = is_word[1:]
        after[-1:] = False
        tails = offs[1:][offs[1:] > 0] - 1
        after[tails] = False
        self.end = np.flatnonzero(is_word & ~after) + 1
        #: words of text i are first[i] to first[i + 1]
        self.first = np.searchsorted(self.start, offs)
        up, down = _powers(len(raw), BASE), _powers(len(raw), _INVERSE)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((self.text.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=total[1:])
        self.hash = _mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the k words from each position on, does this k-gram stay in its text)."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        g = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            g = g * BASE + self.hash[i:n - k + 1 + i]
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return _mix(g), text[:n - k + 1] == text[k - 1:]

    def span(self, a: int, b: int) -> str:
        """Words a to b, joined by one space."""
        data = self.text[self.start[a]:self.end[b - 1]].tobytes() if b > a else b""
        if not data:
            return ""
        base = self.start[a]
        return b" ".join(data[s - base:e - base] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist())).decode("utf-8", "replace")


def winnowed(grams: np.ndarray, inside: np.ndarray, w: int) -> np.ndarray:
    """Positions chosen by winnowing: the smallest (rightmost on ties) of every ``w`` consecutive
    grams that all lie in one text."""
    if len(grams) < w:
        return np.zeros(0, np.int64)
    n = len(grams) - w + 1
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    whole = inside[:n].copy()
    for i in range(1, w):
        g = grams[i:i + n]
        less = g <= best
        best[less] = g[less]
        at[less] = i
        whole &= inside[i:i + n]
    return np.unique((at + np.arange(n))[whole])


def _rows_schema(id_type: T.DataType) -> T.StructType:
    hit = T.StructType([T.StructField("fp", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("pos", T.IntegerType()),
                        T.StructField("left", T.StringType()), T.StructField("gram", T.StringType()),
                        T.StructField("right", T.StringType())])
    return T.StructType([T.StructField("id", id_type), T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(hit))])


def _fingerprint_rows(k: int, window: int, short: list[int], bits: np.ndarray | None, items: bool):
    """Per text: id, n_words, fingerprints with their surroundings.  Items yield their windows' grams,
    or themselves if they are shorter; documents also all grams of the lengths in ``short``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            words = Words(*utf8(part.column(1)))
            first = words.first
            counts = np.diff(first)
            found: list[tuple[int, int, int]] = []  # (position, k, fp)
            g, inside = words.grams(k)
            at = winnowed(g, inside, window - k + 1)
            if bits is not None:
                at = at[may_hold(bits, g[at])]
            found += [(p, k, f) for p, f in zip(at.tolist(), g[at].view(np.int64).tolist())]
            for length in (sorted(set(counts[(counts > 0) & (counts < window)].tolist())) if items else short):
                g, inside = words.grams(length)
                pick = np.flatnonzero(inside)
                if items:
                    whole = first[:-1][counts == length]
                    pick = whole
                if bits is not None:
                    pick = pick[may_hold(bits, g[pick])]
                found += [(p, -length, f) for p, f in zip(pick.tolist(), g[pick].view(np.int64).tolist())]
            found.sort()
            hits: list[list[dict]] = [[] for _ in counts]
            if found:
                owner = np.searchsorted(first, np.array([f[0] for f in found]), side="right") - 1
                for (p, size, fp), doc in zip(found, owner.tolist()):
                    lo, hi, length = int(first[doc]), int(first[doc + 1]), abs(size)
                    reach = window - length if size > 0 else 0
                    hits[doc].append({"fp": fp, "k": size, "pos": p - lo, "left": words.span(max(lo, p - reach), p),
                                      "gram": words.span(p, p + length),
                                      "right": words.span(p + length, min(hi, p + length + reach))})
            kind = pa.list_(pa.struct([("fp", pa.int64()), ("k", pa.int32()), ("pos", pa.int32()), ("left", pa.string()),
                                       ("gram", pa.string()), ("right", pa.string())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(hits, kind)],
                                             names=["id", "n_words", "hits"])
    return run


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", window: int = 13, k: int = 7, most_bits: int = 1 << 26) -> tuple[DataFrame, DataFrame]:
    """(rows, matches): rows(row, id, n_words) for every input row, matches(row, item, lo, hi) with the
    word span of each extended hit."""
    b = benchmark.select(col(item_col).alias("id"), col(item_text).cast("string").alias("text"))
    schema = _rows_schema(b.schema["id"].dataType)
    found = b.mapInArrow(_fingerprint_rows(k, window, [], None, True), schema)
    items = stored(found.select(F.col("id").alias("item"), F.explode("hits").alias("h")).select("item", "h.*").drop("pos").distinct(),
                   "winnow-items")
    short = sorted(-r[0] for r in items.filter("k < 0").select("k").distinct().collect())  # under ``window`` numbers
    bits = bloom_bits(items.select("fp").distinct(), most_bits)
    d = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    rows = d.mapInArrow(_fingerprint_rows(k, window, short, bits, False), _rows_schema(d.schema["id"].dataType))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "winnow-rows")
    at = rows.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*")
    names = {c: f"i_{c}" for c in ("left", "right")}
    both = at.join(items.withColumnsRenamed(names), ["fp", "k", "gram"])

    def common(a, b_, from_end: bool):
        """Number of equal words of two space-joined strings, counted from the hit outwards."""
        x, y = (F.filter(F.split(c, " "), lambda w: w != "") for c in (a, b_))
        if from_end:
            x, y = F.reverse(x), F.reverse(y)
        same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
        stop = F.array_position(same, F.lit(False))
        return F.when(stop == 0, F.size(same)).otherwise(stop - 1).cast("int")

    size = F.abs("k")
    spans = both.select("row", "item", "k", F.col("pos"), common(F.col("left"), F.col("i_left"), True).alias("l"),
                        common(F.col("right"), F.col("i_right"), False).alias("r"))
    whole = (F.col("k") < 0) | (size + F.col("l") + F.col("r") >= window)
    matches = spans.filter(whole).select("row", "item", (F.col("pos") - F.col("l")).alias("lo"),
                                         (F.col("pos") + size + F.col("r")).alias("hi"))
    return rows.select("row", "id", "n_words"), matches


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", window: int = 13, k: int = 7, share: int = 20) -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``contaminated``: some word is hit and ``share`` * n_hit >= n_words.  Per document the spans
    are first reduced to distinct ones; their union is a running fold over the sorted list."""
    rows, matches = hits(docs, benchmark, id_col, text_col, item_col, item_text, window, k)
    spans = matches.groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"),
                                       F.collect_set(F.coalesce(F.col("item").cast("string"), F.lit(""))).alias("items"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    covered = F.aggregate(F.array_sort("spans"), start, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(s["lo"], a["to"]))).alias("n"),
        F.greatest(a["to"], s["hi"]).alias("to")), lambda a: a["n"])
    per_row = spans.select("row", covered.cast("long").alias("n_hit"), F.array_sort("items").alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return rows.join(per_row, "row", "left").select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated rows; columns unchanged.  Each row is judged by its own text,
    also where ids are null or repeated: rows are dropped by a 16-byte hash of id and text, and no text is
    moved for it."""
    names = [fresh([*docs.columns, text_col], n) for n in ("key_a", "key_b")]
    who = fresh([*docs.columns, text_col, *names], "who")
    keyed = docs.select("*", *[k.alias(n) for k, n in zip(row_keys(col(id_col), col(text_col)), names)])
    found = report(keyed.select(F.struct(*names).alias(who), col(text_col)), benchmark, who, text_col, **options)
    bad = stored(found.filter("contaminated").select(f"{who}.*").distinct(), "contaminated")
    return split_by_keys(keyed, names, bad)[0].drop(*names)


ORACLE_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
ip as (select item_id, ws, least(13, len(ws)) as n, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) as p from i where len(ws) > 0),
win as (select distinct item_id, n, array_to_string(ws[p:p + n - 1], ' ') as g from ip),
lens as (select distinct n from win),
dp as (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as p from w, lens where len(ws) >= n),
d as (select doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') as g from dp),
h as (select distinct doc_id, item_id, d.n, p from d join win on d.g = win.g and d.n = win.n),
hw as (select distinct doc_id, unnest(range(p, p + n)) as q from h),
c as (select doc_id, count(*) as n_hit from hw group by doc_id),
it as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items
  from h group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from w left join c using (doc_id) left join it using (doc_id)
"""
