"""Secret scans with multipart credential linking (operator 8), DataFrame functions only.

Base matches per text, each kind leftmost and non-overlapping:
  assign  name, separator and a value of 6+ characters
  access  access key identifiers of 20+ characters
  hex     hexadecimal runs of 24+ characters
Method: credentials come in parts.  Bare 40-character tokens (``secret``) and service
addresses (``endpoint``) are weak by themselves: each is reported only if a complementary
part (an access identifier for a secret, an access identifier or secret value for an
endpoint) starts within ``scope`` characters of it in the same text.  An interval join of
weak parts and anchors within that scope (see ``link``) says which belong together: each
weak part goes to its nearest anchor, and an anchor with its parts is one credential.

Positions are code points, ends exclusive.  Null texts count as empty.  Every row is
scanned by itself: repeated rows and repeated or null ids give one output row each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, stored

# The base patterns of the contract, with the letters' cases written out.
ASSIGN = (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
          r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# A run that is long enough is matched from its first character either way, so the least length is in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# The weak parts.
SECRET = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?"

KINDS = ["assign", "access", "hex", "secret", "endpoint"]


def spans(text: Column, pattern: str, value_group: int, least: int, prefilter: str) -> Column:
    """array<struct<s, e>> of the matches whose group ``value_group`` has ``least``+ characters.

    Splitting a text at its matches gives the gaps between them; running sums of the lengths
    of gaps and matches are the positions.  Texts without ``prefilter`` skip both passes."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    between = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.transform(F.slice(between, 1, F.size(found)), lambda g: F.length(g)).alias("gap"),
                          F.transform(found, lambda h: F.length(h)).alias("hit"),
                          F.transform(values, lambda v: F.length(v) >= least).alias("keep"))
    placed = _let(zipped, lambda hits: _let(F.ceil(F.sqrt(F.size(hits))).cast("int"), lambda w: _running(hits, w)))
    kept = F.transform(F.filter(placed, lambda x: x["keep"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    return F.when(text.rlike(prefilter), kept).otherwise(none)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(hits: Column, width: Column) -> Column:
    """array<struct<s, e, keep>> of array<struct<gap, hit, keep>>: running sums in stretches of ``width`` hits.

    A fold that builds an array copies it at every step, so it runs over a stretch only: with stretches of the
    square root of n hits the copies are n^1.5 in all, and a text of millions of hits is no trouble."""
    stretch = lambda c: F.slice(hits, c * width + 1, width)
    numbers = F.sequence(F.lit(0), F.ceil(F.size(hits) / width).cast("int") - 1)
    length = lambda c: F.aggregate(stretch(c), F.lit(0), lambda a, x: a + x["gap"] + x["hit"])
    first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    starts = F.aggregate(F.transform(numbers, length), first, lambda a, n: F.struct(
        (a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def place(c: Column, at: Column) -> Column:
        zero = F.struct(at.alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,keep:boolean>>)").alias("out"))
        return F.aggregate(stretch(c), zero, lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["hit"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("s"), (a["at"] + x["gap"] + x["hit"]).alias("e"),
                                                x["keep"].alias("keep")))).alias("out")), lambda a: a["out"])

    return _let(starts, lambda s: F.flatten(F.transform(numbers, lambda c: place(c, F.get(s, c)))))


def _base(text: Column) -> list[Column]:
    return [spans(text, ASSIGN, 1, 6, ASSIGN).alias("assign"), spans(text, ACCESS, 0, 20, ACCESS).alias("access"),
            spans(text, HEX, 0, 24, HEX).alias("hex"), spans(text, SECRET, 0, 40, SECRET).alias("secret"),
            spans(text, ENDPOINT, 0, 8, ENDPOINT).alias("endpoint")]


def _listed(parts: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined, of array<struct<s, k, e>>."""
    text = F.transform(F.array_sort(parts), lambda x: F.concat_ws(
        ":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["k"] + 1), x["s"].cast("string"), x["e"].cast("string")))
    return F.array_join(text, ",")


def _tagged(name: str) -> Column:
    k = KINDS.index(name)
    return F.transform(F.col(name), lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def link(parts: DataFrame, scope: int) -> DataFrame:
    """(row, k, s, e, by_k, by_s): every weak part of ``parts(row, k, s, e)`` with an anchor whose start lies within
    ``scope`` characters of its own, and the nearest such anchor (ties: the earlier one).

    An access identifier anchors secrets and endpoints, an assigned value endpoints.  An interval join: an
    anchor is listed under its stretch of ``scope`` characters and both beside it, so parts meet by an
    equi-join on (text, stretch).  Parts do not overlap within a kind, so a weak part meets a bounded number
    of anchors, and one text with very many parts is spread over its stretches."""
    stretch = F.floor(F.col("s") / scope)
    kind = {k: KINDS.index(k) for k in KINDS}
    anchors = parts.filter(F.col("k").isin(kind["access"], kind["assign"])).select(
        "row", F.col("k").alias("by_k"), F.col("s").alias("by_s"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("at"))
    weak = parts.filter(F.col("k").isin(kind["secret"], kind["endpoint"])).select("row", "k", "s", "e", stretch.alias("at"))
    near = F.abs(F.col("s") - F.col("by_s"))
    fits = (F.col("by_k") == kind["access"]) | (F.col("k") == kind["endpoint"])
    return (weak.join(anchors, ["row", "at"]).filter(fits & (near <= scope)).groupBy("row", "k", "s", "e")
            .agg(F.min(F.struct(near.alias("gap"), "by_s", "by_k")).alias("n")).select("row", "k", "s", "e", "n.by_s", "n.by_k"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 400) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_linked, credentials.

    ``credentials`` lists each credential put together: the anchor and its weak parts in order, joined by
    ``+``, credentials by ``,``; the anchor's kind and start are the credential's id within the text."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    found = docs.select(col(id_col).alias("id"), text.alias("text")).select("id", *_base(F.col("text")))
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "secret-parts")
    weak = (F.size("secret") > 0) | (F.size("endpoint") > 0)
    parts = (found.filter(weak & ((F.size("access") > 0) | (F.size("assign") > 0)))
             .select("row", F.explode(F.concat(*[_tagged(k) for k in ("assign", "access", "secret", "endpoint")])).alias("p"))
             .select("row", "p.s", "p.k", "p.e"))
    credentials = link(parts, scope).groupBy("row", "by_s", "by_k").agg(F.collect_list(F.struct("s", "k", "e")).alias("weak"))
    names = F.array(*[F.lit(k) for k in KINDS])
    written = F.concat_ws("+", F.concat_ws(":", F.element_at(names, F.col("by_k") + 1), "by_s"), F.array_join(F.transform(
        F.array_sort("weak"), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), "+"))
    linked = credentials.groupBy("row").agg(
        F.flatten(F.collect_list("weak")).alias("linked"), F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct("by_s", "by_k", written.alias("w")))), lambda x: x["w"]), ",").alias("credentials"))
    base = F.concat(*[_tagged(k) for k in KINDS[:3]])
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")
    linked_or_none = F.coalesce(F.col("linked"), none)
    return found.join(linked, "row", "left").select(
        F.col("id").alias(id_col), F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.concat(base, linked_or_none)).alias("spans"),
        F.size(linked_or_none).cast("long").alias("n_linked"), F.coalesce("credentials", F.lit("")).alias("credentials"))
