"""SimHash near-dedup with BK-trees (operator 9).

1. Fingerprints: one 64-bit SimHash per text over its word shingles, Arrow batches,
   no shuffle; distinct fingerprints are the nodes from here on, so copies cost nothing.
2. Shards: fingerprints within ``radius`` bits agree on at least ``blocks - radius`` of
   ``blocks`` bit blocks, so each fingerprint goes to one shard per choice of that many
   blocks, and any two linked ones meet in a shard.  ``blocks`` grows with the number of
   fingerprints so that a shard stays small at any size.
3. Trees: a shard is cut into chunks of at most ``chunk`` fingerprints; each chunk is a
   BK-tree (children keyed by Hamming distance to the parent), and the chunk trees are sent to
   the shard's other chunks, whose fingerprints search them following only the edges within the
   radius.  So one shard full of near copies is dealt to many tasks.  A search returns not all
   pairs but a spanning forest of the links it saw: at most one row per fingerprint.
4. Components by alternating large-star and small-star steps over the links.

Null texts and texts without words have fingerprint zero and link like any other.  A
component's id is its smallest doc_id (null only if it has no other).  Rows that repeat an
id get a row each.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, row_keys, slices, split_by_keys, stored, utf8

LEAF = 8


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of one UTF-8 text: a bit is 1 if set in over half the shingle hashes."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    n = len(words) - shingle + 1
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[shingle - 1:].tolist())),
                         np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        ones += np.unpackbits(hashes[at:at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4) -> DataFrame:
    """id, fp (the 64 bits as a signed long) per row, stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            offs, raw = utf8(part.column(1))
            data, offs = raw.tobytes(), offs.tolist()
            fps = np.fromiter((fingerprint(data[a:b], shingle) for a, b in zip(offs, offs[1:])), np.uint64, len(offs) - 1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.LongType())])
    return stored(rows.mapInArrow(run, schema), "simhash")


# ---------------------------------------------------------------- BK-trees

class BkTree:
    """Burkhard-Keller tree over 64-bit fingerprints.

    A node is (pivot, {distance: child}); below ``LEAF`` fingerprints a child is a plain
    array.  Searches run for many queries at once."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.root = self._build(np.arange(len(fps)))

    def _build(self, members: np.ndarray):
        if len(members) <= LEAF:
            return members
        pivot, rest = members[0], members[1:]
        d = np.bitwise_count(self.fps[rest] ^ self.fps[pivot])
        order = np.argsort(d, kind="stable")
        rest, d = rest[order], d[order]
        values, first = np.unique(d, return_index=True)
        return pivot, {int(v): self._build(part) for v, part in zip(values, np.split(rest, first[1:]))}

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(members, query numbers, within) for each visited node: within[i, j] says whether
        member i is inside the radius of query j."""
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            node, asked = todo.pop()
            if isinstance(node, np.ndarray):
                for at in range(0, len(asked), 4096):
                    q = asked[at:at + 4096]
                    yield node, q, np.bitwise_count(self.fps[node][:, None] ^ queries[q][None, :]) <= radius
                continue
            pivot, children = node
            d = np.bitwise_count(queries[asked] ^ self.fps[pivot]).astype(np.int16)
            yield np.array([pivot]), asked, (d <= radius)[None, :]
            for edge, child in children.items():
                follow = asked[np.abs(d - edge) <= radius]
                if len(follow):
                    todo.append((child, follow))


class Forest:
    """Union-find over the members of one search, with vectorised merging."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if np.array_equal(up, r):
                self.parent[x] = r
                return r
            r = up

    def merge(self, members: np.ndarray, others: np.ndarray, within: np.ndarray) -> None:
        """Unite along ``within``; each round joins every member to one tree it still misses."""
        if not within.any():
            return
        while True:
            a, b = self.roots(members), self.roots(others)
            apart = within & (a[:, None] != b[None, :])
            rows = np.flatnonzero(apart.any(1))
            if not len(rows):
                return
            for i, j in zip(rows, apart[rows].argmax(1)):
                x, y = self.roots(np.array([members[i], others[j]]))
                if x != y:
                    self.parent[max(x, y)] = min(x, y)


def link_chunks(tree_fps: np.ndarray, query_fps: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (fp, root fp) of all links inside a chunk (no queries) or between two."""
    queries = tree_fps if query_fps is None else query_fps
    fps = tree_fps if query_fps is None else np.concatenate([tree_fps, query_fps])
    shift = 0 if query_fps is None else len(tree_fps)
    forest = Forest(len(fps))
    for members, asked, within in BkTree(tree_fps).search(queries, radius):
        forest.merge(members, asked + shift, within)
    roots = forest.roots(np.arange(len(fps)))
    moved = np.flatnonzero(roots != np.arange(len(fps)))
    return fps[moved], fps[roots[moved]]


def block_plan(n: int, radius: int, per_shard: int = 512) -> list[list[tuple[int, int]]]:
    """For ``n`` fingerprints: the choices of bit blocks (first bit, bits) that make shard keys.
    The fewest blocks whose keys leave at most ``per_shard`` random fingerprints in a shard."""
    for blocks in range(radius + 1, 65):
        edges = [64 * i // blocks for i in range(blocks + 1)]
        cut = [(a, b - a) for a, b in zip(edges, edges[1:])]
        kept = blocks - radius
        bits = min(sum(w for _, w in c) for c in combinations(cut, kept))
        if n / 2.0 ** bits <= per_shard:
            return [list(c) for c in combinations(cut, kept)]
    return [[(0, 64)]]


def _link_rows(radius: int):
    """Rows sorted by (choice, key, pair, side): each run of equal (choice, key, pair) is one search."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def search(block: np.ndarray):
            sides = block[:, 4]
            tree, query = block[sides == 0, 3].view(np.uint64), block[sides == 1, 3].view(np.uint64)
            alone = len(block) and block[0, 5] == 0
            if alone:
                return link_chunks(tree, None, radius) if len(tree) > 1 else None
            return link_chunks(tree, query, radius) if len(tree) and len(query) else None

        def finish(rows: np.ndarray, last: bool):
            same = (rows[1:, :3] == rows[:-1, :3]).all(1)
            cuts = np.flatnonzero(~same) + 1
            bounds = np.concatenate(([0], cuts, [len(rows)]))
            stop = len(bounds) - 1 if last else len(bounds) - 2
            out = [r for a, b in zip(bounds[:stop], bounds[1:stop + 1]) if b - a > 1 and (r := search(rows[a:b]))]
            rest = rows[bounds[stop]:] if not last else rows[:0]
            u = np.concatenate([o[0] for o in out]) if out else np.zeros(0, np.uint64)
            v = np.concatenate([o[1] for o in out]) if out else np.zeros(0, np.uint64)
            return rest, pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)
            held.append(rows)
            if (rows[0, :3] != rows[-1, :3]).any():
                rest, out = finish(np.concatenate(held), False)
                held = [rest]
                yield out
        if held and len(rows := np.concatenate(held)):
            yield finish(rows, True)[1]
    return run


def links(nodes: DataFrame, radius: int = 4, chunk: int = 2048, per_shard: int = 512) -> DataFrame:
    """Stored links (u, v) between distinct fingerprints ``nodes(fp)`` that keep their components."""
    n = nodes.count()
    choices = block_plan(n, radius, per_shard)
    keys = []
    for number, blocks in enumerate(choices):
        key = F.lit(0).cast("long")
        for first, width in blocks:
            part = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("long"))
            key = F.shiftleft(key, width).bitwiseOR(part) if width < 64 else part
        keys.append(F.struct(F.lit(number).alias("choice"), key.alias("key")))
    dealt = nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.choice", "k.key", "fp")
    large = stored(dealt.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > 1)
                   .withColumn("chunks", F.ceil(F.col("members") / chunk).cast("int")), "simhash-shards")
    parts = dealt.join(large.select("choice", "key", "chunks"), ["choice", "key"]).withColumn(
        "mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    # chunk a searches the trees of chunks b < a and its own; pair number = a * chunks + b
    own = F.array(F.struct((F.col("mine") * F.col("chunks") + F.col("mine")).alias("pair"), F.lit(0).alias("side"), F.lit(0).alias("two")))
    as_query = F.transform(F.when(F.col("mine") > 0, F.sequence(F.lit(0), F.col("mine") - 1)).otherwise(F.array().cast("array<int>")),
                           lambda b: F.struct((F.col("mine") * F.col("chunks") + b).alias("pair"), F.lit(1).alias("side"), F.lit(1).alias("two")))
    as_tree = F.transform(F.when(F.col("mine") < F.col("chunks") - 1, F.sequence(F.col("mine") + 1, F.col("chunks") - 1)).otherwise(F.array().cast("array<int>")),
                          lambda a: F.struct((a * F.col("chunks") + F.col("mine")).alias("pair"), F.lit(0).alias("side"), F.lit(1).alias("two")))
    searches = parts.select("choice", "key", "fp", F.explode(F.concat(own, as_query, as_tree)).alias("s")).select(
        "choice", "key", "s.pair", "fp", "s.side", "s.two")
    spread = searches.repartition("choice", "key", "pair").sortWithinPartitions("choice", "key", "pair", "side", "fp")
    return stored(spread.mapInArrow(_link_rows(radius), "u long, v long").distinct(), "simhash-links")


# ---------------------------------------------------------------- components

def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges(u, v)``, root being the smallest node reachable.

    Large-star connects a node's larger neighbours to its smallest one, small-star its smaller
    ones; both only group by node with map-side minima and join back, so a hub is split by the
    skew join.  Each round is stored; rounds grow with the logarithm of the nodes."""
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        large = stored(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                                               F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").filter("u <> v").distinct())
        small = stored(small, "small-star")
        # done when every node hangs on one root and no root hangs on anything
        roots = small.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        chained = small.select(F.col("v").alias("u")).distinct().join(small.select("u"), "u", "left_semi")
        if roots.filter("lo <> hi").isEmpty() and chained.isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = small


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4,
                    chunk: int = 2048) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id."""
    rows = fingerprints(docs, id_col, text_col, shingle)
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-nodes")
    member = components(links(nodes.select("fp"), radius, chunk))
    named = nodes.join(member, nodes["fp"] == member["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = stored(named.join(least, "root").select("fp", "component_id"), "simhash-components")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(of_fp, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each component, one with the smallest id (a null id only if there is no
    other; of rows that repeat id and text any one).  Rows are told apart by a 16-byte hash of id and text, so
    neither a copy of the table nor a shuffle of its texts is needed."""
    names = [fresh([*docs.columns, text_col], n) for n in ("key_a", "key_b")]
    who = fresh([*docs.columns, text_col, *names], "who")
    keyed = docs.select("*", *[k.alias(n) for n, k in zip(names, row_keys(col(id_col), col(text_col)))])
    ranked = F.struct(col(id_col).isNull().alias("none"), col(id_col).alias("id"), *names).alias(who)
    found = near_duplicates(keyed.select(ranked, col(text_col)), who, text_col, shingle, radius)
    same = F.lit(True)
    for n in names:
        same = same & (F.col(who)[n] == F.col("component_id")[n])
    marked = found.select(*[F.col(who)[n].alias(n) for n in names], same.alias("stays")).groupBy(*names).agg(
        F.first("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    listed = stored(marked.filter("not stays or n > 1"), "simhash-listed")
    out = split_by_keys(keyed, names, listed.select(*names))[0]
    repeated = listed.filter("stays").select(*names)
    if not repeated.isEmpty():
        out = out.unionByName(split_by_keys(keyed, names, repeated)[1].dropDuplicates(names))
    return out.drop(*names)
