"""Conversation prefix trie (operator 12): fixed-length block hashing, refined where siblings diverge.

Every conversation is cut into blocks of ``BLOCK`` turns.  A block is known by the digest of its turns and
by the key of all blocks before it, so conversations are first grouped by successive block digests: a
group of equal blocks is one row from then on, however many conversations run through it.  Turn
boundaries inside a block are looked at only where one parent has several different blocks; there the
distinct blocks (not the conversations) are opened and grouped by their shared first turns.  A block
without such siblings is a chain, and its nodes take the block's figures as they are.

Sums over subtrees need no walk over the tree.  A node is named after its smallest member.  The nodes
named after one conversation form the end of its path, from where it leaves the paths of smaller
conversations.  So a node's subtree holds as many leaves as members whose own end is a leaf of that name,
and saves, for each member but the smallest, the bytes from the node to the point where that member leaves.

Scale: texts become a digest and a byte count in the first scan and are never moved.  The key of a prefix
is a sum of position-bound block hashes, so it is a running sum; turn numbers and keys are running sums
within stretches of a conversation plus the totals of earlier stretches, so one endless conversation is
spread over tasks.  Members of a node that end there are hashed from packed, sorted stretches of ids as
they stream by.

Limit: the rows of one conversation whose turn numbers lie within one stretch of ``STRETCH`` (or are all null) are
ordered in one task, as digests; such a window spills.

Defined results: turns of equal number go by the digest of role and text; rows without conv_id belong to no
conversation and count nowhere; null role and text are empty; repeated rows are turns of their own; an
empty table has no nodes.  Columns other than the four named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import null_safe_join
from .common import col, stored

BLOCK = 4
STRETCH = 256
PACK_BITS = 12
LANES = 4


def digest(*parts: Column) -> Column:
    """128 bits of SHA-256 in hex."""
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def running_before(df: DataFrame, key: str, order: list, stretch: Column, sums: dict[str, Column]) -> DataFrame:
    """Add, per name, the sum of the column over the earlier rows of the same key (0 for its first row).

    ``stretch`` is a coarse number that follows the order; its rows are one window, and the totals of a
    key's earlier stretches are added to them.  Columns ``<name>_all`` hold the key's sum up to the end of the row's stretch."""
    d = df.select("*", stretch.alias("_s"), *[c.alias(f"_v_{n}") for n, c in sums.items()])
    w = Window.partitionBy(key, "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = d.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(w), F.lit(0)).alias(n) for n in sums])
    totals = d.groupBy(key, "_s").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    wk = Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select(key, "_s", *[F.coalesce(F.sum(f"_t_{n}").over(wk), F.lit(0)).alias(f"_e_{n}") for n in sums])
    both = null_safe_join(within, earlier, [key, "_s"])
    return both.select(*df.columns, *[(F.col(n) + F.col(f"_e_{n}")).alias(n) for n in sums])


def rebuild(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(turns, convs): rebuilt turns (conv_id, depth from 1, digest, bytes) and every conv_id with its turn count.

    The first h original turns of conversation c - c % 5 stand before what follows c's own first h, h = crc32(c) % 9."""
    role, text = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(col(conv_col).isNotNull()).select(
        col(conv_col).cast("long").alias("conv_id"), col(turn_col).alias("turn"),
        digest(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    numbered = stored(running_before(rows, "conv_id", [F.asc_nulls_first("turn"), "digest"], F.floor(F.col("turn") / STRETCH),
                                     {"place": F.lit(1).cast("long")}).select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "bytes"), "turns")
    lengths = numbered.groupBy("conv_id").agg(F.max("depth").alias("turns"))
    heads = lengths.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    convs = (lengths.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % 9)
             .withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).join(heads, "base", "left")
             .withColumn("head", F.least("h", F.coalesce("base_turns", F.lit(0)))).select("conv_id", "base", "h", "head", "turns"))
    convs = stored(convs, "convs")
    first = numbered.where("depth <= 8").withColumnRenamed("conv_id", "base")
    taken = first.join(convs.select("conv_id", "base", "head"), "base").where("depth <= head").select("conv_id", "depth", "digest", "bytes")
    own = numbered.join(convs.select("conv_id", "h", "head"), "conv_id").where("depth > h")
    own = own.select("conv_id", (F.col("depth") - F.col("h") + F.col("head")).alias("depth"), "digest", "bytes")
    return taken.unionByName(own), convs.select("conv_id")


def blocks_of(turns: DataFrame) -> DataFrame:
    """One row per conversation and block: its turns, the key of all before it and its own key."""
    cut = turns.groupBy("conv_id", F.floor((F.col("depth") - 1) / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("depth", "digest", "bytes"))).alias("turns"))  # BLOCK turns at most
    whole = cut.withColumn("body", digest(F.array_join(F.transform("turns", lambda t: t["digest"]), ",")))
    lanes = {f"lane{i}": F.shiftrightunsigned(F.xxhash64(F.lit(i), "block", "body"), 24) for i in range(LANES)}
    size = F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["bytes"])
    d = running_before(whole, "conv_id", ["block"], F.floor(F.col("block") / STRETCH), lanes | {"before": size})
    key = lambda number, sums: digest(F.concat_ws(",", number, *sums))
    before = [F.col(n) for n in lanes]
    return d.select("conv_id", "block", "turns", "before", size.alias("size"), key(F.col("block"), before).alias("start"),
                    key(F.col("block") + 1, [F.col(n) + c for n, c in lanes.items()]).alias("stop"))


ROOT = ",".join(["0"] * (LANES + 1))


def opened(blocks: DataFrame, *figures: str) -> DataFrame:
    """One row per turn boundary of each block: node, parent, depth, bytes of the last turn and of all before it."""
    names = F.transform("turns", lambda t: t["digest"])
    part = lambda j: F.when(j == 0, F.col("start")).when(j == BLOCK, F.col("stop")).otherwise(
        digest(F.col("start"), F.lit("/"), F.array_join(F.slice(names, F.lit(1), j), ",")))
    each = F.transform("turns", lambda t, i: F.struct(
        part(i + 1).alias("node"), part(i).alias("parent"), t["depth"].cast("long").alias("depth"),
        (F.col("before") + F.aggregate(F.slice("turns", F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x["bytes"])).alias("before")))
    return blocks.select(*figures, F.explode(each).alias("n")).select(*figures, "n.*")


def refine(distinct: DataFrame, figures: dict[str, Column]) -> DataFrame:
    """Nodes of the distinct blocks with their figures; blocks are opened and grouped only beside siblings."""
    alone = opened(distinct.where("siblings = 1"), *figures)
    beside = opened(distinct.where("siblings > 1"), *figures).groupBy("node", "parent", "depth", "before").agg(
        *[c.alias(n) for n, c in figures.items()])
    return alone.unionByName(beside).select("node", "parent", "depth", "before", *figures)


def ends_hash(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): SHA-256 of the decimal ids in order, joined by commas, in bounded memory."""
    packed = ends.groupBy("node", F.shiftright("conv_id", PACK_BITS).alias("pack")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "ends_sha256"]
        now, state = None, None
        for batch in batches:
            nodes, sums = [], []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node != now:
                    if state is not None:
                        nodes.append(now)
                        sums.append(state.hexdigest())
                    now, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(sums, pa.string())], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([state.hexdigest()], pa.string())], names=names)

    return packed.repartition("node").sortWithinPartitions("node", "pack").select("node", "ids").mapInArrow(stream, "node string, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuild(conversations, conv_col, turn_col, role_col, text_col)
    root_node = digest(F.lit(ROOT))
    blocks = stored(blocks_of(turns), "blocks")
    # the way of every conversation: its node at the end and its bytes
    last = blocks.withColumn("n", F.size("turns")).select(
        "conv_id", "size", F.struct("block", F.when(F.col("n") == BLOCK, F.col("stop")).otherwise(
            digest(F.col("start"), F.lit("/"), F.array_join(F.transform("turns", lambda t: t["digest"]), ","))).alias("node")).alias("last"))
    paths = last.groupBy("conv_id").agg(F.max("last")["node"].alias("node"), F.sum("size").alias("total"))
    paths = stored(convs.join(paths, "conv_id", "left").select(
        "conv_id", F.coalesce("node", root_node).alias("node"), F.coalesce("total", F.lit(0)).alias("total")), "paths")

    # groups of equal blocks behind equal prefixes; then how many different blocks follow one prefix
    same = blocks.groupBy("start", "stop").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"),
                                               F.first("turns").alias("turns"), F.first("before").alias("before"))
    same = stored(same, "equal-blocks")
    distinct = stored(same.join(same.groupBy("start").agg(F.count(F.lit(1)).alias("siblings")), "start"), "distinct-blocks")
    root = lambda figures, source: source.agg(*figures).select(
        root_node.alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("before"), "*")
    counts = {"n_convs": F.sum("n_convs"), "conv_id": F.min("conv_id")}
    top = root([F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")], paths).where("n_convs > 0")
    nodes = refine(distinct, counts).unionByName(top)
    children = nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).where("parent is not null")
    nodes = stored(nodes.join(children.withColumnRenamed("parent", "node"), "node", "left")
                   .withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    # where each conversation leaves the smaller ones (never: all its bytes are shared), and whether its end is a leaf of its name
    owners = nodes.groupBy("conv_id").agg(F.min("before").alias("shared"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    members = stored(paths.join(owners, "conv_id", "left").select(
        "conv_id", F.coalesce("shared", "total").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "members")
    sums = {"shared": F.sum("shared"), "leaf": F.sum("leaf")}
    through = blocks.select("conv_id", "start", "stop").join(members, "conv_id").groupBy("start", "stop").agg(*[c.alias(n) for n, c in sums.items()])
    below = refine(distinct.join(through, ["start", "stop"]), sums).select("node", *sums).unionByName(
        root([c.alias(n) for n, c in sums.items()], members).select("node", *sums))

    named = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    smallest = members.select("conv_id", F.col("shared").alias("mine"))
    out = (nodes.join(below, "node").join(ends_hash(paths.select("node", "conv_id")), "node", "left")
           .join(named, "parent", "left").join(smallest, "conv_id"))
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaf").alias("n_leaves"),
        (F.col("shared") - F.col("mine") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


#: Every prefix of every rebuilt conversation by its turns' texts themselves; subtree sums by joining each
#: node with all nodes behind it; CRC-32 bit by bit (a byte is followed by eight shifts, written as -1).
ORACLE_SQL = """
with o as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first,
        substr(sha256(cast(strlen(coalesce(role, '')) as varchar) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) as depth
  from conversations where conv_id is not null),
ids as (select conv_id, max(depth) as turns, cast(conv_id as varchar) as name from o group by conv_id),
bits as (select conv_id, turns, list_reduce(
    list_prepend(cast(4294967295 as bigint), flatten(list_transform(range(1, length(name) + 1),
      lambda i: list_prepend(cast(ascii(substr(name, cast(i as integer), 1)) as bigint), [-1, -1, -1, -1, -1, -1, -1, -1])))),
    lambda a, x: case when x >= 0 then xor(a, x) else xor(a // 2, 3988292384 * (a % 2)) end) as crc from ids),
c as (select b.conv_id, b.conv_id - b.conv_id % 5 as base, xor(crc, 4294967295) % 9 as h from bits b),
p as (select c.*, least(c.h, coalesce(i.turns, 0)) as head from c left join ids i on i.conv_id = c.base),
r as (select p.conv_id, o.depth, o.role, o.text from p join o on o.conv_id = p.base where o.depth <= p.head
  union all select p.conv_id, o.depth - p.h + p.head, o.role, o.text from p join o on o.conv_id = p.conv_id where o.depth > p.h),
pre as (select a.conv_id, a.depth, max(case when b.depth = a.depth then strlen(b.text) end) as bytes,
    string_agg(cast(strlen(b.role) as varchar) || ':' || b.role || cast(strlen(b.text) as varchar) || ':' || b.text, '' order by b.depth) as path
  from r a join r b on a.conv_id = b.conv_id and b.depth <= a.depth group by a.conv_id, a.depth
  union all select conv_id, 0, 0, '' from p),
size as (select conv_id, max(depth) as len from pre group by conv_id),
way as (select pre.*, size.len from pre join size using (conv_id)),
node as (select path, depth, min(conv_id) as conv_id, count(*) as n_convs, max(bytes) as bytes,
    sha256(coalesce(string_agg(case when len = depth then cast(conv_id as varchar) end, ',' order by conv_id), '')) as ends_sha256
  from way group by path, depth),
up as (select distinct b.path, a.path as parent from way a join way b on a.conv_id = b.conv_id and b.depth = a.depth + 1),
kids as (select parent, count(*) as n from up group by parent),
below as (select distinct a.path as top, b.path as path from way a join way b on a.conv_id = b.conv_id and b.depth >= a.depth),
sums as (select below.top, sum((n.n_convs - 1) * n.bytes) as saved, sum(case when k.n is null then 1 else 0 end) as leaves
  from below join node n on n.path = below.path left join kids k on k.parent = below.path group by below.top)
select n.conv_id, cast(n.depth as bigint) as depth, q.conv_id as parent_conv_id, n.n_convs, cast(coalesce(k.n, 0) as bigint) as n_children,
  cast(s.leaves as bigint) as n_leaves, cast(s.saved as bigint) as saved_tokens, n.ends_sha256
from node n join sums s on s.top = n.path left join kids k on k.parent = n.path
left join up on up.path = n.path left join node q on q.path = up.parent
"""
