"""Operators on groups of texts against brute force: exact dedup, winnowing, shards, SimHash, WARC, chats."""

import base64
import gzip
import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskspark.llm import chat, dedup, queries, shards, simhash, warc, winnow

from llm_data import AWKWARD, documents


# ---------------------------------------------------------------- exact dedup

def brute_groups(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {t: (keep([i for i in ids if i is not None], default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, keep, weak):
    """``weak`` makes almost all hashes collide, so only the bytes tell texts apart."""
    rows = [*AWKWARD, *[(100 + i, f"copy {i % 3}") for i in range(40)], (500, "Tie"), (501, "tie ")]
    docs = documents(spark, rows)
    options = {"hash_of": lambda t: F.substring(F.sha1(t), 1, 1)} if weak else {}
    want = brute_groups(rows, max if keep == "max" else min)
    got = dedup.report(docs, keep=keep, **options).collect()
    exp = sorted(((i, *want[t or ""], i == want[t or ""][0], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == exp
    kept = dedup.drop_duplicates(docs, keep=keep, **options)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr) == sorted(((k, t) for t, (k, _) in want.items()), key=repr)
    assert dedup.report(docs.limit(0)).count() == 0 and dedup.drop_duplicates(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- decontamination

def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(docs, items, size):
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        n = min(size, len(w))
        for p in range(len(w) - n + 1) if w else []:
            windows[tuple(w[p:p + n])].add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if own := windows.get(tuple(w[p:p + n])):
                    hit.update(range(p, p + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size,k", [(13, 7), (5, 3), (6, 6)])
def test_winnowing_equals_brute_force(spark, size, k):
    rnd = random.Random(size)
    word = lambda: rnd.choice(["the", "a", "éa", "Of", "x9", "日本", "to"])
    items = [(i, " ".join(word() for _ in range(rnd.randint(1, 30)))) for i in range(25)] + [(None, "null item of words " * 5), (77, None), (78, "!"), (79, "")]
    docs = [(i, " ".join(word() for _ in range(rnd.randint(0, 60)))) for i in range(40)]
    for j in range(25):
        a = items[j][1].split()
        docs.append((200 + j, " ".join(word() for _ in range(rnd.randint(0, 9))) + " - " + ", ".join(a[rnd.randint(0, 2):]).upper() + "\n" + word()))
    docs += [*AWKWARD, (400, "z " * 9000 + items[3][1]), (200, docs[40][1])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = winnow.report(documents(spark, docs), bench, window=size, k=k).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_hits(docs, items, size)


def test_winnowing_edges(spark, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    got = winnow.report(awkward, none).collect()
    assert len(got) == len(AWKWARD) and not any(r.n_hit or r.contaminated for r in got)
    assert winnow.decontaminate(awkward, none).columns == awkward.columns
    some = spark.createDataFrame([(1, "null id")], none.schema)
    assert sorted((r.doc_id or 0) for r in winnow.decontaminate(awkward, some).collect()) == sorted(i for i, t in AWKWARD if t != "null id")
    assert winnow.report(awkward.limit(0), some).count() == 0


def test_rows_with_null_or_repeated_ids_are_dropped_one_by_one(spark):
    bad, clean = "these words stand in the benchmark", "a clean text of other words"
    docs = documents(spark, [(None, bad), (None, clean), (None, None), (7, bad), (7, clean), (7, ""), (8, bad)])
    bench = spark.createDataFrame([(1, bad)], "item_id long, text string")
    left = winnow.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([(None, clean), (None, None), (7, clean), (7, "")], key=repr)
    docs = documents(spark, [(None, bad), (None, bad), (None, clean), (7, clean), (7, clean), (7, "one two three four five six"), (3, "x y z")])
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(None, bad), (7, clean), (7, "one two three four five six"), (3, "x y z")], key=repr)


# ---------------------------------------------------------------- shards

def test_shards_equal_brute_force(spark):
    rnd = random.Random(9)
    rows = [(i, "x" * rnd.randint(0, 90)) for i in range(300)] + [(999, "big" * 200)] + [(1000, "same" * 9)] * 23 + [(None, None), (None, "")]
    limit = 300
    got = shards.assign(documents(spark, rows), max_bytes=limit)
    out = got.collect()
    assert len(out) == len(rows) and sum(r.n_bytes for r in out) == sum(len(t or "") for _, t in rows)
    by_shard = defaultdict(list)
    for r in out:
        by_shard[r.shard].append(r)
    for shard, members in by_shard.items():
        total = sum(r.n_bytes for r in members)
        assert {r.shard_bytes for r in members} == {total} and {r.shard_rows for r in members} == {len(members)}
        assert total <= limit or members[0].oversize and len(members) == 1
    bits = [s.split("/")[0] for s in by_shard]
    assert not any(a != b and b.startswith(a) for a in bits for b in bits)  # a directory is prefix-free
    h = {i: int(hashlib.md5(f"{i}:{t}".encode()).hexdigest()[:15], 16) for i, t in rows if i is not None and i < 999}
    size = {i: len(t) for i, t in rows if i is not None and i < 999}
    everyone = [(int(hashlib.md5(f"{'~' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16), len(t or "")) for i, t in rows]
    for r in out:
        if r.doc_id in size and "/" not in r.shard:  # the parent of a bucket did not fit
            d = r.depth
            assert f"{h[r.doc_id]:060b}"[:d] == r.shard if d else r.shard == "-"
            if d:
                assert sum(b for x, b in everyone if x >> (60 - d + 1) == h[r.doc_id] >> (60 - d + 1)) > limit
    assert shards.assign(documents(spark, rows).limit(0), max_bytes=limit).count() == 0
    assert {r.shard for r in shards.assign(documents(spark, rows), max_bytes=1 << 30).collect()} == {"-"}


# ---------------------------------------------------------------- SimHash

def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    ones = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(values, radius):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def check_simhash(got, rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    distinct = sorted(set(fps))
    root = dict(zip(distinct, brute_components(distinct, 4)))
    least = {}
    for (i, _), fp in zip(rows, fps):
        if i is not None:
            least[root[fp]] = min(i, least.get(root[fp], i))
    want = sorted(((i, f"{fp:016x}", least.get(root[fp])) for (i, _), fp in zip(rows, fps)), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_simhash_on_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check_simhash(queries.op9_simhash_dedup(spark, sf).collect(), [tuple(r) for r in docs])


def test_simhash_edges(spark):
    rnd = random.Random(4)
    base = [rnd.choice("alpha beta gamma delta eta".split()) + str(i % 50) for i in range(400)]
    near = []
    for i in range(60):
        w = list(base)
        w[rnd.randrange(400)] = f"new{i}"
        near.append((1000 + i, " ".join(w)))
    rows = [*AWKWARD, (2000, "one two three four"), (2001, "ONE\ttwo  three four"), (2002, "one two three"), *near, *near[:5]]
    docs = documents(spark, rows)
    check_simhash(simhash.near_duplicates(docs, chunk=7).collect(), rows)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    reps = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted({r.doc_id for r in kept.collect()}, key=repr) == sorted(reps, key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_first(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_tree_links_equal_brute_force(seed):
    rnd = np.random.default_rng(seed)
    centre = rnd.integers(0, 2 ** 63, 4).astype(np.uint64)
    flips = [np.uint64(1) << np.uint64(b) for b in range(64)]
    fps = np.unique(np.array([c ^ np.bitwise_xor.reduce([flips[b] for b in rnd.choice(64, rnd.integers(0, 6))] or [np.uint64(0)])
                              for c in rnd.choice(centre, 300)], np.uint64))
    for cut in (0, len(fps) // 3):
        u, v = simhash.link_chunks(fps[cut:], fps[:cut] if cut else None, 4)
        assert (np.bitwise_count(u ^ v) <= 64).all() and len(u) < len(fps)
    u, v = simhash.link_chunks(fps, None, 4)
    at = {int(x): i for i, x in enumerate(fps)}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(u, v):
        parent[find(at[int(a)])] = find(at[int(b)])
    want = brute_components([int(x) for x in fps], 4)
    assert len({(find(i), want[i]) for i in range(len(fps))}) == len({find(i) for i in range(len(fps))}) == len(set(want))


def test_block_plan_keeps_every_link():
    """Fingerprints that differ in up to 4 bits agree on all blocks of some choice, at any size."""
    rnd = random.Random(1)
    for n in (10, 10 ** 6, 10 ** 9, 10 ** 11):
        plan = simhash.block_plan(n, 4)
        for _ in range(200):
            x = rnd.getrandbits(64)
            y = x
            for b in rnd.sample(range(64), 4):
                y ^= 1 << b
            assert any(all((x >> a) & ((1 << w) - 1) == (y >> a) & ((1 << w) - 1) for a, w in choice) for choice in plan)


def test_components_of_chains_and_hubs(spark):
    rnd = random.Random(2)
    chain = list(range(200))
    rnd.shuffle(chain)
    edges = [*zip(chain, chain[1:]), *[(5000, 6000 + i) for i in range(50)], *[(7000 + i, 7900) for i in range(50)], (1, 1)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 200)}, **{6000 + i: 5000 for i in range(50)}, **{7000 + i: 7000 for i in range(1, 50)}, 7900: 7000}


# ---------------------------------------------------------------- WARC

def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "x"), (2, "http://b/", "x"), (3, None, None), (4, "u\r\nv", ""), (None, "n", "x"), (None, "n", "lone"), (5, "c", "é🙂\r\n\r\nWARC/1.1\r\n"),
            (6, "d", "long " * 300_000), (6, "d", "long " * 300_000), (7, "e", "\r\n")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int")
    got = warc.archive(pages, folder=str(tmp_path / "w"), per_file=3).collect()
    best = {}
    for i, _, h in rows:
        best[h or ""] = max([x for x in (i, best.get(h or "")) if x is not None], default=None)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = best[h or ""] != i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", best[h or ""] if again else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    index = spark.read.parquet(str(tmp_path / "w/members/index")).collect()
    assert len(index) == len(rows)
    for r in index:  # every member alone is one whole record, and members are dense
        with open(r.archive, "rb") as f:
            f.seek(r.offset)
            assert gzip.decompress(f.read(r.length)).startswith(b"WARC/1.1\r\n")
    payloads = {(r.record_id, bytes(r.payload)) for r in warc.read_indexed(spark.read.parquet(str(tmp_path / "w/members/index"))).collect()}
    assert ("<urn:page:5>", "é🙂\r\n\r\nWARC/1.1\r\n".encode()) in payloads
    assert warc.archive(pages.limit(0)).count() == 0
    high = warc.archive(pages, least=2).collect()
    assert {r.record_type for r in high if r.payload_bytes < 2} == {"response"}


def test_reader_takes_any_cut_and_rejects_stumps():
    record = b"WARC/1.1\r\nContent-Length: 5\r\nWARC-Type: response\r\n\r\nab\r\nc\r\n\r\n"
    for step in (1, 7, 1000):
        reader, out = warc.Records(), []
        data = record * 4
        for i in range(0, len(data), step):
            out += reader.feed(data[i:i + step])
        reader.finish()
        assert [b for _, b, _ in out] == [b"ab\r\nc"] * 4
    reader = warc.Records()
    list(reader.feed(record[:-3]))
    with pytest.raises(ValueError):
        reader.finish()


# ---------------------------------------------------------------- chats

def brute_chats(messages, schemas):
    """Statuses, levels and errors of the calls, one conversation at a time."""
    out = []
    by_conv = defaultdict(list)
    for m in messages:
        by_conv[m["conv_id"]].append(m)
    for conv, ms in by_conv.items():
        calls = []
        for m in ms:
            try:
                listed = json.loads(m["tool_calls"]) if m["tool_calls"] else []
            except ValueError:
                listed = []
            for idx, c in enumerate(listed if isinstance(listed, list) else []):
                calls.append((m["turn"], idx, c))
        calls.sort(key=lambda c: (c[0] is not None, c[0] or 0, c[1]))
        own, extra = {}, []
        for c in calls:
            key = c[2].get("id")
            if key is None or key in own:
                extra.append(c)
            else:
                own[key] = c
        level, left = {}, dict(own)
        while ready := [k for k, c in left.items() if all(d in level or d not in own for d in c[2].get("after") or [])]:
            n = max(level.values(), default=-1) + 1
            level |= {k: n for k in ready}
            left = {k: c for k, c in left.items() if k not in level}
        answered = {m["tool_call_id"] for m in ms if m["role"] == "tool"}
        for k, (turn, idx, c) in own.items():
            wrong = chat.check_call(c.get("name"), c.get("arguments"), schemas)[0] + sorted(
                f"after {d}: no such call" for d in set(c.get("after") or []) if d not in own)
            out.append((conv, turn, idx, k, level.get(k), "cycle" if k not in level else "linked" if k in answered else "unanswered", wrong))
        for turn, idx, c in extra:
            named = c.get("id") is not None
            out.append((conv, turn, idx, c.get("id"), None if named else 0, "duplicate" if named else "unanswered",
                        chat.check_call(c.get("name"), c.get("arguments"), schemas)[0]))
    return sorted(out, key=repr)


def calls_of(rows):
    return sorted(((r.conv_id, r.turn, r.idx, r.call_id, r.level, r.status, list(r.errors)) for r in rows if r.kind == "call"), key=repr)


CHAT = "conv_id long, turn long, role string, text string, tool_calls string, tool_call_id string, level int"


def test_chats_on_table(spark, sf):
    messages = queries.chat_messages(spark.read.parquet(f"{sf}/conversations.parquet"))
    rows = queries.op10_tool_calls(spark, sf).collect()
    plain = [r.asDict() for r in messages.collect()]
    assert calls_of(rows) == brute_chats(plain, queries.TOOLS)
    assert sum(r.kind == "message" for r in rows) == len(plain)
    for r in rows:
        assert r.json == chat.canonical(json.loads(r.json))


def test_chats_edges(spark):
    call = lambda i, name="lookup", arguments='{"key":"k"}', **more: {"id": i, "name": name, "arguments": arguments, **more}
    c = json.dumps
    rows = [
        (1, 0, "assistant", "t", c([call("a"), call("b", after=["a"]), call("c", after=["b", "a"])]), None),
        (1, 1, "tool", "ra", None, "a"), (1, 2, "tool", "ra2", None, "a"), (1, 3, "tool", "?", None, "zz"), (1, 4, "tool", "?", None, None),
        (1, 5, "assistant", None, c([call("x", after=["y"]), call("y", after=["x"]), call("z", after=["x", "gone"])]), None),
        (1, 6, "assistant", "", c([call("a", "nope"), call(None), call("s", after=["s"]), call("m", after=["missing"])]), None),
        (2, 0, "assistant", "é\"\n🙂", c([call("a", "search", '{"limit":99,"more":1}'), call("j", arguments="{broken")]), None),
        (None, None, None, None, None, None), (None, 1, "assistant", "n", c([call("a")]), None), (None, 2, "tool", "ok", None, "a"),
        (3, 0, "user", "u", "not json", None), (3, 0, "user", "u", "not json", None), (4, 0, "assistant", "", "[]", None),
        (5, 0, "assistant", "", c([call(f"n{i}", after=[f"n{i - 1}"] if i else []) for i in range(12)]), None)]
    messages = spark.createDataFrame([(*r, 1) for r in rows], CHAT)
    got = chat.format_chats(messages, queries.TOOLS).collect()
    plain = [dict(zip(("conv_id", "turn", "role", "text", "tool_calls", "tool_call_id"), r)) for r in rows]
    assert calls_of(got) == brute_chats(plain, queries.TOOLS)
    said = {(r.conv_id, r.turn, r.status) for r in got if r.kind == "message"}
    assert {(1, 1, "linked"), (1, 2, "extra"), (1, 3, "orphan"), (1, 4, "orphan"), (3, 0, "bad_calls"), (None, 2, "linked"), (4, 0, "ok")} <= said
    for r in got:
        assert r.json == chat.canonical(json.loads(r.json))
    assert chat.format_chats(messages.limit(0), queries.TOOLS).count() == 0


def test_chat_arguments_that_utf8_or_json_cannot_hold(spark):
    """Lone surrogates stay escaped; NaN, Infinity and numbers beyond a double are no JSON."""
    texts = {"a": '{"key":"\\ud800"}', "b": '{"key":NaN}', "c": '{"key":-Infinity}', "d": '{"key":1e999}', "e": '{"\\udfff":1,"limit":1,"query":"q"}',
             "f": '{"key":"\\ud83d\\ude42"}', "g": "1e999", "h": '"{\\"key\\":\\"in text\\"}"', "i": None}
    calls = json.dumps([{"id": k, "name": "search" if k == "e" else "lookup", "arguments": v} for k, v in texts.items()])
    messages = spark.createDataFrame([(1, 0, "assistant", "t", calls, None)], CHAT.rsplit(",", 1)[0])
    got = {r.call_id: r for r in chat.format_chats(messages, queries.TOOLS).collect() if r.kind == "call"}
    for k, r in got.items():
        value = json.loads(r.json, parse_constant=pytest.fail)
        assert r.json.isprintable() and value["id"] == k
    no = {k for k, r in got.items() if list(r.errors) == ["$: not JSON"]}
    assert no == {"b", "c", "d", "g"} and all(json.loads(got[k].json)["arguments"] == texts[k] for k in no)
    assert list(got["a"].errors) == [] and '"key":"\\ud800"' in got["a"].json
    assert list(got["e"].errors) == ["$.\\udfff: unknown"] and "🙂" in got["f"].json and list(got["h"].errors) == []


def test_copies_are_spread(spark):
    from riskspark.llm.common import spread_copies
    counts = {"a": 1, "b": 4, "c": 5, "d": 16, "e": 17, "f": 1000}
    got = spread_copies(spark.createDataFrame(list(counts.items()), "k string, n long"), "n", "copy", page=4).collect()
    assert sorted((r.k, r.copy) for r in got) == [(k, i) for k, n in counts.items() for i in range(n)]


def test_rows_are_split_by_keys(spark, monkeypatch):
    """By broadcast and by the filter of bounded size, also when that is far too small."""
    from riskspark.llm import common
    docs = spark.range(3000).withColumn("text", F.concat(F.lit("t"), "id"))
    docs = docs.select("*", *[k.alias(n) for k, n in zip(common.row_keys(F.col("id"), F.col("text")), "ab")])
    listed = docs.filter("id % 3 = 0").select("a", "b")
    for few, most in ((1 << 18, 1 << 27), (10, 1 << 27), (10, 1 << 10)):
        monkeypatch.setattr(common, "FEW_KEYS", few)
        others, members = common.split_by_keys(docs, ["a", "b"], listed, most)
        assert sorted(r.id for r in others.collect()) == [i for i in range(3000) if i % 3]
        assert sorted(r.id for r in members.collect()) == [i for i in range(3000) if not i % 3]


def brute_levels(after):
    """Rounds that place every call whose predecessors are placed."""
    level, left = {}, dict(after)
    while ready := [k for k, deps in left.items() if all(d in level or d not in after for d in deps or [])]:
        n = max(level.values(), default=-1) + 1
        level |= {k: n for k in ready}
        left = {k: d for k, d in left.items() if k not in level}
    return level


def test_call_levels(spark):
    """Chains, trees, joins in layers, cycles with tails and random graphs, one conversation each."""
    rng = random.Random(5)
    graphs = {
        0: {f"c{i}": [f"c{i - 1}"] if i else None for i in range(150)},
        1: {f"t{i}": [f"t{(i - 1) // 2}"] if i else [] for i in range(60)},
        2: {f"l{i}": [f"l{j}" for j in range(max(0, i - i % 4 - 4), i - i % 4)] for i in range(24)},
        3: {f"r{i}": [f"r{(i + 1) % 9}"] for i in range(9)} | {f"s{i}": [f"s{i - 1}" if i else "r0"] for i in range(9)} | {"own": ["own"], "free": ["gone", None]},
        None: {f"f{i}": [f"f{i - 1}", f"f{i - 2}"] for i in range(8)},
        4: {"big": [f"c{i}" for i in range(20)]} | {f"c{i}": [f"c{i - 1}"] if i else ["p", "q"] for i in range(20)} | {"p": ["q"], "q": []}}
    for g in range(5, 12):
        n = rng.randrange(2, 25)
        graphs[g] = {f"n{i}": [f"n{rng.randrange(n if g > 8 and rng.random() < 0.1 else max(i, 1))}" for _ in range(rng.randrange(3))] if i else []
                     for i in range(n)}
    rows = [(conv, k, deps) for conv, after in graphs.items() for k, deps in after.items()]
    got = chat.levels(spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>")).collect()
    want = sorted(((conv, k, n) for conv, after in graphs.items() for k, n in brute_levels(after).items()), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_sample_is_bounded_where_ids_repeat(spark):
    from riskspark.llm.common import bounded_sample
    rows = [(1, f"text {i}", "x") for i in range(3000)] + [(2, "same", "x")] * 3000 + [(i, f"own {i}", "x") for i in range(3, 50)]
    df = spark.createDataFrame(rows, "id long, text string, lang string").repartition(4)
    ids = df.select("id").distinct()
    got = bounded_sample(df, ids, 500).collect()
    assert len(got) == 500 and len({(r.id, r.text) for r in got}) == 500
    assert len(bounded_sample(df, ids.filter("id = 2"), 500).collect()) == 1
    assert len(bounded_sample(df, ids.filter("id > 2"), 500).collect()) == 47


def test_warc_of_text_ids(spark):
    """Ids that hold line breaks, signs or the word null, beside a null id, come back as they are."""
    ids = ["null", None, "a\r\nb", "x>y", "", "é %41", "plain"]
    pages = spark.createDataFrame([(i, "u", "same" if n % 2 else f"p{n}") for n, i in enumerate(ids)], "page_id string, url string, html string")
    got = {r.page_id: r for r in warc.archive(pages).collect()}
    assert set(got) == set(ids)
    same = [i for n, i in enumerate(ids) if n % 2]
    best = max(i for i in same if i is not None)
    assert {i: got[i].refers_to for i in same} == {i: None if i == best else best for i in same}
