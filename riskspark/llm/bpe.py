"""Byte-level BPE encoding and decoding (operator 1).

Encoding.  A token sequence is the BPE encoding of its bytes exactly when each
token encodes to itself and each neighbouring pair (s, t) encodes to (s, t):
the first merge across a boundary would have to happen between two neighbours.
So the merges compile into a nondeterministic transducer whose state is (last
token, position in the vocabulary trie).  ``Transducer`` determinises it
lazily: a state is the set of live paths and nothing else, so states are shared
by all texts.  What a path has still to emit is not copied from step to step: a
prefix has one encoding, a state names the token that ends it, and the tokens
before are read off the states passed.  The tokens that all live paths share
leave after a bounded lookahead.  States, transitions and checked pairs are kept
up to a fixed number and then built anew, so memory is bounded for any text.

Decoding looks tokens up and feeds the bytes, chunk by chunk, to an
incremental UTF-8 state machine that holds back at most three bytes.

Texts: null counts as empty; an empty text has no tokens.  Rows are handled one
by one: repeated rows and repeated ids give one output row each, null ids stay
null, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bulk import BulkTransducer
from .common import col, give_back, slices

ROOT = 0
NONE = -1
END, PATHS = 256, 257
NODE = (1 << 24) - 1


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> rank of the content of a tiktoken rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a tiktoken rank file."""
    return parse_ranks(read_file(path))


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Transducer:
    """Lazily determinised BPE transducer over bytes."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 120_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {v: k for k, v in ranks.items()}
        leaf: dict[int, int] = {}
        self.kids: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [NONE]
        self.depth: list[int] = [0]
        self.size = {v: len(k) for k, v in ranks.items()}
        for tok, rank in ranks.items():
            node = ROOT
            for b in tok:
                row, node_before = self.kids[node], node
                if row is leaf:
                    row = self.kids[node] = {}
                node = row.get(b, ROOT)
                if node == ROOT:
                    node = row[b] = len(self.token_at)
                    self.token_at.append(NONE)
                    self.depth.append(self.depth[node_before] + 1)
                    self.kids.append(leaf)
            self.token_at[node] = rank
        self.valid: dict[int, bool] = {}
        self.spines: dict[int, tuple | None] = {}
        self._reset()

    def _reset(self) -> None:
        """Forget all states but the start.  A state is a row: byte -> next row, ``END`` -> the token that ends
        here (NONE: no token can), ``PATHS`` -> its paths.  Rows point at each other, so they are emptied."""
        for row in getattr(self, "known", {}).values():
            row.clear()
        self.known: dict[tuple, dict] = {}
        self.start = self._state((ROOT,), NONE)

    def _state(self, paths: tuple, end: int) -> dict:
        row = self.known.get(paths)
        if row is None:
            row = self.known[paths] = {END: end, PATHS: paths}
        return row

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The defining procedure: merge the lowest-ranked neighbours, leftmost first."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return tuple(self.ranks[p] for p in parts)

    def _spines(self, tok: int) -> tuple | None:
        """How ``tok`` forms by itself: the pieces that are its right end and its left
        end in turn, each with the rank of the merge that consumes it.  None if the
        token does not encode to itself; third entry: do the merges come in rank order?"""
        known = self.spines.get(tok)
        if known is None and tok not in self.spines:
            data = self.bytes_of[tok]
            parts = [data[i:i + 1] for i in range(len(data))]
            right, left, order = [], [], []
            while len(parts) > 1:
                pairs = [r for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
                if not pairs:
                    break
                best = min(pairs)
                at = next(i for i in range(len(parts) - 1) if self.ranks.get(parts[i] + parts[i + 1]) == best)
                if at == len(parts) - 2:
                    right.append((parts[-1], best))
                if at == 0:
                    left.append((parts[0], best))
                order.append(best)
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 1:
                end = (data, float("inf"))
                known = ([*right, end], [*left, end], all(a <= b for a, b in zip(order, order[1:])))
            self.spines[tok] = known
        return known

    def _follows(self, last: int, tok: int) -> bool:
        """May ``tok`` come right after ``last`` (NONE: at the start)?

        Walks both spines at the boundary in rank order.  That order is the order of
        the merges as long as no merge ranks below its parts; where one does, the pair
        is merged by the defining procedure instead."""
        key = (last + 1) << 24 | tok
        ok = self.valid.get(key)
        if ok is None:
            if len(self.valid) >= 4 * self.max_states:
                self.valid.clear()
            ok = self.valid[key] = self.may_follow(last, tok)
        return ok

    def may_follow(self, last: int, tok: int) -> bool:
        return self._spines(tok) is not None and (last == NONE or self._meets(last, tok))

    def _meets(self, last: int, tok: int) -> bool:
        a, b, ranks = self._spines(last), self._spines(tok), self.ranks
        if a[2] and b[2]:
            i = j = 0
            right, left = a[0], b[1]
            while True:
                (x, until_x), (y, until_y) = right[i], left[j]
                r = ranks.get(x + y)
                if r is not None:
                    if (len(x) > 1 and r < ranks[x]) or (len(y) > 1 and r < ranks[y]):
                        break
                    if r < until_x and r <= until_y:
                        return False
                if until_x <= until_y:
                    if i == len(right) - 1:
                        return True
                    i += 1
                else:
                    j += 1
        return self.merge(self.bytes_of[last] + self.bytes_of[tok]) == (last, tok)

    def _step(self, row: dict, byte: int) -> dict:
        """The state after one more byte.  A path is (token it comes after) + 1 << 24 | trie node.  A prefix has
        one encoding, so at most one path ends a token here, and its token says how the prefix ends."""
        paths, end, kids, token_at, valid = [], NONE, self.kids, self.token_at, self.valid
        for path in row[PATHS]:
            nxt = kids[path & NODE].get(byte)
            if nxt is None:
                continue
            after = path >> 24 << 24
            if kids[nxt]:
                paths.append(after | nxt)
            if end == NONE:
                tok = token_at[nxt]
                if tok >= 0:
                    ok = valid.get(after | tok)
                    if self._follows((path >> 24) - 1, tok) if ok is None else ok:
                        end = tok
        if end != NONE:
            paths.append(end + 1 << 24)
        step = row[byte] = self._state(tuple(paths), end)
        return step

    def _trace(self, ends: list[int], at: int) -> list[int]:
        """Tokens of the prefix of ``at`` bytes: the last one is known at its end, the others before it in turn."""
        out, size = [], self.size
        while at:
            tok = ends[at - 1]
            out.append(tok)
            at -= size[tok]
        out.reverse()
        return out

    def _agreed(self, ends: list[int], row: dict, at: int) -> int:
        """The last place through which every live path of the state goes."""
        live = sorted({at - self.depth[path & NODE] for path in row[PATHS]})
        while len(live) > 1:
            top = live.pop()
            before = top - self.size[ends[top - 1]]
            if before not in live:
                live.append(before)
                live.sort()
        return live[0]

    def encode(self, data: bytes, lookahead: int = 4096) -> tuple[int, ...]:
        """Token ids of one piece; a piece that is a token itself is that token.

        After each ``lookahead`` bytes the tokens that all live paths share leave, so what is held of a
        long piece is bounded."""
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        if len(self.known) > self.max_states:
            self._reset()
        row, ends, out = self.start, [], []
        for b in data:
            step = row.get(b)
            row = self._step(row, b) if step is None else step
            ends.append(row[END])
            if len(ends) >= lookahead:
                at = self._agreed(ends, row, len(ends))
                out += self._trace(ends, at)
                del ends[:at]
                if len(self.known) > 2 * self.max_states:  # one very long piece: keep only where we are
                    paths, end = row[PATHS], row[END]
                    self._reset()
                    row = self._state(paths, end)
        return tuple(out + self._trace(ends, len(ends)))


class Utf8Machine:
    """Incremental UTF-8 decoder: holds back the bytes of an unfinished character."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Length of the character at the end of ``data`` that could still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
            if need <= back:
                return 0
            if back > 1:  # the second byte of some characters has a narrower range
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                if not low <= data[-back + 1] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = self._unfinished(data)
        self.held = data[len(data) - keep:]
        return data[:len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


#: Characters outside these make a text take the general pattern: in Latin letters, digits, signs and plain
#: white space the quick pattern splits the same way.
_QUICK = re.compile(r"[^\t-\r -\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")
_LATIN = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Function that lists the matches of ``pattern``.  ``\\p{L}`` and ``\\p{N}`` need the general engine;
    a text of Latin characters only is split by the same pattern with these classes spelled out."""
    general = regex.compile(pattern).findall
    if r"\p{L}" not in pattern or regex.search(r"\\p\{[^LN]", pattern):
        return general
    quick = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s0-9{_LATIN}]").replace(r"\p{L}", f"[{_LATIN}]").replace(r"\p{N}", "[0-9]")
    if "[[" in quick or "\\p" in quick:
        return general
    fast, odd = re.compile(quick).findall, _QUICK.search
    return lambda text: general(text) if odd(text) else fast(text)


class Codec:
    """Encoder and streaming decoder of one rank file and split pattern.

    The memo holds up to ``most`` pieces besides those of the texts at hand; pieces of up to ``short`` bytes
    are encoded in lockstep."""

    most, short = 80_000, 64

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.bulk = BulkTransducer(self.machine)
        self.split = splitter(pattern)
        self.memo: dict[str, list[int] | tuple[int, ...]] = {}
        size = max(self.machine.bytes_of, default=-1) + 1
        self.vocab = [self.machine.bytes_of.get(i, b"") for i in range(size)]
        self.names = [str(i) for i in range(size)]

    def forget(self) -> None:
        """Drop all that was learned from texts."""
        self.memo.clear()
        self.bulk.forget()
        self.machine.valid.clear()
        self.machine._reset()

    def _learn(self, pieces: set[str]) -> None:
        """Token ids of new pieces into the memo: whole tokens by rank, long pieces one by one, the others in lockstep."""
        if len(self.memo) + len(pieces) > self.most:
            self.memo.clear()
        ranks, names, texts = self.machine.ranks, [], []
        for piece in pieces:
            data = piece.encode()
            whole = ranks.get(data)
            if whole is not None:
                self.memo[piece] = (whole,)
            elif len(data) <= self.short:
                names.append(piece)
                texts.append(data)
            else:
                self.memo[piece] = self.machine.encode(data)
        self.memo.update(zip(names, self.bulk.encode(texts)))

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Token ids of each text."""
        split = [self.split(t) for t in texts]
        every = set().union(*split)
        if not every <= self.memo.keys():
            self._learn(every - self.memo.keys())
            if not every <= self.memo.keys():  # the memo was emptied
                self._learn(every - self.memo.keys())
        look = self.memo.__getitem__
        for pieces in split:
            yield list(chain.from_iterable(map(look, pieces)))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int], chunk: int = 4096) -> Iterator[tuple[bytes, str]]:
        """Bytes and finished characters, a bounded number of ids at a time."""
        machine = Utf8Machine()
        for at in range(0, len(ids), chunk):
            data = b"".join(map(self.vocab.__getitem__, ids[at:at + chunk]))
            yield data, machine.feed(data)
        yield b"", machine.finish()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str, data: bytes | None = None) -> Codec:
    """One codec per worker process and tokenizer; ``data`` is the rank file's content where the path may be unknown."""
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(parse_ranks(read_file(path) if data is None else data), pattern)
    return _CODECS[key]


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _rows(c: Codec, part: pa.RecordBatch, with_ids: bool) -> pa.RecordBatch:
    cols: list[list] = [[], [], [], [], []]
    texts = [text or "" for text in part.column(1).to_pylist()]
    for text, ids in zip(texts, c.encode_all(texts)):
        plain, chars = hashlib.sha256(), []
        for data, done in c.decode(ids):
            plain.update(data)
            chars.append(done)
        cols[0].append(len(ids))
        cols[1].append(hashlib.sha256(",".join(map(c.names.__getitem__, ids)).encode()).hexdigest())
        cols[2].append(plain.hexdigest())
        cols[3].append("".join(chars) == text)
        if with_ids:
            cols[4].append(pa.array(ids, pa.int32()))
    out = [part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()),
           pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())]
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
    if with_ids:
        offsets = pa.array([0, *accumulate(cols[0])], pa.int32())
        out.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(cols[4])))
        names.append("token_ids")
    return pa.RecordBatch.from_arrays(out, names=names)


def _report(path: str, pattern: str, with_ids: bool, ranks: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern, ranks.value)
        gc.disable()  # scanning the transducer's many tuples costs more than the work; it frees them itself
        try:
            for part in slices(batches, 1, 1 << 20):
                yield _rows(c, part, with_ids)
        finally:
            gc.enable()
            c.forget()  # the worker process may live on with other work
            give_back()
    return run


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                  pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode every text, decode the ids again, and report both per row.

    Returns id, n_tokens, ids_sha256, decoded_sha256, round_trip (decoded text
    equals the text; true for empty), and token_ids if asked for.  One narrow
    pass without a shuffle.
    """
    if path is None or pattern is None:
        own_path, own_pattern = default_tokenizer()
        path, pattern = path or own_path, pattern or own_pattern
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    fields = [T.StructField("id", rows.schema["id"].dataType), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
              T.StructField("round_trip", T.BooleanType())]
    if with_ids:
        fields.append(T.StructField("token_ids", T.ArrayType(T.IntegerType())))
    ranks = docs.sparkSession.sparkContext.broadcast(read_file(path))  # executors need not have the file; a vocabulary has a fixed size
    out = rows.mapInArrow(_report(path, pattern, with_ids, ranks), T.StructType(fields))
    return out.select(F.col("id").alias(id_col), *out.columns[1:])


def decode(rows: DataFrame, id_col: str, ids_col: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id, text of token id arrays; a null array is an empty text, broken UTF-8 becomes U+FFFD."""
    own_path, own_pattern = default_tokenizer()
    path, pattern = path or own_path, pattern or own_pattern
    ranks = rows.sparkSession.sparkContext.broadcast(read_file(path))

    def run(batches):
        c = codec(path, pattern, ranks.value)
        for b in batches:
            texts = ["".join(s for _, s in c.decode(ids or [])) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    picked = rows.select(col(id_col).alias("id"), col(ids_col).alias("ids"))
    schema = T.StructType([T.StructField("id", picked.schema["id"].dataType), T.StructField("text", T.StringType())])
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
