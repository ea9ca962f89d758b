"""Operator 7: byte-level BPE encoding and decoding.

Pre-tokenisation follows the public pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` without a
regex. Each code point gets a symbol (letter, number, other, and white space and
apostrophes by what follows them), and an eight-state automaton over the symbols says
where matches start. A symbol is a function from state to state, and composing functions
is associative, so the states of all code points of a slice of texts come from a blocked
scan: blocks are composed side by side, the block functions are scanned by doubling, and
a second pass fills in the states. Slices between starts are merged by rank (lowest rank
first, leftmost on ties, a slice that is itself in the vocabulary is one token) with a
cache from slice to ids. The offset of each slice's first token is retained, so ids decode
slice by slice or as a whole.

Defined results: a null text encodes as an empty one (no ids); special token strings are
ordinary text; an empty table gives an empty result; repeated rows each get a row; null
ids decode to empty bytes.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmill.llm import arrays as A

CACHE_SLICES = 200_000
SLICE = 1 << 19
L, N, O, SPACE, BREAK, BLANK, SHORT, LONG = range(8)
#: States: what the code points so far have left open.
NONE, IN_L, IN_N, IN_O, AFTER_SPACE, IN_BLANK, ONE_MORE, TWO_MORE = range(8)
RESET = 8  # added to a symbol at the first code point of a text
_BLOCK = 256


@lru_cache(maxsize=1)
def code_classes() -> np.ndarray:
    r"""L, N, O or BLANK of every code point (\p{L}, \p{N}, rest, \s of the pattern's Unicode rules)."""
    table = np.full(sys.maxunicode + 1, O, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = L
        elif kind == "N":
            table[c] = N
    for lo, hi in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
                   (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        table[lo:hi + 1] = BLANK
    return table


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """step[symbol, state] -> next state; begins[symbol, state]: does a match start here?"""
    step, begins = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for state in range(8):
        step[L, state], step[N, state], step[O, state] = IN_L, IN_N, IN_O
        step[SPACE, state], step[BREAK, state], step[BLANK, state] = AFTER_SPACE, NONE, IN_BLANK
        step[SHORT, state], step[LONG, state] = ONE_MORE, TWO_MORE
    for symbol, own in ((L, IN_L), (N, IN_N), (O, IN_O)):
        begins[symbol, own] = begins[symbol, AFTER_SPACE] = False
    step[L, ONE_MORE], step[L, TWO_MORE] = NONE, ONE_MORE
    begins[L, ONE_MORE] = begins[L, TWO_MORE] = False
    for symbol in (SHORT, LONG):  # an apostrophe inside or after a space is part of a run of others
        for state in (IN_O, AFTER_SPACE):
            step[symbol, state], begins[symbol, state] = IN_O, False
    begins[BLANK, IN_BLANK] = False
    for symbol in range(8):  # at the start of a text the state before does not matter
        step[symbol + RESET, :] = step[symbol, NONE]
    return step, begins


_STEP, _BEGINS = _automaton()
_CONSTANT = (_STEP == _STEP[:, :1]).all(axis=1)


def symbols(code: np.ndarray, last: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of each code point; ``first``/``last`` flag the ends of texts."""
    kind = code_classes()[code]
    out = kind.copy()
    n = len(code)
    following = np.full(n, BLANK, np.uint8)  # the end of a text counts as white space
    following[:-1] = kind[1:]
    following[last] = BLANK
    ends = (kind == BLANK) & (following != BLANK)
    out[ends & (code == 0x20)] = SPACE
    out[ends & (code != 0x20)] = BREAK
    quote = np.flatnonzero((code == 0x27) & ~last)
    if len(quote):
        one = code[quote + 1]
        inner = ~last[quote + 1]
        two = code[np.minimum(quote + 2, n - 1)]
        out[quote[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = inner & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        out[quote[pair]] = LONG
    out[first] += RESET
    return out


def states_before(symbol: np.ndarray) -> np.ndarray:
    """The state in front of every code point, by an associative scan of transition functions.

    Blocks are composed side by side. A block with a constant function in it (a space, a
    line end, the start of a text) composes to a constant, found by following one state;
    the rest are composed over all eight. Block functions are then scanned by doubling.
    """
    n = len(symbol)
    blocks = -(-n // _BLOCK)
    grid = np.full(blocks * _BLOCK, RESET, np.uint8)
    grid[:n] = symbol
    grid = grid.reshape(blocks, _BLOCK)
    constant = _CONSTANT[grid].any(axis=1)
    steps = np.ascontiguousarray(grid.T).astype(np.uint16) << 3  # one row a position, one column a block
    flat = _STEP.ravel()
    end = np.zeros(blocks, np.uint8)
    for k in range(_BLOCK):
        end = flat[steps[k] + end]
    whole = np.repeat(end[:, None], 8, axis=1)
    open_ = np.flatnonzero(~constant)
    if len(open_):
        function = np.tile(np.arange(8, dtype=np.uint8), (len(open_), 1))
        for k in range(_BLOCK):
            function = flat[steps[k, open_][:, None] + function]
        whole[open_] = function
        shift = 1
        while shift < blocks:  # inclusive scan: whole[i] = whole[i] after whole[i - shift]
            later = np.take_along_axis(whole[shift:], whole[:-shift], axis=1)
            whole = np.concatenate([whole[:shift], later])
            shift *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = whole[:-1, NONE]
    out = np.empty((_BLOCK, blocks), np.uint8)
    for k in range(_BLOCK):
        out[k] = state
        state = flat[steps[k] + state]
    return out.T.reshape(-1)[:n]


def starts(texts: A.Texts) -> np.ndarray:
    """Byte positions where matches of the pattern start, over all texts of the slice."""
    if not len(texts.data):
        return np.zeros(0, np.int64)
    where = np.flatnonzero((texts.data & 0xC0) != 0x80)  # first byte of each code point
    code = np.frombuffer(texts.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.zeros(len(code) + 1, bool)
    first[np.searchsorted(where, texts.at[:-1])] = True
    symbol = symbols(code, np.append(first[1:-1], True), first[:-1])
    return where[_BEGINS[symbol & 7, states_before(symbol)] | (symbol >= RESET)]


_NO_RANK = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> rank of the joined bytes, as an open-addressing hash table in arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left = ranks.get(token[:cut])
                right = ranks.get(token[cut:]) if left is not None else None
                if right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        keys, values = np.array(keys, np.uint64), np.array(values, np.int32)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.values = np.full(1 << self.bits, _NO_RANK, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # all still homeless keys try their slot; one a free slot gets in
            at = slot[left]
            free = self.keys[at] == 2**64 - 1
            _, winner = np.unique(at[free], return_index=True)
            won = left[free][winner]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (A.mix(keys) >> A.U64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << A.U64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        out = self.values[slot]
        other = np.flatnonzero(self.keys[slot] != keys)
        out[other] = _NO_RANK
        other = other[self.keys[slot[other]] != 2**64 - 1]  # a taken slot: look on
        while len(other):
            slot[other] = (slot[other] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[other]]
            same = found == keys[other]
            out[other[same]] = self.values[slot[other[same]]]
            other = other[~same & (found != 2**64 - 1)]
        return out


def read_ranks(rank_lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_lines.splitlines() if x)}


class TokenBytes:
    """The bytes of each token id: all that decoding needs."""

    def __init__(self, rank_lines: bytes):
        ranks = read_ranks(rank_lines)
        parts = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            parts[rank] = token
        self.bytes_at = A.sums(np.array([len(p) for p in parts]))
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, and the bytes of each id."""
        first, size = self.bytes_at[ids], self.bytes_at[ids + 1] - self.bytes_at[ids]
        return self.bytes[A.expand(first, size)], size


class Vocabulary:
    """Ranks of a public rank file, with a cache from slice to ids."""

    def __init__(self, rank_lines: bytes):
        self.ranks = read_ranks(rank_lines)
        self.pairs = PairTable(self.ranks)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.number = list(range(max(self.ranks.values()) + 1))  # one int object an id, shared by all cached slices
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each slice. All slices merge together, one merge a slice and round: the pair of
        lowest rank, the leftmost of equals. A slice that is itself a token is that token."""
        number = self.number.__getitem__
        out = [(number(self.ranks[p]),) if p in self.ranks else None for p in pieces]
        todo = [i for i, ids in enumerate(out) if ids is None]
        if not todo:
            return out
        size = np.array([len(pieces[i]) for i in todo])
        ids = self.single[np.frombuffer(b"".join([pieces[i] for i in todo]), np.uint8)]
        owner = np.array(todo)
        rank = np.full(len(ids), _NO_RANK, np.int32)
        rank[:-1] = self.pairs.ranks(ids[:-1], ids[1:])
        rank[np.cumsum(size) - 1] = _NO_RANK  # no pair across slices
        while len(size):
            first = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, first)
            over = least == _NO_RANK
            if over.any():
                for k in np.flatnonzero(over).tolist():
                    out[owner[k]] = tuple(map(number, ids[first[k]:first[k] + size[k]].tolist()))
                stay = np.repeat(~over, size)
                ids, rank, owner, least, size = ids[stay], rank[stay], owner[~over], least[~over], size[~over]
                if not len(size):
                    break
                first = np.cumsum(size) - size
            slice_of = np.repeat(np.arange(len(size)), size)
            low = np.flatnonzero(rank == least[slice_of])
            at = low[np.concatenate([[True], slice_of[low[1:]] != slice_of[low[:-1]]])]  # leftmost of each slice
            ids[at] = least
            rank[at] = rank[at + 1]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, rank = ids[stay], rank[stay]
            at = at - np.arange(len(at))  # places after the deletions
            size = size - 1
            first = np.cumsum(size) - size
            right = at[at + 1 < first + size]
            rank[right] = self.pairs.ranks(ids[right], ids[right + 1])
            left = at[at > first]
            rank[left - 1] = self.pairs.ranks(ids[left - 1], ids[left])
        return out

    def encode(self, texts: A.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, ids a text, and per slice its number of ids and its text's row."""
        begin = starts(texts)
        stop = np.append(begin[1:], len(texts.data))
        data, cache = texts.data.tobytes(), self.cache
        pieces = [data[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
        missing = list({p for p in pieces if p not in cache})
        if len(cache) + len(missing) > CACHE_SLICES:  # bounded: start anew, frequent slices come back at once
            cache.clear()
            missing = list(set(pieces))
        cache.update(zip(missing, self.merge(missing), strict=True))
        found = [cache[p] for p in pieces]
        each = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(each.sum()))
        for p in missing:
            if len(p) > 64:  # rare and large ones do not stay
                del cache[p]
        row = np.searchsorted(texts.at, begin, "right") - 1
        return ids, np.bincount(row, weights=each, minlength=texts.n).astype(np.int64), each, row


_OPEN: dict[type, tuple[str, Vocabulary | TokenBytes]] = {}


def _open(kind: type, shared) -> Vocabulary | TokenBytes:
    """One table of a kind for each worker process; a vocabulary keeps its cache across tasks."""
    if kind not in _OPEN or _OPEN[kind][0] != shared.id:
        _OPEN[kind] = shared.id, kind(shared.value)
    return _OPEN[kind][1]


class _Shared:
    """The rank file (under 1 MB) as a broadcast, so executors need no local copy of it."""

    def __init__(self, spark, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.broadcast = spark.sparkContext.broadcast(data)
        self.id = hashlib.sha256(data).hexdigest()

    @property
    def value(self) -> bytes:
        return self.broadcast.value


def encode(df: DataFrame, rank_file: str, keep: Sequence[str] = ("doc_id",), text: str = "text", offsets: bool = True) -> DataFrame:
    """``keep`` columns, ``ids`` and, if asked for, ``offsets`` (index in ``ids`` of each slice's first id)."""
    shared = _Shared(df.sparkSession, rank_file)
    out = [("ids", T.ArrayType(T.IntegerType(), False))] + ([("offsets", T.ArrayType(T.IntegerType(), False))] if offsets else [])

    def make():
        vocabulary = _open(Vocabulary, shared)

        def part(texts: A.Texts, rows) -> dict:
            ids, n, each, row = vocabulary.encode(texts)
            got = {"ids": A.ragged(ids, n, pa.int32())}
            if offsets:
                base = A.sums(n)[:-1]
                got["offsets"] = A.ragged(A.sums(each)[:-1] - base[row], np.bincount(row, minlength=texts.n), pa.int32())
            return got
        return part

    return A.scan(df, keep, text, out, make)


def decode(df: DataFrame, rank_file: str, keep: Sequence[str] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` columns and ``decoded`` (bytes) from a column of ids."""
    shared = _Shared(df.sparkSession, rank_file)
    keep = list(keep)
    src = df.select(*keep, F.col(ids).alias("__ids"))
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType())])

    def run(batches):
        vocabulary = _open(TokenBytes, shared)
        for batch in batches:
            column = batch.column(len(keep))
            size = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
            total, lo = A.sums(size), 0
            while lo < len(size):
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + SLICE, "right")) - 1)
                own = np.asarray(column.slice(lo, hi - lo).flatten(), np.int64)
                data, each = vocabulary.decode(own)
                ends = A.sums(each)[A.sums(size[lo:hi])]
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(data)])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], raw.cast(pa.binary())], names=[*keep, "decoded"])
                lo = hi

    return A.small_batches(src).mapInArrow(lambda batches: A.released(run(batches)), schema)


def digest(df: DataFrame, rank_file: str, keep: Sequence[str] = ("doc_id",), text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode, then decode the ids, in one task: ``keep`` columns, the number of ids, the hashes of
    the ids (decimal, joined by commas) and of the decoded bytes, and the ids if asked for."""
    shared = _Shared(df.sparkSession, rank_file)
    out = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    out += [("ids", T.ArrayType(T.IntegerType(), False))] if with_ids else []

    def make():
        vocabulary, table = _open(Vocabulary, shared), _open(TokenBytes, shared)
        decimal = [b"%d" % i for i in vocabulary.number]

        def part(texts: A.Texts, rows) -> dict:
            ids, n, _, _ = vocabulary.encode(texts)
            data, size = table.decode(ids)
            at = A.sums(n)
            ends = A.sums(size)[at]
            names = list(map(decimal.__getitem__, ids.tolist()))
            data = data.tobytes()
            cuts = list(zip(at.tolist(), at.tolist()[1:], ends.tolist(), ends.tolist()[1:], strict=False))
            got = {"ids": A.ragged(ids, n, pa.int32())} if with_ids else {}
            return got | {"n_tokens": n, "ids_sha256": pa.array([hashlib.sha256(b",".join(names[a:b])).hexdigest() for a, b, _, _ in cuts], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(data[c:d]).hexdigest() for _, _, c, d in cuts], pa.string())}
        return part

    return A.scan(df, keep, text, out, make)
