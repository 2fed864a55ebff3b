"""Byte-level BPE, encoding and decoding, without a regular expression.

Texts become codepoint-class arrays. A small automaton says where a pre-token starts; the
automaton's steps are functions on its states, and functions compose associatively, so all
positions are solved by a blocked prefix scan over function numbers (``scan``). The resulting byte
slices are hashed; each distinct slice is merged once and cached; ids and the byte offsets of every
id are gathered from the cache. Decoding gathers the vocabulary's bytes by those offsets.

Defined cases: a null text is empty; an empty text has no ids; a text of any length is one run of
the scan; repeated rows give repeated results; an empty table gives an empty one. Only ``id_col``
and ``text_col`` are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from nodeloom.llm.common import ragged, slice_hashes, texts_in

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Texts are scanned in groups of about so many bytes; a longer text is a group of its own.
GROUP_BYTES = 500_000
#: The cache of merged slices is emptied beyond so many.
CACHE_SLICES = 200_000
#: Slices up to this length are merged side by side, longer ones each with a heap.
SIDE_BY_SIDE = 48
#: Stands for the rank of two neighbours that don't merge.
NONE = 1 << 40

# Classes of codepoints (fixed by the public splitting pattern).
LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)
#: Codepoints with the property White_Space.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# States: what stands before a position. RUN + class: inside such a run; JOIN: after the one space
# that the next run takes along; LEFT1, LEFT2: so many letters of a contraction are still to come;
# AFTER: right after a contraction.
START, IN_L, IN_N, IN_O, JOIN, IN_WS, LEFT1, LEFT2, AFTER = range(9)
# Symbols: a character with what must be known of the ones that follow it.
(S_L, S_N, S_O, S_QUOTE1, S_QUOTE2, S_SPACE_LAST, S_SPACE, S_BLANK_LAST, S_BLANK, S_RESET) = range(10)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token starts at the character."""
    if symbol == S_RESET:
        return START, True
    if symbol == S_L:
        if state in (LEFT1, LEFT2):
            return (AFTER if state == LEFT1 else LEFT1), False
        return IN_L, state not in (IN_L, JOIN)
    if symbol == S_N:
        return IN_N, state not in (IN_N, JOIN)
    if symbol in (S_O, S_QUOTE1, S_QUOTE2):
        starts = state not in (IN_O, JOIN)
        if starts and symbol != S_O:
            return (LEFT1 if symbol == S_QUOTE1 else LEFT2), True
        return IN_O, starts
    if symbol in (S_SPACE_LAST, S_BLANK_LAST):  # the last of a white run that something follows
        return (JOIN if symbol == S_SPACE_LAST else IN_WS), True
    return IN_WS, state not in (IN_WS, JOIN)


@lru_cache(1)
def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The functions that sequences of symbols can make: numbers of the symbols' own functions, the
    table of compositions [first, symbol], the table of all compositions, and each function's images."""
    own = [tuple(_step(s, x)[0] for s in range(9)) for x in range(10)]
    found, todo = {f: i for i, f in enumerate(dict.fromkeys(own))}, list(dict.fromkeys(own))
    for f in todo:
        for g in own:
            h = tuple(g[x] for x in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    functions = list(found)
    compose = np.array([[found[tuple(g[x] for x in f)] for g in functions] for f in functions], np.uint8)
    assert len(functions) < 256
    return np.array([found[f] for f in own], np.uint8), compose, np.array(functions, np.uint8), np.array([[_step(s, x)[1] for x in range(10)] for s in range(9)], bool)


def scan(functions: np.ndarray, compose: np.ndarray, block: int = 64) -> np.ndarray:
    """Inclusive prefix compositions: within blocks side by side, over the blocks' totals by the same scan, then put together."""
    n = len(functions)
    if n <= block:
        out = functions.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], out[i]]
        return out
    rows = -(-n // block)
    grid = np.zeros(rows * block, np.uint8)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    flat, width = compose.ravel(), compose.shape[1]
    for i in range(1, block):
        grid[i] = flat[grid[i - 1].astype(np.intp) * width + grid[i]]
    totals = scan(grid[-1], compose, block)
    grid[:, 1:] = flat[totals[None, :-1].astype(np.intp) * width + grid[:, 1:]]
    return np.ascontiguousarray(grid.T).reshape(-1)[:n]


@lru_cache(1)
def classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = BLANK
    out[0x20] = SPACE
    return out


def _follow(cp: np.ndarray, letter: str) -> np.ndarray:
    return cp == ord(letter)


def boundaries(cp: np.ndarray, reset: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each codepoint; at reset positions (between texts) nothing is joined."""
    n = len(cp)
    kind = classes()[cp]
    padded = np.full(n + 2, 0, np.uint32)
    padded[:n] = cp
    padded[reset] = 0
    n1, n2 = padded[1 : n + 1], padded[2 : n + 2]
    solid = np.zeros(n + 1, bool)  # something other than white space follows
    solid[:n] = kind <= OTHER
    solid[reset] = False
    symbol = np.array([S_L, S_N, S_O, S_BLANK, S_SPACE], np.uint8)[kind]
    last = solid[1:] & (kind >= BLANK)
    symbol[last & (kind == SPACE)] = S_SPACE_LAST
    symbol[last & (kind == BLANK)] = S_BLANK_LAST
    at = np.flatnonzero(cp == ord("'"))
    a, b = n1[at], n2[at]
    one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    symbol[at[one]] = S_QUOTE1
    symbol[at[two]] = S_QUOTE2
    symbol[reset] = S_RESET
    own, compose, images, starts = _machine()
    reached = images[:, START][scan(own[symbol], compose)]
    before = np.empty(n, np.uint8)
    before[:1] = START
    before[1:] = reached[:-1]
    return starts[before, symbol]


class Encoder:
    """Ranks of a vocabulary, the cache of merged slices, and the arrays for gathering."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        pieces = [b""] * size
        for piece, rank in self.ranks.items():
            pieces[rank] = piece
        self.lengths = np.array([len(x) for x in pieces], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {(a << 32) | b: rank for piece, rank in self.ranks.items() for i in range(1, len(piece)) if (a := self.ranks.get(piece[:i])) is not None and (b := self.ranks.get(piece[i:])) is not None}
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], NONE)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: neighbours of the lowest rank are merged first, the leftmost of equals."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        return self._merge_long(piece)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        i = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[i] == key, self.pair_ranks[i], NONE)

    def merge_many(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of equally many rounds for many slices: (all ids, one slice after another; how many each slice has)."""
        n, width = len(begins), int(lengths.max())
        column = np.arange(width)
        inside = column < lengths[:, None]
        ids = np.where(inside, self.of_byte[data[np.where(inside, begins[:, None] + column, begins[:, None])]], -1)
        scores = np.full((n, width), NONE)
        here = inside[:, 1:]
        scores[:, :-1][here] = self._pairs(ids[:, :-1][here], ids[:, 1:][here])
        done, counts, live = ids.copy(), lengths.copy(), np.arange(n)
        while True:
            at = scores.argmin(1)
            low = scores[np.arange(len(live)), at]
            go = low < NONE
            if not go.all():
                done[live[~go]] = ids[~go]
                ids, scores, at, low, live = ids[go], scores[go], at[go], low[go], live[go]
            if not len(live):
                break
            rows = np.arange(len(live))
            counts[live] -= 1
            ids[rows, at] = low
            take = np.minimum(column + (column > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, take, 1)
            ids[:, -1] = -1
            scores = np.take_along_axis(scores, np.minimum(column + (column > at[:, None]), width - 1), 1)
            scores[:, -1] = NONE
            more = at + 1 < counts[live]
            scores[rows, at] = NONE
            scores[rows[more], at[more]] = self._pairs(ids[rows[more], at[more]], ids[rows[more], at[more] + 1])
            left = at > 0
            scores[rows[left], at[left] - 1] = self._pairs(ids[rows[left], at[left] - 1], ids[rows[left], at[left]])
        return done[np.arange(width) < counts[:, None]], counts

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap and links, for slices where a list would take quadratic time."""
        ranks, n = self.ranks, len(piece)
        ends, nexts, befores = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(i: int) -> None:
            if 0 <= i and (j := nexts[i]) < n and (r := ranks.get(piece[i : ends[j]])) is not None:
                heapq.heappush(heap, (r, i, ends[i], ends[j]))

        for i in range(n):
            push(i)
        while heap:
            _, i, middle, end = heapq.heappop(heap)
            j = nexts[i] if ends[i] == middle else n
            if j >= n or ends[j] != end:
                continue
            ends[i], nexts[i], ends[j] = end, nexts[j], -1
            if nexts[i] < n:
                befores[nexts[i]] = i
            push(i)
            if befores[i] >= 0:
                push(befores[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = nexts[i]
        return out

    def _learn(self, joined: bytes, begins: np.ndarray, stops: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Merges slices that the cache hasn't; returns their numbers in it."""
        lengths, data = stops - begins, np.frombuffer(joined, np.uint8)
        order = np.argsort(lengths, kind="stable")
        ids, counts, n = [], np.ones(len(order), np.int64), 0
        while n < len(order):  # groups of like lengths, so that little is padding
            size = int(lengths[order[n]])
            if size > SIDE_BY_SIDE:
                break
            end = min(n + max(1, 400_000 // size), int(np.searchsorted(lengths[order], size + size // 4, "right")))
            got, counts[n:end] = self.merge_many(data, begins[order[n:end]], lengths[order[n:end]])
            ids.append(got)
            n = end
        for i in range(n, len(order)):
            got = self.merge(joined[begins[order[i]] : stops[order[i]]])
            ids.append(np.array(got, np.int64))
            counts[i] = len(got)
        at = len(self.ids) + np.cumsum(counts) - counts
        numbers = len(self.starts) + np.arange(len(order))
        self.ids = np.concatenate([self.ids, *ids]).astype(np.uint32)
        self.starts, self.counts = np.concatenate([self.starts, at]), np.concatenate([self.counts, counts])
        self.known.update(zip(hashes[order].tolist(), numbers.tolist(), strict=True))
        out = np.empty(len(order), np.int64)
        out[order] = numbers
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers."""
        sizes = np.array([len(x) for x in texts], np.int64)
        joined = b"\n".join(texts) + b"\n"
        cp = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
        width = (1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)).astype(np.int64)
        at = np.cumsum(width) - width
        ends_of_texts = np.cumsum(sizes + 1) - 1
        reset = np.searchsorted(at, ends_of_texts)
        starts = at[boundaries(cp, reset)]
        is_reset = np.zeros(len(joined) + 1, bool)
        is_reset[ends_of_texts] = True
        stops = np.append(starts[1:], len(joined))
        real = ~is_reset[starts]
        starts, stops = starts[real], stops[real]
        hashes = slice_hashes(np.frombuffer(joined, np.uint8), starts, stops)
        distinct, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > CACHE_SLICES:
            self._clear()
        known = self.known
        numbers = np.fromiter((known.get(h, -1) for h in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = self._learn(joined, starts[first[new]], stops[first[new]], distinct[new])
        begin, length = self.starts[numbers], self.counts[numbers]
        n = length[where]
        flat = self.ids[ragged(begin[where], n)]
        total = np.concatenate([[0], np.cumsum(n)])
        cuts = total[np.searchsorted(starts, ends_of_texts)]
        return np.split(flat, cuts[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ragged(self.offsets[ids], self.lengths[ids])].tobytes()

    def offsets_of(self, ids: np.ndarray) -> np.ndarray:
        """The byte offset in the text at which each id's bytes begin."""
        n = self.lengths[ids]
        return np.cumsum(n) - n


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def groups(texts: list[bytes], most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes."""
    begin = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield begin, i
            begin, size = i, 0
        size += len(x) + 1
    if begin < len(texts):
        yield begin, len(texts)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids array<int> of every whole text."""

    def run(batches):
        import pyarrow as pa

        e = encoder(path or default_path())
        for batch in batches:
            texts = texts_in(batch, text_col)
            for a, b in groups(texts):
                out = e.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(a, b - a), pa.array([x.astype(np.int32) for x in out], pa.list_(pa.int32()))], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decoded(ids: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id, data binary: the bytes that the ids stand for, and text, where they are UTF-8 (else null)."""

    def run(batches):
        import pyarrow as pa

        e = encoder(path or default_path())

        def text(data: bytes) -> str | None:
            try:
                return data.decode()
            except UnicodeDecodeError:
                return None

        for batch in batches:
            data = [e.decode(np.array(x or [], np.int64)) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(data, pa.binary()), pa.array([text(x) for x in data], pa.string())], [id_col, "data", "text"])

    return ids.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {ids.schema[id_col].dataType.simpleString()}, data binary, text string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one pass, so that no ids are shuffled or kept."""

    def run(batches):
        import pyarrow as pa

        e = encoder(path or default_path())
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            texts = texts_in(batch, text_col)
            counts, ids_sha, text_sha = [], [], []
            for a, b in groups(texts):
                for ids in e.encode(texts[a:b]):
                    counts.append(len(ids))
                    ids_sha.append(sha(ids.astype("<u4").tobytes()))
                    text_sha.append(sha(e.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
