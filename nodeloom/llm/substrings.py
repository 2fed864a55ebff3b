"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark; repeats become intervals.

Every word of a window goes whose word sequence also starts earlier (a smaller id, or earlier in the
same text). One pass hashes all windows (prefix sums of a polynomial over word hashes). Within a
group of texts, later occurrences are settled at once; only the first of each hash goes on, packed:
for each bucket of hash space one row that holds the hashes' bytes in text order, the ids and the
starts (``_pack``). So a window that a third of all texts share costs one entry per group, not one per
text, and rows stay even. For each bucket the first occurrence over all groups is found; the
others are sent on, packed again by parts of the id space, merge into maximal intervals, one row for
each text that loses words, and are joined to the texts.

Windows are told apart by two independent hashes: 56 bits of the first, 16 of the second, and the bucket,
which is the second's top bits, so that what stands for a window grows with the input: 76 bits with the 16
buckets of small inputs, 84 at 30 GB, 95 at 100 TB. Among n windows about n^2 / 2^(bits + 1) pairs of
different words are taken for equal: 1e-6 expected at 30 GB, 0.01 at 100 TB. Within a group of texts all 128 bits are compared.

Defined cases: a null, empty or short text has no window and keeps its words; texts of any length
are hashed whole; rows of one id and one text are taken as the same document given again: what is
removed is removed from each of them, and none counts as earlier than another; different texts of one
id are documents of their own, in the order of a 63-bit digest of the text (the ``tie``); null ids come
last, in the order of that digest, and each is a document of its own, so of equal texts one stays; an
empty table gives an empty one; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.llm.bpe import groups
from nodeloom.llm.common import mix, slice_hashes, texts_in, window_hashes, words_of

WIDTH = 20
GROUP_BYTES = 4_000_000
#: Bytes of input for each bucket of hash space: the larger, the fewer rows; the entries of one bucket are sorted in memory.
BUCKET_BYTES = 8_000_000
_LAST = np.iinfo(np.int64).max
_ALL = 2**64 - 1
#: Bytes of the second hash beside the bucket, and what makes its words' codes differ from the first's.
SECOND_BYTES = 2
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
#: Ids with several texts are told to all tasks by their hash, of at most so many values.
SLOTS = 1 << 17


#: A larger size is none that Spark's plan knows; texts are measured then.
_UNKNOWN = 1 << 55


def buckets_for(docs: DataFrame, text_col: str = "text") -> int:
    """A power of two that grows with the size that Spark's plan states or, where it doesn't know, with that of the texts."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > _UNKNOWN:
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return 1 << max(4, (max(1, size // BUCKET_BYTES) - 1).bit_length())


def _windows(texts: list[bytes], width: int, mask: int = _ALL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First hash (its bits in ``mask``), second hash, text number and start of every window, in text order."""
    none = np.zeros(0, np.int64)
    if not texts:
        return none.view(np.uint64), none.view(np.uint64), none, none
    joined = b" ".join(texts)
    data = np.frombuffer(joined, np.uint8)
    starts, ends = words_of(data)
    sizes = np.array([len(x) for x in texts], np.int64) + 1
    edges = np.cumsum(sizes) - sizes
    text = np.searchsorted(edges, starts, "right") - 1
    codes = slice_hashes(data, starts, ends)
    hashes = window_hashes(codes, width) & np.uint64(mask)
    if not len(hashes):
        return hashes, hashes, none, none
    second = window_hashes(mix(codes ^ _SECOND), width)
    whole = text[: len(hashes)] == text[width - 1 :]
    first_word = np.searchsorted(text, np.arange(len(texts)))
    at = np.flatnonzero(whole)
    return hashes[at], second[at], text[at], at - first_word[text[at]]


def _sorted(hashes: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order in which equal windows stand together, and which of them equal the one before in this order."""
    order = np.argsort(hashes, kind="stable")
    alike = hashes[order[1:]] == hashes[order[:-1]]
    if (alike & (second[order[1:]] != second[order[:-1]])).any():  # first hashes that collide: the second counts in the order as well
        order = np.lexsort((second, hashes))
        alike = (hashes[order[1:]] == hashes[order[:-1]]) & (second[order[1:]] == second[order[:-1]])
    return order, np.append(np.zeros(min(1, len(order)), bool), alike)


def _later(hashes: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether an equal window stands before, in arrays in text order."""
    order, again = _sorted(hashes, second)
    same = np.zeros(len(hashes), bool)
    same[order] = again
    return same


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key (for a null id the largest long), tie, id, text. tie: 0 where all texts of the id are equal, so that it costs no bytes; else
    a digest of the text, below 0 for ids and above for nulls. Ids whose hash is that of an id with several texts may have a digest as well."""
    digest = F.greatest(F.lit(1).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit(_LAST)))
    own = F.col(id_col).cast("long")
    several = docs.filter(own.isNotNull()).groupBy(own.alias("_key")).agg(F.min(digest).alias("_a"), F.max(digest).alias("_b")).filter("_a < _b")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    several = several.select(slot(F.col("_key")).alias("_slot")).distinct().withColumn("_several", F.lit(True))
    rows = docs.select(own.alias("_own"), digest.alias("_digest"), slot(own).alias("_at"), F.col(id_col).alias(id_col), F.col(text_col).alias(text_col))
    tie = F.when(F.col("_own").isNull(), F.col("_digest")).when(F.col("_several"), -F.col("_digest")).otherwise(F.lit(0))
    rows = rows.join(F.broadcast(several), F.col("_at") == F.col("_slot"), "left")
    return rows.select(F.coalesce("_own", F.lit(_LAST)).alias("_key"), tie.cast("long").alias("_tie"), id_col, text_col)


def _changes(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Where another text begins than that of the entry before."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])
    return new


def _by_part(ids: np.ndarray, ties: np.ndarray, starts: np.ndarray, parts: int) -> list[tuple[int, bytes, bytes]]:
    """(part of the id space, ids and ties with how many starts each has, starts), one for each part."""
    part = (ids ^ ties) % parts
    order = np.lexsort((starts, ties, ids, part))
    part, ids, ties, starts = part[order], ids[order], ties[order], starts[order]
    out, edges = [], np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        heads = np.flatnonzero(_changes(ids[a:b], ties[a:b])) + a
        table = np.stack([ids[heads], ties[heads], np.diff(np.append(heads, b))]).astype("<i8")
        out.append((int(part[a]), zlib.compress(table.tobytes(), 1), starts[a:b].astype("<u4").tobytes()))
    return out


def _pack(hashes: np.ndarray, second: np.ndarray, ids: np.ndarray, ties: np.ndarray, starts: np.ndarray, digest_bytes: int) -> tuple[bytes, bytes, bytes, bytes]:
    """Digests; the ids (as gaps) and ties with how many entries each has; the gaps between starts (one byte, 255: see the wide ones); wide gaps."""
    new = _changes(ids, ties)
    gaps = np.diff(starts, prepend=0)
    gaps[new] = starts[new]
    wide = gaps >= 255
    heads = np.flatnonzero(new)
    table = np.stack([np.diff(ids[heads], prepend=0), ties[heads], np.diff(np.append(heads, len(ids)))]).astype("<i8")
    digests = np.concatenate([hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - digest_bytes :], second.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - SECOND_BYTES :]], 1)
    return digests.tobytes(), zlib.compress(table.tobytes(), 1), np.where(wide, 255, gaps).astype(np.uint8).tobytes(), gaps[wide].astype("<u4").tobytes()


def _unpack(digests: bytes, table: bytes, gaps: bytes, wide: bytes, digest_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(gaps)
    full, both = np.zeros((n, 8), np.uint8), np.frombuffer(digests, np.uint8).reshape(n, digest_bytes + SECOND_BYTES)
    full[:, 8 - digest_bytes :] = both[:, :digest_bytes]
    second = both[:, digest_bytes].astype(np.uint16) << np.uint16(8) | both[:, digest_bytes + 1]
    ids, ties, counts = np.frombuffer(zlib.decompress(table), "<i8").reshape(3, -1)
    ids = np.cumsum(ids)
    steps = np.frombuffer(gaps, np.uint8).astype(np.int64)
    steps[steps == 255] = np.frombuffer(wide, "<u4")
    sums = np.cumsum(steps)
    heads = np.cumsum(counts) - counts
    return full.view(">u8").reshape(n).astype(np.uint64), second, np.repeat(ids, counts), np.repeat(ties, counts), sums - np.repeat(sums[heads] - steps[heads], counts)


_PACKED = "bucket int, grp long, digests binary, ids binary, gaps binary, wide binary"


def repeats(docs: DataFrame, width: int = WIDTH, buckets: int | None = None, digest_bytes: int = 7, mask: int = _ALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (the id; for null the largest long), tie (see ``_keyed``), spans binary (pairs of unsigned 32-bit): the maximal intervals of words in windows that also start earlier; one row for each text that has any."""
    return _repeats(_keyed(docs, id_col, text_col), width, buckets or buckets_for(docs, text_col), digest_bytes, mask, text_col)


def _repeats(keyed: DataFrame, width: int, buckets: int, digest_bytes: int, mask: int, text_col: str) -> DataFrame:
    shift = np.uint64(64 - (buckets - 1).bit_length())

    def hashed(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        grp = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys, ties = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_key", "_tie"))
            order = np.lexsort((ties, keys))
            order = order[_changes(keys[order], ties[order])]
            texts, keys, ties = texts_in(batch, text_col), keys[order], ties[order]
            texts = [texts[i] for i in order.tolist()]
            for a, b in groups(texts, GROUP_BYTES):
                hashes, second, text, starts = _windows(texts[a:b], width, mask)
                own, tie = keys[a:b], ties[a:b]
                later = _later(hashes, second)
                out: list[tuple] = []
                settled = np.flatnonzero(later)
                if len(settled):
                    out = [(k, -1, b"", table, b"", wide) for k, table, wide in _by_part(own[text[settled]], tie[text[settled]], starts[settled], buckets)]
                firsts = np.flatnonzero(~later)
                bucket = (second[firsts] >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(firsts), np.int64)
                by = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1))
                for k, begin, end in zip(bucket[by[edges[:-1]]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    at = firsts[by[begin:end]]
                    out.append((k, grp, *_pack(hashes[at], second[at], own[text[at]], tie[text[at]], starts[at], digest_bytes)))
                grp += 1
                if out:
                    columns = list(zip(*out, strict=True))
                    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "grp", "digests", "ids", "gaps", "wide"])

    def settled(batches):
        import pyarrow as pa

        def put(packed):
            columns = zip(*packed, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "ids", "starts"])

        def close(parts):
            if not parts:
                return
            parts = sorted(parts, key=lambda p: p[0])
            hashes, second, ids, ties, starts = (np.concatenate(x) for x in zip(*[p[1] for p in parts], strict=True))
            order, again = _sorted(hashes, second)
            inside = again.copy()
            inside[:-1] |= again[1:]
            at = order[inside]  # entries of hashes that more than one group has
            if not len(at):
                return
            at = at[np.lexsort((starts[at], ties[at], ids[at], second[at], hashes[at]))]
            first = np.ones(len(at), bool)
            first[1:] = (hashes[at[1:]] != hashes[at[:-1]]) | (second[at[1:]] != second[at[:-1]])
            head = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
            at = at[(ids[at] != ids[head]) | (ties[at] != ties[head]) | (starts[at] != starts[head])]
            if len(at):
                yield put(_by_part(ids[at], ties[at], starts[at], buckets))

        bucket, parts, passed = None, [], []
        for batch in batches:
            for k, grp, *blobs in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if k != bucket:
                    yield from close(parts)
                    bucket, parts = k, []
                if grp == -1:
                    passed.append((k, blobs[1], blobs[3]))
                else:
                    parts.append((grp, _unpack(*blobs, digest_bytes)))
            if passed:
                yield put(passed)
                passed = []
        yield from close(parts)

    def gathered(batches):
        import pyarrow as pa

        def merged(parts):
            if not parts:
                return
            tables = [np.frombuffer(zlib.decompress(x), "<i8").reshape(3, -1) for x, _ in parts]
            ids, ties = (np.concatenate([np.repeat(t[k], t[2]) for t in tables]) for k in (0, 1))
            starts = np.concatenate([np.frombuffer(x, "<u4") for _, x in parts]).astype(np.int64)
            order = np.lexsort((starts, ties, ids))
            ids, ties, starts = ids[order], ties[order], starts[order]
            new = _changes(ids, ties)  # the first window of a maximal interval
            new[1:] |= (starts[1:] > starts[:-1] + width)
            first = np.flatnonzero(new)
            spans = np.stack([starts[first], starts[np.append(first[1:], len(ids)) - 1] + width], 1).astype("<u4")
            owners, ties = ids[first], ties[first]
            cuts = np.flatnonzero(_changes(owners, ties)[1:]) + 1
            blobs = [x.tobytes() for x in np.split(spans, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(owners[np.append(0, cuts)], pa.int64()), pa.array(ties[np.append(0, cuts)], pa.int64()), pa.array(blobs, pa.binary())], ["key", "tie", "spans"])

        now, parts = None, []
        for batch in batches:
            for k, table, starts in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if k != now:
                    yield from merged(parts)
                    now, parts = k, []
                parts.append((table, starts))
        yield from merged(parts)

    packed = keyed.select("_key", "_tie", text_col).mapInArrow(hashed, _PACKED)
    found = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(settled, "part int, ids binary, starts binary")
    return found.repartition("part").sortWithinPartitions("part").mapInArrow(gathered, "key long, tie long, spans binary")


def removed(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_words, n_removed, kept (the words that stay, joined by one space), intervals array<array<int>> (maximal, in words, ends exclusive)."""
    return _applied(docs, width, id_col, text_col, False, options)


def digests(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_words, n_removed, kept_sha256."""
    return _applied(docs, width, id_col, text_col, True, options)


def _applied(docs: DataFrame, width: int, id_col: str, text_col: str, digest: bool, options: dict) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = _keyed(docs, id_col, text_col)
    found = _repeats(keyed, width, options.get("buckets") or buckets_for(docs, text_col), options.get("digest_bytes", 7), options.get("mask", _ALL), text_col)
    # The window deals and sorts rows as the join does. Which of equal rows is the first makes no difference.
    copy = F.row_number().over(Window.partitionBy("_key", "_tie").orderBy("_key"))
    rows = keyed.withColumn("_again", (F.col("_tie") > 0) & (copy > 1))
    both = rows.join(found.toDF("_key", "_tie", "_spans"), ["_key", "_tie"], "left").select(id_col, text_col, "_again", "_spans")

    def apply(batches):
        import pyarrow as pa

        for batch in batches:
            n_words, n_removed, kept, intervals = [], [], [], []
            for text, again, blob in zip(texts_in(batch, text_col), batch.column("_again").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                words = text.split()  # of bytes: at [\x20\x09-\x0D] only
                n_words.append(len(words))
                spans = np.frombuffer(blob or b"", "<u4").reshape(-1, 2).tolist()
                if again:  # all of its windows are in its equal
                    spans = [[0, len(words)]] if len(words) >= width else []
                at, parts = 0, []
                for a, b in spans:
                    parts += words[at:a]
                    at = b
                words = parts + words[at:] if spans else words
                n_removed.append(n_words[-1] - len(words))
                stays = b" ".join(words)
                kept.append(hashlib.sha256(stays).hexdigest() if digest else stays.decode())
                intervals.append(spans)
            columns = [batch.column(id_col), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            names = [id_col, "n_words", "n_removed", "kept_sha256" if digest else "kept"]
            if not digest:
                columns.append(pa.array(intervals, pa.list_(pa.list_(pa.int32()))))
                names.append("intervals")
            yield pa.RecordBatch.from_arrays(columns, names)

    extra = "kept_sha256 string" if digest else "kept string, intervals array<array<int>>"
    return both.mapInArrow(apply, f"`{id_col}` {kind}, n_words long, n_removed long, {extra}")
