import hashlib
import random
import re

from pyspark.sql import functions as F

from nodeloom.llm import substrings


def brute(rows, width):
    """id -> (n_words, n_removed, kept); ids are distinct."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", x or "") for i, x in rows}
    seen, out = set(), {}
    for i in sorted(words, key=lambda i: (i is None, i or 0)):
        w, gone = words[i], set()
        for s in range(len(w) - width + 1):
            window = tuple(w[s : s + width])
            if window in seen:
                gone |= set(range(s, s + width))
            seen.add(window)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), kept)
    return out


def made(seed, n=300, vocabulary=400):
    rng = random.Random(seed)
    word = lambda: rng.choice(["w", "é", "😀", "the\x1c"]) + str(rng.randint(0, vocabulary))
    passages = [[word() for _ in range(rng.randint(15, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [[word() for _ in range(rng.randint(0, 40))]]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), [word() for _ in range(rng.randint(0, 5))]]
        rows.append((i * 7 - 90, rng.choice([" ", "\n", " \t "]).join(x for p in parts for x in p)))
    rows += [(5001, None), (5002, ""), (5003, "a b c"), (5004, "x " * 3000), (None, rows[3][1])]
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(docs, monkeypatch):
    for seed, options in ((1, {}), (2, {"buckets": 1}), (3, {"buckets": 1024, "digest_bytes": 8})):
        rows = made(seed)
        frame = docs(rows).repartition(7).withColumns({"spans": F.lit(1), "starts": F.lit(1), "key": F.lit("k"), "n_words": F.lit(0)})
        want = brute(rows, 20)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digests(frame, **options).collect()}
        assert got == {i: (a, b, hashlib.sha256(c.encode()).hexdigest()) for i, (a, b, c) in want.items()}
    full = {r.doc_id: r for r in substrings.removed(frame, buckets=4).collect()}
    for i, (a, b, c) in want.items():
        assert full[i].kept == c and sum(e - s for s, e in full[i].intervals) == b


def test_small_groups(spark, docs):
    rows = made(5)
    was, substrings.GROUP_BYTES = substrings.GROUP_BYTES, 700
    try:
        got = {r.doc_id: r.n_removed for r in substrings.digests(docs(rows).coalesce(1), 20).collect()}
    finally:
        substrings.GROUP_BYTES = was
    assert got == {i: b for i, (_, b, _) in brute(rows, 20).items()}


def test_repeated_rows_and_empty_table(docs):
    text = " ".join(map(str, range(50)))
    got = substrings.digests(docs([(1, text), (1, text), (2, text)]).repartition(3)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 50)]
    assert substrings.digests(docs([])).count() == 0


def brute_rows(rows, width):
    """(id, n_words, n_removed, kept) of every row; rows of one id and one text are one document, null ids are documents of their own."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", x or "") for _, x in rows]
    tie = lambda k: (rows[k][0] is None, rows[k][0] or 0, DIGEST[rows[k][1] or ""] * (1 if rows[k][0] is None else -1))
    seen, out, by_document = set(), [], {}
    for k in sorted(range(len(rows)), key=tie):
        w, document = words[k], k if rows[k][0] is None else rows[k]
        if document not in by_document:
            gone = by_document[document] = set()
            for s in range(len(w) - width + 1):
                window = tuple(w[s : s + width])
                if window in seen:
                    gone |= set(range(s, s + width))
                seen.add(window)
        gone = by_document[document]
        out.append((rows[k][0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


DIGEST = {}


def test_null_ids_and_ids_with_several_texts_equal_brute_force(docs):
    last = 2**63 - 1
    for seed, options, parts in ((1, {}, 1), (2, {"buckets": 1}, 5), (3, {"buckets": 256, "digest_bytes": 8}, 3)):
        rng = random.Random(seed)
        texts = [x for _, x in made(seed, 90)]
        rows = [(rng.choice([None, None, i, i, i // 2, 7, last]), rng.choice([x, x, texts[0], texts[1]])) for i, x in enumerate(texts)]
        rows += [(None, texts[2]), (None, texts[2]), (7, texts[2]), (8, texts[3]), (8, texts[4]), (8, texts[3]), (None, "short"), (None, "short"), (None, None), (None, ""), (last, texts[2])]
        frame = docs(rows)
        digest = F.greatest(F.lit(1), F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(last)))
        DIGEST.update({r.text: r.d for r in frame.select(F.coalesce("text", F.lit("")).alias("text"), digest.alias("d")).collect()})
        got = substrings.removed(frame.repartition(parts), **options).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute_rows(rows, 20)


def test_packing_of_two_texts_under_one_id():
    import numpy as np

    ids, ties, starts = np.array([5, 5, 5, 5]), np.array([-9, -9, -3, -3]), np.array([10, 310, 5, 405])
    packed = substrings._pack(np.arange(4, dtype=np.uint64), np.arange(300, 304, dtype=np.uint64), ids, ties, starts, 8)
    assert [x.tolist() for x in substrings._unpack(*packed, 8)] == [[0, 1, 2, 3], [300, 301, 302, 303], ids.tolist(), ties.tolist(), starts.tolist()]


def test_first_hashes_that_collide_remove_nothing(docs):
    """With 16 bits of the first hash a thousand pairs of windows collide; the second tells them apart, within groups and across."""
    was = substrings.GROUP_BYTES
    for parts, group in ((1, was), (6, 900)):
        rows = made(7, 120)
        substrings.GROUP_BYTES = group
        try:
            got = {r.doc_id: (r.n_removed, r.kept) for r in substrings.removed(docs(rows).repartition(parts), buckets=16, mask=0xFFFF).collect()}
        finally:
            substrings.GROUP_BYTES = was
        assert got == {i: (b, c) for i, (_, b, c) in brute(rows, 20).items()}


def test_buckets_have_no_cap(docs, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 1)
    assert substrings.buckets_for(docs([(1, "x" * 300_000), (2, None)])) == 1 << 19
    assert substrings.buckets_for(docs([])) == 16
