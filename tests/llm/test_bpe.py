import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from nodeloom.llm import bpe


@pytest.fixture(scope="module")
def both():
    path = bpe.default_path()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return bpe.encoder(path), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = ["'s", "'re", "'ll", "'", "'t", " ", "  ", "\n", "\t", " ", "　", "a", "B", "é", "中", "1", "²", "!", "?", "😀", "́", "\x1c", "\x85", "l", "e", "r", "v", "s", " '", "ſ", "​", "\x00"]


def test_equals_the_library(both):
    own, library = both
    rng = random.Random(7)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x7F), rng.randint(0x80, 0x2FFF), rng.randint(0x3000, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(20)) for _ in range(500)]
    texts += ["", "a" * 5000, "ab" * 3000, " " * 999, "x" + "\n" * 77 + "y"]
    for text, ids in zip(texts, own.encode([x.encode() for x in texts]), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), text[:80]
        assert own.decode(ids) == text.encode()


def test_every_token_and_long_slices(both):
    own, library = both
    pieces = list(own.ranks)[:: 97]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    n = np.array([len(x) for x in pieces])
    ids, counts = own.merge_many(data, np.cumsum(n) - n, n)
    assert counts.tolist() == [1] * len(pieces) and ids.tolist() == [own.ranks[x] for x in pieces]
    long = "".join(random.Random(3).choices("etaoinshr", k=4000))
    assert own.merge(long.encode()) == library.encode_ordinary(long)


def test_offsets(both):
    own, _ = both
    text = "Ünïcode and it's offsets".encode()
    ids = own.encode([text])[0]
    assert [text[o : o + own.lengths[i]] for o, i in zip(own.offsets_of(ids), ids, strict=True)] == [own.decode(np.array([i])) for i in ids]


def test_scan_equals_steps():
    own, compose, images, _ = bpe._machine()
    symbols = np.random.default_rng(1).integers(0, 10, 70_000)
    got = images[:, bpe.START][bpe.scan(own[symbols], compose)]
    state = bpe.START
    for i, x in enumerate(symbols):
        state = bpe._step(state, int(x))[0]
        assert got[i] == state


def test_frames(spark, docs, both):
    _, library = both
    rows = [(1, "it's 12 words"), (2, None), (3, ""), (3, ""), (4, "long " * 30000), (None, "no id")]
    frame = docs(rows)
    got = sorted(map(tuple, bpe.digests(frame).collect()), key=str)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for i, x in rows:
        ids = library.encode_ordinary(x or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((x or "").encode())))
    assert got == sorted(want, key=str)
    assert bpe.digests(docs([])).count() == 0
    back = bpe.decoded(bpe.encoded(frame)).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), x or "") for i, x in rows)
