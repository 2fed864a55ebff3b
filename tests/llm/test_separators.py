import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.llm import bpe
from nodeloom.llm import separators as S
from nodeloom.llm.common import shared_dir


def test_flat_files(spark, tmp_path):
    rng, want = np.random.default_rng(1), []
    for k, (dtype, size) in enumerate([("<u2", 5000), ("<u2", 0), ("<u2", 1), ("<u2", 777)]):
        data = rng.integers(0, 9, size).astype(dtype)
        data[data > 6] = S.END if k != 3 else 0
        (tmp_path / f"t{k}.bin").write_bytes(data.tobytes())
        n = 0
        for number, part in enumerate(np.split(data, np.flatnonzero(data == S.END) + 1)):
            ended = len(part) > 0 and part[-1] == S.END
            if len(part):
                want.append((f"t{k}.bin", number, len(part) - ended, bool(ended)))
    for block, span in ((64, 64), (64, 1280), (1 << 20, 1 << 20)):
        got = S.documents(S.searched(spark, str(tmp_path), block=block, span=span)).collect()
        assert sorted((r.file.rsplit("/", 1)[1], r.number, r.n_tokens, r.terminated) for r in got) == sorted(want)
    wide = np.array([5, 70000, 70001, 3], "<u4")
    (tmp_path / "w").mkdir()
    (tmp_path / "w/x.bin").write_bytes(wide.tobytes())
    got = S.documents(S.searched(spark, str(tmp_path / "w"), end=70001, dtype="<u4", block=8, span=16)).collect()
    assert sorted((r.number, r.n_tokens, r.terminated) for r in got) == [(0, 2, True), (1, 1, False)]


def test_texts(docs):
    e = bpe.encoder(bpe.default_path())
    rows = [(i, "word " * (i * i % 50)) for i in range(60)] + [(100, None), (101, "x" * 20000), (101, "x" * 20000), (None, "é"), (102, "")]
    frame = docs(rows).repartition(3).withColumns({"file": F.lit(1), "block": F.lit("b"), "ids": F.lit(0)})
    for block in (64, 1 << 20):
        got = S.counted(frame, block=block, span=block).collect()
        assert all(r.terminated for r in got)
        assert sorted((str(r.id), r.n_tokens) for r in got) == sorted((str(i), len(e.encode([(x or "").encode()])[0])) for i, x in rows)
    assert S.counted(docs([])).count() == 0


def test_runs_of_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "RUN", 3)
    data = np.random.default_rng(2).integers(S.END - 20, S.END + 1, 3000).astype("<u2")
    (tmp_path / "x.bin").write_bytes(data.tobytes())
    got = S.documents(S.searched(spark, str(tmp_path), block=64, span=256)).collect()
    want = [len(x) - 1 for x in np.split(data, np.flatnonzero(data == S.END) + 1)]
    assert [r.n_tokens for r in sorted(got, key=lambda r: r.number)][: len(want) - 1] == want[:-1]
    assert sorted(r.number for r in got) == list(range(len(got)))


def test_other_attempts_and_what_stays(spark, docs, tmp_path):
    folder = f"file:{tmp_path}/flat"
    (tmp_path / "flat").mkdir()
    ids = S.written(docs([(1, "a b"), (2, "c")]).coalesce(1), folder).cache()
    ids.count()
    (tmp_path / "flat/0-999999.bin").write_bytes(np.array([5, S.END], "<u2").tobytes())  # left by an attempt that failed
    assert sorted(r.id for r in S.documents(S.searched(spark, folder), ids).collect()) == [1, 2]
    S.counted(docs([(1, "a")])).count()
    at = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    assert not [x for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if x.getPath().getName().startswith("flat-") and not x.getPath().getName().startswith("flat-ids")]


def test_odd_size(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no multiple of 2"):
        S.searched(spark, str(tmp_path)).count()
