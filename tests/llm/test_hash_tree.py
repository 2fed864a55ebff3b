import zlib

from pyspark.sql import functions as F

from nodeloom.llm import hash_tree as T


def test_growth_takes_rows_only_into_itself(spark):
    root = T.tree(40)
    ids = spark.range(20000)
    got = ids.select(T.shard_of(F.col("id"), root).alias("a"), T.shard_of(F.col("id"), T.grown(root, 40)).alias("b")).collect()
    assert all(r.a == r.b or r.b == 40 for r in got)
    assert {r.a for r in got} == set(range(40)) and 300 < sum(r.b == 40 for r in got) < 700
    sizes = [sum(r.a == s for r in got) for s in range(40)]
    assert min(sizes) > 380 and max(sizes) < 620


def test_weights_move_rows_within_their_subtree(spark):
    ids = spark.range(20000)
    got = ids.select(T.shard_of(F.col("id"), T.tree(40)).alias("a"), T.shard_of(F.col("id"), T.tree(40, weights={7: 3.0})).alias("b")).collect()
    moved = [(r.a, r.b) for r in got if r.a != r.b]
    assert moved and all(b // 10 == 0 for _, b in moved)  # only into the region whose weight grew
    assert all(b == 7 or b // 5 == 1 or a // 10 for a, b in moved)
    share = sum(r.b == 7 for r in got) / 20000
    assert 0.06 < share < 0.083  # 3 of 42
    none = ids.select(T.shard_of(F.col("id"), T.tree(12, weights={3: 0.0})).alias("a")).filter("a = 3").count()
    assert none == 0


def test_placed(docs):
    rows = [(i, "é" * (i % 7) if i % 5 else None) for i in range(900)] + [(5, "twice"), (5, "twice"), (None, None), (None, "x")]
    root = T.tree(40)
    got = T.placed(docs(rows), root, T.grown(root, 40)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len((x or "").encode()) + 16, zlib.crc32((x or "").encode())) for i, x in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert {r.law for r in got} == {"key"}
    assert T.placed(docs([]), root).count() == 0
    assert all(r.grown_shard is None for r in T.placed(docs(rows[:3]), root).collect())


def test_clashing_columns(docs):
    frame = docs([(1, "a"), (2, "b")]).withColumns({"shard": F.lit(9), "slot": F.lit("x"), "size": F.lit(0), "_bucket": F.lit(1)})
    assert {r["size"] for r in T.placed(frame, T.tree(3)).collect()} == {17}
