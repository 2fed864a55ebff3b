import random
import re

import pytest
from pyspark.sql import functions as F

from nodeloom.llm import chosen_path as C
from nodeloom.llm.components import components


def brute(rows, width, at_least):
    sets = []
    for _, x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= at_least * len(a | b):
                label[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(root(i), []).append(doc)
    key = lambda d: (d is None, d or 0)
    return sorted(((str(doc), len(sets[i]), min(least[root(i)], key=key)) for i, (doc, _) in enumerate(rows)), key=str)


def made(seed, n_base=25):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgÉé") + str(rng.randint(0, 300))
    shared = [word() for _ in range(40)]
    texts = []
    for _ in range(n_base):
        base = [word() for _ in range(rng.choice([1, 2, 3, 5, 12, 60, 150]))]
        for _ in range(rng.choice([1, 1, 2, 6, 14])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w += shared
            texts.append(" ".join(w) if rng.random() < 0.8 else "\n".join(w).upper().replace("É", "é"))
    rng.shuffle(texts)
    return [(i * 3 + 1, x) for i, x in enumerate(texts)] + [(9000, None), (9001, " \n"), (9002, ""), (9003, "x y"), (9004, "X y"), (9003, "x y"), (None, texts[0])]


def check(docs, rows, width, at_least):
    frame = docs(rows).withColumns({"cls": F.lit(1), "doc": F.lit("d"), "component_id": F.lit(0), "n": F.lit(2)})
    got = C.grouped(frame, width, at_least).collect()
    assert sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, width, at_least)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return frame


def test_equals_brute_force(docs):
    rows = made(1)
    frame = check(docs, rows, 3, 85)
    left = C.one_of_each(frame, 3, 85)
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted({str(c) for _, _, c in brute(rows, 3, 85)}) and left.columns == frame.columns


@pytest.mark.parametrize("seed", [2, 3])
def test_large_nodes_and_components(docs, monkeypatch, seed):
    """Nodes and blocks of three at most: branching, peeling, centers and strays all take part."""
    monkeypatch.setattr(C, "NODE", 3)
    monkeypatch.setattr(C, "BLOCK", 3)
    check(docs, made(seed), 5, 80)


def test_empty(docs):
    assert C.grouped(docs([])).count() == 0 and C.one_of_each(docs([])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(50, 90)] + [(7, x) for x in range(100, 400)] + [(rng.randint(500, 600), rng.randint(500, 600)) for _ in range(60)]
    got = {r.u: r.v for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    label = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: v for x, v in label.items() if x != v}


def test_one_of_each_judges_rows(docs):
    """Null ids and equal ids with unrelated texts are documents of their own; one row of each component stays."""
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60)) for _ in range(30)]
    near = lambda k: base[k] + " more"
    rows = [(None, base[k]) for k in range(10)] + [(None, near(0)), (None, base[1])]
    rows += [(7, base[k]) for k in range(10, 20)] + [(7, near(10)), (7, base[11]), (9, near(12)), (8, base[12]), (9, base[20]), (None, near(13))]
    rows += [(2**63 - 1, base[21]), (None, base[22]), (3, None), (3, ""), (None, ""), (None, " "), (3, None)]
    frame = docs(rows)
    left = [(r.doc_id, r.text) for r in C.one_of_each(frame).collect()]
    group = {x: k for k, b in enumerate(base) for x in (b, near(k))}
    want = [(None, k) for k in [*range(10), 22]] + [(7, k) for k in range(10, 20)] + [(9, 20), (2**63 - 1, 21)]
    assert sorted(((i, group[x]) for i, x in left if x and x.strip()), key=str) == sorted(want, key=str)
    assert sorted((str(i), str(x)) for i, x in left if not x or not x.strip()) == sorted((str(i), str(x)) for i, x in rows[-5:])
    judged = {(r.doc_id, r.component_id) for r in C.grouped(frame).collect() if r.kept}
    assert {(i, i) for i, _ in left if i != 2**63 - 1} <= judged


def test_components_with_hubs(spark, monkeypatch):
    """Stars, chains and their bridges; hubs are broadcast, the others shuffled."""
    from nodeloom.llm import components as K

    monkeypatch.setattr(K, "HUB", 5)
    for seed in (1, 2):
        rng = random.Random(seed)
        links = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 190)] + [(x, 500) for x in range(480, 500)] + [(7, 7), (7, 8), (8, 7), (150, 490)]
        links += [(rng.randint(1000, 1300), rng.randint(1000, 1300)) for _ in range(150)]
        names = list({x for e in links for x in e})
        shuffled = dict(zip(names, rng.sample(names, len(names)), strict=True))
        links = [(shuffled[a], shuffled[b]) for a, b in links]
        root = {x: x for x in names}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        want = {(x, find(x)) for x in names if find(x) != x}
        got = [tuple(r) for r in K.components(spark.createDataFrame(links, "u long, v long")).collect()]
        assert len(got) == len(want) and set(got) == want
    assert K.components(spark.createDataFrame([], "u long, v long")).count() == 0
