import random

import regex
from pyspark.sql import functions as F

from nodeloom.llm import templates as T


def items(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


WORDS = "river stone walks under bright morning light while seven birds carry small green leaves over quiet hills and water moves slowly past".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(chr(97 + rng.randint(0, 25))) for _ in range(n))


def test_finds_planted_items_and_leaves_others(spark, docs):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(9, 40)) for _ in range(12)]
    rows, want = [], set()
    for i in range(120):
        x = prose(rng, rng.randint(0, 80))
        if i % 4 == 0:
            k = rng.randrange(12)
            x, _ = f"{x} {texts[k].upper() if i % 8 else texts[k].replace(' ', chr(10))}. {prose(rng, 20)}", want.add((i, k))
        rows.append((i, x))
    rows += [(800, None), (801, ""), (802, prose(rng, 30000) + " " + texts[0]), (803, texts[1]), (803, texts[1]), (None, texts[2])]
    want |= {(802, 0), (803, 1), (None, 2)}
    frame = docs(rows).withColumns({"item_id": F.lit(1), "raw": F.lit("r"), "h": F.lit(1)})
    bench = items(spark, *texts).withColumns({"doc_id": F.lit(5), "lang": F.lit("x")})
    got = T.leaks(frame, bench).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted(want, key=str)
    left = T.clean(frame, bench)
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in rows if i not in {a for a, _ in want}) and left.columns == frame.columns


def test_changed_parameters_need_consistent_slots(spark, docs):
    item = "If Anna walks 12 km in 3 hours and later Anna walks 12 km again, how far did Anna walk?"
    bench = items(spark, item, None, "", "two words", "two words")
    frame = docs([
        (1, "Quiz: " + item.replace("12", "7.5").replace("Anna", "Boris")),
        (2, "if Clara walks 12 km in 3 hours and later Dora walks 15 km again, how far did Eva walk?"),
        (3, item),
        (4, "Two, words!"),
        (5, "only two, words here: an item of so few words must be the whole document"),
        (6, item.replace("Anna walks 12", "Boris walks 9", 1) + " " + item),
        (7, item + " " + item.replace("Anna walks 12", "Boris walks 9", 1)),
    ])
    assert sorted((r.doc_id, r.item_id) for r in T.leaks(frame, bench).collect()) == [(1, 0), (3, 0), (4, 3), (4, 4), (6, 0), (7, 0)]


def brute(texts, items):
    """(document number, item number) of leaks, from the definition."""

    def forms(text):
        tok = regex.findall(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*|\d+(?:[.,]\d+)*|(?<=\d )[$€£%°]+|(?<=\d)[$€£%°]+", text or "")
        low = [x.lower() for x in tok]
        plain = ["<num>" if x[0].isdigit() else "<unit>" if i and low[i - 1][0].isdigit() and (x in T.UNITS or x[0] in "$€£%°") else x for i, x in enumerate(low)]
        named = ["<name>" if tok[i][0] != low[i][0] and low[i] not in T.NO_NAMES and p != "<unit>" else p for i, p in enumerate(plain)]
        return low, {"named": named, "plain": plain, "literal": low}

    out = set()
    for k, item in enumerate(items):
        low, by = forms(item)
        if not low:
            continue
        w = min(len(low), T.WIDTH)
        first = {}
        for at in range(len(low) - w + 1):
            tells = lambda f: sum(not x.startswith("<") for x in by[f][at : at + w]) >= min(T.LEAST_WORDS, w)
            kinds = [f for f in ("named", "plain") if tells(f)] + [] if tells("plain") else ["literal"] + ["named"] * tells("named")
            key = tuple(by["plain" if tells("plain") else "literal"][at : at + w]) + (tells("plain"),)
            first.setdefault(key, (at, kinds))
        for d, text in enumerate(texts):
            own, theirs = forms(text)
            if w < T.SHORT and len(own) != w:
                continue
            met = {}
            for at, kinds in first.values():
                for f in kinds:
                    for j in range(len(own) - w + 1):
                        if theirs[f][j : j + w] == by[f][at : at + w]:
                            values = {(low[at + x], own[j + x]) for x in range(w) if f != "literal" and by[f][at + x].startswith("<")}
                            met.setdefault(j - at, []).append((at, values))
            sound = lambda hits: (v := set().union(*[x for _, x in hits]), len({a for a, _ in v}) == len(v))[1]
            tries = [*met.values(), [h for x in met.values() for h in x], [h for x in met.values() for h in x if not h[1]]]
            if any(hits and sound(hits) and len({a for a, _ in hits}) >= T.LEAST_SHARE * len(first) for hits in tries):
                out.add((d, k))
    return out


def test_equals_brute_force(spark, docs, monkeypatch):
    for seed in (1, 2):
        rng = random.Random(seed)
        vocabulary = "the of walks Anna Boris river 3 12 7.5 km $ apples how many left Nord Süd if ñandú ½ 5 20 % ja".split()
        items_ = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 5, 7, 8, 12, 30]))) for _ in range(40)] + [None, "1 2 3 4 5 6 7 8 9 10", "a a a a a a a a a a a a", "1 2 3 4 5 6 7 8 9 10"]
        texts = []
        for i in range(150):
            parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))]
            for _ in range(rng.randint(0, 2)):
                x = rng.choice(items_) or ""
                swap = dict(zip(("Anna", "Boris", "3", "12", "Nord"), rng.sample(["Clara", "Dora", "9", "44", "Emil", "Anna", "12"], 5), strict=True)) if rng.random() < 0.6 else {}
                x = " ".join(swap.get(y, y) for y in x.split())
                parts += [rng.choice([x, x.upper(), x.lower()]), " ".join(rng.choices(vocabulary, k=rng.randint(0, 5)))]
            texts.append(" ".join(parts) if i % 9 else rng.choice(items_))
        texts += ["1 2 3 4 5 6 7 8 9 10 11 12", "7 7 7 7 7 7 7 7 7 7 7 7", "a " * 500]
        want = brute(texts, items_)
        assert len(want) > 30
        if seed == 2:
            monkeypatch.setattr(T, "BROADCAST_WINDOWS", 0)
            monkeypatch.setattr(T, "MOST_LONGS", 2)
        got = {(r.doc_id, r.item_id) for r in T.leaks(docs(list(enumerate(texts))), items(spark, *items_)).collect()}
        assert got == want


def test_text_of_placeholders_only_makes_no_rows(spark, docs):
    bench = items(spark, "1 2 3 4 5 6 7 8 9 10 11 12", " ".join(f"Anna {k} km" for k in range(9)), " ".join(WORDS))
    table = " ".join(str(i % 89) for i in range(40000))
    met = T._met(docs([(1, table), (2, "Boris 5 km " * 4000), (3, "4 5 6 7 8 9 10 11 12 13 14")]), T._item_windows(bench, "item_id", "text"), "doc_id", "text")
    assert {r[0] for r in met.select("_id").distinct().collect()} == {1, 3} and met.count() < 3000


def test_empty_and_joined_without_broadcast(spark, docs, monkeypatch):
    bench = items(spark, " ".join(WORDS))
    frame = docs([(1, " ".join(WORDS)), (2, "x")])
    assert T.leaks(docs([]), bench).count() == 0
    assert T.leaks(frame, items(spark)).count() == 0 and T.clean(frame, items(spark)).count() == 2
    monkeypatch.setattr(T, "BROADCAST_WINDOWS", 0)
    out = T.leaks(frame, bench)
    assert [r.doc_id for r in out.collect()] == [1]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_names_that_begin_sentences_and_copies_in_any_case(spark, docs):
    apples = "Anna has 3 apples in a bag. Anna gives 2 of them away. Anna wants to know how many apples are left."
    walk = "On monday morning Anna walks with Boris along the old river to Clara and Doris who wait there with Emil"
    bench = items(spark, apples, walk)
    texts = [
        (1, apples.replace("Anna", "Peter").replace("3", "14"), 0),
        (2, apples.lower(), 0),
        (3, apples.upper(), 0),
        (4, walk.lower(), 1),
        (5, walk.upper(), 1),
        (6, "some words before " + walk.replace("Anna", "Nora") + " and some after", 1),
        (7, apples.replace("Anna has", "Peter has").replace("Anna gives", "Olaf gives").replace("Anna wants", "Rita wants"), None),
        (8, "On tuesday evening Fritz eats with Gerd below the new tree at Hanna and Ida who sleep here near Jan", None),
    ]
    got = sorted((r.doc_id, r.item_id) for r in T.leaks(docs([x[:2] for x in texts]), bench).collect())
    assert got == [(i, k) for i, _, k in texts if k is not None]
