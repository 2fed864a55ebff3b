import random

import corpus_pipeline as P
from nodeloom.llm import secrets

WORDS = {"en": "the with thing whole other which water light river stone".split(), "de": "der und nicht schön über zwischen wasser licht fluss stein".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice("abcdefghijk") for _ in range(n))


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, prose(rng, "en" if i % 2 else "de", rng.randint(60, 120)), "en" if i % 2 else "de", "s", 1) for i in range(120)]
    bench = [(k, prose(rng, "en", 25)) for k in range(4)]
    text = {i: x for i, x, *_ in rows}
    words = text[3].split()
    planted = [
        (200, text[5], "en", "s", 1),  # exact copy
        (201, " ".join(words[:50] + ["changed"] + words[51:]), "en", "s", 1),  # near copy
        (202, f"{text[7]} {bench[1][1]} {text[9][:40]}", "en", "s", 1),  # leak
        (203, text[11] + " extra words token = 'abcdef0123456789' of another kind " + prose(rng, "en", 60), "en", "s", 1),  # secret
        (204, "漢字 仮名 交じり 文" * 9, None, "s", 1),  # no known language
        (205, None, "en", "s", 1),
        (206, "", "en", "s", 1),
    ]
    d = str(tmp_path)
    spark.createDataFrame(rows + planted, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = docs.columns
    for name, stage in P.STAGES:
        docs = stage(spark, docs, d)
        seen.append({r.doc_id: r for r in docs.collect()})
        assert name == "byte_bpe" or docs.columns == columns
    clean = set(range(120))
    assert [set(x) for x in seen] == [clean | {200, 201, 202, 203}, clean | {202, 203}, clean | {203}, clean | {203}, clean | {203}]
    assert secrets.MASK in seen[3][203].text and "abcdef0123456789" not in seen[3][203].text
    assert all(seen[3][i].text == text[i] for i in clean)
    got = {r.doc_id: r.n_tokens for r in P.run(spark, d).collect()}
    assert got == {i: r.n_tokens for i, r in seen[4].items()}
