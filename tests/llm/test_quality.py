import random
import re
from collections import Counter

from pyspark.sql import functions as F

from nodeloom.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_counts_equal_brute_force(docs):
    rng = random.Random(4)
    bits = ["the", "of", "a", "é😀", "#x", "$$", "\n", " ", "\t", "\x0b", " ", "and", "word", "the of a", "\n\n", "\x1c"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 300)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " \n "), (903, "the end " * 9000), (903, "the end " * 9000), (None, "no id")]
    got = quality.judged(docs(rows)).collect()
    key = lambda i, x: (str(i), *brute(x))
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(key(*r) for r in rows)
    assert not any(r.kept and r.base_failed for r in got)


def test_rules(docs):
    rng = random.Random(2)
    syllables = ["ka", "mi", "to", "re", "lu", "san", "ver", "dol", "pin", "gra"]
    prose = lambda n: " ".join("".join(rng.choices(syllables, k=3)) if i % 3 else "the" for i in range(n))
    frame = docs([(1, prose(100)), (2, " ".join(w + "$$$" for w in prose(100).split())), (3, prose(49)), (4, prose(60).replace("the", "xq"))])
    frame = frame.withColumns({"kept": F.lit("clash"), "n_words": F.lit(0), "_text": F.lit("x"), "_words": F.lit(1)})
    assert {r.doc_id: r.kept for r in quality.judged(frame).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert quality.judged(docs([])).count() == 0
    assert "Python" not in quality.judged(frame)._jdf.queryExecution().executedPlan().toString()
