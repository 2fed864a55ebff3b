"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Every measure is a native expression over the text or over arrays within its own row, so nothing is
shuffled. Word windows that repeat in a text are found by sorting (hash, position) pairs of the row.

Defined cases: a null or empty text has no words and fails; a text of any length is one row; tied or
repeated rows are judged alike; ratios of nothing are 0; an empty table gives an empty one; of the
input only ``id_col`` and ``text_col`` are read, so clashing extra columns do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
#: Frequent short words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you "
    "au aux avec ce ces dans de des du elle en est et il je la le les leur mais ne nous ou par pas pour qui que sa se ses son sur un une vous "
    "als am auch auf aus bei das dem den der des die ein eine einen einer er es für hat ich im in ist mit nicht oder sich sie sind und von war wie wir zu zum "
    "al como con del el ella en entre es esta este la las lo los más no o para pero por que se sin su sus un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """Keeps a text whose measure lies between least and most, both included."""

    measure: str
    least: float = float("-inf")
    most: float = float("inf")


RULES = (
    Rule("n_words", 50, float("inf")),
    Rule("repeat_ratio", most=0.5),
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", most=0.05),
    Rule("stop_ratio", least=0.05),
    Rule("dup_line_ratio", most=0.5),
    Rule("long_word_ratio", most=0.2),
)


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules as one boolean expression over the measures."""
    out = F.lit(True)
    for r in rules:
        if r.least != float("-inf"):
            out = out & (F.col(r.measure) >= F.lit(r.least))
        if r.most != float("inf"):
            out = out & (F.col(r.measure) <= F.lit(r.most))
    return out


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the counts and the ratios of every whole text."""
    text = F.col("_text")
    a = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # Leading and trailing white space would leave empty words; an empty text has none.
    a = a.withColumn("_words", F.filter(F.split(text, SPACES), lambda w: w != ""))
    a = a.withColumn("n_words", F.size("_words").cast("long"))
    a = a.withColumn("_codes", F.transform("_words", lambda w: F.xxhash64(w)))
    windows = F.transform(
        F.sequence(F.lit(1), F.col("n_words").cast("int") - 2),
        lambda i: F.xxhash64(F.element_at("_codes", i), F.element_at("_codes", i + 1), F.element_at("_codes", i + 2)),
    )
    a = a.withColumn("_windows", F.when(F.col("n_words") >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    a = a.withColumn("_pairs", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), pairs).otherwise(none))
    # In hash order, a window that repeats has a neighbour of the same hash; it covers three words.
    same = lambda p, i: F.coalesce(F.get("_pairs", i)["h"] == p["h"], F.lit(False))
    repeated = F.filter("_pairs", lambda p, i: same(p, i - 1) | same(p, i + 1))
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2))))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    a = a.select(
        id_col,
        "n_words",
        (F.length(text) - F.length(F.regexp_replace(text, SPACES, ""))).alias("_white"),
        F.length(text).alias("_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("_stops"),
        F.size(F.filter("_words", lambda w: F.length(w) > 30)).alias("_longs"),
    )
    a = a.withColumns({"word_chars": (F.col("_chars") - F.col("_white")).cast("long"), "_n_lines": F.size("_lines"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
    return a.select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        _ratio("word_chars", "n_words").alias("mean_word_chars"),
        _ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        _ratio("_stops", "n_words").alias("stop_ratio"),
        _ratio("n_dup_lines", "_n_lines").alias("dup_line_ratio"),
        _ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
        _ratio("_longs", "n_words").alias("long_word_ratio"),
    )


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures with base_failed (too few words, or more than half of them in repeated windows) and kept."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured(docs, id_col, text_col).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))
