"""Benchmark decontamination by canonical templates, in native expressions.

A text becomes words and numbers (one regular expression, once). Two templates are made of them:
``plain``, where numbers and the units behind them are typed placeholders and words lose their case,
and ``named``, where capitalised words that are no stop words are placeholders as well. Windows of
``WIDTH`` template words of documents and of benchmark items are joined by hash (and compared word for
word), so a question whose numbers, names or units were changed still meets its item, and a copy
in any case meets it by the plain form. Windows with fewer than ``LEAST_WORDS`` words that are no
placeholders say nothing and are left to a third, literal form, where numbers stay as they are.

A document leaks an item if it has ``least_share`` of the item's distinct windows, and the values in
the item's slots map consistently (one value of the item to one value of the document): over
all windows found, or over those of any one shift between item and document, or over those without slots.

Documents are tested against a bitmap of the items' hashes within the row; only windows that may
be an item's are exploded, so table-like or boilerplate text costs no rows. The items' windows are
broadcast while they are at most ``BROADCAST_WINDOWS`` (counted first); beyond, the join
shuffles the surviving windows by hash. No text is shuffled.

Defined cases: null and empty texts have no windows; items of ``SHORT`` to ``WIDTH`` - 1 words are one
window, shorter ones leak only into documents that are nothing else; rows are judged one by one, rows of equal id
and text as one, null ids like any other; an item given twice (id and text) counts once; empty
tables give an empty result; columns other than ids and texts are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import stored
from nodeloom.llm.quality import STOP_WORDS

WIDTH = 8
#: The part of an item's windows that a document must have.
LEAST_SHARE = 0.3
#: So many words of a window are no placeholders (all but as many as there are, in shorter windows).
LEAST_WORDS = 4
#: Items of fewer words must be the whole document.
SHORT = 4
BROADCAST_WINDOWS = 200_000
#: The bitmap's bits for each window of the items, and its largest size in longs (2 MB).
BITS, MOST_LONGS = 16, 1 << 18
#: Words that are units after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l gal s sec min h hr hrs hour hours day days week weeks year years mph kmh kph hz khz mhz ghz w kw v mv k c f kb mb gb tb percent dollars dollar euros euro cents cent usd eur pounds miles meters metres feet inches grams liters litres degrees".split()
#: Words that are no names where they begin a sentence.
NO_NAMES = sorted({*STOP_WORDS, *"if when how what who where why there these those then each every all some find given after before while let no yes do does did can will".split()})
_TOKEN = r"[a-zA-Z\p{L}\p{M}]++(?:['’][\p{L}\p{M}]++)*+|\p{Nd}++(?:[.,]\p{Nd}++)*+|(?<=\p{Nd} ?)[$€£%°]++"
_SYMBOLS = r"^[$€£%°]"
#: Codes of the placeholders; words' codes are hashes.
_NUM, _UNIT, _NAME = 1, 2, 3
_FORMS = ("named", "plain", "literal")
_HITS = "array<struct<at:int,width:int,h:bigint>>"


def _is_number(low: Column) -> Column:
    first = F.ascii(low)
    return first.between(48, 57) | ((first > 127) & F.regexp_like(low, F.lit(r"^\p{Nd}")))


def canonical(rows: DataFrame, keys: list[str], text_col: str, literal: bool) -> DataFrame:
    """The keys; low: lower-cased words and numbers; named, plain and, if asked for, literal: their codes, parallel arrays."""
    a = rows.select(*keys, F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(_TOKEN), F.lit(0)).alias("_tok"))
    a = a.select(*keys, "_tok", F.transform("_tok", lambda w: F.lower(w)).alias("low"))
    is_unit = lambda w, i: (i > 0) & (w.isin(UNITS) | F.regexp_like(w, F.lit(_SYMBOLS))) & _is_number(F.get("low", i - 1))
    code = lambda w, i: F.when(_is_number(w), F.lit(_NUM).cast("long")).when(is_unit(w, i), F.lit(_UNIT).cast("long")).otherwise(F.xxhash64(w))
    a = a.select(*keys, "_tok", "low", F.transform("low", code).alias("plain"))

    def named(c: Column, i: Column) -> Column:
        w, low = F.get("_tok", i), F.get("low", i)
        is_name = (w != low) & (F.substring(w, 1, 1) != F.substring(low, 1, 1)) & ~low.isin(NO_NAMES) & (c != _UNIT)
        return F.when(is_name, F.lit(_NAME).cast("long")).otherwise(c)

    third = [F.transform("low", lambda w: F.xxhash64(w)).alias("literal")] if literal else []
    return a.select(*keys, "low", F.transform("plain", named).alias("named"), "plain", *third)


def _hashed(a: DataFrame, keep: list[str], forms: list[str], widths: list[int]) -> DataFrame:
    """For each form and width ``_<form>_<width>``: hashes of all windows, put together from those of 1, 2, 4 and 8 words."""
    n = F.size("low")
    part = {(f, 1): f for f in forms}
    for size in (2, 4, 8):
        if size <= max(widths, default=0):
            half = size // 2
            joined = {f: F.zip_with(part[f, half], F.slice(part[f, half], half + 1, F.greatest(n - half, F.lit(0))), lambda x, y: F.xxhash64(x, y)) for f in forms}
            a = a.withColumns({f"_{f}__{size}": c for f, c in joined.items()})
            part |= {(f, size): f"_{f}__{size}" for f in forms}
    out = {}
    for f in forms:
        for w in widths:
            at, h = 0, None
            for size in (8, 4, 2, 1):
                if w & size:
                    own = F.slice(part[f, size], at + 1, F.greatest(n - at, F.lit(0)))
                    h = own if h is None else F.zip_with(h, own, lambda x, y: F.xxhash64(x, y))
                    at += size
            # Short windows count only where they are the whole text; what the join of halves made beyond the end is cut off.
            fits = n == w if w < SHORT else n >= w
            out[f"_{f}_{w}"] = F.when(fits, F.slice(h, 1, F.greatest(n - (w - 1), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    return a.select(*keep, "low", *[c.alias(k) for k, c in out.items()])


def _with_slots(form: str, width: int) -> Column:
    """h and slots of each window. A word's hash is as good as never a placeholder's code."""
    slots = lambda i: F.transform(F.slice(form, i + 1, width), lambda c: c.between(_NUM, _NAME))
    return F.transform(f"_{form}_{width}", lambda h, i: F.struct(h.alias("h"), slots(i).alias("slots")))


def _item_windows(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """_key (id and text digest of the item), place (of the window's first occurrence), width, form, h, words, slots (which are placeholders)."""
    keyed = items.select(F.struct(F.col(item_id).alias("_item"), F.xxhash64(F.coalesce(F.col(item_text), F.lit(""))).alias("_digest")).alias("_key"), F.col(item_text).alias("_text"))
    a = canonical(keyed.dropDuplicates(["_key"]), ["_key"], "_text", True).filter(F.size("low") > 0)
    a = a.withColumn("width", F.least(F.size("low"), F.lit(WIDTH)))
    parts = []
    # At most WIDTH values; a plan for each width that there is.
    for w in sorted(r.width for r in a.select("width").distinct().collect()) or [WIDTH]:
        own = a.filter(F.col("width") == w)
        hashed = _hashed(own, ["_key", *_FORMS], list(_FORMS), [w])
        # Outer, as else the optimizer would test the whole expression's size once more, in terms of the text.
        at = F.posexplode_outer(F.arrays_zip(*[_with_slots(f, w).alias(f) for f in _FORMS])).alias("place", "x")
        parts.append(hashed.select("_key", "low", at).filter("place is not null").select("_key", "place", F.lit(w).alias("width"), F.slice("low", F.col("place") + 1, w).alias("words"), "x.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    words = lambda f: F.size(F.filter(F.col(f)["slots"], lambda s: ~s))
    tells = lambda f: words(f) >= F.least(F.lit(LEAST_WORDS), F.col("width"))
    identity = F.when(tells("plain"), F.col("plain")["h"]).otherwise(F.col("literal")["h"])
    first = out.withColumn("identity", identity).groupBy("_key", "identity").agg(F.min_by(F.struct("place", "width", "words", *_FORMS), "place").alias("x")).select("_key", "identity", "x.*")
    forms = [F.when(tells(f), F.struct(F.lit(f).alias("form"), F.col(f)["h"].alias("h"), F.col(f)["slots"].alias("slots"))) for f in ("named", "plain")]
    literal = F.when(~tells("plain"), F.struct(F.lit("literal").alias("form"), F.col("literal")["h"].alias("h"), F.transform(F.col("literal")["slots"], lambda _: F.lit(False)).alias("slots")))
    rows = first.select("_key", "place", "width", "words", F.explode(F.array_compact(F.array(*forms, literal))).alias("f")).select("_key", "place", "width", "words", "f.*")
    # Where the forms don't differ, one will do.
    return rows.groupBy("_key", "place", "h").agg(F.min_by(F.struct("width", "words", "form", "slots"), "form").alias("x")).select("_key", "place", "h", "x.*")


def _slotless(slots: str) -> Column:
    return ~F.exists(slots, lambda s: s)


def _bitmap(theirs: DataFrame, n: int) -> tuple[Column, int]:
    """The items' hashes as bits of an array, and the shift that gives a hash's place in it. As many rows as longs come to the driver."""
    power = min(MOST_LONGS.bit_length() - 1, max(1, (BITS * n // 64).bit_length()))
    word = F.shiftrightunsigned("h", 64 - power).cast("int")
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    longs = [0] * (1 << power)
    for r in theirs.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).collect():
        longs[r.word] = r.bits
    return F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>"), 64 - power


def _met(docs: DataFrame, theirs: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """id, digest, _key, place, shift, slotless, values (array of item's and document's value of the slots), for each window that a document shares with an item."""
    asked = theirs.groupBy("form", "width").agg(F.count(F.lit(1)).alias("n")).collect()  # as many as forms and widths
    if not asked:
        return None
    n = sum(r.n for r in asked)
    small = n <= BROADCAST_WINDOWS
    widths, literal = sorted({r.width for r in asked}), any(r.form == "literal" for r in asked)
    forms = [f for f in _FORMS if f != "literal" or literal]
    bits, shift = _bitmap(theirs, n)
    keys = [F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_digest"), F.col(text_col).alias("_text")]
    rows = canonical(docs.select(*keys), ["_id", "_digest"], "_text", literal)
    rows = _hashed(rows, ["_id", "_digest"], forms, widths)
    hit = lambda h: F.getbit(F.get(bits, F.shiftrightunsigned(h, shift).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1
    hits = []
    for f in forms:
        for w in widths:
            width = F.lit(w).alias("width")
            at = F.transform(f"_{f}_{w}", lambda h, i: F.struct(i.alias("at"), width, h.alias("h")))  # noqa: B023
            hits.append(F.when(F.exists(f"_{f}_{w}", hit), F.filter(at, lambda x: hit(x["h"]))).otherwise(F.array().cast(_HITS)))
    rows = rows.select("_id", "_digest", "low", F.array_distinct(F.concat(*hits)).alias("hits"))
    rows = rows.select("_id", "_digest", F.explode_outer(F.transform("hits", lambda x: F.struct(x["at"].alias("at"), x["h"].alias("h"), F.slice("low", x["at"] + 1, x["width"]).alias("own")))).alias("x")).filter("x is not null").select("_id", "_digest", "x.*")
    met = rows.join(F.broadcast(theirs) if small else theirs, "h").filter(F.size("own") == F.size("words"))
    triples = F.arrays_zip(F.col("slots").alias("s"), F.col("words").alias("item"), F.col("own").alias("doc"))
    met = met.filter(F.forall(triples, lambda x: x["s"] | (x["item"] == x["doc"])))
    values = F.transform(F.filter(triples, lambda x: x["s"]), lambda x: F.struct(x["item"].alias("item"), x["doc"].alias("doc")))
    return met.select("_id", "_digest", "_key", "place", (F.col("at") - F.col("place")).alias("shift"), _slotless("slots").alias("slotless"), values.alias("values"))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """id, item_id, n_windows (of the item's windows, those found), item_windows, n_slots (slots of the windows found): contaminated documents with their items."""
    out = _leaks(docs, items, id_col, text_col, item_id, item_text, least_share)
    return out.select(F.col("_id").alias(id_col), F.col("_item").alias(item_id), "n_windows", "item_windows", "n_slots")


def _leaks(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, least_share: float) -> DataFrame:
    theirs = _item_windows(items, item_id, item_text)
    met = _met(docs, theirs, id_col, text_col)
    if met is None:
        kinds = f"_id {docs.schema[id_col].dataType.simpleString()}, _digest long, _item {items.schema[item_id].dataType.simpleString()}"
        return docs.sparkSession.createDataFrame([], f"{kinds}, n_windows int, item_windows int, n_slots int")
    each = met.groupBy("_id", "_digest", "_key", "shift").agg(
        F.collect_set("place").alias("places"),
        F.collect_set(F.when(F.col("slotless"), F.col("place"))).alias("fixed"),
        F.array_distinct(F.flatten(F.collect_set("values"))).alias("values"),
    )
    consistent = lambda values: F.size(values) == F.size(F.array_distinct(F.transform(values, lambda v: v["item"])))
    one = F.when(consistent("values"), F.size("places")).otherwise(F.lit(0))
    pairs = each.select("_id", "_digest", "_key", "places", "fixed", "values", one.alias("one")).groupBy("_id", "_digest", "_key").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.array_distinct(F.flatten(F.collect_list("fixed"))).alias("fixed"),
        F.array_distinct(F.flatten(F.collect_list("values"))).alias("values"),
        F.max("one").alias("one"),
    )
    about = theirs.groupBy("_key").agg(F.count_distinct("place").cast("int").alias("item_windows"))
    whole = F.when(consistent("values"), F.size("places")).otherwise(F.lit(0))
    found = pairs.select("_id", "_digest", "_key", F.greatest(whole, "one", F.size("fixed")).alias("n_windows"), F.size("values").alias("n_slots")).join(about, "_key")
    found = found.filter((F.col("n_windows") > 0) & (F.col("n_windows") >= F.col("item_windows") * F.lit(least_share)))
    return found.select("_id", "_digest", F.col("_key._item").alias("_item"), "n_windows", "item_windows", "n_slots")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """docs without the contaminated rows; all their columns. Their keys stay in the shared folder, or go with the open Scratch."""
    gone = _leaks(docs, items, id_col, text_col, item_id, item_text, least_share).select(F.col("_id").alias("_gone"), F.col("_digest").alias("_gone_digest")).distinct()
    # Written, so that its size is known: a small one is broadcast and no text is shuffled.
    gone = stored(gone, "leaks")
    same = docs[id_col].eqNullSafe(gone["_gone"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == gone["_gone_digest"])
    return docs.join(gone, same, "left_anti")
