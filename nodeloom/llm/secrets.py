"""Secret scan: known shapes, and a battery of randomness tests for strings of no known shape.

Known shapes (``BASE``) are matched leftmost and without overlap per kind; a match that is too short
is dropped but has used up its characters. The battery takes every longer run of letters and digits, of
these with + and /, and of these with - and _, so a key in a path is tested without the words around it
as well as with them; found strings that overlap are told as one. It infers its encoding from the characters seen, and tests the ranks of its symbols: chi-squared against a
uniform alphabet, runs above and below the alphabet's middle, serial correlation. Fisher's method
joins the three; a string whose randomness is refuted has the p-value 1 of a false discovery. For the
rest it is the largest of three, as each test must tell against ordered text: the chance that prose of this length
would look so even (a noncentral chi-squared, growing with length), and in base32 also, and in
hexadecimal only, that its letters and digits all happen to be of the alphabet and change places so
often; and the chances that runs or serial correlation of ordered text would be so near to those of
random text (``MARGIN``). A Benjamini-Hochberg step-up over the text's strings, weighted by their lengths,
bounds the share of false discoveries. Work grows as n log n with a text's strings.

All of it is native expressions within a row: no shuffle, no user functions. Positions are code
points, ends exclusive.

Defined cases: a null or empty text has no spans; texts of any length are scanned whole; repeated
rows get equal results; an empty table gives an empty one; only the named columns are read, so
clashing extra columns do no harm (``redacted`` keeps the other columns as they are).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in their order, patterns, the measured group, and its least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
RANDOM = "random"
LEAST_RANDOM = 20
#: Whole runs; then parts of runs, in each alphabet, with the separators of the others around them. Only lower-case parts are words: of 20
#: random symbols, these would be such in one case of 10^7.
CANDIDATES = (rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_RANDOM},}}={{0,2}}",) + tuple(rf"(?<![A-Za-z0-9{x}])[A-Za-z0-9{x}]{{{LEAST_RANDOM},}}={{0,2}}" for x in ("", "+/", "_-"))
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings in the order of inference: pattern, alphabet, and how far prose written in it is from uniform (size x sum of squared frequencies - 1);
#: how many digits come first in the alphabet, and the chance of a letter and of a digit of prose to be in it (taken high), where that tells anything.
ENCODINGS = (
    (r"^[0-9]+$", "", 0.0, 0, 1.0, 1.0),  # numbers are no secrets
    (r"^[0-9a-f]+$", _DIGITS + "abcdef", 0.6, 10, 0.4, 1.0),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF", 0.6, 10, 0.4, 1.0),
    (r"^[A-Z2-7]+$", "234567" + _UPPER, 1.1, 6, 1.0, 0.6),
    (r"^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER, 3.1, 0, 1.0, 1.0),
    (r"^[0-9A-Za-z+/]+$", "+/" + _DIGITS + _UPPER + _LOWER, 3.2, 0, 1.0, 1.0),
    (r"^[0-9A-Za-z_-]+$", "-_" + _DIGITS + _UPPER + _LOWER, 3.2, 0, 1.0, 1.0),
)
#: The chance, taken high, that in prose and identifiers a digit follows a letter or the other way round once more; a number before or after words is nothing special.
SWITCH = 0.25
REFUTED_BELOW = 0.001
#: How many deviations, times the square root of the length, ordered text is off at least in runs or in serial correlation.
MARGIN = 1.2
FALSE_DISCOVERIES = 0.01
#: Redaction works on parts of so many characters.
PART = 1000
MASK = "[SECRET]"
_SPAN = "array<struct<start:int,end:int,what:string>>"


def _let(value: Column, body) -> Column:
    """body of the value, which is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _scan(values: Column, join) -> Column:
    """Inclusive prefix scan of an array by doubling: n log n steps."""

    def over(xs: Column) -> Column:
        powers = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(xs), F.lit(1)))).cast("int")), lambda j: F.pow(F.lit(2), j).cast("int"))
        return F.aggregate(powers, xs, lambda acc, p: F.transform(acc, lambda x, i: F.when(i >= p, join(F.get(acc, i - p), x)).otherwise(x)))

    return _let(values, over)


def _spans(text: Column, hits: Column, measured: Column, pattern: str, least: int) -> Column:
    """Start, end and measured string of each match; places come from the lengths of matches and of the pieces between them."""
    pieces = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
    ends = _scan(F.zip_with(pieces, hits, lambda p, h: F.length(p) + F.length(h)), lambda x, y: x + y)
    both = F.arrays_zip(hits.alias("h"), measured.alias("m"))
    found = F.zip_with(both, ends, lambda x, e: F.struct((e - F.length(x["h"])).alias("start"), e.alias("end"), x["m"].alias("what")))
    return F.when(F.size(hits) > 0, F.filter(found, lambda x: F.length(x["what"]) >= least)).otherwise(F.array().cast(_SPAN))


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z), by a logistic curve; bounded away from 0."""
    x = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return F.greatest(F.lit(1e-12), F.lit(1.0) / (F.lit(1.0) + F.exp(x * 1.5976 + x * x * x * 0.07056)))


def _choose(token: Column, at: int) -> Column:
    out = None
    for pattern, *values in ENCODINGS:
        test = F.regexp_like(token, F.lit(pattern))
        out = F.when(test, F.lit(values[at])) if out is None else out.when(test, F.lit(values[at]))
    return out


def _tested(candidates: Column) -> Column:
    """Each candidate's symbols as ranks in its inferred alphabet, then the tests' p-values, step by step."""
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x).cast("double"))

    def prepared(c: Column) -> Column:
        token = F.rtrim(c["what"], F.lit("="))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), token.alias("t"), _choose(token, 0).alias("alphabet"), *[_choose(token, k).alias(name) for k, name in enumerate(("skew", "digits", "letter", "digit"), 1)])

    def ranked(c: Column) -> Column:
        ranks = F.transform(F.split(c["t"], ""), lambda s: F.position(s, c["alphabet"]) - 1)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), ranks.alias("r"), F.length(c["alphabet"]).cast("double").alias("a"), F.size(ranks).cast("double").alias("n"), *[c[k].alias(k) for k in ("skew", "digits", "letter", "digit")])

    def summed(c: Column) -> Column:
        r, n = c["r"], c["n"]
        turned = F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1))
        half = c["a"] / 2
        squares = total(F.array_distinct(r), lambda s: F.pow(F.size(F.filter(r, lambda x: x == s)), F.lit(2)))
        products = total(F.zip_with(r, turned, lambda x, y: x * y), lambda x: x)
        changes = total(F.slice(F.zip_with(r, turned, lambda x, y: ((x < half) != (y < half)).cast("int")), 1, F.size(r) - 1), lambda x: x)
        is_digit = lambda x: x < c["digits"]
        n_digits = total(r, lambda x: is_digit(x).cast("int"))
        switches = total(F.slice(F.zip_with(r, turned, lambda x, y: (is_digit(x) != is_digit(y)).cast("int")), 1, F.size(r) - 1), lambda x: x)
        return F.struct(
            (n_digits * F.log(c["digit"]) + (n - n_digits) * F.log(c["letter"]) + F.greatest(switches - 1, F.lit(0.0)) * F.log(F.lit(SWITCH))).alias("log_mixed"),
            c["start"].alias("start"), c["end"].alias("end"), n.alias("n"), c["a"].alias("a"), c["skew"].alias("skew"),
            (c["a"] * squares / n - n).alias("chi"), (changes + 1).alias("runs"), total(r, lambda x: (x < half).cast("int")).alias("low"),
            c["letter"].alias("letter"), products.alias("xy"), total(r, lambda x: x).alias("x"), total(r, lambda x: x * x).alias("xx"),
        )

    def judged(c: Column) -> Column:
        n, df = c["n"], c["a"] - 1
        spread = F.lit(2.0) / (df * 9)
        p_chi = _upper_tail((F.pow(c["chi"] / df, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))
        both = 2 * c["low"] * (n - c["low"])
        variance = both * (both - n) / (n * n * (n - 1))
        z_runs = F.abs(c["runs"] - 1 - both / n) / F.sqrt(F.greatest(variance, F.lit(1e-9)))
        p_runs = F.when(variance > 0, 2 * _upper_tail(z_runs)).otherwise(F.lit(1e-12))
        below = n * c["xx"] - c["x"] * c["x"]
        serial = (n * c["xy"] - c["x"] * c["x"]) / F.greatest(below, F.lit(1e-9))
        z_serial = F.abs(serial + 1 / (n - 1)) * (n - 1) * F.sqrt(n - 2) / n
        p_serial = F.when(below > 0, 2 * _upper_tail(z_serial)).otherwise(F.lit(1e-12))
        joint = -(F.log(p_chi) + F.log(F.least(p_runs, F.lit(1.0))) + F.log(F.least(p_serial, F.lit(1.0))))
        p_random = F.exp(-joint) * (1 + joint + joint * joint / 2)
        prose = n * c["skew"]
        # A number is as even in hexadecimal as a key is, so evenness tells nothing there.
        p_even = F.when(c["letter"] < 1, F.lit(1.0)).otherwise(_upper_tail(-(c["chi"] - df - prose) / F.sqrt(2 * (df + 2 * prose))))
        p_false = p_even * F.exp(c["log_mixed"])
        # Ordered text is at least MARGIN x sqrt(n) deviations off in runs or in serial correlation; all three must tell against it.
        far = lambda z, known: F.when(known, _upper_tail(F.lit(MARGIN) * F.sqrt(n) - z)).otherwise(F.lit(1.0))
        joint_p = F.greatest(p_false, far(z_runs, variance > 0), far(z_serial, below > 0))
        p = F.when(p_random < REFUTED_BELOW, F.lit(1.0)).otherwise(joint_p)
        return F.struct(p.alias("p"), c["start"].alias("start"), c["end"].alias("end"), n.alias("n"), c["chi"].alias("chi"), z_runs.alias("z_runs"), z_serial.alias("z_serial"))

    known = F.filter(F.transform(candidates, prepared), lambda c: F.length(c["alphabet"]) > 0)
    return F.transform(F.transform(F.transform(known, ranked), summed), judged)


def _discoveries(tested: Column) -> Column:
    """Weighted step-up over the battery's joint p-values: p / weight in ascending order against its share of FALSE_DISCOVERIES. Start and end of the discoveries."""

    def stepped(weighted: Column, m: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(weighted, lambda c, i: F.when(c["q"] <= F.lit(FALSE_DISCOVERIES) * (i + 1) / m, i).otherwise(F.lit(-1)))), F.lit(-1))
        return F.transform(F.slice(weighted, 1, last + 1), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))

    def all_of(t: Column) -> Column:
        m, lengths = F.size(t), F.aggregate(t, F.lit(0.0), lambda s, c: s + c["n"])
        weight = lambda total: F.sort_array(F.transform(t, lambda c: F.struct((c["p"] * total / (c["n"] * m)).alias("q"), c["start"].alias("start"), c["end"].alias("end"))))
        return _let(_let(lengths, weight), lambda w: stepped(w, m))

    return _let(tested, all_of)


def _merged(spans: Column) -> Column:
    """Start and end of spans, those that overlap as one."""

    def over(s: Column, reach: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] >= F.get(reach, i - 1)), i)), lambda i: i.isNotNull())
        one = lambda h: F.transform(h, lambda k, j: F.struct(F.get(s, k)["start"].alias("start"), F.get(reach, F.coalesce(F.get(h, j + 1), F.size(s)) - 1).alias("end")))
        return _let(heads, one)

    ends = lambda s: _scan(F.transform(s, lambda x: x["end"]), F.greatest)
    return _let(F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))), lambda s: _let(ends(s), lambda reach: over(s, reach)))


def _apart(candidates: Column, base: Column) -> Column:
    """The candidates that no base span overlaps: both in order of start, with the furthest end before each and the next start after it."""
    far = F.lit(2**31 - 1)
    events = F.sort_array(F.concat(F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("own"), b["end"].alias("end"), F.lit("").alias("what"))), F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("own"), c["end"].alias("end"), c["what"].alias("what")))))

    def over(ev: Column) -> Column:
        before = _scan(F.transform(ev, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(F.lit(-1))), F.greatest)
        after = F.reverse(_scan(F.reverse(F.transform(ev, lambda x: F.when(x["own"] == 0, x["start"]).otherwise(far))), F.least))
        around = F.arrays_zip(ev.alias("x"), before.alias("before"), after.alias("after"))
        free = F.filter(around, lambda a: (a["x"]["own"] == 1) & (a["before"] <= a["x"]["start"]) & (a["after"] >= a["x"]["end"]))
        return F.transform(free, lambda a: F.struct(a["x"]["start"].alias("start"), a["x"]["end"].alias("end"), a["x"]["what"].alias("what")))

    return F.when((F.size(base) > 0) & (F.size(candidates) > 0), _let(events, over)).otherwise(candidates)


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, spans array<struct<start, kind_no, end, kind>> in order, base_spans likewise; and the columns named in ``keep``."""
    a = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.struct(F.lit(0).alias("_none"), *[F.col(c).alias(c) for c in keep]).alias("_keep"))
    text = F.col("_text")
    for kind, pattern, group, _ in BASE:
        a = a.withColumns({f"_{kind}_0": F.regexp_extract_all(text, F.lit(pattern), F.lit(0))} | ({f"_{kind}_m": F.regexp_extract_all(text, F.lit(pattern), F.lit(group))} if group else {}))
    a = a.withColumns({f"_random_{i}": F.regexp_extract_all(text, F.lit(x), F.lit(0)) for i, x in enumerate(CANDIDATES)})
    a = a.withColumns({f"_{kind}": _spans(text, F.col(f"_{kind}_0"), F.col(f"_{kind}_m" if group else f"_{kind}_0"), pattern, least) for kind, pattern, group, least in BASE} | {f"_run_{i}": _spans(text, F.col(f"_random_{i}"), F.col(f"_random_{i}"), x, 0) for i, x in enumerate(CANDIDATES)})
    a = a.withColumn("_candidates", F.array_distinct(F.concat("_run_0", *[F.filter(f"_run_{i}", lambda c: F.regexp_like(c["what"], F.lit("[0-9A-Z]"))) for i in range(1, len(CANDIDATES))])))
    kinds = [k for k, *_ in BASE] + [RANDOM]
    named = lambda c, kind: F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.lit(kinds.index(kind)).alias("kind_no"), x["end"].alias("end"), F.lit(kind).alias("kind")))
    a = a.withColumn("base_spans", F.sort_array(F.concat(*[named(F.col(f"_{k}"), k) for k, *_ in BASE])))
    a = a.select("_id", "_text", "_keep", "base_spans", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k, *_ in BASE], _apart(F.col("_candidates"), F.col("base_spans")).alias("_free"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    a = a.withColumn("_random", F.when(F.size("_free") > 0, _merged(_discoveries(_tested(F.col("_free"))))).otherwise(none))
    return a.select(F.col("_id").alias(id_col), "_text", "_keep", *[f"n_{k}" for k, *_ in BASE], F.size("_random").cast("long").alias("n_random"), "base_spans", F.sort_array(F.concat("base_spans", named(F.col("_random"), RANDOM))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    return found(docs, id_col, text_col).select(id_col, *[f"n_{k}" for k, *_ in BASE], F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_random")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of the text (overlapping ones as one) replaced by MASK; all rows stay; a null text stays null."""
    others = [c for c in docs.columns if c != id_col]
    a = found(docs, id_col, text_col, keep=tuple(others))
    a = a.withColumns({"_merged": F.when(F.size("spans") > 0, _merged(F.col("spans"))), "_parts": F.when(F.size("spans") > 0, F.regexp_extract_all("_text", F.lit(rf"(?s).{{1,{PART}}}"), F.lit(0)))})

    def between(parts: Column, begin: Column, end: Column) -> Column:
        """Characters of the text, from its parts, so that no piece costs more than its own length and two parts."""
        p, q = F.floor(begin / PART).cast("int"), F.floor(end / PART).cast("int")
        of = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
        ahead = F.substring(of(p), begin - p * PART + 1, F.lit(PART))
        return F.when(p == q, F.substring(of(p), begin - p * PART + 1, end - begin)).otherwise(F.concat(ahead, F.array_join(F.slice(parts, p + 2, q - p - 1), ""), F.substring(of(q), F.lit(1), end - q * PART)))

    def masked(merged: Column, parts: Column) -> Column:
        ahead = F.transform(merged, lambda x, i: F.concat(between(parts, F.coalesce(F.get(merged, i - 1)["end"], F.lit(0)), x["start"]), F.lit(MASK)))
        return F.concat(F.array_join(ahead, ""), between(parts, F.element_at(merged, -1)["end"], F.length("_text")))

    once = _let(F.struct(F.col("_merged").alias("m"), F.col("_parts").alias("p")), lambda x: masked(x["m"], x["p"]))
    new = F.when(F.size("spans") > 0, once).otherwise(F.col("_keep")[text_col])
    return a.select(*[F.col(id_col) if c == id_col else (new if c == text_col else F.col("_keep")[c]).alias(c) for c in docs.columns])
