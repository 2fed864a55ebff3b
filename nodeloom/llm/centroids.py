"""Language identification by the nearest centroid.

A text becomes counts of hashed letter n-grams (1 to 3, within words, case folded), weighted by
inverse document frequency and scaled to length 1. For each language several centroids are fitted by
spherical k-means; a text gets the language of the centroid with the largest cosine. A text whose
distance is beyond what nearly all learning texts of that language had is rejected.

Fitting uses at most ``SAMPLE`` whole texts a language (a documented bound), counted on the
executors, so that the driver gets at most languages x SAMPLE x DIMENSIONS numbers; prediction reads
every whole text. Model: dimensions x languages x centroids numbers, about 1 MB.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected; texts of
any length are counted in blocks; ties go to the first language in order of name; repeated rows get
equal results; with nothing to learn from, all is ``und``; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import mix, released

DIMENSIONS = 1 << 13
CENTROIDS = 4
SAMPLE = 500
#: A text is rejected if its cosine is under this part of the one that 99.5 % of the learning texts reach.
SLACK = 0.35
UND = "und"
_BLOCK = 1 << 20


@lru_cache(1)
def _folded() -> np.ndarray:
    """For each codepoint: its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and counts of the text's n-grams; empty if it has no letter."""
    total = None
    for at in range(0, len(text), _BLOCK):
        cp = _folded()[np.frombuffer(text[max(0, at - 2) : at + _BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
        skip = min(at, 2)  # n-grams that end before the block were counted with the last one
        cp = np.concatenate([cp, np.zeros(1, np.uint64)]) if at + _BLOCK >= len(text) else cp
        a, b, c = cp[2:], cp[1:-1], cp[:-2]
        one = cp[skip:]
        grams = [one[one > 0]]
        two = (cp[:-1] << np.uint64(21) | cp[1:] | np.uint64(1 << 62))[max(0, skip - 1) :]
        edge = (cp[:-1] > 0) | (cp[1:] > 0)
        grams.append(two[edge[max(0, skip - 1) :]])
        three = c << np.uint64(42) | b << np.uint64(21) | a
        grams.append(three[(b > 0) & ((a > 0) | (c > 0))])
        dims = (mix(np.concatenate(grams)) >> np.uint64(64 - DIMENSIONS.bit_length() + 1)).astype(np.int64)
        part = np.bincount(dims, minlength=DIMENSIONS) if len(dims) else np.zeros(DIMENSIONS, np.int64)
        total = part if total is None else total + part
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    least: np.ndarray

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = np.log1p(n) * self.idf[at]
        size = np.sqrt((v * v).sum())
        return (v / size if size else v).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, and whether it is rejected."""
        at, n = counts(text or "")
        if not len(self.languages) or not len(at):
            return UND, 0.0, True
        scores = self.centroids[:, at] @ self.vector(at, n)
        best = int(scores.argmax())
        language = int(self.owner[best])
        score = float(min(1.0, max(0.0, scores[best])))
        return self.languages[language], score, score < self.least[language]


def fit(pairs: list[tuple[str, str]], centroids: int = CENTROIDS) -> Model:
    """From (language, text) pairs; deterministic."""
    return fit_counts([(lang, *counts(text)) for lang, text in pairs], centroids)


def fit_counts(sparse: list[tuple[str, np.ndarray, np.ndarray]], centroids: int = CENTROIDS) -> Model:
    """From languages with dimensions and counts."""
    sparse = [x for x in sparse if len(x[1])]
    seen = np.zeros(DIMENSIONS)
    for _, at, _ in sparse:
        seen[at] += 1
    idf = np.log((1 + len(sparse)) / (1 + seen)) + 0.05
    model = Model(idf, sorted({x[0] for x in sparse}), np.zeros(0, np.int64), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0))
    owners, rows, least = [], [], []
    for k, lang in enumerate(model.languages):
        x = np.zeros((sum(s[0] == lang for s in sparse), DIMENSIONS), np.float32)
        for i, (_, at, n) in enumerate(s for s in sparse if s[0] == lang):
            x[i, at] = model.vector(at, n)
        picks = [0]  # farthest-first starts
        while len(picks) < min(centroids, len(x)):
            picks.append(int((x @ x[picks].T).max(1).argmin()))
        c = x[picks]
        for _ in range(8):
            near = (x @ c.T).argmax(1)
            c = np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        owners += [k] * len(c)
        rows.append(c)
        least.append(SLACK * float(np.quantile((x @ c.T).max(1), 0.005)))
    if rows:
        model.owner, model.centroids, model.least = np.array(owners), np.concatenate(rows).astype(np.float32), np.array(least)
    return model


def held_out(id_column: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.encode(id_column.cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fits from a bounded sample: for each language the ``sample`` texts of the smallest hash of their ids, distinct ones."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    counted = rows.groupBy("lang").count().collect()  # as many rows as languages

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            got = [counts(x) for x in batch.column("text").to_pylist()]
            blobs = [pa.array([x[i].astype("<i4").tobytes() for x in got], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), *blobs], ["lang", "dims", "n"])

    sparse = []
    for lang, n in sorted((r["lang"], r["count"]) for r in counted):
        # A little over the sample by a hash of the id, then the smallest hashes: no sort of a whole language.
        limit = min(1.0, (1.5 * sample + 50) / n)
        part = rows.filter((F.col("lang") == lang) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(limit * (1 << 30))))
        part = part.orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)), "id", "text").limit(sample)
        sparse += [(lang, np.frombuffer(r.dims, "<i4"), np.frombuffer(r.n, "<i4")) for r in part.select("lang", "text").mapInArrow(count, "lang string, dims binary, n binary").collect()]
    return fit_counts(sparse)


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, lang_pred, score, rejected of every whole text; and the columns named in ``keep``."""
    names = list(dict.fromkeys((id_col, text_col, *keep)))
    out = list(dict.fromkeys((id_col, *keep)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [shared.value.predict(x) for x in batch.column(text_col).to_pylist()]
            lang, score, rejected = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*out, "lang_pred", "score", "rejected"])

    schema = docs.select(*[F.col(c) for c in out]).schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")):
        schema = schema.add(name, kind)
    return docs.select(*names).mapInArrow(lambda batches: released(run(batches)), schema)
