"""Near duplicates by a chosen-path set similarity join.

A text is the set of its word shingles. Equal sets are one class (a 63-bit number). In each of ``TREES`` independent
trees, a node's documents are branched by the token that a minwise function of that node's level
selects (and now and then by a second one, so that about 1 / threshold children are expected of every
similar pair). Nodes of at most ``NODE`` documents are compared exhaustively on sketches; a larger one
first loses, against a pivot, the documents that certainly lie together (by the triangle inequality
of Jaccard distance nobody else can link to them), the others branch on. What survives the loose
comparison are components that hold every true link with the probability of the trees' recall;
within them links are confirmed on full sets. Large components are confirmed against a center first,
then only what the center doesn't link is compared, in blocks, with all of the component. Links that
would join what is joined already are not looked for, so a group of copies costs no pairs.

Recall: a pair of similarity s shares a node of depth d with about s^d x (1 / threshold)^(d - 1)
expected nodes a tree; nodes of everyday texts end at depth 1 (miss 0.15^16 at 0.85).

Defined cases: null and wordless texts have empty sets and link with nothing; with fewer words than
a shingle, the whole sequence is the one element; texts of any length are whole sets; repeated rows
and equal ids are rows of their own, joined if their sets are alike; a null id counts as the largest;
an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import Scratch, mix, ragged, released, slice_hashes, stored, task_count, texts_in, window_hashes, words_of
from nodeloom.llm.components import components

TREES, DEPTH = 16, 6
#: Nodes up to so many classes are compared exhaustively, on sketches; blocks up to so many on full sets.
NODE, BLOCK = 1000, 200
BINS = 128
#: Rows of nodes, of classes with their sketches, and of texts for each task.
TASK_ROWS, TASK_CLASSES, TASK_TEXTS = 100_000, 20_000, 2_000
_NULL = np.iinfo(np.int64).max
_SALTS = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit codes of the text's shingles; A-Z in lower case."""
    data = np.frombuffer(text.lower(), np.uint8)
    codes = slice_hashes(data, *words_of(data))
    if not len(codes):
        return codes
    return np.unique(window_hashes(codes, min(width, len(codes))))


def class_of(codes: np.ndarray) -> int:
    """A 63-bit number of the set."""
    return int.from_bytes(hashlib.blake2b(codes.tobytes(), digest_size=8).digest()) >> 1


def sketch(codes: np.ndarray) -> bytes:
    """One byte of the least code in each of BINS bins; 0 where a bin is empty."""
    out = np.zeros(BINS, np.uint8)
    bins = (codes >> np.uint64(57)).astype(np.int64)
    at, first = np.unique(bins, return_index=True)
    out[at] = (codes[first] % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def minwise(codes: np.ndarray) -> bytes:
    """For each tree and level the selected token, as 32 bits."""
    out = np.full(len(_SALTS), np.iinfo(np.uint64).max)
    for at in range(0, len(codes), 2048):
        out = np.minimum(out, (codes[None, at : at + 2048] * _SALTS[:, None]).min(1))
    return mix(out).astype(np.uint32).tobytes()


def _alike(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of sketches (last axis), and the least estimate that a pair at the threshold has but for five deviations."""
    some = ((a > 0) | (b > 0)).sum(-1)
    equal = ((a == b) & (a > 0)).sum(-1)
    n = np.maximum(some, 1)
    return equal / n, threshold - 5 * np.sqrt(threshold * (1 - threshold) / n)


def _stars(near: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) of the components of a boolean matrix."""
    todo, out = np.ones(len(near), bool), []
    for i in range(len(near)):
        if todo[i]:
            todo[i] = False
            front = np.array([i])
            while len(front):
                reached = np.flatnonzero(near[front].any(0) & todo)
                todo[reached] = False
                out += [(i, j) for j in reached.tolist()]
                front = reached
    return out


def _digest(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def features(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (the id), digest (of the text, which tells rows of one id apart), n, cls (the set's class), sketch, mins of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text in texts_in(batch, text_col):
                codes = shingles(text, width)
                rows.append((len(codes), class_of(codes), sketch(codes), minwise(codes)) if len(codes) else (0, None, None, None))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("_digest"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc", "digest", "n", "cls", "sketch", "mins"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col, _digest(text_col).alias("_digest")).mapInArrow(lambda batches: released(run(batches)), "doc long, digest long, n long, cls long, sketch binary, mins binary")


def _branch(node: np.ndarray, tree: np.ndarray, cls: np.ndarray, mins: np.ndarray, row: np.ndarray, level: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The children's node, tree and class: one for the level's token, in some nodes a second."""
    extra = int((1 / threshold - 1) * 1000)
    node, mins = node.astype(np.int64).view(np.uint64), mins.astype(np.uint64)
    # Levels beyond DEPTH take the functions of other trees, which this path hasn't used.
    own, second = (tree + level // DEPTH) % TREES, (tree + TREES // 2 + level // DEPTH) % TREES
    one = mix(node ^ mix(mins[row, own, level % DEPTH] + np.uint64(1 << 40)))
    more = np.flatnonzero(mix(node + np.uint64(5)) % np.uint64(1000) < extra)
    other = mix(node[more] ^ mix(mins[row[more], second[more], level % DEPTH] + np.uint64(1 << 41)))
    return np.concatenate([one, other]).view(np.int64), np.concatenate([tree, tree[more]]), np.concatenate([cls, cls[more]])


def _top(reps: DataFrame, threshold: float) -> DataFrame:
    """node, tree, cls: each class below the roots of all trees."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            mins = np.frombuffer(b"".join(batch.column("mins").to_pylist()), np.uint32).reshape(-1, TREES, DEPTH)
            tree = np.tile(np.arange(TREES), n)
            root = mix(tree.astype(np.uint64) + np.uint64(77)).view(np.int64)
            node, tree, cls = _branch(root, tree, np.repeat(batch.column("cls").to_numpy(zero_copy_only=False), TREES), mins, np.repeat(np.arange(n), TREES), 0, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(tree.astype(np.int32)), pa.array(cls)], ["node", "tree", "cls"])

    return reps.select("cls", "mins").mapInArrow(run, "node long, tree int, cls long")


def _in_groups(df: DataFrame, by: str, names: list[str], work, schema: str, parts: int | None = None) -> DataFrame:
    """Rows dealt and sorted by a column; work gets the columns of one group after another, as lists, and yields tuples."""
    fields = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        def put(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], fields)

        now, group, out = None, [], []
        for batch in batches:
            for k, *row in zip(*[batch.column(i).to_pylist() for i in range(1 + len(names))], strict=True):
                if k != now:
                    if group:
                        out += work(now, group)
                    now, group = k, []
                group.append(row)
            if len(out) > 10_000:
                yield put(out)
                out = []
        if group:
            out += work(now, group)
        if out:
            yield put(out)

    dealt = df.select(by, *names).repartition(by)
    return (dealt.coalesce(parts) if parts else dealt).sortWithinPartitions(by).mapInArrow(lambda batches: released(run(batches)), schema)


def _exhaustive(threshold: float):
    def work(_, group):
        if len(group) < 2:
            return []
        classes = [g[0] for g in group]
        s = np.frombuffer(b"".join(g[1] for g in group), np.uint8).reshape(-1, BINS)
        near = np.empty((len(s), len(s)), bool)
        for at in range(0, len(s), 32):
            got, least = _alike(s[at : at + 32, None], s[None], threshold)
            near[at : at + 32] = got >= least
        return [(classes[i], classes[j]) for i, j in _stars(near)]

    return work


def _peel(rows: DataFrame, level: int, threshold: float) -> DataFrame:
    """From node, tree, cls, sketch, mins, pivot, pivot_sketch: rows with a null pivot are the next level's (node, tree, cls), the others links (cls, pivot)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sketch", "pivot_sketch"))
            node, tree, cls, pivot = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "tree", "cls", "pivot"))
            got, _ = _alike(a, b, threshold)
            slack = 2.5 * np.sqrt(0.25 / np.maximum(((a > 0) | (b > 0)).sum(-1), 1))
            far = 1 - threshold  # the distance of a link
            # Whoever is more alike than 1 - 2 far can only link to what is more alike than 1 - 3 far.
            near = np.flatnonzero((got >= 1 - 3 * far - slack) & (cls != pivot))
            stays = np.flatnonzero((got < 1 - 2 * far + slack) & (cls != pivot))
            if level < TREES // 2 * DEPTH:
                mins = np.frombuffer(b"".join(batch.column("mins").take(pa.array(stays)).to_pylist()), np.uint32).reshape(-1, TREES, DEPTH)
                down = _branch(node[stays], tree[stays], cls[stays], mins, np.arange(len(stays)), level, threshold)
            else:  # no function is left: the node goes on without the pivot's surroundings until it is small
                down = node[stays], tree[stays], cls[stays]
            none = np.zeros(len(near), np.int64)
            columns = [np.concatenate([x.astype(np.int64), y]) for x, y in zip(down, (none, none, cls[near]), strict=True)]
            links = pa.array(np.concatenate([np.zeros(len(down[2]), np.int64), pivot[near]]), mask=np.arange(len(columns[2])) < len(down[2]))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), pa.array(columns[2]), links], ["node", "tree", "cls", "pivot"])

    return rows.select("node", "tree", "cls", "sketch", "mins", "pivot", "pivot_sketch").mapInArrow(run, "node long, tree int, cls long, pivot long")


def loose_links(reps: DataFrame, threshold: float) -> DataFrame:
    """u, v: links on sketches between classes that met in a node of a tree."""
    sketches, found, level = reps.select("cls", "sketch"), [], 0
    rows = stored(_top(reps, threshold), "nodes")
    while True:
        parts = task_count(rows.sparkSession, rows.count(), TASK_ROWS)  # deeper levels have few rows: no task for every shuffle partition
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min_by("cls", F.xxhash64("cls", "node")).alias("pivot")).filter("size > 1")
        sized = stored(rows.join(sizes, "node").coalesce(parts), "nodes")
        small = sized.filter(F.col("size") <= NODE).select("node", "cls").join(sketches, "cls")
        found.append(stored(_in_groups(small, "node", ["cls", "sketch"], _exhaustive(threshold), "u long, v long", parts), "loose"))
        large = sized.filter(F.col("size") > NODE)
        if large.isEmpty():
            break
        level += 1
        pivots = large.select("node", "pivot").distinct().join(sketches.select(F.col("cls").alias("pivot"), F.col("sketch").alias("pivot_sketch")), "pivot")
        full = large.select("node", "tree", "cls").join(pivots, "node").join(reps.select("cls", "sketch", "mins"), "cls")
        peeled = stored(_peel(full.coalesce(parts), level, threshold), "peeled")
        found.append(peeled.filter("pivot is not null").select(F.col("pivot").alias("u"), F.col("cls").alias("v")))
        rows = peeled.filter("pivot is null").select("node", "tree", "cls")
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


# Roles of a class in a block.
MEMBER, CENTER, LINKED, STRAY = range(4)


def _confirm(width: int, at_least: int):
    """Links of a block on full sets. Compared are all with all, or the center with all, or the strays with all; linked ones are joined already."""

    def work(_, group):
        ids, sets, roles, seen = [], [], [], set()
        for cls, role, text in sorted(group, key=lambda r: -r[1]):  # a stray may come twice, as the one that asks and as a member
            codes = shingles((text or "").encode(), width)
            if cls not in seen and class_of(codes) == cls:
                seen.add(cls)
                ids.append(cls)
                sets.append(codes)
                roles.append(role)
        g = len(ids)
        if g < 2:
            return []
        n = np.array([len(x) for x in sets])
        tokens, where = np.unique(np.concatenate(sets), return_inverse=True)
        posting, counts = np.repeat(np.arange(g), n)[np.argsort(where, kind="stable")], np.bincount(where, minlength=len(tokens))
        begins, ends = np.cumsum(counts) - counts, np.cumsum(n)
        roles, label = np.array(roles), np.arange(g)
        if (linked := np.flatnonzero(roles == LINKED)).size:
            label[linked] = linked[0]
        asks = np.flatnonzero((roles == STRAY) | (roles == CENTER))
        if not (roles != MEMBER).any():
            asks = np.arange(g)
        out = []
        for i in asks.tolist():
            others = label != label[i]
            if not others.any():
                continue
            mine = where[ends[i] - n[i] : ends[i]]
            both = np.bincount(posting[ragged(begins[mine], counts[mine])], minlength=g)
            for j in np.flatnonzero(others & (100 * both >= at_least * (n[i] + n - both))).tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    out.append((ids[i], ids[j]))
        return out

    return work


def links(docs: DataFrame, reps: DataFrame, width: int, at_least: int, id_col: str, text_col: str) -> DataFrame:
    """u, v: confirmed links between classes that join all that is linked. reps: cls, doc, digest, sketch, mins."""
    loose = components(loose_links(reps, at_least / 100))
    members = loose.select(F.col("u").alias("cls"), F.col("v").alias("comp")).union(loose.select("v", "v").distinct())
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    members = members.join(sizes, "comp").join(reps.select("cls", "doc", "digest"), "cls")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("doc"), _digest(text_col).alias("digest"), F.col(text_col).alias("text"))
    # Rows without an id may repeat a text any number of times; one of each is enough. (Of ids, each has few rows.)
    nameless = texts.filter(F.col("doc") == _NULL).groupBy("doc", "digest").agg(F.any_value("text").alias("text"))
    texts = texts.filter(F.col("doc") != _NULL).union(nameless)
    members = stored(members.join(texts, ["doc", "digest"]).drop("doc", "digest"), "members")
    names = ["cls", "role", "text"]
    parts = task_count(docs.sparkSession, members.count(), TASK_TEXTS)
    confirm = lambda df: stored(_in_groups(df, "unit", names, _confirm(width, at_least), "u long, v long", parts), "confirmed")
    found = confirm(members.filter(F.col("size") <= BLOCK).select(F.xxhash64("comp").alias("unit"), "cls", F.lit(MEMBER).alias("role"), "text"))
    large = members.filter(F.col("size") > BLOCK)
    if large.isEmpty():
        return found
    # The center has, in most bins, the byte that most of its component have.
    bins = large.select("comp", "cls").join(reps.select("cls", F.hex("sketch").alias("hex")), "cls")
    bins = bins.select("comp", "cls", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"), "hex").select("comp", "cls", "bin", F.substring("hex", F.col("bin") * 2 + 1, F.lit(2)).alias("byte")).filter("byte != '00'")
    votes = bins.groupBy("comp", "bin", "byte").agg(F.count(F.lit(1)).alias("votes"))
    most = votes.groupBy("comp", "bin").agg(F.max_by("byte", F.struct("votes", "byte")).alias("byte"))
    scores = bins.join(most, ["comp", "bin", "byte"]).groupBy("comp", "cls").agg(F.count(F.lit(1)).alias("score"))
    centers = stored(scores.groupBy("comp").agg(F.max_by("cls", F.struct("score", "cls")).alias("center")), "centers")
    centered = large.join(centers, "comp")
    part = lambda salt, n: F.pmod(F.xxhash64("cls", F.lit(salt)), n).cast("int")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    around = centered.filter("cls != center").select("comp", part(1, blocks).alias("b"), "cls", F.lit(MEMBER).alias("role"), "text")
    middle = centered.filter("cls = center").select("comp", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("b"), "cls", F.lit(CENTER).alias("role"), "text")
    star = confirm(around.union(middle).select(F.xxhash64("comp", "b").alias("unit"), *names))
    linked = star.select(F.col("v").alias("cls"), F.lit(True).alias("is_linked")).distinct()
    role = F.when(F.col("is_linked") | (F.col("cls") == F.col("center")), LINKED).otherwise(STRAY)
    state = stored(centered.join(linked, "cls", "left").select("comp", "cls", "text", "size", F.coalesce(role, F.lit(STRAY)).alias("role")), "state")
    strays = state.filter(F.col("role") == STRAY).groupBy("comp").agg(F.count(F.lit(1)).alias("strays"))
    both = state.join(strays, "comp")
    rows = F.ceil(F.col("strays") / BLOCK).cast("int")
    # Every block of strays meets every block of the component.
    asked = both.filter(F.col("role") == STRAY).select("comp", part(2, rows).alias("a"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("b"), *names[:1], "role", "text")
    others = both.select("comp", F.explode(F.sequence(F.lit(0), rows - 1)).alias("a"), part(3, blocks).alias("b"), "cls", F.when(F.col("role") == STRAY, MEMBER).otherwise(F.col("role")).alias("role"), "text")
    return found.union(star).union(confirm(asked.union(others).select(F.xxhash64("comp", "a", "b").alias("unit"), *names)))


def _judged(docs: DataFrame, width: int, at_least: int, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """id, doc, n, cls of every row; cls, root (a number of its component), and doc and digest of the class's first row, which has the least of both."""
    spark = docs.sparkSession
    full = stored(features(docs, width, id_col, text_col).withColumns({"id": F.col("doc"), "doc": F.coalesce("doc", F.lit(_NULL))}), "features")
    first = stored(full.filter("n > 0").groupBy("cls").agg(F.min(F.struct("doc", "digest")).alias("x")).select("cls", "x.doc", "x.digest"), "classes")
    reps = stored(full.filter("n > 0").select("cls", "doc", "digest", "sketch", "mins").join(first, ["cls", "doc", "digest"]).dropDuplicates(["cls"]).coalesce(task_count(spark, first.count(), TASK_CLASSES)), "reps")
    rows = stored(full.select("id", "doc", "n", "cls"), "rows")
    scratch.drop(full)
    joined = components(links(docs, reps, width, at_least, id_col, text_col))
    return rows, first.join(joined.withColumnRenamed("u", "cls"), "cls", "left").select("cls", "doc", "digest", F.coalesce("v", "cls").alias("root"))


def grouped(docs: DataFrame, width: int = 5, at_least: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the least id of those that links of at least ``at_least`` % reach), kept, for every row."""
    with Scratch(docs.sparkSession) as scratch:
        rows, roots = _judged(docs, width, at_least, id_col, text_col, scratch)
        least = roots.groupBy("root").agg(F.min("doc").alias("component"))
        of_class = stored(roots.join(least, "root").select("cls", "component"), "components")
        scratch.keep(rows, of_class)
    sets = rows.filter("n > 0")
    some = sets.join(of_class, "cls").select("id", "doc", "n", "component")
    out = some.union(rows.filter("n = 0").select("id", "doc", "n", F.col("doc").alias("component")))
    component = F.when(F.col("component") != _NULL, F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, at_least: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, all their columns: that of the least id, and of several texts of this id the one of the least digest.

    Rows are told apart by id and digest; rows that are alike in both have one set and thus one component.
    Wordless rows link with nothing, so all stay.
    """
    with Scratch(docs.sparkSession) as scratch:
        _, roots = _judged(docs, width, at_least, id_col, text_col, scratch)
        chosen = stored(roots.groupBy("root").agg(F.min(F.struct("doc", "digest")).alias("x")).select("x.doc", "x.digest"), "chosen")
        scratch.keep(chosen)
    wordless = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keys = {"_doc": F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)), "_digest": _digest(text_col)}
    rows = docs.filter(~wordless).withColumns(keys).dropDuplicates(["_doc", "_digest"])
    left = rows.join(chosen.toDF("_doc", "_digest"), ["_doc", "_digest"], "left_semi")
    return left.select(*docs.columns).union(docs.filter(wordless))
