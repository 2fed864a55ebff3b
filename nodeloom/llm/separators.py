"""Token counts of flat token files that have no index, by a scan for end-of-document identifiers.

A file is cut into ranges of bytes, which tasks read by themselves, block by block, wherever the cuts
fall in documents. Each block is searched with one vectorised comparison; what it finds is a row: how
many separators, and the lengths of the pieces between them. A prefix scan over the blocks' separator
counts, of runs of blocks first and then within each run, numbers the documents, and pieces that
block edges cut are added up by number. A document of any length so costs one number a block, a file
of any size no more than a block in memory. Files may lie wherever pyarrow has a file system for.

Defined cases: texts that are null or empty are documents of 0 tokens; what follows the last
separator is a document only if it has tokens, then ``terminated`` is false; empty folders and files
yield nothing; a file whose size is no multiple of the token width is an error; rows of one id are
documents of their own; other columns are not read.
"""

from __future__ import annotations

import bisect
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodeloom.llm import bpe
from nodeloom.llm.common import Scratch, delete, shared_dir, stored, task_count, texts_in

#: Bytes of a block, and of a range that is read as one; multiples of every token width.
BLOCK, RANGE = 1 << 20, 1 << 26
#: Ranges for each task, and blocks whose counts are summed before the prefix scan.
TASK_RANGES, RUN = 8, 1 << 12
#: The first free id of the vocabulary in use.
END = 50256


def _file_system(path: str):
    """The file system of a path as Spark writes it, and the path within."""
    from pyarrow import fs

    if local := re.match(r"(?:file:/*)?(?=/)|file:/+", path):
        return fs.LocalFileSystem(), "/" + path[local.end() :].lstrip("/")
    return fs.FileSystem.from_uri(path)


def searched(spark: SparkSession, path: str, end: int = END, dtype: str = "<u2", block: int = BLOCK, span: int = RANGE) -> DataFrame:
    """file, block, found (separators), pieces (their lengths in tokens, one more than found) of all blocks of flat files."""
    width = np.dtype(dtype).itemsize
    assert block % width == 0 and span % block == 0

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for file, at, length in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if length % width:
                    raise ValueError(f"{file} has {length} bytes, no multiple of {width}")
                system, name = _file_system(file)
                with system.open_input_file(name) as f:
                    for start in range(at, min(at + span, length), block):
                        size = min(block, length - start)
                        data = f.read_at(size, start)
                        if len(data) != size:
                            raise OSError(f"{file} ends at {start + len(data)} of {length} bytes")
                        data = np.frombuffer(data, dtype)
                        found = np.flatnonzero(data == end)
                        pieces = np.diff(found, prepend=-1, append=len(data)) - 1
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start // block], pa.int64()), pa.array([len(found)], pa.int64()), pa.array([pieces], pa.list_(pa.int64()))], ["file", "block", "found", "pieces"])

    files = spark.read.format("binaryFile").load(path).select("path", "length")  # contents aren't read
    ranges = files.agg(F.sum(F.ceil(F.col("length") / span))).first()[0] or 0
    rows = files.filter("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(span).cast("long"))).alias("at"), "length")
    dealt = rows.repartition(task_count(spark, int(ranges), TASK_RANGES), "path", "at")
    return dealt.mapInArrow(run, "file string, block long, found long, pieces array<bigint>")


def written(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block: int = BLOCK) -> DataFrame:
    """The texts as flat files of 16-bit ids in the folder, one for each task. Rows: file (its name), block, ids (of the documents whose separators are in the block).

    Every attempt at a task writes a file of its own; only those that the rows name count.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        e, file = bpe.encoder(path or bpe.default_path()), f"{task.partitionId()}-{task.taskAttemptId()}.bin"
        system, name = _file_system(f"{folder}/{file}")
        k, ids, ends, size = 0, [], [], 0
        with system.open_output_stream(name) as out:
            for batch in batches:
                texts, own = texts_in(batch, text_col), batch.column(id_col).to_pylist()
                for a, b in bpe.groups(texts):
                    for i, tokens in zip(own[a:b], e.encode(texts[a:b]), strict=True):
                        out.write(np.append(tokens, END).astype("<u2").tobytes())
                        size += 2 * (len(tokens) + 1)
                        ids.append(i)
                        ends.append(size)
                    while (k + 1) * block <= size:
                        n = bisect.bisect_right(ends, (k + 1) * block)
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k], pa.int64()), pa.array([ids[:n]], pa.list_(pa.int64()))], ["file", "block", "ids"])
                        ids, ends, k = ids[n:], ends[n:], k + 1
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], ["file", "block", "ids"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, "file string, block long, ids array<bigint>")


def documents(blocks: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """file, number (from 0), n_tokens, terminated, id (null without ids) of every document. blocks: of ``searched``; ids: of ``written``, other files are left out."""
    with Scratch(blocks.sparkSession) as scratch:
        found = stored(blocks, "separators")
        scratch.keep(found)
    counts = found.select("file", "block", F.floor(F.col("block") / RUN).alias("run"), "found")
    before = lambda by, of: F.coalesce(F.sum("found").over(Window.partitionBy(by).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = counts.groupBy("file", "run").agg(F.sum("found").alias("found")).select("file", "run", before(["file"], "run").alias("start"))
    firsts = counts.withColumn("within", before(["file", "run"], "block")).join(runs, ["file", "run"]).select("file", "block", (F.col("start") + F.col("within")).alias("first"))
    pieces = found.join(firsts, ["file", "block"])
    if ids is None:
        pieces = pieces.withColumn("ids", F.lit(None).cast("array<bigint>"))
    else:
        pieces = pieces.withColumn("file", F.substring_index("file", "/", -1)).join(ids, ["file", "block"])
    pieces = pieces.select("file", "first", "found", "ids", F.posexplode("pieces").alias("i", "n"))
    ended = F.col("i") < F.col("found")
    rows = pieces.select("file", (F.col("first") + F.col("i")).alias("number"), F.col("n"), ended.alias("ended"), F.when(ended, F.get("ids", F.col("i"))).alias("id"), ((F.col("i") > 0) & ended).alias("whole"))
    columns = ["file", "number", "n_tokens", "terminated", "id"]
    whole = rows.filter("whole").select("file", "number", F.col("n").alias("n_tokens"), F.lit(True).alias("terminated"), "id")
    cut = rows.filter("not whole").groupBy("file", "number").agg(F.sum("n").alias("n_tokens"), F.max("ended").alias("terminated"), F.max("id").alias("id"))
    return whole.select(columns).union(cut.filter("terminated or n_tokens > 0").select(columns))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block: int = BLOCK, span: int = RANGE) -> DataFrame:
    """``documents`` of the texts, which are written as flat files to the shared folder, scanned there and deleted."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/flat-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    with Scratch(spark) as scratch:
        try:
            ids = stored(written(docs, folder, id_col, text_col, path, block), "flat-ids")
            out = documents(searched(spark, folder, block=block, span=span), ids)
        finally:
            delete(spark, folder)
        scratch.keep(ids)
    return out
