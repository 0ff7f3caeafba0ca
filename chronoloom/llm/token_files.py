"""Token counts from flat token files: a vectorised scan for separators, stitched over blocks by a prefix scan.

A shard is a stream of 16-bit token ids, an end-of-document id after each document and no index. It is read in blocks
of fixed size; numpy finds the separators of a block at once. Documents that cross blocks are stitched by running sums over the
blocks of a shard: tokens so far, and the place of the last separator so far.

Defined results: a document without tokens counts 0. What follows the last separator of a shard is a document too if it has tokens
(its name is null). Null text has no tokens. Repeated rows are documents of their own. An empty table or file
gives no rows. A file of an odd number of bytes is an error.
"""

from __future__ import annotations

import base64
import functools
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary splits text before merging (its published pattern).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
BLOCK_TOKENS = 1 << 20
_BLOCK = "shard string, block long, tokens binary, names array<string>"


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tokenise(docs: DataFrame, path: str = TOKENIZER, pattern: str = PATTERN, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (shard, block, tokens, names) of token streams: one shard per partition of docs, cut regardless of documents.

    names lists the doc_ids, as text, of the documents whose separators the block holds."""

    def run(batches):
        coder, shard = encoding(path, pattern), f"part-{TaskContext.get().partitionId():05d}"
        pieces, held, names, block = [], 0, [], 0

        def cut(flush: bool):
            nonlocal pieces, held, names, block
            stream = np.concatenate(pieces) if pieces else np.zeros(0, np.uint16)
            at = 0
            while len(stream) - at >= block_tokens or (flush and at < len(stream)):
                part = stream[at : at + block_tokens]
                n = int((part == end).sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard]), pa.array([block], pa.int64()), pa.array([part.tobytes()], pa.binary()), pa.array([names[:n]], pa.list_(pa.string()))],
                    names=["shard", "block", "tokens", "names"],
                )
                names, block, at = names[n:], block + 1, at + block_tokens
            pieces = [stream[at:]]
            held = len(pieces[0])

        for batch in batches:
            for name, text in zip(batch.column("doc_id").cast(pa.string()).to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = coder.encode_ordinary(text) if text else []
                pieces.append(np.array([*ids, end], np.uint16))
                held += len(ids) + 1
                names.append(name)
                if held >= block_tokens:
                    yield from cut(False)
        yield from cut(True)

    return docs.select("doc_id", "text").transform(map_arrow, run, _BLOCK)


def read_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, partition_blocks: int = 32) -> DataFrame:
    """Blocks of the flat files at path, of any size: each task reads its ranges of bytes.

    Files in a store that only Spark's readers know are read whole, a file in a task, and must be below 2 GB."""
    listed = spark.read.format("binaryFile").load(path)
    first = listed.select("path").head()
    if first is None or not _seekable(first[0]):
        return _whole_files(listed, block_tokens)
    many = F.ceil(F.col("length") / (2 * block_tokens))
    blocks = listed.select("path", "length").where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0), many - 1)).alias("block"))
    n = max(1, -(-int(blocks.count()) // partition_blocks))

    def run(batches):
        for batch in batches:
            for name, length, k in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "block")), strict=True):
                if length % 2:
                    raise ValueError(f"{name}: {length} bytes are no 16-bit tokens")
                store, where = pafs.FileSystem.from_uri(name)
                with store.open_input_file(where) as f:
                    part = f.read_at(min(2 * block_tokens, length - 2 * block_tokens * k), 2 * block_tokens * k)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([part], pa.binary()), pa.array([None], pa.list_(pa.string()))], names=["shard", "block", "tokens", "names"])

    return blocks.repartition(n, "path", "block").transform(map_arrow, run, _BLOCK)


def _seekable(name: str) -> bool:
    try:
        pafs.FileSystem.from_uri(name)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def _whole_files(listed: DataFrame, block_tokens: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if len(content) % 2:
                    raise ValueError(f"{name}: {len(content)} bytes are no 16-bit tokens")
                for k, at in enumerate(range(0, len(content), 2 * block_tokens)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([k], pa.int64()), pa.array([content[at : at + 2 * block_tokens]], pa.binary()), pa.array([None], pa.list_(pa.string()))],
                        names=["shard", "block", "tokens", "names"],
                    )

    return listed.select("path", "content").transform(map_arrow, run, _BLOCK)


def _separators(end: int):
    """For mapInArrow: each block's size, places of its first and last separator, and the tokens between its separators."""

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            size, first, last, inner = [], [], [], []
            for b in batch.column("tokens"):
                at = np.flatnonzero(np.frombuffer(b.as_buffer(), np.uint16) == end)
                size.append(len(b.as_buffer()) // 2)
                first.append(int(at[0]) if len(at) else None)
                last.append(int(at[-1]) if len(at) else None)
                inner.append(np.diff(at) - 1)
            made = [pa.array(x, k) for x, k in zip((size, first, last, inner), kinds, strict=True)]
            keep = [batch.column(c) for c in ("shard", "block", "names")]
            yield pa.RecordBatch.from_arrays([*keep, *made], names=["shard", "block", "names", "size", "first_end", "last_end", "inner"])

    return run


def count_tokens(blocks: DataFrame, end: int = END) -> DataFrame:
    """shard, ordinal (of the document in its shard, from 0), name and n_tokens of each document in the blocks."""
    scanned = blocks.transform(map_arrow, _separators(end), "shard string, block long, names array<string>, size long, first_end long, last_end long, inner array<long>")
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ends = F.when(F.col("first_end").isNull(), F.lit(0)).otherwise(F.size("inner") + 1)
    # Prefix scan over the few rows of a shard's blocks; positions count from the start of the shard.
    placed = (
        scanned.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("_end", F.col("start") + F.col("last_end"))
        .withColumn("document_start", F.coalesce(F.max("_end").over(before) + 1, F.lit(0)))
        .withColumn("ordinal", F.coalesce(F.sum(ends).over(before), F.lit(0)))
    )
    first = F.array(F.col("start") + F.col("first_end") - F.col("document_start"))
    counts = F.when(F.col("first_end").isNotNull(), F.concat(first, "inner")).otherwise(F.array().cast("array<long>"))
    inside = placed.select("shard", "ordinal", "names", F.posexplode(counts).alias("k", "n_tokens")).select(
        "shard", (F.col("ordinal") + F.col("k")).alias("ordinal"), F.get("names", F.col("k")).alias("name"), "n_tokens"
    )
    rest = (
        placed.groupBy("shard")
        .agg(F.sum("size").alias("size"), F.max("_end").alias("_end"), F.sum(ends).alias("ordinal"))
        .select("shard", "ordinal", F.lit(None).cast("string").alias("name"), (F.col("size") - F.coalesce(F.col("_end") + 1, F.lit(0))).alias("n_tokens"))
        .where(F.col("n_tokens") > 0)
    )
    return inside.unionAll(rest)
