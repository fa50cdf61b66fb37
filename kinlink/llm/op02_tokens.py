r"""Token counts of documents in flat token files by a separator scan.

A flat file holds 16-bit little-endian token ids of document after document, each closed by the end-of-document
id, and nothing else: no index, no lengths. Files are cut in blocks of BLOCK tokens. A task searches one block at a
time for separators, as a vector operation. A block's first document may have begun earlier; a prefix scan over the
blocks of a file (running maximum of last separators, running sum of their number) gives each block the place of
the separator before it and the number of documents closed so far, which stitches the counts together.

An open document at a file's end counts if it has tokens. Empty documents have 0 tokens. Null texts are written as
empty documents, very long texts whole, repeated rows each for itself; extra columns are ignored. Files with an odd
number of bytes are an error. Empty tables and folders give empty results.

Files are written by Spark's own text writer, whose line separator is set to the two bytes of the end-of-document
id, so that any store that Spark writes will do; blocks are read by byte range through Arrow's file systems.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinlink.llm.common import bound_batches, fresh, spread, table, written

#: Tokens of a block, and the end-of-document id of the 50k vocabulary.
BLOCK, EOD = 1 << 21, 50256


@lru_cache(maxsize=2)
def coder(ranks_file: str, pattern: str):
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_flat(docs: DataFrame, ranks_file: str, pattern: str, path: str, eod: int = EOD) -> None:
    """Writes the texts of docs, in their order, as flat token files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(ranks_file, pattern).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.array(encode(t or ""), "<u2").tobytes() for t in b.column(0).to_pylist()], pa.binary())], names=["tokens"])

    bound_batches(docs.sparkSession)
    close = int(eod).to_bytes(2, "little").decode("latin-1")
    flat = spread(docs, "text").mapInArrow(run, "tokens binary").select(F.col("tokens").cast("string").alias("value"))
    flat.write.option("lineSep", close).option("encoding", "ISO-8859-1").text(path)


def separators(spark: SparkSession, path: str, block: int = BLOCK, eod: int = EOD) -> DataFrame:
    """file, block, tokens (in the block) and ends, the places of separators in the file."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # content is not read
    blocks = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / (2 * block)))).alias("block"))
    blocks = blocks.repartition("path", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for name, length, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if length % 2:
                    raise ValueError(f"{name} has half a token")
                store, at = fs.FileSystem.from_uri(name if "://" in name else name.replace("file:", "file://", 1))
                with store.open_input_file(at) as f:
                    data = f.read_at(min(2 * block, length - 2 * block * k), 2 * block * k)
                ids = np.frombuffer(data, "<u2")
                ends = np.flatnonzero(ids == eod) + block * k
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], names=["file", "block", "tokens", "ends"])

    return blocks.mapInArrow(run, "file string, block long, tokens long, ends array<long>")


def counts(spark: SparkSession, path: str, block: int = BLOCK, eod: int = EOD) -> DataFrame:
    """file, ordinal (from 0 in the file), start (place of the first token), n_tokens."""
    found = written(separators(spark, path, block, eod), "separators")
    narrow = found.select("file", "block", "tokens", F.size("ends").alias("many"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    scan = narrow.select(
        "file", "block",
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("prior"),
        F.coalesce(F.sum("many").over(before), F.lit(0)).alias("closed"),
        (F.lead("block").over(order).isNull()).alias("final"),
        (F.sum("tokens").over(order)).alias("upto"),
    )
    both = found.join(scan, ["file", "block"])
    open_end = F.when(F.col("final") & (F.coalesce(F.try_element_at("ends", F.lit(-1)), F.col("prior")) + 1 < F.col("upto")), F.array("upto")).otherwise(F.array().cast("array<long>"))
    both = both.withColumn("ends", F.concat("ends", open_end)).withColumn("starts", F.transform(F.concat(F.array("prior"), "ends"), lambda x: x + 1))
    one = both.select("file", "closed", F.posexplode(F.arrays_zip(F.slice("starts", 1, F.size("ends")).alias("start"), F.col("ends").alias("end"))).alias("k", "at"))
    return one.select("file", (F.col("closed") + F.col("k")).alias("ordinal"), F.col("at.start").alias("start"), (F.col("at.end") - F.col("at.start")).alias("n_tokens"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh(spark, "flat")
    write_flat(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, path)
    shard = F.regexp_extract("file", r"part-([0-9]+)", 1).cast("int").alias("shard")
    return counts(spark, path).select(shard, "ordinal", "start", "n_tokens")
