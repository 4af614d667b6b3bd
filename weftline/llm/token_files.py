"""Token ids of a corpus as entropy-coded blocks, written in the order of doc_id and read back.

Documents are dealt into ranges of ids, tokenized once into a table of chunks, and counted; the counts make the one
frequency table that all blocks share. Each chunk is then coded by ``rans`` into a row of the file with the pieces of
documents that it holds, so every row can be read without any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import text_of
from weftline.llm.rans import BLOCK, Table, crc32_combine, normalize
from weftline.llm.tokens import PieceCodec
from weftline.session import materialize

#: Room for the ids of any tokenizer of this library: two bytes.
VOCABULARY = 1 << 16
PIECES = "doc_ids array<long>, orders array<long>, lengths array<long>, totals array<long>"
CHUNKS = f"shard int, start long, n_ids long, {PIECES}, ids binary"
BLOCKS = f"shard int, start long, n_ids long, {PIECES}, payload binary"


def token_chunks(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Chunks of up to ``BLOCK`` ids by range of doc_id, of whole documents where these aren't longer than that.

    ``start`` counts the ids of the range before a chunk. Rows with equal doc_id are told apart by their ``order`` in
    the range; nulls come first.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, shard = PieceCodec.of(tokenizer_path), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        pieces: list[tuple] = []
        size = start = order = 0

        def row() -> pa.RecordBatch:
            nonlocal held, pieces, size, start
            ids = np.concatenate(held).astype("<u2").tobytes()
            arrays = [pa.array([list(own)], pa.list_(pa.int64())) for own in zip(*pieces, strict=True)]
            out = pa.record_batch([pa.array([shard], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), *arrays, pa.array([ids], pa.binary())], names)
            held, pieces, size, start = [], [], 0, start + size
            return out

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, ids, bounds in codec.ids_of(batch.column(1), end_id):
                for i in range(len(bounds) - 1):
                    at, stop = int(bounds[i]), int(bounds[i + 1])
                    total = stop - at
                    if size and size + total > BLOCK:
                        yield row()
                    while at < stop:
                        take = min(stop - at, BLOCK - size)
                        held.append(ids[at : at + take])
                        pieces.append((doc_ids[first + i], order, take, total))
                        size, at = size + take, at + take
                        if size == BLOCK:
                            yield row()
                    order += 1
        if size:
            yield row()

    names = [c.split()[0] for c in CHUNKS.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("string").alias("text"))
    tie = F.xxhash64("text")
    return rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie).mapInArrow(chunks, CHUNKS)


def id_counts(chunks: DataFrame) -> np.ndarray:
    """How often each id occurs in all chunks; at most one number per id of the vocabulary comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        PieceCodec.release()
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(ids.as_buffer(), "<u2"), minlength=VOCABULARY)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    out = np.zeros(VOCABULARY, np.int64)
    for r in chunks.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0) -> np.ndarray:
    """Write blocks to ``path`` and return the frequency table that reads them, which is also at ``path`` + "-table".

    A null text is an empty one: its ids are the end id alone. Repeated rows are written as often as they occur; an
    empty table gives files without rows. ``start`` of a block counts all ids before it.
    """
    spark = docs.sparkSession
    chunks = materialize(token_chunks(docs, tokenizer_path, end_id), "token-chunks")
    freq = normalize(id_counts(chunks))
    sizes = sorted((r["shard"], r["n"]) for r in chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    starts, before = {}, 0
    for shard, n in sizes:
        starts[shard], before = before, before + n
    bound = spark.sparkContext.broadcast((freq, starts))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        PieceCodec.release()
        table, at = Table(bound.value[0]), bound.value[1]
        for batch in batches:
            shards, within = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                payload = table.encode(np.frombuffer(batch.column(7)[i].as_buffer(), "<u2"))
                one = batch.slice(i, 1)
                yield pa.record_batch([one.column(0), pa.array([at[shards[i]] + within[i]], pa.int64()), *(one.column(k) for k in range(2, 7)), pa.array([payload], pa.binary())], names)

    names = [c.split()[0] for c in BLOCKS.split(", ")]
    # coded ids don't compress further
    chunks.mapInArrow(encode, BLOCKS).write.option("compression", "uncompressed").parquet(path)
    used = np.flatnonzero(freq)
    spark.createDataFrame(pa.table({"id": used.astype(np.int32), "freq": freq[used]})).coalesce(1).write.parquet(f"{path}-table")
    return freq


def read_table(spark: SparkSession, path: str) -> np.ndarray:
    """The frequency table of the files at ``path``: one row for each id of the vocabulary at most."""
    freq = np.zeros(VOCABULARY, np.int64)
    for r in spark.read.schema("id int, freq long").parquet(f"{path}-table").collect():
        freq[r["id"]] = r["freq"]
    return freq


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """shard, doc_id, order, start, length, total and ids_crc32 of each piece of a document in the blocks at ``path``.

    ``total`` is the length of the whole document, so all but documents of more than a block are in one piece. No
    shuffle; every block is decoded and checked by itself.
    """
    bound = spark.sparkContext.broadcast(read_table(spark, path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        PieceCodec.release()
        table = Table(bound.value)
        for batch in batches:
            shards, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                docs_, orders, lengths, totals = (batch.column(k)[i].values for k in (2, 3, 4, 5))
                raw = memoryview(table.decode(batch.column(6)[i].as_py()).astype("<u4").tobytes())
                sizes = lengths.to_numpy()
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                columns = [pa.array([shards[i]] * len(crcs), pa.int32()), docs_, orders, pa.array(starts[i] + ends - sizes), lengths, totals, pa.array(crcs, pa.int64())]
                yield pa.record_batch(columns, ["shard", "doc_id", "order", "start", "length", "total", "ids_crc32"])

    blocks = spark.read.schema(BLOCKS).parquet(path).select("shard", "start", "doc_ids", "orders", "lengths", "totals", "payload")
    return blocks.mapInArrow(decode, "shard int, doc_id long, order long, start long, length long, total long, ids_crc32 long")


def document_digests(pieces: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from its pieces as they were read.

    Only documents of more than one block are gathered: a row per piece, not their ids.
    """

    @F.udf("long")
    def whole_crc(parts):
        total = 0
        for part in sorted(parts, key=lambda p: p["start"]):
            total = crc32_combine(total, part["crc"], 4 * part["n"])
        return total

    pieces = materialize(pieces, "token-digests")
    one = pieces.where("length = total").select("doc_id", "start", F.col("length").alias("n_tokens"), "ids_crc32")
    part = F.struct("start", F.col("length").alias("n"), F.col("ids_crc32").alias("crc"))
    cut = pieces.where("length < total").groupBy("shard", "order", "doc_id").agg(F.min("start").alias("start"), F.max("total").alias("n_tokens"), F.collect_list(part).alias("parts"))
    return one.unionAll(cut.select("doc_id", "start", "n_tokens", whole_crc("parts").alias("ids_crc32")))
