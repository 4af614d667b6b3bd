"""Token counts: lengths only, from Arrow batches that are balanced by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.tokens import PieceCodec

#: Fixed value: the default of the numbers that the contract names.
OVER = 2048
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, tokenizer_path: str, drops_space: bool = True, limit: int = OVER) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of ``docs(doc_id, text)``; no shuffle.

    The tokenizer file is read where the tasks run. Batches are cut into slices of equal bytes and texts at white
    space, where no token can lie across. A null text counts as an empty one: 0 bytes, 0 tokens. Repeated rows give
    repeated results, an empty table gives none, other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec.of(tokenizer_path, drops_space)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            n = codec.lengths_of(texts)
            yield pa.record_batch([batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, SCHEMA)
