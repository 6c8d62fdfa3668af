"""Encoding and decoding of whole texts with the transducer, as a DataFrame operator.

Defined results: a null text is an empty one, with no ids and empty decoded texts; repeated
rows are encoded each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common
from barloom.llm.transducer import coder


def round_trip(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (decimal, a blank between two), ``decoded`` and ``plain``.

    ``decoded`` is what the library gives for tokenizer files without a decoder: the tokens, a blank between two.
    ``plain`` is the text that the ids give back byte by byte: its words as the tokenizer normalises them, a blank after each.
    """
    common.bounded_batches(df.sparkSession)
    names = ["doc_id", "n_tokens", "ids", "decoded", "plain"]
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = coder(tokenizer)
        named, machine = codec.decoder(library=True), codec.decoder()
        for batch in batches:
            for piece in common.slices(batch, "text"):
                found = codec.encode(common.filled(piece.column("text")).to_pylist())
                outputs: list[list[bytes]] = [[], [], []]
                for x in map(np.ndarray.tolist, found):
                    texts = [b" ".join([codec.decimal[i] for i in x]), named.decode(x).encode(), machine.decode(x).encode()]
                    for column, text in zip(outputs, texts, strict=True):
                        column.append(text)
                columns = [pa.array(list(map(len, found)), pa.int64()), *(pa.array(c, pa.binary()) for c in outputs)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns], names=names)

    return rows.mapInArrow(part, "doc_id long, n_tokens long, ids binary, decoded binary, plain binary")
