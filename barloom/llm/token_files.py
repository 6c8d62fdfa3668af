"""Token ids as flat binary files with 64-bit offsets, memory-mapped by their readers.

``write`` deals documents by ranges of ``doc_id`` and sorts within; each task streams its
documents' ids into one flat file of unsigned integers (16 bits where the vocabulary allows,
else 32) and, beside it, an index of 64-bit offsets and document ids. Files carry the task
attempt in their name and count only once they are in the manifest, so a lost or repeated
task leaves nothing wrong behind. A file's place in the whole stream (its base) is the
prefix sum of the sizes before it: one number a file. ``read`` maps the files and needs no
shuffle.

Defined results: a null text is an empty one and holds the end id alone; a null ``doc_id``
comes first; rows of one ``doc_id`` are ordered by a hash
of the text and all written; an empty table
gives no files. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import common, files
from barloom.llm.tokens import encoder

MANIFEST = "part int, ids string, index string, n_docs long, n_ids long"


@dataclass(frozen=True)
class TokenFiles:
    """Where the files of one stream are: ``parts`` has a row a file, in order, with its base."""

    folder: str
    kind: str
    parts: list[tuple[str, str, int, int, int]]  # ids file, index file, documents, ids, ids before


def write(
    df: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> TokenFiles:
    """Encode every whole text, append ``end_id`` and write the ids in ascending ``id_col`` order below ``folder``."""
    spark = df.sparkSession
    common.bounded_batches(spark)
    kind = "<u2" if max(encoder(tokenizer).size - 1, end_id) < 1 << 16 else "<u4"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        keys, nulls, offsets, total = [], [], [np.zeros(1, np.int64)], 0
        system, path = files.opened(folder)
        system.create_dir(path)
        with system.open_output_stream(f"{path}/{name}.ids") as out:
            for batch in batches:
                for piece in common.slices(batch, "text"):
                    found = encoder(tokenizer).encode(common.filled(piece.column("text")).to_pylist())
                    out.write(b"".join(np.append(x, end_id).astype(kind).tobytes() for x in found))
                    sizes = np.array([len(x) + 1 for x in found], np.int64)
                    offsets.append(total + np.cumsum(sizes))
                    total += int(sizes.sum())
                    keys.append(piece.column("id").fill_null(0).to_numpy())
                    nulls.append(piece.column("id").is_null().to_numpy(zero_copy_only=False))
        n = sum(map(len, keys))
        if not n:
            system.delete_file(f"{path}/{name}.ids")
            return
        index = [np.concatenate(offsets).astype("<i8"), np.concatenate(keys).astype("<i8"), np.concatenate(nulls).astype("u1")]
        files.save(f"{folder}/{name}.index", index)
        columns = [[context.partitionId()], [f"{name}.ids"], [f"{name}.index"], [n], [total]]
        types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "ids", "index", "n_docs", "n_ids"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))  # splitters are short, and rows of one id are spread
    ordered = rows.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash", "text").select("id", "text")
    ordered.mapInArrow(part, MANIFEST).write.parquet(f"{folder}/manifest")
    made = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("part").collect()  # one row a file
    base, parts = 0, []
    for row in made:
        parts.append((row.ids, row["index"], row.n_docs, row.n_ids, base))
        base += row.n_ids
    return TokenFiles(folder, kind, parts)


def read(spark: SparkSession, stored: TokenFiles, with_ids: bool = True) -> DataFrame:
    """A row a document, from the mapped files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    folder, kind = stored.folder, stored.kind

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with files.local(f"{folder}/{row['index']}") as index, files.local(f"{folder}/{row['ids']}") as flat:
                    n = row["n_docs"]
                    offsets = files.mapped(index, "<i8", n + 1)
                    keys = files.mapped(index, "<i8", n, 8 * (n + 1))
                    null = files.mapped(index, "u1", n, 8 * (2 * n + 1)).astype(bool)
                    ids = files.mapped(flat, kind, row["n_ids"])
                    for a in range(0, n, 1000):
                        b = min(a + 1000, n)
                        cuts = [ids[offsets[i] : offsets[i + 1]] for i in range(a, b)]
                        columns = [
                            pa.array(keys[a:b], pa.int64(), mask=null[a:b]),
                            pa.array(offsets[a:b] + row["base"], pa.int64()),
                            pa.array(np.diff(offsets[a : b + 1]), pa.int64()),
                            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cuts], pa.int64()),
                        ]
                        if with_ids:
                            columns.append(pa.array([x.astype(np.int32) for x in cuts], pa.list_(pa.int32())))
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    parts = spark.createDataFrame(stored.parts, "ids string, index string, n_docs long, n_ids long, base long")
    return parts.repartition(max(1, len(stored.parts)), "ids").mapInArrow(load, schema)
