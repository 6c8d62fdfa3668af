"""Language identification by a bidirectional gated recurrent network over bytes.

``fit`` draws a bounded sample: about ``DOCS`` documents of each language, chosen by a hash of
the id, and ``WINDOWS`` windows of ``gru.WINDOW`` bytes of each; the network is trained on these
in the driver. ``predict`` cuts every whole text into windows, labels each position with a
distribution over the languages, and pools the positions of letters: a document's
probabilities are their means. Windows of many documents are computed side by side, so a very
long text takes no more memory than a short one.

Languages beyond the ``MAX_LANGUAGES`` most frequent ones (ties by name) aren't learned: their documents get
the learned language that is nearest.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text
where nothing could be learned; ties go to the first language in alphabetical order; repeated
rows are predicted each; an empty table gives no rows. Language, source and id are never inputs
of a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import common
from barloom.llm.common import mix
from barloom.llm.gru import WINDOW, Network, train

DOCS, WINDOWS = 300, 16
#: Languages that one network tells apart, the most frequent ones.
MAX_LANGUAGES = 200
NONE = "und"
_SIDE_BY_SIDE = 4096
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Model:
    languages: list[str]
    network: Network | None


def fit(df: DataFrame, rows: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows where ``rows`` holds and that have a language and a text."""
    common.bounded_batches(df.sparkSession)
    chosen = df.where(rows & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = chosen.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()}
    languages = sorted(counts)
    if len(languages) < 2:
        return Model(languages, None)
    share = df.sparkSession.createDataFrame([(k, DOCS / n) for k, n in counts.items()], "lang string, share double")
    # A uniform number from the id; the number of documents drawn is DOCS on average, and cut to that below.
    uniform = F.pmod(F.xxhash64(F.lit(41), "id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = labelled.join(F.broadcast(share), "lang").withColumn("uniform", uniform).where("uniform < 1.3 * share")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            data, offsets = common.raw(batch.column("text"))
            for i, (lang, at) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("uniform").to_pylist(), strict=True)):
                body = data[offsets[i] : offsets[i + 1]]
                seeds = mix(np.arange(WINDOWS, dtype=np.uint64) + np.uint64(int(at * (1 << 30)) * WINDOWS))
                for start in (seeds % np.uint64(max(1, len(body) - WINDOW + 1))).tolist():
                    for column, value in zip(out, (lang, at, body[start : start + WINDOW].tobytes().ljust(WINDOW, b"\0")), strict=True):
                        column.append(value)
            types = [pa.string(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["lang", "uniform", "bytes"])

    sample = drawn.select("lang", "uniform", "text").mapInArrow(cut, "lang string, uniform double, bytes binary").toPandas()
    sample = sample.sort_values(["lang", "uniform", "bytes"], kind="stable").groupby("lang").head(DOCS * WINDOWS)
    windows = np.frombuffer(b"".join(sample.bytes), np.uint8).reshape(-1, WINDOW)
    present = sorted(sample.lang.unique())  # a language of very few rows may have drawn none
    labels = np.array([present.index(x) for x in sample.lang])
    return Model(present, train(windows, labels, len(present)) if len(present) > 1 else None)


def _pooled(network: Network, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability sums (texts, K) over letter positions and their numbers."""
    sizes = np.diff(offsets)
    windows = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), windows)
    starts = common.taken(np.zeros(len(sizes), np.int64), windows) * WINDOW + offsets[owner]
    sums, letters = np.zeros((len(sizes), len(network.bias))), np.zeros(len(sizes))
    padded = np.append(data, np.uint8(0))
    for a in range(0, len(starts), _SIDE_BY_SIDE):
        own = owner[a : a + _SIDE_BY_SIDE]
        at = starts[a : a + _SIDE_BY_SIDE] + np.arange(WINDOW)[:, None]
        at[at >= offsets[own + 1]] = len(data)  # after the text: zero bytes
        total, count = network.pooled(padded[at])
        np.add.at(sums, own, total.T)
        np.add.at(letters, own, count)
    return sums, letters


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` without the text and with ``lang_pred`` and ``score``; extra columns of these names give way."""
    common.bounded_batches(df.sparkSession)
    others = [f for f in df.schema.fields if f.name not in (text_col, "lang_pred", "score")]
    carried = [f"in_{k}" for k in range(len(others))]  # so no name of a column clashes with one of these
    rows = df.select(F.col(text_col).alias("text"), *(F.col(f"`{f.name}`").alias(c) for c, f in zip(carried, others, strict=True)))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages or [NONE], object)
        for batch in batches:
            for piece in common.slices(batch, "text"):
                texts = piece.column("text")
                lettered = np.array([bool(_LETTER.search(t)) for t in common.filled(texts).to_pylist()]) & bool(model.languages)
                if model.network is None:
                    best, score = np.zeros(len(texts), int), np.ones(len(texts))
                else:
                    sums, letters = _pooled(model.network, *common.raw(texts))
                    means = sums / np.maximum(letters, 1)[:, None]
                    best, score = means.argmax(axis=1), np.clip(means.max(axis=1), 0, 1)
                columns = [np.where(lettered, names[best], NONE), np.where(lettered, score, 0.0)]
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*map(piece.column, carried), *arrays], names=[*carried, "lang_pred", "score"])

    schema = ", ".join([*(f"{c} {f.dataType.simpleString()}" for c, f in zip(carried, others, strict=True)), "lang_pred string", "score double"])
    names = (F.col(c).alias(f.name) for c, f in zip(carried, others, strict=True))
    return rows.mapInArrow(part, schema).select(*names, "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """A fifth of the documents, by a checksum of the id as text."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0
