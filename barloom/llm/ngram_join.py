"""N-gram Jaccard join with prefix filters under several global orders.

A text is the set of its distinct word n-grams, as 64-bit hashes. For a similarity of at least
t, two sets share a token among the first |x| - ceil(t |x|) + 1 of each, in any global order of
the tokens. Pairs are found by the prefix of a first order, and must also share tokens in the
prefixes of two further, independent orders, and the parities of their tokens in ``PARITIES`` cells
must not differ in more cells than the sets may differ in tokens; only then the whole sets are
compared, so the result is exact. In every order the tokens that are frequent in first prefixes come last
(``HOT_TOKENS`` of them at most, by the threshold that bounds their number), so a passage that
many texts share forms no candidates by itself. The two filters hold 16 bits of a token, so they
let some pairs pass that the comparison then rejects, and never reject a pair themselves.

Groups of near copies aren't expanded into all pairs. Equal sets are one class, whose smallest
id represents it. Of the classes that share a prefix token the smallest is a pivot; each class is
first compared with the pivot it shares most tokens with (a star); afterwards, only classes that are not yet connected are compared with
each other, by blocks within a token's group: sizes and parities are looked at there, and only pairs that pass become rows. No link between two components is lost, whatever the order of the steps. Whole sets
are made only for the texts of pairs that pass all filters.

Defined results: null texts and texts without words have an empty set and stay alone; a text
with fewer words than n has one n-gram, its whole word sequence; repeated rows are copies; a
null id is in no link; rows of one id are one document, linked where any of its texts is; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom import storage
from barloom.llm import common
from barloom.llm.common import mix, taken
from barloom.llm.components import components

#: Tokens that may be moved to the end of the orders; 4 bytes each are broadcast.
HOT_TOKENS = 1 << 20
HOT_LEAST = 8
#: Bits of a set's parities: each token flips one, so two sets differ in at least as many tokens as bits.
PARITIES = 1024
#: Entries of a token that a task compares with as many others, and pairs that it looks at at once.
BLOCK = 1024
STEP_PAIRS = 1 << 20
#: Texts that are compared with the same one in a task.
PLACE = 1024
#: Ids (8 bytes each) that may be broadcast to select texts; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000

_WEIGHTS = mix(np.arange(501, 533, dtype=np.uint64)) | np.uint64(1)
_ORDERS = mix(np.arange(701, 703, dtype=np.uint64))


def shingles(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text, lower-cased in A-Z."""
    data, offsets = common.raw(column)
    data = common.LOWER[data]
    starts, ends, first = common.word_spans(data, offsets)
    words = common.keyed_hashes(data, starts, ends)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        grams += words[k : len(grams) + k] * _WEIGHTS[k]
    grams = mix(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            short = (words[a:b] * _WEIGHTS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(size: int, percent: int) -> int:
    return size - -(-size * percent // 100) + 1 if size else 0


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    values = np.concatenate([*parts, np.zeros(0, parts[0].dtype if parts else np.int64)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _mapped(docs: DataFrame, n: int, schema: str, make) -> DataFrame:
    """A row a document from ``make(sets)``, which gives the columns after ``doc_id``."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, "text"):
                columns = make(shingles(piece.column("text"), n))
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns], names=names)

    return docs.mapInArrow(part, schema)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _similar(a: str | Column, b: str | Column, percent: int) -> Column:
    """Whether sizes allow the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _passing(table: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs within the groups of a sorted table that pass labels, sizes and parities, some of them at a time."""
    table = table.combine_chunks()
    keys = [table.column(c).to_numpy() for c in ("token", "low", "high")]
    own, ids, labels, sizes = (table.column(c).to_numpy() for c in ("own", "doc_id", "label", "size"))
    parity = table.column("parity").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(table), -1)
    apart = keys[1] != keys[2]
    new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    starts = np.flatnonzero(new)
    ends = np.repeat(np.append(starts[1:], len(table)), np.diff(np.append(starts, len(table))))
    partners = ends - np.arange(len(table)) - 1
    sums = np.concatenate([[0], np.cumsum(partners)])
    at = 0
    while at < len(table):
        upto = max(at + 1, int(np.searchsorted(sums, sums[at] + STEP_PAIRS, side="right")) - 1)
        left = np.repeat(np.arange(at, upto), partners[at:upto])
        right = taken(np.arange(at, upto) + 1, partners[at:upto])
        at = upto
        # Of two blocks only pairs between them: those within each have a group of their own.
        open_ = (labels[left] != labels[right]) & ~(apart[left] & (own[left] == own[right])) & (ids[left] != ids[right])
        n, m = sizes[left], sizes[right]
        open_ &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        left, right = left[open_], right[open_]
        for k in range(0, len(left), STEP_PAIRS // 16):
            x, y = left[k : k + STEP_PAIRS // 16], right[k : k + STEP_PAIRS // 16]
            differ = np.bitwise_count(parity[x] ^ parity[y]).sum(axis=1, dtype=np.int64)
            near = differ * (100 + percent) <= (100 - percent) * (sizes[x] + sizes[y])
            if near.any():
                a, b = ids[x[near]], ids[y[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough; empty ones are not."""
    if not len(x) or not len(y):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[at] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def few(ids: DataFrame) -> DataFrame:
    """Ids, to be broadcast if they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


class Join:
    """One run over ``docs``: classes, prefixes, candidates, links."""

    def __init__(self, df: DataFrame, n: int, percent: int, id_col: str, text_col: str):
        self.n, self.percent, self.spark = n, percent, df.sparkSession
        common.bounded_batches(self.spark)
        self.docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sets(self) -> DataFrame:
        """Size, digest and first prefix of every document."""
        percent = self.percent

        def make(found: list[np.ndarray]) -> list[pa.Array]:
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in found]
            first = [_signed(x[: prefix_length(len(x), percent)]) for x in found]
            return [pa.array([len(x) for x in found], pa.int64()), pa.array(digests, pa.binary()), _lists(first, pa.int64())]

        schema = "doc_id long, n_shingles long, digest binary, first array<bigint>"
        return storage.materialize(_mapped(self.docs, self.n, schema, make), "sets")

    def hot_tokens(self, first: DataFrame) -> np.ndarray:
        """32 bits of the tokens in more first prefixes than the threshold, which bounds their number by ``HOT_TOKENS``."""
        entries = first.agg(F.sum(F.size("first"))).head()[0] or 0
        least = max(HOT_LEAST, -(-entries // HOT_TOKENS))
        tokens = first.select(F.explode("first").alias("token")).select(F.col("token").bitwiseAND(F.lit(0xFFFFFFFF)).alias("token"))
        counts = tokens.groupBy("token").count()
        hot = counts.where(F.col("count") > least).select("token").toPandas().token
        return np.sort(hot.to_numpy(np.uint32))

    def prefixes(self, hot: np.ndarray) -> DataFrame:
        """The prefixes in three orders, hot tokens last."""
        percent, shared = self.percent, self.spark.sparkContext.broadcast(hot)

        def make(found: list[np.ndarray]) -> list[pa.Array]:
            hot, sizes, orders, parities = shared.value, [], [[], [], []], []
            for x in found:
                k = prefix_length(len(x), percent)
                late = np.zeros(len(x), bool)
                if len(hot):
                    short = (x & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    late = hot[np.minimum(np.searchsorted(hot, short), len(hot) - 1)] == short
                early = np.flatnonzero(~late)
                orders[0].append(_signed(x[np.append(early, np.flatnonzero(late))[:k]]))
                for order, salt in zip(orders[1:], _ORDERS, strict=True):
                    key = mix(x ^ salt) >> np.uint64(1) | late.astype(np.uint64) << np.uint64(63)
                    order.append(np.unique((np.sort(key)[:k] & np.uint64(0xFFFF)).astype(np.uint16)).view(np.int16))
                sizes.append(len(x))
                flips = np.bincount((x % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
                parities.append(np.packbits(flips.astype(np.uint8)).view(np.int64))
            lists = [_lists(orders[0], pa.int64()), *(_lists(o, pa.int16()) for o in orders[1:]), _lists(parities, pa.int64())]
            return [pa.array(sizes, pa.int64()), *lists]

        schema = "doc_id long, size long, first array<bigint>, second array<smallint>, third array<smallint>, parity array<bigint>"
        return _mapped(self.docs, self.n, schema, make)

    def candidates(self, entries: DataFrame) -> DataFrame:
        """Pairs ``a < b`` of one token with different labels whose sizes and parities allow the similarity.

        ``entries`` have a token, its ``n`` entries, and a class with label, size and parities. The entries of a token are
        cut into blocks of about ``BLOCK``, and a task compares two blocks: pairs that don't pass never leave it.
        """
        percent = self.percent
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
        own = F.pmod(F.xxhash64("doc_id", "token"), F.col("blocks")).cast("int")
        each = entries.withColumn("blocks", blocks).withColumn("own", own)
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        each = each.select("token", "doc_id", "label", "size", "parity", "own", other)
        dealt = each.select(
            "token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "doc_id", "label", "size", "parity"
        )

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
                keys = [held.column(c).to_numpy() for c in ("token", "low", "high")]
                new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
                if len(new):  # the last group may go on in the next batch
                    yield from _passing(held.slice(0, int(new[-1])), percent)
                    held = held.slice(int(new[-1]))
            if held is not None:
                yield from _passing(held, percent)

        group = ["token", "low", "high"]
        pairs = dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(compared, "a long, b long")
        return storage.materialize(pairs.distinct(), "candidates")

    def links(self, pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
        """The pairs ``a``, ``b`` that pass the further orders and then the comparison of their sets."""
        percent = self.percent
        for side in ("a", "b"):
            own = {"size": "n", "second": "2", "third": "3", "parity": "p"}
            pairs = pairs.join(prefixes.select(F.col("doc_id").alias(side), *(F.col(k).alias(side + v) for k, v in own.items())), side)
        apart = F.aggregate(F.zip_with("ap", "bp", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
        few_apart = apart * (100 + percent) <= (100 - percent) * (F.col("an") + F.col("bn"))
        pairs = pairs.where(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3") & few_apart).select("a", "b")
        kept = storage.materialize(pairs, "pairs")
        # Each text goes once to where its partner's is. A partner of many has several places.
        places = kept.groupBy("a").agg(F.ceil(F.count("*") / PLACE).cast("int").alias("places"))
        dealt = kept.join(places, "a").withColumn("place", F.pmod(F.xxhash64("b"), F.col("places")).cast("int"))
        others = dealt.select(F.col("b").alias("doc_id"), "a", "place", "b")
        firsts = places.select(
            F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(None).cast("long").alias("b")
        )
        wanted = storage.materialize(others.unionByName(firsts), "wanted")
        meeting = self.docs.join(few(wanted), "doc_id").select("a", "place", "b", "text")
        # Within a place the text that the others are compared with comes first: it has no b.
        meeting = meeting.repartition("a", "place").sortWithinPartitions("a", "place", "b")
        n = self.n

        def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, firsts = None, {}
            for batch in batches:
                for piece in common.slices(batch, "text"):
                    linked: list[tuple[int, int]] = []
                    rows = zip(*(piece.column(c).to_pylist() for c in ("a", "place", "b")), shingles(piece.column("text"), n), strict=True)
                    for a, place, b, y in rows:
                        if (a, place) != at:
                            at, firsts = (a, place), {}
                        if b is None:  # an id may have several texts
                            firsts[hashlib.blake2b(y.tobytes(), digest_size=16).digest()] = y
                        elif any(_linked(x, y, percent) for x in firsts.values()):
                            linked.append((a, b))
                    columns = [pa.array([p[k] for p in linked], pa.int64()) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        found = storage.materialize(meeting.mapInArrow(verified, "a long, b long"), "links")
        for used in (kept, wanted):
            storage.discard(used)
        return found

    def run(self) -> DataFrame:
        wide = self.sets()
        hot = self.hot_tokens(wide.select("first"))
        docs = storage.materialize(wide.drop("first"), "digests")
        storage.discard(wide)
        classes = docs.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
        classes = storage.materialize(classes, "classes")
        reps = classes.select(F.col("rep").alias("doc_id"))

        prefixes = self.prefixes(hot).join(few(reps), "doc_id", "left_semi")
        prefixes = storage.materialize(prefixes, "prefixes")
        entries = prefixes.select("doc_id", "size", F.explode("first").alias("token"))
        pivot = F.min(F.struct("doc_id", "size")).alias("pivot")
        groups = entries.groupBy("token").agg(F.count("*").alias("n"), pivot).where("n > 1").select("token", "pivot")
        shared = storage.materialize(entries.join(groups, "token"), "shared_tokens")

        star = shared.where((F.col("doc_id") != F.col("pivot.doc_id")) & _similar("size", "pivot.size", self.percent))
        # Each with the one smallest class that it shares most tokens with; the other pairs are looked at below.
        star = star.groupBy(F.col("pivot.doc_id").alias("a"), F.col("doc_id").alias("b")).count()
        star = star.groupBy("b").agg(F.max(F.struct("count", -F.col("a"))).alias("best"))
        star = star.select((-F.col("best.col2")).alias("a"), "b")
        links = self.links(star, prefixes)
        labels = components(links)

        # What shares a token and is not connected yet. A pair becomes a row once its parities allow the similarity.
        named = shared.drop("pivot").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        named = named.withColumn("label", F.coalesce("label", "doc_id"))
        ends = [F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")]
        mixed = named.groupBy("token").agg(*ends).where("low <> high").select("token", "n")
        open_ = named.join(mixed, "token").join(prefixes.select("doc_id", "parity"), "doc_id")
        cross = self.candidates(open_)
        more = self.links(cross, prefixes)
        if more.head(1):
            labels = components(links.union(more))
        for used in (prefixes, shared, cross):
            storage.discard(used)

        found = docs.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
        found = found.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        component = F.coalesce("label", "rep", "doc_id").alias("component_id")
        return found.select("doc_id", "n_shingles", component)


def near_duplicates(df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Two documents are linked when the similarity of their sets of word n-grams is at least ``percent`` percent.
    """
    return Join(df, n, percent, id_col, text_col).run()
