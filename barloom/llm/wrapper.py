"""Main text of web pages by wrapper induction.

Each host has a reference page, the one with the smallest hash. Every page of the host is
aligned with it by simple tree matching of the element trees, so that each block of text
stands in a slot of the reference. A slot's text that most pages of the host have is
template; slots with varying text are content. What varies but is no article by its markup
(menus, footers, adverts, comments, forms and the like) is left out by the names of elements.

Where a page marks its main text (``<article>``, or else ``<main>``), the mark decides on hosts of
any size: text outside it is left out, unless it is the larger part and stands in longer blocks than
the marked text (a story in a plain element beside marked teasers), in which case its varying slots are
content too. Copies of an article on a host don't make it template: in an article only
what other pages have outside of one is, in ``<main>`` what most pages have, and neither if more than half of the
marked text would go. On a host whose pages are all the same no slot tells anything.

Slot texts are counted in each batch before they are shuffled, a host with a third of all
pages is counted in every task, and what joins the pages again is a reference of a few
thousand bytes a host.

Defined results: a null page is an empty one and has an empty text; a page without a host
belongs to the host ``''``; hosts of fewer than ``MIN_PAGES`` pages have no template; repeated
rows are extracted each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom import storage
from barloom.llm import common
from barloom.llm.dom import Block, Matcher, Tree, parse

MIN_PAGES = 5
SUPPORT_PERCENT = 80
#: Bytes of references and templates that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def skeleton(tree: Tree) -> str:
    return json.dumps([tree.labels, tree.parents], ensure_ascii=False)


def from_skeleton(text: str) -> Tree:
    tree = Tree()
    for label, parent in zip(*json.loads(text), strict=True):
        tree.add(label, parent)
    return tree


class Aligner:
    """Slots of blocks in the reference of their host; a few references are kept."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.matcher, self.references = Matcher(), {}

    def slots(self, tree: Tree, reference: str) -> list[int]:
        """For each block the reference's node, or -1."""
        if len(self.references) > 200 or len(self.matcher.names) > 100_000 or len(self.matcher.weights) > 500_000:
            self.clear()
        if reference not in self.references:
            self.references[reference] = self.matcher.finish(from_skeleton(reference))
        found = self.matcher.align(self.matcher.finish(tree), self.references[reference])
        return [found.get(b.node, -1) for b in tree.blocks]


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


#: What the slots say of a block.
VARIES, CONSTANT, CONSTANT_OUTSIDE = 0, 1, 2  # the last: pages have it outside an article, too


def _prose(blocks: list[Block]) -> tuple[int, float]:
    """Characters, and the mean length of the block in which a character stands."""
    sizes = [len(b.text) for b in blocks]
    return sum(sizes), sum(x * x for x in sizes) / max(1, sum(sizes))


def main_text(tree: Tree, slots: list[int]) -> str:
    """The blocks that are content, in page order, joined by a line feed."""
    told = [(b, slot) for b, slot in zip(tree.blocks, slots, strict=True) if not b.apart]
    mark = max((b.main for b, _ in told), default=0)
    marked = [b for b, _ in told if mark and b.main == mark]
    template = CONSTANT_OUTSIDE if mark == 2 else CONSTANT
    own = [b for b, slot in told if mark and b.main == mark and slot < template]
    if 2 * _prose(own)[0] >= _prose(marked)[0]:
        marked = own
    # Outside marked main text a list of nothing but links is a menu.
    rest = [b for b, slot in told if not (mark and b.main == mark) and slot == VARIES]
    rest = [b for b in rest if not (b.links and not b.main and tree.labels[b.node].split(".")[0] == "li")]
    beside, within = _prose([b for b in rest if not b.links]), _prose(marked)
    if marked and not (beside[0] > within[0] and beside[1] > within[1]):
        rest = []
    kept = {id(b) for b in marked + rest}
    return "\n".join(b.text for b in tree.blocks if id(b) in kept)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` (empty if none) and ``n_chars`` of each page."""
    spark = df.sparkSession
    common.bounded_batches(spark)
    host = F.lower(F.coalesce(F.regexp_extract(url_col, "://([^/?#]*)", 1), F.lit("")))
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.xxhash64(host).alias("host"))

    # The reference of each host.
    pick = F.xxhash64("page_id", "url", "html")
    first = pages.withColumn("pick", pick).groupBy("host").agg(F.min("pick").alias("pick"), F.count("*").alias("n_pages"))
    first = storage.materialize(first, "hosts")
    few = first.count() * 16 <= BROADCAST_BYTES

    def references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [skeleton(parse(x)) for x in common.filled(batch.column("html")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("n_pages"), pa.array(trees, pa.string())], names=["host", "n_pages", "reference"])

    chosen = pages.withColumn("pick", pick).join(F.broadcast(first) if few else first, ["host", "pick"])
    made = chosen.select("host", "n_pages", "html").mapInArrow(references, "host long, n_pages long, reference string")
    made = storage.materialize(made.groupBy("host").agg(F.min("n_pages").alias("n_pages"), F.min("reference").alias("reference")), "references")
    size = made.agg(F.sum(F.octet_length("reference") + 16)).head()[0] or 0
    small = size <= BROADCAST_BYTES

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner()
        for batch in batches:
            seen, outside = Counter(), Counter()
            columns = (batch.column("host").to_pylist(), common.filled(batch.column("html")).to_pylist(), batch.column("reference").to_pylist())
            for key, body, reference in zip(*columns, strict=True):
                tree = parse(body)
                slots = aligner.slots(tree, reference)
                # Text set apart counts too: whether it is may differ from page to page.
                found = {(key, s, _digest(b.text)): b.main for b, s in zip(tree.blocks, slots, strict=True) if s >= 0}
                seen.update(found.keys())
                outside.update(k for k, main in found.items() if main < 2)
            rows = [[k[i] for k in seen] for i in range(3)] + [list(seen.values()), [outside[k] for k in seen]]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["host", "slot", "digest", "n", "outside"])

    large = made.where(F.col("n_pages") >= MIN_PAGES)
    aligned = pages.select("host", "html").join(F.broadcast(large) if small else large, "host")
    counts = aligned.select("host", "html", "reference").mapInArrow(counted, "host long, slot int, digest long, n long, outside long")
    totals = counts.groupBy("host", "slot", "digest").agg(F.sum("n").alias("n"), F.sum("outside").alias("outside"))
    totals = totals.join(F.broadcast(made.select("host", "n_pages")) if small else made.select("host", "n_pages"), "host")
    shared = 100 * F.col("n") >= SUPPORT_PERCENT * F.col("n_pages")
    slot = F.when(shared, F.struct("slot", "digest", (F.col("outside") > 0).alias("outside")))
    templates = totals.groupBy("host").agg(F.collect_set(slot).alias("template"), F.bool_and(F.col("n") == F.col("n_pages")).alias("copies"))
    # A host with enough pages has a row even if none of its slots is constant; if all of them are, they tell nothing.
    template = F.when(~F.col("copies"), F.col("template"))
    wrappers = storage.materialize(large.join(templates, "host", "left").select("host", "reference", template.alias("template")), "wrappers")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, known = Aligner(), {}
        for batch in batches:
            out = []
            columns = (common.filled(batch.column("html")).to_pylist(), batch.column("reference").to_pylist(), batch.column("host").to_pylist())
            for i, (body, reference, key) in enumerate(zip(*columns, strict=True)):
                tree = parse(body)
                said = [VARIES] * len(tree.blocks)
                if reference is not None:
                    if key not in known:
                        known.clear()
                        entries = batch.column("template")[i].as_py() or []
                        known[key] = {(x["slot"], x["digest"]): CONSTANT_OUTSIDE if x["outside"] else CONSTANT for x in entries}
                    slots = aligner.slots(tree, reference)
                    said = [known[key].get((s, _digest(b.text)), VARIES) for b, s in zip(tree.blocks, slots, strict=True)]
                out.append(main_text(tree, said))
            arrays = [pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *arrays], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    joined = pages.join(F.broadcast(wrappers) if small else wrappers, "host", "left")
    return joined.select("page_id", "url", "html", "host", "reference", "template").mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long")
