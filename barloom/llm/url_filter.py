"""URL rules in a sorted digest array.

The array is one file: the 64-bit xxhash keys of all rules in ascending order, then 64-bit
offsets, then the rules' strings. Tasks memory-map it, probe it with vectorised binary search
for the candidates of a whole batch of URLs, and compare the stored string with the candidate,
so a collision of digests decides nothing. A URL's candidates are the host and its parent
domains, each with the path prefixes whose length some rule has.

The array is bounded by ``MAX_RULES``; beyond it ``judge`` explodes the candidates and joins
them with the rules by their string instead, with the same result.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule and the
verdict ``allow``, as any URL that no rule fits; of two rules of one length the longer host
wins; repeated rows are judged each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import storage
from barloom.llm import common, files

MAX_RULES = 20_000_000
_SPLIT = r"://([^/?#]*)([^?#]*)"
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def text(self) -> str:
        return self.host + self.path


def digest(texts: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)


@dataclass(frozen=True)
class DigestArray:
    """The written array; ``lengths`` has the path lengths that occur."""

    uri: str
    count: int
    size: int
    lengths: tuple[int, ...]

    @staticmethod
    def write(rules: list[Rule], uri: str) -> DigestArray:
        by_text = {}
        for rule in rules:  # a repeated rule counts once; a block outdoes an allow
            if rule.text not in by_text or rule.verdict == "block":
                by_text[rule.text] = rule
        chosen = list(by_text.values())
        keys = digest([r.text for r in chosen])
        order = np.argsort(keys, kind="stable")
        texts = [f"{chosen[i].verdict[0]}{len(chosen[i].host):04x}{chosen[i].text}".encode() for i in order]
        offsets = np.cumsum([0, *map(len, texts)]).astype("<i8")
        files.save(uri, [keys[order].astype("<u8"), offsets, np.frombuffer(b"".join(texts), np.uint8)])
        return DigestArray(uri, len(chosen), int(offsets[-1]), tuple(sorted({len(r.path) for r in chosen})))

    def probe(self, path: str, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        """Rule and verdict for each URL, with the array at a local ``path``."""
        n = self.count
        keys, offsets = files.mapped(path, "<u8", n), files.mapped(path, "<i8", n + 1, 8 * n)
        strings = files.mapped(path, "u1", self.size, 8 * (2 * n + 1))
        rows, texts, lengths = [], [], []
        for row, (host, page) in enumerate(zip(hosts, paths, strict=True)):
            at = 0 if host else -1
            while at >= 0:
                for k in self.lengths:
                    if k <= len(page):
                        rows.append(row)
                        texts.append(host[at:] + page[:k])
                        lengths.append(len(host) - at)
                at = host.find(".", at) + 1 or -1
        best: list[tuple] = [(-1, -1, None, None)] * len(hosts)
        if not texts or not n:
            return [None] * len(hosts), [None] * len(hosts)
        probes = digest(texts)
        first = np.searchsorted(keys, probes, "left")
        last = np.searchsorted(keys, probes, "right")
        for k in np.flatnonzero(last > first).tolist():
            for at in range(first[k], last[k]):
                stored = bytes(strings[offsets[at] : offsets[at + 1]]).decode()
                if stored[5:] == texts[k] and int(stored[1:5], 16) == lengths[k]:
                    found = (len(texts[k]), lengths[k], texts[k], "block" if stored[0] == "b" else "allow")
                    best[rows[k]] = max(best[rows[k]], found, key=lambda x: x[:2])
        return [b[2] for b in best], [b[3] for b in best]


def split(urls: list[str | None]) -> tuple[list[str], list[str]]:
    """Host (A-Z lower-cased) and path of each URL."""
    found = [re.search(_SPLIT, u) if u else None for u in urls]
    return [m[1].translate(_LOWER) if m else "" for m in found], [m[2] if m else "" for m in found]


def judge(df: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row a URL: the id, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``."""
    spark = df.sparkSession
    common.bounded_batches(spark)
    rows = df.select(F.col(id_col), F.col(url_col).alias("url"))
    if len(rules) > MAX_RULES:
        return joined(rows, rules_table(spark, rules), id_col)
    name = hashlib.sha256("\n".join(f"{r.text} {r.verdict}" for r in rules).encode()).hexdigest()[:16]
    array = DigestArray.write(rules, storage.scratch_path(spark, f"rules-{name}"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with files.local(array.uri) as path:
            for batch in batches:
                hosts, paths = split(batch.column("url").to_pylist())
                found, verdicts = array.probe(path, hosts, paths)
                columns = [hosts, paths, found, [v or "allow" for v in verdicts]]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=[id_col, "host", "path", "rule", "verdict"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(part, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "rule_host string, rule_path string, rule_verdict string")


def joined(rows: DataFrame, rules: DataFrame, id_col: str) -> DataFrame:
    """The same verdicts for rules beyond the array's bound: URLs join the rules of their parent domains.

    Distinct (host, path) pairs are judged once, so a hot URL is one row of the join.
    """
    once = rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    split = rows.withColumns(
        {
            "host": F.translate(F.coalesce(F.regexp_extract("url", _SPLIT, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
            "path": F.coalesce(F.regexp_extract("url", _SPLIT, 2), F.lit("")),
        }
    ).drop("url")
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    lengths = once.select(F.length("rule_path").alias("rule_length")).distinct()
    pairs = split.select("host", "path").distinct().where("host <> ''")
    candidates = (
        pairs.withColumn("rule_host", F.explode(parents))
        .join(F.broadcast(lengths), F.col("rule_length") <= F.length("path"))
        .withColumn("rule_path", F.expr("substring(path, 1, rule_length)"))
    )
    best = F.max(F.struct(F.length("rule_host") + F.col("rule_length"), F.length("rule_host").alias("h"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("v")))
    fitting = candidates.join(once, ["rule_host", "rule_path"]).groupBy("host", "path").agg(best.alias("best"))
    out = split.join(fitting, ["host", "path"], "left")
    return out.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit("allow")).alias("verdict"))
