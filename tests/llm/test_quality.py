"""Text statistics and robust estimates against plain loops."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from llm_rows import DOCS, prose

from barloom.llm import quality
from barloom.llm.text_stats import text_stats


def plain(text: str | None) -> dict:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {k for i, w in enumerate(windows) if counts[w] > 1 for k in range(i, i + 8)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_echo_words": sum(a == b for a, b in zip(words[:-1], words[1:], strict=True)),
        "n_repeat_words": len(covered),
    }


def test_statistics_are_those_of_plain_loops():
    rng = np.random.default_rng(3)
    texts = [None, "", " ", "\n\n", "a\na\n a\na\x0b", prose(1, 500), (prose(2, 12) + " ") * 4, "é ü | <x>"]
    texts += ["".join(rng.choice(list("ab \n#é"), rng.integers(0, 80))) for _ in range(500)]
    found = text_stats(pa.array(texts))
    for i, text in enumerate(texts):
        assert {k: int(v[i]) for k, v in found.items()} == plain(text), text


def test_chi_square_quantiles():
    assert quality.chi2_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert quality.chi2_quantile(0.975, 5) == pytest.approx(12.833, abs=1e-3)


def rows(n: int, source: str, start: int, junk: int = 0) -> list:
    out = [(start + i, prose(start + i, 60 + i % 90), "en", source, 0) for i in range(n)]
    for i in range(junk):
        body = " ".join(f"{w}***" for w in prose(9000 + i, 70).split())
        out.append((start + n + i, body, "en", source, 0))
    return out


def test_outliers_of_a_source_are_rejected_and_clean_rows_stay(spark):
    data = rows(150, "a", 0, junk=40) + rows(130, "b", 1000, junk=3) + rows(9, "tiny", 2000) + rows(8, "small", 3000, junk=1)
    out = quality.judged(spark.createDataFrame(data, DOCS).repartition(4)).collect()
    kept = {r.doc_id: r.kept for r in out}
    assert len(out) == len(data)
    clean = [d for d, t, *_ in data if "***" not in t]
    assert all(kept[d] for d in clean)
    judged_sources = {"a", "b"}
    assert not any(kept[d] for d, t, _, s, _ in data if "***" in t and s in judged_sources)


def test_estimates_equal_the_plain_method(spark):
    """The concentration steps of one group, written with numpy over all rows at once."""
    data = rows(200, "a", 0, junk=30)
    out = sorted(quality.judged(spark.createDataFrame(data, DOCS)).collect(), key=lambda r: r.doc_id)
    x = []
    for r in out:
        words, lines = max(1, r.n_words), max(1, r.n_lines)
        x.append([np.log(max(1, r.word_chars) / words), np.sqrt(r.n_symbols / words), np.sqrt(r.n_repeat_words / words), np.sqrt(r.n_dup_lines / lines), np.sqrt(r.n_echo_words / words)])
    x = np.array(x)
    p, floor = x.shape[1], np.diag(np.square(list(quality.VECTOR.values())))

    def distances(centre, scatter):
        d = x - centre
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(scatter + floor), d)

    def next_of(d, bins, taken):
        inside = bins <= np.sort(np.unique(bins))[taken] if isinstance(taken, int) else taken
        share = inside.mean()
        scatter = np.cov(x[inside].T, bias=True)
        if share < 1:
            scatter = scatter * share / quality.chi2_cdf(quality.chi2_quantile(share, p), p + 2)
        return x[inside].mean(axis=0), scatter

    best = None
    quartiles = np.percentile(np.round(x, 3), [25, 50, 75], axis=0)
    starts = [(quartiles[1], np.diag(((quartiles[2] - quartiles[0]) / 1.349) ** 2)), (x.mean(axis=0), np.cov(x.T, bias=True))]
    for centre, scatter in starts:
        for _ in range(quality.STEPS):
            bins = np.floor(np.log2(distances(centre, scatter) + 1e-9) * quality.BINS_AN_OCTAVE)
            upto = np.cumsum([(bins == b).sum() for b in np.unique(bins)])
            centre, scatter = next_of(None, bins, int(np.searchsorted(upto, (len(x) + p + 1) // 2)))
        size = np.linalg.slogdet(scatter + floor)[1]
        if best is None or size < best[0]:
            best = (size, centre, scatter)
    bins = np.floor(np.log2(distances(*best[1:]) + 1e-9) * quality.BINS_AN_OCTAVE)
    bound = np.floor(np.log2(quality.chi2_quantile(0.975, p)) * quality.BINS_AN_OCTAVE)
    expected = distances(*next_of(None, bins, bins <= bound))
    assert [r.distance2 for r in out] == pytest.approx(expected.tolist(), rel=1e-6)


def test_awkward_rows(spark, awkward, empty):
    out = quality.judged(awkward).collect()
    assert len(out) == awkward.count()
    found = {r.doc_id: r for r in out if r.doc_id}
    assert all(not found[i].kept and found[i].base_failed for i in (1, 2, 3, 9, 10, 11))
    assert found[4].kept and found[5].kept  # too few rows for an estimate: the base rules decide
    assert found[4].n_words == 40_000
    assert quality.judged(empty).count() == 0


def test_each_statistic_rejects_alone(spark):
    rng = random.Random(3)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.choice([4, 5, 6]))) for _ in range(n)]
    clean = [" ".join(words(200)) for _ in range(300)]
    few, lines = ["abcd", "bcdef", "cdefgh", "defgi", "efghi", "fghij", "ghijab", "hija"], []
    while len(lines) < 200:
        lines += [x for x in [rng.choice(few)] if lines[-1:] != [x]]
    passage = words(31)
    planted = {
        "x_length": " ".join(x * 2 for x in words(200)),
        "x_symbols": " ".join(x + "#" * (i % 4 == 0) for i, x in enumerate(words(200))),
        "x_repeats": " ".join([*passage, *words(138), *passage]),
        "x_lines": "\n".join(lines),
        "x_echo": " ".join(x for w in words(100) for x in (w, w)),
    }
    assert planted.keys() == quality.VECTOR.keys()
    texts = [*planted.values(), *clean]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS)
    out = {r.doc_id: r for r in quality.judged(df).collect()}
    assert [i for i, r in out.items() if r.base_failed] == [2]  # repeated windows are for the base rule
    assert [name for i, name in enumerate(planted) if out[i].kept] == []
    assert sum(out[i].kept for i in range(5, 305)) >= 299
    assert out[3].n_repeat_words == out[3].n_echo_words == out[3].n_symbols == 0


def test_columns_of_any_name_are_kept(spark):
    names = ["centre", "precision", "_text", "_l", "grp", "x_lines", "in_0", "distance2", "rows", "text.x"]
    df = spark.createDataFrame([(1, "a b", "en", "a", 0)], DOCS).withColumns({c: F.lit(c) for c in names})
    row = quality.judged(df).head()
    assert all(row[c] == c for c in names if c != "distance2") and row["distance2"] is None
    assert (row["doc_id"], row["lang"], row["n_words"], row["kept"]) == (1, "en", 2, False)


def test_lines_that_share_a_polynomial_hash_are_told_apart():
    first, second = ("".join("ab"[(k.bit_count() + flip) % 2] for k in range(2048)) for flip in (0, 1))
    counts = text_stats(pa.array([f"{first}\n{second}", f"{first}\n{first}", f"{first} {second}"]))
    assert counts["n_dup_lines"].tolist() == [0, 1, 0] and counts["n_echo_words"].tolist() == [0, 1, 0]
