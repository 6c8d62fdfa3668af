"""Benchmark decontamination against a plain scan of all windows."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from barloom.llm import decontaminate

ITEMS = "item_id long, text string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, size):
    """A row a document: id, words, hit words, item ids; every window of every item at every place."""
    known = {}
    for item, text in items:
        w = cut(text)
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            known.setdefault(tuple(w[i : i + size]), set()).add(None if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, names = cut(text), set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(w) - n + 1):
                if found := known.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    names |= found - {None}
        out.append((doc, len(w), len(hit), tuple(sorted(names))))
    return sorted(out, key=repr)


def reported(spark, docs, items, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = decontaminate.report(df, spark.createDataFrame(items, ITEMS), **options).collect()
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in rows)
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in rows), key=repr)


PASSAGE = "Alpha beta, gamma delta; epsilon zeta eta theta iota kappa lambda mu. Nu xi"


def test_report_equals_a_plain_scan(spark):
    rng = random.Random(3)
    few = ["a", "b", "c", "é", "7"]
    docs = [(k, " ".join(rng.choice(few) for _ in range(rng.randint(0, 60)))) for k in range(120)]
    items = [(k, "-".join(rng.choice(few) for _ in range(rng.randint(0, 7)))) for k in range(25)]
    assert reported(spark, docs, items, size=4) == plain(docs, items, 4)


def test_awkward_rows(spark):
    docs = [
        (1, None), (2, ""), (3, " ,;\n\x00"), (4, f"before {PASSAGE.upper()} after"), (4, f"before {PASSAGE.upper()} after"),
        (4, "another text under the same id"), (None, PASSAGE), (None, "clean"), (5, "alphabeta gamma"),
        (6, " ".join(["filler"] * 30_000) + " " + PASSAGE), (7, "solo"), (8, "Ünï 你好 ÜNÏ"), (9, PASSAGE.replace("theta", "thêta")),
    ]
    items = [(1, PASSAGE), (1, PASSAGE), (2, PASSAGE), (None, PASSAGE), (3, None), (4, ""), (5, "..."), (10, "Solo!"), (11, "ünï")]
    expected = plain(docs, items, 10)
    assert reported(spark, docs, items) == expected
    assert (4, 16, 14, ("1", "2")) in expected and (7, 1, 1, ("10",)) in expected


def test_without_items_and_without_texts(spark):
    docs = [(1, PASSAGE), (2, None)]
    assert reported(spark, docs, []) == plain(docs, [], 10)
    assert reported(spark, [], [(1, PASSAGE)]) == []
    assert reported(spark, [], []) == []


def test_equal_hashes_are_told_apart_by_words(spark, monkeypatch):
    """With one hash for all windows only the comparison of words is left."""
    monkeypatch.setattr(decontaminate, "_window_hash", lambda hashes, start, length: F.lit(12345).cast("long"))
    docs = [(1, f"x {PASSAGE} y"), (2, "ten other words that are no test item at all here today"), (3, "one two three")]
    items = [(1, PASSAGE), (2, "two")]
    assert reported(spark, docs, items) == plain(docs, items, 10)


def test_shuffled_windows_give_the_same(spark, monkeypatch):
    docs = [(k, f"w{k} {PASSAGE} w{k}" if k % 3 else f"w{k}") for k in range(30)]
    items = [(1, PASSAGE), (2, "w3"), (3, "unseen words")]
    expected = plain(docs, items, 10)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    assert reported(spark, docs, items) == expected
    monkeypatch.setattr(decontaminate, "MOST_BITS", 7)
    assert reported(spark, docs, items) == expected


def test_a_passage_in_every_text_and_in_many_items(spark):
    docs = [(k, f"own{k} {PASSAGE}") for k in range(400)]
    items = [(k, PASSAGE) for k in range(60)]
    rows = reported(spark, docs, items)
    assert len(rows) == 400 and all(r[2] == 14 and len(r[3]) == 60 for r in rows)


@pytest.fixture
def dirty(spark):
    rows = [
        (1, f"Kept start. {PASSAGE}! Kept end.", "a", "x"),
        (2, "Nothing here.\n  At all ", "b", "x"),
        (2, "Nothing here.\n  At all ", "b", "x"),
        (3, None, None, "x"),
        (None, PASSAGE, "c", "x"),
        (None, "clean", "c", "x"),
        (5, f"{PASSAGE} and {PASSAGE} end", "c", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, `key` string").withColumns(
        {name: F.lit("extra") for name in ("items", "hit", "window", "hash", "n_words", "words")}
    )


def test_spans_go_and_the_rest_stays(spark, dirty):
    items = spark.createDataFrame([(1, PASSAGE)], ITEMS)
    out = decontaminate.cleaned(dirty, items)
    assert out.columns == dirty.columns
    texts = sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=repr)
    assert texts == sorted(
        [
            (1, "Kept start. ! Kept end."),
            (2, "Nothing here.\n  At all "),
            (2, "Nothing here.\n  At all "),
            (3, None),
            (None, ""),
            (None, "clean"),
            (5, " and  end"),
        ],
        key=repr,
    )


def test_whole_documents_go(spark, dirty):
    items = spark.createDataFrame([(1, PASSAGE)], ITEMS)
    out = decontaminate.cleaned(dirty, items, whole_documents=True)
    assert out.columns == dirty.columns
    assert sorted([r["doc_id"] for r in out.collect()], key=repr) == sorted([2, 2, 3, None], key=repr)


def test_the_main_path_stays_in_the_jvm(spark):
    docs = spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string")
    found = decontaminate.report(docs, spark.createDataFrame([(1, PASSAGE)], ITEMS))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)
    assert plan.count("Exchange hashpartitioning") == 1
