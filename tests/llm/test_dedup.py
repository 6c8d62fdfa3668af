"""Exact, near and line dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import oracle
import pytest

from barloom.llm import common, components, content_sort, line_dedup, ngram_join, queries
from barloom.llm.oracles import ORACLES

from llm_rows import DOCS, prose

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    rows, found = oracle.differences(queries.REGISTRY[name](spark, FOLDER), oracle.connect(FOLDER), ORACLES[name])
    assert rows and not found, "\n".join(found)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(spark, awkward, empty, keep):
    out = content_sort.groups(awkward, keep=keep).collect()
    rows = awkward.select("doc_id", "text").collect()
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault((r.text or "").translate(LOWER), []).append(r.doc_id)
    pick = min if keep == "smallest" else max
    expected = []
    for text, ids in groups.items():
        stays = pick((i for i in ids if i is not None), default=None)
        expected += [(i, stays, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out], key=key) == sorted(expected, key=key)
    assert sum(r.kept for r in out) == len(groups)
    assert all(r.doc_id == r.keep_id for r in out if r.kept)
    assert content_sort.groups(empty).count() == 0


def test_a_group_over_many_partitions_is_one(spark):
    rows = [(i, "copy" if i % 3 else f"own {i}", None, None, 0) for i in range(600)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = content_sort.groups(df, keep="largest").where("group_size > 1").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(out) == 400 and {(r.group_size, r.keep_id) for r in out} == {(400, 599)}
    assert [r.doc_id for r in out if r.kept] == [599]


def sets(text: str | None, n: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute_components(rows: list, n: int, percent: int) -> dict:
    found = {i: sets(t, n) for i, t in rows}
    label = {i: i for i in found}
    again = True
    while again:
        again = False
        for a, x in found.items():
            for b, y in found.items():
                if a < b and x and y and label[a] != label[b] and 100 * len(x & y) >= percent * len(x | y):
                    low = min(label[a], label[b])
                    for k in (a, b):
                        again |= label[k] != low
                        label[k] = low
    return {i: (len(found[i]), label[i]) for i in found}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, n, percent):
    rng = random.Random(n)
    texts = [None, "", " \n", "one two", "ONE two", "one", prose(50, 3)]
    for g in range(25):
        base = prose(g, rng.randint(5, 160)).split()
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 2, 12])):
            near = list(base)
            for _ in range(rng.randint(0, 6)):
                near[rng.randrange(len(near))] = f"new{rng.randint(0, 99)}"
            texts.append(" ".join(near))
    shared = prose(99, 60)  # a passage in many texts
    texts += [shared + " " + prose(1000 + i, rng.choice([2, 30, 90])) for i in range(40)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = ngram_join.near_duplicates(df, n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, n, percent)
    assert len({r.component_id for r in out}) < len(rows)


def test_blocks_of_a_token_lose_no_pair(spark, monkeypatch):
    """Families that share passages, with tokens cut into blocks of two."""
    rng = random.Random(11)
    rows, bases = [], [prose(900 + g, 80).split() for g in range(3)]
    for i in range(60):
        words = list(bases[i % 3])
        for _ in range(rng.randint(0, 30)):
            words[rng.randrange(len(words))] = f"own{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    monkeypatch.setattr(ngram_join, "PLACE", 2)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, 3, 80).collect()}
    assert out == brute_components(rows, 3, 80)


def test_near_duplicates_of_awkward_rows(spark, awkward, empty):
    out = ngram_join.near_duplicates(awkward, 3, 90).collect()
    assert len(out) == awkward.count()
    label = {r.doc_id: r.component_id for r in out if r.doc_id}
    assert label[5] == label[6] == label[7] == 5
    assert all(label[i] == i for i in (1, 2, 3, 4, 8, 9, 10, 11))
    assert ngram_join.near_duplicates(empty).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a long, b long")
    out = {r.id: r.label for r in components.components(links).collect()}
    assert out == {**dict.fromkeys(range(1, 61), 1), 100: 100, 101: 100}


def test_lines_that_repeat_are_deleted_once(spark, awkward, empty):
    out = {r.doc_id: r for r in line_dedup.dedup(awkward).where("doc_id is not null").collect()}
    assert out[10].n_deleted == 0 and out[10].n_lines == 4
    assert out[11].text == "start" and out[11].n_deleted == 3
    assert out[1].text is None and out[2].text == ""
    assert line_dedup.dedup(empty).count() == 0


def test_native_plan_and_extra_columns(spark, awkward):
    df = line_dedup.dedup(awkward)
    assert set(awkward.columns) < set(df.columns)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_one_copy_of_every_line_stays(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(f"line {rng.randint(0, 12)}" for _ in range(rng.randint(0, 14)))) for i in range(60)]
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    lines = lambda texts: {x for t in texts for x in t.split("\n")} - {""}
    assert lines(t for _, t in rows) == lines(r.text for r in out)
    assert sum(r.n_deleted for r in out)


def repeated_by_brute_force(rows: list, words: int) -> tuple[dict, dict]:
    """By document: places of long lines that stood earlier, and places of lines in a repeated run of two or more."""
    texts = {i: t.split("\n") for i, t in rows}
    every = [(i, k) for i in sorted(texts) for k in range(len(texts[i]))]
    long, runs = {i: set() for i in texts}, {i: set() for i in texts}
    for n, (i, k) in enumerate(every):
        for j, m in every[:n]:
            if texts[i][k] == texts[j][m]:
                if len(texts[i][k].split()) >= words:
                    long[i].add(k)
                if texts[i][k + 1 : k + 2] and texts[i][k + 1 : k + 2] == texts[j][m + 1 : m + 2]:
                    runs[i] |= {k, k + 1}
    return long, runs


def test_long_lines_that_stood_earlier_go_alone_or_in_runs(spark):
    rng = random.Random(9)
    passages = [prose(500 + k, 60) for k in range(6)]
    rows = [(1, passages[0]), (2, passages[0]), (3, f"own\n{passages[1]}\nlast"), (4, f"other\n{passages[1]}\nend"), (5, prose(700, 49)), (6, prose(700, 49))]
    for i in range(7, 45):
        rows.append((i, "\n".join(rng.choice([rng.choice(passages), f"short {rng.randint(0, 9)}", f"own {i} {k}"]) for k in range(rng.randint(1, 7)))))
    out = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    long, runs = repeated_by_brute_force(rows, line_dedup.LONG_WORDS)
    assert out[1] == passages[0] and out[2] == "" and out[4] == "other\nend" and out[5] == out[6] == prose(700, 49)
    for i, text in rows:
        lines, kept = text.split("\n"), out[i].split("\n") if out[i] else []
        sure = [x for k, x in enumerate(lines) if k not in long[i] | runs[i]]
        assert [x for x in kept if x in sure] == [x for x in lines if x in sure]  # nothing else goes
        first = [x for k, x in enumerate(lines) if k not in long[i]]
        assert sum(x in passages for x in kept) == sum(x in passages for x in first)  # and all long copies do


def test_every_long_run_of_a_later_document_is_found(spark):
    rows = [(1, "\n".join(f"a{i}" for i in range(30)))]
    rows += [(k, "\n".join([f"own{k}", *(f"a{i}" for i in range(k, k + 3)), f"end{k}"])) for k in range(2, 25)]
    out = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].n_deleted == 0
    assert all(out[k].text == f"own{k}\nend{k}" for k in range(2, 25))


def without(rows: list, run: int, words: int | None) -> dict:
    """Texts without the lines of runs, and without long lines, that stood earlier: every place against all before it."""
    texts = {i: t.split("\n") for i, t in sorted(rows)}
    places = {i: [k for k, x in enumerate(t) if x.strip(" ")] for i, t in texts.items()}
    seen, gone = set(), set()
    for i, filled in places.items():
        for n, k in enumerate(filled):
            here = [filled[n : n + run]] if len(filled) >= n + run else []
            here += [[k]] if words and len(re.findall(line_dedup.WORD, texts[i][k])) >= words else []
            for part in here:
                body = tuple(texts[i][p] for p in part)
                gone |= {(i, p) for p in part if body in seen}
                seen.add(body)
    return {i: "\n".join(x for k, x in enumerate(t) if (i, k) not in gone) for i, t in texts.items()}


@pytest.mark.parametrize(("gram", "window", "words"), [(1, 2, 50), (2, 2, None), (3, 4, 20), (1, 1, None)])
def test_exactly_repeated_runs_and_long_lines_go(spark, gram, window, words):
    rng = random.Random(17)
    lines = [f"s{k}" for k in range(7)] + ["", " ", "\t"] + [prose(800 + k, rng.choice([19, 20, 49, 50, 51])) for k in range(5)]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.7 else f"own {i} {k}" for k in range(rng.randint(1, 30)))) for i in range(70)]
    rows.append((70, "\n".join(["s1", "s1", "s2"] * 400)))  # one line after the other, and within one document
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = {r.doc_id: r.text for r in line_dedup.dedup(df, gram=gram, window=window, long_words=words).collect()}
    assert out == without(rows, gram + window - 1, words)


def test_a_run_is_found_whichever_document_holds_its_start_first(spark):
    rows = []
    for k in range(20):
        a, b, c = (f"{name} of {k}" for name in "ABC")
        rows += [(10 * k + 1, f"{a}\n{b}\nown {k}"), (10 * k + 2, f"{a}\n{b}\n{c}"), (10 * k + 3, f"{a}\n{b}\n{c}")]
    out = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[10 * k + 2] == f"C of {k}" and out[10 * k + 3] == "" for k in range(20))


def test_runs_name_their_sources(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny\nc\nd")]
    found = line_dedup.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc.id, r.source.id, r["shift"], [tuple(x) for x in r.runs]) for r in found) == [(2, 1, 1, [(1, 3)]), (2, 1, 3, [(5, 6)])]


@pytest.mark.parametrize("letters", [1024, 2048])
def test_words_that_share_a_polynomial_hash_make_no_link(spark, letters):
    first, second = ("".join("ab"[(k.bit_count() + flip) % 2] for k in range(letters)) for flip in (0, 1))
    rows = [(1, first), (2, second), (3, f"one {first} two three"), (4, f"one {second} two three"), (5, f"ONE {first} two three")]
    out = {r.doc_id: r for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=3, percent=90).collect()}
    assert {k: r.component_id for k, r in out.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_keyed_hashes_are_those_of_the_spans_wherever_they_stand(monkeypatch):
    data = np.frombuffer(b"ab abc ab " + b"xy" * 700 + b" abc", np.uint8)
    starts, ends, _ = common.word_spans(data, np.array([0, len(data)]))
    whole = common.keyed_hashes(data, starts, ends)
    assert len(set(whole.tolist())) == 3 and whole[0] == whole[2] and whole[1] == whole[4]
    monkeypatch.setattr(common, "_SEGMENT", 256)
    assert common.keyed_hashes(data, starts, ends).tolist() == whole.tolist()
