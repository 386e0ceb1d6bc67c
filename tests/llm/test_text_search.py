import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import decontaminate as D
from foliospark.llm import licence_scan as L
from foliospark.llm import repeats as R
from foliospark.llm import simhash as S
from foliospark.llm.licence_notices import IDENTIFIERS, TEXTS, notices
from tests_llm_truth import fingerprint, least_ids

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# simhash -------------------------------------------------------------------------------------------------------------


def test_fingerprints(edge_rows):
    texts = [t for _, t, *_ in edge_rows if t is None or len(t) < 1000]
    assert [int(x) % (1 << 64) for x in S.fingerprints(texts)] == [fingerprint(t) for t in texts]


@pytest.mark.parametrize("parts", [2, 3, 4, 5])
def test_links_reach_all_neighbours(spark, parts):
    rng = np.random.default_rng(parts)
    fps = {int(x) for x in rng.integers(0, 1 << 64, 300, np.uint64)}
    for base in list(fps)[:60]:
        chain = base
        for _ in range(6):
            for b in rng.integers(0, 64, int(rng.integers(1, 6))):
                chain ^= 1 << int(b)
            fps.add(chain)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    limit = 4
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = S.links(frame, limit, parts)
    from foliospark.llm.common import components

    found = {r.node: r.component for r in components(edges).collect()}
    want = least_ids(signed, fps, limit)
    groups = {}
    for x in signed:
        groups.setdefault(found.get(x, x), set()).add(x)
    expected = {}
    for x in signed:
        expected.setdefault(want[x], set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_large_buckets_are_dealt_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 16)
    base = 0x123456789ABCDEF
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)})
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    from foliospark.llm.common import components

    edges = S.links(frame, 4)
    assert {r.component for r in components(edges).collect()} == {min(fps)}


def test_allocation():
    assert S.allocate([[5, 9], [1, 50], [7, 8]], 0) in ([0, 0, 0], [1, 0, -1], [-1, 0, 1])
    assert sum(S.allocate([[5.0, 9, 20]] * 4, 1)) == 1


def test_near_duplicates_and_edges(edge_docs, edge_rows, no_docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(edge_docs).collect()}
    fps = {i: fingerprint(t) for i, t, *_ in edge_rows}
    want = least_ids(list(fps), list(fps.values()), 4)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert S.near_duplicates(edge_docs).count() == len(edge_rows) and S.near_duplicates(no_docs).count() == 0
    kept = S.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_one_of_each_of_repeated_and_null_ids(spark):
    """A repeated id may stand for several groups; a row that stands twice is kept once; null ids group among themselves."""
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(1, words(0)), (2, words(0)), (1, words(1)), (3, words(2)), (3, words(2)), (None, words(3)), (None, words(3)), (None, words(0)), (9, words(4)), (4, words(4)), (9, words(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as row", "3 as component", "4 as n")
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    want = Counter([(1, words(0)), (1, words(1)), (3, words(2)), (None, words(3)), (4, words(4)), (9, words(5))])
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want


# repeated passages ---------------------------------------------------------------------------------------------------


def passages(texts, least):
    words = {i: (t or "").encode().lower().split() if (t or "").isascii() else (t or "").translate(LOWER).encode().split() for i, t in texts.items()}
    seen = Counter(tuple(w[k : k + least]) for w in words.values() for k in range(len(w) - least + 1))
    out = set()
    for i, w in words.items():
        runs = []
        for k in range(len(w) - least + 1):
            if seen[tuple(w[k : k + least])] > 1:
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + least
                else:
                    runs.append([k, k + least])
        out |= {(i, a, b) for a, b in runs}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeats_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 60, n)]
    shared = [word(int(n)) for n in rng.integers(8, 60, 12)]
    texts = {}
    for i in range(120):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            parts += shared[int(rng.integers(12))] if rng.random() < 0.5 else word(int(rng.integers(1, 40)))
        texts[i] = " ".join(parts)
    texts[500] = texts[3]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    least = 20
    assert {(r.doc_id, r.begin, r.end) for r in R.repeated_passages(docs, least=least).collect()} == passages(texts, least)


def test_repeats_edges(edge_docs, edge_rows, no_docs):
    texts = {i: t for i, t, *_ in edge_rows}
    assert {(r.doc_id, r.begin, r.end) for r in R.repeated_passages(edge_docs).collect()} == passages(texts, 50)
    assert R.repeated_documents(no_docs).count() == 0


def test_repeats_of_null_and_repeated_ids(spark):
    """Rows are told apart by id and text: a null id, and an id that stands with two texts, hide no repeat and invent none."""
    w = lambda k, n: [f"p{k}x{j}" for j in range(n)]
    long, second, third = w(0, 80), w(1, 65), w(2, 60)
    rows = [(1, long), (None, [*w(10, 20), *long, *w(11, 9)]), (None, [*w(12, 5), *second]), (2, [*second, *w(13, 30)]), (3, [*third, *w(14, 3)]), (3, [*w(15, 7), *third]), (4, w(16, 90)), (4, w(16, 90)), (5, w(17, 70)), (5, [*w(17, 70), "end"])]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string").repartition(3)
    found = sorted((r.doc_id or 0, r.begin, r.end) for r in R.repeated_passages(docs).collect())
    assert found == sorted([(1, 0, 80), (0, 20, 100), (0, 5, 70), (2, 0, 65), (3, 0, 60), (3, 7, 67), (5, 0, 70), (5, 0, 70)])
    assert R.repeated_documents(docs).count() == 8


def test_neighbours_beyond_partitions(spark, monkeypatch):
    """Every pair of neighbours is compared, wherever the range partition cuts: one suffix a partition, and many equal ones."""
    texts = {k: " ".join([*(f"a{j}" for j in range(30)), *(f"b{k % 4}x{j}" for j in range(30)), *(f"c{k}x{j}" for j in range(20))]) for k in range(24)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for parts in ("1", "7", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert {(r.doc_id, r.begin, r.end) for r in R.repeated_passages(docs, least=20).collect()} == passages(texts, 20), parts
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# decontamination -----------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefghij"), min_size=1, max_size=12), min_size=1, max_size=14), st.lists(st.sampled_from("abcdefghijxyz"), min_size=1, max_size=60), st.sampled_from([0.3, 0.6, 0.9]))
def test_search_finds_all_above_threshold(items, passage, threshold):
    index = D.ItemIndex([(k, " ".join(w)) for k, w in enumerate(items)], threshold)
    rows = index.passages(passage)
    found = {(int(p), int(i)) for p, i, _ in zip(*index.search(rows), strict=True)}
    cells = dict(zip(index.keys.tolist(), index.cells, strict=False))
    for direct in (index.direct, None):
        index.direct = direct
        assert {(int(p), int(i)) for p, i, _ in zip(*index.search(rows), strict=True)} == found
    for p, row in enumerate(rows):
        terms = set(row.tolist()) - {index.none}
        for d in range(len(items)):
            score = sum(float(cells[t * index.n_blocks + d // D.BLOCK][d % D.BLOCK]) for t in terms if t * index.n_blocks + d // D.BLOCK in cells)
            if abs(score - threshold) > 1e-3:
                assert ((p, d) in found) == (score >= threshold)


def test_contamination(spark, edge_docs, no_docs, monkeypatch):
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    items = [(i, " ".join(word(30)) + ". " + " ".join(word(5)) + ".") for i in range(25)] + [(98, None), (99, "")]
    rows = []
    for i in range(60):
        text = word(200)
        if i % 3 == 0:
            item = items[i % 25][1].split()
            if i % 2:
                item[10] = "changed"
            at = int(rng.integers(0, 150))
            text[at:at] = [w.upper() for w in item]
        elif i % 3 == 1:
            text[50:50] = items[i % 25][1].split()[:15]  # half an item is none
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, i % 25) for i in range(0, 60, 3)}
    assert {(r.doc_id, r.item_id) for r in D.contamination(docs, bench).collect()} == want
    monkeypatch.setattr(D, "INDEX_BYTES", 500)  # many indexes, one after another
    assert {(r.doc_id, r.item_id) for r in D.contamination(docs, bench).collect()} == want
    assert {r.doc_id for r in D.decontaminated(docs, bench).collect()} == set(range(60)) - {i for i, _ in want}
    assert D.contamination(edge_docs, bench).count() == 0 and D.contamination(no_docs, bench).count() == 0
    assert D.contamination(docs, bench.limit(0)).count() == 0
    assert D.decontaminated(edge_docs, bench).columns == edge_docs.columns


def test_words_between_question_and_answer(spark):
    """The seam's shingles are lost: 4 of 12 here, so that the whole item's share is below 0.8."""
    items = [(k, " ".join(f"q{k}x{i}" for i in range(12)) + "? " + " ".join(f"a{k}x{i}" for i in range(4)) + ".") for k in range(20)]
    rows = []
    for k, text in items:
        question, answer = text.split("? ")
        for gap in (1, 8):
            for before in range(0, 48, 5):  # wherever the passages' limits fall
                rows.append((len(rows), " ".join([*["w"] * before, question, *["Answer:"] * gap, answer, *["w"] * 60]), k))
    rows += [(10_000 + k, text.split("? ")[0] + " " + "w " * 60, None) for k, text in items]  # no answer
    docs = spark.createDataFrame(rows, "doc_id long, text string, item long")
    found = D.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, k) for i, _, k in rows if k is not None} and max(r.overlap for r in found) < 0.8


def test_items_under_five_words(spark):
    items = [(1, "zeta"), (2, "Alpha beta."), (3, "one? two three four"), (4, " ".join(f"k{i}" for i in range(20)))]
    fill = " ".join(f"f{i}" for i in range(90))
    rows = [(1, f"{fill} Zeta {fill}"), (2, f"{fill} alpha, beta {fill}"), (3, f"{fill} one two three four {fill}"), (4, f"{fill} beta alpha two three four one {fill}"), (5, "alpha beta"), (6, "alpha"), (7, fill)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contamination(docs, bench).collect()} == {(1, 1), (2, 2), (3, 3), (5, 2)}




# licences ------------------------------------------------------------------------------------------------------------


def licence_truth(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    places = [(k, label) for phrase, label in L.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    labels = {label for _, label in places}
    score = 1.0 if places else 0.0
    for t in L.templates():
        for start in range(-len(t["words"]), len(words)):
            met = [r for r in t["words"] if 0 <= start + r["p"] < len(words) and words[start + r["p"]] == r["w"]]
            if sum(r["must"] for r in met) == sum(r["must"] for r in t["words"]) and sum(r["idf"] for r in met if r["rare"]) >= L.SHARE * t["weight"] - 1e-9:
                labels.add(t["label"])
                score = max(score, min(1.0, sum(r["idf"] for r in met) / t["all"]))
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), round(score, 6)


def test_notices_are_sound():
    """Every notice is found in its own text, and the gate lets through every text that can hold one."""
    assert len(notices()) > 64 and len({(n, tuple(w)) for n, w, _ in notices()}) == len(notices())
    for _, words, phrases in notices():
        assert any(re.search(L.ANY, " ".join(p)) for p in phrases), phrases
        assert all(any(words[i : i + len(p)] == p for i in range(len(words))) for p in phrases)
    assert all(re.search(L.ANY, phrase) for phrase, _ in L.BASE)


def test_licences(spark, edge_docs, edge_rows, no_docs):
    texts = [
        "Licensed under CC BY-NC 4.0.", "cc by cc by CC-BY", "x. Released under the MIT License. All rights  reserved! all rights reserved", "This work is licensed under the GNU General Public License, version 3.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Licensed under the Apache License, Version 2.0", "license", "apache license version 3",
        "Éß all rights reserved", "redistribution and use in source and binary forms with modification", *[n for _, n, _ in TEXTS], " ".join(n for _, n, _ in TEXTS) * 2,
        *[f"# SPDX-License-Identifier: {i}\nint x;" for i in IDENTIFIERS], "SPDX-License-Identifier:", "license identifier MIT", TEXTS[4][1].replace("merge", "join").replace("furnished", "given"),
    ]
    rows = list(enumerate(texts)) + [(100 + i, t) for i, t, *_ in edge_rows[:7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (*r[1:7], round(r.score, 6)) for r in L.licence_scan(docs).collect()}
    assert got == {i: licence_truth(t) for i, t in rows}
    assert L.licence_scan(edge_docs).count() == len(edge_rows) and L.licence_scan(no_docs).count() == 0
