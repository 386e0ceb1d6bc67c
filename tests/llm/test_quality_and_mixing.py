import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm.mixing import hypergeometric, mix, mixture, permuted_draws, split_node, split_quotas, uniform
from foliospark.llm.quality_rules import host_counts, host_verdicts, keep_good, quality_rules
from tests_llm_truth import measures

def test_rules_against_brute_force(edge_docs, edge_rows, no_docs):
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(edge_docs).collect())
    assert got == sorted((i, *measures(t)) for i, t, *_ in edge_rows)
    assert quality_rules(no_docs).count() == 0


def test_host_verdicts_shrink(spark):
    rows = [("good", i % 10 == 0, False) for i in range(3000)] + [("bad", i % 50 != 0, False) for i in range(500)] + [("tiny", True, True)] + [(None, False, i < 2) for i in range(40)]
    tried = spark.createDataFrame(rows, "host string, w boolean, s boolean").select("host", F.struct(F.col("w").alias("words"), F.lit(False).alias("repeats"), F.col("s").alias("symbols"), F.lit(False).alias("lines")).alias("failures"))
    v = {r.host: r for r in host_verdicts(host_counts(tried)).collect()}
    assert v["good"].host_ok and not v["bad"].host_ok and v["tiny"].host_ok and v[None].host_ok
    assert v["tiny"].rate_words < 0.9 and v["tiny"].rate_symbols < 0.9
    assert v["good"].habit_words and not v["good"].habit_symbols and not v["good"].habit_lines and v[None].habit_symbols


def test_bad_hosts_lose_their_documents(spark):
    clean = " ".join(f"w{k}" for k in range(40))
    rows = [(i, clean if i % 40 == 0 else "x", "bad") for i in range(400)] + [(1000 + i, clean, "good") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality_rules(docs).where("kept").collect()}
    assert kept == {1000 + i for i in range(400)} == {r.doc_id for r in keep_good(docs).collect()}
    assert keep_good(docs).columns == docs.columns and keep_good(docs.limit(0)).count() == 0


def test_habits_decide_on_symbols_and_lines(spark, edge_docs):
    """A failure that is a host's habit counts, a lone one is forgiven, and a host of symbols goes with its clean documents."""
    words = [f"w{k}" for k in range(40)]
    clean, symbols = " ".join(words), " ".join(w + "$$$" for w in words)
    lines = "\n".join(["same"] * 4 + [clean])
    rows = [(i, symbols if i % 10 == 0 else lines if i == 1 else clean, "habit") for i in range(500)] + [(1000 + i, symbols if i == 0 else clean, "lone") for i in range(500)]
    rows += [(2000 + i, clean if i % 40 == 0 else symbols, "junk") for i in range(400)] + [(3000, None, "lone"), (3001, clean, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as row", "2 as host", "3 as failures", "4 as kept")
    out = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert not out[0].kept and out[1].kept and out[2].kept and out[1000].kept and out[1000].failures.symbols and not out[0].base_failed
    assert not out[2000].host_ok and not out[2000].kept and not out[3000].kept and out[3001].kept
    good = keep_good(docs)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {i for i, r in out.items() if r.kept}
    assert keep_good(edge_docs).columns == edge_docs.columns


def water_fill(sizes):
    """The contract's resharing, round by round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


@pytest.mark.parametrize("n_small", [1, 30])
def test_mixing(spark, n_small):
    rows = [(i, "w " * (i % 37 + 1), "hot") for i in range(3000)] + [(10_000 + i, "w " * 5, "a") for i in range(n_small)] + [(20_000 + i, "w " * (i % 11), "b") for i in range(800)]
    rows += [(30_000 + i, "w w w", None) for i in range(500)] + [(40_000, None, "zero")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    out = mix(docs, block_docs=64).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert r.taken == r.size * len(r.copies) and r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    sizes = {s: sum(r.size for r in rs) for s, rs in by.items()}
    want = water_fill(sizes)
    for s, rs in by.items():
        assert {r.source_size for r in rs} == {sizes[s]}
        assert abs(rs[0].target - want[s]) < 1e-6 * max(1, want[s])
        assert abs(sum(r.taken for r in rs) - want[s]) <= max(3, 0.01 * want[s])
    again = mix(docs.repartition(3), block_docs=64).collect()
    assert sorted((r.doc_id, r.taken, tuple(r.copies)) for r in out) == sorted((r.doc_id, r.taken, tuple(r.copies)) for r in again)
    shards = Counter(c.shard for r in out for c in r.copies)
    assert len(shards) == 16


def test_quotas_split_exactly(spark):
    quotas = {1: 334, 2: 333, 3: 333, 700: 24}
    rows = split_quotas(spark.createDataFrame(list(quotas.items()), "src long, k long"), 3, 1).collect()
    per_shard, per_source = Counter(), Counter()
    for r in rows:
        per_shard[r.shard] += r.k
        per_source[r.src] += r.k
    assert per_source == quotas and sorted(per_shard.values()) == [128] * 8
    assert len({r.k for r in rows if r.src == 1}) > 1  # random, not proportional
    assert split_quotas(spark.createDataFrame([], "src long, k long"), 3, 1).count() == 0


def test_hypergeometric_law(spark):
    """Counts against the exact law by chi-square, at a significance of about 1e-6, and at the ends of its range."""
    for n, k, m in ((30, 12, 15), (9, 9, 4), (9, 0, 4), (1000, 3, 500), (5, 4, 4), (0, 0, 0)):
        draws = spark.range(6000).select(hypergeometric(F.lit(n), F.lit(k), F.lit(m), uniform(F.lit(3), F.col("id"))).alias("x"))
        got = Counter(r.x for r in draws.collect())
        law = {x: math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m) for x in range(max(0, m - n + k), min(k, m) + 1)}
        assert set(got) <= set(law)
        cells = [x for x in law if 6000 * law[x] >= 5]
        chi = sum((got[x] - 6000 * law[x]) ** 2 / (6000 * law[x]) for x in cells)
        assert chi < len(cells) + 7 * (2 * len(cells)) ** 0.5 + 20, (n, k, m, chi)
    big = spark.range(1).select(hypergeometric(F.lit(2 * 10**7), F.lit(10**7), F.lit(10**7), F.lit(0.5)).alias("x")).first().x
    assert abs(big - 5 * 10**6) < 10


def test_nodes_follow_the_multivariate_law(spark):
    """Over many draws, means and covariances of a node's left counts are those of half of its units drawn at once."""
    quotas = [40, 24, 16]
    members = F.array(*[F.struct(F.lit(j).cast("long").alias("key"), F.lit(k).cast("long").alias("k"), uniform(F.lit(j), F.col("id")).alias("u")) for j, k in enumerate(quotas)])
    rows = spark.range(4000).select(split_node(members, F.lit(40)).alias("s")).collect()
    seen, share = np.array([[e.left for e in r.s] for r in rows], float), np.array(quotas) / 80
    law = 40 * (80 - 40) / (80 - 1) * (np.diag(share) - np.outer(share, share))
    assert (seen.sum(axis=1) == 40).all() and np.abs(seen.mean(axis=0) - 40 * share).max() < 5 * (law.max() / 4000) ** 0.5
    assert np.abs(np.cov(seen.T) - law).max() < 0.12 * law.max()


def test_tree_decides_the_placement(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 5 + 1), f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string")
    placed = {levels: {r.doc_id: tuple(r.copies) for r in mix(docs, block_docs=16, levels=levels).collect()} for levels in (0, 2, 3)}
    assert {c.shard for cs in placed[0].values() for c in cs} == {0}
    assert {c.shard for cs in placed[2].values() for c in cs} == set(range(4)) and {c.shard for cs in placed[3].values() for c in cs} == set(range(8))
    assert all(Counter(c.epoch for c in placed[0][i]) == Counter(c.epoch for c in placed[3][i]) for i in placed[0])
    # blocks are disjoint runs: a draw of a block lies in one shard whole
    laid = mixture(docs, block_docs=16, levels=2).withColumn("p", F.spark_partition_id()).collect()
    shard = {(i, c.order): c.shard for i, cs in placed[2].items() for c in cs}
    assert Counter(r.doc_id for r in laid) == Counter({i: len(cs) for i, cs in placed[2].items() if cs})
    want = {s: [i for (i, o), x in sorted(shard.items(), key=lambda e: e[0][1]) if x == s] for s in range(4)}
    runs = {}
    for r in laid:
        runs.setdefault(r.p, []).append(r.doc_id)
    flat = [i for p in sorted(runs) for i in runs[p]]
    assert all("".join(f"<{i}>" for i in want[s]) in "".join(f"<{i}>" for i in flat) for s in range(4))


def test_draws_are_a_prefix_of_every_sources_permutation(spark):
    blocks = [(1, b, 10 + b % 7, 40, 40 * 13, 700.0) for b in range(40)] + [(2, 0, 5, 1, 5, 15.0), (3, 0, 0, 1, 0, 0.0)]
    frame = spark.createDataFrame(blocks, "src long, block long, words long, n_blocks long, source_size long, target double")
    whole, sliced = (sorted(map(tuple, permuted_draws(frame, 9).collect())) for _ in range(2))
    assert whole == sliced
    words = {(s, b): w for s, b, w, *_ in blocks}
    for src, target in ((1, 700.0), (2, 15.0)):
        rows = sorted((r for r in whole if r[0] == src), key=lambda r: r[3])
        assert [r[3] for r in rows] == list(range(1, len(rows) + 1)) and [r[2] for r in rows] == sorted(r[2] for r in rows)
        left = target
        for _, block, _, _, rest, full in rows:
            assert abs(rest - left) < 1e-6 and full == (words[src, block] <= left)
            left -= words[src, block]
        assert left <= 0
        for epoch in {r[2] for r in rows}:
            drawn = [r[1] for r in rows if r[2] == epoch]
            assert len(set(drawn)) == len(drawn)


def test_null_and_repeated_ids_are_mixed(spark):
    rows = [(None, "a b " * (i % 9 + 1), "s") for i in range(400)] + [(7, "x " * (i % 4 + 1), "s") for i in range(100)] + [(i, "w w w", None) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix(docs, block_docs=32).collect()
    assert len(out) == len(rows)
    for source in ("s", None):
        mine = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.02 * mine[0].target
    assert mixture(docs, block_docs=32).count() == sum(len(r.copies) for r in out)


def test_mixing_edges(edge_docs, no_docs):
    assert mix(edge_docs).count() == edge_docs.count() and mix(no_docs).count() == 0
    assert mixture(edge_docs).columns == edge_docs.columns and mixture(no_docs).count() == 0
