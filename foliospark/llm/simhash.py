"""Operator 10, SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are taken once per document; from there on only distinct fingerprints count. Their 64 bits are grouped into
parts, correlated bits together; a dynamic program gives each part its own threshold, the thresholds adding up to
most_bits - parts + 1, by estimated candidate counts over all fingerprints. Two fingerprints within most_bits then agree within
its threshold in one part at least: candidates meet in a bucket of that part and are verified on all bits. Buckets emit a
spanning forest of their links, and buckets with many members are dealt in pairs of chunks, so no group is ever whole in
one task and no dense group emits all its pairs.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import components, delete_stored, slices, stored

SHINGLE = 4
SEED = 42
#: Rows of a chunk of a large bucket.
CHUNK = 1024
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text: str | None) -> list[bytes]:
    """The text's shingles of SHINGLE words in UTF-8, A-Z lower-cased; a shorter text's words together; none without a word."""
    words = text.encode().translate(_LOWER).split() if text else []
    if len(words) < SHINGLE:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)))


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """Signed 64-bit fingerprints: bit j is set if it is set in over half of the shingles' hashes."""
    cut = [shingles(t) for t in texts]
    sizes = np.array([len(c) for c in cut], np.int64)
    out = np.zeros(len(texts), np.int64)
    weights = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
    full = np.flatnonzero(sizes)
    for at in np.array_split(full, max(1, int(sizes.sum() >> 17))):
        if not len(at):
            continue
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, (s for i in at for s in cut[i]), repeat(SEED)), np.uint64, int(sizes[at].sum()))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(sizes[at])[:-1]]), axis=0, dtype=np.int64)
        out[at] = ((2 * counts > sizes[at][:, None]) * weights).sum(axis=1, dtype=np.uint64).view(np.int64)
    return out


def fingerprint_table(docs: DataFrame, id_col: str, text_col: str, *keep: Column) -> DataFrame:
    """(id, the columns in keep, fp) of every row of docs."""
    base = docs.select(docs[text_col].cast("string").alias("__text"), docs[id_col].alias("id"), *keep)

    def run(batches):
        for batch in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fingerprints(batch.column(0).to_pylist()))], names=[*batch.schema.names[1:], "fp"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields[1:])
    return base.mapInArrow(run, f"{fields}, fp long")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many both bit i and bit j are set: 64 x 64 sums, added up by Spark."""

    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            fp = batch.column(0).to_numpy().astype("<i8")
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(fp)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097, dtype=np.int32)), pa.array(np.append(total.reshape(-1), n).astype(np.int64))], names=["cell", "n"])

    rows = distinct.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4,097 rows at most
    cells = np.zeros(4097)
    for r in rows:
        cells[r["cell"]] = r["n"]
    return int(cells[4096]), cells[:4096].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in parts of like size, correlated bits together (greedily)."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    left, groups = set(range(64)), []
    for k in range(parts):
        size = (64 - sum(map(len, groups))) // (parts - k)
        rest = sorted(left)
        group = [max(rest, key=lambda j: (tie[j, rest].sum(), -j))]
        while len(group) < size:
            group.append(max((j for j in rest if j not in group), key=lambda j: (tie[j, group].sum(), -j)))
        groups.append(sorted(group))
        left -= set(group)
    return groups


def expected_candidates(n: int, both: np.ndarray, group: list[int], same: float, most: int) -> list[float]:
    """Pairs that agree on the group's bits but for at most t, for t = 0..most, from the pairs that agree on all of them.

    same is counted exactly; each further bit that may differ multiplies by that bit's odds of differing.
    """
    p = both.diagonal()[group] / max(n, 1)
    odds = np.minimum(2 * p * (1 - p) / np.maximum(p * p + (1 - p) ** 2, 1e-9), 1.0)
    poly = [1.0] + [0.0] * most
    for o in odds:
        for t in range(most, 0, -1):
            poly[t] += poly[t - 1] * o
    return [(same + 1) * x for x in np.cumsum(poly)]


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds of at least -1 (part unused) that add up to total with the least cost; costs[k][t] is part k's at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for k, cost in enumerate(costs):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t in range(-1, len(cost)):
                at = (c + (cost[t] if t >= 0 else 0.0), [*chosen, t])
                if used + t not in nxt or at < nxt[used + t]:
                    nxt[used + t] = at
        best = nxt
    return best[total][1]


def gathered(fp: Column, group: list[int]) -> Column:
    """The group's bits of fp side by side."""
    out = F.lit(0).cast("long")
    for place, bit in enumerate(group):
        moved = F.shiftrightunsigned(fp, bit).bitwiseAND(F.lit(1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(moved, place))
    return out


def probes(distinct: DataFrame, groups: list[list[int]], limits: list[int]) -> DataFrame:
    """(part, key, fp): the bucket of each fingerprint in each part, and those with up to the part's threshold of set bits cleared.

    Fingerprints that differ in at most t bits of a part meet where the differing bits are cleared on either side.
    """
    found = None
    for k, (group, limit) in enumerate(zip(groups, limits, strict=True)):
        if limit < 0:
            continue
        key = gathered(F.col("fp"), group)
        masks = [sum(1 << j for j in js) for c in range(limit + 1) for js in combinations(range(len(group)), c)]
        rows = distinct.select("fp", key.alias("part_bits"))
        if len(masks) > 1:
            set_masks = F.filter(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.col("part_bits").bitwiseAND(m) == m)
            rows = rows.select("fp", F.explode(F.transform(set_masks, lambda m: F.col("part_bits").bitwiseXOR(m))).alias("key"))
        else:
            rows = rows.select("fp", F.col("part_bits").alias("key"))
        rows = rows.select(F.lit(k).alias("part"), "key", "fp")
        found = rows if found is None else found.union(rows)
    return found


def linked(values: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among values (unsigned: numpy counts bits of magnitudes), breadth first: each value is met once."""
    rest, a, b = np.unique(values), [], []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= most_bits
            if near.any():
                hit = rest[near]
                a.append(np.full(len(hit), at)), b.append(hit)
                front.extend(hit)
                rest = rest[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (values[:0], values[:0])


def bucket_links(starts: np.ndarray, fps: np.ndarray, most_bits: int, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links of consecutive buckets that begin at starts: small ones all at once, shift by shift, larger ones by linked()."""
    sizes = np.diff(np.append(starts, len(fps)))
    left = np.repeat(starts + sizes, sizes) - np.arange(len(fps)) - 1  # rows that follow in the bucket
    left[np.repeat(sizes > small, sizes)] = 0
    a, b, at = [], [], np.flatnonzero(left)
    for shift in range(1, small):
        at = at[left[at] >= shift]
        if not len(at):
            break
        near = np.bitwise_count(fps[at] ^ fps[at + shift]) <= most_bits
        a.append(fps[at[near]]), b.append(fps[at[near] + shift])
    for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        x, y = linked(fps[s : s + n], most_bits)
        a.append(x), b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def links(distinct: DataFrame, most_bits: int = 4, parts: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all that lie within most_bits of each other."""
    distinct = distinct.select("fp")
    n, both = bit_statistics(distinct)
    parts = parts or (4 if n < 1 << 22 else 3 if n < 1 << 27 else 2)
    parts = min(parts, most_bits + 1)
    groups = group_bits(n, both, parts)
    exact = probes(distinct, groups, [0] * parts).groupBy("part", "key").count()
    same = {r["part"]: float(r["pairs"]) for r in exact.groupBy("part").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    limits = allocate([expected_candidates(n, both, g, same.get(k, 0.0), most_bits) for k, g in enumerate(groups)], most_bits - parts + 1)

    rows = probes(distinct, groups, limits)
    large = rows.groupBy("part", "key").count().where(F.col("count") > 2 * CHUNK).select(F.col("part").alias("l_part"), F.col("key").alias("l_key"), F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    rows = rows.join(large, (F.col("part") == F.col("l_part")) & (F.col("key") == F.col("l_key")), "left")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pair = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: F.least(own, other) * F.col("chunks") + F.greatest(own, other))
    )
    dealt = rows.select("part", "key", F.explode(pair).alias("pair"), "fp").repartition("part", "key", "pair").sortWithinPartitions("part", "key", "pair")

    def run(batches):
        held = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            new = np.ones(len(cols[0]), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)
            starts = np.flatnonzero(new)
            held = [c[starts[-1] :] for c in cols]
            if starts[-1]:
                yield out(starts[:-1], cols[3][: starts[-1]].view(np.uint64))
        if held is not None:
            yield out(np.array([0]), held[3].view(np.uint64))

    def out(starts, fps):
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in bucket_links(starts, fps, most_bits)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def grouped(fps: DataFrame, most_bits: int) -> DataFrame:
    """fps (id, fp, ...) with component, a fingerprint of its group, and component_id, the smallest id of that.

    The tables that are joined back were written before, so that both sides are dealt for their join alone: small they are
    broadcast by size, and of larger ones adaptive execution splits a large component.
    """
    nodes = stored(fps.groupBy(F.col("fp").alias("n_fp")).agg(F.min("id").alias("least_id")), "nodes")
    found = components(links(nodes.select(F.col("n_fp").alias("fp")), most_bits)).select("node", "component")
    named = stored(nodes.join(found, F.col("n_fp") == F.col("node"), "left").select("n_fp", "least_id", F.coalesce("component", "n_fp").alias("component")), "named")
    least = stored(named.groupBy(F.col("component").alias("c")).agg(F.min("least_id").alias("component_id")), "least")
    label = stored(named.join(least, F.col("component") == F.col("c")).select("n_fp", "component", "component_id"), "label")
    delete_stored(fps.sparkSession, nodes, named, least)
    return fps.join(label, F.col("fp") == F.col("n_fp")).drop("n_fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 4) -> DataFrame:
    """One row per row of docs: the id, fingerprint (16 hexadecimal digits) and component_id, the smallest id reachable.

    Null and wordless texts have fingerprint zero and link like any other; equal texts share a fingerprint; repeated rows stay
    repeated; an empty table gives no rows; columns other than the two named are not read, so names cannot clash. Null ids
    are never the smallest.
    """
    found = grouped(stored(fingerprint_table(docs, id_col, text_col), "fingerprints"), most_bits)
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 4) -> DataFrame:
    """One row of docs, with its columns, of each group: that of the smallest id; of rows that repeat it, one of the least hash.

    Of a group of null ids alone one row stays too. Kept rows are found by id and hash without their texts; texts move only if the
    table of kept ids is too large to broadcast, and where a row stands more than once. Columns of docs may have any names.
    """
    whole = F.xxhash64(*[docs[c] for c in docs.columns])
    found = grouped(stored(fingerprint_table(docs, id_col, text_col, whole.alias("h")), "fingerprints"), most_bits)
    alike = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component", "id", "h").agg(F.count("*").alias("n"))
    first = alike.groupBy("component", "id").agg(F.min(F.struct("h", "n")).alias("k"))
    first = stored(first.select(F.col("id").alias("k_id"), F.col("k.h").alias("k_h"), F.col("k.n").alias("k_n")), "kept")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), whole.alias("h"))
    met = rows.join(first, rows["id"].eqNullSafe(first["k_id"]) & (rows["h"] == first["k_h"]))
    return met.where("k_n = 1").select("row").union(met.where("k_n > 1").dropDuplicates(["id", "h"]).select("row")).select("row.*")
