"""Operator 9, quality rules with a host-level verdict.

Each document is measured in its own row, with array functions only, and tried by four rules: too few words, repeated words,
symbols, repeated lines. Failures are counted per host and rule with partial aggregation; for every rule a beta prior is
fitted to the hosts' rates by moments, and each host's rate is shrunk to it. The verdicts go back to the documents: a host
that surely fails one rule on over max_rate of its documents is turned down with all of them; where a host's shrunk rate of a
rule lies above `habit`, its documents that fail the rule go, and where it lies below, a lone failure of symbols or lines is
forgiven. Few words and repeated words (base_failed) are never forgiven.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import SPACE, let, stored, words_of

WINDOW = 5
#: Symbols in % of word characters, repeated lines in % of lines, above which a text fails. No document labelled good lies above either.
SYMBOLS, DUP_LINES = 5, 50
RULES = ("words", "repeats", "symbols", "lines")
#: A host's documents failing one rule beyond which the host goes; the share beyond which failing it is the host's habit.
MAX_RATE, HABIT, SURE = 0.5, 0.02, 2.0


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """How many words stand in k-word windows that occur twice or more in the array, first occurrences included.

    Windows are compared by 64-bit hashes. Texts without a repeat, the usual case, end at one distinct count; the others
    sort (hash, place), keep places with an equal neighbour and add up the words that the kept windows cover.
    """

    def covered(hashes: Column) -> Column:
        paired = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
        places = let(
            paired,
            lambda s: F.transform(
                F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"])), lambda e: e["i"]
            ),
        )
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
        step = lambda a, i: F.struct((a["n"] + i + k - F.greatest(i, a["end"])).alias("n"), (i + k).alias("end"))
        return F.aggregate(F.sort_array(places), start, step, lambda a: a["n"])

    hashes = F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k))))
    return F.coalesce(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h))), F.lit(0).cast("long"))


def rule_measures(text: Column) -> Column:
    """A struct of the measures of a text: n_words, word_chars, n_symbols, lines (n, n_dup: lines with words, repeats among them), n_repeat_words (null text: all 0)."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(rf"[^{SPACE}]"))
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
            let(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup"))).alias("lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def failures(m: Column) -> Column:
    """A struct of one boolean per rule, from rule_measures() m."""
    return F.struct(
        (m["n_words"] < 10).alias("words"), (100 * m["n_repeat_words"] > 20 * m["n_words"]).alias("repeats"),
        (100 * m["n_symbols"] > SYMBOLS * m["word_chars"]).alias("symbols"), (100 * m["lines"]["n_dup"] > DUP_LINES * m["lines"]["n"]).alias("lines"),
    )


def host_counts(tried: DataFrame) -> DataFrame:
    """(host, n, f_ of each rule): documents and failed ones of each host among tried (host, failures)."""
    return tried.groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(f"failures.{r}").alias(f"f_{r}") for r in RULES])


def beta_prior(k: float, n: float, f: float, q: float, nn: float) -> tuple[float, float]:
    """(a, b) of the prior of k hosts' rates by moments, from sums over hosts: n documents, f failed, q of f * f / n, nn of n * n.

    Its strength comes from the spread of the rates beyond what chance gives, and never outweighs 50 documents.
    """
    mean = min(max((f + 0.5) / (n + 1.0), 1e-6), 1 - 1e-6)
    between = (q - n * mean * mean - max(k - 1, 0) * mean * (1 - mean)) / max(n - nn / max(n, 1.0), 1.0)
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 50.0) if between > 0 else 50.0
    return mean * strength, (1 - mean) * strength


def host_verdicts(hosts: DataFrame, max_rate: float = MAX_RATE, habit: float = HABIT, sure: float = SURE) -> DataFrame:
    """(host, host_docs, rate_ and habit_ of each rule, host_ok) of host_counts().

    rate_ is the share of documents failing the rule, shrunk to the rule's prior; habit_ says whether it lies above habit; host_ok is
    false where one rule's rate lies more than `sure` posterior deviations above max_rate. The priors take one row of sums over hosts.
    """
    sums = [F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.lit(1.0) * F.col("n") * F.col("n")).alias("nn")]
    sums += [x for r in RULES for x in (F.sum(f"f_{r}").alias(f"f_{r}"), F.sum(F.col(f"f_{r}") / F.col("n") * F.col(f"f_{r}")).alias(f"q_{r}"))]
    s = hosts.agg(*sums).first()
    rates, ok = [], F.lit(True)
    for r in RULES:
        a, b = beta_prior(s["k"], *(float(s[c] or 0) for c in ("n", f"f_{r}", f"q_{r}", "nn")))
        rate = (F.col(f"f_{r}") + a) / (F.col("n") + a + b)
        rates += [rate.alias(f"rate_{r}"), (rate > habit).alias(f"habit_{r}")]
        ok = ok & (rate - sure * F.sqrt(rate * (1 - rate) / (F.col("n") + a + b + 1)) <= max_rate)
    return hosts.select("host", F.col("n").alias("host_docs"), *rates, ok.alias("host_ok"))


def _judged(tried: DataFrame, max_rate: float, habit: float, sure: float) -> DataFrame:
    """tried (host, failures, ...) with its host's verdicts and kept.

    The hosts' table is written first, so Spark knows its size: small it is broadcast, else a sort-merge join whose hot host
    adaptive execution splits, both sides being dealt for this join alone.
    """
    hosts = stored(host_verdicts(stored(host_counts(tried), "host-counts"), max_rate, habit, sure).withColumnRenamed("host", "h"), "hosts")
    met = tried.join(hosts, tried["host"].eqNullSafe(hosts["h"]), "left")
    base = F.col("failures.words") | F.col("failures.repeats")
    soft = (F.col("failures.symbols") & F.col("habit_symbols")) | (F.col("failures.lines") & F.col("habit_lines"))
    return met.withColumns({"base_failed": base, "kept": ~base & ~soft & F.col("host_ok")})


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE, habit: float = HABIT, sure: float = SURE) -> DataFrame:
    """One row per row of docs: the id, the base measures, base_failed, kept, failures, and of the host host_docs, its rates, host_ok.

    Null text has no words and fails; a null host is a host of its own; repeated rows are measured and counted each; columns
    other than the three named are not read, so names cannot clash; an empty table gives no rows. Measures are taken once
    and stored (a few longs a row).
    """
    tried = stored(
        docs.select(docs[id_col].alias("id"), docs[host_col].alias("host"), rule_measures(docs[text_col].cast("string")).alias("m")).select("id", "host", "m.*", failures(F.col("m")).alias("failures")),
        "measures",
    )
    judged = _judged(tried, max_rate, habit, sure)
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", F.col("lines.n_dup").alias("n_dup_lines"), "n_repeat_words", "base_failed", "kept",
        "failures", "host_docs", *[f"rate_{r}" for r in RULES], "host_ok",
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE, habit: float = HABIT, sure: float = SURE) -> DataFrame:
    """The rows of docs, with its columns, that quality_rules() keeps; repeated rows stay repeated. Columns may have any names.

    One pass measures: rows are written with their failures, hosts are counted from that column alone, and the rows are read again
    beside the hosts' verdicts. Texts are not shuffled unless the hosts' table is too large to broadcast.
    """
    row = F.struct(*[docs[c] for c in docs.columns])
    tried = stored(docs.select(row.alias("row"), docs[host_col].alias("host"), failures(rule_measures(docs[text_col].cast("string"))).alias("failures")), "tried")
    return _judged(tried, max_rate, habit, sure).where("kept").select("row.*")


def oracle(max_rate: float = MAX_RATE, habit: float = HABIT, sure: float = SURE) -> str:
    """quality_rules() of documents in DuckDB SQL, over exploded windows (doc_id unique)."""
    return rf"""
with w as (select doc_id, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
g as (select doc_id, i, array_to_string(ws[i + 1 : i + {WINDOW}], ' ') s from (select doc_id, ws, unnest(range(len(ws) - {WINDOW - 1})) i from w where len(ws) >= {WINDOW})),
r as (select doc_id, i, count(*) over (partition by doc_id, s) n from g),
c as (select doc_id, count(distinct i + k) n from (select doc_id, i, unnest(range({WINDOW})) k from r where n > 1) group by 1),
m as (select doc_id, source, len(ws)::BIGINT n_words, length(array_to_string(ws, ''))::BIGINT word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls, coalesce(c.n, 0)::BIGINT n_repeat_words from w left join c using (doc_id)),
b as (select *, (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines from m),
f as (select doc_id, source, unnest([{", ".join(f"'{r}'" for r in RULES)}]) rule,
  unnest([n_words < 10, 100 * n_repeat_words > 20 * n_words, 100 * n_symbols > {SYMBOLS} * word_chars, 100 * n_dup_lines > {DUP_LINES} * len(ls)]) failed from b),
h as (select source, rule, count(*) n, count(*) filter (failed) f from f group by 1, 2),
s as (select *, least(greatest((f + 0.5) / (n + 1), 1e-6), 1 - 1e-6) mean from (select rule, count(*) k, sum(n) n, sum(f) f, sum(f::DOUBLE / n * f) q, sum(n::DOUBLE * n) nn from h group by 1)),
v as (select *, (q - n * mean * mean - (k - 1) * mean * (1 - mean)) / greatest(n - nn / n, 1) between_hosts from s),
p as (select rule, mean, case when between_hosts > 0 then least(greatest(mean * (1 - mean) / between_hosts - 1, 1), 50) else 50 end strength from v),
o as (select source, rule, n, strength, (f + mean * strength) / (n + strength) rate from h join p using (rule)),
y as (select source, bool_and(rate - {sure} * sqrt(rate * (1 - rate) / (n + strength + 1)) <= {max_rate}) ok from o group by 1),
z as (select doc_id, bool_or(failed and (f.rule in ('words', 'repeats') or rate > {habit})) failed from f join o on o.source is not distinct from f.source and o.rule = f.rule group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed, not z.failed and y.ok kept
from b join z using (doc_id) join y on y.source is not distinct from b.source"""
