"""Operator 6, licence scans by a positional index of rare words.

Templates of licence notices (whole texts, headers, SPDX lines) are indexed offline: each keeps its words of highest IDF with
their places; the corpus that IDF counts in is the notices themselves. A text's words are
looked up in the index; a rare word at place i that stands at p in a template proposes that the template begins at i - p.
There the template's other postings are intersected by relative place, and the alignment counts if enough IDF agrees and every
word of the mandatory key phrases stands in its place. All of it happens in the document's row; nothing is shuffled.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import ascii_lower, let
from foliospark.llm.licence_notices import notices

#: Phrases and labels of the contract.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What every base phrase and the mandatory phrases of every notice hold somewhere (tested); a text without it has no label.
ANY = rf"(?i)licens|rights{_GAP}(?:reserved|to)|cc{_GAP}by|cc0|redistribution|permission|unencumbered|neighboring|endorse|unauthorized|hereby|commons"
#: Words of a template that are its rare ones, and the share of their IDF that must agree.
RARE, SHARE = 6, 0.75


def templates() -> list[dict]:
    """The index's templates: words with place p, idf, and whether rare (the highest IDF) or must, and the anchor's place.

    The anchor is the mandatory word of the highest IDF: it stands in every alignment that can count, so looking it up finds all.
    """
    found = notices()
    df = Counter(w for _, words, _ in found for w in set(words))
    out = []
    for label, words, phrases in found:
        idf = [round(math.log(1 + len(found) / df[w]), 6) for w in words]
        order = sorted(range(len(words)), key=lambda p: (-idf[p], p))
        must = set()
        for k in phrases:
            at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
            must |= set(range(at, at + len(k)))
        rows = [{"p": p, "w": words[p], "idf": idf[p], "rare": p in order[:RARE], "must": p in must} for p in range(len(words))]
        anchor = min(must, key=lambda p: (-idf[p], p))
        out.append({"label": label, "words": rows, "anchor": anchor, "weight": sum(r["idf"] for r in rows if r["rare"]), "all": sum(idf)})
    return out


_TEMPLATES = "array<struct<label:string,weight:double,all:double,words:array<struct<p:int,w:string,idf:double,rare:boolean,must:boolean>>>>"


def _notice_hits(words: Column) -> Column:
    """array<struct<label, score>> of the alignments in words that hold."""
    found = templates()
    posts: dict[str, list[dict]] = {}
    for t, template in enumerate(found):
        p = template["anchor"]
        posts.setdefault(template["words"][p]["w"], []).append({"t": t, "p": p})
    index = F.from_json(F.lit(json.dumps(posts)), "map<string,array<struct<t:int,p:int>>>")
    table = F.from_json(F.lit(json.dumps(found)), _TEMPLATES)
    rare = F.array(*[F.lit(w) for w in sorted(posts)])
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: F.array_contains(rare, h["w"]))
    # a proposal is one long: place and template
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(index, h["w"]), lambda p: (h["i"] - p["p"]).cast("long") * len(found) + p["t"]))))

    def verdict(start: Column) -> Column:
        t = F.pmod(start, F.lit(len(found)))
        at, template = ((start - t) / len(found)).cast("int"), F.get(table, t.cast("int"))
        agrees = lambda r: F.coalesce(F.get(words, at + r["p"]) == r["w"], F.lit(False))
        total = lambda kept: F.aggregate(template["words"], F.lit(0.0), lambda a, r: a + F.when(kept(r) & agrees(r), r["idf"]).otherwise(0.0))
        ok = F.forall(template["words"], lambda r: ~r["must"] | agrees(r)) & (total(lambda r: r["rare"]) >= SHARE * template["weight"] - 1e-9)
        return F.struct(F.when(ok, template["label"]).alias("label"), F.least(F.lit(1.0), F.when(ok, total(lambda r: F.lit(True)) / template["all"])).alias("score"))

    return F.filter(F.transform(starts, verdict), lambda v: v["label"].isNotNull())


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    same = lambda i: [F.get(words, i + k) == w for k, w in enumerate(parts)]
    places = F.transform(words, lambda w, i: F.when(w == parts[0], i.cast("long")))
    return F.filter(places, lambda i: i.isNotNull() & F.coalesce(_all(same(i.cast("int"))), F.lit(False)))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of the base phrases, first_word and last_word are their smallest and largest start (null without
    one). labels joins base_labels with those of the aligned notices. score is 1 with a base phrase, else the best alignment's
    share of its notice's IDF, else 0. Null text counts as empty; repeated rows stay repeated; an empty table gives no rows;
    other columns are not read, so names cannot clash. Texts without any licence stem skip the index; long texts are read whole.
    """
    text = docs[text_col].cast("string")
    n_words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")

    def scan(words: Column) -> Column:
        places = [(label, _places(words, phrase)) for phrase, label in BASE]
        by_label = let(F.array(*[p for _, p in places]), lambda found: F.struct(F.flatten(found).alias("places"), F.filter(F.array(*[F.when(F.size(F.get(found, F.lit(k))) > 0, F.lit(label)) for k, (label, _) in enumerate(places)]), lambda x: x.isNotNull()).alias("labels")))
        return F.struct(by_label.alias("base"), _notice_hits(words).alias("hits"))

    words = F.regexp_extract_all(ascii_lower(text), F.lit(f"({WORD})"), F.lit(1))
    scanned = docs.select(docs[id_col].alias("id"), n_words.alias("n_words"), F.when(text.rlike(ANY), let(words, scan)).alias("s"))
    base, hits = F.col("s.base.labels"), F.col("s.hits")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_distinct(F.concat(F.coalesce(base, none), F.coalesce(F.transform(hits, lambda h: h["label"]), none))))
    n_base = F.coalesce(F.size("s.base.places"), F.lit(0))
    n_base = F.when(F.col("s").isNull(), F.lit(0)).otherwise(n_base).cast("long")
    score = F.when(n_base > 0, F.lit(1.0)).otherwise(F.round(F.coalesce(F.array_max(F.transform(hits, lambda h: h["score"])), F.lit(0.0)), 9))
    return scanned.select(
        F.col("id").alias(id_col), "n_words", n_base.alias("n_base"), F.array_min("s.base.places").alias("first_word"), F.array_max("s.base.places").alias("last_word"),
        F.array_join(F.array_sort(F.coalesce(base, none)), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )


def oracle() -> str:
    """The scan of documents in DuckDB SQL, over exploded words."""
    rows, anchors = [], []
    for t, x in enumerate(templates()):
        rows += [f"({t}, '{x['label']}', {r['p']}, '{r['w']}', {r['idf']}::DOUBLE, {r['rare']}, {r['must']})" for r in x["words"]]
        anchors.append(f"({t}, {x['anchor']}, '{x['words'][x['anchor']]['w']}')")
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in BASE)
    return f"""
with t(t, label, p, w, idf, rare, must) as (values {", ".join(rows)}), a(t, p, w) as (values {", ".join(anchors)}), b(phrase, label, k) as (values {phrases}),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') ws from documents),
x as (select doc_id, unnest(ws) w, unnest(range(len(ws))) i from d),
base as (select d.doc_id, b.label, r.i from d, b, lateral (select unnest(range(len(ws))) i) r where array_to_string(ws[r.i + 1 : r.i + b.k], ' ') = b.phrase),
bs as (select doc_id, count(*) n, min(i) lo, max(i) hi, string_agg(distinct label, ',' order by label) labels from base group by 1),
c as (select distinct x.doc_id, a.t, x.i - a.p as start from x join a using (w)),
s as (select c.doc_id, c.t, any_value(t.label) label, sum(case when x.i is not null then t.idf else 0 end) / sum(t.idf) score,
  bool_and(not t.must or x.i is not null) ok, sum(case when t.rare and x.i is not null then t.idf else 0 end) >= {SHARE} * sum(case when t.rare then t.idf else 0 end) - 1e-9 enough
  from c join t on c.t = t.t left join x on x.doc_id = c.doc_id and x.i = c.start + t.p and x.w = t.w group by c.doc_id, c.t, c.start),
h as (select doc_id, label, score from s where ok and enough),
l as (select doc_id, string_agg(distinct label, ',' order by label) labels from (select doc_id, label from h union all select doc_id, label from base) group by 1),
m as (select doc_id, least(1.0, max(score)) score from h group by 1)
select d.doc_id, len(ws)::BIGINT n_words, coalesce(bs.n, 0)::BIGINT n_base, bs.lo::BIGINT first_word, bs.hi::BIGINT last_word, coalesce(bs.labels, '') base_labels, coalesce(l.labels, '') labels,
  case when bs.n > 0 then 1.0 else round(coalesce(m.score, 0.0), 9) end::DOUBLE score
from d left join bs using (doc_id) left join l using (doc_id) left join m using (doc_id)"""
