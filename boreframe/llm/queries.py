"""Registered queries of the operators, on their whole tables, with production
parameters, and the DuckDB text of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreframe.llm.common import load
from boreframe.session import shared_dir

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query
    return keep


#: DuckDB: words of a text, unchanged
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@register("op5_substring_dedup", rf"""
with d as (select doc_id, {WORDS_SQL} as w from documents),
w as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as s
      from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d)),
gone as (select doc_id, i from
         (select doc_id, i, row_number() over (partition by s order by doc_id, i) as r from w) where r > 1),
spots as (select distinct doc_id, unnest(range(i, i + 20)) as j from gone),
lists as (select doc_id, list(j) as js from spots group by doc_id),
x as (select d.doc_id, len(w) as n_words, coalesce(len(js), 0) as n_removed,
             case when js is null then w
                  else list_filter(w, lambda v, j: not list_contains(js, j)) end as kept
      from d left join lists using (doc_id))
select doc_id, n_words::bigint as n_words, n_removed::bigint as n_removed,
       sha256(array_to_string(kept, ' ')) as kept_sha256
from x""")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boreframe.llm.substring_dedup import substring_dedup
    d = substring_dedup(load(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boreframe.llm.simhash import simhash_near_dups
    return simhash_near_dups(load(spark, sf_dir, "documents"))


@register("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boreframe.llm.packing import pack
    return pack(load(spark, sf_dir, "documents"))


@register("op10_lm_score")
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boreframe.llm.lm_score import lm_scores
    return lm_scores(load(spark, sf_dir, "documents"))


@register("op1_quality_rules", rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(source, '') as host, coalesce(text, '') as t,
                  {WORDS_SQL} as w from documents),
lines as (select rid, host, t, unnest(string_split(t, chr(10))) as line from d),
norm as (select rid, host, t, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) as k,
                len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as lw
         from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
sizes as (select host, count(distinct t) as docs from d group by host),
freq as (select host, k, count(distinct t) as n from norm group by host, k),
common as (select host, k from freq join sizes using (host) where n >= 10 and (n > 0.05 * docs or n >= 1000)),
gone as (select rid, count(*) as n_common_lines, sum(lw) as n_common_words
         from norm join common using (host, k) group by rid),
dup as (select rid, count(*) - count(distinct line) as n_dup_lines from norm group by rid),
win as (select rid, i, count(*) over (partition by rid, s) as c from (
          select rid, i, array_to_string(w[i:i + 4], ' ') as s
          from (select rid, w, unnest(range(1, len(w) - 3)) as i from d))),
rep as (select rid, count(distinct j) as n_repeat_words
        from (select rid, unnest(range(i, i + 5)) as j from win where c > 1) group by rid),
x as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
             coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
             coalesce(n_common_lines, 0)::bigint as n_common_lines,
             coalesce(n_common_words, 0)::bigint as n_common_words
      from d left join dup using (rid) left join rep using (rid) left join gone using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       n_common_lines, n_common_words,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)
         and n_common_words <= 0.5 * n_words as kept
from x""")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boreframe.llm.quality_rules import quality_rules
    return quality_rules(load(spark, sf_dir, "documents")).drop("clean_text")


def _license_oracle() -> str:
    from boreframe.llm.license_scan import GRAM, PHRASES, TEMPLATES, _split
    grams = [(n, label, len(w), i, " ".join(w[i:i + GRAM])) for n, (label, text) in enumerate(TEMPLATES)
             for w in [_split(text)] for i in range(len(w) - GRAM + 1)]
    values = ", ".join(f"({n}, '{label}', {size}, {i}, '{g}')" for n, label, size, i, g in grams)
    phrases = " union all ".join(
        f"select rid, '{label}' as label, i - 1 as pos from pos where array_to_string(w[i:i + {p.count(' ')}], ' ') = '{p}'"
        for p, label in PHRASES.items())
    return rf"""
with t(template, label, size, tpos, gram) as (values {values}),
d as (select row_number() over () as rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
pos as (select rid, w, unnest(range(1, len(w) + 1)) as i from d),
places as ({phrases}),
base as (select rid, count(*) as n_base, min(pos) as first_word, max(pos) as last_word,
                list_sort(list(distinct label)) as ls from places group by rid),
g as (select rid, i - 1 as pos, array_to_string(w[i:i + {GRAM - 1}], ' ') as gram from pos where i <= len(w) - {GRAM - 1}),
votes as (select rid, template, label, size, tpos, pos - tpos as diagonal from g join t using (gram)),
jumps as (select *, case when diagonal - lag(diagonal) over b > 2 then 1 else 0 end as jump
          from votes window b as (partition by rid, template order by diagonal)),
blocks as (select *, sum(jump) over (partition by rid, template order by diagonal) as block from jumps),
spread as (select distinct rid, template, label, size, block, unnest(range(tpos, tpos + {GRAM})) as c from blocks),
cover as (select rid, label, count(*) / size::double as cover from spread group by rid, template, label, size, block),
found as (select rid, max(cover) as best, list(distinct label) filter (cover >= 0.8) as ls from cover group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
       last_word::bigint as last_word, coalesce(array_to_string(base.ls, ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(found.ls, [])))), ','), '') as labels,
       case when n_base > 0 then 1.0::double else coalesce(best, 0.0)::double end as score
from d left join base using (rid) left join found using (rid)"""


@register("op4_license_scan", _license_oracle())
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boreframe.llm.license_scan import license_scan
    return license_scan(load(spark, sf_dir, "documents")).drop("spans")


def _secret_oracle() -> str:
    from boreframe.llm.secret_scan import BASE_RULES, MORE_RULES
    plain = {"access": (r"AKIA[A-Z0-9]+", 20), "hex": (r"[0-9a-f]+", 24)}
    one = []
    for rank, r in enumerate(BASE_RULES + MORE_RULES):
        p, least = plain.get(r.kind, (r.pattern.replace("'", "''"), r.least))
        one.append(f"select rid, t, {rank} as rank, '{r.kind}' as kind, {least} as least, "
                   f"regexp_extract_all(t, '{p}') as m, regexp_extract_all(t, '{p}', {r.group}) as g from d")
    return rf"""
with recursive d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
every as ({' union all '.join(one)}),
walk(rid, rank, kind, least, m, g, i, rest, base, s, e, ok) as (
  select rid, rank, kind, least, m, g, 0, t, 0::bigint, 0::bigint, 0::bigint, false from
    every where list_max(list_transform(g, lambda x: length(x))) >= least
  union all
  select rid, rank, kind, least, m, g, i + 1, substring(rest, instr(rest, m[i + 1]) + length(m[i + 1])),
         base + instr(rest, m[i + 1]) - 1 + length(m[i + 1]), base + instr(rest, m[i + 1]) - 1,
         base + instr(rest, m[i + 1]) - 1 + length(m[i + 1]), length(g[i + 1]) >= least
  from walk where i < len(m)),
spans as (select rid, rank, kind, s, e from walk where ok),
agg as (select rid, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access,
               count(*) filter (rank = 2) as n_hex,
               string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans,
               string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (rank < 3) as base
        from spans group by rid)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access,
       coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join agg using (rid)"""


@register("op9_secret_scan", _secret_oracle())
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boreframe.llm.secret_scan import BlobLedger, span_text
    docs, english = load(spark, sf_dir, "documents"), F.coalesce(F.col("lang") == "en", F.lit(False))
    ledger = BlobLedger(spark, shared_dir(spark, f"secret-ledger-{uuid.uuid4().hex}"))
    ledger.scan(docs.where(english), "english")  # the table comes in two arrivals; the second
    ledger.scan(docs.where(~english), "other")  # scans only blobs that the first did not hold
    found, spans = ledger.history(), F.col("spans")

    def kind(n: int):
        return F.size(F.filter(spans, lambda x: x["rank"] == n)).cast("long")

    return found.select("doc_id", kind(0).alias("n_assign"), kind(1).alias("n_access"), kind(2).alias("n_hex"),
                        F.sha2(span_text(F.filter(spans, lambda x: x["rank"] < 3)), 256).alias("base_sha256"),
                        span_text(spans).alias("spans"))


@register("op2_decontamination", r"""
with d as (select doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(regexp_extract_all(lower(coalesce(text, '')),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
ds as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
       from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d)),
bs as (select distinct item_id, array_to_string(w[i:i + 4], ' ') as s
       from (select item_id, w, unnest(range(1, len(w) - 3)) as i from b)),
n as (select item_id, count(*) as n_shingles from bs group by item_id),
c as (select doc_id, item_id, count(*) as n_common from ds join bs using (s) group by doc_id, item_id)
select doc_id, item_id, n_shingles::bigint as n_shingles, n_common::bigint as n_common,
       n_common / n_shingles::double as containment
from c join n using (item_id) where n_common / n_shingles::double >= 0.8""")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boreframe.llm.decontaminate import contained_items
    return contained_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@register("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boreframe.llm.quality_classifier import score_quality
    return score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@register("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boreframe.llm.html_extract import extract_pages
    return extract_pages(load(spark, sf_dir, "pages"))


#: DuckDB: the rows of ``embeddings`` that take part, as exact integers in doubles
VECTORS_SQL = """
select row_number() over () as rid, vec_id, label,
       list_transform(embedding, lambda x: floor(256 * x::double)) as v
from embeddings
where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"""


@register("op13_topk_search", f"""
with e as ({VECTORS_SQL}),
s as (select q.rid, q.vec_id as query_id, e.vec_id, list_dot_product(q.v, e.v)::bigint as score, e.rid as other
      from e as q join e on e.rid <> q.rid where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by rid order by score desc, vec_id nulls last, other) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 5""")
def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boreframe.llm.topk_search import top_k
    return top_k(load(spark, sf_dir, "embeddings"))


@register("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boreframe.llm.token_alignment import align_tokenizers
    return align_tokenizers(load(spark, sf_dir, "documents"))[0]


@register("op11_hard_negatives", f"""
with e as (select rid, vec_id, v, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label
           from ({VECTORS_SQL}) where label is not null),
s as (select a.rid, a.vec_id as anchor_id, a.label as anchor_label, e.vec_id, e.label, e.rid as other,
             list_dot_product(a.v, e.v)::bigint as score
      from e as a join e on e.rid <> a.rid where a.vec_id % 100 = 0),
p as (select rid, anchor_id, vec_id as positive_id, other as positive, score as positive_score,
             row_number() over (partition by rid order by score desc, vec_id nulls last, other) as r
      from s where label = anchor_label),
n as (select p.anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score,
             row_number() over (partition by p.rid, positive order by s.score desc, s.vec_id nulls last, s.other) as rank
      from p join s on s.rid = p.rid and s.label <> s.anchor_label
      where r <= 5 and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score
from n where rank <= 10""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boreframe.llm.hard_negatives import hard_negatives
    return hard_negatives(load(spark, sf_dir, "embeddings"),
                          relabel=lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label))


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
