"""The queries of the text operators over their whole tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import language_id, line_dedup, merkle, mixing, packing, quality_model, quality_rules, simhash, templates, toxicity
from palimpsest.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.evaluate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op3_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.evaluate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "n_draws", "source")


def op5_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_report(table(spark, sf_dir, "documents"))


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.evaluate(table(spark, sf_dir, "documents"))


def op10_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_line_dedup,
        op3_quality_attention,
        op4_mix_sources,
        op5_merkle_fingerprints,
        op6_harmonic_packing,
        op7_simhash_duplicates,
        op8_host_rules,
        op9_language_id,
        op10_template_extraction,
    )
} | {"pipeline": corpus_pipeline.run}
WORDS = "regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')"

OP4 = f"""
with d as (select doc_id, source, len({WORDS.format(text="text")}) as size, md5(coalesce(cast(doc_id as varchar), text, '')) as key from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by encode(source) nulls last) - 1 as n from d group by source),
w as (select *, case n % 3 when 0 then 5 when 1 then 2 else 1 end as weight from s),
o as (select *, sum(source_size) over () as total, row_number() over (order by 3 * source_size / weight, n) as k from w),
-- Sources in the order in which they reach their bound: those before the first that doesn't stop at three times their size.
p as (select *, cast(total as double) - coalesce(cast(sum(3 * source_size) over (order by k rows between unbounded preceding and 1 preceding) as double), 0) as words_left,
    sum(weight) over (order by k rows between current row and unbounded following) as weight_left from o),
q as (select *, min(case when 3 * source_size / weight >= words_left / weight_left then k end) over () as first_open from p),
t as (select source, source_size, case when k < first_open then cast(3 * source_size as double)
    else weight * max(case when k = first_open then words_left end) over () / max(case when k = first_open then weight_left end) over () end as target from q),
g as (select d.doc_id, d.size, d.source, t.source_size, t.target, cast(floor(t.target + 0.5) as bigint) as goal,
    cast(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows unbounded preceding) as bigint) - d.size as before from d join t on t.source is not distinct from d.source)
select doc_id, cast(size as bigint) as size, source_size, target, source,
    case when source_size = 0 then 0 else (goal // source_size) * size + greatest(0, least(size, goal % source_size - before)) end as taken,
    cast(case when size = 0 then 0 else goal // source_size + (least(size, goal % source_size - before) > 0)::int end as bigint) as n_draws from g
"""

OP8 = f"""
with d as (select row_number() over () as r, doc_id, source as host, coalesce(text, '') as text from documents),
w as (select r, {WORDS.format(text="text")} as words from d),
u as (select r, unnest(words) as word, unnest(range(len(words))) as i from w),
g as (select r, i, word, lead(word) over x as b, lead(word, 2) over x as c from u window x as (partition by r order by i)),
h as (select r, i, count(*) over (partition by r, word, b, c) as n from g where c is not null),
m as (select r, count(distinct j) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as j from h where n > 1) group by r),
l as (select r, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from d),
e as (select r, count(*) as n_dup_lines from (select r, row_number() over (partition by r, line order by i) as k from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]')) where k > 1 group by r),
f as (select d.r, doc_id, host, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
    from d join w using (r) left join m using (r) left join e using (r)),
j as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f),
k as (select host, count(*) as n, count(*) filter (where base_failed) as failed from j where host is not null group by host),
v as (select sum(failed) / sum(n) as mean, sum(n) as total, count(*) as hosts from k),
x as (select mean, hosts, (sum(n * power(failed / n - mean, 2)) - count(*) * mean * (1 - mean)) / any_value(total) as variance from k, v group by mean, hosts),
y as (select mean, case when hosts > 1 and variance > 0 then least(1000, greatest(1, mean * (1 - mean) / variance - 1)) else 1000 end as strength from x),
z as (select host, (failed + mean * strength) / (n + strength) > {quality_rules.HOST_RATE} as bad from k, y)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not (base_failed or coalesce(bad, false)) as kept from j left join z using (host)
"""

ORACLE: dict[str, str] = {"op4_mix_sources": OP4, "op8_host_rules": OP8}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
