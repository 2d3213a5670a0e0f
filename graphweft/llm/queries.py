"""The thirteen operators as queries over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, leaks, lines, pieces, pii, quality, ranking, rules, simhash, spelling, suffix_tree, urls
from .common import hex_sha256, table


def model_bytes(path: str | None = None) -> bytes:
    """The vocabulary file; its path is a parameter."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.train(docs))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_chats(turns))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), model_bytes(), remembered=256 << 20)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=True)
    return done.select("doc_id", "n_lines", "n_removed", hex_sha256(F.coalesce("text", F.lit(""))).alias("text_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = rules.judge(docs, rules.learn(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return leaks.find_secrets(docs, leaks.train(docs))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_lm_scoring, op3_chat_formatting, op4_sentencepiece, op5_url_filter, op6_line_dedup, op7_quality, op8_quality_rules, op9_decontamination, op10_simhash, op11_spelling_variants, op12_secret_scan, op13_ranked_search)}

_ESCAPED = "replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '<text>', '<\\text>'), '<turn>', '<\\turn>')"

SQL = {
    "op3_chat_formatting": f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o as (select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) as before, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from t)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length({_ESCAPED.format('text')}) + case when before is not distinct from role and k > 1 then 6 else 3 + length({_ESCAPED.format('role')}) + 6 + 4 end)::bigint as formatted_chars,
  sum(case when before is not distinct from role and k > 1 then 0 else 1 end)::bigint as n_runs
from o group by conv_id""",
    "op6_line_dedup": f"""
with l as (
  select doc_id, source, md5(concat_ws(chr(10), doc_id::varchar, text)) as dkey, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
  from documents where text is not null),
w as (select *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as key from l where trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''),
b as (select key, min((coalesce(doc_id, -9223372036854775808), pos)) as first from w group by key having count(distinct source) >= {lines.SITES}),
g as (select distinct w.dkey, w.pos from w join b using (key) where (coalesce(w.doc_id, -9223372036854775808), w.pos) <> b.first),
a as (select doc_id, text, md5(concat_ws(chr(10), doc_id::varchar, text)) as dkey from documents),
p as (select dkey, list(pos) as gone from g group by dkey)
select doc_id, case when text is null then 0 else len(string_split(text, chr(10))) end::bigint as n_lines, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(case when text is null then '' when gone is null then text else array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: not list_contains(gone, i - 1)), chr(10)) end) as text_sha256
from a left join p using (dkey)""",
    "op9_decontamination": r"""
with d as (select row_number() over () as rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark where item_id is not null),
i as (select distinct item_id, least(8, len(w)) as m, unnest(list_transform(range(1, greatest(len(w) - 7, 1) + 1), lambda k: array_to_string(w[k:k + 7], ' '))) as gram from b where len(w) > 0),
m as (select distinct m from i),
g as (select rid, m.m, unnest(range(1, len(w) - m.m + 2)) as pos, w from d, m where len(w) >= m.m),
h as (select g.rid, g.m, g.pos, i.item_id from (select rid, m, pos, array_to_string(w[pos:pos + m - 1], ' ') as gram from g) g join i on g.gram = i.gram and g.m = i.m),
c as (select rid, count(distinct place) as n from (select rid, unnest(range(pos, pos + m)) as place from h) group by rid),
s as (select rid, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct rid, item_id::varchar as item from h) group by rid)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(c.n, 0)::bigint as n_hit, coalesce(s.n, 0)::bigint as n_items, sha256(coalesce(s.items, '')) as items_sha256, coalesce(s.n, 0) >= 2 as contaminated
from d left join c using (rid) left join s using (rid)""",
    "op13_ranked_search": r"""
with d as (select row_number() over () as rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) as term from benchmark),
q as (select item_id, term, count(*) as times from b group by item_id, term),
s as (select count(*)::bigint as n_docs, sum(len(w))::bigint as total from d where len(w) > 0),
p as (select rid, term, count(*)::bigint as tf from (select rid, unnest(w) as term from d) where term in (select term from q) group by rid, term),
f as (select term, count(*)::bigint as df from p group by term),
u as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint as weight from f, s),
m as (select rid, doc_id, 75 + (25 * len(w) * n_docs) // total as m from d, s),
c as (select item_id, m.doc_id, rid, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score from q join p using (term) join u using (term) join m using (rid) group by item_id, m.doc_id, rid)
select item_id, "rank"::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id nulls first) as "rank" from c where score > 0) where "rank" <= 20""",
}
