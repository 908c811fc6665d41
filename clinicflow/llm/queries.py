"""Registered queries of the corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clinicflow.llm import (
    conversation_repair,
    decontamination,
    exact_dedup,
    fill_in_middle,
    language,
    near_dedup,
    personal_data,
    quality,
    sentencepieces,
    substring_dedup,
    toxicity,
    url_filter,
    word_bpe,
)
from clinicflow.llm.url_filter import Rule

# The models are public vocabulary files; where they lie is a parameter of the operators.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

URL_RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.tokenize(
        table(spark, sf_dir, "documents"), PIECE_MODEL, fields=("n_tokens", "ids_sha256", "decoded_sha256")
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), kept_bytes=False)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items", "spans")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    return fill_in_middle.transform(table(spark, sf_dir, "documents"), fields=fields)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.damage(conversations), conversations)


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.tokenize(
        table(spark, sf_dir, "documents"), WORD_TOKENIZER, fields=("n_tokens", "ids_sha256", "decoded_sha256")
    )


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_url_filter, op3_near_dedup, op4_toxicity, op5_quality, op6_exact_dedup, op7_pii,
        op8_language, op9_substring_dedup, op10_decontamination,
        op11_fill_in_middle, op12_conversation_repair, op13_word_bpe,
    )
}

LLM_ORACLE: dict[str, str] = {
    "op6_exact_dedup": """
        select doc_id,
               max(doc_id) over same as keep_id,
               count(*) over same as group_size,
               doc_id = max(doc_id) over same as kept,
               sha256(coalesce(text, '')) as text_sha256
        from documents
        window same as (partition by coalesce(text, ''))
    """,
    "op10_decontamination": r"""
        with doc_words as (
            select doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
            from documents
        ), item_words as (
            select item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
            from benchmark
        ), item_sizes as (
            select item_id, words, least(13, len(words)) as size from item_words where len(words) > 0
        ), phrases as (
            select distinct item_id, size, array_to_string(words[pos : pos + size - 1], ' ') as phrase
            from (select *, unnest(range(1, len(words) - size + 2)) as pos from item_sizes)
        ), doc_places as (
            select doc_id, words, size, unnest(range(1, len(words) - size + 2)) as pos
            from doc_words cross join (select distinct size from phrases)
        ), found as (
            select doc_id, pos, p.size, item_id
            from (select doc_id, pos, size, array_to_string(words[pos : pos + size - 1], ' ') as phrase from doc_places) d
            join phrases p on p.phrase = d.phrase and p.size = d.size
        ), hit as (
            select doc_id, count(distinct place) as n_hit
            from (select doc_id, unnest(range(pos, pos + size)) as place from (select distinct doc_id, pos, size from found))
            group by doc_id
        ), named as (
            select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
            from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id
        )
        select doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(items, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
        from doc_words left join hit using (doc_id) left join named using (doc_id)
    """,
    "op11_fill_in_middle": r"""
        with cut as (
            select doc_id, coalesce(text, '') as content, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h,
                   regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as tokens
            from documents
        ), drawn as (
            select *, len(tokens) as n, ('0x' || h[1:8])::ubigint as h1, ('0x' || h[9:16])::ubigint as h2,
                   ('0x' || h[17:24])::ubigint as h3, ('0x' || h[25:32])::ubigint as h4
            from cut
        ), placed as (
            select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
                   case when content = '' or contains(content, '<P>') or contains(content, '<S>')
                             or contains(content, '<M>') or h3 % 100 >= 50 then 'plain'
                        when h4 % 100 < 80 then 'spm' else 'psm' end as form
            from drawn
        ), parts as (
            select *, array_to_string(tokens[1:a], '') as prefix, array_to_string(tokens[a + 1:b], '') as middle,
                   array_to_string(tokens[b + 1:], '') as suffix
            from placed
        )
        select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
               case when form <> 'plain' then length(middle) end as middle_chars,
               sha256(case form when 'plain' then content
                      when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
               sha256(content) as restored_sha256
        from parts
    """,
    "op12_conversation_repair": r"""
        with recursive crc_table as (
            select list(list_reduce([byte::ubigint] || list_transform(range(8), lambda k: k::ubigint),
                        lambda c, k: case when c & 1 = 1 then xor(3988292384::ubigint, c >> 1) else c >> 1 end)
                        order by byte) as entries
            from range(256) as bytes(byte)
        ), damaged as (
            select conv_id, turn, case when kind = 4 then 'user' else coalesce(role, ' ') end as role,
                   case kind when 1 then '' when 2 then translate(coalesce(text, ' '), '.!?', '')
                        else coalesce(text, ' ') end as text,
                   unnest(range(case when kind = 3 then 2 else 1 end)) as copy
            from (select *, xor(4294967295::ubigint, list_reduce(
                             [4294967295::ubigint] || list_transform(string_split(
                                 coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''),
                                 lambda c: ascii(c)::ubigint),
                             lambda c, x: xor(c >> 8, entries[((xor(c, x) & 255) + 1)::bigint]))) % 20 as kind
                  from conversations, crc_table)
            where kind <> 0
        ), placed as (
            select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as pos,
                   row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen,
                   not regexp_matches(text, '[^\x20\x09-\x0D]') as blank,
                   not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as open_end
            from damaged
        ), judged as (
            select *, not blank and seen > 1 as duplicate, not blank and seen = 1 and open_end as truncated,
                   case role[1] when 's' then 1 when 'u' then 2 when 'a' then 3 else 0 end as initial
            from placed
        ), facts as (
            select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
                   count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate,
                   count(*) filter (truncated) as truncated, count(*) filter (wrong) as illegal, count(*) as n
            from (select *, coalesce((lag(initial) over (partition by conv_id order by pos), initial)
                                     not in ((1, 2), (2, 3), (3, 2)), false)
                            and pos > 1 as wrong
                  from judged)
            group by conv_id
        ), ways as (
            select * from (values (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) as v(place, after, role)
        ), inserted as (
            select place, place as after, 0 as cost, '' as letters, '' as added from ways
            union all
            select place, after, 5, 'I', chr(10) || role || ':' from ways
            union all
            select a.place, b.after, 10, 'II', chr(10) || a.role || ':' || chr(10) || b.role || ':'
            from ways a join ways b on b.place = a.after
        ), walk as (
            select conv_id, 0::bigint as pos, 0 as place, {'cost': 0, 'audit': '', 'out': ''} as best from facts
            union all
            select conv_id, pos, place, min(best) as best
            from (select w.conv_id, r.pos, e.place,
                         {'cost': w.best.cost + i.cost + e.cost, 'audit': w.best.audit || i.letters || e.letter,
                          'out': w.best.out || i.added || e.added} as best
                  from walk w
                  join inserted i on i.place = w.place
                  join judged r on r.conv_id is not distinct from w.conv_id and r.pos = w.pos + 1
                  join ways y on y.place = i.after,
                  lateral (select i.after as place, 'D' as letter, 2 as cost, '' as added
                           union all
                           select r.initial, 'K', case when r.truncated then 5 else 0 end, chr(10) || r.role || ':' || r.text
                           where not r.blank and not r.duplicate
                                 and (r.initial = y.after or (i.after = 0 and r.initial = 1))
                           union all
                           select y.after, 'R', case when r.truncated then 6 else 1 end, chr(10) || y.role || ':' || r.text
                           where not r.blank and not r.duplicate) e)
            group by conv_id, pos, place
        ), repaired as (
            select w.conv_id, min({'cost': w.best.cost + i.cost, 'audit': w.best.audit || i.letters,
                                   'out': w.best.out || i.added}) as best
            from walk w
            join facts f on f.conv_id is not distinct from w.conv_id and f.n = w.pos
            join inserted i on i.place = w.place
            where i.after in (0, 3)
            group by w.conv_id
        )
        select c.conv_id, coalesce(f.gaps, 0) as gaps, coalesce(f.blank, 0) as blank,
               coalesce(f.duplicate, 0) as duplicate, coalesce(f.truncated, 0) as truncated,
               coalesce(f.illegal, 0) as illegal, coalesce(r.best.cost, 0)::bigint as cost,
               coalesce(r.best.audit, '') as audit, sha256(coalesce(substr(r.best.out, 2), '')) as repaired_sha256
        from (select distinct conv_id from conversations) c
        left join facts f on f.conv_id is not distinct from c.conv_id
        left join repaired r on r.conv_id is not distinct from c.conv_id
    """,
    "op3_near_dedup": r"""
        with recursive doc_words as (
            select doc_id, coalesce(text, '') as content, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
            from documents
        ), shingles as (
            select doc_id, shingle, count(*) as n
            from (select doc_id, array_to_string(words[pos : pos + 4], ' ') as shingle
                  from (select *, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as pos
                        from doc_words where len(words) > 0))
            group by doc_id, shingle
        ), sizes as (
            select doc_id, sum(n) as size from shingles group by doc_id
        ), common as (
            select a.doc_id as a, b.doc_id as b, sum(least(a.n, b.n)) as n
            from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id
            group by 1, 2
        ), links as (
            select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
            where 5 * n >= 4 * (x.size + y.size - n)
            union
            select x.doc_id, y.doc_id from doc_words x join doc_words y using (content)
            where len(x.words) = 0 and x.doc_id < y.doc_id
        ), both_ways as (
            select a, b from links union select b, a from links
        ), reach as (
            select doc_id, doc_id as other from documents
            union
            select r.doc_id, e.b from reach r join both_ways e on e.a = r.other
        )
        select doc_id, min(other) as class_id, count(*) as class_size, doc_id = min(other) as kept
        from reach group by doc_id
    """,
}
