"""Queries of this subpackage's operators over the driver's tables, and their SQL where that can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from serigraph.llm import filter_audit, html_text, langid, mixing, near_vectors, ngram_join, packing, phrases, pii, quality, span_dedup, token_files, topk
from serigraph.llm._common import shared_folder, table

TOKENIZER, BYTE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"


def id_remainder(n: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep_text=False)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_top_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(id_remainder(5) != 0))
    held_out = F.coalesce(id_remainder(5) == 0, F.lit(False)).alias("held_out")
    return langid.identify(docs.select("doc_id", "text", held_out), model)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = quality.train(docs, table(spark, sf_dir, "labels").where(id_remainder(3) != 1))
    held_out = F.coalesce(id_remainder(3) == 1, F.lit(False)).alias("held_out")
    return quality.classify(docs.select("doc_id", "text", held_out), forest)


def op10_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back from the files, which stay in the shared folder for whoever reads the rows."""
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    return token_files.documents(token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(BYTE_TOKENIZER)))


QUERIES = {
    f.__name__: f
    for f in (op1_mix_sources, op2_ngram_jaccard, op3_near_embeddings, op4_best_fit_packing, op5_page_text, op6_top_vectors, op7_language, op8_personal_data, op9_quality, op10_repeated_spans, op11_collocations, op12_filter_audit, op13_token_files)
}

ORACLES = {
    "op1_mix_sources": """
        with sized as (
            select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size from documents
        ), sums as (
            select source, cast(sum(size) as bigint) as source_size, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3) + 1]::double as weight
            from sized group by source
        ), stepped as (
            select *, row_number() over o as k, coalesce(sum(source_size) over (o rows between unbounded preceding and 1 preceding), 0) as full_size,
                sum(weight) over (order by 2.0 * source_size / weight desc, source desc nulls first rows between unbounded preceding and current row) as rest,
                sum(source_size) over () as total
            from sums window o as (order by 2.0 * source_size / weight, source nulls last)
        ), leveled as (
            select coalesce(min_by((1.5 * total - 2.0 * full_size) / rest, k) filter (2.0 * source_size >= (1.5 * total - 2.0 * full_size) / rest * weight), cast('inf' as double)) as level
            from stepped
        ), targets as (
            select source, source_size, least(2.0 * source_size, level * weight)::double as target from sums, leveled
        ), drawn as (
            select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
                cast('0x' || substr(md5('17:' || coalesce(cast(d.doc_id as varchar), '')), 1, 8) as bigint) / 4294967296.0::double as u
            from sized d join targets t on d.source is not distinct from t.source
        )
        select doc_id, size, source_size, target, cast(size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) as bigint) as taken from drawn
    """,
    "op2_ngram_jaccard": """
        with recursive worded as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
        ), shingles as (
            select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
            from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from worded where len(w) > 0)
        ), sizes as (
            select doc_id, count(*) as n from shingles group by doc_id
        ), links as (
            select a.doc_id as a, b.doc_id as b from shingles a join shingles b using (s) join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
            where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))
        ), reach(doc_id, other) as (
            select doc_id, doc_id from documents union select r.doc_id, l.b from reach r join links l on l.a = r.other
        )
        select doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(other)::bigint as component_id from reach left join sizes using (doc_id) group by doc_id
    """,
    "op3_near_embeddings": """
        with recursive fit as (
            select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
            where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links as (
            select a.vec_id as a, b.vec_id as b from fit a join fit b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
            where list_inner_product(a.e, b.e) >= 0.95 * sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))
        ), reach(vec_id, other) as (
            select vec_id, vec_id from embeddings union select r.vec_id, l.b from reach r join links l on l.a = r.other
        ), found as (
            select vec_id, min(other)::bigint as component_id from reach group by vec_id
        )
        select vec_id, (select count(*) from links where a = vec_id)::bigint as n_links, component_id, vec_id = component_id as kept from found
    """,
    "op6_top_vectors": """
        with fit as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select q.vec_id as query_id, c.vec_id, cast(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1] * p[2], 0))), 0) as bigint) as score
            from fit q join fit c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
        )
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
        from scored qualify rank <= 5
    """,
    "op11_collocations": """
        with pieces as (
            select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as p from documents
        ), worded as (
            select lang, regexp_extract_all(p, '[^\\x20\\x09]+') as w from pieces
        ), grams as (
            select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase, count(*) as f
            from (select lang, m, w, unnest(range(1, len(w) - m + 2)) as i from worded, (values (1), (2), (3)) t(m)) group by all
        ), totals as (
            select lang, sum(f)::bigint as n from grams where m = 1 group by lang
        ), often as (
            select *, string_split(phrase, ' ') as w from grams where m > 1 and f >= 10
        ), cuts as (
            select c.lang, c.phrase, c.m as m, c.f as a, c.k as k, l.f as l, r.f as r, 1000000::hugeint * c.f * c.f // (l.f::hugeint * r.f) as score
            from (select lang, phrase, m, f, w, unnest(range(1, m)) as k from often) c
            join grams l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:c.k], ' ') join grams r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')
        ), lowest as (
            select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
        ), held as (
            select distinct c.lang, x.phrase from (select lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as part from often where m = 3) c
            join often x on x.lang = c.lang and x.phrase = c.part where 100 * c.f >= 50 * x.f
        )
        select lang, (row_number() over (partition by lang order by score desc, a desc, phrase))::int as rank, phrase, a, l, r, n, score::bigint as score
        from lowest join totals using (lang) where (lang, phrase) not in (select lang, phrase from held)
        qualify rank <= 2000
    """,
    "op12_filter_audit": """
        with worded as (
            select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
        ), masks as (
            select doc_id, part, (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text))::int
                + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(min(doc_id) over (partition by text) < doc_id, false)::int as m from worded
        ), known as (
            select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id
        ), counts as (
            select part, m, count(*) as n, sum(coalesce(good, 0)) as g, sum(coalesce(toxic, 0)) as t from masks left join known using (doc_id) group by part, m
        ), f(name, bit) as (
            values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
        ), orders as (
            select a.name || b.name || c.name || d.name || e.name as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
            from f a, f b, f c, f d, f e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
        ), steps as (
            select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as earlier from (select *, unnest(range(1, 6)) as step from orders)
        ), told as (
            select part, filter_order, step, bit, coalesce(sum(n) filter (m & (earlier | bit) = 0), 0) as kept, coalesce(sum(n) filter (m & bit <> 0 and m & earlier = 0), 0) as removed,
                coalesce(sum(n) filter (m & bit <> 0 and m & earlier <> 0), 0) as redundant, coalesce(sum(n) filter (m = bit), 0) as unique_fails,
                coalesce(sum(g) filter (m & bit <> 0 and m & earlier = 0), 0) as good_lost, coalesce(sum(t) filter (m & bit <> 0 and m & earlier = 0), 0) as toxic_lost
            from counts, steps group by part, filter_order, step, bit
        )
        select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
            good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from told
    """,
}
