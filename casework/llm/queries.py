"""The registered queries of this subpackage: thin digests of what its operators give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm import html_text, langid, metric_join, mixing, neardup, negatives, ngram_lm, packing, pii, quality, spelling, token_counts, topk
from casework.llm.common import fold_of, small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op4_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = pii.listed(F.filter("spans", lambda s: s.kind.isin(*pii.BASE_KINDS)))
    counts = [pii.count_of(F.col("spans"), k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary(), keep_ids=False)
    return pieces.select("doc_id", "start", "length", F.col("crc32").alias("ids_crc32"), F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    model = langid.train(docs, ~held_out)
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "_lang.lang_pred", "_lang.score")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), words=2)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, weights, F.col("source"), F.col("lang")).select("doc_id", "_q.*")


def op10_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of(F.col("doc_id"), 7) == 2
    counts = ngram_lm.train(docs.filter(~held_out))
    found = ngram_lm.score(docs, counts)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(counts.n).cast("long").alias("train_tokens"), "base_score", "score")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), damage=97, least_length=5, least_count=3)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES = {
    "op1_topk": op1_topk,
    "op2_pii": op2_pii,
    "op3_packing": op3_packing,
    "op4_metric_join": op4_metric_join,
    "op5_mixing": op5_mixing,
    "op6_langid": op6_langid,
    "op7_html_text": op7_html_text,
    "op8_neardup": op8_neardup,
    "op9_quality": op9_quality,
    "op10_ngram_lm": op10_ngram_lm,
    "op11_token_counts": op11_token_counts,
    "op12_spelling": op12_spelling,
    "op13_negatives": op13_negatives,
}
_USABLE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

ORACLE_SQL: dict[str, str] = {
    "op1_topk": f"""
        with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e from embeddings where {_USABLE}),
        s as (select q.vec_id as query_id, d.vec_id as vec_id, cast(list_dot_product(q.e, d.e) as bigint) as score
              from v q join v d on q.vec_id % 100 = 0 and q.vec_id <> d.vec_id),
        r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 10""",
    "op4_metric_join": f"""
        with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings where {_USABLE} and list_dot_product(cast(embedding as double[]), cast(embedding as double[])) > 0),
        links as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
        reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
        component as (select a as vec_id, min(b) as component_id from reach group by a),
        counted as (select a as vec_id, count(*) as n_links from links group by a)
        select c.vec_id, coalesce(n_links, 0) as n_links, component_id, c.vec_id = component_id as kept
        from component c left join counted using (vec_id)""",
    "op8_neardup": r"""
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        s as materialized (select doc_id, list_distinct(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) as s from w),
        e as materialized (select doc_id, len(s) as n, unnest(s) as x from s),
        pairs as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as n_both from e a join e b on a.x = b.x and a.doc_id < b.doc_id where least(a.n, b.n) * 100 >= 80 * greatest(a.n, b.n) group by 1, 2),
        links as materialized (select a, b from pairs where 100 * n_both >= 80 * (na + nb - n_both)),
        ways as materialized (select a, b from links union all select b, a from links),
        reach as (select doc_id as a, doc_id as b from documents union select r.a, y.b from reach r join ways y on r.b = y.a),
        component as (select a as doc_id, min(b) as component_id from reach group by 1)
        select s.doc_id, cast(len(s.s) as bigint) as n_shingles, component_id, s.doc_id = component_id as kept from s join component using (doc_id)""",
    "op13_negatives": f"""
        with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings where label is not null and {_USABLE}),
        s as materialized (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_dot_product(a.e, b.e) as bigint) as score
              from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
        p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
        select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by s.score desc, other) as integer) as rank, other as negative_id, positive_score, s.score as negative_score
        from p join s on p.anchor_id = s.anchor_id and not same and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score
        qualify rank <= 5""",
    "op12_spelling": r"""
        with recursive bits as (select i, 0 as k, i as c from range(256) t(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
        tab as (select list(c order by i) as t from bits where k = 8),
        runs as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as r from documents),
        low as (select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r, count(*) as n from runs group by 1, 2),
        hexed as (select *, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || r)) as h from low),
        hashed as (select r, n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(h) // 2), lambda i: ((strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as c from hexed, tab),
        words as materialized (select case when c % 97 = 0 then substring(r, 1, (c % length(r))::bigint) || substring(r, (c % length(r))::bigint + 2) else r end as word, cast(sum(n) as bigint) as n from hashed group by 1 having sum(n) >= 3 and length(word) >= 5),
        cut as materialized (select word, n, length(word) as size, i, substring(word, 1, i) || substring(word, i + 2) as rest from (select word, n, unnest(range(length(word))) as i from words)),
        near as materialized (select a.word as word, a.n as n, b.word as other, b.n as m from cut a join cut b on a.rest = b.rest and a.i = b.i and a.size = b.size and a.word <> b.word union select a.word, a.n, w.word, w.n from cut a join words w on w.word = a.rest union select w.word, w.n, a.word, a.n from cut a join words w on w.word = a.rest),
        best as (select word, count(*) as n_near, arg_min(struct_pack(other := other, m := m), struct_pack(m := -m, other := other)) as b from near group by 1),
        forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when b.m >= 2 * w.n then b.other end as form, case when b.m >= 2 * w.n then b.m end as form_n from words w left join best using (word)),
        walk as (select word, word as root, form as next from forms union all select walk.word, forms.word, forms.form from walk join forms on forms.word = walk.next)
        select f.word, f.form, k.root, f.n, f.n_near, f.form_n from forms f join (select word, root from walk where next is null) k using (word)""",
}
