"""Registered queries of the training-data operators: ``opN_<name>`` takes (spark, folder of tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm import decontamination, embedding_dedup, mixing, packing, quality, resampling, secrets, simhash, suffix_dedup, token_counts, toxicity, training_order, vector_codes


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that lie in a 200-byte string found elsewhere, removed."""
    return suffix_dedup.without_repeats(table(spark, folder, "documents"))


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every embedding."""
    return embedding_dedup.near_duplicate_vectors(table(spark, folder, "embeddings"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram tokens of every document."""
    return token_counts.token_counts(table(spark, folder, "documents"))


def op5_quality_outliers(spark: SparkSession, folder: str) -> DataFrame:
    """Base statistics and robust verdict of every document."""
    return quality.judged(table(spark, folder, "documents"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in their sequences, with a checksum of their ids."""
    pieces = packing.pack_documents(table(spark, folder, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secret spans of every document."""
    return secrets.summarised(secrets.find_secrets(table(spark, folder, "documents")))


def op8_training_order(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest of the shards that hold all documents in training order."""
    return training_order.write_shards(table(spark, folder, "documents"))


#: Domains are the combinations of both labels; weights are shares of the token total.
DOMAIN = "concat('quality', quality, '-toxic', toxic)"
TARGETS = {"quality0-toxic0": 0.10, "quality0-toxic1": 0.02, "quality1-toxic0": 0.85, "quality1-toxic1": 0.03}


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Chances and rate of every document for the target weights."""
    labels = table(spark, folder, "labels").selectExpr("doc_id", f"{DOMAIN} as domain")
    rated, domains = mixing.mixing_rates(table(spark, folder, "documents"), labels, TARGETS)
    chances = [F.expr(f"chances[{k}]").alias(f"p_{name.replace('-', '_')}") for k, name in enumerate(domains)]
    return rated.select("doc_id", "n_tokens", *chances, "rate")


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learnt from the rows that are not held out."""
    docs = table(spark, folder, "documents")
    held_out = toxicity.is_held_out(F.col("doc_id"))
    model = toxicity.fit_toxicity(docs, table(spark, folder, "labels").where(~held_out))
    scored = docs.select(
        "doc_id", held_out.alias("held_out"), toxicity.toxicity_score(model, F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", F.expr("cast(score >= 0.5 as int)"))


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside occurrences of benchmark windows, and the items they come from."""
    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontamination.summarised(decontamination.find_contamination(docs, benchmark))


def op12_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Importance weights of every document towards the benchmark's n-gram buckets, and the drawn ranks."""
    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return resampling.resample(docs, benchmark)


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Product-quantisation code of every embedding, its error, and the digest of the trained codebooks."""
    return vector_codes.compressed(table(spark, folder, "embeddings"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_simhash": op3_simhash,
    "op4_token_counts": op4_token_counts,
    "op5_quality_outliers": op5_quality_outliers,
    "op6_packing": op6_packing,
    "op7_secrets": op7_secrets,
    "op8_training_order": op8_training_order,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_decontamination": op11_decontamination,
    "op12_resampling": op12_resampling,
    "op13_vector_codes": op13_vector_codes,
}
ORACLE = {
    "op1_suffix_dedup": """
        with texts as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        windows as (
            select doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) as k
            from (select doc_id, h, unnest(range(0, len(h) // 2 - 199)) as i from texts)),
        repeated as (
            select doc_id, i from windows where k in (select k from windows group by k having count(*) > 1)),
        marked as (
            select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 200, true) as fresh
            from repeated),
        numbered as (
            select doc_id, i, sum(fresh::int) over (partition by doc_id order by i rows unbounded preceding) as span from marked),
        spans as (select doc_id, min(i) as a, max(i) + 200 as e from numbered group by doc_id, span),
        pieces as (
            select doc_id, coalesce(lag(e) over (partition by doc_id order by a), 0) as first, a as last from spans
            union all
            select doc_id, coalesce(max(e), 0), any_value(len(h)) // 2 from texts left join spans using (doc_id) group by doc_id),
        kept as (
            select doc_id, string_agg(substr(h, 2 * first + 1, 2 * (last - first)), '' order by first, last) as rest
            from pieces join texts using (doc_id) group by doc_id),
        gone as (select doc_id, count(*) as n_spans, sum(e - a) as n_removed from spans group by doc_id)
        select doc_id, len(h) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans,
               sha256(unhex(rest)) as kept_sha256
        from texts join kept using (doc_id) left join gone using (doc_id)
    """,
    "op2_embedding_dedup": """
        with recursive clean as (
            select vec_id, embedding::double[] as v from embeddings
            where vec_id is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        pairs as (
            select a.vec_id as a, b.vec_id as b from clean a join clean b on a.vec_id <> b.vec_id
            and list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.95),
        reach as (
            select vec_id as node, vec_id as root from embeddings
            union
            select p.b, r.root from reach r join pairs p on p.a = r.node)
        select node as vec_id, coalesce(n, 0) as n_links, min(root) as component_id, min(root) = node as kept
        from reach left join (select a, count(*) as n from pairs group by a) on a = node
        group by node, n
    """,
    "op11_decontamination": r"""
        with d as (
            select doc_id, row_number() over () as r,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
            from documents),
        b as (
            select item_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
            from benchmark),
        starts as (select item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) as i from b where len(w) > 0),
        win as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') as g from starts),
        lens as (select distinct n from win),
        placed as (select r, n, w, unnest(range(0, len(w) - n + 1)) as p from d, lens),
        grams as (select r, n, p, array_to_string(w[p + 1 : p + n], ' ') as g from placed),
        found as (select distinct r, p, n, item_id from grams join win using (n, g)),
        hit as (select r, count(distinct p + k) as n_hit from (select r, p, unnest(range(0, n)) as k from found) group by r),
        items as (
            select r, count(distinct item_id) as n_items,
                   array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as s
            from found where item_id is not null group by r)
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
               sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join hit using (r) left join items using (r)
    """,
}
