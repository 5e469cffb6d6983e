"""The registered queries of this package and their SQL, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlake.llm import eliasfano, fptree, kmeans, licences, minhash, mixing, packing, quality, suffix, topk, toxicity, warc, winnow

VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"), least_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"), VOCABULARY, end_id=2, capacity=1024)[1]


def op3_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly"
    )


def op4_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80).drop("text_hash")


def op5_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(_table(spark, sf_dir, "documents"))


def op6_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)
    row = F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))
    return decided.withColumn("__row", row).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def op7_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fitted(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_suffix_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeat_removal(_table(spark, sf_dir, "documents"), length=200)


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compared(_table(spark, sf_dir, "documents"))


def op10_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eliasfano.token_files(_table(spark, sf_dir, "documents"), VOCABULARY, end_id=0)


def op11_block_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.clustered(_table(spark, sf_dir, "embeddings"), dims=64, k=16, rounds=3)


def op13_document_fptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fptree.best_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_dictionary": op1_warc_dictionary,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_isolation_forest": op3_isolation_forest,
        "op4_circulant_minhash": op4_circulant_minhash,
        "op5_licence_digests": op5_licence_digests,
        "op6_pivotal_mixing": op6_pivotal_mixing,
        "op7_toxicity_grammar": op7_toxicity_grammar,
        "op8_suffix_blocks": op8_suffix_blocks,
        "op9_winnowing": op9_winnowing,
        "op10_elias_fano_tokens": op10_elias_fano_tokens,
        "op11_block_pruning": op11_block_pruning,
        "op12_centroid_clusters": op12_centroid_clusters,
        "op13_document_fptree": op13_document_fptree,
    }


#: Upper-case base32 of a SHA-1: eight groups of 20 bits, four letters each.
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr({hex}, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1)), '')"

ORACLES = {
    "op1_warc_dictionary": f"""
        with digests as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hex from pages),
        firsts as (select hex, min(page_id) as first from digests group by hex)
        select page_id, octet_length(encode(payload)) as payload_bytes, {_BASE32.format(hex="d.hex")} as payload_digest,
            case when page_id = first then 'response' else 'revisit' end as record_type,
            case when page_id = first then null else first end as refers_to
        from digests d join firsts f on d.hex = f.hex
    """,
    "op4_circulant_minhash": r"""
        with recursive texts as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
            from documents
        ), shingles as (
            select distinct doc_id, unnest(case when len(words) < 2 then words
                else list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) end) as shingle
            from texts
        ), sizes as (
            select doc_id, count(shingle) as n from texts left join shingles using (doc_id) group by doc_id
        ), links as (
            select a.doc_id as a, b.doc_id as b from shingles a join shingles b on a.shingle = b.shingle and a.doc_id <> b.doc_id
            join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
            group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))
        ), reached as (
            select doc_id, doc_id as other from sizes union select r.doc_id, l.b from reached r join links l on l.a = r.other
        )
        select doc_id, any_value(n) as n_shingles, min(other) as component_id, doc_id = min(other) as kept
        from sizes join reached using (doc_id) group by doc_id
    """,
    "op8_suffix_blocks": """
        with bytes as (
            select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents
        ), places as (
            select doc_id, h, n, unnest(range(n)) as i from bytes
        ), windows as (
            select doc_id, i, n, substr(h, 2 * i + 1, 2) as byte, case when i + 200 <= n then md5(substr(h, 2 * i + 1, 400)) end as print from places
        ), counted as (
            select *, print is not null and count(*) over (partition by print) > 1 as again from windows
        ), covered as (
            select doc_id, i, byte, bool_or(again) over (partition by doc_id order by i rows 199 preceding) as gone from counted
        ), edges as (
            select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as opens from covered
        ), found as (
            select doc_id, count(*) filter (gone) as n_removed, count(*) filter (opens) as n_spans,
                   string_agg(byte, '' order by i) filter (not gone) as kept
            from edges group by doc_id
        )
        select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
               sha256(unhex(coalesce(kept, ''))) as kept_sha256
        from bytes left join found using (doc_id)
    """,
    "op11_block_pruning": """
        with vectors as (
            select row_number() over () as place, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select q.place, q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(c.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
            from vectors q, vectors c where q.vec_id % 20 = 0 and q.place <> c.place
        ), ranked as (
            select *, row_number() over (partition by place order by score desc, vec_id nulls last)::int as rank from scored
        )
        select query_id, rank, vec_id, score from ranked where rank <= 20
    """,
    "op13_document_fptree": r"""
        with words as (
            select row_number() over () as doc, doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') as terms
            from documents
        ), asked as (
            select distinct item, item_id, unnest(terms) as term from (
                select row_number() over () as item, item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') as terms
                from benchmark)
        ), sizes as (
            select doc, doc_id, len(terms)::bigint as n from words where len(terms) > 0
        ), totals as (
            select count(*)::bigint as docs, sum(n)::bigint as length from sizes
        ), counts as (
            select doc, term, count(*)::bigint as tf from (select doc, unnest(terms) as term from words) group by doc, term
        ), weights as (
            select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)::double))::bigint as w from counts, totals group by term
        ), scored as (
            select item, item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // length))))::bigint as score
            from asked join counts using (term) join weights using (term) join sizes using (doc), totals
            group by item, item_id, doc, doc_id
        ), ranked as (
            select *, row_number() over (partition by item order by score desc, doc_id nulls last)::int as rank from scored where score > 0
        )
        select item_id, rank, doc_id, score from ranked where rank <= 10
    """,
}


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds written out: each assigns in one subquery and averages in the next."""
    nearest = """
        select place, vec_id, v, (best).cluster as cluster, (best).distance as distance from (
            select place, vec_id, v, min(struct_pack(distance := list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::bigint, cluster := cluster)) as best
            from vectors, {centroids} group by place, vec_id, v)"""
    steps = []
    for at in range(rounds):
        steps.append(f"assigned{at} as ({nearest.format(centroids=f'centroids{at}')})")
        steps.append(f"""means{at} as (
            select cluster, list(mean order by i) as c from (
                select cluster, i, ((s - ((s % n) + n) % n) // n)::bigint as mean from (
                    select cluster, i, sum(v[i])::bigint as s, count(*)::bigint as n from assigned{at}, range(1, 65) t(i) group by cluster, i))
            group by cluster)""")
        steps.append(f"""centroids{at + 1} as (
            select o.cluster, coalesce(m.c, o.c) as c from centroids{at} o left join means{at} m on m.cluster = o.cluster)""")
    steps.append(f"final as ({nearest.format(centroids=f'centroids{rounds}')})")
    return f"""
        with vectors as (
            select row_number() over () as place, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v
            from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), centroids0 as (
            select (row_number() over (order by sha256('1:' || vec_id) nulls last, v) - 1)::int as cluster, v as c
            from vectors order by cluster limit {k}
        ), {", ".join(steps)},
        inertias as (select cluster, sum(distance)::bigint as cluster_inertia from final group by cluster)
        select vec_id, cluster, distance, cluster_inertia, (select sum(cluster_inertia)::bigint from inertias) as inertia,
            sha256(array_to_string(list_transform(c, lambda x: x::varchar), ',')) as centroid_sha256
        from final join inertias using (cluster) join centroids{rounds} using (cluster)
    """


def oracles() -> dict[str, str]:
    return ORACLES | {"op5_licence_digests": licences.scan_sql(), "op12_centroid_clusters": _clusters_sql()}
