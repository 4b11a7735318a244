"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.llm import blockrank, bpe, brown, bucketrefine, crosspolytope, gramgroups, langid, lshforest, mixing, quality, repair, rules, secretscan
from pricetrail.llm.common import learned_from, ship_code, split_is

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = lambda spark, root: query(ship_code(spark), root)
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op1_quality_score")
def quality_score(spark: SparkSession, root: str) -> DataFrame:
    docs = read(spark, root, "documents")
    seen = learned_from(F.col("doc_id"), 4, 2)
    model = quality.fit(docs.where(seen), read(spark, root, "labels").where(seen))
    out = quality.score(docs, model, ["doc_id"])
    held_out = split_is(F.col("doc_id"), 4, 2).alias("held_out")
    return out.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@register("op2_source_mix")
def source_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.taken_words(read(spark, root, "documents"))


@register("op7_bpe_encoding")
def bpe_encoding(spark: SparkSession, root: str) -> DataFrame:
    docs = read(spark, root, "documents")
    return bpe.digests(docs, tokenizer_path(), docs.schema["doc_id"].dataType.simpleString())


@register("op8_adaptive_rules")
def adaptive_rules(spark: SparkSession, root: str) -> DataFrame:
    return rules.judge(read(spark, root, "documents"))


@register("op9_language_id")
def language_id(spark: SparkSession, root: str) -> DataFrame:
    docs = read(spark, root, "documents")
    model = langid.fit(docs.where(learned_from(F.col("doc_id"), 3, 1)))
    out = langid.predict(docs, model, ["doc_id"])
    return out.select("doc_id", split_is(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


@register("op6_minhash_forest", sql=r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), s AS (SELECT DISTINCT doc_id, w[i] || ' ' || coalesce(w[i + 1], '') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.other)
    SELECT node AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id, node = min(other) AS kept
    FROM reach LEFT JOIN n ON n.doc_id = node GROUP BY node
""")
def minhash_forest(spark: SparkSession, root: str) -> DataFrame:
    return lshforest.near_duplicates(read(spark, root, "documents"), width=2)


@register("op4_embedding_near_dup", sql="""
    WITH RECURSIVE v AS (
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0
    ), l AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.e, b.e) >= 0.93
    ), reach AS (
        SELECT vec_id AS node, vec_id AS other FROM embeddings
        UNION
        SELECT r.node, l.b FROM reach r JOIN l ON r.other = l.a
    ), least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
    n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
    SELECT node AS vec_id, coalesce(n_links, 0) AS n_links, component_id, node = component_id AS kept
    FROM least LEFT JOIN n ON n.a = node
""")
def embedding_near_dup(spark: SparkSession, root: str) -> DataFrame:
    return crosspolytope.near_duplicates(read(spark, root, "embeddings"))


@register("op10_repair_shards")
def repair_shards(spark: SparkSession, root: str) -> DataFrame:
    return repair.through_files(read(spark, root, "documents"), tokenizer_path())


@register("op3_brown_bigram")
def brown_bigram(spark: SparkSession, root: str) -> DataFrame:
    docs = read(spark, root, "documents")
    model, counts = brown.fit(docs.where(learned_from(F.col("doc_id"), 7, 2)))
    return brown.score(docs, model, counts, [split_is(F.col("doc_id"), 7, 2).alias("held_out")])


@register("op5_secret_forest")
def secret_forest(spark: SparkSession, root: str) -> DataFrame:
    found = secretscan.scan(read(spark, root, "documents"))
    return found.select("doc_id", "place", F.sha2("value", 256).alias("value_sha256"), "kind", "score", "is_secret")


@register("op11_block_rank", sql=r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
        FROM documents WHERE text IS NOT NULL
    ), sizes AS (SELECT doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
    total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM sizes),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
    weight AS (
        SELECT term, CAST(floor(1000 * ln((2 * CAST(any_value(nd) AS DOUBLE) + 2) / (2 * CAST(count(*) AS DOUBLE) + 1))) AS BIGINT) AS w
        FROM tf, total GROUP BY term
    ), entry AS (
        SELECT item_id, term, count(*) AS c FROM (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark WHERE text IS NOT NULL
        ) GROUP BY ALL
    ), scored AS (
        SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt)))) AS BIGINT) AS score
        FROM entry JOIN weight USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id
    )
    SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
    WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 20
""")
def block_rank(spark: SparkSession, root: str) -> DataFrame:
    return blockrank.search(spark, read(spark, root, "documents"), read(spark, root, "benchmark"))


@register("op12_bucket_refine", sql="""
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, CAST(strlen(coalesce(text, '')) AS BIGINT) AS nb FROM documents),
    w AS (SELECT doc_id, p, substr(hx, 2 * p + 1, 100) AS s FROM (SELECT doc_id, hx, unnest(range(nb - 49)) AS p FROM d WHERE nb >= 50)),
    hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
    run AS (
        SELECT doc_id, p, sum(CASE WHEN prev IS NULL OR p > prev + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS r
        FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM hit)
    ),
    span AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY doc_id, r),
    piece AS (
        SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS s, a AS e FROM span
        UNION ALL
        SELECT doc_id, max(b), any_value(nb) FROM span JOIN d USING (doc_id) GROUP BY doc_id
    ),
    kept AS (SELECT doc_id, string_agg(substr(hx, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS hx FROM piece JOIN d USING (doc_id) GROUP BY doc_id),
    cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM span GROUP BY doc_id)
    SELECT doc_id, nb AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
        sha256(unhex(coalesce(kept.hx, d.hx))) AS kept_sha256
    FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def bucket_refine(spark: SparkSession, root: str) -> DataFrame:
    out = bucketrefine.without_repeats(read(spark, root, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select(
        "doc.doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@register("op13_gram_groups")
def gram_groups(spark: SparkSession, root: str) -> DataFrame:
    return gramgroups.variants(read(spark, root, "documents"))
