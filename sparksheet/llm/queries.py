"""The subpackage's registered queries: thin digests of what its operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, lexical, licenses, lines, media, mixing, neardup, negatives, packing, parity, quality, secrets, topk
from .common import table, text_of


def tokenizer_path(spark: SparkSession | None = None) -> str:
    """Where the tokenizer lies; given a session, it is shipped with its jobs too."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    if spark:
        spark.sparkContext.addFile(path)
    return path


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, and all documents with their source as the host.  Each half of the documents is judged by grams learned from the other half; their given language is no evidence there.  Pages are judged by all."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    half = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)).cast("int")
    counts = [langid.learn_counts(docs.where(half == i), "lang", "text") for i in (0, 1)]
    langs, by_all = langid.likelihoods(*counts)
    tables = [langid.likelihoods(counts[1], langs=langs)[1], langid.likelihoods(counts[0], langs=langs)[1], by_all]
    web = langid.of_pages(pages).select(F.lit(None).cast("long").alias("doc_id"), "page_id", "t", "declared", "address", "host", "domain", F.lit(2).alias("fold"))
    own = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), text_of().alias("t"), F.lit("").alias("declared"), F.lit("").alias("address"), F.col("source").alias("host"), F.lit("").alias("domain"), half.alias("fold"))
    return langid.identify(web.unionByName(own), langs, tables, ["doc_id", "page_id"])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "removed", "text")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), tokenizer_path(spark))
    return packing.pack(pieces)


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["from"].cast("string"), s["to"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != secrets.KINDS[3])
    return found.select("doc_id", *[count(k) for k in secrets.KINDS], F.sha2(show(base), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.png_features(media.to_png(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    base, spans = F.col("base.label"), F.col("spans.label")
    starts = F.col("base.at").cast("array<bigint>")
    score = F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max("spans.score"), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.concat(base, spans)).alias("labels"), F.least(score, F.lit(1.0)).alias("score")
    )


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector bears the next label, so that its anchors' negatives are as near as can be."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.jaccard_groups(table(spark, sf_dir, "documents"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_langid": op1_langid, "op2_mixing": op2_mixing, "op4_lines": op4_lines, "op5_quality": op5_quality, "op3_pack": op3_pack, "op6_neardup": op6_neardup, "op7_secrets": op7_secrets, "op8_topk": op8_topk, "op9_media": op9_media, "op10_licenses": op10_licenses, "op11_negatives": op11_negatives, "op12_jaccard": op12_jaccard, "op13_lexical": op13_lexical}
ORACLES: dict[str, str] = {
    "op8_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(generate_series(1, least(len(q.w), len(c.w))), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op6_neardup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        r(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
        c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op11_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(generate_series(1, least(len(a.w), len(c.w))), lambda i: a.w[i] * c.w[i])) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""",
    "op13_lexical": r"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
        s AS (SELECT count(*) FILTER (len(ws) > 0) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM t),
        m AS (SELECT r, doc_id, 25 + (75 * len(ws) * s.n) // s.l AS m FROM t, s WHERE len(ws) > 0),
        p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM t) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2.0 * s.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, s.n),
        q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        a AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL),
        k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM a JOIN m USING (r) WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10""",
}
ORACLES["op12_jaccard"] = ORACLES["op6_neardup"].replace("100 * k >= 80", "100 * k >= 85").replace(", doc_id = component_id AS kept", "")
