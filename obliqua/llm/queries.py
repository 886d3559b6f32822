"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fit_labelled(docs: DataFrame, labels: DataFrame, fit):
    """A model from labels of some documents; the sample is drawn before texts are joined to it."""
    from .common import bounded_sample

    few = bounded_sample(labels.filter("toxic is not null"), "doc_id", 6000, "labelled")
    return fit(docs.join(F.broadcast(few), "doc_id"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import decisions

    return decisions(table(spark, sf_dir, "documents"), edits=2, least_bytes=20, least_equal=1, percent=5)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_features, to_media

    return media_features(to_media(table(spark, sf_dir, "documents")))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), id_remainder(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").filter(~held).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    lexicon = fit_labelled(docs, labels, fit)
    return score(docs, lexicon).withColumn("held_out", held).select("doc_id", "held_out", "score", "predicted")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest

    return digest(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, predict

    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), id_remainder(F.col("doc_id"), 4) == 2
    model = fit(docs.filter(~held))
    return predict(docs.select("doc_id", "text"), model).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import similar_classes

    return similar_classes(table(spark, sf_dir, "documents"), width=4, percent=85)


def op10_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .binary_output import token_output

    return token_output(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import checkpointed, remove_path, scratch_path
    from .warc import read_pages, write_archives

    path = scratch_path(spark, "warc")
    try:
        write_archives(table(spark, sf_dir, "pages"), path)
        return checkpointed(read_pages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    finally:
        remove_path(spark, path)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import periodic_runs, repeated_tail

    return periodic_runs(table(spark, sf_dir, "documents"), prepare=repeated_tail)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_sentencepiece, op3_line_dedup, op4_media_columns, op5_embedding_near_dedup, op6_toxicity, op7_pii, op8_language_id, op9_ngram_jaccard_join, op10_token_binary_output, op11_warc, op12_periodic_runs)}


JACCARD_SQL = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON r.doc_id = e.a)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.m) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

EMBEDDING_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.norm > 0 AND b.norm > 0 WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r(vec_id, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.m FROM r JOIN l ON r.vec_id = l.a),
c AS (SELECT vec_id, min(m) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n ON n.vec_id = c.vec_id"""


WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT page_id, html, n, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS kept FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to FROM m"""

#: The checksum of an id goes bit by bit; equal words at each lag become islands of consecutive places.
PERIODIC_SQL = """WITH h AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: [CAST(ord(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS h FROM documents),
a AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) ELSE 0 END AS a FROM h),
b AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
w AS (SELECT doc_id, n, i, CASE WHEN planted AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS w FROM b, LATERAL (SELECT unnest(range(n)) AS i)),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
l AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM l GROUP BY doc_id, start, length),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM r GROUP BY doc_id),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
g AS (SELECT DISTINCT w.doc_id, w.i FROM w JOIN r ON w.doc_id = r.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length),
c AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS kept FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.i = w.i WHERE g.i IS NULL GROUP BY w.doc_id)
SELECT h.doc_id, CAST(coalesce(t.n_runs, 0) AS BIGINT) AS n_runs, CAST(k.start AS BIGINT) AS start, CAST(k.length AS BIGINT) AS length, CAST(k.period AS BIGINT) AS period, CAST(1000 * k.length // k.period AS BIGINT) AS exponent_milli, sha256(coalesce(t.told, '')) AS runs_sha256, sha256(coalesce(c.kept, '')) AS collapsed_sha256
FROM h LEFT JOIN t ON t.doc_id = h.doc_id LEFT JOIN k ON k.doc_id = h.doc_id LEFT JOIN c ON c.doc_id = h.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL for the joins, archives and runs; the others are tested against brute force, round trips or held-out rows."""
    return {"op5_embedding_near_dedup": EMBEDDING_SQL, "op9_ngram_jaccard_join": JACCARD_SQL, "op11_warc": WARC_SQL, "op12_periodic_runs": PERIODIC_SQL}
