"""Queries of the training-data operators over the whole of their tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import hard_negatives, language_id, language_model, media, mixing, near_duplicates, packing, personal_data, spelling, token_counts, token_files, vector_search, warc
from .shared import table

BYTE_FILE, WORD_FILE = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_FILE))


def op2_source_mixing(spark, sf_dir):
    """Documents in training order with their first and last training position; those that are not taken come last."""
    return mixing.in_training_order(mixing.mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "first_position", "last_position")


def op3_exact_top_k(spark, sf_dir):
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op4_token_files(spark, sf_dir):
    return token_files.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_FILE))


def op5_near_duplicates(spark, sf_dir):
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op6_personal_data(spark, sf_dir):
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


def op7_media_columns(spark, sf_dir):
    """Timestamps and random-access points (time@packet) as texts."""
    points = F.transform("access_points", lambda p: F.concat_ws("@", p["time"], p["packet"]))
    return media.media_features(table(spark, sf_dir, "documents")).withColumns({"timestamps": F.array_join("timestamps", ","), "access_points": F.array_join(points, ",")})


def op8_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(WORD_FILE))


def op9_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op11_language_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = language_model.is_held_out()
    model = language_model.train(docs.where(~held_out))
    return language_model.score(docs, model).withColumns({"held_out": held_out, "train_tokens": F.lit(model.tokens).cast("long")})


def op12_spelling_variants(spark, sf_dir):
    """One run in 199 loses a letter first, as the query is defined."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), slips=199)


def op13_hard_negatives(spark, sf_dir):
    """Every seventh id's label is one higher, as the query is defined."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_source_mixing, op3_exact_top_k, op4_token_files, op5_near_duplicates, op6_personal_data, op7_media_columns, op8_best_fit_packing, op9_language_id, op10_warc, op11_language_model, op12_spelling_variants, op13_hard_negatives)}


def _positions_sql() -> str:
    """First and last training position by the schedule of the source's number."""
    share = "CASE WHEN {k} < whole THEN ({k} * source_size + middle) / target ELSE least(1::DOUBLE, (whole * source_size + middle * rest / source_size) / target) END"
    columns = []
    for name, k in (("first_position", "0"), ("last_position", "(passes - 1)")):
        time = " ".join(f"WHEN number % {len(mixing.SCHEDULES)} = {i} THEN {mixing.schedule_sql(f'({share.format(k=k)})', knots)}" for i, knots in enumerate(mixing.SCHEDULES))
        columns.append(f"round(CASE WHEN passes > 0 THEN CASE {time} END END, 9) AS {name}")
    return ", ".join(columns)


ORACLE_SQL = {
    "op2_source_mixing": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS mark, md5(coalesce(text, '')) AS text_mark FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM s),
w AS (SELECT *, number % 3 + 1 AS weight, source_size * 3 AS cap FROM n),
l AS (SELECT *, row_number() OVER o AS step,
        CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, number)),
r AS (SELECT first(level ORDER BY step) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT l.source, l.source_size, l.number, least(CAST(l.cap AS DOUBLE), coalesce(r.level, 'inf'::DOUBLE) * l.weight) AS target FROM l LEFT JOIN r ON true),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
e AS (SELECT d.*, q.source_size, q.number, q.target, q.whole, q.target - q.whole * q.source_size AS rest, d.size * 256 > q.source_size AS long FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, long ORDER BY mark, doc_id NULLS FIRST, size, text_mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        coalesce(sum(size) FILTER (WHERE long) OVER (PARTITION BY source), 0) AS long_size FROM e),
c AS (SELECT *, CAST(before * 2 + size AS DOUBLE) <= 2 * (rest * long_size / source_size) AS long_again FROM b),
f AS (SELECT *, coalesce(sum(size) FILTER (WHERE long AND long_again) OVER (PARTITION BY source), 0) AS spent FROM c),
g AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN CASE WHEN long THEN long_again ELSE CAST(before * 2 + size AS DOUBLE) <= 2 * (rest - spent) END THEN 1 ELSE 0 END END AS passes,
        before + size / 2 + CASE WHEN long THEN 0 ELSE long_size END AS middle FROM f)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * passes AS BIGINT) AS taken, {_positions_sql()} FROM g""",
    "op3_exact_top_k": """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vector, c.vector) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vector) = len(c.vector) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op5_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
  ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS s FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
c(node, root) AS (SELECT doc_id, doc_id FROM g UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.node),
m AS (SELECT node, min(root) AS component_id FROM c GROUP BY node)
SELECT g.doc_id, CAST(len(g.shingles) AS BIGINT) AS n_shingles, m.component_id, g.doc_id = m.component_id AS kept FROM g JOIN m ON g.doc_id = m.node""",
    "op10_warc": """
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS holder FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < holder THEN holder END AS refers_to FROM d""",
    "op13_hard_negatives": """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_inner_product(a.vector, c.vector) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.vector) = len(c.vector) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}
