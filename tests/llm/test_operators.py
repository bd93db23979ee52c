"""Operators on small awkward tables: nulls, empty texts, repeated rows, hot values, empty tables, extra columns."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fitrank.llm import language_id, media, mixing, near_duplicates, packing, personal_data, token_counts, token_files, tokenization, vector_search, warc

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, node long, SIZE string"
BASE = " ".join(f"word{i} and the" for i in range(60))


def documents(spark, empty=False):
    texts = [None, "", "   ", "solo", BASE, BASE, BASE.replace("word7 ", "other "), BASE.upper(), "mail me@x.org or +1 (724) 555-7214 " + "long text. " * 30000, "die katze und der hund " * 9, "the cat and the dog " * 9, "the cat and the dog " * 9]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], 0, i, i, "x") for i, t in enumerate(texts)] + [(None, "no id here", "en", "a", 0, 0, 0, "x"), (3, "solo", "en", "a", 0, 0, 0, "x")]
    return spark.createDataFrame([] if empty else rows, SCHEMA)


def ids(text, path=BYTE):
    return tokenization.library(path).encode(text or "", add_special_tokens=False).ids


def test_token_counts(spark):
    got = sorted(map(tuple, token_counts.count_tokens(documents(spark), BYTE, head=50, gathered=10).collect()), key=str)
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(ids(r.text)), len(ids(r.text)) > 1024) for r in documents(spark).collect()), key=str)
    assert got == want


def test_token_files(spark):
    got = [tuple(r) for r in token_files.encode_documents(documents(spark), BYTE, tokens_a_file=100).orderBy("start").collect()]
    rows = sorted(documents(spark).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    for r, g in zip(rows, got, strict=True):
        x = ids(r.text) + [2]
        assert g == (r.doc_id, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)


def test_packing(spark):
    got = packing.pack(documents(spark), WORD, block=2).toPandas()
    want = []
    for r in documents(spark).collect():
        x = ids(r.text, WORD) + [1]
        want += [(r.doc_id, k, a, min(4096, len(x) - a), zlib.crc32(np.array(x[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(x), 4096))]
    rows = got.astype(object).where(got.notna(), None)[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)
    assert sorted(rows, key=str) == sorted(want, key=str)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 4096


def test_packing_needs_few_sequences(spark):
    """Within one sequence in a hundred of the least possible, over a whole synthetic table."""
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), WORD)
    tokens, sequences = got.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert sequences <= -(-tokens // 4096) * 1.01 + 1 and got.where("length = 4096").groupBy("sequence_id").count().where("count > 1").isEmpty()


def test_mixing(spark):
    got = mixing.mix(documents(spark)).toPandas()
    assert len(got) == 14 and (got["taken"] <= 3 * got["size"]).all() and abs(got.groupby("source", dropna=False)["target"].first().sum() - got["size"].sum()) < 1e-6
    again = mixing.mix(documents(spark).repartition(3)).toPandas()
    assert sorted(got["taken"]) == sorted(again["taken"])
    assert all(list(p) == sorted(p) and all(0 <= x <= 1 for x in p) and len(p) == n for p, n in zip(got["positions"], got["passes"]))
    mixed = mixing.mixed_documents(documents(spark)).toPandas()
    assert len(mixed) == got["passes"].sum() and mixed["mix_position"].is_monotonic_increasing


def test_mixing_does_not_depend_on_the_layout(spark):
    """Rows of few ids with different sizes and texts, in two orders and partitionings."""
    rows = [(i % 40, f"w{i % 7} " * (1 + i * 37 % 90), "en", "ab"[i % 5 == 0], 0, i, i, "x") for i in range(600)] + [(None, "null id", "en", "a", 0, 0, 0, "x")] * 2
    told = lambda df: sorted(map(tuple, mixing.in_training_order(mixing.mix(df)).select("doc_id", "size", "taken", "first_position", "last_position").collect()), key=str)
    assert told(spark.createDataFrame(rows, SCHEMA).repartition(2)) == told(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5, "n_chars", "row"))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    rows = [r for r in documents(spark).collect() if r.doc_id is not None]
    sets = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                i = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                    root[a] = root[b] = min(root[a], root[b])
    got = near_duplicates.near_duplicates(documents(spark), width=width).collect()
    assert len(got) == 14
    for g in got:
        if g.doc_id is not None:
            assert (g.n_shingles, g.component_id, g.kept) == (len(sets[g.doc_id]), root[g.doc_id], root[g.doc_id] == g.doc_id)


def test_personal_data(spark):
    import hashlib

    from test_codecs import plain_spans

    contacts = "Mr. Peter Smith, phone 212 555 1234, mail p@x.org; card 4111 1111 1111 1111; " * 3
    more = spark.createDataFrame([(50 + i, contacts + "x" * i, "en", "a", 0, 0, 0, "x") for i in range(5)], SCHEMA)
    docs = documents(spark).union(more)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = personal_data.personal_data(docs).collect()
    assert len(got) == 19
    for r in got:
        base = plain_spans(texts[r.doc_id])
        form = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(form.encode()).hexdigest()
        every = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        loose = [s for s in every if s not in base]
        assert [s for s in every if s in base] == base and every == sorted(every, key=personal_data._by_place)
        assert all((*s, False) in [c[:4] for c in personal_data.candidate_spans(texts[r.doc_id])] for s in loose)
        assert r.doc_id is None or r.doc_id < 50 or {s[0] for s in loose} >= {"phone"}
    clean = {r.doc_id: r.text for r in personal_data.redact(docs).collect()}
    assert clean[8].startswith("mail [EMAIL] or [PHONE] long") and clean[0] is None and clean[4] == BASE
    assert "4111" not in clean[50] and "212 555" not in clean[50] and clean[54].endswith("[CARD]; xxxx")
    assert personal_data.redact(docs).columns == docs.columns


def test_media(spark):
    import hashlib

    sha = lambda x: hashlib.sha256(x).hexdigest()
    for r in media.media_features(documents(spark)).join(documents(spark).select("doc_id", "text").distinct(), "doc_id").collect():
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        stream = media.mux(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stream), sha(stream)) and "errors=0" in r.feature
        assert len(r.timestamps) == -(-len(payload) // media.UNIT) and [p.time for p in r.access_points] == r.timestamps[:: media.RAP_EVERY]


def test_language(spark):
    model = language_id.train([("the cat and the dog " * 3, "en"), ("der hund und die katze " * 3, "de")] * 5)
    got = {r.doc_id: r for r in language_id.identify(documents(spark), model).collect()}
    assert got[9].lang_pred == "de" and got[10].lang_pred == "en" and got[0].lang_pred == "und" and got[4].held_out == (zlib.crc32(b"4") % 3 == 1)
    kept = {r.doc_id for r in language_id.keep_identified(documents(spark), model).collect()}
    assert {9, 10, 11} <= kept and not kept & {0, 1, 2}


def test_language_accuracy_on_held_out_documents(spark):
    """Over a whole synthetic table: accuracy, a share of clean documents that stay, and the same model again."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    again = language_id.fit(docs.repartition(5))
    assert model.languages == again.languages and np.array_equal(model.centroids, again.centroids) and np.array_equal(model.floors, again.floors)
    rows = language_id.identify(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null and text rlike '\\\\p{L}'").toPandas()
    assert len(rows) > 250 and (rows.lang == rows.lang_pred).mean() >= 0.97 and rows.rejected.mean() <= 0.01


def test_language_sample_is_bounded(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("words of number "), F.col("id")).alias("text"), F.when(F.col("id") % 3 < 2, "en").otherwise("fr").alias("lang"))
    for options, most in (({"per_language": 50}, 50), ({"sample_rows": 30}, 15)):
        sizes = {r["lang"]: r["count"] for r in language_id.training_sample(rows, **options).groupBy("lang").count().collect()}
        assert set(sizes) == {"en", "fr"} and max(sizes.values()) == most
    ids = {r.doc_id for r in language_id.training_sample(rows).collect()}
    assert not any(zlib.crc32(str(i).encode()) % 3 == 1 for i in ids)


def test_archives(spark):
    big = "x" * 1500
    pages = spark.createDataFrame([(1, "u", big), (2, "u", big), (3, None, big), (4, "u", None), (5, "u", "s"), (6, "u", "s"), (None, "u", big)], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(pages, roll_bytes=400).collect()}
    assert got == {1: (1500, "revisit", 3), 2: (1500, "revisit", 3), 3: (1500, "response", None), 4: (0, "response", None), 5: (1, "response", None), 6: (1, "response", None), None: (1500, "response", None)}


def test_archives_are_the_same_bytes_every_time(spark, tmp_path):
    """Over two runs, other partitions of the input and other numbers of shuffle partitions."""
    rows = [(i * 7 % 1000 if i % 9 else None, f"http://h/{i}", f"<p>{i % 300}</p>" * (i % 50)) for i in range(1200)]
    manifests = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for k, partitions in enumerate((3, 7, 7)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(partitions)
            written = warc.write_archives(pages, str(tmp_path / str(k)), roll_bytes=2000, shard_rows=100)
            manifests.append(sorted((r.part, r.seq, r.file.rpartition("/")[2], r.records, r.bytes, r.sha256) for r in written.collect()))
            assert sorted(p.name for p in (tmp_path / str(k)).iterdir() if not p.name.startswith(".")) == [m[2] for m in manifests[-1]]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert manifests[0] == manifests[1] == manifests[2] and len({m[0] for m in manifests[0]}) > 5 and sum(m[3] for m in manifests[0]) == 1200


def test_archives_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 1200, "s", 1, "d", 2), (1, "u", "x" * 1200, "s", 1, "d", 2), (2, "u", "x" * 1200, "s", 1, "d", 2)], "page_id long, url string, html string, shard string, size int, DIGEST string, refers_to long")
    got = sorted((r.page_id, r.record_type, r.refers_to or 0) for r in warc.archive_pages(pages).collect())
    assert got == [(1, "revisit", 2), (1, "revisit", 2), (2, "response", 0)]


@pytest.mark.parametrize("options", [{"shard": 16, "leaf": 4, "query_block": 2, "least_block": 1}, {"shard": 8, "leaf": 2, "sample": 20, "most_cells": 3}, {}])
def test_vectors(spark, options):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(60)] + [(60, None), (61, [1.0, float("nan"), 0.0, 0.0, 0.0]), (62, []), (63, [0.1] * 5), (64, [0.1] * 5), (None, [0.1] * 5)]
    rows += [(100 + i, [0.5] * 5) for i in range(70)] + [(300 + i, [0.1 * i] * 3) for i in range(30)]
    # repeated rows, and one id with two vectors, of which the greater counts
    rows += rows[:30] + [(7, [-9.0] * 5)]
    table = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "vec_id long, embedding array<double>, dim int, SHARD int, vector int, tree int")
    got = vector_search.top_k(table, F.col("vec_id") % 20 == 0, k=7, **options).toPandas()
    v: dict = {}
    for i, x in rows:
        if i is not None and x and not np.isnan(x).any():
            v[i] = max(v.get(i, [-1e9]), np.floor(64 * np.array(x)).tolist())
    for q in (i for i in v if i % 20 == 0):
        want = sorted((-np.dot(v[q], v[j]), j) for j in v if j != q and len(v[j]) == len(v[q]))[:7]
        g = got[got.query_id == q].sort_values("rank")
        assert list(zip(-g.score, g.vec_id)) == want and g["rank"].tolist() == list(range(1, len(want) + 1))
    assert set(got.query_id) == {i for i in v if i % 20 == 0}


def test_vectors_beyond_exact_doubles(spark):
    rows = [(0, [3e9, 1.0]), (1, [3e9, 1.0]), (2, [3e9, 2.0]), (3, [-3e9, 0.0])]
    got = vector_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3, scale=1).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 9 * 10**18 + 2), (1, 9 * 10**18 + 1), (3, -9 * 10**18)]


def test_empty_tables(spark):
    e = documents(spark, empty=True)
    for f in (lambda: token_counts.count_tokens(e, BYTE), lambda: token_files.encode_documents(e, BYTE), lambda: packing.pack(e, WORD), lambda: mixing.mix(e), lambda: near_duplicates.near_duplicates(e), lambda: personal_data.personal_data(e), lambda: media.media_features(e), lambda: language_id.identify(e)):
        assert f().count() == 0
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert vector_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).count() == 0


def test_pipeline_columns(spark, tmp_path):
    import corpus_pipeline

    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    empty = docs.where("false")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_shared_folder_is_released(spark):
    from fitrank.llm import shared

    path = shared.shared_path(spark, "x")
    rows = shared.written(spark.range(3), "x")
    assert rows.count() == 3 and shared.shared_root(spark) in path
    numbers = shared.row_numbers(spark.range(100).select((F.col("id") * 37 % 100).alias("v")), [F.col("v")], "n").where("n <> v")
    assert numbers.isEmpty()
    shared.release(spark)
    assert shared.written(spark.range(3), "x").count() == 3


def test_only_the_most_frequent_languages_are_learned(spark):
    rows = [(i, "the cat and dog", "en") for i in range(9)] + [(20 + i, "der hund und katze", "de") for i in range(6)] + [(40 + i, "x y z", f"dirty {i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang for r in language_id.training_sample(docs, languages=2).collect()} == {"en", "de"}
    assert language_id.fit(docs, languages=2).languages == ("de", "en")


def test_archive_bounds_are_bounded(spark):
    pages = spark.createDataFrame([(i, "u", "h" * 2000) for i in range(500)], "page_id long, url string, html string")
    marks = warc._payloads(pages).select("page_id", "same", "size", "place")
    assert len(warc.shard_bounds(marks, shard_rows=10)) == 49 and len(warc.shard_bounds(marks, shard_rows=10, most_shards=4)) == 3
