"""What reviews found to be less than the whole job."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fitrank.llm import language_id, mixing, packing, personal_data, queries

WORD = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sources(spark, n=90):
    return spark.createDataFrame([(i, f"word{i} " * (3 + i % 5), "en", "abc"[i % 3], 0) for i in range(n)], SCHEMA)


def test_mix_query_is_in_training_order(spark, tmp_path, monkeypatch):
    sources(spark).write.parquet(str(tmp_path / "documents.parquet"))
    plan = {r.doc_id: r.positions for r in mixing.mix(sources(spark)).collect()}
    never = [d for d, p in plan.items() if not p]
    want = sorted((d for d, p in plan.items() if p), key=lambda d: (plan[d][0], d)) + sorted(never)
    rows = queries.op2_source_mixing(spark, str(tmp_path)).collect()
    got = [r.doc_id for r in rows]
    assert got == want
    assert [(r.first_position, r.last_position) for r in rows] == [(round(plan[d][0], 9), round(plan[d][-1], 9)) if plan[d] else (None, None) for d in want]
    reversed_mix = mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda docs: reversed_mix(docs, schedules=mixing.SCHEDULES[::-1]))
    other = [r.doc_id for r in queries.op2_source_mixing(spark, str(tmp_path)).collect()]
    assert other != got and sorted(other) == sorted(got)


def test_pipeline_keeps_training_positions(spark, tmp_path):
    import corpus_pipeline as p

    docs = sources(spark).withColumn(p.POSITION, F.lit(None).cast("double"))
    want = sorted(r[p.POSITION] for r in mixing.mixed_documents(sources(spark)).collect())
    mixed = p.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns and sorted(r[p.POSITION] for r in mixed.collect()) == want
    packed = p.pack_sequences(spark, mixed, "").toPandas()
    assert sorted(packed["position"]) == want
    sources(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = p.run(spark, str(tmp_path)).collect()
    first = {r.sequence_id: min(x.position for x in rows if x.sequence_id == r.sequence_id) for r in rows}
    assert [r.sequence_position for r in rows] == [first[r.sequence_id] for r in rows] == sorted(first[r.sequence_id] for r in rows)


def test_packing_takes_equal_lengths_in_training_order(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the cat and "), 300).alias("text"), (F.col("id") * 7 % 400 / 400).alias("at"))
    got = packing.pack(docs, WORD, block=32, position="at").orderBy("sequence_id", "offset").toPandas()
    assert len(got) == 400 and got["position"].is_monotonic_increasing and got["sequence_id"].nunique() > 10
    assert got["sequence_id"].nunique() == packing.pack(docs, WORD).select("sequence_id").distinct().count()


@pytest.mark.parametrize(
    "text, kind, found, source",
    [
        ("call 212 555 1234 now", "phone", "212 555 1234", "form"),
        ("Dear Mr Peter Smith thank you", "name", "Mr Peter Smith", "form"),
        ("Herr Müller kommt", "name", "Herr Müller", "form"),
        ("von Frau Anna Müller.", "name", "Frau Anna Müller", "form"),
        ("Mme E\u0301lodie Le\u0301ger dit", "name", "Mme E\u0301lodie Le\u0301ger", "form"),
        ("Dr Øystein McDonald said", "name", "Dr Øystein McDonald", "form"),
        ("ask joe [at] example [dot] org", "email", "joe [at] example [dot] org", "form"),
        ("no 123-45-6789", "id", "123-45-6789", "form"),
        ("my name is Ola Nordmann.", "name", "Ola Nordmann", "context"),
        ("passport no. AB123456, old", "id", "AB123456", "context"),
        ("so Anna Karlsson wrote", "name", "Anna Karlsson", "gazetteer"),
        ("call 212555 1234", "phone", "212555 1234", "number"),
    ],
)
def test_every_loose_pattern_is_tried(text, kind, found, source):
    at = text.index(found)
    assert (kind, at, at + len(found), False, source) in personal_data.candidate_spans(text)


@pytest.mark.parametrize("text", ["Mr is short", "Dr älter geworden", "Mr X2 and Frau Anna2", "Herrn Meier", "call 212555"])
def test_looser_names_stay_names(text):
    assert personal_data.candidate_spans(text) == []


def test_near_duplicates_stage_decides_by_row(spark):
    import corpus_pipeline as p

    text = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"else{i}" for i in range(40))
    rows = [(None, text), (None, text), (None, None), (2, text), (2, text), (5, text), (5, other), (7, ""), (7, ""), (8, None), (9, other + " more"), (9, other + " more")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA).coalesce(3)
    got = p.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    want = [(None, text), (None, text), (None, None), (2, text), (5, other), (7, ""), (8, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_short_texts_are_not_rejected_by_a_constant():
    long = [("the cat and the dog sat on the mat " * 3, "en"), ("der hund und die katze auf der matte " * 3, "de")] * 15
    model = language_id.train(long)
    assert model.floors[:7].max() == 0 and model.floors[7:].min() > 0
    (_, score, rejected), none = model.predict(["Qu.", "?"])
    assert score < 0.1 and not rejected and none == ("und", 0.0, True)
