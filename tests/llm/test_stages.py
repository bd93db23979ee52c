"""Each stage of the pipeline against a plain, single-process version of what it promises."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from fitrank.llm import language_id, mixing, personal_data, tokenization

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    """A synthetic table and awkward rows: null ids, repeated rows, null and empty texts, a null source, no letters."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select([c.split()[0] for c in SCHEMA.split(", ")])
    texts = table.orderBy("doc_id").limit(3).collect()
    odd = [(None, texts[0].text, "en", "a", 1), (None, None, None, None, 0), (9001, texts[1].text, "en", None, 1), (9001, texts[1].text, "en", None, 1), (9002, "", "en", "a", 0), (9003, "12 34", None, "b", 5), (9004, "the cat and " * 5000, "en", "b", 60000)]
    return table.union(spark.createDataFrame(odd, SCHEMA))


def rows_of(df, columns=None):
    return sorted((tuple(r) for r in (df.select(columns) if columns else df).collect()), key=str)


def test_language(spark, docs):
    model = language_id.fit(docs)
    rows = docs.collect()
    kept = [tuple(r) for r, (_, _, rejected) in zip(rows, model.predict([r.text for r in rows])) if not rejected]
    got = pipeline.identify_language(spark, docs, "")
    assert rows_of(got, docs.columns) == sorted(kept, key=str) and got.columns == [*docs.columns, pipeline.POSITION]
    assert len(rows) * 0.9 < len(kept) < len(rows)


def test_near_duplicates(spark, docs):
    rows, sets = docs.collect(), {}
    for i, r in enumerate(rows):
        w = (r.text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {r.doc_id: r.doc_id for r in rows if r.doc_id is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = defaultdict(list)
    for i, s in sets.items():
        if rows[i].doc_id is not None:
            for x in s:
                by_shingle[x].append(i)
    pairs = Counter((a, b) for own in by_shingle.values() for k, a in enumerate(own) for b in own[k + 1 :])
    for (a, b), n in pairs.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(rows[a].doc_id), find(rows[b].doc_id)))
            root[y] = x
    want = [tuple(r) for r in rows if r.doc_id is None]
    want += list({tuple(r) for r in rows if r.doc_id is not None and find(r.doc_id) == r.doc_id})
    got = rows_of(pipeline.drop_near_duplicates(spark, docs, ""))
    assert got == sorted(want, key=str) and len(want) < len(rows) - 3


def test_personal_data_is_replaced(spark, docs):
    rows = docs.collect()
    found = [personal_data._candidates(r.text, personal_data.GAZETTEERS) for r in rows]
    weights = personal_data.fit(personal_data.find_candidates(docs))
    want = []
    for r, spans in zip(rows, found):
        text = r.text
        if text:
            marks = [None] * len(text)
            for s in sorted((s for s in spans if s["base"] or personal_data.accepted(weights, s["features"])), key=lambda s: (s["start"], personal_data.KINDS.index(s["kind"]))):
                run = next((marks[i] for i in range(s["start"], s["end"]) if marks[i]), None) or (s["start"], s["kind"])
                for i in range(s["start"], s["end"]):
                    marks[i] = marks[i] or run
            text = "".join(c if not m else (f"[{m[1].upper()}]" if m[0] == i else "") for i, (c, m) in enumerate(zip(text, marks)))
        want.append((r.doc_id, text, r.lang, r.source, len(text) if text is not None else None))
    got = rows_of(pipeline.redact_personal_data(spark, docs, ""))
    assert got == sorted(want, key=str) and sum(a != r.text for (_, a, *_), r in zip(want, rows)) > 3


def plain_mix(rows):
    """{row: positions} of the mix, by plain loops and bisection."""
    sizes = [len(re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode())) for r in rows]
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    own = {s: [i for i, r in enumerate(rows) if r.source == s] for s in sources}
    whole = {s: sum(sizes[i] for i in own[s]) for s in sources}
    weight = {s: n % 3 + 1 for n, s in enumerate(sources)}
    capped: set = set()
    while True:
        level = (sum(whole.values()) - sum(3 * whole[s] for s in capped)) / max(1, sum(weight[s] for s in sources if s not in capped))
        more = {s for s in sources if s not in capped and level * weight[s] > 3 * whole[s]}
        if not more:
            break
        capped |= more
    target = {s: 3 * whole[s] if s in capped else level * weight[s] for s in sources}
    out = {}
    for n, s in enumerate(sources):
        if not whole[s]:
            out |= {i: [] for i in own[s]}
            continue
        full, rest = int(target[s] // whole[s]), target[s] - int(target[s] // whole[s]) * whole[s]
        order = sorted(own[s], key=lambda i: (sizes[i] * 256 <= whole[s], hashlib.md5(str("" if rows[i].doc_id is None else rows[i].doc_id).encode()).hexdigest()))
        long_size = sum(sizes[i] for i in own[s] if sizes[i] * 256 > whole[s])
        knots = mixing.SCHEDULES[n % 3]
        times = np.array([t for t, _ in knots])
        rates = np.array([r for _, r in knots])

        def demand(t):
            """Share of the source's demand before a time."""
            def area(to):
                grid = np.unique(np.concatenate([times[times < to], [to]]))
                return float(np.trapezoid(np.interp(grid, times, rates), grid))
            return area(t) / area(1.0)

        def at(share):
            low, high = 0.0, 1.0
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (mid, high) if demand(mid) < share else (low, mid)
            return high

        before, spent = {True: 0, False: 0}, 0
        chosen = {}
        for is_long in (True, False):
            quota = rest * long_size / whole[s] if is_long else rest - spent
            for i in order:
                if (sizes[i] * 256 > whole[s]) == is_long:
                    again = sizes[i] > 0 and before[is_long] * 2 + sizes[i] <= 2 * quota
                    middle = before[is_long] + sizes[i] / 2 + (0 if is_long else long_size)
                    chosen[i] = ((full + again) if sizes[i] else 0, middle)
                    before[is_long] += sizes[i]
                    spent += sizes[i] * (again and is_long)
        for i, (passes, middle) in chosen.items():
            shares = [(k * whole[s] + middle) / target[s] if k < full else min(1, (full * whole[s] + middle * rest / whole[s]) / target[s]) for k in range(passes)]
            out[i] = [at(x) for x in shares]
    return out


def test_mixing(spark, docs):
    rows = [r for r in docs.collect() if (r.doc_id or 0) != 9001]
    table = spark.createDataFrame([(*r, None) for r in rows], SCHEMA + f", {pipeline.POSITION} double")
    want = sorted(((rows[i].doc_id, rows[i].text, p) for i, positions in plain_mix(rows).items() for p in positions), key=lambda x: x[2])
    got = [(r.doc_id, r.text, r[pipeline.POSITION]) for r in pipeline.mix_sources(spark, table, "").collect()]
    assert [p for *_, p in got] == sorted(p for *_, p in got) and len(got) == len(want) > len(rows) / 2
    by_row = lambda x: (str(x[0]), str(x[1]), x[2])
    for a, b in zip(sorted(got, key=by_row), sorted(want, key=by_row)):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-9)


def test_packing(spark, docs):
    rows = [(*r, i / 1000) for i, r in enumerate(docs.collect())]
    table = spark.createDataFrame(rows, SCHEMA + f", {pipeline.POSITION} double")
    got = pipeline.pack_sequences(spark, table, "").toPandas()
    want = []
    for doc_id, text, *_, position in rows:
        ids = tokenization.library(WORD).encode(text or "", add_special_tokens=False).ids + [1]
        want += [(doc_id, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()), position) for k, a in enumerate(range(0, len(ids), 4096))]
    cells = got.astype(object).where(got.notna(), None)[["doc_id", "piece", "start", "length", "ids_crc32", "position"]].itertuples(index=False, name=None)
    assert sorted(cells, key=str) == sorted(want, key=str)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 4096
    tokens = sum(w[3] for w in want)
    assert got["sequence_id"].nunique() <= -(-tokens // 4096) * 1.02 + 1


def test_run_applies_all_stages(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    step = docs
    for _, stage in pipeline.STAGES:
        step = stage(spark, step, str(tmp_path))
    got = pipeline.run(spark, str(tmp_path))
    assert got.columns == step.columns
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(rows_of(got, columns)) == Counter(rows_of(step, columns))
