"""Language models, spelling variants and hard negatives against plain versions, on small awkward tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fitrank.llm import hard_negatives, language_model, queries, spelling

SCHEMA = "doc_id long, text string, n long, word string, WORD_ string, bucket int, level int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", 0, 0) for i, t in rows], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


# --- language model ----------------------------------------------------------------------------------------------------


class PlainKneserNey:
    """Interpolated modified Kneser-Ney by dictionaries; a text begins with one begin word."""

    def __init__(self, texts, order):
        self.order = order
        raw = Counter()
        for t in texts:
            x = [None] * (order - 2) + [b"<s>"] + words(t) + [b"\n"]
            x = x if order > 1 else x[1:]
            for i in range(max(1, order - 1) if order > 1 else 0, len(x)):
                raw[tuple(x[max(0, i - order + 1) : i + 1])] += 1
        self.unigrams = Counter(w for t in texts for w in [*words(t), b"\n"])
        self.levels, self.cuts = {}, {}
        for k in range(order, 0, -1):
            self.levels[k] = {g: n for g, n in raw.items() if g[0] is not None}
            n = [sum(c == i for c in self.levels[k].values()) for i in range(1, 5)]
            self.cuts[k] = language_model.discounts(n)
            lower = Counter()
            for g, n in raw.items():
                lower[g[1:]] += n if g[0] is None else 1
            raw = lower
        self.contexts = {k: defaultdict(list) for k in self.levels}
        for k, grams in self.levels.items():
            for g, n in grams.items():
                self.contexts[k][g[:-1]].append(n)

    def probability(self, gram):
        p = 1 / (len(self.unigrams) + 1)
        for k in range(1, len(gram) + 1):
            g = gram[-k:]
            seen = self.contexts[k].get(g[:-1])
            if seen:
                own = self.levels[k].get(g, 0)
                p = (own - self.cuts[k][min(own, 3)] + sum(self.cuts[k][min(n, 3)] for n in seen) * p) / sum(seen)
        return p

    def score(self, text):
        x = [b"<s>", *words(text), b"\n"]
        return sum(math.log10(self.probability(tuple(x[max(0, i - self.order + 1) : i + 1]))) for i in range(1, len(x)))


def corpus():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 40), p=np.arange(30, 0, -1) / 465))) for i in range(60)]
    return rows + [(60, None), (61, ""), (62, " \t\x0b "), (63, "W1 É unknown w2 " * 200), (None, "w1 w2"), (5, "w1 w2"), (70, rows[0][1]), (71, "é É é")]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model(spark, order):
    rows = corpus()
    docs = documents(spark, rows)
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    training = [t for i, t in rows if not held[i]]
    assert any(held.values())
    model = language_model.train(docs.where(~language_model.is_held_out()), order=order, bucket=50)
    plain = PlainKneserNey(training, order)
    assert model.tokens == sum(plain.unigrams.values()) and model.words == len(plain.unigrams)
    assert model.discounts == tuple(plain.cuts[k] for k in range(1, order + 1))
    got = language_model.score(docs, model).collect()
    want = []
    for i, t in rows:
        x = [*words(t), b"\n"]
        base = sum(math.log10((plain.unigrams[w] + 1) / (model.tokens + len(plain.unigrams) + 1)) for w in x)
        want.append((i, len(x), sum(w in plain.unigrams for w in x), base, plain.score(t)))
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=lambda r: (str(r[0]), r[1])), sorted(want, key=lambda r: (str(r[0]), r[1])), strict=True):
        assert g[:3] == w[:3] and g[3:5] == pytest.approx(w[3:], rel=1e-9)
        assert g[5] == pytest.approx(10 ** (-w[4] / w[1]), rel=1e-9)


def hash_of(word):
    return language_model.tokens(pa.array([word.decode()]))[0][0]


def test_tokens_in_pieces(monkeypatch):
    """Words and ends are the same however the buffer is cut; equal words and only they have equal hashes."""
    rng = np.random.default_rng(0)
    texts = [None, "", " ", "a", "ab ba AB", "É é\x85É\u00a0x", "long" * 500 + " long", *(" ".join(f"w{rng.integers(0, 99)}" for _ in range(int(rng.integers(0, 60)))) + " " * int(rng.integers(0, 3)) for _ in range(50)), None, "last"]
    column = pa.array(["cut off", *texts, "cut off too"]).slice(1, len(texts))
    whole, lengths = language_model.tokens(column)
    assert lengths.tolist() == [len(words(t)) + 1 for t in texts]
    of = {}
    for w, h in zip([x for t in texts for x in [*words(t), b"\n"]], whole.tolist(), strict=True):
        assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)
    for size in (1, 7, 64):
        monkeypatch.setattr(language_model, "PIECE_BYTES", size)
        again, n = language_model.tokens(column)
        assert (again == whole).all() and (n == lengths).all()
    assert language_model.tokens(pa.array([], pa.string()))[0].tolist() == []
    hidden = pa.Array.from_buffers(pa.string(), 3, [pa.py_buffer(b"\x05"), pa.py_buffer(np.array([0, 2, 5, 6], np.int32).tobytes()), pa.py_buffer(b"aab bc")])
    assert language_model.tokens(hidden)[1].tolist() == [2, 1, 2]


def test_probabilities_sum_to_one(spark):
    rows = corpus()
    model = language_model.train(documents(spark, rows), order=3, bucket=100)
    vocabulary = sorted({w for _, t in rows for w in words(t)}) + [b"\n", b"never seen"]
    for history in ([], [b"w1"], [b"w1", b"w2"], [b"never"], [b"w3", b"never"]):
        numbers, _ = model.lookup_words(np.array([language_model.END if w == b"\n" else hash_of(w) for w in [*history, *vocabulary]], np.uint64))
        start = [language_model.BEGIN, *numbers[: len(history)].tolist()]
        streams = np.array([x for n in numbers[len(history) :].tolist() for x in [*start, n]], np.uint32)
        place = np.tile(np.arange(len(start) + 1), len(vocabulary))
        logs = model.log10(streams, place)[place == len(start)]
        assert (10.0**logs).sum() == pytest.approx(1, rel=1e-9)


def test_windows_of_long_texts(spark, monkeypatch):
    rows = corpus()
    model = language_model.train(documents(spark, rows), order=3)
    texts = pa.array([t for _, t in rows])
    whole = language_model.score_texts(model, texts)
    monkeypatch.setattr(language_model, "CHUNK_TOKENS", 7)
    parts = language_model.score_texts(model, texts)
    assert all(a.tolist() == pytest.approx(b.tolist()) for a, b in zip(parts, whole))


def test_files_that_cannot_be_mapped_are_few(monkeypatch, tmp_path):
    from fitrank.llm.shared import put_file

    h = np.arange(1, 1001, dtype=np.uint64) << np.uint64(54)
    for b in range(4):
        own = h[language_model.bucket_of(h, 4) == b]
        put_file(str(tmp_path), f"level-{b:08d}", language_model.file_bytes(own, np.array([own >> np.uint64(54)])))
    monkeypatch.setattr(language_model, "HELD_BYTES", 1)
    monkeypatch.setattr(np, "memmap", lambda path, *_: np.fromfile(path, np.uint8))
    shards = language_model.Shards()
    asked = np.concatenate([h[::-7], h[:3] + np.uint64(1)])
    got = shards.counts(str(tmp_path), "level", 4, asked, 1)[0]
    assert got.tolist() == [*(h[::-7] >> np.uint64(54)).tolist(), 0, 0, 0] and len(shards.open) <= 4
    for s in shards.open.values():
        s.held = 1 << 30
    shards.held = 4 << 30
    shards.shard("nowhere")
    assert len(shards.open) == 1 and shards.held == 0


def test_language_model_of_nothing(spark):
    model = language_model.train(documents(spark, [(1, "a b")]).where("false"))
    assert [tuple(r)[:5] for r in language_model.score(documents(spark, [(1, "a b")]), model).collect()] == [(1, 3, 0, 0.0, 0.0)]
    assert language_model.score(documents(spark, [(1, "a")]).where("false"), model).count() == 0


def test_model_predicts_unseen_documents_better_than_its_base(spark):
    got = queries.op11_language_model(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.1 * got[2]


# --- spelling variants -------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, shortest, least, ratio, slips):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if slips and h % slips == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    form = {w: min(o, key=lambda x: (-counts[x], x)) for w, o in near.items() if o}
    form = {w: f for w, f in form.items() if counts[f] >= ratio * counts[w]}
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return sorted(out)


def spelled():
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdeilnrstÀéÿ÷×Z"))
    bases = ["".join(rng.choice(letters, rng.integers(5, 12))) for _ in range(40)]
    rows = []
    for i in range(250):
        out = []
        for _ in range(30):
            w = bases[min(39, int(rng.exponential(8)))]
            for _ in range(int(rng.integers(0, 3) == 0) + int(rng.integers(0, 12) == 0)):
                at = int(rng.integers(0, len(w)))
                w = [w[:at] + w[at + 1 :], w[:at] + str(rng.choice(letters[:4])) + w[at + 1 :], w[:at] + "e" + w[at:]][rng.integers(0, 3)]
            out.append(w)
        rows.append((i, " ".join(out)))
    chain = "chained " * 1250 + "chaiined " * 250 + "chaiiined " * 50 + "chaiiiined " * 10 + "tiesab " * 5 + "tiesac " * 25 + "tiesad " * 25
    return rows + [(900, chain), (None, "nameless " * 9), (901, None), (902, ""), (903, "1 2 ,,"), (5, "nameless"), (5, "nameless")]


@pytest.mark.parametrize("slips", [None, 7])
def test_spelling_variants(spark, slips):
    rows = spelled()
    got = sorted(map(tuple, spelling.spelling_variants(documents(spark, rows), shortest=4, least=2, slips=slips).collect()))
    want = plain_variants(rows, 4, 2, 5, slips)
    assert got == want
    if not slips:
        assert {("chaiiiined", "chaiiined", "chained", 10, 1, 50), ("tiesab", "tiesac", "tiesac", 5, 2, 25)} <= set(got)
        assert sum(r[1] is not None for r in got) > 50 and spelling.spelling_variants(documents(spark, rows).where("false")).count() == 0


def test_spelling_query_on_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op12_spelling_variants(spark, "/root/testdata/sf0.001").collect()))
    assert got == plain_variants(rows, 6, 5, 5, 199) and len(got) > 100


# --- hard negatives ----------------------------------------------------------------------------------------------------


def plain_negatives(rows, anchors, scale, k, percent):
    best = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            one = (label, [math.floor(scale * float(np.float32(x))) for x in v])
            best[i] = max(best.get(i, one), one)
    out = []
    for a in filter(anchors, best):
        label, vector = best[a]
        scores = sorted((-sum(x * y for x, y in zip(vector, v)), i, other) for i, (other, v) in best.items() if i != a and len(v) == len(vector))
        for p, positive, other in [s for s in scores if s[2] == label][:k]:
            inside = [(i, -s) for s, i, x in scores if x != label and 80 * -p <= 100 * -s <= 100 * -p] if percent == 80 else None
            out += [(a, positive, r, i, -p, s) for r, (i, s) in enumerate(inside[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("group_bytes", [1, 600, 1 << 20])
def test_hard_negatives(spark, group_bytes):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0.2, 0.4, 6).round(1).tolist(), int(rng.integers(0, 3))) for i in range(150)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5], i % 2) for i in range(40)]
    rows += [(300, None, 1), (301, [None] * 6, 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] + [0.0] * 5, 1), (304, [0.1] * 6, None), (None, [0.1] * 6, 1), (305, [], 1)]
    rows += [(310, [0.5, 0.25], 0), (320, [0.5, 0.75], 0), (311, [0.5, 0.5], 1), (10, [0.9] * 6, 2), (10, [0.9] * 6, 2), (20, [0.0] * 6, 0), (330, [-1.0] * 6, 9), (340, [1.0] * 6, 9)]
    table = spark.createDataFrame([(i, v, g, 0, 0, "x") for i, v, g in rows], "vec_id long, embedding array<float>, label int, score int, rank int, VECTOR string")
    got = sorted(map(tuple, hard_negatives.mine(table.repartition(5), F.col("vec_id") % 10 == 0, F.col("label"), scale=16, group_bytes=group_bytes).collect()))
    assert got == plain_negatives(rows, lambda i: i % 10 == 0, 16, 5, 80) and len(got) > 100
    assert hard_negatives.mine(table.where("false"), F.col("vec_id") % 10 == 0, F.col("label")).count() == 0


def test_hard_negatives_beyond_exact_doubles(spark):
    rows = [(i, [float(2**22 + i), float(i)], i % 2) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, hard_negatives.mine(table, F.col("vec_id") % 10 == 0, F.col("label"), scale=64).collect()))
    assert got == plain_negatives(rows, lambda i: i % 10 == 0, 64, 5, 80) and got
