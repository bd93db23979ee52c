"""Weak supervision of personal data: what labelers and the classifier find of planted spans in documents never seen."""

import random
from collections import Counter

import numpy as np

from fitrank.llm import personal_data

FILLER = "the report was late and we saw many small boats near old harbour while rain fell on every roof".split()


def planted(seed, n, announced):
    """Documents with spans that are personal data and others that look like it. Where `announced`, words that labelers know
    stand beside others ("dial the phone"); otherwise these others stand alone ("dial"), and no labeler says anything."""
    r = random.Random(seed)
    d = lambda k: "".join(str(r.randrange(10)) for _ in range(k))
    first = lambda: r.choice("Anna Peter Maria Thomas Julia Carlos Emma Lucas Ola Priya Kwame Yuki".split())
    last = lambda: r.choice("Smith Keller Moreau Garcia Novak Lindqvist Okafor Tanaka Weber Rossi".split())
    phone = lambda: r.choice(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}"]).format(r.choice("23456789") + d(2), d(3), d(4))
    number = lambda: f"{r.randrange(100, 600)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}"
    with_cue = lambda word, cue: f"{word} {cue} " if announced else f"{word} "
    yes = [
        lambda: ("phone", with_cue(r.choice(["please dial", "just ring", "reach us at"]), "the phone"), phone(), " after six"),
        lambda: ("phone", with_cue(r.choice(["text", "whatsapp"]), "my mobile"), phone(), ""),
        lambda: ("email", with_cue("message", "by email"), f"{first().lower()} [at] {last().lower()} [dot] {r.choice(['org', 'com', 'de'])}", " please"),
        lambda: ("id", with_cue("insured under", "SSN"), number(), " on file"),
        lambda: ("name", "contact ", f"Dr. {first()} {last()}", " first"),
        lambda: ("name", "my name is ", f"{first()} {last()}", " and"),
    ]
    no = [
        lambda: ("phone", with_cue(r.choice(["parcel", "crate", "lot"]), "of order"), phone(), " shipped"),
        lambda: ("phone", with_cue("paid against", "invoice no."), phone(), " last week"),
        lambda: ("phone", with_cue("counted", "a total"), f"{d(3)} {d(3)} {d(3)}", " of them"),
        lambda: ("phone", "on ", f"20{d(2)}-0{r.randrange(1, 9)}-1{d(1)}", " it began"),
        lambda: ("id", with_cue("shelf", "item"), number(), " of the list"),
    ]
    docs = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randrange(0, 4)):
            text += " ".join(r.choice(FILLER) for _ in range(r.randrange(6, 25))) + ". "
            real = r.random() < 0.5
            kind, left, span, right = r.choice(yes if real else no)()
            if real:
                spans.append((kind, len(text + left), len(text + left + span)))
            text += left + span + right + " "
        docs.append((text + " ".join(r.choice(FILLER) for _ in range(9)), spans))
    return docs


def learned(docs):
    spans = [s for text, _ in docs for s in personal_data._candidates(text, personal_data.GAZETTEERS)]
    patterns = Counter(personal_data._key(s["pattern"]) for s in spans)
    posterior, rates, shares = personal_data.estimate_reliabilities(patterns)
    keys = [personal_data._key(s["pattern"]) for s in spans]
    return posterior, rates, shares, personal_data.train_classifier([(s["features"], 1.0 if s["base"] else posterior[k], personal_data.weight_of(k)) for s, k in zip(spans, keys)])


def quality(docs, accept):
    right = found = there = 0
    for text, spans in docs:
        got = {(s["kind"], s["start"], s["end"]) for s in personal_data._candidates(text, personal_data.GAZETTEERS) if not s["base"] and accept(s)}
        right, found, there = right + len(got & set(spans)), found + len(got), there + len(spans)
    return right / max(1, found), right / there


def test_planted_spans_of_unseen_documents():
    posterior, _, shares, weights = learned(planted(1, 1500, True) + planted(3, 300, False))
    by_class = lambda s: personal_data.accepted(weights, s["features"])
    by_votes = lambda s: posterior.get(personal_data._key(s["pattern"]), 0.0) >= 0.9
    precision, recall = quality(planted(2, 800, True), by_class)
    assert precision >= 0.98 and recall >= 0.95
    # words that no labeler knows: the votes find few, the classifier has learned the words beside them
    precision, recall = quality(planted(4, 800, False), by_class)
    votes_precision, votes_recall = quality(planted(4, 800, False), by_votes)
    print(f"precision {precision:.3f}, recall {recall:.3f}; votes alone {votes_precision:.3f}, {votes_recall:.3f}; shares {shares}")
    assert precision >= 0.98 and recall > votes_recall + 0.1
    precision, recall = quality(planted(4, 800, False), lambda s: personal_data.accepted(weights, s["features"], 0.25))
    print(f"at a quarter: precision {precision:.3f}, recall {recall:.3f}")
    assert precision >= 0.85 and recall >= 0.95


def test_reliabilities_are_by_kind():
    at = personal_data.LABELERS.index
    key = lambda kind, base=0, **v: (kind, base, *[v.get(x, 0) for x in personal_data.LABELERS])
    patterns = {key("phone", form=1, cue=1): 90, key("phone", form=-1, denial=-1): 200, key("phone", form=1): 40, key("phone", 1, form=1, cue=1): 1000, key("id", form=1, cue=-1): 30, key("id", form=-1, cue=1): 3}
    posterior, rates, shares = personal_data.estimate_reliabilities(patterns)
    assert posterior[key("phone", form=1, cue=1)] > 0.95 and posterior[key("phone", form=-1, denial=-1)] < 0.05
    assert set(posterior) == {k for k in patterns if not k[1]} and set(rates) == {"phone", "id"}
    assert rates["phone"][1, at("cue"), 2] > 0.5 > rates["phone"][0, at("cue"), 2] and abs(rates["id"] - rates["phone"]).max() > 0.2
    assert np.allclose(rates["phone"].sum(axis=2), 1) and personal_data.estimate_reliabilities({}) == ({}, {}, {})


def test_the_classifier_decides_what_is_added(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(planted(5, 300, True))] + [(900, None), (901, ""), (None, "plain")], "doc_id long, text string")
    with_it = {r.doc_id: r for r in personal_data.personal_data(docs).collect()}
    without = {r.doc_id: r for r in personal_data.personal_data(docs, least=2.0).collect()}
    added = sum(with_it[i].spans != without[i].spans for i in with_it)
    assert added > 100 and all(with_it[i].base_sha256 == without[i].base_sha256 for i in with_it)
    assert all(r.spans == "" for r in without.values() if r.n_email + r.n_ip + r.n_card + r.n_phone == 0)
    clean = {r.doc_id: r.text for r in personal_data.redact(docs).collect()}
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert all((clean[i] != kept[i]) == bool(with_it[i].spans) for i in with_it)


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(planted(6, 200, True))], "doc_id long, text string")
    found = personal_data.find_candidates(docs)
    few, again = personal_data.fit(found, sample_spans=5), personal_data.fit(found.repartition(7), sample_spans=5)
    assert (few == again).all() and 0 < (few != 0).sum() < (personal_data.fit(found) != 0).sum()


def test_no_spans_no_model():
    assert not personal_data.train_classifier([]).any() and not personal_data.accepted(np.zeros(1 << personal_data.BITS), [1, 2])
    assert personal_data.redact_text("mail a@b.c now", [("email", 5, 10)]) == "mail [EMAIL] now"
