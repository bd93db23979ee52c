"""Parts without Spark: encoders, token files, packing plans, streams, archives, sketches, trees, models."""

import math

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fitrank.llm import language_id, media, near_duplicates, packing, personal_data, token_counts, tokenization, vector_search, warc
from fitrank.llm.token_files import DacFile, dac_bytes

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "  ", "a  b", "x \n y", "\n\n", "it's o.k., I'll", "<|endoftext|>", "x <|endoftext|> y", "a<|endoftext|>b.", "İstanbul ΑΣ ας", "é́ ﬁ", "a\x1cb c\x85d\xa0e", "漢字 かな", "a " * 3000, "z" * 5000, "tab\there", " lead", "trail ", " x y", "🙂 🙂"]


@pytest.mark.parametrize("path,kind", [(BYTE, tokenization.ByteLevelCoder), (WORD, tokenization.WordCoder)])
@pytest.mark.parametrize("text", ODD)
def test_coder_equals_library(path, kind, text):
    expected = tokenization.library(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokenization.coder(path, kind).encode(text), np.uint32).tolist() == expected


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab .,\n\t'sé<|>09Z-_") + ["\xa0", "\x1c", "ß", "漢", "İ"]), max_size=40))
def test_coders_equal_library_on_any_text(text):
    for path, kind in ((BYTE, tokenization.ByteLevelCoder), (WORD, tokenization.WordCoder)):
        expected = tokenization.library(path).encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokenization.coder(path, kind).encode(text), np.uint32).tolist() == expected


@pytest.mark.parametrize("path,kind", [(BYTE, tokenization.ByteLevelCoder), (WORD, tokenization.WordCoder)])
def test_coder_equals_library_on_every_character(path, kind):
    """Each character of the basic plane between letters, after a space, beside digits and doubled."""
    own, library = tokenization.coder(path, kind), tokenization.library(path)
    texts = [f"a{c}b {c}1 x{c}{c} 2{c}" for c in map(chr, range(1 << 16)) if not "\ud800" <= c <= "\udfff"]
    expected = library.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, e in zip(texts, expected) if np.frombuffer(own.encode(t), np.uint32).tolist() != e.ids] == []


def test_pre_tokens_are_the_tokenizers_own():
    cut = tokenization.library(BYTE).pre_tokenizer.pre_tokenize_str
    for text in [*ODD, "It's 12.50 EUR,they'll\npay!  ok\t\tno", " the end...", "漢字 かな 123abc"]:
        if text and (parts := tokenization.pre_tokens(text)) is not None:
            assert parts == [text[a:b] for _, (a, b) in cut(text)]


def test_tail_blobs_round_trip():
    tail = token_counts.Tail(3)
    tail.add(5, {"a": 2, "b\n\0": 1})
    tail.add(9, {"a": 1})
    found = {}
    for _, blob in tail.blobs():
        units, counts, rows, freq = token_counts.open_blob(blob)
        at = 0
        for u, n in zip(units, counts):
            found[u] = list(zip(rows[at : at + n].tolist(), freq[at : at + n].tolist()))
            at += n
    assert found == {"a": [(5, 2), (9, 1)], "b\n\0": [(5, 1)]}


@pytest.mark.parametrize("ids", [[], [0], [255, 256], list(range(0, 70000, 7)), [2**32 - 1] * 600])
def test_token_file_random_access(ids):
    ids = np.array(ids, np.uint32)
    f = DacFile(dac_bytes([7], [0, len(ids)], ids))
    assert f.document(0).tolist() == ids.tolist()
    for i in range(0, len(ids), max(1, len(ids) // 50)):
        assert f.get(i) == ids[i] and f.slice(i, min(len(ids), i + 3)).tolist() == ids[i : i + 3].tolist()


def test_token_file_tells_null_from_any_id():
    f = DacFile(dac_bytes([None, None, -(2**63), 2**63 - 1], [0, 1, 1, 2, 2], np.array([5, 6], np.uint32)))
    assert f.nulls == 2 and f.doc_ids[2:].tolist() == [-(2**63), 2**63 - 1] and f.document(2).tolist() == [6]


def test_broken_token_file_raises():
    data = bytearray(dac_bytes([7], [0, 2], np.array([1, 2], np.uint32)))
    data[38] ^= 1
    with pytest.raises(ValueError):
        DacFile(bytes(data))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 60), max_size=25), st.sampled_from(["dot", "norm"]))
def test_packing_plan_places_all(histogram, rule):
    limits = packing.Limits(tokens=100, documents=9, attention=6000 if max(histogram, default=1) ** 2 <= 6000 else None, rule=rule)
    lines = packing.plan_packing(histogram, limits)
    used, ranks = {}, {}
    for length, rank, n, deep, at, offset in lines.tolist():
        for i in range(n):
            for j in range(deep):
                used.setdefault(at + i, []).append((offset + j * length, length))
                ranks.setdefault(length, set()).add(rank + i * deep + j)
    assert {k: len(v) for k, v in ranks.items()} == histogram and all(v == set(range(len(v))) for v in ranks.values())
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 100 and len(pieces) <= 9 and sum(n * n for _, n in pieces) <= limits.vector[2]


@given(st.binary(max_size=40000))
@settings(max_examples=60, deadline=None)
def test_stream_round_trip(payload):
    payload = payload or b"\0"
    data = media.mux(payload)
    s, expected = media.demux(data), media.index(len(payload))
    assert s.payload == payload and s.errors == 0 and len(s.timestamps) == math.ceil(len(payload) / media.UNIT)
    assert (s.timestamps, s.access_points) == (expected.timestamps, expected.access_points)
    for time, packet in s.access_points:
        rest = media.demux(data[media.PACKET * packet :])
        assert rest.payload == payload[media.UNIT * s.timestamps.index(time) :] and rest.timestamps[0] == time


def test_stream_faults():
    data = media.mux(b"x" * 5000)
    assert media.demux(data).errors == 0
    lost = data[: 188 * 4] + data[188 * 5 :]
    with pytest.raises(ValueError):
        media.demux(lost)
    broken = bytearray(data)
    broken[20] ^= 255
    with pytest.raises(ValueError):
        media.demux(bytes(broken))
    with pytest.raises(ValueError):
        media.demux(data[188 * 2 :])  # no tables
    assert media.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_legal_streams_of_others():
    """Network entries, descriptors, a second program, null packets, legal repeats and a section over two packets."""
    payload = bytes(range(256)) * 20
    rest = media.mux(payload)[2 * media.PACKET :]
    entry = lambda program, pid: program.to_bytes(2, "big") + (0xE000 | pid).to_bytes(2, "big")
    pat = media._section(0, 1, entry(0, 0x10) + entry(1, media.PMT_PID) + entry(2, 0x1100))
    stream = lambda kind, pid, info: bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(info)).to_bytes(2, "big") + info
    info = b"\x05\x04TEST" + b"\x09\xc8" + b"z" * 200
    pmt = media._section(2, 1, (0xE000 | media.ES_PID).to_bytes(2, "big") + (0xF000 | len(info)).to_bytes(2, "big") + info + stream(0x0F, 0x200, b"\x0a\x04eng\x00") + stream(6, media.ES_PID, b"\x0a\x01x"))
    head = bytes([0x47, 0x40 | media.PMT_PID >> 8, media.PMT_PID & 255])
    first, second = pmt[:183], pmt[183:]
    tables = media._table_packet(0, pat, 0) + head + b"\x10\x00" + first + bytes([0x47, media.PMT_PID >> 8, media.PMT_PID & 255, 0x11]) + second + b"\xff" * (184 - len(second))
    null = b"\x47\x1f\xff\x10" + b"\xff" * 184
    twice = rest[: 188 * 3] + rest[188 * 2 : 188 * 3] + null + rest[188 * 3 :]
    s = media.demux(tables + twice)
    assert s.payload == payload and s.errors == 0


def test_records_round_trip():
    import gzip
    import hashlib

    html = "é".encode() * 600
    digest = hashlib.sha1(html).hexdigest()
    out = b"".join(gzip.compress(r) for r in (warc.record_bytes(2, "http://a/\r\nX: y", html, digest, len(html), None, "d"), warc.record_bytes(1, None, None, digest, len(html), 2, "d"), warc.record_bytes(None, "", b"", hashlib.sha1(b"").hexdigest(), 0, None, "d")))
    assert list(warc.read_records(out)) == [(2, 1200, digest, "response", None), (1, 1200, digest, "revisit", 2), (None, 0, hashlib.sha1(b"").hexdigest(), "response", None)]


@given(st.integers(0, 10**6))
@settings(max_examples=30, deadline=None)
def test_trees_find_the_exact_best(seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(-9, 9, (200, 6)).astype(float)
    v[50:90] = v[50]
    ids = rng.permutation(1000)[:200]
    best = vector_search.Best(ids[:20], v[:20], 5)
    for a in range(0, 200, 70):
        best.walk(vector_search.build_tree(ids[a : a + 70], v[a : a + 70], 8))
    for i in range(20):
        expected = sorted((-(v[i] @ v[j]), ids[j]) for j in range(200) if j != i)[:5]
        assert list(zip(-best.scores[i], best.found[i])) == expected


def test_sketches_and_samples():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1000, np.uint64)
    a, b = np.unique(x[:900]), np.unique(x[100:])  # similarity .8
    signer = near_duplicates.Signer(40, 5)
    s = signer.samples([a, b])
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.1 and (signer.keys(s)[0] == signer.keys(s)[1]).any()
    bits = lambda m: sum(bin(int(p) & (2**64 - 1)).count("1") for p in m[0] ^ m[1])
    assert bits(signer.sketches(s)) <= near_duplicates.widest_xor(0.8, signer.k, 6)
    assert bits(near_duplicates.parities([a, b])) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_shingles():
    f = near_duplicates.shingle_set
    assert len(f(None, 2)) == len(f(" \n\t", 2)) == 0 and len(f("One", 2)) == 1
    assert f("A b\x0bC", 2).tolist() == f("a B c", 2).tolist() and len(f("a a a a", 2)) == 1
    assert f("É", 2).tolist() != f("é", 2).tolist()


def test_base_spans():
    kinds = lambda t: [s[0] for s in personal_data.base_spans(t)]
    assert kinds("a@b a@b.c @x.y a@@b.c") == ["email"] and personal_data.base_spans("x..a@b.c.d@e.f") == [("email", 0, 10)]
    assert kinds("1.2.3.4 256.1.1.1 1.2.3.4.5") == ["ip", "ip"] and kinds("0" * 5000 + ".1.1.1") == ["ip"]
    assert kinds("4111 1111 1111 1111") == ["card"] and kinds("4111 1111 1111 1112") == []
    assert kinds("+1 (724) 555-7214, +12") == ["phone"]


def plain_spans(text):
    """The four base kinds by plain patterns."""
    import re

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in re.sub("[^0-9]", "", m[0])]
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        if 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("a.@-1 +()5é%")), max_size=40))
def test_base_spans_equal_plain_patterns(text):
    assert personal_data.base_spans(text) == plain_spans(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "378282246310005", "5500-0000-0000-0004", "3530 1113 3330 0000 ", "0000000000000000", "1", " ", "-", "é", "@b.c", "1.2.3.4", "+1 212 555 1234"]), max_size=6))
def test_cards_equal_plain_patterns(parts):
    text = "".join(parts)
    assert personal_data.base_spans(text) == plain_spans(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 900), st.integers(1, 60)), max_size=30))
def test_companions_and_places(pairs):
    spans = sorted({("email", a, a + n) for a, n in pairs}, key=personal_data._by_place)
    expected = [any((x, y) != (a, b) and x < b + 80 and a - 80 < y for _, x, y in spans) for _, a, b in spans]
    assert personal_data.companions(spans) == expected
    places, taken = personal_data._Places([]), []
    for _, a, b in spans[::-1]:
        free = not any(x < b and a < y for x, y in taken)
        assert places.take(a, b) == free
        taken += [(a, b)] * free


def test_long_contact_lists_stay_fast():
    import time

    text = "call 212 555 1234 or mail a@b.org, 10.0.0.1; " * 8000
    began = time.process_time()
    assert len(personal_data._candidates(text, personal_data.GAZETTEERS)) == 24000
    assert time.process_time() - began < 10


def test_gazetteers():
    lists = personal_data.GAZETTEERS
    assert [lists.has_issuer(x) for x in ("4111", "5555", "2221", "9999", "0000")] == [True, True, True, False, False]
    assert [lists.has_calling_code(x) for x in ("1212", "4930", "3531", "999", "0123", "")] == [True, True, True, True, False, False]
    assert [lists.has_domain(x) for x in ("com", "de", "zzz", "")] == [True, True, False, False]


def test_language_model():
    rows = [("the cat and the dog " * 3, "en"), ("der hund und die katze " * 3, "de")] * 5
    model = language_id.train(rows)
    assert [p[0] for p in model.predict(["the dog and cat", "die katze und der hund", None, "123", ""])] == ["en", "de", "und", "und", "und"]
    assert all(0 <= p[1] <= 1 for p in model.predict(["the", "xqz"])) and language_id.train([]).predict(["a"]) == [("und", 0.0, True)]
