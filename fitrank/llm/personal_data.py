"""Personal data by weak supervision.

Candidate spans are the base matches of four kinds (email, ip, card, phone), which are always kept, and looser ones from
three sources: regular expressions (phones without a plus, written-out emails, grouped identity numbers, names after a
title, any long number), a gazetteer (a listed given name before another name) and contexts (names and numbers after
words that announce them). Labelers of these sorts vote on each (yes, no or nothing), and others deny it. Vote patterns
are counted over all documents by kind; their number is bounded by the labelers. For each kind of its own,
expectation-maximisation on these counts estimates how many looser spans are personal data, how reliable every labeler is
and how likely each pattern is; base spans are known positives of the labelers that look at the context alone. A
logistic span classifier is then trained on a bounded sample of spans with these as soft labels. It sees no votes but the
span's shape, its letters and its neighbours, so that it also judges spans whose labelers say nothing. Looser spans that
it accepts are added.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, small_batches, written

KINDS = ("email", "ip", "card", "phone", "name", "id")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the lookbehind only skips starts inside a run of digits, which fail wherever the run's start has failed
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_BRACKET = re.compile(r"[\[(]at[\])]")
_TITLE = re.compile(r"M[rs]|Dr|Herr|Frau|Mme|Sr")
# any letters, with the combining marks of decomposed text; a name does not start with a lower-case one
_LOWER = "".join(c for c in map(chr, range(0x10000)) if c.isalpha() and c.islower())
_LETTER = r"[^\W\d_][\u0300-\u036f]*"
_NAME = rf" (?![{_LOWER}]){_LETTER}(?:{_LETTER}){{1,20}}(?![\w\u0300-\u036f])"
_NUMBER = r"[0-9(][0-9 ()./-]{5,18}[0-9]"
#: source, kind, what every text with a match holds, pattern; a group of the name `span`, if any, is the span.
_LOOSE = (
    ("form", "phone", _DIGITS, re.compile(r"(?<![\w+.-])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])")),
    ("form", "email", _BRACKET, re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[A-Za-z]{2,24}){1,4}\b")),
    ("form", "id", _DIGITS, re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("form", "name", _TITLE, re.compile(rf"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.?{_NAME}(?:{_NAME})?")),
    ("context", "id", _DIGITS, re.compile(r"\b(?:ssn|passport|social security|tax id|national id|id card)\b[\w .:#]{0,16}?(?P<span>\b[A-Z]{0,3}[0-9](?:[A-Z0-9-]{4,12})[0-9A-Z]\b)", re.I)),
    ("context", "name", re.compile(r"name is|signed|regards|yours|signé|gezeichnet", re.I), re.compile(rf"\b(?i:my name is|signed by|signed|kind regards|best regards|regards|yours truly|signé|gezeichnet)[,:]?(?P<span>{_NAME}(?:{_NAME})?)")),
    ("number", "phone", _DIGITS, re.compile(rf"(?<![\w+.,-]){_NUMBER}(?![\w-])")),
)
#: A capitalised word before another; the gazetteer says if it is a given name.
_PAIR = re.compile(rf"\b(?![{_LOWER}]){_LETTER}(?:{_LETTER}){{1,20}}{_NAME}")


@dataclass(frozen=True)
class Gazetteers:
    """Lists that labelers look in; two-letter domains of countries and calling codes follow from their rules."""

    domains: frozenset = frozenset("com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia post app dev cloud online site shop store tech blog xyz".split())
    names: frozenset = frozenset(
        (
            "anna anne antonio barbara bernard brigitte carlos carmen carol caroline charles charlotte christian christine claire claude daniel daniela david deborah denise dennis diana diego dieter dominique donald donna dorothy edward "
            "elena elisabeth elizabeth emily emma eric eva felix fernando francesca francisco frank françois françoise frederick gabriel george gerhard giovanni giulia guillaume hannah hans harold heather heinz helen helga helmut henri henry "
            "ingrid isabel isabelle jack jacques james jan jane janet javier jean jennifer jessica joan johann john jonas jorge jose josé joseph joshua juan judith julia julie jürgen karen karin karl katharina kevin klaus laura lea "
            "léa linda lisa louis louise lucas lucía luis lukas manfred manuel margaret maria maría marie mark marta martin martina mary matthew matthias max mia michael michel miguel monika nancy natalie nicolas nicole nina olivia pablo "
            "patricia patrick paul paula pedro peter petra philippe pierre rachel ralf raquel richard robert roberto rosa ruth sabine samuel sandra sara sarah sebastian sergio simon sofia sophie stefan stephanie steven susan susanne sylvie "
            "teresa thomas ursula uwe valerie victor walter werner william wolfgang yves"
        ).split()
    )

    def has_domain(self, word: str) -> bool:
        return word in self.domains or (len(word) == 2 and word.isascii() and word.isalpha())

    def has_name(self, words: list[str]) -> bool:
        return any(w.lower() in self.names for w in words)

    @staticmethod
    def has_calling_code(digits: str) -> bool:
        """World zones: 1 and 7 alone; two digits where the zone has such codes, else three."""
        return digits[:1] in ("1", "7") or digits[:2] in _TWO_DIGIT_CODES or digits[:2] in _THREE_DIGIT_ZONES

    @staticmethod
    def has_issuer(digits: str) -> bool:
        """Ranges of card issuers by their first digits."""
        four = int(digits[:4] or 0)
        return digits[:1] == "4" or digits[:2] in ("34", "36", "37", "38", "39", "62", "65") or 5100 <= four <= 5599 or 2221 <= four <= 2720 or 3528 <= four <= 3589 or 3000 <= four <= 3059 or four == 6011 or 6440 <= four <= 6499


# Calling codes of two digits, and zones whose codes have three.
_TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_THREE_DIGIT_ZONES = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
GAZETTEERS = Gazetteers()
_CUE = {
    "email": re.compile(r"e-?mail|contact|write to|@", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|t[ée]l|anruf", re.I),
    "card": re.compile(r"card|visa|credit|karte|carte|tarjeta", re.I),
    "ip": re.compile(r"\bip\b|address|host|server", re.I),
    "name": re.compile(r"name|signed|contact|dear", re.I),
    "id": re.compile(r"ssn|social|security|id\b|passport", re.I),
}
#: What speaks against a span that it follows.
_DENIAL = re.compile(r"order|invoice|item|article|version|isbn|page|total|model|part|serial|reference|ticket|bestell|rechnung|commande|facture|pedido|factura|[$€£#]\s*$", re.I)
LABELERS = ("form", "check", "gazetteer", "cue", "denial", "company", "edges")
#: Of these the rates are those of base spans too.
CONTEXT_LABELERS = ("cue", "denial", "company")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches by start, then kind; places are code points, ends exclusive."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        run = text[free:at]
        start = free + len(run.rstrip(_LOCAL))
        free = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", free)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=_by_place)


def _by_place(span):
    return span[1], KINDS.index(span[0])


class _Places:
    """Places of a text that are taken, as ordered ranges that do not touch each other."""

    def __init__(self, ranges):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(ranges):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def take(self, a: int, b: int) -> bool:
        """Take a range if nothing of it is taken."""
        i = bisect_left(self.starts, b)
        if i and self.ends[i - 1] > a:
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


def candidate_spans(text: str, lists: Gazetteers = GAZETTEERS) -> list[tuple[str, int, int, bool, str]]:
    """Base matches (True, `base`) and looser spans (False, their source) that overlap none of them, nor each other."""
    base = base_spans(text)
    out = [(*s, True, "base") for s in base]
    taken = _Places((a, b) for _, a, b in base)
    for source, kind, needed, pattern in _LOOSE:
        if needed.search(text):
            for m in pattern.finditer(text):
                a, b = m.span("span" if "span" in pattern.groupindex else 0)
                a += text[a] == " "
                if (source != "number" or 7 <= sum(c in "0123456789" for c in text[a:b]) <= 15) and taken.take(a, b):
                    out.append((kind, a, b, False, source))
    for m in _PAIR.finditer(text):
        if m.group().partition(" ")[0].lower() in lists.names and taken.take(*m.span()):
            out.append(("name", *m.span(), False, "gazetteer"))
    return sorted(out, key=_by_place)


def companions(spans, reach: int = 80) -> list[bool]:
    """Of each span: is another range within `reach` characters? Spans are in order of their starts."""
    ranges = sorted({(a, b) for _, a, b, *_ in spans})
    near, far = {}, -reach - 1
    for i, (a, b) in enumerate(ranges):
        near[a, b] = far > a - reach or (i + 1 < len(ranges) and ranges[i + 1][0] < b + reach)
        far = max(far, b)
    return [near[a, b] for _, a, b, *_ in spans]


def votes(text: str, kind: str, start: int, end: int, source: str, company: bool, lists: Gazetteers = GAZETTEERS) -> tuple[int, ...]:
    """1 yes, -1 no, 0 nothing, by labeler. A form that is only a long number speaks against it; checks and edges only
    speak against."""
    found, left = text[start:end], text[max(0, start - 32) : start]
    digits = "".join(_DIGITS.findall(found))
    glued = (start > 0 and (text[start - 1].isalnum() or text[start - 1] in "-_/=")) or (end < len(text) and (text[end].isalnum() or text[end] in "-_/="))
    check, listed = _BY_KIND[kind](found, digits, lists)
    form = {"base": 1, "form": 1, "number": -1}.get(source, 0)
    cue = source == "context" or _CUE[kind].search(left)
    return (form, 0 if check else -1, 1 if listed else 0, 1 if cue else 0, -1 if _DENIAL.search(left) else 0, 1 if company else 0, -1 if glued else 0)


#: kind -> whether a check passes, and whether a list has it, of the text found, its digits and the lists.
_BY_KIND = {
    "email": lambda found, digits, lists: (re.search(r"[A-Za-z]", found[:2]), lists.has_domain(re.split(r"[.\]) ]", found)[-1].lower())),
    "ip": lambda found, digits, lists: (not found.startswith(("0", "127.", "255.")), False),
    "card": lambda found, digits, lists: (_luhn(digits), lists.has_issuer(digits)),
    "phone": lambda found, digits, lists: (len(set(digits)) > 3 and 9 <= len(digits) <= 13, digits[-7:-4] == "555" or (found.startswith("+") and lists.has_calling_code(digits))),
    "name": lambda found, digits, lists: (len(found) < 60, lists.has_name(found.split())),
    "id": lambda found, digits, lists: (digits[:3] not in ("000", "666") and len(digits) >= 5 and len(set(digits)) > 2, False),
}

#: Counts that a labeler's votes no, nothing, yes start from where a span is not, and where it is personal data.
BELIEF = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])
#: Looser spans of a kind that are and that are not personal data, before any is seen.
PRIOR = (1.0, 4.0)


def estimate_reliabilities(patterns: dict[tuple, int], rounds: int = 100) -> tuple[dict[tuple, float], dict[str, np.ndarray], dict[str, float]]:
    """EM on counted vote patterns (kind, base, *votes), each kind of its own: (posterior of each looser pattern,
    P(vote | class) as [class][labeler][vote + 1] by kind, share of looser spans that are personal data by kind).

    Labelers are believed to be better than chance (BELIEF), looser spans to be rare (PRIOR). Base spans are 1 and tell
    what the context of personal data is like."""
    posterior, all_rates, shares = {}, {}, {}
    known = [LABELERS.index(x) for x in CONTEXT_LABELERS]
    for kind in sorted({k[0] for k in patterns}):
        loose, base = (sorted(k for k in patterns if k[0] == kind and bool(k[1]) == is_base) for is_base in (False, True))
        v, n = np.array([k[2:] for k in loose], int).reshape(-1, len(LABELERS)) + 1, np.array([patterns[k] for k in loose], float)
        seen = np.zeros((len(LABELERS), 3))
        for k in base:
            for j in known:
                seen[j, k[2 + j] + 1] += patterns[k]
        # base spans are not to outweigh the looser ones
        seen *= min(1.0, (n.sum() + 10) / max(1.0, seen.sum(axis=1).max()))
        p = 1 / (1 + np.exp(1.0 - 2.0 * (v - 1).sum(axis=1)))
        for _ in range(rounds):
            share = float((PRIOR[0] + n @ p) / (sum(PRIOR) + n.sum()))
            rates = np.repeat(BELIEF[:, None, :], len(LABELERS), axis=1)
            rates[1] += seen
            for c, w in ((0, n * (1 - p)), (1, n * p)):
                for j in range(len(LABELERS)):
                    rates[c, j] += np.bincount(v[:, j], w, 3)
            rates /= rates.sum(axis=2, keepdims=True)
            log = [np.log(rates[c][np.arange(len(LABELERS)), v]).sum(axis=1) for c in (0, 1)]
            new = 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log((1 - share) / share), -30, 30)))
            done = not len(p) or np.abs(new - p).max() < 1e-9
            p = new
            if done:
                break
        posterior |= dict(zip(loose, p.tolist()))
        all_rates[kind], shares[kind] = rates, share
    return posterior, all_rates, shares


BITS = 15
_WORD = re.compile(r"\w+|[^\w\s]")


def features(text: str, kind: str, start: int, end: int) -> list[int]:
    """Hashed features of a span: its shape in pieces, its letters in threes, its length and the words beside it. What a
    labeler votes is none of them."""
    found = text[start : start + 64]  # a name or number is no longer; a longer email goes by its begin
    found = found[: end - start]
    shape = "".join("0" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in found)
    left = [w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])][-4:]
    right = [w.lower() for w in _WORD.findall(text[end : end + 30])][:2]
    padded = f"^{shape}$"
    names = [f"shape {padded[i : i + 4]}" for i in range(max(1, len(padded) - 3))] + [f"size {min(8, (end - start) // 4)}"]
    names += [f"part {found[i : i + 3].lower()}" for i in range(len(found) - 2) if found[i : i + 3].isalpha()]
    names += [f"left {w}" for w in left] + [f"last {w}" for w in left[-1:]] + [f"right {w}" for w in right] + ["any"]
    return sorted({zlib.crc32(f"{kind} {n}".encode("utf-8", "surrogatepass")) % (1 << BITS) for n in names})


#: Weight of spans that no labeler tells apart from others of their form.
UNTOLD = 0.02


def weight_of(key: tuple) -> float:
    """How much a span's soft label counts: little where no labeler but its form and its company says anything, as there is
    then nothing that agrees or disagrees with them; base spans count wholly."""
    telling = [v for name, v in zip(LABELERS, key[2:]) if name not in ("form", "company")]
    return 1.0 if key[1] or any(telling) else UNTOLD


def train_classifier(rows: list[tuple[list[int], float, float]], rounds: int = 300, decay: float = 3e-3) -> np.ndarray:
    """Logistic weights from (features, probability, weight) of sampled spans, by adaptive gradient steps. Without rows all
    are 0."""
    w = np.zeros(1 << BITS)
    if not rows:
        return w
    columns = np.concatenate([np.array(f, np.int64) for f, *_ in rows])
    of = np.repeat(np.arange(len(rows)), [len(f) for f, *_ in rows])
    y, counts = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    seen = np.full(1 << BITS, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[columns], len(rows)), -30, 30)))
        slope = np.bincount(columns, (counts * (p - y))[of], 1 << BITS) / len(rows) ** 0.5 + decay * w
        seen += slope * slope
        w -= 0.3 * slope / np.sqrt(seen)
    return w


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.string()), ("features", pa.list_(pa.int32()))])
_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()), T.StructField("pattern", T.StringType()), T.StructField("features", T.ArrayType(T.IntegerType()))]))


def _candidates(text: str | None, lists: Gazetteers) -> list[dict]:
    """A text's candidate spans with their vote patterns (kind, base, votes) and features."""
    spans = candidate_spans(text, lists) if text else []
    out = []
    for (kind, a, b, base, source), company in zip(spans, companions(spans)):
        pattern = (kind, int(base), *votes(text, kind, a, b, source, company, lists))
        out.append({"kind": kind, "start": a, "end": b, "base": base, "pattern": ",".join(map(str, pattern)), "features": features(text, kind, a, b)})
    return out


def with_candidates(docs: DataFrame, name: str, lists: Gazetteers = GAZETTEERS) -> DataFrame:
    """docs and, as the column `name`, the candidate spans of their whole texts (null: empty)."""
    small_batches(docs.sparkSession)
    at = [c.lower() for c in docs.columns].index("text")

    def find(batches):
        for batch in batches:
            spans = pa.array([_candidates(t, lists) for t in batch.column(at).to_pylist()], pa.list_(_SPAN))
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], [*batch.schema.names, name])

    return docs.mapInArrow(find, T.StructType([*docs.schema.fields, T.StructField(name, _SPANS)]))


def find_candidates(docs: DataFrame, lists: Gazetteers = GAZETTEERS) -> DataFrame:
    """doc_id and its candidate spans with their vote patterns, for every whole text (null: empty)."""
    return with_candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "candidates", lists).drop("text")


def _key(pattern: str) -> tuple:
    kind, *rest = pattern.split(",")
    return (kind, *map(int, rest))


def fit(candidates: DataFrame, sample_spans: int = 2000) -> np.ndarray:
    """The span classifier's weights. Vote patterns are counted over all candidates; the classifier is trained on
    `sample_spans` spans at most of each kind, base or looser, those of the smallest hash of what they look like."""
    spans = candidates.select(F.explode("candidates").alias("s"))
    rows = spans.groupBy("s.pattern").count().collect()
    patterns = {_key(r["pattern"]): r["count"] for r in rows}
    posterior, _, _ = estimate_reliabilities(patterns)
    sizes = Counter()
    for k, n in patterns.items():
        sizes[k[:2]] += n
    # no more than a few times as many spans meet in the window of a kind
    every = F.lit(1)
    for (kind, base), n in sorted(sizes.items()):
        every = F.when((F.col("kind") == kind) & (F.col("base") == bool(base)), max(1, n // (2 * sample_spans))).otherwise(every)
    look = spans.select("s.kind", "s.base", "s.pattern", "s.features", F.xxhash64("s.features", "s.pattern", "s.start").alias("mark"))
    order = Window.partitionBy("kind", "base").orderBy("mark", "pattern", "features")
    sample = look.where(F.pmod("mark", every) == 0).withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample_spans)
    taken = sorted((r["kind"], r["base"], r["mark"], r["pattern"], r["features"]) for r in sample.drop("place").collect())
    return train_classifier([(f, 1.0 if base else posterior[_key(p)], weight_of(_key(p))) for _, base, _, p, f in taken])


def accepted(weights: np.ndarray, span_features: list[int], least: float = 0.9) -> bool:
    return bool(1 / (1 + np.exp(-weights[span_features].sum())) >= least)


def personal_data(docs: DataFrame, least: float = 0.9, lists: Gazetteers = GAZETTEERS) -> DataFrame:
    """doc_id, base (base spans) and spans (base and accepted ones): each `kind:start:end`, comma-joined by start, then
    kind; counts of base spans by kind as n_<kind>; base_sha256.

    Null and empty texts have no spans. Repeated rows and null ids give a row each; other columns are ignored; an
    empty table gives no rows and an untrained classifier."""
    found = written(find_candidates(docs, lists), "candidates")
    weights = fit(found)

    def decide(batches):
        for batch in batches:
            base, every, counts = [], [], []
            for spans in batch.column(1).to_pylist():
                text = lambda chosen: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in chosen)
                own = [s for s in spans if s["base"]]
                base.append(text(own))
                every.append(text([s for s in spans if s["base"] or accepted(weights, s["features"], least)]))
                counts.append([sum(s["kind"] == k for s in own) for k in KINDS[:4]])
            n = list(zip(*counts)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in n), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()), pa.array(every, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return found.mapInArrow(decide, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_text(text: str, spans) -> str:
    """Each span (kind, start, end) becomes [KIND]; of overlapping ones the first names the whole."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=_by_place):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, least: float = 0.9, lists: Gazetteers = GAZETTEERS) -> DataFrame:
    """docs with every span of their texts replaced; null texts stay null, other columns stay as they are. Spans are
    found once and written beside the texts."""
    name = free_name(docs, "candidates")
    found = written(with_candidates(docs, name, lists), "candidates", "zstd")
    weights = fit(found.select(F.col(name).alias("candidates")))
    at = [c.lower() for c in docs.columns].index("text")

    def clean(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                chosen = [(s["kind"], s["start"], s["end"]) for s in spans if s["base"] or accepted(weights, s["features"], least)]
                out.append(redact_text(text, chosen) if chosen else text)
            rest = pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
            yield rest.set_column(at, rest.schema.names[at], pa.array(out, pa.string()))

    return found.mapInArrow(clean, docs.schema)
