"""Lexicons as whole-token regular expressions, with suppression of negated and aspired mentions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\x02"
#: Characters before a mention in which a negation may stand.
WINDOW = 40
#: Characters from a mention on that an aspiration before it may look at.
AHEAD = 64


def _branches(terms: list[str]) -> str:
    """An alternation of terms that shares their beginnings; of terms that go on, the longer ones come first."""
    by_first: dict[str, list[str]] = {}
    for t in terms:
        if t:
            by_first.setdefault(t[0], []).append(t[1:])
    parts = [re.sub(r"([^\w\s])", r"\\\1", c) + _branches(rest) for c, rest in sorted(by_first.items())]
    if not parts:
        return ""
    whole = parts[0] if len(parts) == 1 and "" not in terms else f"(?:{'|'.join(parts)})"
    return f"(?:{whole})?" if "" in terms else whole


def term_regex(terms) -> str:
    """One alternation of distinct terms, longest first, between non-word characters of any script. It begins with the
    class of first characters, which most places of a text fail at once, before looking back."""
    firsts = "".join(re.sub(r"([^\w])", r"\\\1", c) for c in sorted({t[0] for t in terms}))
    return rf"(?U)(?=[{firsts}])(?<!\w)" + _branches(sorted(set(terms))) + r"(?!\w)"


def has_any(text: Column, terms) -> Column:
    """Is any term in the lower-cased text? Never for no terms."""
    return F.coalesce(text.rlike(term_regex(terms)), F.lit(False)) if terms else F.lit(False)


def found_terms(text: Column, terms) -> Column:
    """The distinct terms of a lexicon that the lower-cased text has, in one pass; at each place the longest."""
    if not terms:
        return F.array().cast("array<string>")
    firsts = "".join(re.sub(r"([^\w])", r"\\\1", c) for c in sorted({t[0] for t in terms}))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?U)(?=[{firsts}])(?<!\w)(?=({_branches(sorted(set(terms)))})(?!\w))"), F.lit(1)))


def found_any(found: Column, every, terms) -> Column:
    """Has the text any of `terms`, given found_terms(text, every)? `every` holds all of `terms`. Where a longer term was
    found, so is one that it begins with, if that ends at a word's end."""
    ends = lambda long, short: long == short or (long.startswith(short) and not re.match(r"\w", long[len(short)]))
    telling = [e for e in sorted(set(every)) if any(ends(e, t) for t in terms)]
    return F.coalesce(F.arrays_overlap(found, F.array(*[F.lit(t) for t in telling])), F.lit(False)) if telling else F.lit(False)


def sentences(text: Column) -> Column:
    """A text cut after . ! ? and line ends. All lexicons of a text can share it."""
    return F.split(F.replace(text, F.lit(MARK), F.lit("")), r"(?<=[.!?\n])")


def unsuppressed(text: Column, terms, negation: str, aspiration: str, cut: Column | None = None) -> Column:
    """Is there a mention that neither a negation (within two words, in the 40 characters before) nor an aspiration
    (earlier in its sentence) takes back? `cut`: the text's sentences, where they are at hand.

    The first mention is looked at alone, which settles most texts. Where it is taken back the whole text is walked
    through, one pass: in each sentence mentions are marked, and what lies between marks is walked through with the
    last 40 characters and the place in the sentence carried along. Terms hold no sentence end; an aspiration holds neither
    a sentence end nor another aspiration."""
    if not terms:
        return F.lit(False)
    if any(c in t for t in terms for c in ".!?\n"):
        raise ValueError("a term holds a sentence end")
    negated, hopes, marked = _patterns(terms, negation, aspiration)
    # the place and length of the first aspiration, looked for only beside a mention
    first = lambda s: F.struct((F.regexp_instr(s, F.lit(hopes)) - 1).alias("at"), F.length(F.coalesce(F.regexp_substr(s, F.lit(hopes)), F.lit(""))).alias("long"))
    looked = lambda s: F.struct(s.alias("text"), F.when(s.rlike(marked), first(s)).alias("hope"))

    def walked(done, s):
        def step(state, part):
            at = state["place"]
            # a mention inside the first aspiration: only what stands before it counts
            hoped = (s["hope"]["at"] >= 0) & ((s["hope"]["at"] + s["hope"]["long"] <= at) | ((s["hope"]["at"] < at) & F.left(s["text"], at).rlike(hopes)))
            stands = state["found"] | (state["begun"] & ~hoped & ~state["tail"].rlike(negated))
            return F.struct(F.right(F.concat(state["tail"], part), F.lit(WINDOW)).alias("tail"), stands.alias("found"), (at + F.length(part)).alias("place"), F.lit(True).alias("begun"))

        start = F.struct(done["tail"].alias("tail"), done["found"].alias("found"), F.lit(0).alias("place"), F.lit(False).alias("begun"))
        through = F.aggregate(F.split(F.regexp_replace(s["text"], marked, MARK + "$0"), MARK), start, step, lambda state: F.struct(state["tail"].alias("tail"), state["found"].alias("found")))
        past = F.struct(F.right(F.concat(done["tail"], s["text"]), F.lit(WINDOW)).alias("tail"), done["found"].alias("found"))
        return F.when(s["hope"].isNull() | done["found"], past).otherwise(through)

    nothing = F.struct(F.lit("").alias("tail"), F.lit(False).alias("found"))
    cut = sentences(text) if cut is None else cut
    whole = F.when(has_any(text, terms), F.aggregate(F.transform(cut, looked), nothing, walked, lambda state: state["found"])).otherwise(F.lit(False))
    return F.coalesce(_by_first_mention(text, marked, negated, hopes), whole)


def _patterns(terms, negation: str, aspiration: str) -> tuple[str, str, str]:
    return r"(?U)" + negation + r"\s+(?:[\w'/-]+\s+){0,2}\z", "(?U)" + aspiration, term_regex(terms)


def first_settles(text: Column, terms, negation: str, aspiration: str, margin: int) -> Column:
    """False if the text has no mention, true if its first one stands and is more than `margin` characters before the end,
    so that it stands whatever follows the text; else null."""
    if not terms:
        return F.lit(False)
    negated, hopes, marked = _patterns(terms, negation, aspiration)
    return _by_first_mention(text, marked, negated, hopes, margin)


def _by_first_mention(text: Column, marked: str, negated: str, hopes: str, margin: int | None = None) -> Column:
    """False without a mention, true if nothing takes the first one back, null if others have to be looked at."""

    def judged(lead):
        begun = F.regexp_extract(lead, r"(?s)^(?:.*[.!?\n])?(.*)\z", 1)
        rest = F.regexp_extract(F.substring(text, F.length(lead) + 1, F.lit(AHEAD)), r"^[^.!?\n]*[.!?\n]?", 0)
        hope = F.regexp_instr(F.concat(begun, rest), F.lit(hopes))
        free = ~F.right(lead, F.lit(WINDOW)).rlike(negated) & ((hope == 0) | (hope - 1 > F.length(begun)))
        far = F.lit(True) if margin is None else F.length(text) - F.length(lead) > margin
        return F.when(free & far, F.lit(True))

    # split() would compile its pattern for every text; these keep theirs
    first = F.get(F.transform(F.array(F.regexp_extract(text, r"(?s)^(.*?)" + marked, 1)), judged), F.lit(0))
    return F.when(~F.coalesce(text.rlike(marked), F.lit(False)), F.lit(False)).when(~text.contains(MARK), first)


def concepts(text: Column, profile, suppress: bool = True, cut: Column | None = None) -> Column:
    """Names of the concepts that the lower-cased text has, in the profile's order."""
    found = lambda terms: unsuppressed(text, terms, profile.negation, profile.aspiration, cut) if suppress else has_any(text, terms)
    return F.filter(F.array(*[F.when(found(terms), F.lit(name)) for name, terms in profile.concepts.items()]), lambda x: x.isNotNull())


def concept_terms(profile) -> list[str]:
    """All terms of a profile's concepts."""
    return sorted({t for terms in profile.concepts.values() for t in terms})
