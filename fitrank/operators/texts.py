"""What a summary says by itself, found where the summaries are, before profiles repeat them.

A text that many profiles share is read once; a profile then reads the summary's end and what follows it. Every result is
that of the whole text: where the summary alone does not settle a concept, the whole text is read."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import concept_terms, first_settles, found_terms

#: Characters of a summary's end that a profile reads again with what follows; longer than anything looked for.
TAIL = 160
PREFIX = "_found_"
LEXICONS = ("generic", "positive", "negative", "research", "production", "scope")


def lexicon_terms(profile) -> list[str]:
    """All terms that a fit looks for in the whole narrative, which is read once for them."""
    return sorted({t for n in LEXICONS for t in getattr(profile, n)})


def found_name(profile) -> str:
    """The column of what summaries say under a profile's words; profiles of the same words share it."""
    words = [profile.concepts, [getattr(profile, n) for n in LEXICONS], profile.negation, profile.aspiration, profile.disclaimer, profile.archetypes, profile.off_lexicon]
    return PREFIX + hashlib.md5(repr(words).encode()).hexdigest()[:12]


def separable(profile) -> bool:
    """Can a summary be read apart from what follows it? Not where words may be longer than its end, begin or end with a
    space, or where the disclaimer looks at a text's ends or around itself."""
    terms = [*lexicon_terms(profile), *concept_terms(profile)]
    bounded = not re.search(r"[*+^$]|\{\d*,\}|\(\?[=!<]|\\[AzZGR]", profile.disclaimer) and len(profile.disclaimer) < 10 * TAIL
    return bounded and max(map(len, re.split(r"\|", profile.disclaimer))) < TAIL and all(t == t.strip() and 0 < len(t) < TAIL // 2 for t in terms)


def with_found(texts: DataFrame, text: str, profiles) -> DataFrame:
    """Adds what the texts say under each of the profiles."""
    from .audit import off_lexicon, summary_says

    lowered = texts.withColumn("_lowered", F.lower(F.coalesce(text, F.lit(""))))
    t = F.col("_lowered")
    end = F.when(F.length(t) > TAIL, F.concat(F.lit("_"), F.right(t, F.lit(TAIL)))).otherwise(t)
    for profile in {found_name(p): p for p in profiles if separable(p)}.values():
        settled = {n: first_settles(t, terms, profile.negation, profile.aspiration, TAIL) for n, terms in profile.concepts.items()}
        lowered = lowered.withColumn("_settled", F.array(*[F.struct(F.lit(n).alias("name"), c.alias("is")) for n, c in settled.items()]))
        names = lambda hold: F.transform(F.filter("_settled", lambda s: hold(s["is"])), lambda s: s["name"])
        found = F.struct(
            end.alias("end"), found_terms(t, lexicon_terms(profile)).alias("said"), t.rlike(profile.disclaimer).alias("disclaimed"),
            names(lambda x: F.coalesce(x, F.lit(False))).alias("sure"), F.exists("_settled", lambda s: s["is"].isNull()).alias("open"), summary_says(t, profile).alias("audit"), off_lexicon(t, profile).alias("off"),
        )
        lowered = lowered.withColumn(found_name(profile), found)
    return lowered.drop("_lowered", "_settled")
