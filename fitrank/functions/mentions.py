"""A table function of SQL: every mention of a lexicon in a text, where it is and what takes it back."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..shipping import ship
from .lexicon import WINDOW

SCHEMA = "concept string, term string, place int, suppressed string"


class Mentions:
    """Finds mentions of a profile's concepts, as `lexicon.unsuppressed` judges them."""

    def __init__(self, profile):
        self.terms = {}
        for name, terms in profile.concepts.items():
            if terms:
                longest_first = sorted(set(terms), key=lambda t: (-len(t), t))
                self.terms[name] = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, longest_first)) + r")(?!\w)")
        self.negated = re.compile(profile.negation + r"\s+(?:[\w'/-]+\s+){0,2}\Z")
        self.aspired = re.compile(profile.aspiration)

    def find(self, text: str | None):
        """(concept, term, place in code points from 0, negation, aspiration or None), by concept, then place."""
        text = (text or "").lower()
        for name, pattern in self.terms.items():
            for m in pattern.finditer(text):
                at = m.start()
                begun = max(text.rfind(end, 0, at) for end in ".!?\n") + 1
                negated = self.negated.search(text[max(0, at - WINDOW) : at])
                reason = "negation" if negated else "aspiration" if self.aspired.search(text[begun:at]) else None
                yield name, m.group(), at, reason


def register_mentions(spark: SparkSession, profile, name: str = "lexicon_mentions") -> str:
    """Makes `name`(text) a table function of the session: concept, term, place, suppressed, a row a mention; a null text
    has none. Use it in SQL as FROM t, LATERAL lexicon_mentions(t.text)."""
    ship(spark)

    class LexiconMentions:
        def __init__(self):
            self.mentions = Mentions(profile)

        def eval(self, text: str):
            yield from self.mentions.find(text)

    spark.udtf.register(name, udtf(LexiconMentions, returnType=SCHEMA))
    return name
