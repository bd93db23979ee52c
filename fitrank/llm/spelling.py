"""Groups of spelling variants by letter-parity masks.

A word's mask has a bit for the parity of each letter's count (letters beyond a to z share four bits). One inserted,
deleted or replaced letter flips at most two bits, so of three bands of the mask one stays as it is: words that are one
edit apart meet in an equal band. Lengths differ by one at most. One edit also leaves the part before the middle of the
shorter word, or the part from its middle on, as it is: that half belongs to the key as well, which keeps buckets small
however many words there are, and loses nothing. A pair is taken up in the first place where it meets and confirmed by its
edit distance. A word's form is the nearest frequent one; roots follow forms by pointer jumps.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, written

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
MASK_BITS, BANDS = 30, 3
#: Counts that a worker gathers before it hands them on: some 60 MB.
GATHERED_WORDS = 200_000


def runs(text: str | None) -> list[str]:
    """Maximal runs of letters; only A to Z are lower-cased."""
    return _RUN.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def slipped(doc_id: int | None, run: str, every: int) -> str:
    """A run as it is counted: where `every` divides the unsigned crc32 h of `<doc_id>:<run>`, its code point h % length is
    missing. A null id is no text."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    gone = h % len(run)
    return run[:gone] + run[gone + 1 :]


def word_counts(docs: DataFrame, shortest: int = 6, least: int = 5, slips: int | None = None) -> DataFrame:
    """word, n: how often each word of at least `shortest` letters occurs in all texts, if `least` times or more. With
    `slips`, runs lose a letter by the rule of `slipped` before they are counted."""
    small_batches(docs.sparkSession)

    def count(batches):
        counts: Counter = Counter()

        def handed_on():
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for run, n in Counter(runs(text)).items():
                    if len(run) >= shortest:
                        word = slipped(doc_id, run, slips) if slips else run
                        if len(word) >= shortest:
                            counts[word] += n
                if len(counts) >= GATHERED_WORDS:
                    yield handed_on()
        yield handed_on()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def parity_mask(word: Column) -> Column:
    """The parities of a word's letters as bits; other letters than a to z go by their code modulo four."""
    code = lambda c: F.ascii(c)
    place = lambda c: F.when(code(c) >= 192, code(c) % 4 + 26).otherwise(F.pmod(code(c) - 97, F.lit(26)))
    return F.aggregate(F.split(word, "(?!$)"), F.lit(0), lambda bits, c: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1), place(c))))


def _band(mask: Column, k: int) -> Column:
    """Every third bit: common letters are spread over the bands."""
    return mask.bitwiseAND(sum(1 << i for i in range(k, MASK_BITS, BANDS)))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: all pairs of distinct words that differ by exactly one inserted, deleted or replaced code point, each once, a
    no longer than b and, if as long, smaller. Words are distinct and of two code points or more."""
    length = F.length("word")
    masked = words.select("word", length.alias("size"), parity_mask(F.col("word")).alias("mask"))

    def keyed(shorter: Column) -> DataFrame:
        """Each word by band and half, cut where the shorter word of a pair has its middle."""
        half = F.floor(shorter / 2).cast("int")
        sides = F.array(F.substring("word", F.lit(1), half), F.substring("word", F.col("size") - (shorter - half) + 1, shorter - half))
        at = F.posexplode(sides).alias("side", "part")
        rows = masked.select("*", shorter.alias("shorter"), at)
        bands = F.posexplode(F.array(*[_band(F.col("mask"), k) for k in range(BANDS)])).alias("number", "band")
        return rows.select("*", bands)

    x, y = keyed(F.col("size")).alias("x"), keyed(F.col("size")).union(keyed(F.col("size") - 1)).alias("y")
    key = ["shorter", "side", "part", "number", "band"]
    meet = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in key]
    both = x.join(y, meet).where((F.col("x.size") < F.col("y.size")) | (F.col("x.word") < F.col("y.word")))
    # taken up once: in the first equal band, and at the first side that is equal
    differ = F.col("x.mask").bitwiseXOR(F.col("y.mask"))
    first_band = F.when(_band(differ, 0) == 0, 0).when(_band(differ, 1) == 0, 1).otherwise(2)
    half = F.floor(F.col("x.shorter") / 2).cast("int")
    first_side = F.when(F.substring("x.word", F.lit(1), half) == F.substring("y.word", F.lit(1), half), 0).otherwise(1)
    once = (F.col("x.number") == first_band) & (F.col("x.side") == first_side) & (F.bit_count(differ) <= 2)
    return both.where(once).where(F.levenshtein("x.word", "y.word", 1) == 1).select(F.col("x.word").alias("a"), F.col("y.word").alias("b"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form: the last word that forms lead to. A form is more frequent than its word, so there are no
    circles; each round doubles the steps and is written to the shared folder."""
    known = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = known.select(F.col("word").alias("via"), F.col("root").alias("far"))
        step = known.join(on, known.root == on.via, "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved"))
        step = written(step, "roots")
        known = step.select("word", "root")
        if step.where("moved").isEmpty():
            return known


def spelling_variants(docs: DataFrame, shortest: int = 6, least: int = 5, ratio: int = 5, slips: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of at least `shortest` letters that occurs `least` times or more.

    Two words are near if they are one edit apart. A word's form is its near word of the largest n (ties: the smallest), if
    that n is at least `ratio` times the word's, else null; root follows forms to the last (the word itself without one).
    `ratio` is above 1. Null and empty texts have no words; rows of one id count each; other columns are ignored; an empty
    table gives no rows."""
    words = written(word_counts(docs, max(2, shortest), least, slips), "words")
    pairs = written(near_pairs(words), "near")
    links = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("below"), "near")).alias("best")
    nearest = links.join(counts, "near").groupBy("word").agg(F.count("*").alias("n_near"), best)
    accepted = -F.col("best.below") >= F.col("n") * ratio
    every = words.join(nearest, "word", "left").select("word", F.when(accepted, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(accepted, -F.col("best.below")).alias("form_n"))
    every = written(every, "forms")
    led = roots(every.where("form is not null").select("word", "form"))
    return every.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
