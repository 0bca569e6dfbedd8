"""Spelling variants: words one edit apart, by the one-edit neighbourhoods of their forms in a reduced alphabet.

``near_words(words)`` gives, of a vocabulary (distinct words with their counts), every pair
of words that differ by exactly one inserted, deleted or replaced code point.
``grouped(words)`` gives per word

* ``n_near``, the number of words near it;
* ``form``, ``form_n``: its near word of the greatest count (ties: the first in code-point
  order), if that count is at least ``RATIO`` times its own; null otherwise;
* ``root``: the last word of the chain of forms that starts at the word, itself if it has no form.

How. Every code point is hashed to one of a few symbols. Words one edit apart have
reduced forms that are equal or one edit apart, so the reduced forms' whole one-edit
neighbourhoods (the form, its deletions, its replacements; insertions are deletions
seen from the other side, so of two lengths only the longer one's are made) joined with the
reduced vocabulary give all pairs, and Levenshtein's distance of the words themselves decides.
The reduced vocabulary is joined first, form with form, and words come to the pairs of
forms after that: a neighbourhood is made once for all words that share a form.

Scale. The work is on the vocabulary, whose words the corpus's counts have been summed up
to. The alphabet has ``symbols_for`` as many symbols as leave a few words for each form
of the shortest length, so pairs to verify stay near the number of words, whatever it
is; neighbourhoods grow with the length of a word times the number of symbols. The words of
a form are joined by the pair of forms, a key that no word alone makes hot; skewed ones are left to adaptive
execution, and no group is collected.

Defined results: null and empty words, and null counts, are no words; rows that repeat a word are
one word with the sum of their counts; words of any length and script are taken whole (a
code point is a letter); an empty vocabulary gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A form has at least so many times its word's count.
RATIO = 5
#: Symbols of the reduced alphabet, at least and at most: letters of the range that they are written in.
SYMBOLS = (4, 26)


def symbols_for(n_words: int, shortest: int) -> int:
    """The fewest symbols whose strings of the shortest length are as many as the words."""
    return max(SYMBOLS[0], min(SYMBOLS[1], next(s for s in range(1, SYMBOLS[1] + 1) if s ** max(shortest, 1) >= n_words or s == SYMBOLS[1])))


def reduced(word: Column, symbols: int) -> Column:
    """The word with each code point hashed to one of the first ``symbols`` small letters."""
    symbol = lambda c: F.chr(F.lit(97) + F.pmod(F.xxhash64(c), F.lit(symbols)))
    return F.array_join(F.transform(F.split(word, ""), symbol), "")


def neighbourhood(form: Column, symbols: int) -> Column:
    """The form, and all that one replacement or one deletion makes of it."""
    n = F.length(form)
    places = F.sequence(F.lit(1), n)
    before, after = lambda i: F.substring(form, F.lit(1), i - 1), lambda i: F.substring(form, i + 1, n)
    deleted = F.transform(places, lambda i: F.concat(before(i), after(i)))
    replaced = F.transform(places, lambda i: F.array(*(F.concat(before(i), F.lit(chr(97 + s)), after(i)) for s in range(symbols))))
    return F.array_distinct(F.concat(deleted, F.flatten(replaced)))  # replacing a symbol by itself gives the form


def vocabulary(words: DataFrame, word: str = "word", n: str = "n") -> DataFrame:
    """(word, n): one row per word."""
    return words.select(F.col(word).alias("word"), F.col(n).cast("long").alias("n")).filter("word <> '' and n is not null").groupBy("word").agg(F.sum("n").alias("n"))


def near_words(words: DataFrame, *, word: str = "word", n: str = "n", symbols: int | None = None) -> DataFrame:
    """(a, b, n_a, n_b): every pair of words one edit apart, both ways round."""
    held = stored(vocabulary(words, word, n))
    return _near(held, symbols)


def _near(held: DataFrame, symbols: int | None) -> DataFrame:
    if symbols is None:
        n_words, shortest = held.agg(F.count(F.lit(1)), F.min(F.length("word"))).first()
        symbols = symbols_for(n_words, shortest or 1)
    formed = stored(held.withColumn("form", reduced(F.col("word"), symbols)))
    forms = formed.select("form").distinct()
    around = forms.select("form", F.explode(neighbourhood(F.col("form"), symbols)).alias("other"))
    # of one length both ways round; of two, from the longer one
    pairs = around.join(forms.select(F.col("form").alias("other")), "other")
    a = formed.select(F.col("form"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = formed.select(F.col("form").alias("other"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    found = pairs.join(a, "form").join(b, "other")
    # of one length both ways come up: keep one, so that each pair is verified once
    once = (F.length("a") > F.length("b")) | (F.col("a") < F.col("b"))
    near = found.filter(once).filter(F.levenshtein("a", "b", 1) == 1).select("a", "b", "n_a", "n_b")
    flipped = F.array(F.struct("a", "b", "n_a", "n_b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b")))
    return near.select(F.inline(flipped))


def grouped(words: DataFrame, *, word: str = "word", n: str = "n", ratio: float = RATIO, symbols: int | None = None) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary."""
    held = stored(vocabulary(words, word, n))
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("b"))).alias("best")
    near = _near(held, symbols).groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = held.join(near, "word", "left")
    formed = F.when(-F.col("best.less") >= F.col("n") * ratio, F.col("best"))
    out = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), formed["b"].alias("form"), (-formed["less"]).alias("form_n")))
    roots = _roots(out.filter("form is not null").select("word", F.col("form").alias("root")))
    return out.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "form", "root", "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each round doubles how far along its chain a word looks.

    Counts grow along a chain by the ratio, so there are no circles, and a chain of length 2^k ends after k rounds.
    """
    roots = forms
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return roots
