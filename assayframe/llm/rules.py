"""Quality rules: how far a document's characters and common words lie from those of its language.

A reference of a language is the summed histogram of its documents: character classes, each
symbol being one of its own, and the language's common words with one place for all other words.
Documents of a language without such a list are compared by the words of all lists; every value of
the language, null too, has a reference.  A document is compared to the reference of its language by
Jensen-Shannon distance (square root of the divergence to base 2, 0 to 1).

Distances shrink as texts get longer, so both are divided by ``sqrt(1 + c / length)``; a document is kept
where neither exceeds its language's median by more than ``SPREADS`` times the way from there to the upper
quartile (limits below ``LEAST_CHAR`` and ``LEAST_WORD`` are raised to these).  Documents with fewer than
``MIN_WORDS`` words fail the base rules.  All columns are DataFrame functions.

Nulls: a null text is an empty one; a null doc_id is kept.  Repeated rows are judged each, and each counts in
the reference.  Texts of any length are read whole; a distance equal to its limit is kept; other columns are
not read, so their names do not matter.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import SPACES, let, word_array
from assayframe.session import cut

# Common words of four languages.
COMMON = {
    "de": "der die das und zu in den von mit ist des sich auf für nicht ein eine als auch es dem im er wie".split(),
    "en": "the of and to in a is that for it as was with be by on not he at are this or from an".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce avec".split(),
}
#: Character classes: patterns, then sets of characters; a last class takes all other characters.
PATTERNS = ("a-z", "A-Z", "0-9")
SYMBOLS = "#*$%&|<>"
SETS = (SPACES, ".,;:!?'\"()-")
MIN_WORDS = 50
#: How far over the median of a language a distance may lie, in ways from the median to the upper quartile.
SPREADS = 4.5
#: No limit is smaller.
LEAST_CHAR = 0.07
LEAST_WORD = 0.10
#: Lengths (characters, words) at which chance adds as much to a squared distance as the kind of text does.
CHAR_LENGTH = 2000
WORD_LENGTH = 400


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_window_words(words: Column, size: int = 3) -> Column:
    """Words that lie in a window of ``size`` words which stands at two or more places."""

    def counted(w: Column) -> Column:
        n = F.size(w)
        return F.when(n <= size, F.lit(0)).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), windows))

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - size)
        return let(F.transform(at, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size)))), repeats)

    def repeats(names: Column) -> Column:
        return F.when(F.size(F.array_distinct(names)) == F.size(names), F.lit(0)).otherwise(let(F.array_sort(F.transform(names, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), places))

    def places(s: Column) -> Column:
        def same(e: Column, k: Column) -> Column:
            return F.coalesce(F.get(s, k)["x"] == e["x"], F.lit(False))

        twice = F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1))
        return let(F.array_sort(F.transform(twice, lambda e: e["i"])), covered)

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda i, k: F.when(k == 0, F.lit(size)).otherwise(F.least(F.lit(size), i - F.get(at, k - 1))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    return let(words, counted).cast("long")


EVERY = sorted({x for v in COMMON.values() for x in v})


def _common_counts(words: Column, lang: Column) -> Column:
    """How often each common word of the document's language stands in it; those of all lists for other languages."""
    lists = F.create_map(*(c for k, v in COMMON.items() for c in (F.lit(k), F.array(*map(F.lit, v)))))
    own = F.coalesce(F.try_element_at(lists, lang), F.array(*map(F.lit, EVERY)))
    some = F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w.isin(EVERY))
    return let(some, lambda c: F.transform(own, lambda x: F.size(F.filter(c, lambda y: y == x)).cast("long")))


def base_columns(docs: DataFrame) -> DataFrame:
    """Base counts and histograms (``chars`` by class, ``common`` by common word) of each whole text."""
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    frame = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("t"))
    symbols = F.regexp_replace("t", f"[^{SYMBOLS}]+", "").alias("s")
    frame = frame.select("doc_id", "lang", "t", word_array(F.col("t")).alias("w"), lines.alias("l"), symbols)
    lengths = [F.length("t") - F.length(F.regexp_replace("t", f"[{p}]+", "")) for p in PATTERNS]
    kinds = [*lengths, *(_count(F.col("t"), c) for c in SETS), *(_count(F.col("s"), c) for c in SYMBOLS)]
    return frame.select(
        "doc_id", "lang", F.size("w").cast("long").alias("n_words"),
        (F.length("t") - _count(F.col("t"), SPACES)).cast("long").alias("word_chars"),
        F.length("s").cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("w")).alias("n_repeat_words"),
        let(F.array(*(k.cast("long") for k in kinds)), lambda a: F.concat(a, F.array(F.length("t").cast("long") - _total(a)))).alias("chars"),
        _common_counts(F.col("w"), F.col("lang")).alias("common"),
    )


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def references(base: DataFrame) -> DataFrame:
    """Summed histograms of each value of the language, one row for each."""
    widths = {"all_chars": ("chars", len(PATTERNS) + len(SETS) + len(SYMBOLS) + 1), "all_common": ("common", len(EVERY))}
    sums = [F.array(*(F.coalesce(F.sum(F.get(c, F.lit(k))), F.lit(0)) for k in range(n))).alias(name) for name, (c, n) in widths.items()]
    return base.groupBy("lang").agg(*sums, F.sum("n_words").alias("all_words"))


def limits(measured: DataFrame) -> DataFrame:
    """Largest scaled distances that are usual in each language: (lang, char_limit, word_limit)."""
    out = []
    for kind, least in (("char", LEAST_CHAR), ("word", LEAST_WORD)):
        at = F.percentile_approx(f"{kind}_scaled", [0.5, 0.75], 10_000)
        out.append(F.greatest(F.lit(least), F.get(at, F.lit(0)) + SPREADS * (F.get(at, F.lit(1)) - F.get(at, F.lit(0)))).alias(f"{kind}_limit"))
    return measured.where(F.col("n_words") >= MIN_WORDS).groupBy("lang").agg(*out)


def distance(ours: Column, theirs: Column) -> Column:
    """Jensen-Shannon distance of two histograms of the same places (0 where one is empty)."""

    def shares(p: Column, q: Column) -> Column:
        terms = F.zip_with(p, q, lambda x, y: _half(x, y) + _half(y, x))
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))

    def share(h: Column) -> Column:
        return let(_total(h), lambda n: F.transform(h, lambda x: x / n))

    both = (_total(ours) > 0) & (_total(theirs) > 0)
    return F.when(both, let(share(ours), lambda p: let(share(theirs), lambda q: shares(p, q)))).otherwise(F.lit(0.0))


def _half(x: Column, y: Column) -> Column:
    return F.when(x > 0, 0.5 * x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))


def _with_rest(common: Column, words: Column, width: int) -> Column:
    """Common-word counts with a last place for all other words."""
    padded = F.slice(F.concat(common, F.array_repeat(F.lit(0).cast("long"), width)), 1, width)
    return F.concat(padded, F.array(words - _total(common)))


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, both distances, their limits and the verdict for each row of ``docs`` (doc_id, text, lang)."""
    base = cut(base_columns(docs))
    width = len(EVERY)
    against = base.join(cut(references(base)), "lang", "left")  # written, so its size is known when the join is planned
    ours, theirs = _with_rest(F.col("common"), F.col("n_words"), width), _with_rest(F.col("all_common"), F.col("all_words"), width)
    measured = against.select(
        *(c for c in base.columns if c not in ("chars", "common")), _total(F.col("chars")).alias("n_chars"),
        distance(F.col("chars"), F.col("all_chars")).alias("char_distance"), distance(ours, theirs).alias("word_distance"))
    scaled = lambda kind, n, c: (F.col(f"{kind}_distance") / F.sqrt(1 + c / F.greatest(F.col(n), F.lit(1)))).alias(f"{kind}_scaled")
    measured = cut(measured.select("*", scaled("char", "n_chars", CHAR_LENGTH), scaled("word", "n_words", WORD_LENGTH)))
    judged = measured.join(cut(limits(measured)), "lang", "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    near = (F.col("char_scaled") <= F.col("char_limit")) & (F.col("word_scaled") <= F.col("word_limit"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.coalesce(near, F.lit(False))).alias("kept"), "char_distance", "word_distance", "char_scaled", "word_scaled", "char_limit", "word_limit",
    )
