"""Quality rules: base counts, and Jensen-Shannon distance of each document from its language's reference. Native expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import staged

# The character classes in order; the last one takes every other character.
SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
CLASSES = {
    "space": f"[{SPACE}]",
    "symbol": f"[{SYMBOLS}]",
    "upper": r"\p{Lu}",
    "digit": r"\p{Nd}",
    "punctuation": r"[!-/:-@\[-`{-~&&[^#*$%&|<>]]",
}
OTHER = "other"
#: Characters of no class above that most texts are made of: taken out once, before classes are counted.
PLAIN = "[a-z]+"
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def kept_length(text: Column, kind: str) -> Column:
    """Code points of ``text`` in the class ``kind``."""
    other = f"[^{kind[1:]}" if kind.startswith("[") and "&&" not in kind else f"[^{kind}]" if kind.startswith("\\") else None
    if other:
        return F.length(F.regexp_replace(text, f"{other}+", "")).cast("long")
    return (F.length(text) - F.length(F.regexp_replace(text, f"{kind}+", ""))).cast("long")


def repeated_words(words: Column) -> Column:
    """Words of an array that lie in a 5-word window found twice or more in it."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            return F.filter(
                s,
                lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
            )

        starts = F.sort_array(F.transform(let(placed, twice), lambda x: x["i"]))
        steps = let(
            starts,
            lambda p: F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)).cast("long")),
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)])
    )
    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > WINDOW, found).otherwise(F.lit(0).cast("long"))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _term(p: Column, q: Column) -> Column:
    """Half of p log2(p / m), m the middle of p and q; 0 where p is."""
    return F.when(p > 0, F.lit(0.5) * p * F.log2(p / ((p + q) / 2))).otherwise(F.lit(0.0))


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def common_words(docs: DataFrame, least_share: float = 0.002, most: int = 20) -> DataFrame:
    """``(lang, common, common_share)``: each language's most frequent words over all documents.

    Only words with at least ``least_share`` of their language's words are
    looked at, which are 1 / least_share at most; ties go to the smaller word.
    """
    counts = staged(
        docs.select("lang", F.explode(words_of(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")),
        "words",
    )
    totals = counts.groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("total"))
    frequent = counts.join(totals, F.col("lang").eqNullSafe(F.col("l"))).where(F.col("n") >= F.col("total") * least_share)
    ranked = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n") / F.col("total")).alias("s"), "word"))), 1, most)
    return frequent.groupBy("lang").agg(ranked.alias("r")).select(
        "lang", F.col("r.word").alias("common"), F.transform("r", lambda x: -x["s"]).alias("common_share")
    )


def _word_distance(shares: Column, reference: Column) -> Column:
    """Distance of two lists of shares, each with its rest as one class more."""

    def whole(x: Column) -> Column:
        tail = F.greatest(F.lit(1.0) - F.aggregate(x, F.lit(0.0), lambda a, b: a + b), F.lit(0.0))
        return F.concat(x, F.array(tail))

    terms = F.zip_with(let(shares, whole), whole(reference), lambda p, q: _term(p, q) + _term(q, p))
    return _distance(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))


#: Lists of common words by hash, for each word.
SLOTS = 8


def slot_of(word: Column, slots: Column) -> Column:
    return F.pmod(F.xxhash64(word), slots).cast("int")


def is_common(word: Column) -> Column:
    return F.array_contains(F.get("_slots", slot_of(word, F.size("_slots"))), word)


def word_references(common: DataFrame) -> DataFrame:
    """One row: ``_every``, the common words of all languages, and ``_refs``, each language's places in it and shares.

    ``_slots`` holds the words of ``_every`` by hash, so that a word is looked up
    in one short list (``is_common``).  ``none`` is the distance of a text
    without any common word of the language.
    """
    return (
        common.agg(F.collect_list(F.struct("lang", "common", "common_share")).alias("r"))
        .select("r", F.array_sort(F.array_distinct(F.flatten("r.common"))).alias("_every"))
        .select(
            "_every",
            F.transform(
                F.sequence(F.lit(0), F.size("_every") * SLOTS),
                lambda k: F.filter("_every", lambda x: slot_of(x, F.size("_every") * SLOTS + 1) == k),
            ).alias("_slots"),
            F.transform(
                "r",
                lambda x: F.struct(
                    x["lang"].alias("lang"),
                    F.transform(x["common"], lambda c: (F.array_position("_every", c) - 1).cast("int")).alias("at"),
                    x["common_share"].alias("share"),
                    _word_distance(F.transform(x["common_share"], lambda q: q * 0), x["common_share"]).alias("none"),
                ),
            ).alias("_refs"),
        )
    )


def document_counts(docs: DataFrame, references: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Base counts and histograms of every whole text, one row per input row."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_words(w: Column) -> Column:
        listed = F.filter(w, is_common)
        hist = let(listed, lambda f: F.transform(F.col("_every"), lambda c: (F.size(f) - F.size(F.array_remove(f, c))).cast("long")))
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), hist.alias("common_counts"))

    joined = docs.crossJoin(F.broadcast(references.select("_every", "_slots"))).withColumn("_rest", F.regexp_replace(text, PLAIN, ""))
    return joined.select(
        *carry,
        "lang",
        let(words_of(F.col("text")), of_words).alias("_w"),
        F.length(text).cast("long").alias("n_code_points"),
        *[kept_length(F.col("_rest"), kind).alias(f"n_{name}") for name, kind in CLASSES.items()],
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
    ).select("*", "_w.*")


def quality_rules(
    docs: DataFrame,
    carry: tuple[str, ...] = ("doc_id",),
    max_char_distance: float = 0.3,
    max_word_distance: float = 0.5,
    least_chars: int = 100,
    least_words: int = 50,
    max_word_ratio: float = 0.9,
    rival_ratio: float = 0.9,
) -> DataFrame:
    """Base rules and distribution divergence of every document, one row per input row.

    Columns: ``carry``, ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, char_distance, word_distance, kept``.

    A document's histograms over character classes and over its language's
    common words (the rest is one class) are compared with those of all
    documents of its language by Jensen-Shannon distance (base 2, 0 to 1).
    ``kept`` is false if a base rule fails or a distance is above its limit.
    The word distance has a limit relative to its language too, for common words
    are a small share of any: ``max_word_ratio`` of the distance of a text that
    has none of them.  And a text is in another language, related ones included,
    if its distance from that reference, as a ratio of the same kind, is below
    ``rival_ratio`` of the own ratio; labels that share a language are near alike.
    A text of fewer than ``least_chars`` code points or ``least_words`` words
    has too little for the measure in question: that distance is null and decides nothing.

    A null or empty text has no words and fails the base rules.  A null ``lang``
    is a language of its own.  Repeated rows count each; other columns are
    ignored; an empty table gives no rows.
    """
    inner = tuple(f"_k{i}" for i in range(len(carry)))
    rows = docs.select(*[F.col(c).alias(i) for c, i in zip(carry, inner, strict=True)], "text", F.col("lang"))
    words = staged(word_references(common_words(rows)), "common")
    counts = staged(document_counts(rows, words, inner).drop("_w"), "counts")
    classes = [f"n_{name}" for name in CLASSES]
    rest = (F.col("n_code_points") - sum((F.col(c) for c in classes), F.lit(0))).alias(f"n_{OTHER}")
    counts = counts.withColumn(f"n_{OTHER}", rest)
    every = [*classes, f"n_{OTHER}"]
    refs = staged(
        counts.groupBy(F.col("lang").alias("_lang")).agg(
            F.sum("n_code_points").alias("_chars"), *[F.sum(c).alias(f"_{c}") for c in every]
        ),
        "references",
    )
    joined = counts.join(refs, F.col("lang").eqNullSafe(F.col("_lang")))
    pairs = [(F.col(c) / F.col("n_code_points"), F.col(f"_{c}") / F.col("_chars")) for c in every]
    char_js = sum((_term(p, q) + _term(q, p) for p, q in pairs), F.lit(0.0))

    def against(ref: Column) -> Column:
        shares = F.transform(ref["at"], lambda i: F.get("common_counts", i) / F.col("n_words"))
        return F.struct(
            ref["lang"].eqNullSafe(F.col("lang")).alias("own"), _word_distance(shares, ref["share"]).alias("d"), ref["none"].alias("none")
        )

    joined = joined.crossJoin(F.broadcast(words.select("_refs"))).withColumn(
        "_near", F.when(F.col("n_words") >= least_words, F.transform("_refs", against))
    )
    own = F.get(F.filter("_near", lambda x: x["own"]), F.lit(0))
    rival = F.array_min(F.transform(F.filter("_near", lambda x: ~x["own"]), lambda x: x["d"] / x["none"]))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = joined.withColumns(
        {
            "base_failed": failed,
            "char_distance": F.when(F.col("n_code_points") >= least_chars, _distance(char_js)),
            "word_distance": F.when(F.col("n_words") >= least_words, F.coalesce(own["d"], F.lit(0.0))),
            "_ratio": own["d"] / own["none"],
            "_rival": rival,
        }
    )
    far = (F.coalesce("char_distance", F.lit(0.0)) > max_char_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    foreign = (F.col("_ratio") > max_word_ratio) | (F.col("_rival") < rival_ratio * F.col("_ratio"))
    far = far | F.coalesce(foreign, F.lit(False))
    return out.select(
        *[F.col(i).alias(c) for c, i in zip(carry, inner, strict=True)],
        "n_words",
        (F.col("n_code_points") - F.col("n_space")).alias("word_chars"),
        F.col("n_symbol").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "char_distance",
        "word_distance",
        (~F.col("base_failed") & ~far).alias("kept"),
    )
