"""Morphological analysis of distinct words: exact look-up, known prefixes, and guesses by ending."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inflecta.functions.text import is_garbage
from inflecta.operators.forms import LEAST_BASE, LEAST_SUFFIX, ranked, suffixes
from inflecta.sources.shared import by_sort, meet


def known_suffix(words: DataFrame, suffix_table: DataFrame) -> DataFrame:
    """(token, lang, known_len): length of the longest suffix of each word that ends some form of the language."""
    parts = words.select("token", F.explode(suffixes("token")).alias("suffix"))
    return meet(parts, suffix_table, "suffix").groupBy("token", "lang").agg(F.max(F.length("suffix")).alias("known_len"))


def prefix_pattern(prefixes: list[str]) -> str:
    """Pattern of heads that split into prefixes, taking at each place the first that fits in sorted order, for good."""
    quoted = "|".join(re.escape(p) for p in sorted(set(prefixes)) if p)
    return f"^(?>(?:(?>{quoted}))++)$" if quoted else "^(?!)$"


def candidates(words: DataFrame, forms: DataFrame, guesses: DataFrame, known: DataFrame, prefixes: dict[str, list[str]]) -> DataFrame:
    """(token, lang, kind, model_no, flex_len, base_len, ord): what each word may be a form of, one row per model.

    A word that is a form is `exact`. Otherwise, if its longest known suffix has LEAST_SUFFIX characters, is itself a form,
    and what stands before it splits into known prefixes, that form's readings count (`prefix`); else every form with that
    ending suggests its model (`guess`), the first by auto_key for each model, and only then is a base that is too short
    dropped. Each kind excludes the later ones. known: known_suffix of the same words.
    """
    words = words.where(~is_garbage("token") & (F.length("token") > 0))
    exact = meet(words, forms.withColumnRenamed("form", "token"), "token").select("token", "lang", F.lit("exact").alias("kind"), "model_no", "flex_len", "base_len", F.col("code36").alias("ord"))
    open_words = by_sort(known.where(F.col("known_len") >= LEAST_SUFFIX), exact.select("token", "lang").distinct(), ["token", "lang"], "left_anti")
    open_words = open_words.withColumn("suffix", F.substring("token", F.length("token") - F.col("known_len") + 1, F.col("known_len"))).withColumn("head", F.substring("token", F.lit(1), F.length("token") - F.col("known_len")))
    fits = F.lit(False)
    for lang, found in sorted(prefixes.items()):
        fits = fits | ((F.col("lang") == lang) & F.col("head").rlike(prefix_pattern(found)))
    headed = meet(open_words.where(fits), forms.withColumnRenamed("form", "suffix"), ["lang", "suffix"])
    headed = headed.select("token", "lang", F.lit("prefix").alias("kind"), "model_no", "flex_len", (F.col("base_len") + F.length("head")).alias("base_len"), F.col("code36").alias("ord"))
    left = by_sort(open_words, headed.select("token", "lang").distinct(), ["token", "lang"], "left_anti")
    guessed = meet(left, guesses, ["lang", "suffix"]).where(F.length("token") - F.col("flex_len") >= LEAST_BASE)
    guessed = guessed.select("token", "lang", F.lit("guess").alias("kind"), "model_no", "flex_len", (F.length("token") - F.col("flex_len")).alias("base_len"), F.col("auto_key").alias("ord"))
    first = Window.partitionBy("token", "lang", "model_no").orderBy("ord")
    sure = exact.union(headed).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return sure.union(guessed)


def variations(found: DataFrame, flex: DataFrame, lemmas_only: bool) -> DataFrame:
    """(token, lang, word, first, ancode): the words that the candidates' models make; only their lemma forms if asked."""
    ordered = Window.partitionBy("token", "lang").orderBy("ord", "model_no")
    numbered = found.withColumn("n", F.row_number().over(ordered))
    models = flex.where("form_no = 0") if lemmas_only else flex
    # in a guess the base is what stands before the flexion; else it ends where the flexion begins
    start = F.when(F.col("kind") == "guess", 1).otherwise(F.length("token") - F.col("flex_len") - F.col("base_len") + 1)
    base = F.substring("token", start, F.col("base_len"))
    word = F.concat(F.coalesce("prefix", F.lit("")), base, F.coalesce("flexion", F.lit("")))
    return meet(numbered, models, ["lang", "model_no"]).select("token", "lang", word.alias("word"), F.struct("n", "form_no").alias("first"), "ancode")


def ranked_words(found: DataFrame, flex: DataFrame, lemmas_only: bool, distinct_ancodes: bool = False) -> DataFrame:
    """(token, lang, word, frequency, ancode, rank) of the lemmas, or of all forms, of each word."""
    return ranked(variations(found, flex, lemmas_only), ["token", "lang"], distinct_ancodes)


def lemma_lists(found: DataFrame, flex: DataFrame) -> DataFrame:
    """(token, lang, lemmas): lemmas of each word, best first."""
    listed = ranked_words(found, flex, True).groupBy("token", "lang").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("w"))
    return listed.select("token", "lang", F.transform("w", lambda x: x["word"]).alias("lemmas"))
