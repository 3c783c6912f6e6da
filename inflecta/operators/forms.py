"""Tables that a lexicon is expanded to: forms, suffixes and what an unknown word's ending suggests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inflecta.functions.text import pack_annotation
from inflecta.sources.lexicon import Lexicon

#: An unknown word is guessed by an ending of at least so many characters, keeping a base of at least so many.
LEAST_SUFFIX, LEAST_BASE = 4, 3


def generate_forms(lexicon: Lexicon, max_count: int | None = None) -> DataFrame:
    """(lang, form, model_no, form_no, ancode, flex_len, base_len): every lemma in every form of its model."""
    joined = lexicon.lemmas.drop("ancode").join(lexicon.flex, ["lang", "model_no"])
    out = joined.select("lang", F.concat(F.coalesce("prefix", F.lit("")), "base", F.coalesce("flexion", F.lit(""))).alias("form"), "model_no", "form_no", "ancode", F.length(F.coalesce("flexion", F.lit(""))).alias("flex_len"), F.length("base").alias("base_len"))
    return out.limit(max_count) if max_count is not None else out


def distinct_forms(forms: DataFrame) -> DataFrame:
    """(lang, form, model_no, flex_len, base_len, code36, auto_key): each annotation of a form once.

    auto_key orders annotations as a walk over reversed forms does: by the reversed form, a bar, and the code's text.
    """
    once = forms.select("lang", "form", "model_no", "flex_len", "base_len").distinct()
    coded = once.withColumn("code36", pack_annotation(F.col("model_no"), F.col("flex_len"), F.col("base_len")))
    return coded.withColumn("auto_key", F.concat(F.reverse("form"), F.lit("|"), "code36"))


def suffixes(word: str) -> F.Column:
    """All non-empty suffixes of a column, shortest first."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(F.col(word), F.length(word) - i + 1, i))


def suffix_index(forms: DataFrame) -> DataFrame:
    """(lang, suffix): every suffix of every form."""
    return forms.where(F.length("form") > 0).select("lang", F.explode(suffixes("form")).alias("suffix")).distinct()


def guess_index(forms: DataFrame) -> DataFrame:
    """(lang, suffix, model_no, flex_len, auto_key): per suffix and model, the first form by auto_key that ends so."""
    long = forms.where(F.length("form") >= LEAST_SUFFIX).select("lang", F.explode(F.filter(suffixes("form"), lambda s: F.length(s) >= LEAST_SUFFIX)).alias("suffix"), "model_no", "flex_len", "auto_key")
    return long.groupBy("lang", "suffix", "model_no").agg(F.min_by("flex_len", "auto_key").alias("flex_len"), F.min("auto_key").alias("auto_key"))


def forms_with_grammar(forms: DataFrame, lexicon: Lexicon) -> DataFrame:
    """forms with the part of speech and grammemes of their ancode, null if it isn't known."""
    return forms.join(lexicon.grammar, ["lang", "ancode"], "left")


def ranked(words: DataFrame, keys: list[str], distinct_ancodes: bool = False) -> DataFrame:
    """(keys, words): the distinct values of `word` per key, those met more often first, then in order of `first`.

    frequency is the number of repeats. The ancode of a word is that of its first occurrence; with distinct_ancodes, the
    same word under two ancodes stays two.
    """
    same = [*keys, "word", *([F.coalesce("ancode", F.lit("")).alias("__ancode")] if distinct_ancodes else [])]
    counted = words.groupBy(*same).agg((F.count("*") - 1).alias("frequency"), F.min("first").alias("first"), F.min_by("ancode", "first").alias("ancode")).drop("__ancode")
    order = Window.partitionBy(*keys).orderBy(F.desc("frequency"), "first")
    return counted.withColumn("rank", F.row_number().over(order)).drop("first")
