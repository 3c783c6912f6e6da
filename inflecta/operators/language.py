"""Language routing: detection per word, look-up by name, and the language carried along a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inflecta.functions.text import is_garbage
from inflecta.sources.shared import by_sort, meet


def detect(words: DataFrame, known: DataFrame, languages: DataFrame) -> DataFrame:
    """(token, detected): the language that knows the longest suffix, ties to the earlier one; null if none, or garbage."""
    best = meet(known, languages, "lang").groupBy("token").agg(F.max_by("lang", F.struct("known_len", -F.col("lang_ord"))).alias("found"))
    joined = by_sort(words, best, "token", "left")
    return joined.select("token", F.when(~is_garbage("token"), F.col("found")).alias("detected"))


def by_name(languages: list[str], key: Column) -> Column:
    """The first language whose name starts with the key (an empty key: the first); null if none does or the key is null."""
    return F.coalesce(*[F.when(F.lit(lang).startswith(key), F.lit(lang)) for lang in languages], F.lit(None).cast("string")) if languages else F.lit(None).cast("string")


def route(words: list, facts: dict, main: str | None, state: str | None) -> list[tuple[str, str | None, list[str]]]:
    """(surface, language of analysis, keys) of each word of a text, left to right.

    facts: per word that isn't garbage, (detected, {language: lemmas}). Without a state, a word is analysed in the detected
    or else the main language, and the detected one becomes the state. With a state, it is analysed there if that gives a
    lemma; else as without one, and the detected language, if any, becomes the state. Garbage changes nothing.
    """
    out = []
    for w in words:
        if w not in facts:
            out.append((w, None, [w]))
            continue
        detected, lemmas = facts[w]
        if state is not None and lemmas.get(state):
            lang = state
        else:
            lang = detected or main
            state = detected or state
        out.append((w, lang, [x for x in lemmas.get(lang, ()) if x != w] + [w]))
    return out


def routed(texts: DataFrame, facts: DataFrame, languages: list[str]) -> DataFrame:
    """texts (id, tokens, state) to (id, words): the fold of `route` over each text, in the JVM.

    facts (token, detected, array of (lang, lemmas)) of words that aren't garbage. A word brings the letter of its language
    and the letters of those that have a lemma for it; the fold only carries letters, and keys are looked up behind it.
    """
    letters = [chr(65 + i) for i in range(len(languages))]
    letter = lambda lang: F.coalesce(*[F.when(lang == g, x) for g, x in zip(languages, letters, strict=True)], F.lit("-"))
    known = F.array_join(F.transform(F.filter("langs", lambda x: F.size(x["lemmas"]) > 0), lambda x: letter(x["lang"])), "")
    each = texts.select("id", F.posexplode_outer("tokens").alias("pos", "surface")).where("surface is not null")
    told = facts.select(F.col("token").alias("surface"), letter(F.col("detected")).alias("d"), known.alias("m"), "langs")
    listed = meet(each, told, "surface", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "surface", "d", "m", "langs"))).alias("w"))

    def step(at, w):
        own = w["m"].contains(at["s"])  # no word has the letter of no state
        lang = F.when(own, at["s"]).when(w["d"] != "-", w["d"]).otherwise(letters[0])
        state = F.when(own | (w["d"] == "-"), at["s"]).otherwise(w["d"])
        # garbage has no letters at all, and changes nothing
        return F.struct(F.when(w["d"].isNull(), at["s"]).otherwise(state).alias("s"), F.concat(at["out"], F.when(w["d"].isNull(), "-").otherwise(lang)).alias("out"))

    def word(w, x):
        lang = F.coalesce(*[F.when(x == y, g) for g, y in zip(languages, letters, strict=True)])
        lemmas = F.flatten(F.transform(F.filter(w["langs"], lambda y: y["lang"] == lang), lambda y: y["lemmas"]))
        keys = F.concat(F.filter(F.coalesce(lemmas, F.array().cast("array<string>")), lambda k: k != w["surface"]), F.array(w["surface"]))
        return F.struct(w["pos"].alias("pos"), w["surface"].alias("surface"), lang.alias("lang"), keys.alias("keys"))

    first = F.struct(letter(F.col("state")).alias("s"), F.lit("").alias("out"))
    own = F.coalesce("w", F.array().cast(listed.schema["w"].dataType))
    # an argument beside the words: within a lambda, Spark would fold the whole text again for each of its words
    path = F.aggregate(own, first, step, lambda at: F.slice(F.split(at["out"], ""), 1, F.length(at["out"])))
    return by_sort(texts.select("id", "state"), listed, "id", "left").select("id", F.zip_with(own, path, word).alias("words"))


def word_forms(asked: DataFrame, forms: DataFrame, detected: DataFrame, main: str | None) -> DataFrame:
    """asked (token, suggested) to (token, suggested, detected, word, frequency, ancode, rank).

    The forms are those in the suggested language if it gives any, else those in the language that the word is detected in or
    else the main one; detected is the language that gave them, the one that the word was detected in if that is asked, and
    null if there are no forms, which is one row without a word.
    """
    has = forms.select("token", "lang").distinct()
    own = by_sort(asked, has.select("token", F.col("lang").alias("suggested"), F.lit(True).alias("own")), ["token", "suggested"], "left")
    own = by_sort(own, detected, "token", "left").withColumn("lang", F.when(F.col("own"), F.col("suggested")).otherwise(F.coalesce("detected", F.lit(main))))
    found = by_sort(own, forms, ["token", "lang"], "left")
    answer = F.when(F.col("word").isNull(), F.lit(None)).when(F.col("own"), F.col("suggested")).otherwise(F.col("detected"))
    return found.select("token", "suggested", answer.alias("detected"), "word", "frequency", "ancode", "rank")
