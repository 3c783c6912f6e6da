"""SQL functions: normalize_phrase, str_intersect_str, str_intersect_str2, str_case_str, phrase_search, detect_language, lemmas and
word_forms (of a word in a language), and the tables tokens and search (the matches of a phrase)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from inflecta.functions.kernel import Kernel, is_garbage, tokens


def register(spark: SparkSession, kernel: Kernel) -> None:
    """Registers the functions, in Arrow batches; null arguments count as empty texts, as a missing one does.

    The kernel is shipped to the workers once, as a broadcast of a dictionary of bounded size (see Kernel.from_lexicon).
    """
    shared = spark.sparkContext.broadcast(kernel)

    def two(name: str, kind: str) -> None:
        @F.pandas_udf(kind)
        def f(docs: pd.Series, others: pd.Series) -> pd.Series:
            call = getattr(shared.value, "search" if name == "phrase_search" else name)
            return pd.Series([call(a or "", b or "") for a, b in zip(docs, others, strict=True)])

        spark.udf.register(name, f)

    for name, kind in (("str_intersect_str", "double"), ("str_intersect_str2", "double"), ("str_case_str", "int"), ("phrase_search", "string")):
        two(name, kind)

    @F.pandas_udf("string")
    def normalize_phrase(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.normalize_phrase(t or "") for t in texts], dtype=object)

    spark.udf.register("normalize_phrase", normalize_phrase)

    @F.pandas_udf("string")
    def detect_language(words: pd.Series) -> pd.Series:
        return pd.Series([shared.value.detect_language(w or "") for w in words], dtype=object)

    spark.udf.register("detect_language", detect_language)

    def of_a_word(name: str, lemmas_only: bool) -> None:
        @F.pandas_udf("array<string>")
        def f(words: pd.Series, langs: pd.Series) -> pd.Series:
            known = shared.value.languages
            return pd.Series([known[g].words(w, lemmas_only) if g in known and w and not is_garbage(w) else [] for w, g in zip(words, langs, strict=True)], dtype=object)

        spark.udf.register(name, f)

    of_a_word("lemmas", True)
    of_a_word("word_forms", False)

    @F.udtf(returnType="match string")
    class Search:
        def eval(self, doc: str, phrase: str):
            yield from ((m,) for m in shared.value.search(doc or "", phrase or "").splitlines())

    spark.udtf.register("search", Search.asDeterministic())

    @F.udtf(returnType="pos int, token string")
    class Tokens:
        def eval(self, text: str):
            yield from enumerate(tokens((text or "").lower()))

    spark.udtf.register("tokens", Tokens.asDeterministic())
