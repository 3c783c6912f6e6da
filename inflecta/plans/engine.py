"""The engine: one lexicon and the operators on it, as methods over DataFrames.

Words are analysed once per distinct word and joined back per distinct (document, word); postings meet phrases by key.
Tables of the lexicon are broadcast if they have few rows; nothing that grows with a corpus is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inflecta.functions import text as T
from inflecta.operators import analyze, forms, language, search
from inflecta.sources import lexicon as source
from inflecta.sources.lexicon import Lexicon
from inflecta.sources.shared import by_sort, generation, meet, parts_of, spread, written


_WORDS = "array<struct<pos:int,surface:string,lang:string,keys:array<string>>>"


@dataclass
class DocIndex:
    """Indexed documents: sizes (id, byte_len), words (id, words), postings (id, pos, surface, key), lexemes (id, surface, key)."""

    sizes: DataFrame
    words: DataFrame
    postings: DataFrame
    lexemes: DataFrame
    parts: int
    #: (id, pos, surface), (id, surface) and (surface, key) of keys besides the surface, where keys don't depend on the text
    each: DataFrame | None = None
    once: DataFrame | None = None
    more: DataFrame | None = None

    def write(self, path: str) -> None:
        """The index as Parquet; postings come from the words again."""
        self.words.join(self.sizes, "id").write.mode("overwrite").parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> DocIndex:
        rows = spark.read.parquet(path)
        return DocIndex(rows.select("id", "byte_len"), rows.select("id", "words"), search.postings(rows.select("id", "words")), search.lexemes(rows.select("id", "words")), parts_of(rows))


class MorphEngine:
    """Morphology-aware comparison of texts; without a lexicon every word is its own only key."""

    def __init__(self, spark: SparkSession, lexicon: Lexicon | None = None):
        self.spark, self.lexicon = spark, lexicon
        self._given: dict[str, DataFrame] = {}
        self._kept: dict[str, tuple[int, DataFrame]] = {}
        # a lexicon has a handful of languages and prefixes: dimensions, not data
        self.languages = [r["lang"] for r in lexicon.languages.orderBy("lang_ord").collect()] if lexicon else []

    @classmethod
    def from_path(cls, spark: SparkSession, root: str) -> MorphEngine:
        """From a folder of dictionaries; raises if it isn't there."""
        return cls(spark, source.load_dictionaries(spark, root))

    @classmethod
    def from_lexicon(cls, spark: SparkSession, lexicon: Lexicon) -> MorphEngine:
        return cls(spark, lexicon)

    @classmethod
    def identity(cls, spark: SparkSession) -> MorphEngine:
        return cls(spark)

    def build(self, path: str) -> None:
        """Writes the lexicon with its derived tables, so that engines from_tables need not derive them again."""
        self.lexicon.write(path)
        for name in ("forms", "suffixes", "guesses"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def from_tables(cls, spark: SparkSession, path: str) -> MorphEngine:
        """From what build has written."""
        out = cls(spark, source.read_tables(spark, path))
        for name in ("forms", "suffixes", "guesses"):
            out._given[name] = spark.read.parquet(f"{path}/{name}")
        return out

    def close(self) -> None:
        """Forgets the derived tables, which stay in the shared folder until its tables are deleted."""
        self.__dict__.pop("prefixes", None)
        self._kept.clear()

    def _table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table of the lexicon, written down once: by its files alone it is known to be small."""
        if name in self._given:
            return self._given[name]
        if name not in self._kept or self._kept[name][0] != generation():
            self._kept[name] = (generation(), written(make(), name))
        return self._kept[name][1]

    @property
    def main_language(self) -> str | None:
        return self.languages[0] if self.languages else None

    @property
    def forms(self) -> DataFrame:
        return self._table("forms", lambda: forms.distinct_forms(forms.generate_forms(self.lexicon)))

    @property
    def suffixes(self) -> DataFrame:
        return self._table("suffixes", lambda: forms.suffix_index(self.forms))

    @property
    def guesses(self) -> DataFrame:
        return self._table("guesses", lambda: forms.guess_index(self.forms))

    @property
    def flex(self) -> DataFrame:
        return self._table("flex", lambda: self.lexicon.flex)

    @property
    def language_order(self) -> DataFrame:
        return self._table("languages", lambda: self.lexicon.languages)

    @cached_property
    def prefixes(self) -> dict[str, list[str]]:
        found: dict[str, list[str]] = {}
        for r in self.lexicon.prefixes.select("lang", "prefix").distinct().collect():
            found.setdefault(r["lang"], []).append(r["prefix"])
        return found

    # --- words: DataFrames with a column `token` of distinct words ---

    def known_suffix(self, words: DataFrame) -> DataFrame:
        return analyze.known_suffix(words.where(~T.is_garbage("token")), self.suffixes)

    def candidates(self, words: DataFrame) -> DataFrame:
        return analyze.candidates(words, self.forms, self.guesses, self.known_suffix(words), self.prefixes)

    def lemmas(self, words: DataFrame) -> DataFrame:
        """(token, lang, word, frequency, ancode, rank)."""
        return analyze.ranked_words(self.candidates(words), self.flex, True)

    def word_forms(self, words: DataFrame, distinct_ancodes: bool = False) -> DataFrame:
        """All forms of the words that each may be: (token, lang, word, frequency, ancode, rank)."""
        return analyze.ranked_words(self.candidates(words), self.flex, False, distinct_ancodes)

    def contextual_forms(self, asked: DataFrame) -> DataFrame:
        """asked (token, suggested language or null) to (token, suggested, detected, word, frequency, ancode, rank)."""
        asked = written(asked, "asked")
        vocabulary = written(asked.select("token").distinct(), "vocabulary")
        return language.word_forms(asked, written(self.word_forms(vocabulary), "word-forms"), self.detect_language(vocabulary), self.main_language)

    def detect_language(self, words: DataFrame) -> DataFrame:
        return language.detect(words, self.known_suffix(words), self.language_order)

    def analysis(self, words: DataFrame) -> DataFrame:
        """(token, detected, langs): of each word that isn't garbage, its language and its lemmas in each."""
        lists = analyze.lemma_lists(self.candidates(words), self.flex)
        by_word = lists.groupBy("token").agg(F.collect_list(F.struct("lang", "lemmas")).alias("langs"))
        out = by_sort(self.detect_language(words.where(~T.is_garbage("token"))), by_word, "token", "left")
        return out.select("token", "detected", F.coalesce("langs", F.expr("cast(array() as array<struct<lang:string,lemmas:array<string>>>)")).alias("langs"))

    def lemma_keys(self, each: DataFrame) -> DataFrame:
        """(token, more): the keys that words (column `token`, in any number) have besides themselves, in one language.

        Distinct words are written down before they are analysed, so that texts are read once for them; and the keys are,
        so that the join of texts to them is one of plain tables, which Spark can broadcast by size or split at hot words.
        """
        vocabulary = written(each.select("token").distinct(), "vocabulary")
        listed = self.lemmas(vocabulary).where("word <> token").groupBy("token").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("w"))
        return written(listed.select("token", F.transform("w", lambda x: x["word"]).alias("more")), "lemma-keys")

    def describe(self, texts: DataFrame) -> DataFrame:
        """texts (id, tokens, state) to (id, words): surface and keys of every word, in order; state: the first language."""
        if not self.languages:
            words = F.transform("tokens", lambda w, i: F.struct(i.cast("int").alias("pos"), w.alias("surface"), F.lit(None).cast("string").alias("lang"), F.array(w).alias("keys")))
            return texts.select("id", F.coalesce(words, F.expr(f"cast(array() as {_WORDS})")).alias("words"))
        if len(self.languages) > 1:
            vocabulary = texts.select(F.explode_outer(F.array_distinct("tokens")).alias("token")).where("token is not null")
            facts = written(self.analysis(written(vocabulary.distinct(), "vocabulary")), "facts")
            return language.routed(texts, facts, self.languages)
        return self._joined_words(texts, self.lemma_keys(texts.select(F.explode_outer("tokens").alias("token")).where("token is not null")))

    def _joined_words(self, texts: DataFrame, listed: DataFrame) -> DataFrame:
        """With one language every word is analysed in it, and no order matters: words meet their keys in a join."""
        each = texts.select("id", F.posexplode_outer("tokens").alias("pos", "token")).where("token is not null")
        lang = F.when(~T.is_garbage("token"), F.lit(self.main_language))
        word = F.struct("pos", F.col("token").alias("surface"), lang.alias("lang"), F.concat(F.coalesce("more", F.expr("cast(array() as array<string>)")), F.array("token")).alias("keys"))
        words = meet(each, listed, "token", "left").groupBy("id").agg(F.array_sort(F.collect_list(word)).alias("words"))
        return by_sort(texts.select("id"), words, "id", "left").select("id", F.coalesce("words", F.expr(f"cast(array() as {_WORDS})")).alias("words"))

    # --- documents and phrases ---

    def index(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalize: bool = True) -> DocIndex:
        """Indexes documents of distinct ids. normalize=False takes words as they are written."""
        rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")))
        texts = rows.select("id", T.tokens("t", normalize).alias("tokens"), F.lit(None).cast("string").alias("state"))
        sizes = rows.select("id", F.coalesce(T.byte_length("t"), F.lit(0).cast("long")).alias("byte_len"))
        if len(self.languages) > 1:
            words = self.describe(texts)
            return DocIndex(sizes, words, search.postings(words), search.lexemes(words), parts_of(rows))
        # outer, as Spark would else find the words of each text a second time, to see whether there are any
        each = texts.select("id", F.posexplode_outer("tokens").alias("pos", "surface")).where("surface is not null")
        once = texts.select("id", F.explode_outer(F.array_distinct("tokens")).alias("surface")).where("surface is not null")
        if not self.languages:
            return DocIndex(sizes, self.describe(texts), each.withColumn("key", F.col("surface")), once.withColumn("key", F.col("surface")), parts_of(rows), each, once)
        listed = self.lemma_keys(once.select(F.col("surface").alias("token")))
        every = F.concat(F.array("surface"), F.coalesce("more", F.array().cast("array<string>")))
        keyed = lambda rows: meet(rows, listed.withColumnRenamed("token", "surface"), "surface", "left").select(*rows.columns, F.explode(every).alias("key"))
        return DocIndex(sizes, self._joined_words(texts, listed), keyed(each), keyed(once), parts_of(rows), each, once, listed.select(F.col("token").alias("surface"), F.explode("more").alias("key")))

    def phrase_lines(self, pieces: DataFrame) -> DataFrame:
        """pieces (phrase_id, piece_no, text) to described lines (phrase_id, piece_no, line_no, exact, words).

        A piece is several lines; each is `[lang|][!]text`. Distinct lines are described once.
        """
        each = pieces.select("phrase_id", "piece_no", F.posexplode(T.phrase_lines("text")).alias("line_no", "line"))
        parsed = each.select("line").distinct().withColumn("p", T.parse_phrase("line"))
        lines = parsed.select(F.col("line").alias("id"), T.tokens("p.text", False).alias("tokens"), language.by_name(self.languages, F.col("p.lang")).alias("state"))
        described = self.describe(lines.withColumn("tokens", F.coalesce("tokens", F.expr("cast(array() as array<string>)")))).withColumnRenamed("id", "line")
        return each.join(described, "line").select("phrase_id", "piece_no", "line_no", T.parse_phrase("line")["exact"].alias("exact"), "words")

    def _pieces(self, phrases: DataFrame, id_col: str, text_col: str, normalize: bool, by_space: bool) -> DataFrame:
        text = T.normalize(text_col) if normalize else F.col(text_col)
        rows = phrases.select(F.col(id_col).alias("phrase_id"), text.alias("text"))
        if not by_space:
            return rows.select("phrase_id", F.lit(0).alias("piece_no"), "text")
        return rows.select("phrase_id", F.posexplode(F.split("text", " ", -1)).alias("piece_no", "text")).where("text <> ''")

    def matches(self, index: DocIndex, phrases: DataFrame, id_col: str = "phrase_id", text_col: str = "phrase", normalize: bool = True, by_space: bool = False, same_id: bool = False) -> DataFrame:
        """(id, phrase_id, piece_no, surface): see operators.search.matches."""
        asked = search.probes(self.phrase_lines(self._pieces(phrases, id_col, text_col, normalize, by_space)))
        return self._matched(index, asked, same_id)

    def _matched(self, index: DocIndex, asked: DataFrame, same_id: bool = False) -> DataFrame:
        """Matches of probes. Where keys don't depend on the text, probes look their surfaces up, and texts need no keys."""
        asked = written(asked, "probes")
        if index.each is None:
            return search.matches(index.postings, index.lexemes, asked, index.parts, same_id)
        asked = written(search.by_surface(asked, index.more), "probes")
        return search.matches(index.each, index.once, asked, index.parts, same_id)

    def search(self, index: DocIndex, phrases: DataFrame, **options) -> DataFrame:
        """(id, phrase_id, result) of the pairs that match; every other pair's result is the empty text."""
        return search.joined_matches(self.matches(index, phrases, **options))

    def contains(self, index: DocIndex, phrases: DataFrame, pairs: DataFrame | None = None, compat: bool = False, **options) -> DataFrame:
        """(id, phrase_id, contained): 1 for pairs that match; with pairs (id, phrase_id) also 0 for those that don't.

        compat: 1 for every one of pairs, as the original function answers whatever it is asked.
        """
        if compat and pairs is not None:
            return pairs.select("id", "phrase_id", F.lit(1).alias("contained"))
        found = self.matches(index, phrases, **options).select("id", "phrase_id").distinct().withColumn("contained", F.lit(1))
        return found if pairs is None else by_sort(pairs.repartition(index.parts, "id"), found, ["id", "phrase_id"], "left").fillna(0, ["contained"])

    def intersect(self, index: DocIndex, searches: DataFrame, id_col: str = "search_id", text_col: str = "search", guard: bool = True, normalize_search: bool = True, pairs: DataFrame | None = None, same_id: bool = False) -> DataFrame:
        """(id, phrase_id, score): the share of a document that the words of a search text cover.

        Without pairs (id, phrase_id), only those with a match are returned; every other scores 0 (1 if the document is
        empty). Each blank-separated piece of the search counts for itself, repeated pieces again.
        """
        if same_id:
            found = search.covered_bytes(self.matches(index, searches, id_col, text_col, normalize_search, True, True))
        else:
            pieces = written(self._pieces(searches, id_col, text_col, normalize_search, True).groupBy("phrase_id", "text").agg(F.count("*").alias("times")), "pieces")
            texts = pieces.select(F.col("text").alias("phrase_id"), F.lit(0).alias("piece_no"), "text").distinct()
            per_text = search.covered_bytes(self._matched(index, search.probes(self.phrase_lines(texts))))
            found = search.covered_by_pieces(per_text, pieces)
        if pairs is not None:
            found = by_sort(pairs.repartition(index.parts, "id"), found, ["id", "phrase_id"], "left")
        sized = meet(by_sort(found, index.sizes.repartition(index.parts, "id"), "id"), searches.select(F.col(id_col).alias("phrase_id"), F.coalesce(T.byte_length(text_col), F.lit(0).cast("long")).alias("search_len")), "phrase_id")
        return sized.select("id", "phrase_id", search.score(F.col("covered"), F.col("byte_len"), F.col("search_len"), guard).alias("score"))

    def intersect_pairs(self, rows: DataFrame, id_col: str, doc_col: str, search_col: str, guard: bool = True) -> DataFrame:
        """(id, score) of rows that each hold a document and a search text."""
        pairs = rows.select(F.col(id_col).alias("id"), F.col(id_col).alias("phrase_id"))
        return self.intersect(self.index(rows, id_col, doc_col), rows, id_col, search_col, guard, True, pairs, True).select("id", "score")

    def contains_pairs(self, rows: DataFrame, id_col: str, doc_col: str, phrase_col: str) -> DataFrame:
        """(id, contained) of rows that each hold a document and a phrase."""
        pairs = rows.select(F.col(id_col).alias("id"), F.col(id_col).alias("phrase_id"))
        return self.contains(self.index(rows, id_col, doc_col), rows, pairs, id_col=id_col, text_col=phrase_col, same_id=True).select("id", "contained")

    def normalize_phrase(self, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, normalized): the first key of every word, a blank behind each.

        A key is left out if it would take the result, blank included, to twice the text's bytes or more; so a text of one
        byte gives the empty text.
        """
        index = self.index(rows, id_col, text_col)
        first = F.transform("words", lambda w: F.concat(w["keys"][0], F.lit(" ")))
        room = 2 * F.col("byte_len")
        whole = F.array_join(first, "")
        fitted = F.aggregate(first, F.lit(""), lambda out, k: F.when(F.octet_length(out) + F.octet_length(k) < room, F.concat(out, k)).otherwise(out))
        return index.words.join(index.sizes, "id").select("id", F.when(F.octet_length(whole) < room, whole).otherwise(fitted).alias("normalized"))
