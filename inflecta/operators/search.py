"""Positional phrase search over postings, and the scores made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inflecta.sources.shared import meet


def postings(words: DataFrame) -> DataFrame:
    """(id, pos, surface, key) of texts (id, words)."""
    each = words.select("id", F.explode("words").alias("w"))
    return each.select("id", F.col("w.pos").alias("pos"), F.col("w.surface").alias("surface"), F.explode("w.keys").alias("key"))


def lexemes(words: DataFrame) -> DataFrame:
    """(id, surface, key) of texts (id, words), each surface with the same keys once per text: found in the row, unshuffled."""
    kinds = F.array_distinct(F.transform("words", lambda w: F.struct(w["surface"].alias("surface"), w["keys"].alias("keys"))))
    each = words.select("id", F.explode(kinds).alias("w"))
    return each.select("id", F.col("w.surface").alias("surface"), F.explode("w.keys").alias("key"))


def probes(lines: DataFrame) -> DataFrame:
    """(phrase_id, piece_no, line_no, n, token_no, key) of described phrase lines (phrase_id, piece_no, line_no, exact, words).

    An exact line is looked up by its surfaces alone.
    """
    each = lines.where(F.size("words") > 0).select("phrase_id", "piece_no", "line_no", "exact", F.size("words").alias("n"), F.explode("words").alias("w"))
    keys = F.when(F.col("exact"), F.array("w.surface")).otherwise(F.col("w.keys"))
    return each.select("phrase_id", "piece_no", "line_no", "n", F.col("w.pos").alias("token_no"), F.explode(keys).alias("key"))


def by_surface(asked: DataFrame, more: DataFrame | None) -> DataFrame:
    """probes with the surface that meets them in place of the key: the key itself, or a word that has it by more (surface, key).

    Each surface meets a word of a line once, whichever of its keys they share.
    """
    own = asked.withColumnRenamed("key", "surface")
    if more is not None:
        own = own.unionByName(meet(more, asked, "key").select(own.columns))
    return own.distinct()


def matches(posts: DataFrame, once: DataFrame, asked: DataFrame, parts: int, same_id: bool = False) -> DataFrame:
    """(id, phrase_id, piece_no, surface): the distinct texts that the lines of a piece match in a document.

    A line matches consecutive words of which each shares a key with the line's word there; what is matched are the
    document's surfaces. asked is a written table. posts, once and asked meet by key, or by surface where the columns are
    surfaces. One-word lines need no positions: they meet the lexemes (`once`), so a frequent word costs one row
    a document. same_id: a phrase is only looked for in the document of its own id.

    What is found is dealt by document into `parts` (by the size of the texts), so that a task holds as much of a large corpus
    as of a small one. What follows groups by document as well: the matches move once.
    """
    by = "key" if "key" in asked.columns else "surface"
    on = [by, "id"] if same_id else [by]
    asked = asked.withColumn("id", F.col("phrase_id")) if same_id else asked
    single = meet(once, asked.where("n = 1").drop("n", "token_no", "line_no"), on).select("id", "phrase_id", "piece_no", "surface")
    if asked.where("n > 1").isEmpty():
        return single.repartition(parts, "id").distinct()
    hits = meet(posts, asked.where("n > 1"), on).select("id", "phrase_id", "piece_no", "line_no", "n", (F.col("pos") - F.col("token_no")).alias("start"), "token_no", "surface").repartition(parts, "id").distinct()
    whole = hits.groupBy("id", "phrase_id", "piece_no", "line_no", "n", "start").agg(F.array_sort(F.collect_list(F.struct("token_no", "surface"))).alias("w")).where(F.size("w") == F.col("n"))
    phrase = F.array_join(F.transform("w", lambda x: x["surface"]), " ")
    return single.union(whole.select("id", "phrase_id", "piece_no", phrase.alias("surface"))).repartition(parts, "id").distinct()


def joined_matches(found: DataFrame) -> DataFrame:
    """(id, phrase_id, result): each match, sorted, with a line end behind it; only pairs that match at all."""
    listed = found.select("id", "phrase_id", "surface").distinct().groupBy("id", "phrase_id").agg(F.array_sort(F.collect_list("surface")).alias("s"))
    return listed.select("id", "phrase_id", F.concat(F.array_join("s", "\n"), F.lit("\n")).alias("result"))


def covered_bytes(found: DataFrame) -> DataFrame:
    """(id, phrase_id, covered): bytes of the matches of each piece, each match counting one more."""
    return found.groupBy("id", "phrase_id").agg(F.sum(F.octet_length("surface") + 1).cast("long").alias("covered"))


def covered_by_pieces(per_text: DataFrame, pieces: DataFrame) -> DataFrame:
    """(id, phrase_id, covered) from what each distinct piece text covers (id, phrase_id: that text, covered).

    pieces: (phrase_id, text, times), written. A piece text is matched once, however many searches share it.
    """
    each = meet(per_text.withColumnRenamed("phrase_id", "text"), pieces, "text")
    return each.groupBy("id", "phrase_id").agg(F.sum(F.col("covered") * F.col("times")).alias("covered"))


def score(covered: Column, doc_bytes: Column, search_bytes: Column, guard: bool) -> Column:
    """covered / doc_bytes, at most 1; an empty document scores 1. guard: 0 if the search is longer than the document."""
    covered = F.coalesce(covered, F.lit(0))
    share = F.when(covered >= doc_bytes, F.lit(1.0)).otherwise(covered / doc_bytes)
    return F.when(search_bytes > doc_bytes, F.lit(0.0)).otherwise(share) if guard else share
