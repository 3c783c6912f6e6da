"""Line dedup by overlapping windows of three lines, in DataFrame functions only.

Every three consecutive lines of a text are hashed (two 64-bit hashes). Of the places where a window occurs, by doc_id
and position, the first stays; the lines of all later ones are removed, positions covered by several windows once. Only
(document, position, hashes) is shuffled to find repeats; a window's places are pre-aggregated to its first, and the join
back to them is an ordinary equi-join whose hot keys Spark can split. Texts are shuffled once, to their removed positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inflecta.llm._common import row_key, written

LINES = 3


def _compared(documents: DataFrame) -> tuple[DataFrame, list[str]]:
    """All columns, renamed c0, c1 ..., with new_text, n_lines and n_removed; and the columns' names."""
    names = documents.columns
    rows = documents.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}")
    rows = rows.withColumn("row", row_key(doc_id, text))
    lines, at = F.split(text, "\n", -1), F.col("lines")
    window = lambda i: F.struct(F.xxhash64(at[i], at[i + 1], at[i + 2]).alias("h"), F.xxhash64(at[i + 2], F.lit(1), at[i], at[i + 1]).alias("g"), (F.length(F.trim(F.concat(at[i], at[i + 1], at[i + 2]))) == 0).alias("blank"))
    places = (
        rows.select(doc_id.alias("d"), F.col("row").alias("k"), lines.alias("lines"))
        .where(F.size("lines") >= LINES)
        .select("d", "k", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("lines") - LINES), window)).alias("p", "w"))
        .where("not w.blank")
        .select("w.h", "w.g", "d", "k", "p")
    )
    # written down, so that the join back is one of plain tables, whose hot windows Spark can split
    first = written(places.groupBy("h", "g").agg(F.min(F.struct("d", "k", "p")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "g", "first"), "line-windows")
    later = places.join(first, ["h", "g"]).where(F.struct("d", "k", "p") > F.col("first"))
    removed = later.groupBy("d", "k").agg(F.collect_set("p").alias("gone"))
    joined = rows.join(removed, doc_id.eqNullSafe(F.col("d")) & (F.col("row") == F.col("k")), "left")
    covered = F.flatten(F.transform("gone", lambda p: F.sequence(p, p + (LINES - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    joined = joined.withColumn("kept", F.when(F.col("gone").isNotNull(), kept)).withColumn("lines", lines)
    new_text = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform("kept", lambda i: at[i]), "\n"))
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size("lines"))
    n_removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("kept"))
    return joined.withColumns({"new_text": new_text, "n_lines": n_lines.cast("long"), "n_removed": n_removed.cast("long")}), names


def deduplicated(documents: DataFrame) -> DataFrame:
    """All columns with text deduplicated, and n_lines and n_removed.

    Lines are parted by \\n and compared as they are. Texts of fewer than three lines, and windows of blank lines only,
    stay as they are; a null text stays null (0 lines); a text whose lines all go becomes empty. Rows with the same id and
    text are one document and keep the same lines; rows with the same id and other texts go by a hash of the text; null
    ids come first. An empty table gives an empty one. The columns n_lines and n_removed are replaced if the table has them.
    """
    joined, names = _compared(documents)
    kept = [i for i, c in enumerate(names) if c not in ("n_lines", "n_removed")]
    columns = [F.col("new_text" if names[i] == "text" else f"c{i}").alias(names[i]) for i in kept]
    return joined.select(*columns, "n_lines", "n_removed")


def without_repeats(documents: DataFrame) -> DataFrame:
    """Just the columns of documents, with text deduplicated and n_chars, if there, anew where lines are gone."""
    joined, names = _compared(documents)
    count = lambda c: F.when(F.col("n_removed") > 0, F.length("new_text")).otherwise(F.col(c)).cast(documents.schema["n_chars"].dataType)
    return joined.select(*[F.col("new_text").alias(c) if c == "text" else count(f"c{i}").alias(c) if c == "n_chars" else F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def oracle_sql(source: str = "documents") -> str:
    """DuckDB SQL with the rows (doc_id, text, n_lines, n_removed) of deduplicated() over distinct ids."""
    return f"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM {source}),
w AS (SELECT doc_id, unnest(range(0, len(ls) - 2)) AS p, ls FROM l WHERE len(ls) >= 3),
v AS (SELECT doc_id, p, ls[p + 1] || chr(10) || ls[p + 2] || chr(10) || ls[p + 3] AS s FROM w
      WHERE length(trim(ls[p + 1] || ls[p + 2] || ls[p + 3])) > 0),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM v),
c AS (SELECT doc_id, list_distinct(flatten(list([p, p + 1, p + 2]))) AS cs FROM r WHERE n > 1 GROUP BY doc_id)
SELECT l.doc_id AS doc_id,
       CASE WHEN cs IS NULL THEN text
            ELSE coalesce(array_to_string(list_transform(list_filter(range(0, len(ls)), lambda i: NOT list_contains(cs, i)), lambda i: ls[i + 1]), chr(10)), '') END AS text,
       CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(cs), 0) AS BIGINT) AS n_removed
FROM l LEFT JOIN c USING (doc_id)"""
