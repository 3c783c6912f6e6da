"""Dictionaries: text files of paradigms, lemmas and grammar, as DataFrames.

A dictionary root holds one folder per language, named by digits (the order of precedence) and letters (the language).
A folder holds `gramtab.tab` (grammar) and `morphs.mrd` (flexion models, accents, sessions, prefix sets, lemmas, each behind
a line with their count). Files are read by Spark, so a root may lie in any store that Spark knows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "languages": "lang string, lang_ord int",
    "grammar": "lang string, ancode string, pos string, grammemes array<string>",
    "flex": "lang string, model_no int, form_no int, flexion string, ancode string, prefix string",
    "prefixes": "lang string, set_no int, prefix string",
    "lemmas": "lang string, lang_ord int, base string, model_no int, accent_no int, ancode string, prefix_set int",
}
FOLDER = re.compile(r"^[0-9]*([A-Za-z]+)$")


@dataclass
class Lexicon:
    """The tables of one or more dictionaries; their columns are in SCHEMAS."""

    languages: DataFrame
    grammar: DataFrame
    flex: DataFrame
    prefixes: DataFrame
    lemmas: DataFrame

    def write(self, path: str) -> None:
        """As Parquet, one folder a table."""
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")


def read_tables(spark: SparkSession, path: str) -> Lexicon:
    """What Lexicon.write has written."""
    return Lexicon(**{name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()})


def folder_language(name: str) -> str | None:
    """Language of a folder name (`01ru`: ru); null if it isn't digits and letters. Digits alone name the language ''."""
    m = FOLDER.match(name)
    return m[1] if m else "" if name.isdigit() else None


def parse_grammar(text: DataFrame, lang: str) -> DataFrame:
    """Rows of grammar from a file as one value: lines `ancode code POS [grammemes]`; the first line of an ancode counts.

    Empty lines and lines whose first or second character is `/` are skipped; only the fourth field gives grammemes.
    """
    lines = text.select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    lines = lines.select("line_no", F.btrim("line", F.lit(" \t\r\n")).alias("line"))
    lines = lines.where((F.col("line") != "") & (F.substring("line", 1, 1) != "/") & (F.substring("line", 2, 1) != "/"))
    part = F.filter(F.split("line", " +"), lambda p: p != "")
    grammemes = F.filter(F.split(F.coalesce(F.try_element_at("part", F.lit(4)), F.lit("")), ","), lambda g: g != "")
    rows = lines.withColumn("part", part).select("line_no", F.try_element_at("part", F.lit(1)).alias("ancode"), F.try_element_at("part", F.lit(3)).alias("pos"), grammemes.alias("grammemes"))
    first = rows.groupBy("ancode").agg(F.min_by("pos", "line_no").alias("pos"), F.min_by("grammemes", "line_no").alias("grammemes"))
    return first.select(F.lit(lang).alias("lang"), "ancode", "pos", "grammemes")


def parse_mrd(text: DataFrame, lang: str, lang_ord: int) -> dict[str, DataFrame]:
    """Rows of flex, prefixes and lemmas of a `morphs.mrd` file as one value.

    Five sections stand behind lines with their counts; a file that ends early has empty sections. A lemma line without a
    number of its model, or of fewer than two fields, is left out, as is a prefix set that isn't a number.
    """
    whole = text.select(F.transform(F.split("value", "\n"), lambda x: F.btrim(x, F.lit(" \t\r\n"))).alias("lines"), F.lit(0).alias("s0"))
    for i in range(5):
        count = F.coalesce(F.try_element_at("lines", F.col(f"s{i}") + 1).try_cast("int"), F.lit(0))
        whole = whole.withColumn(f"s{i + 1}", F.col(f"s{i}") + 1 + F.greatest(count, F.lit(0)))

    def section(i: int) -> DataFrame:
        each = whole.select(F.posexplode(F.slice("lines", F.col(f"s{i}") + 2, F.col(f"s{i + 1}") - F.col(f"s{i}") - 1)).alias("no", "line"))
        return each.repartition("no")  # a file is one row

    filled = lambda part: F.filter(part, lambda x: x != "")
    names = lambda table: [x.split()[0] for x in SCHEMAS[table].split(", ")]
    forms = section(0).select("no", F.posexplode(filled(F.split(F.btrim(F.substring_index("line", "q//q", 1)), "%"))).alias("form_no", "form")).withColumn("part", F.split("form", "\\*"))
    flex = forms.select(F.lit(lang), "no", "form_no", F.lower(F.col("part")[0]), F.try_element_at("part", F.lit(2)), F.lower(F.coalesce(F.try_element_at("part", F.lit(3)), F.lit("")))).toDF(*names("flex"))
    prefixes = section(3).select(F.lit(lang), "no", F.explode(filled(F.split(F.lower("line"), "[, ]+")))).toDF(*names("prefixes"))
    part = section(4).select(filled(F.split("line", "[ \t]+")).alias("part"))
    at = lambda i: F.try_element_at("part", F.lit(i + 1))
    number = lambda i: at(i).try_cast("int")
    told = lambda i: F.when(at(i) != "-", at(i))
    base = F.when(at(0) == "#", "").otherwise(F.lower(at(0)))
    lemmas = part.select(F.lit(lang), F.lit(lang_ord), base, number(1), number(2), told(4), F.when(told(5).isNull(), -1).otherwise(number(5))).toDF(*names("lemmas"))
    return {"flex": flex, "prefixes": prefixes, "lemmas": lemmas.where("model_no is not null and prefix_set is not null")}


def from_rows(spark: SparkSession, languages: list[tuple], flex: list[tuple], lemmas: list[tuple], prefixes: list[tuple] = (), grammar: list[tuple] = ()) -> Lexicon:
    """A lexicon of rows as in SCHEMAS."""
    rows = {"languages": languages, "grammar": grammar, "flex": flex, "prefixes": prefixes, "lemmas": lemmas}
    return Lexicon(**{name: spark.createDataFrame(list(rows[name]), schema) for name, schema in SCHEMAS.items()})


def _listed(spark: SparkSession, root: str, folders: bool) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() == folders)


def list_folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders in root, sorted: their order is the languages' precedence."""
    return _listed(spark, root, True)


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder, sorted."""
    return _listed(spark, folder, False)


def load_dictionaries(spark: SparkSession, root: str, skipped: list[str] | None = None) -> Lexicon:
    """All dictionaries of a root. One that lacks a file is skipped (and named in `skipped`); a missing root raises."""
    languages, found = [], {"grammar": [], "flex": [], "prefixes": [], "lemmas": []}
    for name in list_folders(spark, root):
        lang = folder_language(name)
        if lang is None:
            continue
        if not {"morphs.mrd", "gramtab.tab"} <= set(list_files(spark, f"{root}/{name}")):
            if skipped is not None:
                skipped.append(name)
            continue
        tables = parse_mrd(spark.read.text(f"{root}/{name}/morphs.mrd", wholetext=True), lang, len(languages))
        tables["grammar"] = parse_grammar(spark.read.text(f"{root}/{name}/gramtab.tab", wholetext=True), lang)
        languages.append((lang, len(languages)))
        for table, more in tables.items():
            found[table].append(more)
    out = from_rows(spark, languages, [], [])
    for table, parts in found.items():
        for more in parts:
            setattr(out, table, getattr(out, table).union(more))
    return out


def write_mrd(flex: list[tuple], prefixes: list[tuple], lemmas: list[tuple]) -> str:
    """The text of a `morphs.mrd` file with these rows of one language."""
    models: dict[int, list[str]] = {}
    for _, model_no, _, flexion, ancode, prefix in sorted(flex, key=lambda r: (r[1], r[2])):
        models.setdefault(model_no, []).append("*".join([flexion.upper(), ancode or "aa", *([prefix.upper()] if prefix else [])]))
    sets: dict[int, list[str]] = {}
    for _, set_no, prefix in prefixes:
        sets.setdefault(set_no, []).append(prefix.upper())
    body = [[f"%{'%'.join(models.get(i, []))}" for i in range(max(models, default=-1) + 1)], [], [], [",".join(sets.get(i, [])) for i in range(max(sets, default=-1) + 1)]]
    body.append([f"{base.upper() or '#'} {model_no} {accent if accent is not None else 0} 0 {ancode or '-'} {prefix_set if prefix_set >= 0 else '-'}" for _, _, base, model_no, accent, ancode, prefix_set in lemmas])
    return "".join(f"{len(part)}\r\n" + "".join(f"{x}\r\n" for x in part) for part in body)
