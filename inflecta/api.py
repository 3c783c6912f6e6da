"""Functions over plain strings, with one dictionary for the process."""

from __future__ import annotations

from pyspark.sql import SparkSession

from inflecta.functions.kernel import Kernel
from inflecta.sources.lexicon import load_dictionaries

_kernel: Kernel | None = None


def init(root: str | None = None, spark: SparkSession | None = None) -> int:
    """Loads the dictionaries of a folder (none: every word is its own lemma); 1 when done. A missing folder raises."""
    global _kernel
    _kernel = Kernel() if root is None else Kernel.from_lexicon(load_dictionaries(spark or SparkSession.builder.getOrCreate(), root))
    return 1


def destroy() -> None:
    """Forgets the dictionaries."""
    global _kernel
    _kernel = None


def _loaded() -> Kernel:
    if _kernel is None:
        raise RuntimeError("call init() first")
    return _kernel


def normalize_phrase(text: str = "") -> str:
    return _loaded().normalize_phrase(text)


def str_intersect_str(doc: str | None = None, search: str | None = None) -> float:
    """The share of doc that search covers, 0 if search is the longer one or an argument is missing."""
    return 0.0 if doc is None or search is None else _loaded().str_intersect_str(doc, search)


def str_intersect_str2(doc: str | None = None, search: str | None = None) -> float:
    return 0.0 if doc is None or search is None else _loaded().str_intersect_str2(doc, search)


def str_case_str(doc: str | None = None, phrase: str | None = None) -> int:
    """1 if the phrase occurs in doc, whatever its inflection; else 0."""
    return 0 if doc is None or phrase is None else _loaded().str_case_str(doc, phrase)
