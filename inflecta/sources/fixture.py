"""A small original lexicon for tests and for the queries that are checked against SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from inflecta.sources.lexicon import Lexicon, from_rows

#: Flexions of each English model, lemma form first; (prefix, flexion) where a form has a prefix of its own.
EN_MODELS = [["", "s"], ["", "s", "ed", "ing"], ["y", "ies"], ["", "er", "est"], ["ee", "ees", "aw"], ["", "ly", ("un", "")]]
EN_LEMMAS = [("cat", 0), ("walk", 0), ("saw", 0), ("walk", 1), ("talk", 1), ("cit", 2), ("cold", 3), ("s", 4)]
#: Stems that the test corpus attests.
EN_CORPUS_LEMMAS = [("that", 0), ("that", 3), ("orre", 1), ("tion", 1), ("ther", 3), ("thon", 1), ("than", 3), ("thre", 0), ("ened", 5), ("ting", 1)]
EN_PREFIXES = ["re", "un"]
EN_CORPUS_PREFIXES = ["in", "on"]
RU_MODELS = [["я", "и", "ю"], ["", "а", "у"], ["йти", "шел", "шла"], ["а", "и", "ой"]]
RU_LEMMAS = [("земл", 0), ("мастер", 1), ("сосед", 1), ("за", 2), ("книг", 3)]
#: A second language of the test corpus.
DE_MODELS = [["", "en", "t"], ["ung", "ungen"], ["", "e", "er", "es"]]
DE_LEMMAS = [("mach", 0), ("schau", 0), ("einh", 1), ("erz", 1), ("lich", 2), ("keit", 0), ("isch", 2), ("schön", 2)]
#: A grammar file: a comment by its first and one by its second character, a repeated ancode, a field too many.
GRAMMAR_TAB = "// parts of speech\r\naa 1 ADJECTIVE\r\n\r\nna 1 NOUN sg,narr\r\n//gone 1 VERB\r\nx/ 1 VERB\r\nna 2 VERB inf\r\nxx 1 NOUN prop sg pl\r\nvb 1 VERB past,,sg\r\n"
EN_ANCODES = [("aa", "ADJECTIVE", []), ("na", "NOUN", ["sg"]), ("nb", "NOUN", ["pl"]), ("va", "VERB", ["inf"]), ("vb", "VERB", ["past", "sg"])]


def rows(lang: str, lang_ord: int, models: list, lemmas: list) -> tuple[list[tuple], list[tuple]]:
    """Rows of flex and lemmas; the forms of a model take the ancodes in turn."""
    flex = []
    for model_no, forms in enumerate(models):
        for form_no, form in enumerate(forms):
            prefix, flexion = form if isinstance(form, tuple) else ("", form)
            flex.append((lang, model_no, form_no, flexion, EN_ANCODES[(model_no + form_no) % len(EN_ANCODES)][0] if lang == "en" else None, prefix))
    return flex, [(lang, lang_ord, base, model_no, 0, None, 0 if lang == "en" else -1) for base, model_no in lemmas]


def lexicon(spark: SparkSession, languages: tuple[str, ...] = ("en",), corpus: bool = True) -> Lexicon:
    """The languages in order of precedence; with or without the stems of the test corpus."""
    flex, lemmas, prefixes, grammar = [], [], [], []
    for lang_ord, lang in enumerate(languages):
        models, stems = (EN_MODELS, EN_LEMMAS + (EN_CORPUS_LEMMAS if corpus else [])) if lang == "en" else (DE_MODELS, DE_LEMMAS) if lang == "de" else (RU_MODELS, RU_LEMMAS)
        more = rows(lang, lang_ord, models, stems)
        flex += more[0]
        lemmas += more[1]
        if lang == "en":
            prefixes += [(lang, 0, p) for p in sorted(EN_PREFIXES + (EN_CORPUS_PREFIXES if corpus else []))]
            grammar += [(lang, *g) for g in EN_ANCODES]
    return from_rows(spark, [(lang, i) for i, lang in enumerate(languages)], flex, lemmas, prefixes, grammar)
