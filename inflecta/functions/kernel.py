"""The engine's semantics for one pair of texts in plain Python: for SQL functions and calls outside of queries.

It holds a dictionary's forms in memory, so it suits dictionaries, not corpora: whole tables go through the engine, which
analyses each distinct word once. Building it from more than `limit` forms is refused.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import regex as re

TOKEN = re.compile(r"[\p{Alphabetic}\p{Nd}]+(?:[-'`_][\p{Alphabetic}\p{Nd}]+)*")
GARBAGE = re.compile(r"[^\p{Alphabetic}'`-]")
LEAST_SUFFIX, LEAST_BASE = 4, 3
FORMS = 5_000_000


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text)


def is_garbage(word: str) -> bool:
    return GARBAGE.search(word) is not None


def base36(n: int) -> str:
    digits = ""
    while n:
        n, d = divmod(n, 36)
        digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[d] + digits
    return digits or "0"


class Dictionary:
    """Forms of one language by word, and by ending the first of each model in the order of reversed forms."""

    def __init__(self, flex: list[tuple[int, int, str, str]], lemmas: list[tuple[str, int]], prefixes: list[str]):
        """flex: (model_no, form_no, prefix, flexion); lemmas: (base, model_no)."""
        self.models: dict[int, list[tuple[str, str]]] = defaultdict(list)
        for model_no, _, prefix, flexion in sorted(flex):
            self.models[model_no].append((prefix or "", flexion or ""))
        self.forms: dict[str, set[tuple[str, int, int, int]]] = defaultdict(set)
        for base, model_no in lemmas:
            for prefix, flexion in self.models.get(model_no, ()):
                code = base36(model_no << 16 | len(flexion) << 8 | len(base))
                self.forms[f"{prefix}{base}{flexion}"].add((code, model_no, len(flexion), len(base)))
        self.endings: dict[str, dict[int, tuple[bytes, int]]] = {}
        for form, codes in self.forms.items():
            for n in range(1, len(form) + 1):
                at = self.endings.setdefault(form[-n:], {})
                if n >= LEAST_SUFFIX:
                    for code, model_no, flex_len, _ in codes:
                        key = (f"{form[::-1]}|{code}".encode(), flex_len)
                        if model_no not in at or key < at[model_no]:
                            at[model_no] = key
        quoted = "|".join(re.escape(p) for p in sorted(set(prefixes)) if p)
        self.head = re.compile(f"(?>(?:{quoted}))++" if quoted else r"(?!)")

    def known(self, word: str) -> int:
        """Length of the longest suffix that ends a form; suffixes of known suffixes are known."""
        n = 0
        while n < len(word) and word[-n - 1 :] in self.endings:
            n += 1
        return n

    def readings(self, word: str) -> list[tuple[bool, int, int, int]]:
        """(guess, model, flexion length, base length): at most one per model, in order."""
        n, guess = self.known(word), False
        hits = sorted(self.forms.get(word, ()))
        if not hits and n >= LEAST_SUFFIX:
            head, tail = word[: len(word) - n], word[len(word) - n :]
            if self.head.fullmatch(head):
                hits = [(c, m, x, b + len(head)) for c, m, x, b in sorted(self.forms.get(tail, ()))]
            if not hits:
                guess = True
                hits = [(k, m, x, len(word) - x) for m, (k, x) in sorted(self.endings[tail].items(), key=lambda i: i[1])]
        first: dict[int, tuple[bool, int, int, int]] = {}
        for _, m, x, b in hits:
            first.setdefault(m, (guess, m, x, b))
        return [r for r in first.values() if not guess or r[3] >= LEAST_BASE]

    def words(self, word: str, lemmas_only: bool) -> list[str]:
        """Lemmas, or all forms, the more frequent first."""
        count: dict[str, int] = {}
        for guess, m, x, b in self.readings(word):
            start = 0 if guess else len(word) - x - b
            for prefix, flexion in self.models[m][:1] if lemmas_only else self.models[m]:
                w = f"{prefix}{word[start : start + b]}{flexion}"
                count[w] = count.get(w, 0) + 1
        return sorted(count, key=lambda w: -count[w])


class Kernel:
    """All functions over strings; languages in order of precedence, possibly none."""

    def __init__(self, languages: dict[str, Dictionary] | None = None):
        self.languages = languages or {}
        self.main = next(iter(self.languages), None)
        self._facts = lru_cache(maxsize=100_000)(self._look_up)

    def __getstate__(self) -> dict:
        return {"languages": self.languages}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["languages"])

    @classmethod
    def from_lexicon(cls, lexicon, limit: int = FORMS) -> Kernel:
        """Collects a dictionary's tables (paradigms, lemmas, prefixes); refuses more than `limit` forms."""
        langs = [r["lang"] for r in lexicon.languages.orderBy("lang_ord").collect()]
        n = lexicon.lemmas.join(lexicon.flex, ["lang", "model_no"]).limit(limit + 1).count()
        if n > limit:
            raise ValueError(f"over {limit} forms: use the engine's DataFrame methods")
        flex, lemmas, prefixes = defaultdict(list), defaultdict(list), defaultdict(list)
        for r in lexicon.flex.collect():
            flex[r["lang"]].append((r["model_no"], r["form_no"], r["prefix"] or "", r["flexion"] or ""))
        for r in lexicon.lemmas.collect():
            lemmas[r["lang"]].append((r["base"], r["model_no"]))
        for r in lexicon.prefixes.collect():
            prefixes[r["lang"]].append(r["prefix"])
        return cls({lang: Dictionary(flex[lang], lemmas[lang], prefixes[lang]) for lang in langs})

    def _look_up(self, word: str) -> tuple[str | None, dict[str, list[str]]]:
        sizes = [(d.known(word), -i, lang) for i, (lang, d) in enumerate(self.languages.items())]
        best = max(sizes, default=(0, 0, None))
        return (best[2] if best[0] else None), {lang: d.words(word, True) for lang, d in self.languages.items()}

    def detect_language(self, word: str) -> str | None:
        return None if is_garbage(word) else self._facts(word)[0]

    def describe(self, words: list[str], state: str | None = None) -> list[tuple[str, str | None, list[str]]]:
        """(surface, language, keys) of each word."""
        if not self.languages:
            return [(w, None, [w]) for w in words]
        from inflecta.operators.language import route

        return route(words, {w: self._facts(w) for w in set(words) if not is_garbage(w)}, self.main, state)

    def _matches(self, described: list, phrase: str) -> set[str]:
        found = set()
        for line in phrase.split("\n"):
            line = line.strip(" \t\r\n")
            name, bar, rest = line.partition("|")
            rest = rest if bar else line
            exact = rest.startswith("!")
            state = next((lang for lang in self.languages if lang.startswith(name)), None) if bar else None
            asked = [{w} if exact else set(keys) for w, _, keys in self.describe(tokens(rest[1:] if exact else rest), state)]
            for i in range(len(described) - len(asked) + 1 if asked else 0):
                if all(not a.isdisjoint(described[i + j][2]) for j, a in enumerate(asked)):
                    found.add(" ".join(d[0] for d in described[i : i + len(asked)]))
        return found

    def search(self, doc: str, phrase: str) -> str:
        """The matches, sorted, each with a line end."""
        return "".join(f"{m}\n" for m in sorted(self._matches(self.describe(tokens(doc.lower())), phrase.lower())))

    def _covered(self, doc: str, search: str) -> int:
        described = self.describe(tokens(doc.lower()))
        return sum(len(m.encode()) + 1 for piece in search.lower().split(" ") if piece for m in self._matches(described, piece))

    def str_intersect_str2(self, doc: str, search: str) -> float:
        size = len(doc.encode())
        covered = self._covered(doc, search)
        return 1.0 if covered >= size else covered / size

    def str_intersect_str(self, doc: str, search: str) -> float:
        return 0.0 if len(search.encode()) > len(doc.encode()) else self.str_intersect_str2(doc, search)

    def str_case_str(self, doc: str, phrase: str) -> int:
        return int(bool(self._matches(self.describe(tokens(doc.lower())), phrase.lower())))

    def normalize_phrase(self, text: str) -> str:
        out, size, room = [], 0, 2 * len(text.encode())
        for _, _, keys in self.describe(tokens(text.lower())):
            n = len(keys[0].encode()) + 1
            if size + n < room:
                out.append(f"{keys[0]} ")
                size += n
        return "".join(out)
