"""A plain-Python model of the engine's semantics, one text at a time, for tests to hold Spark against."""

from __future__ import annotations

import re

TOKEN = re.compile(r"[^\W_]+(?:[-'`_][^\W_]+)*")


def base36(n: int) -> str:
    out = ""
    while n:
        n, d = divmod(n, 36)
        out = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[d] + out
    return out or "0"


class Model:
    """languages: in order, {lang: (models, lemmas, prefixes)} with models as lists of flexions or (prefix, flexion)."""

    def __init__(self, languages: dict):
        self.languages = {}
        for lang, (models, lemmas, prefixes) in languages.items():
            models = [[f if isinstance(f, tuple) else ("", f) for f in m] for m in models]
            forms = sorted({(f"{p}{base}{x}", m, len(x), len(base)) for base, m in lemmas for p, x in models[m]})
            self.languages[lang] = (models, forms, sorted(prefixes))

    def known(self, lang: str, w: str) -> int:
        forms = self.languages[lang][1]
        return max((n for n in range(1, len(w) + 1) if any(f.endswith(w[-n:]) for f, *_ in forms)), default=0)

    def has_prefixes(self, lang: str, head: str) -> bool:
        for p in self.languages[lang][2]:
            if head.startswith(p):
                return head == p or self.has_prefixes(lang, head[len(p) :])
        return False

    def candidates(self, lang: str, w: str) -> list[tuple[str, int, int, int]]:
        """(kind, model, flexion length, base length), first hits per model, in order."""
        _, forms, _ = self.languages[lang]
        code = lambda m, x, b: base36(m << 16 | x << 8 | b)
        hits = sorted((code(m, x, b), m, x, b) for f, m, x, b in forms if f == w)
        kind, n = "exact", self.known(lang, w)
        if not hits and n >= 4:
            head, tail = w[: len(w) - n], w[-n:]
            if self.has_prefixes(lang, head):
                kind, hits = "prefix", sorted((code(m, x, b), m, x, b + len(head)) for f, m, x, b in forms if f == tail)
            if not hits:
                kind = "guess"
                hits = sorted((f"{f[::-1]}|{code(m, x, b)}".encode(), m, x, len(w) - x) for f, m, x, b in forms if f.endswith(tail))
        out, seen = [], set()
        for _, m, x, b in hits:
            if m not in seen:
                seen.add(m)
                if kind != "guess" or b >= 3:
                    out.append((kind, m, x, b))
        return out

    def words(self, lang: str, w: str, lemmas_only: bool) -> list[str]:
        """Lemmas, or all forms: the more frequent first, then in order."""
        count: dict[str, int] = {}
        for kind, m, x, b in self.candidates(lang, w):
            start = 0 if kind == "guess" else len(w) - x - b
            for p, flexion in self.languages[lang][0][m][: 1 if lemmas_only else None]:
                word = p + w[start : start + b] + flexion
                count[word] = count.get(word, 0) + 1
        return sorted(count, key=lambda k: -count[k])

    def garbage(self, w: str) -> bool:
        return any(not c.isalpha() and c not in "-'`" for c in w)

    def detect(self, w: str) -> str | None:
        best = max(((self.known(lang, w), -i, lang) for i, lang in enumerate(self.languages)), default=(0, 0, None))
        return best[2] if best[0] else None

    def by_name(self, key: str | None) -> str | None:
        return next((lang for lang in self.languages if key is not None and lang.startswith(key)), None)

    def describe(self, tokens: list[str], state: str | None = None) -> list[tuple[str, list[str]]]:
        out = []
        for w in tokens:
            if self.garbage(w) or not self.languages:
                out.append((w, [w]))
                continue
            lemmas = self.words(state, w, True) if state else []
            if not lemmas:
                found = self.detect(w)
                lemmas = self.words(found or next(iter(self.languages)), w, True)
                state = found or state
            out.append((w, [x for x in lemmas if x != w] + [w]))
        return out

    def search(self, doc: str, phrase: str) -> str:
        """The matches of a phrase's lines in a lower-cased document."""
        words = self.describe(TOKEN.findall(doc))
        found = set()
        for line in phrase.split("\n"):
            line = line.strip(" \t\r\n")
            if not line:
                continue
            name, bar, rest = line.partition("|")
            rest = rest if bar else line
            exact = rest.startswith("!")
            asked = self.describe(TOKEN.findall(rest[1:] if exact else rest), self.by_name(name) if bar else None)
            keys = [{w} if exact else set(k) for w, k in asked]
            for i in range(len(words) - len(keys) + 1):
                if keys and all(k & set(words[i + j][1]) for j, k in enumerate(keys)):
                    found.add(" ".join(w for w, _ in words[i : i + len(keys)]))
        return "".join(f"{x}\n" for x in sorted(found))

    def intersect(self, doc: str, search: str, guard: bool = True) -> float:
        n, m = len(doc.encode()), len(search.encode())
        if guard and m > n:
            return 0.0
        covered = sum(len(self.search(doc.lower(), p).encode()) for p in search.lower().split(" ") if p)
        return 1.0 if covered >= n else covered / n

    def normalize_phrase(self, text: str) -> str:
        out, room = "", 2 * len(text.encode())
        for _, keys in self.describe(TOKEN.findall(text.lower())):
            if len(f"{out}{keys[0]} ".encode()) < room:
                out += f"{keys[0]} "
        return out
