"""The rules of `text.raw_tokens`, `text.expand_token` and `text.similarity` in plain Python, for Arrow batches: a chunk's terms are counted where
its text is read, so no token moves between tasks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

#: The script Han of Unicode 15, as the oracles' engine has it; an older JVM knows some hundred code points less.
HAN_RANGES = (
    "2E80-2E99 2E9B-2EF3 2F00-2FD5 3005 3007 3021-3029 3038-303B 3400-4DBF 4E00-9FFF F900-FA6D FA70-FAD9 16FE2-16FE3 16FF0-16FF1 20000-2A6DF 2A700-2B739"
    " 2B740-2B81D 2B820-2CEA1 2CEB0-2EBE0 2F800-2FA1D 30000-3134A 31350-323AF"
).split()
HAN = "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in HAN_RANGES)
RAW = re.compile(f"[A-Za-z_$][A-Za-z0-9_$]+|[{HAN}]{{2,}}")
NUMBER = re.compile(r"[0-9](?<![A-Za-z0-9_$][0-9])[0-9]+(?![A-Za-z0-9_$])")  # whole tokens of two digits or more
PLAIN = re.compile(r"[A-Za-z][a-z0-9]*|[A-Z]+")
WORD = re.compile(r"[a-z0-9_$]{4,}")
HUMP, ACRONYM, JOINT = re.compile("([a-z0-9])([A-Z])"), re.compile("([A-Z]+)([A-Z][a-z])"), re.compile("[ _$]+")
MOST_TF, MOST_HELD = 255, 400_000


def forms(word: str, stop: frozenset[str]) -> tuple[str, ...]:
    """All forms of a raw token under which it is looked up: itself, its parts, the parts joined."""
    low = word if word.islower() else word.lower()
    if PLAIN.fullmatch(word) or word[0] > "\x7f":
        return () if len(low) < 2 or low in stop else (low,)
    parts = [p for p in JOINT.split(ACRONYM.sub(r"\1 \2", HUMP.sub(r"\1 \2", word)).lower()) if p]
    found = [low, *parts, *(("".join(parts), "_".join(parts)) if len(parts) > 1 else ())]
    return tuple(f for f in dict.fromkeys(found) if len(f) >= 2 and f not in stop)


def trigrams(word: str) -> set[str]:
    w = f"^{word}$"
    return {w[i : i + 3] for i in range(max(1, len(w) - 2))}


class Forms(dict):
    """Each token's forms, worked out once."""

    def __init__(self, stop: Iterable[str]):
        self.stop = frozenset(stop)

    def __missing__(self, word: str) -> tuple[str, ...]:
        out = self[word] = forms(word, self.stop)
        return out


class Similar(dict):
    """Of each term the words of queries that are similar to it, with the similarity, worked out once."""

    def __init__(self, words: Iterable[str]):
        self.sizes, self.by_gram = {}, {}
        for q in words:
            grams = trigrams(q)
            self.sizes[q] = len(grams)
            for g in grams:
                self.by_gram.setdefault(g, []).append(q)

    def __missing__(self, v: str) -> tuple[tuple[str, float], ...]:
        out = self[v] = self.of(v)
        return out

    def of(self, v: str) -> tuple[tuple[str, float], ...]:
        w = f"^{v}$"
        met = [g for i in range(len(v)) if (g := w[i : i + 3]) in self.by_gram]
        if len(met) < 2 or not WORD.fullmatch(v):  # words of four letters that share one trigram have a coefficient of 1/4 at most, and none holds the other
            return ()
        shared: dict[str, int] = {}
        for g in set(met):
            for q in self.by_gram[g]:
                shared[q] = shared.get(q, 0) + 1
        if max(shared.values()) < 2:
            return ()
        n_v, out = len(trigrams(v)), []
        for q, n in shared.items():
            dice = 2.0 * n / (self.sizes[q] + n_v)
            if q == v:
                out.append((q, 1.0))
            elif v in q or q in v:
                out.append((q, 0.82))
            elif abs(len(q) - len(v)) <= max(5, len(q)) and dice >= 0.42:
                out.append((q, dice))
        return tuple(out)


def counted(bodies: Iterable[str], held: Forms) -> dict[str, int]:
    """How often each term occurs in a chunk of one or several bodies, up to 255; numbers count once where no form has them."""
    tf: dict[str, int] = {}
    tokens: Counter[str] = Counter()
    for body in bodies:
        tokens.update(RAW.findall(body))
    for word, n in tokens.items():
        for form in held[word]:
            tf[form] = tf.get(form, 0) + n
    for body in bodies:
        for number in NUMBER.findall(body):
            tf.setdefault(number, 1)
    if tf and max(tf.values()) > MOST_TF:
        tf = {t: min(n, MOST_TF) for t, n in tf.items()}
    return tf
