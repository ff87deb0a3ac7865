"""Segmenters: callables from a text to its words with their parts of speech.

A segmenter is built once per Python worker by a factory that travels with the plan, so one that
loads a model or a dictionary does so there. Parts of speech are short codes; None means that the
segmenter does not know, and such words pass every filter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from quillstone.functions.text import KEPT, split_tokens

Segmenter = Callable[[str], Iterable[tuple[str, str | None]]]

# Codes of nouns, verbs, adjectives and foreign words that keywords may have, by their
# beginning for frequency lists, and one by one for word graphs.
KEYWORD_POS = ("n", "v", "a", "eng")
GRAPH_POS = ("n", "nr", "ns", "nt", "nz", "ng", "vn", "v", "a", "an", "ad", "eng")

_KEPT, _RUNS = re.compile(KEPT, re.ASCII), re.compile("[a-z0-9]+|[一-龥]+")


def pieces() -> Segmenter:
    """Words of Latin letters and digits, and two-character pieces of Chinese runs, without parts of speech."""
    return lambda text: ((w, None) for w in split_tokens(text))


class Dictionary:
    """Longest words first from a dictionary of words and their parts of speech; Latin words are eng, numbers
    m, and characters that no word covers stand alone as x."""

    def __init__(self, words: dict[str, str]):
        self.words = {w.lower(): pos for w, pos in words.items() if w}
        self.longest = max(map(len, self.words), default=1)

    def __call__(self, text: str) -> list[tuple[str, str | None]]:
        out: list[tuple[str, str | None]] = []
        for run in _RUNS.findall(_KEPT.sub(" ", text or "").lower()):
            if run.isascii():
                out.append((run, self.words.get(run, "m" if run.isdigit() else "eng")))
                continue
            at = 0
            while at < len(run):
                n = next((n for n in range(min(self.longest, len(run) - at), 0, -1) if run[at : at + n] in self.words), 0)
                out.append((run[at : at + (n or 1)], self.words[run[at : at + n]] if n else "x"))
                at += n or 1
        return out


def kept_words(words: Iterable[tuple[str, str | None]], stop: set[str], allowed: Iterable[str] | None, whole: bool = False) -> list[str]:
    """Words of at least two characters, no number, no stop word, of an allowed part of speech: one that begins
    with an allowed code, or with ``whole`` is one."""
    codes = None if allowed is None else (frozenset(allowed) if whole else tuple(allowed))
    out = []
    for word, pos in words:
        word = word.strip()
        if len(word) < 2 or word.isdigit() or word in stop or word.lower() in stop:
            continue
        if pos is None or codes is None or (pos in codes if whole else pos.startswith(codes)):
            out.append(word)
    return out
