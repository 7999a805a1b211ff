"""Noisy-channel restoration of obfuscated words: Viterbi decoding of character lattices under a character language model.

The language model is a trigram model over the letters a to z and the space,
from counts over all texts. A word that mixes letters with look-alike signs,
stretches letters, or is spaced out becomes a lattice: every sign offers the
letters it may stand for, every run of one letter offers one or two of it, and
between the letters of a spaced-out run a space is offered too, so that whole
sentences come back as words. Full-width and styled letters are folded first
(compatibility forms), and Cyrillic or Greek letters among Latin ones stand for
the letters that they look like; a word of one script alone stays as it is. The best path weighs the channel's cost against the
model, in time linear in the length, which has no bound.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Signs and the letters that they stand for (fixed values).
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou"}
#: Cyrillic and Greek letters and the Latin ones that they look like (fixed values).
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
LETTERS = 27  # a to z, and 0 for everything else
#: The channel's log-probabilities of a word going on and ending at a gap: where all gaps are alike, of one sign beside wider ones, of two signs beside narrower ones.
GAP_ALIKE, GAP_NARROW, GAP_WIDE = (0.0, 0.0), (0.0, -7.0), (-4.0, 0.0)

SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|])(?:[ .\-_*~]{1,2}(?:[^\W_]|[@$!|])){3,}(?![^\W_])")
_SPACED_LETTER = re.compile(r"([^\W_]|[@$!|])([ .\-_*~]{0,2})")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
_EDGE_LEFT, _EDGE_RIGHT = ".,;:?\"'()[]{}<>#%&*-_/\\|~^+=`´“”„«»¿¡…", ".,;:?!\"'()[]{}<>#%&*-_/\\|~^+=`´“”„«»…@$"


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """Code point -> letter number, for the first 0x250; accents fold to their letter, all else is 0."""
    codes = np.zeros(0x251, np.uint8)
    for point in range(0x250):
        base = unicodedata.normalize("NFKD", chr(point).lower())[:1]
        if "a" <= base <= "z":
            codes[point] = ord(base) - 96
    return codes


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of letter trigrams (32 * 32 * 32, by letter numbers) in the texts; every text begins and ends with two gaps."""
    joined = "  ".join(["", *texts, ""])
    points = np.minimum(np.frombuffer(joined.encode("utf-32-le"), "<u4"), 0x250)
    codes = letter_codes()[points].astype(np.int32)
    return np.bincount((codes[:-2] << 10) | (codes[1:-1] << 5) | codes[2:], minlength=1 << 15)


class CharModel:
    """log P(c | a, b), trigrams smoothed by bigrams and those by single letters."""

    def __init__(self, counts: np.ndarray) -> None:
        tri = counts.reshape(32, 32, 32)[:LETTERS, :LETTERS, :LETTERS].astype(np.float64)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
        p1 = (uni + 1) / (uni.sum() + LETTERS)
        p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
        p3 = (tri + 5 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 5)
        self.log = np.log(p3).tolist()

    def restore(self, word: str) -> str:
        """The best letters for a word of letters and look-alikes."""
        return self._best(lattice(word))

    def restore_spaced(self, run: str) -> str:
        """The best words for a run of spaced-out letters."""
        return " ".join(self._best(spaced_lattice(run)).split())

    def _best(self, options_of: Iterator[list[tuple[str, float]]]) -> str:
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in options_of:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in paths.items():
                for letters, cost in options:
                    x, y, total = a, b, score + cost
                    for c in letters:
                        k = 0 if c == " " else ord(c) - 96
                        total += self.log[x][y][k]
                        x, y = y, k
                    if (x, y) not in after or total > after[(x, y)][0]:
                        after[(x, y)] = (total, (path, letters))
            paths = after
        path = max(((s + self.log[a][b][0], p) for (a, b), (s, p) in paths.items()), key=lambda x: x[0])[1]
        pieces = []
        while path:
            path, letters = path
            pieces.append(letters)
        return "".join(reversed(pieces))


def folded(char: str) -> str:
    point = ord(char)
    code = int(letter_codes()[point]) if point < 0x250 else 0
    return chr(96 + code) if code else HOMOGLYPHS.get(char, "")


def lowered(text: str) -> str:
    """The text in lower case, compatibility forms folded."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()


def mixed(word: str) -> bool:
    """Latin letters, and others that look like Latin ones."""
    return not word.isascii() and any(c in HOMOGLYPHS for c in word) and any("a" <= c <= "z" for c in word)


def lattice(word: str) -> Iterator[list[tuple[str, float]]]:
    """For each run of one sign, what it may stand for and the channel's log-probability."""
    i = 0
    while i < len(word):
        char, n = word[i], 1
        while i + n < len(word) and word[i + n] == char:
            n += 1
        i += n
        letter = folded(char)
        choices = [letter] if letter else list(LOOKALIKES.get(char, ""))
        if not choices:
            continue
        cost = 0.0 if letter else -np.log(len(choices))
        if n == 1:
            yield [(c, cost) for c in choices]
        elif letter and n == 2:
            yield [(letter * 2, -0.05), (letter, -3.0)]
        else:
            yield [option for c in choices for option in ((c, cost - 0.4), (c * 2, cost - 1.1))]


def spaced_lattice(run: str) -> Iterator[list[tuple[str, float]]]:
    """The same for every letter of a spaced-out run, and between letters a space or none; letters that repeat are one run where no word ends."""
    letters = list(_SPACED_LETTER.finditer(run))
    widths = [len(m[2]) for m in letters[:-1]]
    costs = [GAP_ALIKE if len(set(widths)) < 2 else GAP_WIDE if w > 1 else GAP_NARROW for w in widths]
    i = 0
    while i < len(letters):
        n = 1
        while i + n < len(letters) and letters[i + n][1] == letters[i][1] and n < 2:
            n += 1
        if n == 2 and i + 2 < len(letters) and letters[i + 2][1] == letters[i][1]:
            # stretched: all of the run at once
            while i + n < len(letters) and letters[i + n][1] == letters[i][1]:
                n += 1
        own = list(lattice(letters[i][1] * n))
        i += n
        if not own:
            continue
        options = own[0]
        if n > 1:
            on, end = max(costs[i - n : i - 1], key=lambda c: c[1] - c[0])  # the likeliest place of a word's end
            options = [(c, cost + on) for c, cost in options] + [(f"{c} {c}", cost + end) for c, cost in options if len(c) == 1]
        yield options
        if i < len(letters):
            on, end = costs[i - 1]
            yield [("", on), (" ", end)]


def needs_restoring(word: str) -> bool:
    """Letters among look-alikes, letters of mixed scripts, or a stretched letter. word: lower case, without outer punctuation."""
    if len(word) < 3:
        return False
    letters = sum(c.isalpha() for c in word)
    if letters == len(word):
        return STRETCHED.search(word) is not None or mixed(word)
    return letters >= 1 and all(c.isalpha() or c in LOOKALIKES for c in word)


def bare(token: str) -> str:
    """A token without outer punctuation, but with the look-alikes that may begin a word."""
    return token.rstrip(_EDGE_RIGHT).lstrip(_EDGE_LEFT)


class Restorer:
    """Words of texts with obfuscated ones restored; decoded words are kept, up to a bound."""

    def __init__(self, model: CharModel) -> None:
        self.decode = lru_cache(maxsize=100_000)(model.restore)
        self.decode_spaced = lru_cache(maxsize=10_000)(model.restore_spaced)

    def words(self, text: str) -> set[str]:
        """The distinct lower-case words of a text after restoration."""
        text = lowered(text)
        out: set[str] = set()
        for token in set(text.split()):
            if token.isalpha():
                word = token
            elif not (word := bare(token)):
                continue
            if word.isalpha() and not mixed(word):
                out.add(word)
            elif needs_restoring(word):
                out.add(self.decode(word))
            else:
                out.update(p for p in re.split(r"[\W_]+", word) if p)
        done = 0
        for found in STRETCHED.finditer(text):
            if found.start() < done:
                continue  # in the run of the match before
            start, end = found.start(), found.end()
            while start and text[start - 1].isalnum():
                start -= 1
            while end < len(text) and text[end].isalnum():
                end += 1
            done = end
            if needs_restoring(word := text[start:end]):
                out.add(self.decode(word))
        for found in SPACED.finditer(text):
            out.add(self.decode(re.sub(r"[ .\-_*~]", "", found[0])))
            out.update(self.decode_spaced(found[0]).split())
        return out

    def restored(self, text: str) -> str:
        """The text, lower-case, with obfuscated words replaced by what they stand for."""

        def one(match: re.Match) -> str:
            word = bare(match[0])
            return match[0].replace(word, self.decode(word), 1) if word and needs_restoring(word) else match[0]

        joined = SPACED.sub(lambda m: self.decode_spaced(m[0]), lowered(text))
        return re.sub(r"\S+", one, joined)
