"""A linear-chain conditional random field over word-shape features, in numpy.

Sequences are padded to (batch, length, features) arrays of feature numbers.
Training follows the log-likelihood's gradient by the forward-backward sums;
decoding is Viterbi over whole batches at once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

LABELS = ("O", "B", "I")
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
RUNS = re.compile(r"[A-Z]+|[a-z]+|[0-9]+")
#: Words that announce a credential (fixed values).
CUES = frozenset(("password", "passwd", "pwd", "token", "secret", "key", "apikey", "auth", "credential"))


def shape(word: str) -> str:
    """Runs of upper-case letters, other letters and digits as A, a and 9, cut to three runs; other characters as themselves."""
    if not word[0].isalnum():
        return word
    runs = []
    for c in word:
        kind = "9" if c.isdigit() else "A" if c.isupper() else "a"
        if not runs or runs[-1] != kind:
            runs.append(kind)
    return "".join(runs[:3])


def features(words: list[str]) -> list[list[str]]:
    """Of each token: shape and length, the shapes beside it, whether a cue word stands up to three tokens before."""
    shapes = [shape(w) for w in words]
    out = []
    for i, word in enumerate(words):
        mixed = len(set(RUNS.findall(word))) > 3
        cue = any(w.lower() in CUES for w in words[max(0, i - 3) : i])
        size = min(len(word) // 4, 6)
        out.append([
            "bias", f"shape={shapes[i]}", f"size={size}", f"mixed={mixed}/{size}", f"hex={all(c in '0123456789abcdef' for c in word)}/{size}",
            f"upper={word.isupper() and word.isalnum() and not word.isdigit()}/{size}", f"digits={word.isdigit()}", f"cue={cue}/{size > 2}",
            f"before={shapes[i - 1] if i else '^'}", f"after={shapes[i + 1] if i + 1 < len(words) else '$'}",
        ])
    return out


@dataclass
class ChainModel:
    numbers: dict[str, int]
    emit: np.ndarray  # features x labels; the last row is for unknown features and stays 0
    move: np.ndarray  # labels x labels, from row to column
    start: np.ndarray

    def pad(self, rows: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers (batch, length, features) and the sequences' lengths."""
        none = len(self.numbers)
        lengths = np.array([len(r) for r in rows])
        width = len(rows[0][0])
        out = np.full((len(rows), lengths.max(), width), none, np.int32)
        for i, row in enumerate(rows):
            out[i, : len(row)] = [[self.numbers.get(f, none) for f in token] for token in row]
        return out, lengths

    def decode(self, rows: list[list[list[str]]]) -> list[list[int]]:
        """The best label sequence of each row."""
        if not rows:
            return []
        x, lengths = self.pad(rows)
        return [labels[:n].tolist() for labels, n in zip(self.best(self.emit[x].sum(axis=2), lengths), lengths, strict=True)]

    def best(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi over a padded batch of token scores: labels (batch, length)."""
        n, width, k = scores.shape
        best = self.start + scores[:, 0]
        back = np.zeros((n, width, k), np.int8)
        ends = np.where((lengths == 1)[:, None], best, -np.inf)
        for t in range(1, width):
            paths = best[:, :, None] + self.move
            back[:, t] = paths.argmax(axis=1)
            best = paths.max(axis=1) + scores[:, t]
            ends = np.where((lengths == t + 1)[:, None], best, ends)
        out, label, rows = np.zeros((n, width), np.int8), ends.argmax(axis=1), np.arange(n)
        for t in range(width - 1, -1, -1):
            out[:, t] = label
            if t:
                label = np.where(t < lengths, back[rows, t, label], label)
        return out


class _Alike(dict):
    """Characters that no feature tells apart, by one of them."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if "a" <= c <= "z":
            like = "a" if c <= "f" else "g"
        elif "A" <= c <= "Z":
            like = "A"
        elif "0" <= c <= "9":
            like = "0"
        elif not c.isalnum() or c.istitle() and not c.isupper():
            like = c
        else:
            like = "\u0663" if c.isdigit() else "\u00c9" if c.isupper() else "\u00e9" if c.islower() else "\u4e2d"
        self[code] = like
        return like


class _Numbers(dict):
    """The number of every word's pattern; a new word is handed to `read`."""

    def __init__(self, read) -> None:
        super().__init__()
        self.read = read

    def __missing__(self, word: str) -> int:
        found = self[word] = self.read(word)
        return found


class Lexicon:
    """Scores of tokens by their own and their neighbours' features, as `features` gives them.

    Words of which all features agree have one pattern, which is read once:
    their characters are replaced by like ones, unless a word has so many runs that
    the runs themselves matter.
    """

    WORDS = 300_000

    def __init__(self, model: ChainModel) -> None:
        self.model = model
        self.announced = np.array([[self._of(f"cue={c}/{large}") for large in (False, True)] for c in (False, True)])
        self.alike = _Alike()
        self.clear()

    def clear(self) -> None:
        self.ids = _Numbers(self._read)
        self.patterns: dict[str, int] = {}
        self.rows: list[tuple[np.ndarray, int, bool, bool]] = []  # own scores, shape, cue, large
        self.shapes: dict[str, int] = {}
        self.before, self.after = [self._of("before=^")], [self._of("after=$")]  # shape 0: the text's edge
        self.known = 0

    def _of(self, feature: str) -> np.ndarray:
        return self.model.emit[self.model.numbers.get(feature, len(self.model.numbers))]

    def _read(self, word: str) -> int:
        like = word.translate(self.alike)
        if len(RUNS.findall(like)) > 3 or word.lower() in CUES:
            like = word
        found = self.patterns.get(like)
        if found is None:
            found = self.patterns[like] = len(self.rows)
            kind = shape(like)
            if kind not in self.shapes:
                self.shapes[kind] = len(self.before)
                self.before.append(self._of(f"before={kind}"))
                self.after.append(self._of(f"after={kind}"))
            self.rows.append((sum(self._of(f) for f in features([like])[0][:7]), self.shapes[kind], like.lower() in CUES, min(len(like) // 4, 6) > 2))
        return found

    def _tables(self) -> None:
        """The patterns' scores, shapes, cues and sizes as arrays, anew when there are new ones."""
        if self.known != len(self.rows):
            own, kinds, cue, large = zip(*self.rows, strict=True)
            self.own, self.kinds, self.cue, self.large = np.array(own), np.array(kinds), np.array(cue), np.array(large, np.int64)
            self.left, self.right = np.array(self.before), np.array(self.after)
            self.known = len(self.rows)

    def scores(self, words: list[str], lengths: list[int] | None = None) -> np.ndarray:
        """(tokens, labels) of texts that stand one after another; lengths: their tokens (one text)."""
        if len(self.ids) > self.WORDS:
            self.ids.clear()
        if len(self.patterns) > self.WORDS:
            self.clear()
        sizes = np.array([len(words)] if lengths is None else lengths, np.int64)
        ends = np.cumsum(sizes)[sizes > 0]
        begins = ends - sizes[sizes > 0]
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        self._tables()
        kinds = self.kinds[ids]
        left, right = np.append(0, kinds[:-1]), np.append(kinds[1:], 0)
        left[begins], right[ends - 1] = 0, 0
        place = np.arange(len(ids)) - np.repeat(begins, ends - begins)
        cue, own = np.zeros(len(ids), np.int64), self.cue[ids]
        for d in range(1, 4):
            cue[d:] |= own[:-d] & (place[d:] >= d)
        return self.own[ids] + self.left[left] + self.right[right] + self.announced[cue, self.large[ids]]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(examples: list[tuple[list[str], list[int]]], steps: int = 120, rate: float = 0.3, l2: float = 1e-3) -> ChainModel:
    """Fit by gradient ascent with adaptive steps. examples: words and label numbers."""
    rows = [features(words) for words, _ in examples]
    numbers = {f: i for i, f in enumerate(sorted({f for row in rows for token in row for f in token}))}
    k, n_features = len(LABELS), len(numbers)
    model = ChainModel(numbers, np.zeros((n_features + 1, k)), np.zeros((k, k)), np.zeros(k))
    x, lengths = model.pad(rows)
    n, width, _ = x.shape
    inside = np.arange(width) < lengths[:, None]
    y = np.zeros((n, width), np.int64)
    for i, (_, labels) in enumerate(examples):
        y[i, : len(labels)] = labels
    gold = np.eye(k)[y] * inside[:, :, None]
    gold_moves = np.einsum("ntj,ntk->jk", gold[:, :-1], gold[:, 1:])
    params = [model.emit, model.move, model.start]
    squares = [np.full_like(p, 1e-8) for p in params]
    for _ in range(steps):
        scores = model.emit[x].sum(axis=2)
        alpha, beta = np.zeros((n, width, k)), np.zeros((n, width, k))
        alpha[:, 0] = model.start + scores[:, 0]
        for t in range(1, width):
            step = _logsum(alpha[:, t - 1, :, None] + model.move, 1) + scores[:, t]
            alpha[:, t] = np.where(inside[:, t, None], step, alpha[:, t - 1])
        total = _logsum(alpha[:, -1], 1)
        for t in range(width - 2, -1, -1):
            step = _logsum(model.move + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(inside[:, t + 1, None], step, 0.0)
        marginal = np.exp(alpha + beta - total[:, None, None]) * inside[:, :, None]
        diff = gold - marginal
        g_emit = np.zeros_like(model.emit)
        for f in range(x.shape[2]):
            np.add.at(g_emit, x[:, :, f].ravel(), diff.reshape(-1, k))
        pair = alpha[:, :-1, :, None] + model.move + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        g_move = gold_moves - (np.exp(pair) * inside[:, 1:, None, None]).sum(axis=(0, 1))
        g_start = diff[:, 0].sum(axis=0)
        for p, g, s in zip(params, (g_emit, g_move, g_start), squares, strict=True):
            g = g / n - l2 * p
            s += g * g
            p += rate * g / np.sqrt(s)
        model.emit[-1] = 0.0
    return model
