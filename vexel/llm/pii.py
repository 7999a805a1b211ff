"""Operator 7. Personal data by fixed patterns and a linear-chain CRF.

The base patterns find e-mail addresses, IP addresses, payment cards and phone
numbers. The CRF, trained on a small labelled table of sentences, adds spans of
kind ``secret``: keys, tokens and passwords. It decodes all tokens of every text,
long ones in pieces of PIECE tokens that see MARGIN tokens on either side. A span
of the CRF that meets a base span is left out; base spans always stay.

Edge cases: null and empty texts have no spans; null ids are kept; repeated rows
give repeated rows; overlapping base spans of different kinds are all reported;
an empty training table gives base spans only; other columns are ignored, or in
redact passed through.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm import crf
from vexel.llm.common import lean, table, text_slices

#: Kinds in their order within a position (the first four fixed).
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Tokens of a text that are decoded together, and tokens on each side of them that are decoded with them and left.
PIECE, MARGIN = 512, 64
#: Tokens, padding included, decoded in one numpy batch (a longer window alone).
BATCH_TOKENS = 60_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, in time linear in the text: the local part is the run of its characters before an @."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    found: list[Span] = [(start, 0, end) for start, end in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def secret_spans(texts: list[str], model: crf.ChainModel | None) -> list[list[tuple[int, int]]]:
    """Spans that the CRF labels, for each text."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if model is None:
        return out
    if (lexicon := model.__dict__.get("lexicon")) is None:
        lexicon = model.__dict__["lexicon"] = crf.Lexicon(model)
    labels: dict[int, np.ndarray] = {}
    tokens = [crf.TOKEN.findall(text) for text in texts]

    def decode(some: list[int]) -> None:
        """Decode texts by number: cut to pieces, the pieces sorted by length and put together to batches."""
        sizes = [len(tokens[i]) for i in some]
        scores = lexicon.scores([w for i in some for w in tokens[i]], sizes)
        pieces, at = [], 0  # text, first token kept, tokens before it, first and last token's row
        for i, size in zip(some, sizes, strict=True):
            labels[i] = np.zeros(size, np.int8)
            for start in range(0, size, PIECE):
                low = max(0, start - MARGIN)
                pieces.append((i, start, start - low, at + low, at + min(size, start + PIECE + MARGIN)))
            at += size
        pieces.sort(key=lambda p: p[4] - p[3])
        at = 0
        while at < len(pieces):
            size = 1
            while at + size < len(pieces) and (size + 1) * (pieces[at + size][4] - pieces[at + size][3]) <= BATCH_TOKENS:
                size += 1
            part = pieces[at : at + size]
            at += size
            lengths = np.array([high - low for *_, low, high in part])
            padded = np.zeros((size, lengths.max(), len(crf.LABELS)))
            for row, (*_, low, high) in zip(padded, part, strict=True):
                row[: high - low] = scores[low:high]
            for (i, start, before, low, high), found in zip(part, model.best(padded, lengths), strict=True):
                kept = found[before : min(before + PIECE, high - low)]
                labels[i][start : start + len(kept)] = kept

    some, held = [], 0
    for i, words in enumerate(tokens):
        if words:
            some.append(i)
            held += len(words)
        if held > 8 * BATCH_TOKENS:
            decode(some)
            some, held = [], 0
    if some:
        decode(some)
    for i, own in labels.items():
        if not (own == 1).any():
            continue
        places, start = [m.span() for m in crf.TOKEN.finditer(texts[i])], None
        for k, label in enumerate([*own.tolist(), 0]):
            if start is not None and label != 2:
                out[i].append((places[start][0], places[k - 1][1]))
                start = None
            if label == 1:
                start = k
    return out


def all_spans(texts: list[str], model: crf.ChainModel | None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    out = []
    for text, secrets in zip(texts, secret_spans(texts, model), strict=True):
        base = base_spans(text)
        extra = [(s, KINDS.index("secret"), e) for s, e in secrets if not any(s < b_end and b_start < e for b_start, _, b_end in base)]
        out.append((base, sorted(base + extra)))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def labelled_sentences(n: int = 360, seed: int = 7) -> list[tuple[str, int, int]]:
    """The small labelled table: sentence, start and end of its secret (-1, -1: none). Made up by rule."""
    rng = random.Random(seed)
    letters, hexes = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"

    def word() -> str:
        made = "".join(rng.choice(letters + "éäöüñç") for _ in range(rng.randint(1, 11)))
        return rng.choice((made, made, made, made.capitalize(), made + rng.choice(",.")))

    def digits(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def text_of(chars: str, k: int) -> str:
        made = "".join(rng.choice(chars) for _ in range(k))
        return made if any(c.isdigit() for c in made) else made[:-1] + rng.choice("0123456789")

    upper = letters.upper() + "0123456789"
    secret = (
        lambda: ("password=", text_of(hexes, rng.randint(10, 24)), ""),
        lambda: (f'{rng.choice(("token", "secret", "api_key", "auth"))} = "', text_of(hexes, rng.choice((24, 32, 40, 48))), '"'),
        lambda: (f'{rng.choice(("password", "passwd", "key", "secret"))}{rng.choice((":", ": ", "=", " = "))}', text_of(letters + upper, rng.randint(9, 24)), ""),
        lambda: ("", "A" + rng.choice(("KIA", "SIA")) + text_of(upper, 16), ""),
        lambda: ("", "gh" + rng.choice("pos") + text_of(letters + upper, 30), ""),
        lambda: (f'{rng.choice(("password", "passwd", "pwd", "secret"))}{rng.choice((":", ": ", "=", " = "))}', "".join(rng.choice(letters) for _ in range(rng.randint(5, 16))), ""),
        lambda: (f'{rng.choice(("password", "token", "key", "secret"))}{rng.choice((":", ": ", "=", " = "))}', "-".join(text_of(letters + upper, rng.randint(3, 5)) for _ in range(rng.randint(2, 4))), ""),
    )
    plain = (
        lambda: digits(rng.randint(8, 19)),
        lambda: f"{rng.choice(letters)}{rng.choice(letters)}.{digits(2)}@mail{digits(1)}.example.com",
        lambda: ".".join(digits(rng.randint(1, 3)) for _ in range(4)),
        lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: f"{digits(4)}-{digits(2)}-{digits(2)}",
        lambda: f"https://{rng.choice(letters)}{rng.choice(letters)}.example.org/{digits(4)}?page={digits(1)}",
        lambda: f"{word()}{digits(rng.randint(1, 4))}",
        lambda: f"{rng.choice(('token', 'password', 'key'))} {word()} {word()}",
        lambda: f"version{digits(1)}.{digits(1)}",
    )
    rows = []
    for i in range(n):
        before = " ".join(word() for _ in range(rng.randint(0, 7)))
        before += " " if before else ""
        after = "".join(f" {word()}" for _ in range(rng.randint(0, 6)))
        if i % 2:
            lead, value, tail = rng.choice(secret)()
            rows.append((f"{before}{lead}{value}{tail}{after}", len(before) + len(lead), len(before) + len(lead) + len(value)))
        else:
            rows.append((f"{before}{rng.choice(plain)()}{after}", -1, -1))
    return rows


def train_model(rows: list[tuple[str, int, int]]) -> crf.ChainModel | None:
    """The CRF for a labelled table (sentence, start, end)."""
    examples = []
    for text, start, end in rows:
        cut = list(crf.TOKEN.finditer(text))
        labels = [0 if not (start <= m.start() and m.end() <= end) else 1 if m.start() == start else 2 for m in cut]
        if cut:
            examples.append(([m[0] for m in cut], labels))
    return crf.train(examples) if examples else None


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long"


def find_pii(docs: DataFrame, model: crf.ChainModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by kind, the hash of the base spans and all spans of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.int64() if f.endswith("long") else pa.string() for f in SCHEMA.split(", ")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches, ["doc_id", "text"]):
            rows = []
            for i, (base, spans) in zip(ids, all_spans([t or "" for t in texts], shared.value), strict=True):
                counts = [sum(k == kind for _, k, _ in spans) for kind in range(len(KINDS))]
                rows.append((i, *counts[:4], sha256(joined(base).encode()).hexdigest(), joined(spans), counts[4]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(find), SCHEMA)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the union, under the first one's kind."""
    out, end = [], 0
    for start, kind, stop in spans:
        if start >= end:
            out += [text[end:start], f"<{KINDS[kind].upper()}>"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, model: crf.ChainModel | None, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with personal data in the text replaced, and the length column, where there is one, set anew."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(place).to_pylist()
                spans = all_spans([t or "" for t in texts], shared.value)
                new = [t if t is None else redacted(t, s) for t, (_, s) in zip(texts, spans, strict=True)]
                yield part.set_column(place, part.schema.field(place), pa.array(new, part.schema.field(place).type))

    out = docs.mapInArrow(lean(clean), docs.schema)
    if length_col:
        out = out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return out


def op7_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"), train_model(labelled_sentences()))
