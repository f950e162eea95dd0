"""Personal data: exact patterns, and a character-level BiLSTM-CRF that adds what they miss.

The network knows the patterns' kinds in further forms (spaced or bracketed addresses, numbers without country code,
cards of 13 to 15 digits) and a kind of its own, secrets: keys and tokens of letters and digits. Every labelled kind holds
a digit or an at sign, so a span without one is no span; texts are looked at in regions of CONTEXT characters around
these. A region is cut into overlapping windows, the network scores each, the scores of overlapping windows are blended
with weights that fall towards the windows' edges, and Viterbi decodes the region. A region of more than SEGMENT
characters is decoded in segments that overlap by JOIN and are joined where both say the same, so memory is bounded
whatever the text. Spans that overlap a pattern's, or that lack the least their kind must have, are left out.

The network is trained by ``train_tagger`` on labelled spans in generated sentences, once per Python process.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tagger
from .common import table
from .tagger import KINDS

WINDOW, STRIDE, CONTEXT = 96, 48, 40
SEGMENT, JOIN = 43 * STRIDE, 6 * STRIDE  # so the segments' windows start where the region's do
#: Bound of the labelled sample: so many generated windows.
TRAINING_WINDOWS, EPOCHS = 2400, 6

#: The first kinds have patterns.
BASE_KINDS = 4

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the address pattern, found from the at signs: linear in the text."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches that pass their checks, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def generated_windows(n: int, seed: int) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """n windows of generated text with labelled spans of all kinds, and with numbers that are none."""
    r = np.random.default_rng(seed)
    pick = lambda x: x[int(r.integers(len(x)))]
    digits = lambda k: "".join(str(x) for x in r.integers(0, 10, k))
    syllables = ("the", "on", "er", "re", "an", "ti", "es", "or", "st", "en", "la", "de", "que", "sch", "ung", "ción", "ment", "é", "ü", "ou")
    word = lambda: "".join(pick(syllables) for _ in range(int(r.integers(1, 4))))

    def checked(body: str) -> str:
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    def card() -> str:
        gap = pick(("", "", " ", "-"))
        if r.random() < 0.3:
            x = checked(pick(("34", "37")) + digits(12))
            return gap.join((x[:4], x[4:10], x[10:]))
        x = checked(pick("3456") + digits(14))
        return gap.join(x[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c, d = digits(3), digits(3), digits(4), digits(2)
        return pick((f"+1 ({a}) {b}-{c}", f"+{d} {a} {b} {c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", *[f"{a}-{b}-{c}"] * 4, *[f"{a}.{b}.{c}"] * 2, f"+1-{a}-{b}-{c}", f"+{d}{a}{b}{c}", f"0{a}/{b}{c}", f"0{digits(1)} {d} {digits(2)} {digits(2)} {digits(2)}"))

    def email() -> str:
        name = pick((word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}.{digits(2)}", f"{word()}_{word()}"))
        host = f"{word()}{pick(('', digits(1)))}{pick(('', '', '.' + word()))}"
        return f"{name}{pick(('@', '@', '@', ' @ ', ' @', '[@]', '(@)'))}{host}.{pick(('com', 'org', 'net', 'example.com', 'de', 'fr'))}"

    def secret() -> str:
        lower, alnum = "abcdef0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        some = lambda letters, k: "".join(pick(letters) for _ in range(k))
        return pick((lambda: some(lower, pick((32, 40, 40, 48, 64))), lambda: some(lower, 40).upper(), lambda: f"{pick(('sk', 'pk', 'ghp', 'key'))}{pick('_-')}{some(alnum, int(r.integers(20, 40)))}", lambda: "AKIA" + some(alnum[:26] + "0123456789", 16), lambda: some(alnum, int(r.integers(24, 44)))))()

    # kind, maker, and what may stand before and after the span
    def made(k: int) -> tuple[str, str, str]:
        if k == 4 and r.random() < 0.8:
            quote = pick(('"', '"', "'", ""))
            return f"{pick(('token', 'key', 'secret', 'password', 'api_key', word()))}{pick((' = ', '=', ': '))}{quote}", secret(), quote
        s = (email, lambda: pick((".", ".", ".", "[.]")).join(str(x) for x in r.integers(0, 256, 4)), card, phone, secret)[k]()
        return pick(("", "", "", "(", '"', "<")), s, pick(("", "", "", ")", '"', ">", ":"))

    other = (
        lambda: f"{digits(1)}.{digits(1)}.", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: digits(int(r.integers(1, 9))), lambda: digits(int(r.integers(1, 4))), lambda: "".join(pick("0123456789abcdef") for _ in range(7)),
        lambda: f"20{digits(2)}-0{digits(1)}-1{digits(1)}", lambda: f"{digits(2)}.{digits(2)}.20{digits(2)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{digits(2)},{digits(3)}.{digits(2)}", lambda: "@" + word(), lambda: f"{word()}*** {word()}### ",
        lambda: f"{digits(3)}-{digits(1)}-{digits(5)}-{digits(1)}", lambda: f"{word()}_{digits(3)}", lambda: f"${digits(3)}", lambda: f"{digits(2)}%", lambda: f"{digits(4)}-{digits(4)}",
    )
    texts, labels = [], []
    while len(texts) < n:
        text, found = "", []
        while len(text) < WINDOW:
            x = r.random()
            if x < 0.14:
                k = int(r.integers(len(KINDS)))
                before, s, after = made(k)
                text += before
                found.append((k, len(text), len(text) + len(s)))
                text += s + after
            else:
                text += other[int(r.integers(len(other)))]() if x < 0.26 else word()
            text += pick((" ", " ", " ", " ", " ", ", ", ". ", "\n", "### ", "%%% ", "!! "))
        if r.random() < 0.15 and len(text.upper()) == len(text):
            text = text.upper()
        shift = int(r.integers(0, max(1, len(text) - WINDOW + 1)))
        inside = [(k, a - shift, b - shift) for k, a, b in found if a < shift + WINDOW and b > shift]
        if all(a >= 0 and b <= WINDOW for _, a, b in inside):
            texts.append(text[shift : shift + WINDOW])
            labels.append(inside)
    return texts, labels


def _labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    texts, labels = generated_windows(n, seed)
    tags = np.zeros((n, WINDOW), np.int64)
    for row, found in zip(tags, labels, strict=True):
        for k, a, b in found:
            row[a:b] = 2 + 2 * k
            row[a] = 1 + 2 * k
    return np.stack([tagger.encode(t) for t in texts]), tags


@functools.cache
def train_tagger(windows: int = TRAINING_WINDOWS, epochs: int = EPOCHS, seed: int = 1) -> dict[str, np.ndarray]:
    return tagger.train(*_labelled(windows, seed), epochs)


def regions(text: str) -> list[tuple[int, int]]:
    """Merged stretches of CONTEXT characters around digits and at signs."""
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.flatnonzero(((x >= 48) & (x <= 57)) | (x == 64))
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 2 * CONTEXT)
    starts, ends = np.concatenate([at[:1], at[cut + 1]]), np.concatenate([at[cut], at[-1:]])
    return [(max(0, int(a) - CONTEXT), min(len(x), int(b) + CONTEXT + 1)) for a, b in zip(starts, ends, strict=True)]


_EDGE = (np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1).astype(np.float32)


def segments(a: int, b: int) -> list[tuple[int, int]]:
    """A region cut into segments of at most SEGMENT characters that overlap by JOIN."""
    if b - a <= SEGMENT:
        return [(a, b)]
    return [(s, min(b, s + SEGMENT)) for s in range(a, b - JOIN, SEGMENT - JOIN)]


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """The tags of a region from those of its segments: of an overlap, the earlier segment's up to a place where both are
    outside of spans, the one nearest to its middle, or else to the middle."""
    out = parts[0]
    for x in parts[1:]:
        outside = np.flatnonzero((out[-JOIN:] == 0) & (x[:JOIN] == 0))
        cut = int(outside[np.abs(outside - JOIN // 2).argmin()]) if len(outside) else JOIN // 2
        out = np.concatenate([out[: len(out) - JOIN + cut], x[cut:]])
    return out


def model_spans(p: dict[str, np.ndarray], texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) that the network finds in each text."""
    areas = [(i, a, b) for i, t in enumerate(texts) for a, b in regions(t)]
    parts = [(area, a, b) for area, (_, lo, hi) in enumerate(areas) for a, b in segments(lo, hi)]
    decoded: list[list[np.ndarray]] = [[] for _ in areas]
    order = sorted(range(len(parts)), key=lambda k: parts[k][2] - parts[k][1])
    tags_of: dict[int, np.ndarray] = {}
    while order:
        longest = parts[order[-1]][2] - parts[order[-1]][1]
        n = min(len(order), max(1, (1 << 16) // longest))
        group, order = order[len(order) - n :], order[: len(order) - n]
        codes = [tagger.encode(texts[areas[parts[k][0]][0]][parts[k][1] : parts[k][2]]) for k in group]
        windows, where = [], []
        for g, c in enumerate(codes):
            for s in range(0, max(1, len(c) - WINDOW + STRIDE), STRIDE):
                windows.append(np.pad(c[s : s + WINDOW], (0, max(0, WINDOW - len(c[s : s + WINDOW])))))
                where.append((g, s))
        blended, weight = np.zeros((len(group), longest, tagger.TAGS), np.float32), np.zeros((len(group), longest, 1), np.float32)
        for w in range(0, len(windows), 1024):
            scores = tagger.emissions(p, np.stack(windows[w : w + 1024]))
            for (g, s), e in zip(where[w : w + 1024], scores, strict=True):
                n = min(WINDOW, len(codes[g]) - s)
                blended[g, s : s + n] += e[:n] * _EDGE[:n, None]
                weight[g, s : s + n] += _EDGE[:n, None]
        tags_of |= dict(zip(group, tagger.viterbi(p, blended / np.maximum(weight, 1e-6), np.array([len(c) for c in codes])), strict=True))
    for k, (area, _, _) in enumerate(parts):
        decoded[area].append(tags_of.pop(k))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, a, _), tags in zip(areas, decoded, strict=True):
        out[i] += [(k, s + a, e + a) for k, s, e in tagger.spans(joined(tags))]
    return out


#: The least a span of each kind must have for the network's word to count: digits, and for emails a name, an at sign and a dot.
LEAST_DIGITS = (0, 4, 13, 7, 2)


def plausible(kind: int, s: str) -> bool:
    """Whether a span that the network adds has the least that its kind must have; what it is, the network decides."""
    n = sum(c.isascii() and c.isdigit() for c in s)
    if kind == 0:
        at = s.find("@")
        return at > 0 and "." in s[at:]
    if kind == 4:
        return len(s) >= 16 and n >= LEAST_DIGITS[kind] and not any(c.isspace() for c in s)
    return n >= LEAST_DIGITS[kind]


def free_of(known: list[tuple[int, int, int]], new: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The new spans that overlap no known one: one sort of both, then a walk over them."""
    ends = sorted((a, b) for _, a, b in known)
    out, j, reach = [], 0, 0
    for k, a, b in sorted(new, key=lambda x: x[1]):
        while j < len(ends) and ends[j][0] < b:
            reach = max(reach, ends[j][1])
            j += 1
        if reach <= a:
            out.append((k, a, b))
    return out


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the patterns' spans), spans (all, with the
    network's) and n_spans of every row of docs (doc_id, text).

    Null texts are empty; rows are independent, with or without doc_id, repeated ones equal; other columns are ignored, and
    an empty table gives an empty result. Spans of two patterns that start alike are listed by kind. Texts of any length
    are read whole, in regions and segments of bounded size.
    """
    model = docs.sparkSession.sparkContext.broadcast(train_tagger())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            added = model_spans(p, texts)
            every = [known + free_of(known, [(k, a, b) for k, a, b in new if plausible(k, t[a:b])]) for t, known, new in zip(texts, base, added, strict=True)]
            counts = [pa.array([sum(k == i for k, _, _ in x) for x in base], pa.int64()) for i in range(BASE_KINDS)]
            digests = pa.array([hashlib.sha256(_join(x).encode()).hexdigest() for x in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([_join(x) for x in every], pa.string()), pa.array([len(x) for x in every], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS[:BASE_KINDS]), "base_sha256", "spans", "n_spans"])

    some = docs.select("doc_id", F.when(F.col("text").rlike("[0-9@]"), F.col("text")).alias("text"))
    return some.mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
