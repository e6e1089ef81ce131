"""Personal data: fixed base patterns, and a semi-Markov conditional random field that
adds what they miss (phone numbers without a plus sign, spelled-out addresses, oddly
grouped card numbers, spaced-out addresses of machines).

The field scores whole candidate segments: features look at a segment's digits, shape,
checksum, separators and the words before it. Segments have at most ``LONGEST``
tokens, so the dynamic program over boundaries and types is linear in a text's length.
Outside of zones that hold seven digits, four short numbers between dots (bracketed or
spelled out as well) or a spelled-out "at" every token is its own unlabelled segment, whatever the weights, so only zones are walked; a segment may not
touch a base span. Weights are fitted to the conditional likelihood of generated
sentences, whose segmentation is known; no text of the corpus is needed.

Scale: one pass over whole texts without a shuffle. A zone of any length is walked
``STEP`` tokens at a time, whose candidates' features are dropped once scored: only
candidates with a positive score, which alone can be in the best segmentation, are kept.
Features of a segment's shape are worked out once a shape, checksums by running sums.

A null text is empty and has no spans. Repeated rows are judged alike; an empty table
gives an empty result; other columns are not used.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import blocks, table

KINDS = ["email", "ip", "card", "phone"]
LONGEST = 24

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits does, so no start inside a run is tried.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_NUMBERS = re.compile(r"[+(\[]{0,2}[0-9](?:[ ().\[\]/·–-]{0,3}[0-9])+")
# A dot as machine addresses spell it.
_DOT = r" ?(?:[(\[{<] ?(?:\.|dot) ?[)\]}>]|[(\[]?\. ?[)\]]?) ?| dot "
_SHORT = re.compile(rf"(?i)(?<![0-9])[0-9]{{1,3}}+(?![0-9])(?:(?:{_DOT})[0-9]{{1,3}}+(?![0-9])){{3,}}+")
_DOTS = re.compile(rf"(?i){_DOT}")
_SPELLED = re.compile(r"(?i)[(\[{<] ?(?:at|@) ?[)\]}>]| at [a-z0-9-]{1,40} (?:dot |[(\[{<] ?(?:dot|\.))")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def small(part: str) -> bool:
    """Whether a decimal number of any length is at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order. Kinds are scanned each on their own; a match that
    fails its check is dropped."""
    out = []
    if "@" in text:
        upto = 0
        for m in _AT.finditer(text):
            # The name before an @ reaches back to the last address at most.
            a = b = m.start()
            while a > upto and text[a - 1] in _LOCAL:
                a -= 1
            if a < b:
                out.append((a, 0, m.end()))
                upto = m.end()
    if not _DIGITS.search(text):
        return out
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(small, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def zones(text: str) -> list[tuple[int, int]]:
    """Where a segment other than a single unlabelled token can be."""
    out = []
    if _DIGITS.search(text):
        for m in _NUMBERS.finditer(text):
            if m.end() - m.start() >= 7 and sum("0" <= c <= "9" for c in m[0]) >= 7:
                out.append((m.start(), m.end()))
        out += [(m.start(), m.end()) for m in _SHORT.finditer(text) if len(_DOTS.findall(m[0])) == 3]
    for m in _SPELLED.finditer(text):
        a, b = max(0, m.start() - 48), min(len(text), m.end() + 64)
        while a and not text[a - 1].isspace() and m.start() - a < 112:
            a -= 1
        while b < len(text) and not text[b].isspace() and b - m.end() < 128:
            b += 1
        out.append((a, b))
    merged = []
    for a, b in sorted(out):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


_CUES = [
    re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel)\W*$"),
    re.compile(r"(?i)\b(?:ip|host|server|address|addr|adresse)\W*$"),
    re.compile(r"(?i)\b(?:card|visa|mastercard|amex|carte|karte|tarjeta|credit)\W*(?:number|no|nr)?\W*$"),
    re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|téléphone|teléfono)\W*$"),
]
_DATE = re.compile(r"(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})(?:[ T]\d.*)?$")
_NATIONAL = re.compile(r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}$")
_GROUPED = re.compile(r"(?:\+|00)?[\d]{1,4}(?:[ ./-]\(?\d{2,4}\)?){2,5}$")
_CARD_SHAPE = re.compile(r"\d{4}(?:[^\dA-Za-z]{1,3}\d{4}){3}$|\d{4}[^\dA-Za-z]{1,3}\d{6}[^\dA-Za-z]{1,3}\d{5}$")
_ADDRESS = re.compile(r"(?i)[a-z0-9][a-z0-9_+-]*(?:(?:\.| dot )[a-z0-9_+-]+)*(?: ?[(\[{<] ?(?:at|@) ?[)\]}>] ?| at )[a-z0-9-]+(?:(?:\.| dot | ?[(\[{<] ?(?:dot|\.) ?[)\]}>] ?)[a-z0-9-]+)*(?:\.| dot | ?[(\[{<] ?(?:dot|\.) ?[)\]}>] ?)[a-z]{2,12}$")
_OCTETS = re.compile(rf"(?i)([0-9]{{1,3}})(?:{_DOT})([0-9]{{1,3}})(?:{_DOT})([0-9]{{1,3}})(?:{_DOT})([0-9]{{1,3}})$")
#: Common endings of addresses, fixed values.
_ENDINGS = re.compile(r"(?i)[^a-z](?:com|org|net|edu|gov|info|io|eu|uk|us|de|fr|es|it|nl|ch)$")
FEATURES = 31
#: Columns of the features that a segment's digits decide, not only its shape.
_LUHN, _SMALL, _GLUED, _CLOSE, _BEFORE = 10, 13, 23, 24, 27
#: The patterns above name digits (0 and 1) only where a segment begins.
_HEAD, _TAIL = str.maketrans("23456789", "2" * 8), str.maketrans("0123456789", "2" * 10)
#: Tokens whose candidates are scored at once, and segment shapes that are remembered.
STEP, SHAPES = 1024, 1 << 14


def shape_features(s: str) -> list[float]:
    """Features of a segment that hold for all segments of its shape."""
    n, letters = sum("0" <= c <= "9" for c in s), sum(c.isalpha() for c in s)
    f = [1.0, n < 7, 7 <= n <= 9, n == 10, n == 11, 12 <= n <= 13, 14 <= n <= 15, n == 16, 17 <= n <= 19, n > 19]
    f += [False, bool(_CARD_SHAPE.match(s)), bool(_OCTETS.match(s)), False]
    f += [bool(_NATIONAL.match(s)), bool(_GROUPED.match(s)) and 9 <= n <= 13, s[0] == "+", s[:1] == "(" or s[:2] == "+(", bool(_DATE.match(s)), s.isdigit()]
    f += [bool(_ADDRESS.match(s)), bool(_ADDRESS.match(s) and _ENDINGS.search(s)), letters > 0, False, False, s[-1].isalnum(), s.count("(") != s.count(")")]
    return [float(x) for x in f] + [0.0] * len(_CUES)


class Zone:
    """Tokens of a zone, and the features of its candidate segments, some starts at once.
    ``taken``: base spans, which no segment may touch."""

    def __init__(self, text: str, a: int, b: int, taken: list[tuple[int, int, int]] = ()):
        self.text = text
        tokens = np.fromiter((x for m in _TOKEN.finditer(text, a, b) for x in m.span()), dtype=np.int64).reshape(-1, 2)
        self.start, self.end = tokens[:, 0], tokens[:, 1]
        self.a, part = a, text[a:b]
        self.head, self.tail = part.translate(_HEAD), part.translate(_TAIL)
        # Digits in front of each place, and checksums of all digits up to there, one for
        # each parity of the last digit's place.
        values = np.fromiter((ord(c) - 48 if "0" <= c <= "9" else -1 for c in part), dtype=np.int8, count=len(part))
        digits = values[values >= 0]
        self.before = np.concatenate(([0], np.cumsum(values >= 0, dtype=np.int32)))
        doubled = 2 * digits - 9 * (digits > 4)
        even = np.arange(len(digits)) % 2 == 0
        self.sums = [np.concatenate(([0], np.cumsum(np.where(even == bool(last), doubled, digits), dtype=np.int32))) for last in (0, 1)]
        union: list[list[int]] = []
        for x, _, y in sorted(taken):
            if union and x < union[-1][1]:
                union[-1][1] = max(union[-1][1], y)
            else:
                union.append([x, y])
        self.opens, self.closes = (np.array([u[k] for u in union], dtype=np.int64) for k in (0, 1))
        self.seen: dict[str, int] = {}
        self.known: list[list[float]] = []

    def candidates(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First token, token after the last, and features of the candidates that begin
        at tokens lo:hi."""
        n = len(self.start)
        i = np.repeat(np.arange(lo, hi), LONGEST)
        j = i + np.tile(np.arange(LONGEST), hi - lo)
        i, j = i[j < n], j[j < n]
        x, y = self.start[i], self.end[j]
        free = (y - x >= 7) & (np.searchsorted(self.closes, x, side="right") == np.searchsorted(self.opens, y))
        i, j, x, y = i[free], j[free], x[free], y[free]
        head, tail, seen, at = self.head, self.tail, self.seen, []
        for p, q in zip((x - self.a).tolist(), (y - self.a).tolist(), strict=True):
            s = head[p : p + 2] + tail[p + 2 : q]
            k = seen.get(s)
            if k is None:
                k = seen[s] = len(self.known)
                self.known.append(shape_features(s))
            at.append(k)
        rows = np.array(self.known).reshape(-1, FEATURES)[at]
        if len(seen) > SHAPES:
            self.seen, self.known = {}, []
        p, q = self.before[x - self.a], self.before[y - self.a]
        total = np.where((q - 1) % 2 == 0, self.sums[0][q] - self.sums[0][p], self.sums[1][q] - self.sums[1][p])
        rows[:, _LUHN] = (q - p >= 13) & (q - p <= 19) & (total % 10 == 0)
        for k in np.flatnonzero(rows[:, _SMALL - 1]).tolist():
            rows[k, _SMALL] = all(map(small, _OCTETS.match(self.text[x[k] : y[k]]).groups()))
        self.context(rows, i, j)
        return i, j + 1, rows

    def context(self, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Features of what stands before the first token and after the last."""
        text = self.text
        for own, side in ((i, 0), (j, 1)):
            for t in np.unique(own).tolist():
                x, y = int(self.start[t]), int(self.end[t])
                if side:
                    glued = y < len(text) and (text[y].isalnum() or text[y] in "_%")
                    close = y + 1 < len(text) and text[y] in ".,/-" and text[y + 1].isdigit()
                    cues = []
                else:
                    glued = x > 0 and (text[x - 1].isalnum() or text[x - 1] in "_#$€£")
                    close = x > 1 and text[x - 1] in ".,/-" and text[x - 2].isdigit()
                    words = text[max(0, x - 24) : x]
                    cues = [k for k, c in enumerate(_CUES) if c.search(words)] if any(c.isalpha() for c in words) else []
                if glued or close or cues:
                    mine = slice(*np.searchsorted(own, [t, t + 1])) if not side else np.flatnonzero(own == t)
                    rows[mine, _GLUED] = np.maximum(rows[mine, _GLUED], glued)
                    rows[mine, _CLOSE] = np.maximum(rows[mine, _CLOSE], close)
                    for k in cues:
                        rows[mine, _BEFORE + k] = 1.0

    def all(self) -> tuple[list[tuple[int, int]], np.ndarray]:
        """All candidates of a short zone."""
        i, j, rows = self.candidates(0, len(self.start))
        return list(zip(i.tolist(), j.tolist(), strict=True)), rows


def best_segments(zone: Zone, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the labelled segments of the best segmentation. An
    unlabelled token scores 0, so a segment that scores no more is never part of it."""
    n = len(zone.start)
    ending: dict[int, list[tuple[int, int, float]]] = {}
    for lo in range(0, n, STEP):
        i, j, rows = zone.candidates(lo, min(lo + STEP, n))
        scores = rows @ weights
        kind = scores.argmax(axis=1) if len(scores) else np.zeros(0, int)
        score = scores[np.arange(len(kind)), kind]
        for k in np.flatnonzero(score > 0).tolist():
            ending.setdefault(int(j[k]), []).append((int(i[k]), int(kind[k]), float(score[k])))
    best, back = np.zeros(n + 1), {}
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, k, score in ending.get(j, ()):
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, k)
    out, j = [], n
    while j:
        if j not in back:
            j -= 1
        else:
            i, k = back[j]
            out.append((int(zone.start[i]), k, int(zone.end[j - 1])))
            j = i
    return out[::-1]


def expectations(n: int, pairs: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
    """The probability of each candidate segment and type of ``n`` tokens, by
    forward-backward."""
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0.0
    mass = np.logaddexp.reduce(scores, axis=1)
    ending, opening = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for at, (i, j) in enumerate(pairs):
        ending[j].append((i, mass[at]))
        opening[i].append((j, mass[at]))
    for j in range(1, n + 1):
        forward[j] = np.logaddexp.reduce([forward[j - 1], *[forward[i] + m for i, m in ending[j]]])
    for i in range(n - 1, -1, -1):
        backward[i] = np.logaddexp.reduce([backward[i + 1], *[backward[j] + m for j, m in opening[i]]])
    i, j = np.array(pairs).T
    return np.exp(scores + (forward[i] + backward[j] - forward[n])[:, None])


def generated(n: int, seed: int = 11) -> Iterator[tuple[str, tuple[int, int, int] | None]]:
    """Sentences with one item each and its span, or None if it is nothing personal."""
    r = random.Random(seed)
    digit = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["an", "er", "ti", "lo", "ma", "re", "sh", "ou", "de", "la"]) for _ in range(r.randint(1, 3)))

    def phone() -> str:
        a, b, c = digit(3), digit(3), digit(4)
        sep = r.choice(" .-")
        return r.choice([f"({a}) {b}-{c}", f"{a}{sep}{b}{sep}{c}", f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"0{digit(1)} {digit(2)} {digit(2)} {digit(2)} {digit(2)}", f"00{digit(2)} {digit(3)} {digit(3)} {digit(4)}", f"+{digit(2)}/{digit(3)}/{digit(4)}/{digit(3)}"])

    def email() -> str:
        at = r.choice([" at ", " (at) ", "(at)", " [at] ", "[at]", " {at} "])
        dot = " dot " if at == " at " else r.choice([".", " dot ", " (dot) ", "[dot]"])
        name = word() + r.choice(["", "." + word(), "_" + word(), digit(2)])
        return f"{name}{at}{r.choice([word(), 'mail' + digit(1), 'example'])}{r.choice(['', dot + 'example'])}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io'])}"

    def ip() -> str:
        dot = r.choice(["[.]", "(.)", " . ", ". ", "[dot]", "(dot)", " [dot] ", " dot "])
        most = r.choice([9, 99, 255, 255])
        return dot.join(str(r.randint(0, most)) for _ in range(4))

    def card() -> str:
        while not luhn(d := r.choice("3456") + digit(15)):
            pass
        return r.choice([".", "/", " - ", "  "]).join(d[k : k + 4] for k in (0, 4, 8, 12))

    def nothing() -> str:
        y, m, d = r.randint(1900, 2030), r.randint(1, 12), r.randint(1, 28)
        return r.choice([f"{y}-{m:02}-{d:02}", f"{d:02}/{m:02}/{y}", f"{d:02}.{m:02}.{y} {digit(2)}:{digit(2)}", f"{y}-{m:02}-{d:02} {digit(2)}", f"{digit(1)},{digit(3)},{digit(3)}.{digit(2)}", f"{digit(3)}.{digit(6)}", digit(r.randint(7, 20)), f"{digit(4)} {digit(4)} {digit(4)} {digit(4)}", f"{digit(2)}.{digit(2)}.{digit(2)}.{digit(2)}.{digit(2)}", f"{digit(1)} {digit(2)} {digit(1)} {digit(3)} {digit(2)}", f"{y} {y + 1} {y + 2}", f"{y}-{y + 3}", f"{digit(3)}-{digit(2)}-{digit(4)}-{digit(1)}-{digit(1)}", f"{word()} at {word()} dot {word()} {word()}", "".join(r.choice("0123456789abcdef") for _ in range(32)), f"978-{digit(1)}-{digit(4)}-{digit(4)}-{digit(1)}", f"{digit(2)}/{digit(3)}-{digit(5)}", f"v{digit(1)}.{digit(2)}.{digit(4)}.{digit(1)}", f"9{digit(2)}.{digit(3)}.3{digit(2)}.{digit(3)}"])

    cues = [["email", "contact", "mail to"], ["ip", "host", "server"], ["card", "visa", "credit card number"], ["call", "phone", "tel."]]
    makers = [email, ip, card, phone]
    for _ in range(n):
        k = r.choice([0, 1, 2, 3, None, None, None, None])
        item = makers[k]() if k is not None else nothing()
        cue = r.choice(cues[r.randrange(4) if k is None else k]) + r.choice([" ", ": "]) if r.random() < 0.3 else ""
        left = " ".join(word() for _ in range(r.randint(0, 4)))
        left += " " * bool(left) + cue
        right = r.choice(["", ".", ",", " " + word(), " " + word() + " " + word() + "."])
        yield left + item + right, (None if k is None else (len(left), k, len(left) + len(item)))


@cache
def weights(n: int = 1200, epochs: int = 12) -> np.ndarray:
    """Fitted by gradient steps with Adagrad."""
    cases = []
    for text, span in generated(n):
        for a, b in zones(text):
            z = Zone(text, a, b, base_spans(text))
            pairs, rows = z.all()
            if not pairs:
                continue
            truth = np.zeros((len(pairs), len(KINDS)))
            for at, (i, j) in enumerate(pairs):
                if span and (int(z.start[i]), int(z.end[j - 1])) == (span[0], span[2]):
                    truth[at, span[1]] = 1
            cases.append((len(z.start), pairs, rows, truth))
    w = np.zeros((FEATURES, len(KINDS)))
    w[0] = -4.0
    squares = np.full_like(w, 1.0)
    order = random.Random(3)
    for _ in range(epochs):
        order.shuffle(cases)
        for n_tokens, pairs, rows, truth in cases:
            g = rows.T @ (truth - expectations(n_tokens, pairs, rows @ w)) - 1e-4 * w
            squares += g * g
            w += 0.5 * g / np.sqrt(squares)
    return w


def all_spans(text: str, w: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base and added ones together."""
    base = base_spans(text)
    added = []
    # Base spans of one kind are in order; those of a zone lie between two places.
    begins, reach = [s[0] for s in base], np.maximum.accumulate([s[2] for s in base]) if base else np.zeros(0, int)
    for a, b in zones(text):
        near = base[int(np.searchsorted(reach, a, side="right")) : bisect_left(begins, b)]
        if any(s[0] <= a and b <= s[2] for s in near):
            continue
        added += best_segments(Zone(text, a, b, near), w)
    return base, sorted(base + added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _find(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = [all_spans(t or "", w) for t in block.column(1).to_pylist()]
            counts = [[sum(s[1] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
            digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([block.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array([joined(s) for _, s in found]), pa.array([len(s) - len(base) for base, s in found], pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return run


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, their digest, all spans, and how many the
    field added."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_find(weights()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
