"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds to them.

The field tags tokens as secret begin, inside or outside from their shape, neighbouring tokens and
features of the file, and is decoded by Viterbi. A token may begin a secret if it has eight or more
characters and a digit, changes from lower to upper case, is long and of high entropy, follows a
credential name within NAMED tokens or an assignment mark within MARKED; only a token that touches
the one before may continue it; all others are outside by construction. So the best path of a text falls apart into those of its runs of
free tokens, each between two outside tokens, and decoding runs one by one is exact. A run may be as long as its text: tokens
stream through the decoder, which holds the best path into each tag as its spans alone.

Trained on tags that the patterns give, by a bounded sample of distinct runs (one half of it is for runs with
a tagged secret, the other for runs without), and on made-up lines: credentials of many forms, most of which no
pattern knows, and look-alikes such as dates, addresses, versions and identifiers.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import random
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narae.llm.shared import materialise, small_batches, tidy

KINDS = ("assign", "access", "hex", "crf")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
KEYWORDS = (b"passw", b"secret", b"token", b"api")
#: Names that announce a credential.
NAMES = frozenset(b"password passwd pwd secret token key api apikey api_key access auth authorization bearer credential credentials private".split())
#: Begins of well-known credential forms.
PREFIXES = (b"AKIA", b"ASIA", b"ghp_", b"gho_", b"sk-", b"xox", b"eyJ", b"AIza", b"glpat")

#: Distinct training runs at most (a half each with and without a secret), epochs, step and L2 weight.
MOST_RUNS, EPOCHS, STEP, L2 = 4000, 12, 0.2, 1e-3
#: Runs longer than this are decoded in the same way but not trained on.
LONGEST_RUN = 64

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
_TOKEN = re.compile(rb"[A-Za-z0-9+/_-]+|[^\sA-Za-z0-9+/_-]")
#: Tokens after a credential name and after an assignment mark that are free to begin a secret.
NAMED, MARKED = 5, 2
#: Least length and bits a character of tokens that are free by their entropy.
LEAST_LONG, LEAST_BITS = 16, 3.5
_NUMBER = re.compile(rb"[0-9]+")
_CASED = re.compile(rb"[a-z][A-Z]")
_LONG = re.compile(rb"[A-Za-z0-9+/_-]{%d,}" % LEAST_LONG)
_ASSIGNED = re.compile(rb"[:=]")
_WORD = re.compile(rb"\S+")
_ALIKE = re.compile(rb"[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]+")
_BLANK, _OF_TOKEN = frozenset(b" \t\n\r\x0b\x0c"), frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
#: Tokens before one that may name it, and tokens whose scores are remembered, with their greatest length.
BACK, REMEMBERED, LONGEST_REMEMBERED = 5, 1 << 15, 64
_DIGITS = b"0123456789"
_HEX_FLAG = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))

Span = tuple[int, int]
Token = tuple[int, int, bytes, bool]
Scores = tuple[float, float, float]
#: Features, penalties and tags of a run, and how often it occurs.
Sample = tuple[list[list[str]], np.ndarray, list[int], int]


# --- patterns --------------------------------------------------------------------------------


def base_matches(text: bytes) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, start of the secret itself) in bytes; leftmost, non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(0, m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if b"AKIA" in text:
        out += [(1, m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"\x01" * LEAST_HEX in text.translate(_HEX_FLAG):
        out += [(2, m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda m: (m[1], m[0]))


# --- tokens and features ---------------------------------------------------------------------


_NAMES = re.compile(rb"(?<![A-Za-z0-9+/_-])(?:%s)(?![A-Za-z0-9+/_-])" % b"|".join(sorted(NAMES, key=len, reverse=True)))


def _bits(token: bytes) -> float:
    """Entropy of a token's bytes."""
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values())


def may_begin(token: bytes) -> bool:
    """Whether a token may begin a secret wherever it stands."""
    if len(token) >= 8 and _NUMBER.search(token):
        return True
    return _CASED.search(token) is not None or len(token) >= LEAST_LONG and _bits(token) >= LEAST_BITS


def _announced(text: bytes) -> bytearray:
    """1 at the starts of the tokens that a name or an assignment mark announces; single marks are none."""
    low = text.lower()
    out = bytearray(len(text))

    def announce(pattern: re.Pattern, data: bytes, most: int) -> None:
        for mark in pattern.finditer(data):
            for _, m in zip(range(most), _TOKEN.finditer(text, mark.end())):
                if m.group()[:1].isalnum() or m.end() - m.start() > 1:
                    out[m.start()] = 1

    announce(_ASSIGNED, text, MARKED)
    if any(n in low for n in NAMES):
        announce(_NAMES, low, NAMED)
    return out


def run_tokens(text: bytes) -> Iterator[tuple[bool, Token]]:
    """The tokens of the maximal runs that are free to be other than outside, and whether each starts a run.

    The last field of a token: free to begin. Holds a flag a byte and eight bytes a place, whatever a run's length.
    """
    announced = _announced(text)
    places = [np.flatnonzero(np.frombuffer(announced, np.uint8))]
    places += [np.fromiter((m.start() for m in p.finditer(text)), np.int64) for p in (_CASED, _LONG, _NUMBER)]
    places = np.unique(np.concatenate(places))
    last, k = -1, 0
    while k < len(places):
        start = int(places[k])  # every token that may begin holds a place
        done, inside = _WORD.match(text, start).end(), False
        while start and text[start] in _OF_TOKEN and text[start - 1] in _OF_TOKEN:
            start -= 1
        for m in _TOKEN.finditer(text, start, done):
            begins = announced[m.start()] == 1 or may_begin(m.group())
            if not inside and not begins:
                done = m.end()
                break
            # neighbours with only a blank between share a path
            yield not inside and (last < 0 or last == m.start() or bool(text[last : m.start()].strip())), (m.start(), m.end(), m.group(), begins)
            inside, last = True, m.end()
        k = int(np.searchsorted(places, done))


def runs(text: bytes, longest: int | None = None) -> Iterator[list[Token]]:
    """The runs one by one; those of more than ``longest`` tokens are left out without being held."""
    run: list[Token] = []
    for first, token in run_tokens(text):
        if first:
            if run and (longest is None or len(run) <= longest):
                yield run
            run = []
        if longest is None or len(run) <= longest:
            run.append(token)
    if run and (longest is None or len(run) <= longest):
        yield run


def file_features(text: bytes) -> list[str]:
    size = max(len(text), 1)
    code = sum(text.count(c) for c in (b"{", b"}", b";", b"=", b"<"))
    digits = len(text) - len(text.translate(None, _DIGITS))
    return [f"file:code={min(3, int(200 * code / size))}", f"file:digits={min(3, int(50 * digits / size))}"]


def _shape(token: bytes) -> list[str]:
    n = len(token)
    counts = Counter(token)
    digits, upper, lower = (sum(counts[c] for c in part) for part in (range(48, 58), range(65, 91), range(97, 123)))
    switches = (sum(1 for _ in _ALIKE.finditer(token)) - 1) / n
    entropy = _bits(token)
    out = [f"length={min(7, n.bit_length() * 2 + (n >> (n.bit_length() - 2) & 1) - 6)}" if n > 1 else "length=1", f"switches={min(4, int(switches * 8))}", f"entropy={min(8, int(entropy * 2))}"]
    out.append("case=" + "".join(name for name, k in (("d", digits), ("U", upper), ("l", lower), ("s", n - digits - upper - lower)) if k))
    if digits < n and all(c in b"0123456789abcdef" for c in counts):
        out.append("hex")
    if digits == n:
        out.append("number")
    out += [f"prefix={p.decode()}" for p in PREFIXES if token.startswith(p)]
    return out


def _preceding(text: bytes, at: int) -> list[tuple[int, bytes]]:
    """(end, token) of the BACK tokens before a token's start, whole, in order."""
    out: list[tuple[int, bytes]] = []
    while len(out) < BACK:
        while at and text[at - 1] in _BLANK:
            at -= 1
        if not at:
            break
        end = at
        at -= 1
        while text[end - 1] in _OF_TOKEN and at and text[at - 1] in _OF_TOKEN:
            at -= 1
        out.append((end, text[at:end]))
    return out[::-1]


def _named(token: bytes) -> bool:
    return len(token) < LONGEST_REMEMBERED and token.lower() in NAMES


Around = tuple[str, ...]


def surroundings(text: bytes, run: Iterable[Token]) -> Iterator[Around]:
    """For each token of a run, the features of its neighbours."""
    place = name_at = -BACK - 1  # numbers of the token and of the last name
    left_end, left = -1, b""
    for start, end, token, _ in run:
        if left_end < 0:
            before = _preceding(text, start)
            left_end, left = before[-1] if before else (0, b"")
            name_at = max((k - len(before) for k, (_, t) in enumerate(before) if _named(t)), default=name_at)
            place = 0
        kind = left.decode(errors="replace") if len(left) == 1 else "name" if name_at == place - 1 else "word"
        follower = text[end : end + 2]
        single = follower and follower[0] not in _BLANK and not (len(follower) == 2 and follower[0] in _OF_TOKEN and follower[1] in _OF_TOKEN)
        after = follower[:1].decode(errors="replace") if single else "other"
        out = ("gap=1" if left_end < start else "gap=0", f"before={kind}", f"after={after}")
        yield (*out, "named") if place - name_at <= BACK else out
        if _named(token):
            name_at = place
        left_end, left, place = end, token, place + 1


def features(text: bytes, run: list[Token], of_file: list[str]) -> list[list[str]]:
    """Active features of each token of a run."""
    return [["bias", *of_file, *_shape(token[2]), *around] for token, around in zip(run, surroundings(text, run))]


def allowed(run: list[Token]) -> np.ndarray:
    """For each token, the tags it may have, as penalties."""
    out = np.full((len(run), 3), -np.inf)
    out[:, OUTSIDE] = 0
    for k, (start, _, _, begins) in enumerate(run):
        if begins:
            out[k, BEGIN] = 0
        if k and run[k - 1][1] == start:
            out[k, INSIDE] = 0
    return out


def weak_tags(run: list[Token], matches: list[tuple[int, int, int, int]]) -> list[int]:
    """Tags by the patterns' secrets; plain numbers are no secrets, whatever pattern they meet."""
    tags = [OUTSIDE] * len(run)
    for kind, _, end, start in matches:
        inside = False
        for k, (a, b, token, begins) in enumerate(run):
            if a >= start and b <= end and not (kind == 2 and token.isdigit()):
                if inside and run[k - 1][1] == a:
                    tags[k] = INSIDE
                elif begins:
                    tags[k] = BEGIN
                inside = tags[k] != OUTSIDE
            else:
                inside = False
    return tags


# --- made-up lines ---------------------------------------------------------------------------

_LOWER, _UPPER, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
_MIXED = _LOWER + _UPPER + "0123456789"
#: Credentials by form: what stands around one, and how its parts are drawn (alphabet, least and most length).
CREDENTIALS = {
    "pwd": ("pwd: {}", [(_MIXED, 8, 16)]), "passwd": ("passwd {}", [(_MIXED, 10, 18)]), "bearer": ("Authorization: Bearer {}", [(_MIXED + "-_", 24, 48)]),
    "basic": ("authorization basic {}", [(_MIXED + "+/", 20, 40)]), "letters": ("secret key {}", [(_LOWER + _UPPER, 16, 32)]), "private": ("private key = {}", [(_MIXED + "+/", 32, 64)]),
    "prefixed": ("{}", [("ghp_", 0, 0), (_MIXED, 36, 36)]), "dashed": ("{}", [("xoxb-", 0, 0), ("0123456789", 10, 12), ("-", 0, 0), (_MIXED, 24, 24)]), "short": ("{}", [("sk-", 0, 0), (_MIXED, 32, 48)]),
    "cloud": ("{}", [("AIza", 0, 0), (_MIXED + "-_", 35, 35)]), "web": ("auth {}", [("eyJ", 0, 0), (_MIXED, 20, 30), (".eyJ", 0, 0), (_MIXED, 30, 60), (".", 0, 0), (_MIXED + "-_", 43, 43)]),
    "session": ("access credentials: {}", [(_HEX, 32, 40)]), "assigned": ("export KEY={}", [(_MIXED, 20, 40)]), "quoted": ('"credential": "{}"', [(_MIXED, 20, 32)]),
}
#: Look-alikes that are no secrets, in the same way.
LOOKALIKES = {
    "date": ("on {}", [("2024-0", 0, 0), ("123456789", 1, 1), ("-1", 0, 0), ("0123456789", 1, 1), ("T10:", 0, 0), ("12345", 2, 2), (":00Z", 0, 0)]), "phone": ("call {}", [("+1 (", 0, 0), ("23456789", 3, 3), (") 555-", 0, 0), ("0123456789", 4, 4)]),
    "address": ("see {}", [("https://example.org/", 0, 0), (_LOWER, 4, 9), ("/", 0, 0), (_LOWER, 3, 8), ("?page=", 0, 0), ("0123456789", 1, 4)]), "version": ("release {}", [("v", 0, 0), ("123456789", 1, 2), (".", 0, 0), ("0123456789", 1, 3), (".", 0, 0), ("0123456789", 1, 5)]),
    "camel": ("call {} first", [("get", 0, 0), (_UPPER, 1, 1), (_LOWER, 3, 8), (_UPPER, 1, 1), (_LOWER, 3, 8)]), "file": ("in {}", [("src/", 0, 0), (_LOWER, 3, 8), ("/", 0, 0), (_UPPER, 1, 1), (_LOWER, 4, 9), ("2.java", 0, 0)]),
    "uuid": ("record {}", [(_HEX, 8, 8), ("-", 0, 0), (_HEX, 4, 4), ("-4", 0, 0), (_HEX, 3, 3), ("-a", 0, 0), (_HEX, 3, 3), ("-", 0, 0), (_HEX, 12, 12)]), "number": ("order {} of", [("0123456789", 8, 16)]),
    "mail": ("write to {}", [(_LOWER, 3, 8), (".", 0, 0), (_LOWER, 4, 9), ("0123456789", 1, 3), ("@example.com", 0, 0)]), "time": ("token: at {}", [("1", 0, 0), ("012", 1, 1), (":", 0, 0), ("12345", 2, 2)]), "key": ("the key to {}", [(_LOWER, 4, 10)]),
    "named": ("a note: {}", [(_UPPER, 1, 1), (_LOWER, 4, 10)]), "product": ("model {}", [(_UPPER, 2, 3), ("0123456789", 3, 5), ("-", 0, 0), (_UPPER, 1, 2)]),
}
#: Made-up lines of each form.
MADE = 24


def made_lines(forms: dict, each: int = MADE, seed: int = 0) -> Iterator[tuple[str, bytes, Span]]:
    """(form, line, where the drawn value stands in it). The same for the same seed."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(_LOWER, k=rng.randint(2, 9)))
    for form, (template, parts) in sorted(forms.items()):
        for _ in range(each):
            drawn = "".join("".join(rng.choices(alphabet, k=rng.randint(least, most))) if most else alphabet for alphabet, least, most in parts)
            head, tail = template.split("{}")
            before = "".join(word() + " " for _ in range(rng.randint(0, 6))) + head
            after = tail + "".join(" " + word() for _ in range(rng.randint(0, 6)))
            yield form, (before + drawn + after).encode(), (len(before), len(before) + len(drawn))


def made_runs(credentials: dict | None = None, lookalikes: dict | None = None) -> list[Sample]:
    out = []
    for forms, secret in ((CREDENTIALS if credentials is None else credentials, True), (LOOKALIKES if lookalikes is None else lookalikes, False)):
        for _, line, (a, b) in made_lines(forms):
            of_file = file_features(line)
            for run in runs(line):
                tags = weak_tags(run, [(3, a, b, a)] if secret else [])
                out.append((features(line, run, of_file), allowed(run), tags, 1))
    return out


# --- the field -------------------------------------------------------------------------------


class Field:
    """Weights of a linear-chain conditional random field over three tags."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move
        self.remembered: dict[tuple | bytes, Scores] = {}

    def scores(self, key: tuple | bytes) -> Scores:
        """The summed weights of a token's shape, or of a tuple of features."""
        out = self.remembered.get(key)
        if out is None:
            known = [self.names[f] for f in (_shape(key) if isinstance(key, bytes) else key) if f in self.names]
            out = tuple(self.emit[known].sum(axis=0).tolist())
            if len(key) <= LONGEST_REMEMBERED:
                if len(self.remembered) >= REMEMBERED:
                    self.remembered.clear()
                self.remembered[key] = out
        return out

    def spans(self, text: bytes, tokens: Iterable[Token], of_file: list[str]) -> list[Span]:
        """The spans of a run's best path between two outside tokens.

        Of the best path into each tag, its score and spans are held: those behind as a chain that paths share,
        and the last one. Of equal paths, that with the lower tag wins.
        """
        move = self.move.tolist()
        to_outside, to_begin, to_inside = ([row[tag] for row in move] for tag in (OUTSIDE, BEGIN, INSIDE))
        base = self.scores(("bias", *of_file))
        never = (-math.inf, None, None)
        # (score, chain of spans, open span) by the tag of the token before, which is outside at first
        paths = ((0.0, None, None), never, never)
        touched = -1
        held: deque[Token] = deque()

        def best(to: list[float]) -> tuple[float, tuple | None, Span | None]:
            score, at = paths[0][0] + to[0], 0
            for k in (BEGIN, INSIDE):
                if paths[k][0] + to[k] > score:
                    score, at = paths[k][0] + to[k], k
            return score, paths[at][1], paths[at][2]

        def passed() -> Iterator[Token]:
            for token in tokens:
                held.append(token)
                yield token

        for around in surroundings(text, passed()):
            start, end, token, begins = held.popleft()
            shape, near = self.scores(token), self.scores(around)
            score, chain, last = best(to_outside)
            outside = (score + base[0] + shape[0] + near[0], (chain, last) if last else chain, None)
            begin = inside = never
            if begins:
                score, chain, last = best(to_begin)
                begin = (score + base[1] + shape[1] + near[1], (chain, last) if last else chain, (start, end))
            if touched == start:
                score, chain, last = best(to_inside)
                if last:
                    inside = (score + base[2] + shape[2] + near[2], chain, (last[0], end))
            paths, touched = (outside, begin, inside), end
        _, chain, last = best(to_outside)
        out = [last] if last else []
        while chain:
            chain, span = chain
            out.append(span)
        return out[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _transitions(free: np.ndarray) -> np.ndarray:
    out = free.copy()
    out[OUTSIDE, INSIDE] = -np.inf
    return out


def train(samples: list[Sample]) -> Field:
    """Maximum conditional likelihood with an L2 penalty, by per-run gradient steps in a fixed order.

    A run that occurs n times counts 1 + ln(n), so that steps stay small.
    """
    names = {f: k for k, f in enumerate(sorted({f for rows, *_ in samples for row in rows for f in row}))}
    emit, free = np.zeros((len(names) + 1, 3)), np.zeros((3, 3))
    coded = [([[names[f] for f in row] for row in rows], mask, tags, 1 + math.log(n)) for rows, mask, tags, n in samples]
    for epoch in range(EPOCHS):
        for known, mask, tags, weight in coded:
            step = STEP * weight / (1 + epoch)
            move = _transitions(free)
            scores = np.array([emit[k].sum(axis=0) for k in known]) + mask
            n = len(scores)
            ahead, behind = np.empty((n, 3)), np.empty((n, 3))
            ahead[0] = scores[0] + move[OUTSIDE]
            for t in range(1, n):
                ahead[t] = scores[t] + _log_sum(ahead[t - 1][:, None] + move, 0)
            behind[-1] = move[:, OUTSIDE]
            for t in range(n - 2, -1, -1):
                behind[t] = _log_sum(move + (scores[t + 1] + behind[t + 1])[None, :], 1)
            total = _log_sum(ahead[-1] + behind[-1], 0)
            odds = -np.exp(ahead + behind - total)
            odds[np.arange(n), tags] += 1
            for t, k in enumerate(known):
                emit[k] += step * odds[t]
            path = [OUTSIDE, *tags, OUTSIDE]
            grad = np.zeros((3, 3))
            np.add.at(grad, (path[:-1], path[1:]), 1)
            grad[OUTSIDE] -= np.exp(ahead[0] + behind[0] - total)
            grad[:, OUTSIDE] -= np.exp(ahead[-1] + behind[-1] - total)
            for t in range(1, n):
                grad -= np.exp(ahead[t - 1][:, None] + move + (scores[t] + behind[t])[None, :] - total)
            free += step * grad
        emit *= 1 - L2
        free *= 1 - L2
    return Field(names, emit, _transitions(free))


def field_spans(text: bytes, field: Field) -> list[Span]:
    """Byte spans that the field tags as secrets. Beside the text, memory grows with its places and spans only."""
    out: list[Span] = []
    of_file: list[str] | None = None
    for _, run in groupby(_numbered(text), key=lambda t: t[0]):
        of_file = of_file or file_features(text)
        out += field.spans(text, (token for _, token in run), of_file)
    return out


def _numbered(text: bytes) -> Iterator[tuple[int, Token]]:
    number = 0
    for first, token in run_tokens(text):
        number += first
        yield number, token


# --- DataFrames ------------------------------------------------------------------------------


def _texts(column: pa.Array) -> Iterator[bytes]:
    for v in column:
        yield v.as_buffer().to_pybytes() if v.is_valid else b""


def training_runs(docs: DataFrame, most: int = MOST_RUNS) -> list[Sample]:
    """At most ``most`` distinct runs (by features and weak tags) with their numbers, those of the smallest
    hash: up to a half of them with a tagged secret, and as many without. Copies take no further place.

    A task passes on no more than its own smallest hashes, which hold all of its runs that are among the
    smallest of all; before runs come to the driver, a threshold on the hash leaves some three times as many.
    """
    half = {True: most // 2, False: most - most // 2}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, dict[str, list]] = {True: {}, False: {}}
        least = {True: "~", False: "~"}  # keys beyond are not among the smallest

        def smallest(secret: bool) -> list[str]:
            return heapq.nsmallest(half[secret], held[secret])

        for batch in batches:
            for text in _texts(batch.column(0)):
                matches = None
                for run in runs(text, LONGEST_RUN):
                    if matches is None:
                        matches, of_file = base_matches(text), file_features(text)
                        starts, longest = [m[1] for m in matches], max((m[2] - m[1] for m in matches), default=0)
                    near = matches[bisect_left(starts, run[0][0] - longest) : bisect_left(starts, run[-1][1])]
                    tags = weak_tags(run, near)
                    sample = json.dumps([features(text, run, of_file), np.isfinite(allowed(run)).astype(int).tolist(), tags])
                    key, secret = hashlib.md5(sample.encode()).hexdigest(), any(tags)
                    if key <= least[secret]:
                        held[secret].setdefault(key, [sample, 0])[1] += 1
                    if len(held[secret]) >= 2 * half[secret] + 1000:
                        kept = smallest(secret)
                        held[secret], least[secret] = {k: held[secret][k] for k in kept}, kept[-1] if kept else ""
        found = [(k, secret, *held[secret][k]) for secret in (True, False) for k in smallest(secret)]
        kinds = (pa.string(), pa.bool_(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found)) or [[]] * 4, kinds)], names=["key", "secret", "sample", "n"])

    sampled = docs.select(F.encode("text", "UTF-8").alias("text")).mapInArrow(tidy(rows), "key string, secret boolean, sample string, n long")
    sampled = materialise(sampled.groupBy("key", "secret").agg(F.first("sample").alias("sample"), F.sum("n").alias("n")), "training-runs")
    number = dict(sampled.groupBy("secret").count().collect())

    def taken(secret: bool) -> DataFrame:
        share = min(1.0, 3.0 * half[secret] / max(number.get(secret, 0), 1))
        below = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") < F.lit(int(share * 2**32))
        return sampled.where((F.col("secret") == secret) & below).orderBy("key").limit(half[secret])

    out = []
    for r in sorted(taken(True).unionByName(taken(False)).collect(), key=lambda r: r.key):
        rows_, mask, tags = json.loads(r.sample)
        out.append((rows_, np.where(np.array(mask, dtype=bool), 0.0, -np.inf), tags, r.n))
    return out


def fit_field(docs: DataFrame, most: int = MOST_RUNS) -> Field:
    return train([*made_runs(), *training_runs(docs, most)])


def _points(text: bytes, offsets: list[int]) -> dict[int, int]:
    """Byte offsets as code points."""
    starts = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, dtype=np.int32)
    return {o: int(starts[o - 1]) if o else 0 for o in offsets}


def secret_spans(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, spans): kind, start and end (code points, end exclusive) by start, then kind as listed.

    Pattern spans stay as they are. A span of the field that meets none of them is added as ``crf``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in _texts(batch.column(1)):
                spans = [m[:3] for m in base_matches(text)]  # by start
                starts, ends = [s[1] for s in spans], [0, *accumulate((s[2] for s in spans), max)]
                # A span meets a pattern's if one of those that start before its end ends behind its start.
                spans += [(3, a, b) for a, b in field_spans(text, shared.value) if ends[bisect_left(starts, b)] <= a]
                if spans:
                    at = _points(text, [o for s in spans for o in s[1:]])
                    spans.sort(key=lambda s: (s[1], s[0]))
                    found.append([{"kind": KINDS[k], "start": at[a], "end": at[b]} for k, a, b in spans])
                else:
                    found.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    ident = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.encode("text", "UTF-8").alias("text")).mapInArrow(tidy(rows), f"doc_id {ident}, spans array<struct<kind:string,start:int,end:int>>")


def secret_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each document.

    Null texts count as empty and have no spans; repeated rows give repeated rows.
    """
    small_batches(docs.sparkSession)
    found = secret_spans(docs, fit_field(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
