"""Personal data by fixed patterns and a semi-Markov conditional random field.

The base kinds (email, ip, card, phone) are fixed patterns with checks; their spans always stay. The field adds
spans that the patterns miss: written-out addresses, numbers without a plus sign, cards with dots, and a fifth
kind, secret: passwords, tokens and keys, told by their name or by an issuer's prefix. It scores whole candidate
segments of at most LONGEST tokens and WIDEST characters (secrets: SECRET characters) by features of the entire
span and of its borders, and a dynamic programme over a stretch of text chooses boundaries and kinds together;
weights are trained by the likelihood of sentences made from templates. Only stretches around digits, @,
written-out signs and names of secrets are looked at: elsewhere no segment is a candidate, so nothing else than
"outside" is possible there. An added span never overlaps a base span.

Edge cases: null texts count as empty, which have no spans and the digest of an empty string; the work grows
with a text's length, also in long runs of digits, numbers and marks; repeated rows and further columns stay; spans of one start are ordered by
kind; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits

KINDS = ("email", "ip", "card", "phone")
#: What the field tells apart.
LABELS = (*KINDS, "secret")
LONGEST, WIDEST, SECRET = 24, 160, 400
#: Groups of digits and digits of a number.
GROUPS, DIGITS = 6, 19
#: Tokens at which segments begin that are scored at once.
STARTS = 1 << 14
#: Characters of context on either side of a stretch.
CONTEXT = 24

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_RUN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _is_byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by start, then kind."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_SET:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            found.append(("email", start, match.end()))
            end = match.end()
        at = text.find("@", max(at + 1, end))
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            # A match takes the next four numbers of a run; what stands before ".." ends one.
            for part in _RUN.finditer(text, *run.span()):
                numbers = [m.span() for m in _GROUPS.finditer(text, *part.span())]
                for i in range(0, len(numbers) - 3, 4):
                    if all(_is_byte(text[x:y]) for x, y in numbers[i : i + 4]):
                        found.append(("ip", numbers[i][0], numbers[i + 3][1]))
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 12:
            digits = _NOT_DIGIT.sub("", match[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", match.start(), match.end()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", match[0])) <= 15:
                found.append(("phone", match.start(), match.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# --- The field ---

#: Names of secrets, and prefixes that issuers of keys give them.
_NAMES = r"(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|credential)s?"
ISSUERS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "rk_live_", "pk_live_", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "npm_", "hf_", "eyJ")
_ISSUED = re.compile(rf"(?:AKIA|ASIA)[A-Z0-9]{{16}}|(?:{'|'.join(ISSUERS[2:])})[A-Za-z0-9_.-]{{12,}}")
_SIGN = r"""["']?\s{0,2}[:=]\s{0,2}["']?"""
_RUN_OF = "[A-Za-z0-9_+/-]"
_VALUE = rf"""[^\s"',;]{{4,{SECRET}}}+"""
_STRETCH = re.compile(r"@|\(?[0-9][0-9().\-/ ]{5,}[0-9]|[(\[ ]at[)\] ] ?[\w-]{1,40} ?[(\[ ]dot[)\] ]", re.IGNORECASE | re.ASCII)
_DIGIT, _EQUALS = re.compile(r"[0-9]"), re.compile(r"[:=]")
_RUN_SET = _LOCAL_SET - frozenset(".%") | {"/"}
_REST = re.compile(rf"{_RUN_OF}*+")
_CALLS = re.compile(rf"""{_NAMES}["']?\s{{0,2}}$""", re.IGNORECASE | re.ASCII)
_GIVEN = re.compile(rf"""\s{{0,2}}["']?{_VALUE}""")
#: What makes a span a part of a longer one.
_CUT = re.compile(r"""[^\s"',;]*[^\s"',;.:!?)\]}>]|[.:!?)\]}>]+["']""")
_KEY = re.compile(rf"(?<!{_RUN_OF})(?:eyJ[A-Za-z0-9_-]{{6,200}}+\.[A-Za-z0-9_-]{{6,200}}+\.[A-Za-z0-9_-]{{6,200}}+|{_RUN_OF}{{8,{SECRET}}}+)(?!{_RUN_OF})(?:={{1,2}}(?![A-Za-z0-9=]))?")
_ASSIGNED = re.compile(rf"{_NAMES}{_SIGN}({_VALUE})", re.IGNORECASE | re.ASCII)
_NAMED = re.compile(rf"{_NAMES}{_SIGN}$", re.IGNORECASE | re.ASCII)
_HEX = re.compile(r"[0-9a-f]{12,}|[0-9A-F]{12,}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_PARTS = re.compile(r"[^A-Za-z0-9]+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.ASCII | re.DOTALL)
_BEGUN = r"[a-z0-9._%+-]{1,64} ?(\(at\)|\[at\]|\sat\s|@)"
_AT = re.compile(_BEGUN, re.IGNORECASE | re.ASCII)
_WRITTEN = re.compile(_BEGUN + r" ?[a-z0-9-]{1,63}( ?(\(dot\)|\[dot\]|\sdot\s|\.) ?[a-z0-9-]{1,63})+", re.IGNORECASE | re.ASCII)
_MARKED = re.compile(r"[(\[ ](at|dot)[)\] ]", re.IGNORECASE)
_GROUPS = re.compile(r"[0-9]+")
_DATE = re.compile(r"([12][0-9]{3}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2})|([0-9]{1,2}[-/. ][0-9]{1,2}[-/. ][0-9]{2,4})")
_NUMBER_BEFORE, _NUMBER_AFTER = re.compile(r"[0-9][-./ ]$"), re.compile(r"[-./ ][0-9]")
#: Marks inside numbers, each a bit; all blanks are one kind of mark, and so are all others.
MARKS = {".": 1, "-": 2, "/": 4, "(": 8, ")": 16}
BLANK, OTHER = 32, 64
_KINDS_OF_MARKS = np.array([n.bit_count() for n in range(128)])
#: Words before a number that name its kind.
CALLED = {"phone": ("tel", "phone", "call", "fax", "mobile", "cell"), "card": ("card", "visa", "mastercard", "amex", "credit"), "ip": ("ip", "host", "address", "server"), "email": ("mail", "email", "contact", "write")}
(
    ALWAYS, WRITTEN, MARKED, AT_SIGN, AS_PHONE, AS_CARD, LUHN, FOURS, FOUR_BYTES, LOCAL, AREA, ONE_GROUP, ONE_MARK, MIXED_MARKS, SLASH, DATE, INSIDE, AFTER_SIGN,
    NAMED_PHONE, NAMED_CARD, NAMED_IP, NAMED_EMAIL, UNBALANCED, FEW_DIGITS,
    KEY, NAMED_KEY, ISSUED, NO_DIGIT, HEX, UUID, CHANGES, CASES, PLAIN_PARTS, SIXTEEN, MONOTONE,
) = range(35)
FEATURES = 35


class Borders:
    """Features of what stands before a token and after one."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.text, self.tokens = text, tokens

    def before(self, i: int) -> tuple[bool, bool, list[bool]]:
        """Inside a number or word, after a sign, and called by each kind's words."""
        at = self.tokens[i][0]
        before = self.text[max(0, at - CONTEXT) : at]
        context = before[-16:].lower()
        inside = before[-1:].isalnum() or bool(_NUMBER_BEFORE.search(before))
        return inside, before[-1:] in tuple("$#=€£%:"), [any(w in context for w in CALLED[k]) for k in ("phone", "card", "ip", "email")]

    def after(self, j: int) -> bool:
        """Inside a number or word."""
        at = self.tokens[j][1]
        return self.text[at : at + 1].isalnum() or bool(_NUMBER_AFTER.match(self.text, at))


def numbers(text: str, tokens: list[tuple[int, int]], starts: np.ndarray, borders: Borders) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First tokens, last tokens and features of the numbers that begin at `starts`, all of a length at once.

    A number begins with a digit or a bracket, ends with a digit, and holds digits and marks but no letters.
    """
    if not len(starts):
        return
    low, high = int(starts[0]), min(len(tokens), int(starts[-1]) + LONGEST)
    head = [text[tokens[t][0]] for t in range(low, high)]
    size = np.array([b - a for a, b in tokens[low:high]])
    begin = np.array([a for a, _ in tokens[low:high]])
    digit = np.array(["0" <= c <= "9" for c in head])
    word = np.array([c == "@" or c.isascii() and c.isalpha() for c in head])
    mark = np.array([0 if d else MARKS.get(c, BLANK if c.isspace() else OTHER) for c, d in zip(head, digit, strict=True)])
    wide = np.array([d and not _is_byte(text[a : a + n]) if n <= 3 else d for d, a, n in zip(digit, begin, size, strict=True)])
    # Borders of a token are looked at when a segment first needs them.
    left, right, seen = np.zeros((len(head), 6), bool), np.zeros(len(head), bool), np.zeros((2, len(head)), bool)
    first = starts - low
    count = {name: np.zeros(len(first), np.int64) for name in ("digits", "groups", "marks", "open", "close", "lead", "one", "two", "three", "odd", "wide", "longest")}
    for d in range(LONGEST):
        keep = first + d < len(head)
        keep[keep] &= ~word[first[keep] + d]
        keep[keep] &= begin[first[keep] + d] + size[first[keep] + d] - begin[first[keep]] <= WIDEST
        keep &= (count["digits"] <= DIGITS) & (count["groups"] <= GROUPS)
        first, count = first[keep], {k: v[keep] for k, v in count.items()}
        if not len(first):
            return
        at = first + d
        own, length = digit[at], size[at]
        number = np.where(own, length, 0)
        count["digits"] += number
        count["groups"] += own
        count["marks"] |= mark[at]
        count["open"] += mark[at] == MARKS["("]
        count["close"] += mark[at] == MARKS[")"]
        count["lead"] = np.where(own & (count["groups"] == 1), number, count["lead"])
        for old, new in (("three", count["two"]), ("two", count["one"]), ("one", number)):
            count[old] = np.where(own, new, count[old])
        count["odd"] += own & ((length < 3) | (length > 6))
        count["wide"] += wide[at]
        count["longest"] = np.maximum(count["longest"], number)
        some = np.flatnonzero(own & (count["digits"] >= 4) & (count["digits"] <= DIGITS) & (count["groups"] <= GROUPS))
        if not len(some):
            continue
        n = {k: v[some] for k, v in count.items()}
        i, j = first[some] + low, at[some] + low
        f = np.zeros((len(some), FEATURES), bool)
        kinds = _KINDS_OF_MARKS[n["marks"]]
        f[:, ALWAYS] = True
        f[:, AS_PHONE] = (n["digits"] >= 7) & (n["digits"] <= 11)
        f[:, AS_CARD] = n["digits"] >= 12
        f[:, FOURS] = (n["groups"] > 1) & (n["odd"] == 0) & (n["lead"] == 4) & (n["digits"] >= 13)
        f[:, FOUR_BYTES] = (n["marks"] == MARKS["."]) & (n["groups"] == 4) & (n["wide"] == 0) & (n["longest"] <= 3)
        f[:, LOCAL] = (n["three"] == 3) & (n["two"] == 3) & (n["one"] == 4) & (n["groups"] <= 4)
        f[:, AREA] = (mark[first[some]] == MARKS["("]) & (n["close"] > 0)
        f[:, ONE_GROUP] = n["groups"] == 1
        f[:, ONE_MARK] = kinds == 1
        f[:, MIXED_MARKS] = _KINDS_OF_MARKS[n["marks"] & ~BLANK] > 1
        f[:, SLASH] = n["marks"] & MARKS["/"] > 0
        f[:, UNBALANCED] = n["open"] != n["close"]
        f[:, FEW_DIGITS] = n["digits"] < 7
        for r in np.flatnonzero(f[:, AS_CARD]):
            f[r, LUHN] = luhn(_NOT_DIGIT.sub("", text[tokens[i[r]][0] : tokens[j[r]][1]]))
        for r in np.flatnonzero((n["groups"] == 3) & (n["digits"] <= 8)):
            f[r, DATE] = bool(_DATE.fullmatch(text, tokens[i[r]][0], tokens[j[r]][1]))
        x, y = first[some], at[some]
        for t in np.unique(x[~seen[0, x]]).tolist():
            inside, sign, called = borders.before(t + low)
            left[t] = inside, sign, *called
        for t in np.unique(y[~seen[1, y]]).tolist():
            right[t] = borders.after(t + low)
        seen[0, x] = seen[1, y] = True
        f[:, INSIDE], f[:, AFTER_SIGN], f[:, NAMED_PHONE : NAMED_EMAIL + 1] = left[x, 0] | right[y], left[x, 1], left[x, 2:]
        yield i, j, f


def addresses(text: str, tokens: list[tuple[int, int]], borders: Borders) -> Iterator[tuple[int, int, np.ndarray]]:
    """First token, last token and features of written addresses."""
    for i, (a, b) in enumerate(tokens):
        if not (text[a].isascii() and text[a].isalnum()) or not _AT.match(text, a, b + 64 + 8):
            continue
        left = None
        for j in range(i, min(i + LONGEST, len(tokens))):
            end = tokens[j][1]
            if end - a > WIDEST:
                break
            if not text[end - 1].isalnum() or not _WRITTEN.fullmatch(text, a, end):
                continue
            left = left or borders.before(i)
            span = text[a:end]
            f = np.zeros(FEATURES, bool)
            f[[ALWAYS, WRITTEN]] = True
            f[MARKED], f[AT_SIGN] = len(_MARKED.findall(span)) >= 2, "@" in span
            f[INSIDE], f[AFTER_SIGN], f[NAMED_PHONE : NAMED_EMAIL + 1] = left[0] or borders.after(j), left[1], left[2]
            f[UNBALANCED] = span.count("(") != span.count(")")
            yield i, j, f


def key_features(text: str, a: int, b: int) -> np.ndarray:
    """Features of a candidate for a secret."""
    span, f = text[a:b], np.zeros(FEATURES, bool)
    body = span.rstrip("=")
    parts = [p for p in _PARTS.split(body) if p]
    signs = [c.isdigit() for c in body if c.isascii() and c.isalnum()]
    f[KEY] = True
    f[NAMED_KEY] = bool(_NAMED.search(text, max(0, a - 2 * CONTEXT), a))
    f[ISSUED] = bool(_ISSUED.fullmatch(body))
    f[NO_DIGIT] = not f[ISSUED] and not any(signs)
    f[HEX], f[UUID] = bool(_HEX.fullmatch(body)), bool(_UUID.fullmatch(body))
    f[CHANGES] = sum(x != y for x, y in zip(signs, signs[1:], strict=False)) >= max(3, len(signs) // 8)
    f[CASES] = any(map(str.isupper, body)) and any(map(str.islower, body)) and any(signs)
    f[PLAIN_PARTS] = len(parts) > 1 and all(p.isalpha() or p.isdigit() for p in parts)
    f[SIXTEEN], f[MONOTONE], f[SLASH] = len(body) >= 16, len(set(body)) < 4, body.count("/") > 1
    f[INSIDE] = a > 0 and text[a - 1].isalnum() or bool(_CUT.match(text, b, b + CONTEXT))
    return f


def secrets(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, np.ndarray]]:
    """First token, last token and features of runs that may be keys, and of what a name of a secret stands before."""
    if not tokens:
        return
    low, high = tokens[0][0], tokens[-1][1]
    spans = {m.span() for m in _KEY.finditer(text, low, high)}
    for match in _ASSIGNED.finditer(text, low, high):
        a, value = match.start(1), match[1] if match[0][: -len(match[1])][-1] in "\"'" else match[1].rstrip(".:!?)]}>")
        if len(value) >= 4:
            spans.add((a, a + len(value)))
    spans = sorted(s for s in spans if any(c.isascii() and c.isalpha() for c in text[slice(*s)]))
    if not spans:
        return
    first, last = {a: i for i, (a, _) in enumerate(tokens)}, {b: i for i, (_, b) in enumerate(tokens)}
    for a, b in spans:
        if a in first and b in last:
            yield first[a], last[b], key_features(text, a, b)


def segments(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First tokens, end tokens and features of every segment that some kind is possible for, in blocks."""
    borders = Borders(text, tokens)
    found = [*addresses(text, tokens, borders), *secrets(text, tokens)]
    if found:
        i, j, f = (np.array(x) for x in zip(*found, strict=True))
        yield i, j + 1, f
    starts = np.array([i for i, (a, _) in enumerate(tokens) if text[a] == "(" or "0" <= text[a] <= "9"], np.int64)
    for at in range(0, len(starts), STARTS):
        for i, j, f in numbers(text, tokens, starts[at : at + STARTS], borders):
            yield i, j + 1, f


def candidates(text: str, tokens: list[tuple[int, int]], weights: np.ndarray | None = None) -> list[tuple[int, int, np.ndarray]]:
    """The segments one by one; with weights only those that score above "outside", which no best path lacks."""
    out = []
    for i, j, f in segments(text, tokens):
        f = f.astype(np.float64)
        keep = (f @ weights.T).max(1) > 0 if weights is not None else np.ones(len(i), bool)
        out += zip(i[keep].tolist(), j[keep].tolist(), f[keep], strict=True)
    return out


def best_path(length: int, segments: list[tuple[int, int, np.ndarray]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """First token, end token and kind of the best segmentation; a token outside scores 0."""
    score, back = np.zeros(length + 1), [None] * (length + 1)
    by_end: dict[int, list] = {}
    for i, j, f in segments:
        by_end.setdefault(j, []).append((i, weights @ f))
    for j in range(1, length + 1):
        score[j] = score[j - 1]
        for i, s in by_end.get(j, ()):
            kind = int(s.argmax())
            if score[i] + s[kind] > score[j]:
                score[j], back[j] = score[i] + s[kind], (i, j, kind)
    path, j = [], length
    while j:
        if back[j]:
            path.append(back[j])
            j = back[j][0]
        else:
            j -= 1
    return path[::-1]


def likelihood(length: int, segments: list[tuple[int, int, np.ndarray]], gold: set[tuple[int, int, int]], weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of the gold segmentation and its gradient, by forward and backward sums."""
    scores = [weights @ f for _, _, f in segments]
    ahead, behind = np.full(length + 1, -np.inf), np.full(length + 1, -np.inf)
    ahead[0] = behind[length] = 0
    order = sorted(range(len(segments)), key=lambda n: segments[n][1])
    n = 0
    for j in range(1, length + 1):
        terms = [ahead[j - 1]]
        while n < len(order) and segments[order[n]][1] == j:
            terms += list(ahead[segments[order[n]][0]] + scores[order[n]])
            n += 1
        ahead[j] = np.logaddexp.reduce(terms)
    order.sort(key=lambda n: -segments[n][0])
    n = 0
    for i in range(length - 1, -1, -1):
        terms = [behind[i + 1]]
        while n < len(order) and segments[order[n]][0] == i:
            terms += list(behind[segments[order[n]][1]] + scores[order[n]])
            n += 1
        behind[i] = np.logaddexp.reduce(terms)
    value, gradient = -ahead[length], np.zeros_like(weights)
    for (i, j, f), s in zip(segments, scores, strict=True):
        share = np.exp(ahead[i] + s + behind[j] - ahead[length])
        for kind in range(len(LABELS)):
            if (i, j, kind) in gold:
                value += s[kind]
                share[kind] -= 1
        gradient -= share[:, None] * f
    return value, gradient


def _templates(seed: int, count: int) -> Iterator[tuple[str, list[Span]]]:
    """Sentences with their spans. # is a digit, 9 one of 1 to 9."""
    rng = np.random.default_rng(seed)
    digits = lambda s: re.sub("#", lambda _: str(rng.integers(10)), s.replace("9", str(rng.integers(1, 10))))
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(2, 9)))

    def card(sep: str) -> str:
        body = digits("4##############")
        last = next(str(d) for d in range(10) if luhn(body + str(d)))
        return sep.join((body + last)[i : i + 4] for i in range(0, 16, 4))

    def other_card() -> str:
        good = card("")
        return good[:-1] + str((int(good[-1]) + int(rng.integers(1, 10))) % 10)

    ip = lambda: ".".join(str(rng.integers(256)) for _ in range(4))
    makers = [
        ("email", lambda: f"{word()}@{word()}.com"),
        ("email", lambda: f"{word()} (at) {word()} (dot) org"),
        ("email", lambda: f"{word()}.{word()} [at] {word()} [dot] net"),
        ("email", lambda: f"{word()} at {word()} dot com"),
        ("ip", ip),
        ("ip", ip),
        ("card", lambda: card("")),
        ("card", lambda: card(" ")),
        ("card", lambda: card("-")),
        ("card", lambda: card(".")),
        ("phone", lambda: digits("(9##) ###-####")),
        ("phone", lambda: digits("9##-###-####")),
        ("phone", lambda: digits("9##.###.####")),
        ("phone", lambda: digits("9-9##-###-####")),
        *[(None, lambda p=p: digits(p)) for p in ("2##9-0#-1#", "1#/0#/19##", "9,###.##", "9#:##", "9######", "9###-####", "9##-##-####-#", "9#########", "9####-###", "9.9.##", "9## ###", "9### #### ##", "9##########", "9##/###/####")],
        (None, other_card),
        (None, other_card),
        (None, lambda: f"{word()} at {word()} {word()}"),
        (None, lambda: ".".join(str(rng.integers(256, 999)) for _ in range(4))),
    ]
    for n in range(count):
        kind, make = makers[n % len(makers)]
        left = " ".join(word() for _ in range(rng.integers(1, 3)))
        if kind and rng.random() < 0.3:
            left += " " + str(rng.choice(CALLED[kind])) + rng.choice(["", ":"])
        span = make()
        right = str(rng.choice(["", ".", ",", " " + word()]))
        text = f"{left} {span}{right}"
        yield text, [(kind, len(left) + 1, len(left) + 1 + len(span))] if kind else []


def _secret_templates(seed: int, count: int) -> Iterator[tuple[str, list[Span]]]:
    """Sentences with secrets and with what looks like them."""
    rng = np.random.default_rng(seed)
    of = lambda letters, n: "".join(rng.choice(list(letters), n))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: of("abcdefghijklmnoprstuvw", rng.integers(3, 10))
    name = lambda: str(rng.choice(["password", "Password", "passwd", "pwd", "secret", "client_secret", "token", "TOKEN", "api_key", "apikey", "API-KEY", "access_key"]))
    mixed = lambda n: of(lower + upper + digit, n - 2) + of(digit, 1) + of(upper, 1)
    hexed = lambda n: of(digit + "abcdef", n - 2) + of("abcdef", 1) + of(digit, 1)
    uuid = lambda: "-".join(of(digit + "abcdef", n) for n in (8, 4, 4, 4, 12))
    # Told by a name, told by a prefix, and told by neither.
    named = [lambda: hexed(rng.integers(12, 65)), lambda: mixed(rng.integers(10, 41)), lambda: word() + of(digit, rng.integers(1, 5)), lambda: of(lower + digit + "!#%&*", 9) + of(digit, 1), uuid]
    issued = [lambda: "AKIA" + of(upper + digit, 16), lambda: "AKIA" + of(upper, 16), lambda: "ghp_" + mixed(36), lambda: "sk-" + mixed(40), lambda: "xoxb-" + of(digit, 11) + "-" + mixed(20), lambda: ".".join(["eyJ" + mixed(20), mixed(30), mixed(24)])]
    neither = [
        lambda: hexed(40), lambda: hexed(64), lambda: hexed(12), uuid, lambda: mixed(11), lambda: mixed(24), lambda: f"{word()}-{rng.integers(1, 99)}-{word()}{word()}", lambda: f"{word()}_{word()}_{rng.integers(9)}",
        lambda: f"{word()}/{word()}/{word()}{rng.integers(9)}/{word()}", lambda: of(upper, 3) + "-" + of(digit, 6), lambda: of(upper, 2) + of(digit, 10), lambda: word() + word() + word(), lambda: word() + "-" + word(),
        lambda: f"sk-{word()}-{word()}-{word()}", lambda: f"hf_{word()}_{word()}{word()}", lambda: of(upper, 3) + of(digit, 4) + mixed(6) + "-" + of(upper, 2), lambda: mixed(16),
    ]
    plain = [word, lambda: word() + "-" + word(), lambda: word() + "_" + word(), lambda: "x" * int(rng.integers(4, 12)), lambda: "*" * 6 + "a", lambda: f"/{word()}/{word()}/{word()}{rng.integers(9)}/{word()}"]
    for n in range(count):
        makers, form = ((named, "name"), (issued, ""), (neither, ""), (plain, "name"), (named, "name"), (neither, "other"))[n % 6]
        left, value = " ".join(word() for _ in range(rng.integers(1, 3))) + " ", makers[int(rng.integers(len(makers)))]()
        if form:
            left += (name() if form == "name" else str(rng.choice(["commit", "sha", "id", "file", "digest", word()]))) + str(rng.choice(["=", ": ", " = ", ":"]))
        quote = str(rng.choice(["", '"'])) if form else ""
        text = f"{left}{quote}{value}{quote}{rng.choice(['', '.', ' ' + word()])}"
        a = len(left) + len(quote)
        yield text, [("secret", a, a + len(value))] if makers in (named, issued) else []


@lru_cache
def trained(seed: int = 29, count: int = 320, rounds: int = 100, rate: float = 0.1, decay: float = 0.002) -> np.ndarray:
    """Weights (kinds x features) by gradient ascent with Adam on the template sentences."""
    rows = []
    for text, spans in [*_templates(seed, count), *_secret_templates(seed, count // 2)]:
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        first, last = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
        rows.append((len(tokens), candidates(text, tokens), {(first[a], last[b], LABELS.index(k)) for k, a, b in spans}))
    weights = np.zeros((len(LABELS), FEATURES))
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        gradient = -decay * weights + sum(likelihood(*row, weights)[1] for row in rows) / len(rows)
        m += 0.1 * (gradient - m)
        v += 0.001 * (gradient * gradient - v)
        weights = weights + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights


def looked_at(text: str) -> list[tuple[int, int]]:
    """Starts and ends of what may be a span or a part of one, in order; where there is nothing, no segment scores."""
    found = [m.span() for m in _STRETCH.finditer(text)]
    # Runs of letters and digits, from a digit on both ways.
    end = 0
    match = _DIGIT.search(text)
    while match:
        start = match.start()
        while start > end and text[start - 1] in _RUN_SET:
            start -= 1
        end = _REST.match(text, match.end()).end()
        if 12 <= end - start <= SECRET and not text[start:end].isdigit():
            found.append((start, end))
        match = _DIGIT.search(text, end)
    # Runs that begin with an issuer's prefix, which need no digit.
    for prefix in ISSUERS:
        start = text.find(prefix)
        while start >= 0:
            end = _REST.match(text, start).end()
            if 12 <= end - start <= SECRET:
                found.append((start, end))
            start = text.find(prefix, end)
    # What a name of a secret stands before.
    for match in _EQUALS.finditer(text):
        at = match.start()
        if _CALLS.search(text, max(0, at - CONTEXT), at):
            value = _GIVEN.match(text, at + 1)
            if value:
                found.append((at - CONTEXT, value.end()))
    return sorted(found)


def added_spans(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """Spans of the field's best segmentation that overlap no base span."""
    stretches: list[list[int]] = []
    for start, end in looked_at(text):
        a, b = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = max(b, stretches[-1][1])
        else:
            stretches.append([a, b])
    found: list[Span] = []
    taken = sorted((a, b) for _, a, b in base)
    n = 0
    for a, b in stretches:
        # Base spans are settled: the field reads the gaps between them.
        gaps, at = [], a
        while n < len(taken) and taken[n][0] < b:
            x, y = taken[n]
            if y > at:
                gaps.append((at, x))
                at = y
            if y > b:
                break
            n += 1
        for x, y in [*gaps, (at, b)]:
            if y - x < 4:
                continue
            tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, x, y)]
            for i, j, kind in best_path(len(tokens), candidates(text, tokens, weights), weights):
                found.append((LABELS[kind], tokens[i][0], tokens[j - 1][1]))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans; spans: all; n_added, n_secret, n_spans."""
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(trained())

    def spans_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights = shared.value
        for texts in batches:
            rows = []
            for text in texts.fillna(""):
                base = base_spans(text)
                more = added_spans(text, base, weights)
                every = sorted(base + more, key=lambda s: (s[1], LABELS.index(s[0]), s[2]))
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(more), sum(s[0] == "secret" for s in more), len(every)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_secret", "n_spans"])

    apply = F.pandas_udf(spans_of, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long, n_spans long")
    return docs.select("doc_id", apply("text").alias("_f")).select("doc_id", "_f.*")
