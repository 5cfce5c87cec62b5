"""Personal data: patterns, and a linear-chain conditional random field over word shapes that adds to them.

The chain is the whole text: the field labels every word, where most are proved to be outside by their own scores and need no search. It is trained on a small labelled table by full-batch
gradient ascent with exact marginals and decoded by Viterbi over many texts at a time.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds, in the order in which spans are listed; the first four have patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
Span = tuple[str, int, int]

# --- patterns -------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Matches start at a run of digits: from inside the run the same match would only be shorter. No step looks back, so time is linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """What the patterns find: leftmost, without overlap within a kind, code points, end exclusive."""
    out: list[Span] = [("email", *x) for x in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15] if "+" in text else []
    return out


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


# --- windows and features ----------------------------------------------------------------------------------------

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words whose neighbourhood tells; fixed values.
CUES = {
    "secret": ("token", "key", "secret", "apikey", "api_key", "access_key", "auth", "credential"),
    "pass": ("password", "passwd", "pwd", "passphrase"),
    "at": ("at",),
    "dot": ("dot",),
    "domain": ("com", "org", "net", "edu", "gov", "io", "co", "uk", "de", "info"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "telephone", "ext"),
    "count": ("version", "v", "no", "page", "figure", "section", "chapter", "in", "of", "year", "table", "release"),
    "money": ("$", "usd", "eur", "price", "total"),
}
_CUE = {w: k for k, words in CUES.items() for w in words}
_TRIM = "\"'`.,;:!?()[]{}<>*#%&$|"
_HEX = frozenset("0123456789abcdefABCDEF")


def shape(word: str) -> str:
    """Runs of digits with their length up to five, runs of letters as one sign, other characters as they are."""
    out, last, n = [], "", 0
    for ch in word + "\0":
        kind = "d" if "0" <= ch <= "9" else "X" if "A" <= ch <= "Z" else "x" if ch.isalpha() else ch
        if kind == last and kind in "dXx":
            n += 1
            continue
        if last:
            out.append(f"d{min(n, 5)}" if last == "d" else last)
        last, n = kind, 1
    return "".join(out)


def _assigned(core: str) -> tuple[str, str]:
    """Name and value of a word that assigns: at its last equals sign, or at a colon after a word that tells of secrets."""
    name, _, value = core.rpartition("=")
    if not name and not core.startswith("="):
        first, _, rest = core.partition(":")
        if rest and _CUE.get(first.lower().strip(_TRIM)) in ("secret", "pass"):
            return first, rest
    return name, value


Known = tuple[tuple[str, ...], "tuple[str | None, str] | None"]


def _known(word: str) -> Known:
    """As `_own`: of plain words in lower case, with one capital or in capitals only the length matters."""
    core = word.strip(_TRIM)
    if core.isalpha() and ":" not in word and word[0] not in "(\"'" and core.lower() not in _CUE and (len(core) < 16 or not _HEX.issuperset(core)):
        n = len(core)
        if core.islower():
            return _own("g" * min(n, 64))
        elif core[1:].islower():
            return _own(("G" if core[0].isascii() else "g") + "g" * min(n - 1, 63))
        elif n < 16 and core.isascii() and core.isupper():
            return _own("G" * n)
    return _own(word)


@lru_cache(maxsize=50_000)
def _own(word: str) -> Known:
    """A word's own features and, if it tells about its neighbours, its cue and the sign (= or :) with which it assigns to the next."""
    core = word.strip(_TRIM)
    name, value = _assigned(core)
    value = value.strip(_TRIM)
    digits, letters = sum(c.isdigit() for c in value), sum(c.isalpha() for c in value)
    size = min(len(value).bit_length(), 7)
    plain = "letters" if value.isalpha() else "other"
    found = ["bias", f"len{size}", f"digits{min(digits, 6)}"]
    form = shape(core)
    found.append("shape:" + (form if len(form) <= 14 else "long"))
    mixed = digits and letters and value.isalnum()
    found += [n for n, x in (
        ("at", "@" in core), ("equals", "=" in word), ("assigned", "=" in core and bool(value)), ("only=", core == "="), ("plus", core.startswith("+")), ("paren", word.startswith("(")), ("dots3", core.count(".") == 3), ("dots1", core.count(".") == 1),
        ("dashes", core.count("-") >= 1), ("quoted", word[:1] in "\"'"), ("mixed16", mixed and len(value) >= 16), ("mixed12", mixed and 10 <= len(value) < 16), ("caps16", mixed and len(value) >= 16 and value.upper() == value),
        ("hex16", len(value) >= 16 and _HEX.issuperset(value)), ("number13", value.isdigit() and len(value) >= 13), ("number", value.isdigit()), ("url", "://" in word),
        (f"capsletters16:{value[:2]}", len(value) >= 16 and value.isalpha() and value.isupper()), ("cases", value.isalpha() and len(value) >= 12 and any(c.isupper() for c in value[1:]) and any(c.islower() for c in value)),
    ) if x]
    key = name.lower().strip(_TRIM)
    if key:
        found += ["assigns:" + _CUE.get(key, "other"), f"assigns:{_CUE.get(key, 'other')}:{plain}{size}"]
    cue = _CUE.get(core.strip("=").lower().strip(_TRIM))
    if cue:
        found.append("is:" + cue)
    bare = word.rstrip("\"'`")
    sign = bare[-1:] if bare[-1:] in ("=", ":") else ""
    return tuple(found), (cue, sign) if cue or sign else None


@dataclass
class Window:
    """Words in a row: their offsets and features."""

    spans: list[tuple[int, int]]
    features: list[tuple[str, ...]]


def _size(word: str) -> str:
    value = word.strip(_TRIM)
    return f"{'letters' if value.isalpha() else 'other'}{min(len(value).bit_length(), 7)}"


class _Features(dict):
    """Features by position, a word's own ones at first."""

    def __init__(self, words: list[str]) -> None:
        self.words = words

    def __missing__(self, i: int) -> tuple[str, ...]:
        return _known(self.words[i])[0]


def _told(words: list[str], telling: dict[int, tuple[str | None, str]], features: _Features) -> None:
    """Add what words that tell something or assign say about their neighbours; only those have any to be told."""
    last = len(words)
    cue_of = lambda i: telling[i][0] if i in telling else None
    for i, (cue, sign) in telling.items():
        if cue:
            for j in (1, 2):
                if i + j < last:
                    features[i + j] += (f"cue{j - 1}:{cue}",)
        if sign and i + 1 < last:
            lone = not words[i].strip(_TRIM + "=")
            named = cue_of(i - 1) if lone and i else cue
            features[i + 1] += ("after" + sign, f"to:{named or 'other'}", f"to:{named or 'other'}:{_size(words[i + 1])}")
        if cue == "dot" and i > 1 and cue_of(i - 2) == "at" and i + 1 < last:
            end = i + 1
            while end + 2 < last and cue_of(end + 1) == "dot":
                end += 2
            mark = ("spelled", "spelled:domain" if cue_of(end) == "domain" else "spelled:other")
            for j in range(max(0, i - 3), end + 1):
                features[j] += (*mark, "spelled:" + (cue_of(j) or "name"))


def windows(text: str) -> list[Window]:
    """All words of a text as one window; none for a text without words."""
    spans = [m.span() for m in _WORD.finditer(text)]
    if not spans:
        return []
    words = _WORD.findall(text)
    features = _Features(words)
    _told(words, {i: tell for i, x in enumerate(words) if (tell := _known(x)[1])}, features)
    return [Window(spans, [features[i] for i in range(len(words))])]


def _spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a text's words."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = np.zeros(len(code) + 2, np.int8)
    inside[1:-1] = (code != 32) & ((code < 9) | (code > 13))
    step = np.diff(inside)
    return np.flatnonzero(step > 0), np.flatnonzero(step < 0)


def open_windows(text: str, model: "Field") -> list[Window]:
    """The parts of a text's chain that aren't decided yet, in order.

    Where a word's own score for outside is ahead of any other label's by more than transitions can make up for, the best path is
    outside there, whatever its neighbours are. Such words part the chain, and what lies between them, with outside on both sides, has
    the labels that it has in the whole chain.
    """
    words = _WORD.findall(text)
    seen = model.seen
    if len(seen) > 200_000:
        seen.clear()
    known = list(map(seen.get, words))
    if None in known:
        for i, x in enumerate(known):
            if x is None:
                own = _known(words[i])
                known[i] = seen[words[i]] = own if own[1] or not model.outside(own[0]) else ()
    asked = [i for i, x in enumerate(known) if x]
    if not asked:
        return []
    features = _Features(words)
    for i in asked:
        features[i] = known[i][0]
    _told(words, {i: known[i][1] for i in asked if known[i][1]}, features)
    left = sorted(i for i, f in features.items() if not model.outside(f))
    if not left:
        return []
    starts, ends = _spans(text)
    out: list[Window] = []
    for n, i in enumerate(left):
        if not n or left[n - 1] != i - 1:
            out.append(Window([], []))
        out[-1].spans.append((int(starts[i]), int(ends[i])))
        out[-1].features.append(features[i])
    return out


# --- the field ---------------------------------------------------------------------------------------------------

LABELS = ("outside", *KINDS)


@dataclass
class Field:
    """Weights of a linear chain: features by label, and transitions (outside before and after every window)."""

    index: dict[str, int] = field(default_factory=dict)
    emit: np.ndarray = field(default_factory=lambda: np.zeros((0, len(LABELS))))
    move: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS), len(LABELS))))
    #: What open_windows found out about words under these weights; not a part of the model.
    seen: dict[str, tuple] = field(default_factory=dict, repr=False, compare=False)
    _sure: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "seen": {}, "_sure": {}}

    def outside(self, features: tuple[str, ...]) -> bool:
        """Whether a word with these features is outside on the best path of every chain, for a fitted model."""
        found = self._sure.get(features)
        if found is None:
            if "gain" not in self._sure:
                # The most that transitions into and out of a label can be better than those of outside.
                through = self.move[:, :, None] + self.move[None, :, :]
                self._sure["gain"] = (through - self.move[:, 0][:, None, None] - self.move[0][None, None, :]).max(axis=(0, 2))
            emit = self.emit[[k for f in features if (k := self.index.get(f)) is not None]].sum(axis=0)
            if len(self._sure) > 200_000:
                self._sure = {"gain": self._sure["gain"]}
            found = self._sure[features] = bool(np.all(emit[0] - emit[1:] > self._sure["gain"][1:] + 1e-6))
        return found

    def scores(self, found: list[Window]) -> np.ndarray:
        """Emissions of windows: window, position, label; nothing beyond a window's end."""
        kinds: dict[tuple[str, ...], int] = {}
        places = [[kinds.setdefault(f, len(kinds)) for f in w.features] for w in found]
        each = np.zeros((len(kinds), len(LABELS)))
        for features, at in kinds.items():
            each[at] = self.emit[[k for f in features if (k := self.index.get(f)) is not None]].sum(axis=0)
        out = np.zeros((len(found), max(map(len, places)), len(LABELS)))
        for i, rows in enumerate(places):
            out[i, : len(rows)] = each[rows]
        return out

    def decode(self, found: list[Window], most: int = 400_000) -> list[list[str]]:
        """The best labels of each window by Viterbi, windows of like length together, at most `most` padded positions of several at a time."""
        out: list[list[str]] = [[] for _ in found]
        order = sorted(range(len(found)), key=lambda i: -len(found[i].spans))
        at = 0
        while at < len(order):
            take = max(1, most // max(1, len(found[order[at]].spans)))
            self._decode([(i, found[i]) for i in order[at : at + take] if found[i].spans], out)
            at += take
        return out

    def _decode(self, part: list[tuple[int, Window]], out: list[list[str]]) -> None:
        """Windows from long to short: at each position only those that reach it take part."""
        if not part:
            return
        emit = self.scores([w for _, w in part])
        sizes = np.array([len(w.spans) for _, w in part])
        alive = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        best = emit[:, 0] + self.move[0]
        back = np.zeros((sizes[0], len(part), len(LABELS)), np.int8)
        into = np.ascontiguousarray(self.move.T)
        for j in range(1, sizes[0]):
            n = alive[j]
            paths = best[:n, None, :] + into
            back[j, :n] = paths.argmax(axis=2)
            best[:n] = paths.max(axis=2) + emit[:n, j]
        label = (best + self.move[:, 0]).argmax(axis=1)
        path = np.zeros((len(part), sizes[0]), np.int8)
        rows = np.arange(len(part))
        for j in range(sizes[0] - 1, -1, -1):
            n = alive[j]
            path[:n, j] = label[:n]
            label[:n] = back[j, rows[:n], label[:n]]
        for (i, w), labels in zip(part, path, strict=True):
            out[i] = [LABELS[k] for k in labels[: len(w.spans)].tolist()] if labels.any() else ["outside"] * len(w.spans)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def train(table: Iterable[tuple[str, list[Span]]], *, steps: int = 200, rate: float = 0.1, penalty: float = 0.02) -> Field:
    """Fit a field to texts with their spans by Adam on the exact penalised likelihood."""
    found: list[Window] = []
    gold: list[list[int]] = []
    for text, spans in table:
        for w in windows(text):
            found.append(w)
            gold.append([next((1 + KINDS.index(k) for k, a, b in spans if a < e and s < b), 0) for s, e in w.spans])
    model = Field({f: i for i, f in enumerate(sorted({f for w in found for x in w.features for f in x}))})
    model.emit = np.zeros((len(model.index), len(LABELS)))
    sizes = np.array([len(w.spans) for w in found])
    n, length = len(found), int(sizes.max())
    flat = np.array([(i, j, model.index[f]) for i, w in enumerate(found) for j, features in enumerate(w.features) for f in features])
    y = np.array([labels + [0] * (length - len(labels)) for labels in gold])
    inside = np.arange(length) < sizes[:, None]
    ends = np.arange(length) == sizes[:, None] - 1
    state = [np.zeros_like(model.emit), np.zeros_like(model.emit), np.zeros_like(model.move), np.zeros_like(model.move)]
    for step in range(1, steps + 1):
        grad_emit, grad_move = -penalty * model.emit, -penalty * model.move
        emit = np.zeros((n, length, len(LABELS)))
        np.add.at(emit, (flat[:, 0], flat[:, 1]), model.emit[flat[:, 2]])
        ahead, behind = np.empty_like(emit), np.empty_like(emit)
        ahead[:, 0], behind[:, -1] = emit[:, 0] + model.move[0], model.move[:, 0]
        for j in range(1, length):
            # Beyond a window's end nothing moves; at its end the chain goes outside.
            ahead[:, j] = np.where(inside[:, j, None], _logsumexp(ahead[:, j - 1, :, None] + model.move, 1) + emit[:, j], ahead[:, j - 1])
            k = length - 1 - j
            behind[:, k] = np.where(ends[:, k, None], model.move[:, 0], _logsumexp(model.move + (emit[:, k + 1] + behind[:, k + 1])[:, None, :], 2))
        total = _logsumexp(ahead[:, -1] + model.move[:, 0], 1)
        share = np.exp(np.where(inside[:, :, None], ahead + behind - total[:, None, None], -np.inf))
        wrong = np.eye(len(LABELS))[y] * inside[:, :, None] - share
        np.add.at(grad_emit, flat[:, 2], wrong[flat[:, 0], flat[:, 1]])
        grad_move[0] += wrong[:, 0].sum(axis=0)
        grad_move[:, 0] += wrong[ends].sum(axis=0)
        for j in range(1, length):
            on = inside[:, j]
            pair = np.exp(ahead[on, j - 1, :, None] + model.move + (emit[on, j] + behind[on, j])[:, None, :] - total[on, None, None])
            np.add.at(grad_move, (y[on, j - 1], y[on, j]), 1.0)
            grad_move -= pair.sum(axis=0)
        for value, grad, m, v in ((model.emit, grad_emit, state[0], state[1]), (model.move, grad_move, state[2], state[3])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def labelled_table(rows: int = 500, seed: int = 1) -> list[tuple[str, list[Span]]]:
    """The small labelled table: invented sentences with and without personal data in common notations."""
    r = np.random.default_rng(seed)
    pick = lambda *x: x[r.integers(len(x))]
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    of = lambda letters, n: "".join(r.choice(list(letters), n))
    hexes = lambda n: of("0123456789abcdef", n)
    words = lambda n: " ".join(of("aeioulnrstdmc", r.integers(2, 9)) for _ in range(n))

    def card() -> str:
        d = digits(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return pick(d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4)))

    def item() -> tuple[str, str, str, str]:
        """Before, kind or nothing, value, after."""
        match r.integers(25):
            case 0:
                return "", "email", f"{of('abcdefgh', 5)}{pick('', '.' + digits(2), '_x')}@{of('mailbox', 4)}{digits(1)}.{pick('com', 'org', 'example.com')}", ""
            case 1:
                return "", "ip", ".".join(str(x) for x in r.integers(0, 256, 4)), ""
            case 2:
                return "", "card", card(), ""
            case 3:
                return pick("", "tel ", "call "), "phone", pick(f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}"), ""
            case 4:
                return pick("tel ", "phone: ", "call "), "phone", pick(f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"), ""
            case 5:
                return pick('token = "', 'key = "', "secret = '", 'api_key = "'), "secret", pick(hexes(40), hexes(32), hexes(24)), pick('"', '" ')
            case 6:
                return pick("password=", "passwd=", "token=", "key=", "pwd="), "secret", pick(hexes(18), hexes(20), of("abcdefghkmnprstuvwxyz23456789", 14) + "7q"), ""
            case 7:
                return "", "secret", pick("AKIA", "ASIA", "SK", "GHP") + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r.integers(16, 30)) + "4K", ""
            case 8:
                return pick("version ", "Version ", "v "), "", pick(f"{digits(1)}.{digits(1)}", f"{digits(1)}.", f"{digits(1)}.{digits(1)}.{digits(1)}"), ""
            case 9:
                return pick("in ", "year ", "of "), "", pick(f"19{digits(2)}", f"20{digits(2)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"{digits(2)}/{digits(2)}/20{digits(2)}"), ""
            case 10:
                return pick("page ", "figure ", "no "), "", pick(digits(1), digits(2), digits(3), f"{digits(1)}-{digits(2)}"), ""
            case 11:
                return pick("$", "total ", ""), "", pick(f"{digits(3)}.{digits(2)}", f"{digits(1)},{digits(3)}", f"{digits(2)}%", digits(6), digits(9)), ""
            case 12:
                return "", "", pick(f"x = {digits(2)}", "a = b", f"n={digits(3)}", "key = value", "mode=fast", f"{of('abc', 3)}{digits(1)}", f"H{digits(1)}O", f"{of('mn', 2)}{digits(2)}{of('pq', 2)}"), ""
            case 13:
                return "", "", pick(f"{digits(3)}.{digits(2)}.{digits(1)}", f"({digits(2)})", f"{digits(2)}:{digits(2)}", f"{digits(4)}", f"@{of('abc', 5)}", f"https://{of('abc', 6)}.com/{digits(3)}"), ""
            case 14:
                return "", "", pick(f"ISBN {digits(3)}-{digits(1)}-{digits(4)}", f"{digits(2)} {digits(3)}", f"{digits(1)} + {digits(1)} = {digits(2)}", f"{digits(5)} {of('abc', 4)}"), ""
            case 15:
                return pick("password: ", "Password: ", "passwd: ", "pwd: ", "password = ", "passwd = ", "pwd = ", 'password = "', "password:", "password=", "pwd="), "secret", of("abcdefghijklmnopqrstuvwxyz", r.integers(8, 25)), ""
            case 16:
                return pick("token: ", "secret = ", "api_key: ", "key = ", "token=", "secret=", "api_key=", "auth: ", "password: ", "password = "), "secret", "aK" + of("abcdefghkmnprstuvwxyzABCDEFGHKMNPRSTUVWXYZ", r.integers(12, 38)), ""
            case 17:
                at, dot = (" at ", " dot ") if r.integers(2) else pick((" (at) ", " (dot) "), (" [at] ", " [dot] "))
                return pick("", "mail ", "write to "), "email", of("abcdefghij", r.integers(2, 9)) + at + of("mailbox", r.integers(3, 8)) + dot + pick("com", "org", "net", "edu", f"co{dot}uk"), ""
            case 18:
                return "", "secret", pick("AKIA", "ASIA") + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 16), ""
            case 19:
                return pick("the ", "your ", "a "), "", pick("password", "token", "key", "secret") + pick(" is ", " of ", " to ", ", ", ". ", " and ", ": ", " = ") + pick("the", "a", "this", "no", "value", "lost", "none", "your"), ""
            case 20:
                return pick("Note: ", "author: ", "title: ", "name = ", "x = ", "see: ", "Subject: "), "", pick(words(1).title(), of("aeioulnrstdmc", r.integers(5, 20)), words(2)), ""
            case 21:
                return pick("at ", "look at ", "met at ", "(at) "), "", pick("the dot on it", "noon", "a dot", f"{words(1)} point", "the end of the dot", f"{words(1)}.com"), ""
            case 22:
                return "", "", pick(of("ABCDEILMNORST", r.integers(2, 20)), of("aeioulnrstdmc", r.integers(9, 24)), words(1).title(), f"{words(1)}-{words(1)}", f"({words(2)})", f'"{words(2)}"', f"{words(1)}'s", f"{words(1)}/{words(1)}", "—", "é" + words(1), f"{words(1).title()}{words(1).title()}"), ""
            case 23:
                return pick("call ", "phone ", "Tel: ", "total ", "version ", "mobile: "), "", words(2), ""
            case _:
                return "", "", "", ""

    out = []
    for _ in range(rows):
        text, spans = words(r.integers(1, 6)) + " ", []
        for _ in range(r.integers(1, 4)):
            before, kind, value, after = item()
            if kind:
                spans.append((kind, len(text) + len(before), len(text) + len(before) + len(value)))
            text += before + value + after + pick(" ", ". ", ", ", "*** ", "\n") + words(r.integers(1, 7)) + " "
        out.append((text, spans))
    return out


def _value_span(text: str, start: int, end: int) -> tuple[int, int]:
    """A labelled stretch without quotes and signs around it, and without the name it is assigned to."""
    cut = text.rfind("=", start, end)
    if cut < 0 and (name := _assigned(text[start:end].strip(_TRIM))[0]):
        cut = text.index(name, start) + len(name)
    if 0 <= cut < end - 1 and text[cut + 1 : end].strip(_TRIM):
        start = cut + 1
    while start < end and text[start] in _TRIM + " \t\n" and not (text[start] == "(" and ")" in text[start:end].rstrip(_TRIM)):
        start += 1
    while end > start and text[end - 1] in _TRIM + " \t\n":
        end -= 1
    return start, end


def added_spans(texts: list[str], base: list[list[Span]], model: Field) -> list[list[Span]]:
    """What the field finds beyond the patterns: labelled stretches that overlap none of their spans."""
    out: list[list[Span]] = []
    at = 0
    while at < len(texts):
        # Not more than about a million characters are held as words at once, unless one text is longer.
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= 1_000_000:
            size += len(texts[end])
            end += 1
        # Words make many small objects without cycles, which the collector would only walk over.
        collects = gc.isenabled()
        gc.disable()
        try:
            out += _added(texts[at:end], base[at:end], model)
        finally:
            if collects:
                gc.enable()
        at = end
    return out


def _added(texts: list[str], base: list[list[Span]], model: Field) -> list[list[Span]]:
    found = [open_windows(x, model) for x in texts]
    labels = iter(model.decode([w for part in found for w in part]))
    out = []
    for text, part, known in zip(texts, found, base, strict=True):
        spans: list[Span] = []
        for w in part:
            run: list = []
            kinds = next(labels)
            if kinds.count("outside") == len(kinds):
                continue
            for (s, e), label in zip(w.spans, kinds, strict=True):
                if label == "outside":
                    if run:
                        spans.append(tuple(run))
                        run = []
                    continue
                # Several words make one number, or one address that is spelled out.
                if run and run[0] == label and (label in ("phone", "card") or label == "email" and "@" not in text[run[1] : e]):
                    run[2] = e
                    continue
                if run:
                    spans.append(tuple(run))
                run = [label, s, e]
            if run:
                spans.append(tuple(run))
        spans = [(k, *_value_span(text, a, b)) for k, a, b in spans]
        out.append([(k, a, b) for k, a, b in spans if b - a > 3 and not any(a < y and x < b for _, x, y in known)])
    return out


@lru_cache(maxsize=1)
def default_model() -> Field:
    return train(labelled_table())


def find(docs: DataFrame, model: Field | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, base_spans and spans (arrays of kind, start, end in code points, end exclusive).

    Null texts count as empty and have none. Rows that repeat or share an id are searched each. An empty table gives no rows;
    other columns are not read.
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        rows = lambda x: pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in part] for part in x], kind)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            base = [base_spans(x) for x in texts]
            more = added_spans(texts, base, model)
            both = [sorted([*a, *b], key=lambda s: (KINDS.index(s[0]), s[1])) for a, b in zip(base, more, strict=True)]
            yield pa.record_batch({"doc_id": batch.column(0), "base_spans": rows(base), "spans": rows(both)})

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    source = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text"))
    return source.mapInArrow(run, f"doc_id long, base_spans {spans}, spans {spans}")


def digests(found: DataFrame) -> DataFrame:
    """Counts per kind, the hash of the patterns' spans, and all spans as text."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(text(F.col("base_spans")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, model: Field | None = None, *, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The rows with each span of their text replaced by its kind in brackets, overlapping ones by the first; `length`, where there is such a column, follows the text."""
    model = model or default_model()
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            bodies = [x or "" for x in texts]
            base = [base_spans(x) for x in bodies]
            out = []
            for value, a, b in zip(texts, base, added_spans(bodies, base, model), strict=True):
                pieces, end = [], 0
                for k, s, e in sorted([*a, *b], key=lambda x: (x[1], -x[2])):
                    if s >= end:
                        pieces += [value[end:s], f"[{k.upper()}]"]
                    end = max(end, e)
                out.append(value if not pieces else "".join(pieces) + value[end:])
            columns = [pa.array(out, batch.column(i).type) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.record_batch(columns, schema=batch.schema)

    found = docs.mapInArrow(run, docs.schema)
    return found.withColumn(length, F.when(F.col(length).isNotNull(), F.length(text)).cast(docs.schema[length].dataType)) if length in names else found


def sha256_of(spans: Iterable[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
