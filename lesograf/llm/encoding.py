"""Text read in the wrong character encoding: best-first search for the cheapest reachable text.

States are texts; the moves encode a text in one character set and decode the bytes in another, or
undo an escape. A character-plausibility cost (trigrams learned from correct word forms, case, mixed
scripts, signs that no text uses) guides the search: states leave the queue by an admissible bound of
that cost, visited texts are never opened again, and the first acceptable text that leaves it is the
cheapest; it wins if it saves enough bits. The unit is what stands between ASCII blanks, so that a
text that is garbled only in part is found as well; short units are then judged by their neighbours.
"""

from __future__ import annotations

import heapq
import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lesograf.llm.confusables import TO_SCRIPT, visible
from lesograf.sources.tables import settle

# The character sets of the moves.
SINGLE = ("cp1252", "cp1251", "cp866", "koi8_r", "latin_1", "mac_cyrillic", "iso8859_5", "cp1250")
MIN_GAIN = 9.0  # bits that the restored text must save
UTF8_BITS = 5.0  # that a valid reading as UTF-8 saves
SINGLE_BITS, AGAIN_BITS = 1.0, 8.0  # that an exchange of single-byte sets costs, and a second one besides
LAST = 1e6  # puts two exchanges on end behind everything else
PLAUSIBLE = 5.2  # bits a letter up to which a regular word is not searched
MAX_KNOWN = 20_000_000  # reference forms that a worker holds, 8 bytes each
MEMO = 300_000

_ENCODE: dict[str, dict[int, int]] = {}
_DECODE: dict[str, dict[int, str]] = {}
for _name in SINGLE:
    _to = {}
    for _b in range(128, 256):
        try:
            _to[_b] = bytes([_b]).decode(_name)
        except UnicodeDecodeError:  # an undefined byte stays as control character
            _to[_b] = chr(_b)
    _DECODE[_name] = {b: c for b, c in _to.items() if chr(b) != c}
    _ENCODE[_name] = {b: 0xFFFF for b in range(128, 256)} | {ord(c): b for b, c in _to.items()}

UNSEEN = {c: None for c in (0xAD, 0x34F, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF)}
_INVISIBLE = UNSEEN | {0x301: None, 0xA0: " ", 0x2007: " ", 0x202F: " ", 0x3000: " "}
_COMMON_SIGNS = frozenset("«»—–…“”„’‘№€°§•·×") | {chr(c) for c in (*UNSEEN, 0xA0, 0x2007, 0x202F, 0x3000, 0x301)}
_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
_ASCII_WORDS = re.compile(r"[A-Za-z]+")
_UNIT = re.compile(r"[^ \t\r\n]+")
_EDGE = " .,;:!?…«»\"'“”„()[]—–-0123456789%№"
_ESCAPE = re.compile(r"&#?\w+;|\\u[0-9a-fA-F]{4}|(?:%[0-9A-Fa-f]{2})+")


def _script(c: str) -> int:
    o = ord(c)
    if o < 0x250:
        return 1
    if 0x400 <= o < 0x530:
        return 2
    if 0x370 <= o < 0x400:
        return 3
    return 4


def place(hashes: np.ndarray, form: str) -> int | None:
    """Place of a form among sorted 64-bit hashes, as Spark's xxhash64 gives them."""
    h = xxhash.xxh64_intdigest(form.encode("utf-8", "surrogatepass"), 42)
    h -= (h >> 63) << 64
    i = int(hashes.searchsorted(h))
    return i if i < len(hashes) and hashes[i] == h else None


class Forms:
    """A set of forms as sorted 64-bit hashes: 8 bytes a form, so that none need be left out."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.memo: dict[str, bool] = {}

    def __contains__(self, form: str) -> bool:
        if (v := self.memo.get(form)) is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            v = self.memo[form] = place(self.hashes, form) is not None
        return v


def gram_counts(forms: Iterable[str]) -> tuple[Counter, Counter]:
    """How often each trigram of words and each character occurs in the forms."""
    three, one = Counter(), Counter()
    for form in forms:
        one.update(form)
        for w in _WORD.findall(form):
            s = f"^^{w}$"
            three.update(s[i - 2 : i + 1] for i in range(2, len(s)))
    return three, one


class Plausibility:
    """Bits that a text costs under trigrams of correct forms, and the set of all forms.

    ``counts``: those of ``gram_counts``, where the forms were counted elsewhere."""

    def __init__(self, forms: list[str], known: Forms | None = None, counts: tuple[Counter, Counter] | None = None):
        self.known = frozenset(forms) if known is None else known
        three, one = gram_counts(forms) if counts is None else counts
        two, seen = Counter(), {1: set(), 2: set(), 3: set()}
        for t, n in three.items():
            two[t[:2]] += n
            if t[2] != "$" and (k := _script(t[2])) in seen:
                seen[k].add(t[2])
        total = sum(one.values()) or 1
        self.one = {c: -math.log2(n / total) for c, n in one.items()}
        self.base = {k: math.log2(len(v) + 30) + 3 for k, v in seen.items()}
        self.bits = {t: -math.log2((n - 0.5) / two[t[:2]] * 0.95) for t, n in three.items()}
        self.new = {h: -math.log2(0.05 + min(0.4, 1.5 / n)) for h, n in two.items()}
        self.exchanges: Exchanges | None = None
        self.memo: dict[str, float] = {}

    def word(self, w: str) -> float:
        """Bits of a word: trigrams of its letters in lower case, plus irregular case and mixed scripts."""
        if (cost := self.memo.get(w)) is not None:
            return cost
        low = w.lower()
        s, cost = f"^^{low}$", 0.0
        for i in range(2, len(s)):
            b = self.bits.get(s[i - 2 : i + 1])
            if b is None:
                c = s[i]
                k = _script(c) if c != "$" else 0
                b = 9.0 if k == 4 else self.new.get(s[i - 2 : i], 0.5) + (4.0 if c == "$" else self.one.get(c, self.base.get(k, 10) + 3))
            cost += b
        if w != low:
            upper = [c.isupper() for c in w]
            n = sum(upper)
            if n == len(w):
                cost += 1.5 * (n - 1)
            elif not (n == 1 and upper[0]):
                cost += 6.0 + 1.5 * n
        kinds = [_script(c) for c in w if ord(c) < 0x300 or ord(c) > 0x36F]
        cost += 7.0 * sum(1 for a, b in zip(kinds, kinds[1:]) if a != b)
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.memo[w] = cost
        return cost

    def least_after(self, chars: list[str]) -> np.ndarray:
        """Bits that each character costs at least after each other one (the last row: at the beginning),
        whatever stands before that; infinite where no result may have the pair."""
        size = len(chars)
        letter = np.array([_WORD.match(c) is not None for c in chars])
        low = [c.lower()[:1] for c in chars]
        at: dict[str, list[int]] = {}
        for i, c in enumerate(low):
            at.setdefault(c, []).append(i)
        fresh: dict[str, float] = {}
        for h, b in self.new.items():
            fresh[h[1]] = min(b, fresh.get(h[1], 0.5))
        own = np.array([9.0 if (k := _script(c)) == 4 else self.one.get(c, self.base.get(k, 10) + 3) for c in low])
        unseen = np.array([0.0 if _script(c) == 4 else 1.0 for c in low])  # the others cost a new context besides
        before = np.array([*(min(0.5, fresh.get(c, 0.5)) if x else min(0.5, fresh.get("^", 0.5)) for c, x in zip(low, letter)), min(0.5, fresh.get("^", 0.5))])
        out = own + before[:, None] * unseen
        openers = [*np.flatnonzero(~letter), size]
        for t, b in self.bits.items():
            for j in at.get(t[2], ()):
                for i in openers if t[1] == "^" else at.get(t[1], ()):
                    out[i, j] = min(out[i, j], b)
        kind = np.array([*map(_script, chars)])
        both = letter[:, None] & letter
        out[:size][both & (kind[:, None] != kind)] += 7.0
        small = np.array([re.match("[a-zа-яё]", c) is not None for c in chars])
        out[:size][small[:, None] & np.array([re.match("[A-ZА-ЯЁ]", c) is not None for c in chars])] = np.inf
        for j, c in enumerate(chars):
            if _BROKEN.match(c):
                out[:, j] = np.inf
            elif not letter[j]:
                out[:, j] = self._sign(c)
        return out.astype(np.float32)

    def text(self, t: str) -> float:
        cost, at = 0.0, 0
        for m in _WORD.finditer(t):
            cost += sum(map(self._sign, t[at : m.start()])) + self.word(m[0])
            at = m.end()
        return cost + sum(map(self._sign, t[at:]))

    @staticmethod
    def _sign(c: str) -> float:
        o = ord(c)
        if o < 128:
            return 4.0 if o >= 32 or c in "\t\r\n" else 14.0
        if c in _COMMON_SIGNS:
            return 6.0
        if c == "�":
            return 16.0
        if o < 0x100 or 0x2500 <= o < 0x25A0 or 0x2018 <= o < 0x2100 or 0x2200 <= o < 0x2330:
            return 13.0
        return 8.0


def _encode(t: str, name: str) -> bytes | None:
    try:
        return t.translate(_ENCODE[name]).encode("latin_1")
    except UnicodeEncodeError:
        return None


def unescape(t: str) -> str:
    """HTML entities, \\u and percent escapes undone."""
    t = html.unescape(t)
    t = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), t)
    if "%" in t:
        t = re.sub(r"(?:%[0-9A-Fa-f]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), t)
    return t


def moves(t: str) -> Iterator[tuple[str, tuple[str, str]]]:
    """(text, move) of every single reading of ``t``."""
    yield from _opened(t)
    for enc in SINGLE:
        raw = _encode(t, enc)
        if raw is not None:
            plain = raw.decode("latin_1")
            for dec in SINGLE:
                if dec != enc and (u := plain.translate(_DECODE[dec])) != t:
                    yield u, (enc, dec)


_BROKEN = re.compile("[\x80-\x9f�─-▟]")
_IRREGULAR = re.compile("[a-zа-яё][A-ZА-ЯЁ]|[A-ZА-ЯЁ]{2}[a-zа-яё]")
_REPEATED = re.compile(r"(.)\1{2,}")
# First and last code points of letters outside Latin and Cyrillic that a restored text may have.
_OTHER_SCRIPTS = ((0x370, 0x3FF), (0x531, 0x586), (0x5D0, 0x5EA), (0x621, 0x6D3), (0x904, 0x96F), (0xE01, 0xE5B), (0x10D0, 0x10FA), (0x3041, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


_QUOTES = frozenset("«»—–…“”„’")


def acceptable(t: str, of: str, path: tuple[tuple[str, str], ...], model: Plausibility) -> bool:
    """Whether ``t``, restored from ``of`` by ``path``, reads like text: regular words of one script
    that are known or plausible, no signs that the original hasn't but quotes, dashes and dots."""
    if _BROKEN.search(t):
        return False
    utf8 = any(m[1] != m[0] and m[1] in ("utf_8", "") for m in path)
    text = t.translate(_INVISIBLE)
    words = _WORD.findall(text)
    rest = _WORD.sub("", text)
    if any(not c.isascii() and c not in _QUOTES and not (utf8 and (c in "\xa0№°§" and len(t) > 1 or ord(c) >= 0x2600)) and c not in of for c in rest):
        return False
    if not words:
        return utf8 and any(c in _QUOTES or ord(c) >= 0x2600 for c in rest)
    if re.search(r"\w[«»“”„…—–]\w", text) and not utf8:
        return False
    # a plain word is no sign of a wrong reading by itself: its replacement must be the better for it
    core = of.translate(_INVISIBLE).strip(_EDGE)
    plain = core.isalpha() and (core.islower() or core[0].isupper() and core[1:].islower()) and all(0x430 <= ord(c) < 0x452 for c in core.lower())
    if plain and (len(core) < 2 or core.lower() in model.known or len(core) < 4 and not utf8):
        return False
    for w in words:
        if w.isascii():
            continue
        kinds = {_script(c) for c in w if not 0x300 <= ord(c) < 0x370}
        if len(kinds) > 1:
            return False
        if kinds & {3, 4}:
            blocks = {next((i for i, (a, b) in enumerate(_OTHER_SCRIPTS) if a <= ord(c) <= b), -1) for c in w}
            if -1 in blocks or len(blocks - {7, 8}) > 1 or len(blocks) > 2 or len(w) < 2 or not utf8:
                return False
            continue
        regular = w.islower() or w[0].isupper() and (w[1:].islower() or len(w) == 1)
        if w.lower() in model.known and (regular or w.isupper() and len(w) > 2):
            continue
        if not regular or not (utf8 and len(w) > 1) and (len(w) < 4 or model.word(w) > (4.6 if plain else 6.2) * (len(w) + 1)):
            return False
    return True


class Exchanges:
    """One exchange of single-byte sets and two of them as maps over the characters of all sets, with the
    least bits of every pair of characters: the bounds of all these texts are one sum over an array."""

    def __init__(self, model: Plausibility):
        chars = [*map(chr, range(128)), *sorted({c for t in _DECODE.values() for c in t.values()} | {chr(b) for b in range(128, 256)})]
        self.index = {c: i for i, c in enumerate(chars)}
        self.chars = chars
        self.single = [(a, b) for a in SINGLE for b in SINGLE if a != b]
        size = len(chars)
        one = np.full((len(self.single), size + 1), size, np.int32)  # the last place: can't be encoded
        one[:, :128] = np.arange(128)
        for k, (enc, dec) in enumerate(self.single):
            for i in range(128, size):
                byte = _ENCODE[enc].get(ord(chars[i]), 0xFFFF)
                if byte < 256:
                    one[k, i] = self.index[_DECODE[dec].get(byte, chr(byte))]
        twice = [(p, q) for p in range(len(self.single)) for q in range(len(self.single)) if self.single[p][1] != self.single[q][0]]
        first, second = np.array([p for p, _ in twice]), np.array([q for _, q in twice])
        two = np.take_along_axis(one[second], one[first], axis=1)
        self.maps = np.concatenate([one, two])
        self.texts = {p: {ord(chars[i]): chars[j] for i, j in enumerate(one[k, 128:].tolist(), 128) if j < size} for k, p in enumerate(self.single)}
        self.moves = [(p,) for p in self.single] + [(self.single[p], self.single[q]) for p, q in twice]
        self.cost = np.array([SINGLE_BITS] * len(self.single) + [SINGLE_BITS + AGAIN_BITS] * len(twice))
        bits = model.least_after(chars)
        self.after = np.full((size + 1, size + 1), np.inf, np.float32)
        self.after[:size, :size] = bits[:size]
        self.first = np.array([*bits[size], np.inf], np.float32)

    def codes(self, t: str) -> list[int] | None:
        try:
            return [self.index[c] for c in t]
        except KeyError:
            return None

    def below(self, codes: list[int], limit: float, again: bool) -> list[tuple[float, int]]:
        """(bound, number of the map) of the maps of one exchange, or of two (``again``), whose text may cost
        less than ``limit``, cheapest first. Maps leave as soon as the sum over a few characters is too much."""
        at = np.arange(len(self.single), len(self.maps)) if again else np.arange(len(self.single))
        m = self.maps[at, codes[0]]
        bound = self.first[m] + self.cost[at]
        for i in range(1, len(codes) + 1):
            if i % 3 == 1:
                keep = bound < limit
                at, m, bound = at[keep], m[keep], bound[keep]
                if not len(at):
                    return []
            if i < len(codes):
                after = self.maps[at, codes[i]]
                bound = bound + self.after[m, after]
                m = after
        keep = bound < limit
        return sorted(zip(bound[keep].tolist(), at[keep].tolist()))

    def apply(self, t: str, k: int) -> str:
        for move in self.moves[k]:
            t = t.translate(self.texts[move])
        return t


def _opened(u: str) -> Iterator[tuple[str, tuple[str, str]]]:
    """Texts that an escape or bytes read as UTF-8 hide, with the move."""
    if _ESCAPE.search(u):
        v = unescape(u)
        if v != u:
            yield v, ("unescape", "")
    if u.isascii():
        return
    for enc in SINGLE:
        raw = _encode(u, enc)
        if raw is not None:
            try:
                yield raw.decode("utf-8"), (enc, "utf_8")
            except UnicodeDecodeError:
                continue


def search(t: str, model: Plausibility, goal=acceptable, gain: float = MIN_GAIN / 3, count: list[int] | None = None) -> tuple[str, float, tuple[tuple[str, str], ...]]:
    """Cheapest acceptable text that the moves reach from ``t`` and that saves at least ``gain`` bits, its
    cost, and the moves.

    The queue holds states by a bound that no text behind them can cost less than: texts whose escapes
    and UTF-8 readings are to be opened (every reading halves the characters beyond ASCII at least, so that
    there is no other limit on their number), rows of exchanges by the least bits of their characters,
    and texts by their cost. The first acceptable text that leaves the queue is the cheapest, and the
    search ends. A valid reading as UTF-8 is evidence by itself and saves bits; an exchange of single-byte
    sets costs one. Two of them on end come last, where nothing else is acceptable, and must give known words.
    """
    if model.exchanges is None:
        model.exchanges = Exchanges(model)
    table = model.exchanges
    start = model.text(t)
    heap, visited, number = [(-math.inf, 0, 0, t, (), 0.0)], {t}, 0

    def offer(v: str, path: tuple, moved: float, last: float = 0.0) -> None:
        nonlocal number
        if not _BROKEN.search(v) and not _IRREGULAR.search(v) and (c := model.text(v) + moved) <= start - gain:
            number += 1
            heapq.heappush(heap, (c + last, number, 2, v, path, c))

    while heap:
        bound, _, kind, u, path, moved = heapq.heappop(heap)
        if count is not None:
            count[0] += 1
        if kind == 2:  # a text with its cost
            if goal(u, t, path, model) and (len(path) < 2 or not _twice(path) or _all_known(u, model)):
                return u, moved, path
        elif kind == 1:  # the next of a row of exchanges
            of, row, at = u
            v = table.apply(of, row[at][1])
            last = LAST if row[at][1] >= len(table.single) else 0.0
            if v not in visited:
                visited.add(v)
                offer(v, (*path, *table.moves[row[at][1]]), moved + float(table.cost[row[at][1]]), last)
            if at + 1 < len(row):
                number += 1
                heapq.heappush(heap, (row[at + 1][0] + moved + last, number, 1, (of, row, at + 1), path, moved))
        elif kind == 3:  # two exchanges, where nothing else is acceptable
            if row := table.below(table.codes(u), start - gain - moved, True):
                number += 1
                heapq.heappush(heap, (row[0][0] + moved + LAST, number, 1, (u, row, 0), path, moved))
        else:  # open: readings of what it hides, and a row of exchanges
            for v, move in _opened(u):
                if v not in visited:
                    visited.add(v)
                    cost = moved - (UTF8_BITS if move[1] == "utf_8" else -SINGLE_BITS)
                    offer(v, (*path, move), cost)
                    beyond = sum(not c.isascii() for c in v)
                    if beyond or _ESCAPE.search(v):
                        number += 1
                        heapq.heappush(heap, (cost - UTF8_BITS * beyond.bit_length(), number, 0, v, (*path, move), cost))
            if not u.isascii() and (codes := table.codes(u)) is not None:
                if row := table.below(codes, start - gain - moved, False):
                    number += 1
                    heapq.heappush(heap, (row[0][0] + moved, number, 1, (u, row, 0), path, moved))
                if sum(not c.isascii() for c in u) > 2:  # a word of three letters at least
                    number += 1
                    heapq.heappush(heap, (moved + LAST, number, 3, u, path, moved))
    return t, start, ()


def _twice(path: tuple[tuple[str, str], ...]) -> bool:
    """Whether two exchanges of single-byte sets follow each other."""
    plain = [m[1] not in ("utf_8", "") for m in path]
    return any(a and b for a, b in zip(plain, plain[1:]))


def _all_known(t: str, model: Plausibility) -> bool:
    words = _WORD.findall(t.lower())
    return bool(words) and all(len(w) > 2 and w in model.known for w in words)


_LATIN = re.compile("[A-Za-z]")
_CYRILLIC_OR_GREEK = re.compile("[\u0370-\u04ff]")
_ODD_RUN = re.compile(r"[^\x00-\x7fА-яЁё]+")
_MARK_BEFORE = re.compile("[‘’“”•–—…]([а-яё].*)")  # a mark that may stand for a capital
_PLAIN = re.compile("[А-яЁё]")


class Restorer:
    """Verdicts on units, remembered: None (fine) or (restored text or None, moves, sure)."""

    def __init__(self, model: Plausibility):
        self.model, self.memo = model, {}
        self.runs: dict[str, list[tuple[str, tuple[str, str], str]]] = {}

    def readings(self, run: str) -> list[tuple[str, tuple[str, str], str]]:
        """(text, move, signs that only the original may bring) of every reading of a few characters."""
        if (found := self.runs.get(run)) is None:
            if len(self.runs) > MEMO:
                self.runs.clear()
            found = self.runs[run] = []
            for v, move in moves(run):
                if not _BROKEN.search(v):
                    single = move[1] not in ("utf_8", "")
                    found.append((v, move, "".join(c for c in v if single and not c.isascii() and c not in _QUOTES and not _WORD.match(c) and not 0x300 <= ord(c) < 0x370)))
        return found

    def known(self, unit: str) -> bool:
        core = unit.translate(_INVISIBLE).strip(_EDGE)
        if not core or core.isascii():
            return all(c in _COMMON_SIGNS or c.isascii() for c in unit)
        if not (core.islower() or core[0].isupper() and (core[1:].islower() or len(core) == 1)):
            return False
        if any(ord(c) > 127 and c not in _COMMON_SIGNS for c in unit if not c.isalpha() and c not in core):
            return False
        core = core.lower()
        return len(core) > 1 and (core in self.model.known or "-" in core and all(p in self.model.known for p in core.split("-")))

    def fine(self, unit: str) -> bool:
        if _ESCAPE.search(unit):
            return False
        if unit.isascii():
            return True
        if self.known(unit):
            return True
        text = unit.translate(_INVISIBLE)
        if (m := _MARK_BEFORE.match(unit)) and not self.known(m[1]):
            return False
        if _REPEATED.search(text):  # stretched letters
            text = _REPEATED.sub(lambda m: m[1], text)
            if self.known(text):
                return True
        if _LATIN.search(text) and _CYRILLIC_OR_GREEK.search(text):  # look-alikes of other scripts
            seen = unicodedata.normalize("NFC", visible(text))
            if self.known(seen.translate(TO_SCRIPT["latin"])) or seen.translate(TO_SCRIPT["latin"]).isascii():
                return True
            text = seen.translate(TO_SCRIPT["cyrillic"])
            if self.known(text):
                return True
        words = _WORD.findall(text)
        rest = _WORD.sub("", text)
        if any(not c.isascii() and c not in _COMMON_SIGNS and (ord(c) < 0x2600 or c == "�") for c in rest):
            return False
        for w in words:
            if w.isascii():
                continue
            if any(_script(c) == 4 for c in w):
                continue
            if len(w) < 3 or not (w.islower() or w[0].isupper() and w[1:].islower()):
                return False
            if self.model.word(w) > PLAUSIBLE * (len(w) + 1) or _ODD_RUN.search(w) and _PLAIN.search(w) and w.lower() not in self.model.known:
                return False
        return True

    def verdict(self, unit: str):
        if unit in self.memo:
            return self.memo[unit]
        if len(self.memo) > MEMO:
            self.memo.clear()
        v = self.memo[unit] = None if self.fine(unit) else self._verdict(unit)
        return v

    def _verdict(self, unit: str):
        model = self.model
        start = model.text(unit)
        best, cost, path = search(unit, model)
        if _PLAIN.search(unit):  # the odd characters alone, beside letters that are right
            for m in _ODD_RUN.finditer(unit):
                left, right = unit[m.start() - 1 : m.start()], unit[m.end() : m.end() + 1]
                for v, move, signs in self.readings(m[0]):
                    if signs and any(c not in unit for c in signs):
                        continue
                    if left.isalpha() and v[0].isalpha() and _script(left) != _script(v[0]) or right.isalpha() and v[-1].isalpha() and _script(right) != _script(v[-1]):
                        continue  # a word of two scripts
                    u = unit[: m.start()] + v + unit[m.end() :]
                    if _IRREGULAR.search(u):
                        continue
                    c = model.text(u) + 3.0
                    if v.isalpha() and self.known(u):  # a single wrong letter in a known word saves few bits
                        c -= MIN_GAIN
                    if c < cost and acceptable(u, unit, (move,), model):
                        best, cost, path = u, c, (move,)
        lost = "�" in unit
        if lost:
            whole, moved = self._with_losses(unit)
            return whole, moved or path, True
        single = len(unit.translate(_INVISIBLE).strip(_EDGE)) == 1 and _ODD_RUN.fullmatch(unit.strip(_EDGE)) and all(w in self.model.known for w in _WORD.findall(best.lower()))
        if path and start - cost >= (MIN_GAIN / 3 if single else MIN_GAIN):
            return best, path, True
        return None

    def _with_losses(self, unit: str) -> tuple[str | None, tuple[tuple[str, str], ...]]:
        """The parts around characters that are lost for good, restored by the one move that fits best."""
        best = None
        for enc in SINGLE:
            for dec in ("utf_8", *SINGLE):
                if enc == dec:
                    continue
                out = []
                for part in unit.split("�"):
                    raw = _encode(part, enc)
                    if raw is None:
                        break
                    out.append(raw.decode("utf-8", "replace") if dec == "utf_8" else raw.decode("latin_1").translate(_DECODE[dec]))
                else:
                    u = re.sub("�+", "�", "�".join(out))
                    cost = self.model.text(u) - 9 * sum(map(str.isalpha, u))
                    if best is None or cost < best[0]:
                        best = cost, u, ((enc, dec),)
        return best[1:] if best else (None, ())

    @staticmethod
    def _whole_path(unit: str, restored: str | None, path: tuple) -> tuple:
        """A move that gives the restored text from the whole unit, where ``path`` only does from a part."""
        if restored is None or apply(unit, path) == restored:
            return path
        whole = (((a, b),) for a in SINGLE for b in SINGLE if a != b)
        return next((p for p in whole if apply(unit, p) == restored), path)

    def _follows(self, unit: str, restored: str) -> bool:
        """Whether a unit beside a garbled one is garbled likewise, so that ``restored`` is the original."""
        if _BROKEN.search(restored):
            return False
        if self.model.text(restored) <= self.model.text(unit) + 1 and not (self.known(unit) and not self.known(restored)):
            return True
        old, new = unit.translate(_INVISIBLE).strip(_EDGE), restored.translate(_INVISIBLE).strip(_EDGE)
        if not new:
            return len(old) <= 1 and not old.islower() and any(c in "–—…" for c in restored)
        if new.lower() not in self.model.known or not (new.islower() or new[0].isupper() and (len(new) == 1 or new[1:].islower())):
            return False
        return old.lower() not in self.model.known or len(old) > 1 and old.isupper()

    def spans(self, text: str) -> list[tuple[int, int, str | None]]:
        """Garbled stretches of a text: (start, end, restored); [] for a text that is fine."""
        if text.isascii() and "&" not in text and "\\u" not in text and "%" not in text:
            return []
        units = [(m.start(), m.end(), m[0]) for m in _UNIT.finditer(text)]
        found: dict[int, tuple[int, int, str | None]] = {}
        paths: dict[int, tuple] = {}
        for i, (a, b, u) in enumerate(units):
            v = self.verdict(u)
            if v is not None:
                found[i], paths[i] = (a, b, v[0]), self._whole_path(u, v[0], v[1])
        if not found:
            return []
        # a short unit has several readings: the one of most of the text is taken where it fits
        main = Counter()
        for i in found:
            main[paths[i]] += found[i][1] - found[i][0]
        fit = lambda u, p: self.model.text(v) if (v := apply(u, p)) is not None and not _BROKEN.search(v) and not _IRREGULAR.search(v) else 2 * self.model.text(u)
        way = min((p for p, _ in main.most_common(4)), key=lambda p: sum(fit(text[a:b], p) for a, b, _ in found.values())) if len(main) > 1 else next(iter(main))
        for i, (a, b, v) in found.items():
            if way and paths[i] != way and (u := apply(text[a:b], way)) not in (None, v, text[a:b]) and "\ufffd" not in text[a:b] and (self.known(u) or acceptable(u, text[a:b], way, self.model)):
                found[i], paths[i] = (a, b, u), way
        # neighbours of a garbled unit: what the same moves turn into something as plausible is garbled too
        for i in sorted(found):
            if not paths[i]:
                continue
            for step in (1, -1):
                j = i + step
                while 0 <= j < len(units) and j not in found:
                    u = units[j][2]
                    if u.isascii():
                        j += step
                        continue
                    v = apply(u, paths[i])
                    if v == u:  # the same in both sets: neither for nor against
                        j += step
                        continue
                    if v is None or not self._follows(u, v):
                        break
                    found[j], paths[j] = (units[j][0], units[j][1], v), paths[i]
                    j += step
        return [found[i] for i in sorted(found)]


def apply(t: str, path: tuple[tuple[str, str], ...]) -> str | None:
    """The text after the moves of ``path``; None where one doesn't apply."""
    for enc, dec in path:
        if enc == "unescape":
            t = unescape(t)
            continue
        raw = _encode(t, enc)
        if raw is None:
            return None
        if dec == "utf_8":
            try:
                t = raw.decode("utf-8")
            except UnicodeDecodeError:
                return None
        else:
            t = raw.decode("latin_1").translate(_DECODE[dec])
    return t


def bounded(forms: DataFrame) -> DataFrame:
    """The rows, of which a hash each goes to every worker: an error beyond MAX_KNOWN, none is dropped."""
    if forms.limit(MAX_KNOWN + 1).count() > MAX_KNOWN:
        raise ValueError(f"more than {MAX_KNOWN} reference forms")
    return forms


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``gram, n``: the counts of one task; a trigram has three characters, a character one."""
    three, one = gram_counts(f for batch in batches for f in batch.column("form").to_pylist())
    grams = [*three.items(), *one.items()]
    yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in grams], pa.string()), pa.array([n for _, n in grams], pa.int64())], names=["gram", "n"])


def learn(forms: DataFrame, tasks: int | None = None) -> Plausibility:
    """The cost model, its trigrams counted over all forms (by ``tasks`` tasks), and the set of all forms.

    What reaches the driver is one row a distinct trigram or character, and the hashes."""
    rows = settle(forms.where("form IS NOT NULL").select(F.lower("form").alias("form")).distinct())  # read twice
    spread = rows.repartition(tasks) if tasks else rows
    grams = spread.mapInArrow(_counts, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    three, one = Counter(), Counter()
    for g, n in sorted(zip(grams["gram"], grams["n"])):
        (one if len(g) == 1 else three)[g] = n
    hashes = bounded(rows).select(F.xxhash64("form").alias("h")).toArrow()["h"].to_numpy()
    return Plausibility([], Forms(hashes), (three, one))


def restore(text: str, spans: list[tuple[int, int, str | None]]) -> str | None:
    """The text with its garbled stretches replaced; None if one of them can't be restored."""
    if any(v is None for _, _, v in spans):
        return None
    out, at = [], 0
    for a, b, v in spans:
        out += [text[at:a], v]
        at = b
    return "".join([*out, text[at:]])


def _rows(model: Plausibility, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            keys, spans, restored = [], [], []
            for k, t in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist()):
                if found := restorer.spans(t):
                    keys.append(k)
                    spans.append([{"start": a, "end": b} for a, b, _ in found])
                    restored.append(restore(t, found))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(restored, pa.string())], names=[key, "spans", "restored"])

    return run


def garbled_sentences(sentences: DataFrame, forms: DataFrame | Plausibility) -> DataFrame:
    """``sent_key, spans, restored`` of sentences whose text was decoded wrongly, wholly or in part.

    ``restored`` is NULL where characters are lost for good. NULL and empty texts are never found;
    repeated rows are judged alike.
    """
    model = forms if isinstance(forms, Plausibility) else learn(forms)
    rows = sentences.where("text IS NOT NULL AND sent_key IS NOT NULL").select("sent_key", "text")
    return rows.mapInArrow(_rows(model, "sent_key"), "sent_key bigint, spans array<struct<start:int,end:int>>, restored string")


def _token_rows(model: Plausibility):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        memo: dict[str, tuple[int, str | None]] = {}  # 0 fine, 1 open (the sentence decides), 2 garbled
        for batch in batches:
            encoded = pc.dictionary_encode(batch.column("text"))
            kind, restored = [], []
            for t in encoded.dictionary.to_pylist():
                if (v := memo.get(t)) is None:
                    if len(memo) > MEMO:
                        memo.clear()
                    if spans := restorer.spans(t):
                        v = (2, restore(t, spans))
                    else:
                        v = (0 if t.isascii() or (len(t) > 2 and restorer.known(t)) else 1, None)
                    memo[t] = v
                kind.append(v[0])
                restored.append(v[1])
            each = pa.array(kind, pa.int8()).take(encoded.indices)
            keep = pc.greater(each, 0)
            yield pa.RecordBatch.from_arrays([*(c.filter(keep) for c in batch.columns), pc.equal(each, 2).filter(keep), pa.array(restored, pa.string()).take(encoded.indices).filter(keep)], names=[*batch.schema.names, "sure", "restored"])

    return run


def garbled_tokens(tokens: DataFrame, garbled: DataFrame, forms: DataFrame | Plausibility) -> DataFrame:
    """``tok_key, restored`` of tokens whose text was decoded wrongly.

    A token that is too short to tell by itself is found if it lies in a garbled stretch of its
    sentence (``garbled``: result of garbled_sentences) with the same text there.
    """
    model = forms if isinstance(forms, Plausibility) else learn(forms)
    rows = tokens.where("text IS NOT NULL AND tok_key IS NOT NULL").select("tok_key", "sent_key", "text", "char_start", "char_end")
    judged = rows.mapInArrow(_token_rows(model), "tok_key bigint, sent_key bigint, text string, char_start int, char_end int, sure boolean, restored string")
    # one pass over the tokens: the sure ones and those that their sentence decides take the same join
    spans = garbled.select("sent_key", "spans")
    inside = F.exists("spans", lambda s: (s["start"] < F.col("char_end")) & (s["end"] > F.col("char_start")))
    return judged.join(spans, "sent_key", "left").where(F.col("sure") | inside).select("tok_key", "restored")


def garbled_records(sentences: DataFrame, tokens: DataFrame, forms: DataFrame) -> DataFrame:
    """``record_type, record_key, restored`` over both tables."""
    model = learn(forms)
    found = settle(garbled_sentences(sentences, model))  # read twice: searched once
    token = garbled_tokens(tokens, found, model)
    return found.select(F.lit("sentence").alias("record_type"), F.col("sent_key").alias("record_key"), "restored").unionByName(token.select(F.lit("token").alias("record_type"), F.col("tok_key").alias("record_key"), "restored"))
