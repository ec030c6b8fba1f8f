"""Splitting oversized sentences at natural places: lexical-cohesion segmentation.

At every gap between words the words of two sliding blocks, before and after it, are compared; the
similarity curve has valleys where the topic changes, as deep as the peaks beside them are high.
Each piece ends at the deepest valley among the most natural gaps (sentence ends, else clause marks,
else blanks) of its size window, and begins a set number of words before the piece before it ended.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS, MAX_TOKENS = 400, 60
OVERLAP_WORDS = 5
LEAST_FILL = 0.5  # share of the limits from which a piece may end
BLOCK = 12  # words of a block
_WORD = re.compile(r"\S+")
_SENTENCE_END = re.compile(r"[.!?…。！？։።][»”\"')\]」』】）〉》]*$")
_CLAUSE_END = re.compile(r"[,;:—–、，；：]$")
# Scripts that are written without blanks: every character (with the marks on it) is an atom there, and
# an ideographic mark ends one without a blank after it.
_BLANKLESS = re.compile(r"[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_TIGHT_SENTENCE_END = re.compile(r"[。！？｡။។][»”’\"')\]」』】）〉》]*$")
_TIGHT_CLAUSE_END = re.compile(r"[、，；：၊][»”’\"')\]」』】）〉》]*$")
_TIGHT = re.compile(f"{_BLANKLESS.pattern}|[。！？｡။។、，；：၊]")
_OPENING = frozenset("«“‘([{「『【（〈《")
_NEVER_FIRST = frozenset("ะาำະາຳーゝゞヽヾ々ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮヵヶ")
_LEADING_VOWELS = frozenset("เแโใไເແໂໃໄ")  # written before the consonant that they follow in speech


def _stem(word: str) -> str:
    return re.sub(r"\W", "", word).lower()[:5]


def similarities(words: list[str]) -> list[float]:
    """Cosine of the stems of the BLOCK words before and after each word; 0 for the first."""
    stems = [_stem(w) for w in words]
    left: Counter = Counter()
    right = Counter(s for s in stems[:BLOCK] if s)
    out = [0.0]
    for i in range(1, len(stems)):
        if s := stems[i - 1]:
            left[s] += 1
            right[s] -= 1
        if i > BLOCK and (s := stems[i - 1 - BLOCK]):
            left[s] -= 1
        if i + BLOCK - 1 < len(stems) and (s := stems[i + BLOCK - 1]):
            right[s] += 1
        dot = sum(n * right[s] for s, n in left.items() if n)
        norm = math.sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values() if n > 0))
        out.append(dot / norm if norm else 0.0)
    return out


def depths(curve: list[float]) -> list[float]:
    """Depth of every point below the peaks on its left and right."""
    n = len(curve)
    left, right = curve[:], curve[:]
    for i in range(1, n):
        if left[i - 1] >= curve[i]:
            left[i] = left[i - 1] if curve[i] <= curve[i - 1] else curve[i]
    for i in range(n - 2, -1, -1):
        if right[i + 1] >= curve[i]:
            right[i] = right[i + 1] if curve[i] <= curve[i + 1] else curve[i]
    return [(a - c) + (b - c) for a, b, c in zip(left, right, curve)]


def _forward(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The longest chain of (number, start, end) in which no span begins before the one before ends."""
    ends, last, back = [], [], []  # of the chain of each length: least end, its last span; the span before each
    for k, (_, a, b) in enumerate(spans):
        n = bisect_right(ends, a)
        back.append(last[n - 1] if n else -1)
        if n == len(ends):
            ends.append(b)
            last.append(k)
        elif b < ends[n]:
            ends[n], last[n] = b, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(spans[k])
        k = back[k]
    return out[::-1]


def place_tokens(text: str, tokens: list[tuple[str | None, int | None, int | None]]) -> list[tuple[int, int]]:
    """Spans of the tokens in the text: their own where the form stands, else their own if they fit
    between those, else the next place of their form there, else an empty span; tokens without place
    are spread evenly between their neighbours."""
    own = [(i, a, b) for i, (_, a, b) in enumerate(tokens) if a is not None and b is not None and 0 <= a < b <= len(text)]
    placed = _forward([(i, a, b) for i, a, b in own if text[a:b] == tokens[i][0]])
    bounds = [(-1, 0, 0), *placed, (len(tokens), len(text), len(text))]
    sure, k = {i for i, _, _ in placed}, 0
    between: list[list[tuple[int, int, int]]] = [[] for _ in bounds]
    for i, a, b in own:
        if i not in sure:
            while bounds[k + 1][0] < i:
                k += 1
            if bounds[k][2] <= a and b <= bounds[k + 1][1]:
                between[k].append((i, a, b))
    bounds = [x for k, bound in enumerate(bounds) for x in (bound, *_forward(between[k]))]
    out: list[tuple[int, int]] = []
    for (i, _, at), (j, until, end) in zip(bounds, bounds[1:]):
        waiting = 0  # tokens without place since the last that has one
        for n in range(i + 1, j + 1):
            if n < j:
                form = tokens[n][0]
                a = text.find(form, at, until) if form else -1
                if a < 0:
                    waiting += 1
                    continue
                b = a + len(form)
            else:
                a, b = until, end
            spread = [at + (a - at) * m // (waiting + 1) for m in range(1, waiting + 1)]
            out += [(x, x) for x in spread]
            if n < len(tokens):
                out.append((a, b))
            waiting, at = 0, b
    return out


def _characters(word: str) -> list[int]:
    """Places within a word where a script without blanks may be cut: before its characters, but not
    before a mark on one or a closing or end mark, nor after an opening one or a vowel written first."""
    out = []
    for i in range(1, len(word)):
        c, before = word[i], word[i - 1]
        if not (_BLANKLESS.match(c) or _BLANKLESS.match(before) or _TIGHT_SENTENCE_END.search(before) or _TIGHT_CLAUSE_END.search(before)):
            continue
        if before in _OPENING or before in _LEADING_VOWELS or before in "\u1039\u17d2" or unicodedata.category(c)[0] == "M" or c in _NEVER_FIRST:
            continue
        if not c.isalnum() and c not in _OPENING:
            continue
        out.append(i)
    return out


def atoms_of(text: str, spans: list[tuple[int, int]] | None, max_chars: int) -> list[tuple[int, int]]:
    """Stretches that stay whole: words (characters in a script without blanks), glued where a token
    spans several, cut where one is too long."""
    words = []
    for m in _WORD.finditer(text):
        places = [m.start(), *(m.start() + i for i in _characters(m[0])), m.end()] if _TIGHT.search(m[0]) else [m.start(), m.end()]
        words += zip(places, places[1:])
    if spans:
        cuts = sorted({a for a, b in spans if b > a} | {a for a, _ in words})
        held = sorted((a, b) for a, b in spans if b > a)
        bounds, k = [], 0
        for c in cuts:
            while k < len(held) and held[k][1] <= c:
                k += 1
            if not (k < len(held) and held[k][0] < c < held[k][1]):
                bounds.append(c)
        words = []
        for i, c in enumerate(bounds):
            end = bounds[i + 1] if i + 1 < len(bounds) else len(text)
            piece = text[c:end].rstrip()
            if piece:
                words.append((c, c + len(piece)))
        if words and text[: words[0][0]].strip():
            words.insert(0, (len(text) - len(text.lstrip()), words[0][0]))
    out = []
    for a, b in words:
        if b - a > max_chars:  # a single word too long for a piece
            step = max(1, max_chars // 20)
            while b - a > step:
                out.append((a, a + step))
                a += step
        out.append((a, b))
    return out


def cut(text: str, spans: list[tuple[int, int]] | None, max_chars: int = MAX_CHARS, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_WORDS) -> list[tuple[int, int, int]]:
    """Pieces as (start, end, characters shared with the piece before); [] for a blank text."""
    return [p[:3] for p in cut_with_tokens(text, spans, max_chars, max_tokens, overlap)]


def cut_with_tokens(text: str, spans: list[tuple[int, int]] | None, max_chars: int, max_tokens: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces as (start, end, characters shared with the piece before, first token, token after the last).

    Where more than ``max_tokens`` tokens begin at one atom, it comes out again for what exceeds them."""
    atoms = atoms_of(text, spans, max_chars)
    if not atoms:
        return []
    n = len(atoms)
    starts = sorted(a for a, _ in spans) if spans else []
    # tokens that begin before the i-th atom; those before the first belong to it
    count = [0, *(bisect_left(starts, a) for a, _ in atoms[1:]), len(starts)]
    words = [text[a:b] for a, b in atoms]
    depth = depths(similarities(words))
    kind = [0] * (n + 1)  # of the gap before the i-th atom
    for i in range(1, n):
        end = atoms[i - 1][1]
        before, loose = text[max(0, end - 8) : end], end < atoms[i][0]
        if not loose and not (text[end].isalnum() or text[end] in _OPENING):
            continue  # a closing mark belongs to what stands before it
        kind[i] = 3 if (_SENTENCE_END if loose else _TIGHT_SENTENCE_END).search(before) else 2 if (_CLAUSE_END if loose else _TIGHT_CLAUSE_END).search(before) else 1 if loose else 0
    pieces, i, before = [], 0, 0
    while True:
        a = atoms[i][0]
        last = max(i, before)  # the piece must go beyond the one before
        while last + 1 < n and atoms[last + 1][1] - a <= max_chars and count[last + 2] - count[i] <= max_tokens:
            last += 1
        if last + 1 >= n:
            pieces.append((i, n))
            break
        least = [j for j in range(before + 1, last + 2) if j > i and (atoms[j - 1][1] - a >= LEAST_FILL * max_chars or count[j] - count[i] >= LEAST_FILL * max_tokens)] or [last + 1]
        best = max(least, key=lambda j: (kind[j], round(depth[j], 6), j))
        pieces.append((i, best))
        before = best
        # the overlap: OVERLAP_WORDS atoms, fewer where they would take a quarter of the next piece
        i = best
        while i > pieces[-1][0] + 1 and best - i < overlap and atoms[best - 1][1] - atoms[i - 1][0] <= max_chars // 4 and count[best] - count[i - 1] <= max_tokens // 4:
            i -= 1
        while i < best and (atoms[best][1] - atoms[i][0] > max_chars or count[best + 1] - count[i] > max_tokens):
            i += 1
    out = []
    for k, (i, j) in enumerate(pieces):
        start, end = atoms[i][0], atoms[j - 1][1]
        first, stop = count[i], count[j]
        out.append((start, end, max(0, out[-1][1] - start) if k else 0, first, min(stop, first + max_tokens)))
        while (first := first + max_tokens) < stop:
            out.append((start, end, end - start, first, min(stop, first + max_tokens)))
    return out


def _rows(max_chars: int, max_tokens: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            flat = lists.flatten()
            offsets = lists.offsets.to_numpy()
            valid = lists.is_valid().to_pylist()
            fields = [flat.field(f).to_pylist() for f in ("text", "start_char", "end_char")]
            keys, number, total, texts, start, end, shared, take, sizes, none = [], [], [], [], [], [], [], [], [], []
            for r, (key, text) in enumerate(zip(batch.column("sent_key").to_pylist(), batch.column("text").to_pylist())):
                lo, hi = (int(offsets[r]), int(offsets[r + 1])) if valid[r] else (0, 0)
                if text is None or not text.strip():
                    # tokens alone, or blanks alone: runs of tokens with the same overlap
                    size = max(1, hi - lo)
                    pieces, a = [], 0
                    while True:
                        b = min(size, a + max_tokens)
                        pieces.append((None, None, 0, lo + a if valid[r] else 0, lo + b if valid[r] and hi > lo else lo))
                        if b >= size:
                            break
                        a = b - min(overlap, max_tokens // 4)
                else:
                    spans = place_tokens(text, list(zip(*(f[lo:hi] for f in fields)))) if valid[r] else None
                    pieces = [(a, b, s, lo + x, lo + y) for a, b, s, x, y in cut_with_tokens(text, spans, max_chars, max_tokens, overlap)]
                for k, (a, b, s, x, y) in enumerate(pieces):
                    keys.append(key)
                    number.append(k)
                    total.append(len(pieces))
                    texts.append(None if a is None else text[a:b])
                    start.append(a)
                    end.append(b)
                    shared.append(s)
                    take += range(x, y)
                    sizes.append(y - x)
                    none.append(not valid[r])
            bounds = pa.array([0, *accumulate(sizes)], pa.int32())
            kept = pa.ListArray.from_arrays(bounds, flat.take(pa.array(take, pa.int64())), mask=pa.array(none, pa.bool_()) if none else None)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(number, pa.int32()), pa.array(total, pa.int32()), pa.array(texts, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(shared, pa.int32()), kept], names=["sent_key", "piece", "pieces", "text", "start_char", "end_char", "overlap", "tokens"])

    return run


def oversized(max_chars: int = MAX_CHARS, max_tokens: int = MAX_TOKENS):
    return F.coalesce(F.length("text") > max_chars, F.lit(False)) | F.coalesce(F.size("tokens") > max_tokens, F.lit(False))


def split_oversized(sentences: DataFrame, max_chars: int = MAX_CHARS, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """``sent_key, piece, pieces, text, start_char, end_char, overlap, tokens, oversized`` of every row.

    Offsets count in the row's text. Every piece has at most ``max_chars`` characters and
    ``max_tokens`` tokens; together the pieces hold every character but outer blanks, and every token.
    Rows within the limits are one piece as they are, NULL tokens stay NULL, a NULL or blank text is
    cut by its tokens alone. A single word longer than ``max_chars`` is cut by length. Tokens that
    can't be found in the text are spread between their neighbours; where more than ``max_tokens``
    begin at one word, it is repeated for the rest. Repeated rows are cut alike; other columns are
    not read.
    """
    rows = sentences.select("sent_key", "text", "tokens").withColumn("oversized", oversized(max_chars, max_tokens))
    kind = dict(rows.dtypes)["tokens"]
    small = rows.where(~F.col("oversized")).select("sent_key", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), "text", F.when(F.col("text").isNotNull(), 0).alias("start_char"), F.length("text").alias("end_char"), F.lit(0).alias("overlap"), "tokens", "oversized")
    schema = f"sent_key bigint, piece int, pieces int, text string, start_char int, end_char int, overlap int, tokens {kind}"
    large = rows.where("oversized").drop("oversized").mapInArrow(_rows(max_chars, max_tokens, overlap), schema)
    return small.unionByName(large.withColumn("oversized", F.lit(True)))
