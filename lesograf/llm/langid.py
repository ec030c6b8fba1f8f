"""Language of texts and of their parts: prediction by partial matching.

For every language a tree of byte contexts of up to ORDER bytes holds the frozen statistics of its
training text. The code length of a byte is taken from the longest known context; a byte that is new
there costs an escape to the next shorter one (method C). Contexts begin at the blank before a word,
so the exact code length of a text is the sum of its words' code lengths, and each distinct word is
coded once per task. Sentences are labelled by least code length, a change of language from one
sentence to the next costs SWITCH_BITS (Viterbi).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lesograf.llm.seeds import SEEDS

ORDER = 6  # bytes of context; three Cyrillic letters
SWITCH_BITS = 14.0
SAMPLE_ROWS = 4000  # bound of the labelled rows that the models are fitted on, least hashes of doc_id
SAMPLE_CHARS = (40, 2000)
MEMO = 400_000
CAP_BITS = 20.0  # that a word may tell against a language
RARE_BITS = 25.0  # that a sentence costs in a language of which the labelled rows have no sentence
WHOLE = 3  # words from which a sentence counts as a whole one beside others; with an end mark one less

# Codes of languages: two letters, then the three-letter codes and names in use.
CODES = """
ar ara arabic
be bel belarusian
bg bul bulgarian
ca cat catalan
cs ces cze czech
da dan danish
de deu ger german
el ell gre greek
en eng english
es spa spanish
et est estonian
fi fin finnish
fr fra fre french
he heb iw hebrew
hi hin hindi
hr hrv scr croatian
hu hun hungarian
hy hye arm armenian
is isl ice icelandic
it ita italian
ja jpn japanese
ka kat geo georgian
kk kaz kazakh
ko kor korean
la lat latin
lt lit lithuanian
lv lav latvian
mk mkd mac macedonian
nl nld dut dutch
no nor nb nob nn nno norwegian
pl pol polish
pt por portuguese
ro ron rum romanian
ru rus russian
sk slk slo slovak
sl slv slovenian
sr srp scc serbian
sv swe swedish
th tha thai
tr tur turkish
tt tat tatar
uk ukr ukrainian
vi vie vietnamese
zh zho chi cmn chinese
"""
_CODE = {name: line.split()[0] for line in CODES.strip().split("\n") for name in line.split()}

# Languages that their script alone tells, by first and last code point.
SCRIPTS = (("hy", 0x531, 0x586), ("he", 0x5D0, 0x5EA), ("ar", 0x621, 0x6D3), ("hi", 0x904, 0x963), ("th", 0xE01, 0xE4E), ("ka", 0x10D0, 0x10FA), ("ja", 0x3041, 0x30FF), ("zh", 0x4E00, 0x9FFF), ("ko", 0xAC00, 0xD7A3), ("el", 0x391, 0x3C9))

# Usual ways to write Russian in Latin letters.
_LATIN_RU = (
    dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e yo zh z i y k l m n o p r s t u f h ts ch sh sch  y  e yu ya".split(" "))),
    dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e jo zh z i j k l m n o p r s t u f h c ch sh shh ' y ' e ju ja".split(" "))),
    dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i i k l m n o p r s t u f kh ts ch sh shch ie y  e iu ia".split(" "))),
    dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e ë ž z i j k l m n o p r s t u f ch c č š šč  y ' è ju ja".split(" "))),
)
_SR_LATIN = dict(zip("абвгдђежзијклљмнњопрстћуфхцчџш", "a b v g d đ e ž z i j k l lj m n nj o p r s t ć u f h c č dž š".split(" ")))

_WORD = re.compile(r"[^\W\d_]+(?:['’ʼ\-‐̀-ͯ]+[^\W\d_]+)*['’ʼ]?")
_END_MARK = re.compile(r"[.!?…][\"»”’)\]]*$")
_BREAK = re.compile(r"[.!?…。！？։।]+[\"»”’)\]]*(?=\s|$|[^\W\d_])|\n+|[«»„“”\"]")
_MARKUP = re.compile(r"^(?:#(?! ?text ?=)[^\n]*|# ?text ?= ?|[0-9][0-9.\-]*\t[^\n]*)|(?:https?://|www\.)\S+|\S+@\S+\.\S+|<[^<>\n]{1,200}>", re.M)
_COLUMNS = re.compile(r"^([0-9][0-9.\-]*\t)([^\t\n]*)([^\n]*)$", re.M)


def code_of(label: str | None) -> str | None:
    """Two-letter code of a label: any case, region, script or three letters; None if it names no known language."""
    if label is None:
        return None
    head = re.split(r"[-_\s]", label.strip().lower())[0]
    return _CODE.get(head)


class ByteTree:
    """Context tree of one language: context -> {next byte: bits}, with the escape's bits."""

    def __init__(self, words: Counter):
        counts: dict[bytes, Counter] = {}
        for word, n in words.items():
            s = b" " + word.encode() + b" "
            for i in range(1, len(s)):
                for k in range(min(i, ORDER) + 1):
                    counts.setdefault(s[i - k : i], Counter())[s[i]] += n
        self.bits: dict[bytes, tuple[float, dict[int, float]]] = {}
        for context, c in counts.items():
            total, kinds = sum(c.values()), len(c)
            self.bits[context] = (math.log2((total + kinds) / kinds), {b: math.log2((total + kinds) / n) for b, n in c.items()})

    def cost(self, word: str) -> float:
        s, out = b" " + word.encode() + b" ", 0.0
        for i in range(1, len(s)):
            for k in range(min(i, ORDER), -1, -1):
                node = self.bits.get(s[i - k : i])
                if node is None:
                    continue
                if (b := node[1].get(s[i])) is not None:
                    out += b
                    break
                out += node[0]
            else:
                out += 8.0
        return out


class Languages:
    """The trees, and the costs of words under all of them."""

    def __init__(self, texts: dict[str, Counter], supported: frozenset[str] = frozenset()):
        self.names = sorted(texts)
        self.cyrillic = ["Ѐ" <= next(iter(texts[n])) <= "ԯ" for n in self.names]
        self.start = [0.0 if n.split("-")[0] in supported else RARE_BITS for n in self.names]
        self.trees = [ByteTree(texts[n]) for n in self.names]
        self.code = [n.split("-")[0] for n in self.names]

    def costs(self, word: str) -> list[float]:
        return [t.cost(word) for t in self.trees]

    def word_costs(self, word: str) -> list[float]:
        """Costs for comparisons: a word tells CAP_BITS at most, and nothing between languages that
        are not written in its script (a foreign term in a sentence favours none of them)."""
        own = self.costs(word)
        cyrillic = "Ѐ" <= word[0] <= "ԯ"
        least = min(c for c, s in zip(own, self.cyrillic) if s == cyrillic)
        return [min(c, least + CAP_BITS) if s == cyrillic else least + CAP_BITS for c, s in zip(own, self.cyrillic)]


def _words(text: str) -> Counter:
    return Counter(w.lower() for w in _WORD.findall(text))


def _latin(words: Counter, tables) -> Counter:
    out: Counter = Counter()
    for table in tables:
        for w, n in words.items():
            out["".join(table.get(c, c) for c in w)] += n
    return out


def _with_latin(texts: dict[str, Counter]) -> dict[str, Counter]:
    return texts | {"ru-latn": _latin(texts["ru"], _LATIN_RU), "sr-latn": _latin(texts["sr"], (_SR_LATIN,))}


def fit(rows: list[tuple[str, str]]) -> Languages:
    """Models from (label, text) rows: the seeds first, then twice with the sentences of the rows on
    which the label and the models agree."""
    seeds = {k: _words(v) for k, v in SEEDS.items()}
    models = Languages(_with_latin(seeds))
    sentences = [(code, s) for label, text in rows if (code := code_of(label)) in seeds for s in re.split(r"(?<=[.!?…])\s+|\n+", masked(text)) if s.strip()]
    words = [(code, [w.lower() for w in _WORD.findall(s)]) for code, s in sentences]
    for _ in range(2):
        memo: dict[str, list[float]] = {}
        texts, supported = {k: Counter(v) for k, v in seeds.items()}, set()
        for code, ws in words:
            if not ws:
                continue
            total = np.sum([memo[w] if w in memo else memo.setdefault(w, models.costs(w)) for w in ws], axis=0)
            if models.names[int(np.argmin(total))] == code:
                texts[code].update(ws)
                if len(ws) >= WHOLE:
                    supported.add(code)
        models = Languages(_with_latin(texts), frozenset(supported))
    return models


def masked(text: str) -> str:
    """The text with markup, addresses and the token lines of treebank files blanked out, as long as before."""
    if "\t" not in text and "#" not in text and "@" not in text and "<" not in text and "/" not in text and "www." not in text:
        return text
    out = _MARKUP.sub(lambda m: "\n" * len(m[0]), text)
    if _WORD.search(out) is None and "\t" in text:  # token lines only: their forms
        out = _COLUMNS.sub(lambda m: "\n" * len(m[1]) + m[2] + " " * len(m[3]), text)
    return out


def _script_language(word: str) -> str | None:
    o = ord(word[0])
    if o < 0x370 or 0x400 <= o < 0x530:
        return None
    for code, a, b in SCRIPTS:
        if a <= o <= b:
            return "ja" if code == "zh" and any(0x3041 <= ord(c) <= 0x30FF for c in word) else code
    return None


class Labeller:
    def __init__(self, models: Languages):
        self.models = models
        self.others = [code for code, _, _ in SCRIPTS]
        self.codes = [*models.code, *self.others]
        self.start = np.array([*models.start, *([0.0] * len(self.others))], np.float32)
        self.index: dict[str, int] = {}
        self.rows: list[list[float]] = []
        self.table = np.zeros((0, len(self.codes)), np.float32)

    def _id(self, word: str) -> int:
        i = self.index.get(word)
        if i is None:
            low = word.lower()
            script = _script_language(low)
            if script is None:
                own = self.models.word_costs(low)
                row = own + [max(own) + CAP_BITS] * len(self.others)
            else:
                row = [14.0 * len(low)] * len(self.models.code) + [2.0 * len(low) if c == script or (script == "zh" and c == "ja") else 14.0 * len(low) for c in self.others]
                if script == "zh":
                    row[self.codes.index("ja", len(self.models.code))] += 1.0
            i = self.index[word] = len(self.rows)
            self.rows.append(row)
        return i

    def sentences(self, text: str) -> tuple[list[int], list[int], list[int], list[int], list[bool]]:
        """(word ids, first word, start, end of each sentence, whether it has an end mark)."""
        ids: list[int] = []
        first, starts, ends, marked = [], [], [], []
        text, at, get, find = masked(text), 0, self.index.get, _WORD.findall
        for end in [m.end() for m in _BREAK.finditer(text)] + [len(text)]:
            if end > at and (words := find(text, at, end)):
                new = [get(w) for w in words]
                if None in new:
                    new = [self._id(w) if i is None else i for w, i in zip(words, new)]
                first.append(len(ids))
                ids += new
                starts.append(text.index(words[0], at))
                ends.append(end)
                marked.append(_END_MARK.search(text, at, end) is not None)
            at = end
        return ids, first, starts, ends, marked

    def label(self, texts: list[str]) -> list[list[tuple[int, int, str, float, int]]]:
        """For each text its segments (start, end, language, confidence, words of its longest sentence)."""
        if len(self.index) > MEMO:
            self.__init__(self.models)
        parts = [self.sentences(t) for t in texts]
        if len(self.rows) > len(self.table):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], np.float32)])
        out = []
        for ids, first, starts, ends, marked in parts:
            if not ids:
                out.append([])
                continue
            cost = np.add.reduceat(self.table[np.array(ids)], np.array(first), axis=0) + self.start
            sizes = np.diff([*first, len(ids)])
            sizes += np.array(marked) & (sizes == WHOLE - 1)  # two words and an end mark are a whole sentence
            out.append(self._segments(cost, sizes, starts, ends))
        return out

    def _segments(self, cost: np.ndarray, sizes: np.ndarray, starts: list[int], ends: list[int]):
        n, k = cost.shape
        best = cost.argmin(1)
        if (best == best[0]).all():
            path = best
        else:  # Viterbi: staying is free, any change costs SWITCH_BITS
            total, back = cost[0].astype(np.float64), np.zeros((n, k), np.int32)
            for i in range(1, n):
                low = int(total.argmin())
                moved = total[low] + SWITCH_BITS
                stay = total <= moved
                back[i] = np.where(stay, np.arange(k), low)
                total = np.where(stay, total, moved) + cost[i]
            path = np.zeros(n, np.int64)
            path[-1] = total.argmin()
            for i in range(n - 1, 0, -1):
                path[i - 1] = back[i, path[i]]
        segments: list[tuple[int, int, str, float, int]] = []
        i = 0
        while i < n:
            j = i
            code = self.codes[path[i]]
            while j < n and self.codes[path[j]] == code:
                j += 1
            sums = cost[i:j].sum(0, dtype=np.float64)
            own = min(s for s, c in zip(sums, self.codes) if c == code)
            other = min(s for s, c in zip(sums, self.codes) if c != code)
            confidence = 1.0 / (1.0 + 2.0 ** max(-50.0, min(50.0, own - other)))
            segments.append((starts[i], ends[j - 1], code, float(confidence), int(sizes[i:j].max())))
            i = j
        return _whole(segments)


def _whole(segments: list[tuple[int, int, str, float, int]]) -> list[tuple[int, int, str, float, int]]:
    """Segments without any sentence of WHOLE words (names, terms, tags) go to the part before, or after."""
    if len(segments) < 2 or all(s[4] < WHOLE for s in segments):
        return segments
    out: list[tuple[int, int, str, float, int]] = []
    for k, s in enumerate(segments):
        code = s[2]
        if s[4] < WHOLE:
            code = out[-1][2] if out else next(t[2] for t in segments[k:] if t[4] >= WHOLE)
        if out and out[-1][2] == code:
            a = out[-1]
            out[-1] = (a[0], s[1], code, a[3] if s[4] < WHOLE else max(a[3], s[3]), max(a[4], s[4]))
        else:
            out.append((s[0], s[1], code, s[3], s[4]))
    return out


def sample(documents: DataFrame) -> list[tuple[str, str]]:
    """At most SAMPLE_ROWS labelled rows of SAMPLE_CHARS characters, by least hash of doc_id.

    Hashes above what SAMPLE_ROWS of these rows need, and a tenth for chance, are dropped where they
    are read, so that the driver gets little more than the sample, however many tasks there are."""
    eligible = documents.where(F.col("lang").isNotNull() & F.length("text").between(*SAMPLE_CHARS))
    share = min(1.0, 1.1 * SAMPLE_ROWS / max(1, eligible.count()))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    rows = eligible.where(h <= int(share * (1 << 40))).select("lang", "text", h.alias("h"))
    return [(r["lang"], r["text"]) for r in rows.orderBy("h").limit(SAMPLE_ROWS).collect()]


def _rows(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(models.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int32())]))
        for batch in batches:
            found = labeller.label([t or "" for t in batch.column("text").to_pylist()])
            segments = [[dict(zip(("start", "end", "lang", "confidence", "words"), s)) for s in one] for one in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(segments, kind)], names=["doc_id", "label", "segments"])

    return run


def segments(documents: DataFrame) -> DataFrame:
    """``doc_id, label, segments<start, end, lang, confidence, words>`` of every document.

    A segment is a run of sentences in one language; NULL, empty and wordless texts have none. The
    models are fitted on at most SAMPLE_ROWS labelled rows; all rows are labelled as a whole.
    """
    spark = documents.sparkSession
    models = spark.sparkContext.broadcast(fit(sample(documents)))  # bounded by SAMPLE_ROWS x SAMPLE_CHARS
    kind = "doc_id bigint, label string, segments array<struct<start:int,end:int,lang:string,confidence:double,words:int>>"
    return documents.select("doc_id", "lang", "text").mapInArrow(_rows(models), kind)


def label_code(label: str = "label"):
    """Column with the two-letter code of a label column, NULL if it names no known language."""
    head = F.split(F.lower(F.trim(F.col(label))), "[-_\\s]")[0]
    return F.create_map(*(F.lit(x) for pair in sorted(_CODE.items()) for x in pair))[head]


def found_languages(documents: DataFrame) -> DataFrame:
    """``doc_id, lang``: documents whose label is missing, no language or not the text's, and those
    with sentences in several languages; one row a language."""
    rows = segments(documents).where(F.size("segments") > 0)
    langs = F.array_distinct(F.transform("segments", lambda s: s["lang"]))
    rows = rows.select("doc_id", langs.alias("langs"), label_code().alias("code"))
    listed = rows.where((F.size("langs") > 1) | F.col("code").isNull() | (F.col("code") != F.col("langs")[0]))
    return listed.select("doc_id", F.explode("langs").alias("lang"))
