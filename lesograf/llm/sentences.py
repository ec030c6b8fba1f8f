"""Sentence units across languages and scripts.

Spaced scripts: the terminators of a text (with closing marks) are the nodes of a lattice. Each gap
gets a score from its left context (abbreviation, initial, unit, ellipsis), its right context (case,
opening word, dash of direct speech) and its depth in quotes and brackets; each edge between two
gaps gets a penalty if the stretch can't be a unit by itself. The best path through the lattice is
the segmentation. Scripts without blanks are cut at end marks; the cheapest path through the lattice of
dictionary words after the mark decides whether the sentence goes on instead: with a particle, or with
a clause that names the speaker, and not with a longer word that only begins like one. Scripts
without end marks are cut at blanks between their letters and at the end marks that stand outside
numbers and abbreviations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Abbreviations that never end a sentence.
NEVER = frozenset(
    """
    тел ул кв гл рис табл илл ст п пп им проф акад доц инж канд напр ок тов г-н г-жа см ср обл р-н пос оз св изд ред т е ч пл наб корп стр д пр
    mr mrs ms dr prof st sr jr approx fig figs no vol p pp ed vs gen col rev hon capt lt mt dept i.e e.g cf al
    z b d h abb s nr hr fr bzw ca vgl tel art bd bspw evtl ggf inkl
    m mme mlle env av tzn np ul prof. mgr inż hab wg śp
    डॉ د
    """.split()
)
# Abbreviations that may end a sentence: the word after them decides.
MAYBE = frozenset("руб коп тыс млн млрд кг г гг в вв см км мм м мин сек ч чел долл экз др проч etc usw p.m a.m inc ltd co corp jh chr itd itp uhr".split())
# Units of measure, which end a sentence after a number only.
UNITS = frozenset("руб коп тыс млн млрд кг см км мм м мин сек ч чел долл экз".split())
# Month names after a German ordinal.
MONTHS = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split())
# Own word lists of scripts without blanks, for the word lattice: particles that go on after a quotation
# (QUOTATIVE after any exclamation or question), speakers, verbs that name them, what may follow these, denials.
QUOTATIVE = frozenset("と って".split())
PARTICLES = QUOTATIVE | frozenset("は が を に の も".split())
SPEAKERS = frozenset("他 她 我 他们 她们 我们".split())
SPEECH = frozenset("说 问 道 喊".split())
AFTER_SPEECH = frozenset("着 了 过".split())
DENIALS = frozenset("没 没有 不 未 别".split())
# Words that only begin or end like those.
LONGER = frozenset(
    """
    とても とある とうとう とにかく とりあえず とはいえ ところが ところで ところ ともかく とき とっくに となり とたん とおり
    はい はじめ はじめて はっきり はやく はるか はず もう もし もしも もしかして もちろん もっと もともと もの もはや もうすぐ
    のち のんびり にっこり にわかに にもかかわらず がっかり がんばれ がんばって がんばろう
    说明 说法 说话 说不定 说实话 说起来 说到底 小说 学说 传说 据说 听说 再说 难说 问题 问候 学问 疑问 访问 提问 顾问 慰问
    道路 道理 道德 道具 道歉 道教 知道 味道 街道 频道 报道 难道 管道 轨道 隧道 跑道 通道 渠道 铁道 喊声 明天 明年 明白 明明
    """.split()
)
_WORDS = PARTICLES | SPEAKERS | SPEECH | AFTER_SPEECH | DENIALS | LONGER

_OPEN, _CLOSE = "«‘『「（([【《", "»’』」）)]】》"
_PAIR = dict(zip(_CLOSE, _OPEN))
_TERM = re.compile(r"(?:[.!?…‽]+|[。！？｡]+|[։।॥؟۔။។]+)[»”\"“’』」）)\]]*")
_PARAGRAPH = re.compile(r"[ \t\r]*\n[ \t\r]*(?:\n[ \t\r]*)+")
_LINE = re.compile(r"[^\n]+")
_MARKER = re.compile(r"[ \t]*(?:([-•*–—·▪◦])[ \t]+|(\d{1,3})([.)])[ \t]+(?=\D)|([a-zа-я])\)[ \t]+)")
_DASH = re.compile(r"\s*[—–―-]+\s+")
_THAI = re.compile(r"[ก-๛຀-໿က-႟ក-៿]")
_OWN_END = re.compile(r"[။។]")  # end marks of Burmese and Khmer
# Thai abbreviations before a name or number, and units that may end a sentence.
_TITLES = ("ดร", "ผศ", "รศ", "ศ", "นพ", "พญ", "ทพ", "โทร", "บจก", "หจก", "บมจ", "รร", "ทล", "ฉบ", "พล")
_SHORT_FORM = re.compile(r"(?:[ก-๎ກ-໎]{1,4}\.)+")
_UNITS_BEFORE_BLANK = re.compile(r"[\d๐-๙໐-໙]\s*(?:น|กม|กก|ซม|มม|ชม|ม|ก|ล|บ)$")
_WORD_BEFORE = re.compile("[^\\W_][\\w.\\-\u0300-\u036f\u0900-\u0dff]*$")
_ROMAN = re.compile(r"[IVXLCDM]+$|[ІХ]+$")
_CASELESS = re.compile(r"[֐-ࣿऀ-෿฀-໿ა-ჿ぀-ヿ㐀-鿿가-힣Ա-ֆ]")
# Months as a date names them.
_DATE = re.compile(r"\d{1,2}\s+(?:января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря)\b")
# German words that an ordinal number follows.
_ORDINAL = re.compile(r"\b(?:[Dd](?:er|ie|as|en|em|es)|[Aa]m|[Ii]m|[Vv]om|[Zz]um|[Zz]ur|[Bb]eim|[Ss]ein|[Ii]hr|[Jj]ede[rnms]?)\s+\d{1,3}$")
# Words that number a heading.
_HEADING = re.compile(r"(?:^|\n)\s*(?:Глава|Часть|Раздел|Том|Chapter|Part|Section|Kapitel|Teil|Chapitre)\s+\d{1,3}$")
_FAR = 60
_CLAUSE_MAX = 16
_KANA = re.compile(r"[ぁ-ヿ]")
_CLAUSE = re.compile(r"\w{1,%d}" % _CLAUSE_MAX)


def _quotes(text: str) -> list[tuple[int, int]]:
    """Matching quotation marks and brackets as (open, close), outermost only, within paragraphs."""
    spans: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for m in re.finditer(r"[«»„“”\"『』「」（）()\[\]【】《》]|\n[ \t\r]*\n", text):
        c, i = m[0], m.start()
        if c[0] == "\n":
            stack.clear()
            continue
        if c == '"':
            closes = stack and stack[-1][0] == '"'
            if any(o == '"' for o, _ in stack) and not closes:
                closes = True
                while stack[-1][0] != '"':
                    stack.pop()
        elif c == "“":
            closes = bool(stack) and stack[-1][0] == "„"
        elif c == "”":
            closes = bool(stack) and stack[-1][0] in "“„"
        else:
            closes = c in _CLOSE
            if closes and not (stack and stack[-1][0] == _PAIR[c]):
                if any(o == _PAIR[c] for o, _ in stack):
                    while stack[-1][0] != _PAIR[c]:
                        stack.pop()
                else:
                    continue
        if closes and stack:
            spans.append((stack.pop()[1], i))
        elif not closes:
            stack.append((c, i))
    spans.sort()
    outer: list[tuple[int, int]] = []
    for a, b in spans:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _list_lines(lines: list[tuple[int, int, str]]) -> set[int]:
    """Lines that are list items: marked lines of a run, without an end mark or numbered in order."""
    marks = [_MARKER.match(s) for _, _, s in lines]
    items: set[int] = set()
    for i, m in enumerate(marks):
        if m is None:
            continue
        for j in (i - 1, i + 1):
            if not 0 <= j < len(lines) or marks[j] is None:
                continue
            n = marks[j]
            if m[1] and n[1] == m[1] and not re.search(r"[.!?…][»\"”)]*\s*$", lines[i][2]) and not re.search(r"[.!?…][»\"”)]*\s*$", lines[j][2]):
                items.add(i)
            elif m[2] and n[2] and m[3] == n[3] and int(n[2]) - int(m[2]) == j - i:
                items.add(i)
            elif m[4] and n[4] and ord(n[4]) - ord(m[4]) == j - i:
                items.add(i)
    return items


def _read(text: str) -> list[str]:
    """Cheapest path through the lattice of dictionary words over a short stretch without blanks."""
    n = len(text)
    best = [(0.0, -1)] + [(float("inf"), -1)] * n
    for i in range(n):
        for k in range(1, min(6, n - i) + 1):
            w = text[i : i + k]
            cost = 0.5 if w in _WORDS else 1.5 if k == 1 else None
            if cost is not None and best[i][0] + cost < best[i + k][0]:
                best[i + k] = (best[i][0] + cost, i)
    out, i = [], n
    while i > 0:
        out.append(text[best[i][1] : i])
        i = best[i][1]
    return out[::-1]


def _caseless_gap(term: str, right: str, closed: bool) -> float | None:
    """Score of a gap before a letter without case; None where the sentence goes on, as the words of the
    lattice after it tell. After a closing mark that is a particle, or in a clause without kana a verb of
    speech at the beginning, after the speaker or at the end; else a quotative after ``！`` and ``？``."""
    clause = _CLAUSE.match(right)
    if clause is None or not (closed or "！" in term or "？" in term):
        return 2.0
    words = _read(clause[0])
    if not closed:
        return None if words[0] in QUOTATIVE and len(words) > 1 else 2.0
    if words[0] in PARTICLES:
        return None
    if not _KANA.search(clause[0]) and not right.startswith(("：", ":"), clause.end()):  # a colon: it names who speaks next
        if words[words[0] in SPEAKERS and len(words) > 1] in SPEECH:
            return None
        whole = clause.end() < _CLAUSE_MAX and DENIALS.isdisjoint(words)
        if whole and words[-2 if len(words) > 1 and words[-1] in AFTER_SPEECH else -1] in SPEECH:
            return None
    return 2.0


class Segmenter:
    def units(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of every unit, without outer whitespace; together they hold all other characters."""
        out: list[tuple[int, int]] = []
        at = 0
        low = self._low(text)
        for m in [*_PARAGRAPH.finditer(text), None]:
            end = m.start() if m else len(text)
            self._paragraph(text, at, end, low, out)
            at = m.end() if m else end
        return out

    @staticmethod
    def _low(text: str) -> bool:
        """Whether the writer left out capitals: next to no word begins with one."""
        if not (first := re.search(r"[^\W\d_]", text)) or not first[0].islower():
            return False
        words = re.findall(r"\b[^\W\d_]", text)
        return sum(map(str.isupper, words)) <= 0.02 * len(words)

    def _paragraph(self, text: str, start: int, end: int, low: bool, out: list[tuple[int, int]]) -> None:
        lines = [(start + m.start(), start + m.end(), m[0]) for m in _LINE.finditer(text[start:end])]
        items = _list_lines(lines) if len(lines) > 1 else set()
        at = None
        for i, (a, b, _) in enumerate(lines):
            if i in items:
                if at is not None:
                    self._stretch(text, at, lines[i - 1][1], low, out)
                    at = None
                self._put(text, a, b, out)
            elif at is None:
                at = a
        if at is not None:
            self._stretch(text, at, end, low, out)

    @staticmethod
    def _put(text: str, a: int, b: int, out: list[tuple[int, int]]) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    def _stretch(self, text: str, start: int, end: int, low: bool, out: list[tuple[int, int]]) -> None:
        part = text[start:end]
        blanks = _THAI.search(part) is not None and len(_THAI.findall(part)) * 2 > len(re.sub(r"\s", "", part))
        gaps = self._blank_gaps(part, low) if blanks else self._gaps(part, low)
        at = 0
        for g in self._path(part, gaps):
            self._put(text, start + at, start + g, out)
            at = g
        self._put(text, start + at, end, out)

    def _blank_gaps(self, part: str, low: bool) -> list[tuple[int, float]]:
        """Gaps of a script without end marks: end marks that are in no number or abbreviation, and
        blanks between its letters, unless the stretch has end marks of that script."""
        letter = lambda c: _THAI.match(c) is not None and not c.isdigit() and c != "฿"
        gaps = {g: s for g, s in self._gaps(part, low) if not (part[g - 1] == "." and g > 1 and letter(part[g - 2]))}
        own, quotes, q = _OWN_END.search(part) is not None, _quotes(part), 0
        for m in re.finditer(r"(?<=\S)\s+(?=\S)", part):
            a, b = m.span()
            while q < len(quotes) and quotes[q][1] < a:
                q += 1
            if q < len(quotes) and quotes[q][0] < a:
                continue
            if part[a - 1] == "." and a > 1 and letter(part[a - 2]):
                word = re.search(r"[^\s.]*$", part[max(0, a - 1 - _FAR) : a - 1])[0]
                short = len(word) < 5 or word.endswith(_TITLES)
                if (not short or _UNITS_BEFORE_BLANK.search(part[max(0, a - 1 - _FAR) : a - 1])) and (part[b].isalnum() or part[b] in _OPEN):
                    gaps[a] = 3.0
            elif not own and letter(part[a - 1]) and letter(part[b]) and not _SHORT_FORM.match(part, b):
                gaps[a] = 2.0
        return sorted(gaps.items())

    def _gaps(self, part: str, low: bool) -> list[tuple[int, float]]:
        quotes = _quotes(part)
        q, gaps = 0, []
        for m in _TERM.finditer(part):
            end = m.end()
            while q < len(quotes) and quotes[q][1] < m.start():
                q += 1
            # the marks after the terminator belong to it only as far as they close something
            k = m.start()
            while k < end and part[k] in ".!?…‽。！？｡։।॥؟۔။។":
                k += 1
            term_end = k
            inside = q < len(quotes) and quotes[q][0] < m.start() <= quotes[q][1]
            if inside:
                close = quotes[q][1]
                if close >= end or close < term_end:
                    continue
                end = close + 1
            else:
                end = term_end
            # a period after the closing mark: »., ).
            score = self._score(part, m.start(), term_end, end, inside, low)
            if score is not None:
                gaps.append((end, score))
        # a sentence that ends in quotation marks whose own end mark stands inside is seen above; «...». below
        return gaps

    def _score(self, part: str, t: int, term_end: int, end: int, closed: bool, low: bool) -> float | None:
        term = part[t:term_end]
        rest = part[end:]
        if not rest.strip():
            return None
        tight = not rest[0].isspace()
        after = rest.lstrip()
        left = part[max(0, t - _FAR) : t]
        word_m = _WORD_BEFORE.search(left)
        word = word_m[0] if word_m else ""
        strong = term[0] in "。！？｡։।॥؟۔။។"
        nxt = after[0]
        dash = _DASH.match(rest)
        if dash and after[0] in "—–―-":
            speech = after[1:].lstrip("—–―- ")
            if closed or not speech:
                return None
            c = next((x for x in speech if x.isalpha()), "")
            if not c or not c.isupper() and not _CASELESS.match(c):
                return None
            if term == "." and self._abbreviation(part, t, word, speech) == "never":
                return None
            return 4.0
        if nxt in ",;:)]}»”%/，、：；）」』":
            return None
        opened = after.lstrip("«„“\"'‘(（[「『—–-¿¡ ")
        c = opened[0] if opened else ""
        if strong:
            return _caseless_gap(term, opened if nxt == c else "", closed) if _CASELESS.match(c or "x") else 4.0
        if tight and not (closed and c):
            # without a blank: a new sentence after a word, no address, number or pair of initials
            if not (c.isupper() and nxt == c or _CASELESS.match(nxt)) and nxt not in "«„“\"—":
                return None
            if len(word) < 2 or not word[-1].islower() and not _CASELESS.match(word[-1]) and not word[-1].isdigit():
                return None
            if term == "." and ("." in word or word.lower() in NEVER or len(opened) > 1 and not (opened[1].isalpha() or opened[1] in " …,")):
                return None
            if re.search(r"(?:https?:|www\.|@)\S*$", part[max(0, t - _FAR) : end]):
                return None
        if c and _CASELESS.match(c):
            if term == "." and (word in NEVER or word.isdigit() and opened[0].isdigit()):
                return None
            return 4.0
        upper = c.isupper() or c.isdigit() or not c.isalnum()
        if set(term) <= {"…", "."} and (len(term) > 1 or term == "…"):
            if not upper and not (low and len(left.split()) > 1):
                return None
            return 3.0
        if len(term) > 1 or term in "!?‽":
            return 4.0 if upper or low else None
        # one period
        kind = self._abbreviation(part, t, word, opened)
        if kind == "never" or not (upper or low):
            return None
        if kind == "maybe":
            numbered = "\n" in rest[: len(rest) - len(after)] and re.match(r"\d+(?:\.\d+)+\s+[^\W\d_]", after)
            return 1.0 if c.isupper() or not c.isalnum() or numbered or _DATE.match(opened) else None
        if word.isdigit() and re.search(r"(?:^|\n)\s*\d{1,3}$", left) and t == len(left):
            return None
        if word.isdigit() and ((opened.split(None, 1) or [""])[0].strip(".,") in MONTHS or _ORDINAL.search(left) or _HEADING.search(left)):
            return None
        return 3.0

    @staticmethod
    def _abbreviation(part: str, t: int, word: str, opened: str) -> str:
        """'never', 'maybe' or '' for the word before a period."""
        if not word:
            return ""
        low = word.lower()
        before = part[max(0, t - len(word) - 12) : t - len(word)]
        if len(word) == 1 and word.isupper():
            return "" if _ROMAN.match(word) and not re.search(r"[^\W\d_]{2,}\.?\s*$", before) else "never"
        if re.search(r"(?:^|\W)т\.?\s*$", before) and low in ("д", "п", "т.д", "т.п") or low in ("т.д", "т.п"):
            return "maybe"
        if low == "пр" and re.search(r"(?:^|\W)и\s*$", before):
            return "maybe"
        if low in ("г", "гг"):
            return "maybe" if re.search(r"\d\s*$", before) else "never"
        if low in ("в", "вв"):
            return "maybe" if re.search(r"[IVXІХ]\s*$", before) else "never"
        if low in UNITS:
            if re.search(r"\bв т\.\s*$", before):
                return "never"
            return "maybe" if re.search(r"(?:\d|тыс\.|млн\.?|млрд\.?)\s*$", before) else "never" if len(low) == 1 else ""
        if low in ("uhr",):
            return ""
        if low in MAYBE:
            return "maybe"
        if low == "p" or low in NEVER:
            return "never" if low != "al" else "maybe"
        if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", low):
            return "never"
        return ""

    @staticmethod
    def _path(part: str, gaps: list[tuple[int, float]]) -> list[int]:
        """Best path through the lattice of gaps: their scores less the penalty of unlikely units."""
        if not gaps:
            return []
        ends = [0, *(g for g, _ in gaps), len(part)]
        score = [0.0, *(s for _, s in gaps), 0.0]
        best = [0.0] + [-1e9] * (len(ends) - 1)
        back = [0] * len(ends)
        for j in range(1, len(ends)):
            for i in range(max(0, j - 12), j):
                value = best[i] + score[j] - _unlikely(part[ends[i] : ends[j]] if ends[j] - ends[i] < 80 else "")
                if value > best[j]:
                    best[j], back[j] = value, i
        path, j = [], len(ends) - 1
        while back[j]:
            j = back[j]
            path.append(ends[j])
        return path[::-1]


_BEGINNING = re.compile(r"\s*(?:[—–-]\s*)?(?:[ВвКкСс]о?|[Нн]а|[Дд]о|[Пп]осле|[Зз]а|[Ии]з|[Пп]о|In|in|Am|Im)\s+\S+(?:\s+\S+)?\s*$")
_SHORT_END = re.compile(r"(?:^|[\s(])(?:г|гг|в|вв)\.\s*$")


def _unlikely(unit: str) -> float:
    """Penalty of a stretch that can't be a unit: a bare time like «В 1958 г.» wants its clause."""
    if unit and _SHORT_END.search(unit) and len(unit.split()) <= 3:
        return 6.0
    return 6.0 if unit and unit.rstrip().endswith(".") and _BEGINNING.match(unit) and re.search(r"\d\s*\S{0,3}\.\s*$", unit) else 0.0


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    segmenter = Segmenter()
    for batch in batches:
        keys, number, start, end, texts = [], [], [], [], []
        for k, t in zip(batch.column("text_id").to_pylist(), batch.column("text").to_pylist()):
            for i, (a, b) in enumerate(segmenter.units(t)):
                keys.append(k)
                number.append(i)
                start.append(a)
                end.append(b)
                texts.append(t[a:b])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(number, pa.int32()), pa.array(texts, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["text_id", "unit", "text", "start_char", "end_char"])


def sentence_units(texts: DataFrame) -> DataFrame:
    """``text_id, unit, text, start_char, end_char`` of every sentence unit.

    Every character but outer whitespace lies in exactly one unit. NULL, empty and blank texts have
    none; repeated rows are cut alike; a text without end marks is one unit (in scripts without end
    marks one unit a blank). Other columns are not read.
    """
    rows = texts.where("text IS NOT NULL AND text_id IS NOT NULL").select("text_id", "text")
    return rows.mapInArrow(_rows, "text_id bigint, unit int, text string, start_char int, end_char int")
