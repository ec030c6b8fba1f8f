"""Text quality: statistics of every text, their exact ranks within its language, an outlier score
and the verdict that the score gives.

1. One pass computes the statistics, quantised to LEVELS steps, of the text as it reads once a wrong
   decoding is undone.
2. Counts per (language, statistic, step) are sorted by range over the cluster; each range adds up
   its own counts, offsets of the ranges before it make the ranks exact. The table is bounded by
   languages x statistics x (LEVELS + 1) rows, whatever the number of texts, and no task ever holds
   the texts of a language.
3. The score is the weighted sum of -ln p over the low and high tail probabilities p of all statistics.
   Texts whose language can't be told are ranked among all; with every language the exact shares of the
   whole collection count as much as BORROWED rows. A text from MIN_SCORE on is no prose: nothing else decides.

Ranks, the character model and the lexicon count all rows; nothing is drawn from them. The weights and
the threshold are parameters that no run fits: they were fitted once by logistic regression on all 20,000
sentences of sf0.1, labelled by a check for clauses, then rounded.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lesograf.llm.confusables import clean_form
from lesograf.llm.encoding import UNSEEN, Plausibility, Restorer, bounded, learn, place, restore
from lesograf.sources.tables import settle

LEVELS = 1000
# What -ln of the low and of the high tail probability of each statistic counts in the score. A negative
# weight speaks for prose; a statistic without weight is only reported.
STATISTICS = {
    "words": (0.0, 0.0), "mean_length": (0.0, 0.6), "longest": (0.0, 0.0), "letters": (0.8, 0.0), "symbols": (0.0, 0.1), "digits": (0.0, 0.9), "code": (0.0, 0.8),
    "lines": (0.0, 0.5), "line_ends": (0.1, 0.0), "markers": (0.0, 0.4), "leaders": (0.0, 2.5), "common": (0.5, 0.0), "verbs": (0.5, -1.2), "function": (0.5, -1.2), "clause": (1.3, -0.8),
    "clauseless": (0.0, 0.8), "distinct": (1.1, 0.0), "repeated": (0.0, 0.5), "strung": (0.0, 0.1), "titles": (0.0, 1.2), "sentence": (1.9, 0.0), "strangeness": (0.0, 0.8), "unspoken": (0.0, 1.3),
}
MIN_SCORE = 16.5  # from which a text is no prose
BORROWED = 200  # rows as much as which the shares of the whole collection count with every language
ALL, NONE = "*", "-"

_WORD = re.compile(r"[^\W\d_]+(?:[-‐'’̀-ͯ]+[^\W\d_]+)*")
_STRESS = {0x300: None, 0x301: None}
_STRETCHED = re.compile(r"(.)\1{2,}")
_MARKS = re.compile("[\u0300-\u036f]|(?=[\u0900-\u0e7f])\\W")  # vowel and tone signs count as letters
_PLAIN_SIGNS = re.compile(r"[.,!?…:;\-–—«»\"'()„“”‘’。，！？、「」‐]")
_ADDRESS = re.compile(r"(?:https?://|www\.)[^\s<>]+|[\w.+-]+@[\w-]+\.[\w.]+")
_SHORT = re.compile(r"(?<!\w)[^\W\d_]{1,3}\.(?=\s*[\w,])|(?<=\d )[^\W\d_]{1,3}(?=[\s,.])")  # abbreviations, units after a number
_LINE_END = re.compile(r"[.!?…,;:—–\-»\"”')。！？।؟]\s*$")
_MARKER = re.compile(r"^\s*(?:[-•*–—·▪#]|\d{1,3}[.)]|[a-zа-я]\))\s", re.M)
_CODE = re.compile(r"[{}<>\[\]=|#_\\^~@&%$+*/;]|\"\s*:")
_FINITE = re.compile(r"[а-яёіїєў]{2,}(?:л|ла|ло|ли|лся|лась|лось|лись|ет|ёт|ит|ут|ют|ат|ят|ешь|ишь|ете|ите|ется|ится|утся|ются|атся|ятся)$")
# Nouns that look like finite verbs.
_NOUNS = frozenset(
    "билет пакет интернет кредит бюджет кабинет предмет совет ответ привет сюжет макет жакет портрет буфет балет букет паркет магнит визит транзит депозит лимит зенит аппетит дефицит бисквит гранит "
    "салат халат аппарат адвокат солдат результат формат шоколад автомат институт маршрут салют уют приют парашют статут стол котёл узел отдел предел раздел козёл осёл канал журнал вокзал материал металл футбол "
    "протокол сигнал персонал капитал портал филиал финал потенциал генерал школа сила скала пила могила смола пчела стрела мыло масло село стекло тело дело число кресло весло зеркало правило начало одеяло покрывало "
    "сало горло жало крыло ремесло петли цели соли роли мебели недели недель туфли сопли земли капли комнат палат зарплат монет газет конфет котлет таблет анкет ракет планет диет карет штиблет минут валют кают".split()
)
# Own word lists: words of no open class, auxiliaries among them.
_CLOSED = {
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber denn weil dass ob wenn als wie ich du er sie es wir ihr ihn ihm ihnen mich mir dich dir uns euch sich mein dein sein unser kein keine nicht in im an am auf aus bei mit nach von vom zu zum zur über unter vor für um ist sind war waren hat haben hatte wird wurde kann konnte will wollte muss musste dieser diese dieses seine ihre ihren".split(),
    "en": "the a an and or but because that if when as i you he she it we they him her them me us my your his its our their this these those not no in on at of from by with to into over under before for about after is are was were be been has have had do does did will would can could must who which".split(),
    "fr": "le la les l un une des du de d et ou mais car que qu si quand comme je j tu il elle on nous vous ils elles me m te se s lui leur mon ton son ma ta sa mes tes ses notre votre ce cette ces ne n pas plus dans en à au aux sur sous avec par pour chez est sont était a ont avait qui où dont".split(),
    "pl": "i oraz a ale lub albo że bo gdy jeśli jak ja ty on ona ono my wy oni one mnie mi cię ci go mu jej ją nas was ich im się mój twój jego nasz ten ta to te tego tej nie w we na z ze do od po pod nad przed przez za o u dla przy jest są był była było byli będzie który która które co już".split(),
    "pt": "o a os as um uma de do da dos das e ou mas porque que se quando como eu tu ele ela nós eles elas me te lhe meu minha seu sua este esta esse essa não em no na nos nas com por para ao à sobre sob é são era foi está estava tem tinha mais".split(),
    "is": "og eða en að sem ef þegar ég þú hann hún það við þið þeir þær þau mig þig sig hans hennar minn þinn sinn ekki í á af frá með til um yfir undir fyrir eftir er eru var voru hefur hafði þessi".split(),
    "uk": "і й та або але що бо якщо коли як я ти він вона воно ми ви вони мене тебе його її нас вас їх себе мій твій наш цей ця це ці не в у на з із зі до від по під над перед через за про для при є був була було були який яка".split(),
    "be": "і й ды або але што бо калі як я ты ён яна яно мы вы яны мяне цябе яго яе нас вас іх сябе мой твой наш гэты гэтая гэта не ў у на з са да ад па пад над перад праз за пра для пры быў была было былі які якая".split(),
    "bg": "и или но а че ако когато как аз ти той тя то ние вие те ме те го я ни ви ги се си моят моята неговият нашият този тази това тези не в във на с със до от по под над пред през за при е са беше бяха ще да който която".split(),
    "sr": "и или али а да ако кад како ја ти он она оно ми ви они ме те га је нас вас их се мој твој његов наш овај ова ово не у на с са до од по под над пред кроз за о при сам си смо сте су био била било који која".split(),
}
_CLOSED = {k: frozenset(v) for k, v in _CLOSED.items()}
_SENTENCE = re.compile(r"\s*[—–\-«„“\"'(¿¡]*\s*[^\W\d_a-zа-яё].*[.!?…][»”\"')]*\s*$", re.S)
# Endings of finite verbs where they tell, for languages whose tags nobody gave.
_ENDINGS = {"pl": re.compile(r".{3,}(?:ł|ła|ło|li|ły|łem|łam)$"), "uk": re.compile(r".{3,}(?:[аиіяув]в|ла|ло|ли|ється|ться)$"), "be": re.compile(r".{3,}(?:[аіыяеу]ў|ла|ло|лі|ўся|лася|ецца)$"), "sr": re.compile(r".{3,}(?:ао|ио|ела|ала|ила|али|или)$"), "en": re.compile(r".{3,}ed$"), "de": re.compile(r".{3,}te$")}
_STRUNG = re.compile(r"[,;|\n\t•·]+")
_CONTENTS = re.compile(r"(?:(?:\.\s?){4,}|…{2,}|_{4,})\s*\d+\W*$")
_OTHER_SCRIPT = re.compile(r"[Ա-֏֐-ࣿऀ-෿฀-๿ა-ჿ぀-ヿ㐀-鿿가-힣]")


_VOWELS = frozenset("аеёиоуыэюяіїєўaeiouyàâáäãåæéèêëíìîïóòôöõøúùûüýąęœ")


def _vowels(word: str) -> int:
    return sum(c in _VOWELS for c in word)


def _rough(word: str) -> bool:
    """Four consonants on end, or none but consonants."""
    run = best = 0
    for c in word:
        run = 0 if c in _VOWELS or not c.isalpha() else run + 1
        best = max(best, run)
    return best >= 4 or best == len(word) > 2


class Lexicon:
    """Every form with its language, share of finite verbs and of function words, in sorted arrays of 64-bit
    hashes: 25 bytes a form, so that no form need be left out."""

    def __init__(self, languages: list[str], hashes: np.ndarray, language: np.ndarray, verb: np.ndarray, function: np.ndarray):
        self.languages, self.hashes, self.language, self.verb, self.function = languages, hashes, language, verb, function

    def get(self, form: str) -> tuple[str, float, float] | None:
        i = place(self.hashes, form)
        return None if i is None else (self.languages[self.language[i]], float(self.verb[i]), float(self.function[i]))


class Measurer:
    """Statistics of a text by a character model and a lexicon."""

    def __init__(self, model: Plausibility, lexicon: Lexicon):
        self.model, self.lexicon, self.restorer = model, lexicon, Restorer(model)
        self.memo: dict[str, tuple[str | None, float, float, float, bool]] = {}

    def word(self, w: str) -> tuple[str | None, float, float, float, bool]:
        """(language or None, verb, function word, bits a letter, whether it can't be spoken)."""
        if (v := self.memo.get(w)) is None:
            low = w.translate(_STRESS).lower()
            entry = self.lexicon.get(low)
            if entry is None and not low.isascii():
                low = clean_form(low) or low
                entry = self.lexicon.get(low)
            if entry is None and low.startswith("не") and len(low) > 4:
                entry = self.lexicon.get(low[2:])
            if entry is None and _STRETCHED.search(low):
                low = _STRETCHED.sub(r"\1", low)
                entry = self.lexicon.get(low)
            bits = self.model.word(low) / (len(low) + 1)
            if entry is None:
                v = (None, 1.0 if _FINITE.match(low) and len(low) > 3 and _vowels(low) and low not in _NOUNS else 0.0, 0.0, bits, _rough(low))
            else:
                v = (entry[0], entry[1], entry[2], min(bits, 4.0), False)
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[w] = v
        return v

    def readable(self, text: str) -> str:
        """The text as it reads once a wrong decoding is undone; units that are lost for good are left out,
        and where these are the most there is no text."""
        broken = self.restorer.spans(text)
        if not broken:
            return text
        fixed = restore(text, broken)
        if fixed is not None and "\ufffd" not in fixed:
            return fixed
        part = restore(text, [(a, b, "" if v is None or "\ufffd" in v else v) for a, b, v in broken])
        units = [u for u in text.split() if any(map(str.isalpha, u))]
        kept = [u for u in part.split() if self.restorer.fine(u)]
        return " ".join(kept) if 2 * sum(any(map(str.isalpha, u)) for u in kept) > len(units) else ""

    def measure(self, text: str) -> tuple[str, list[int]]:
        """(language, steps of the statistics); language NONE where nothing can be read."""
        text = self.readable(text).translate(UNSEEN)
        if not text.strip():
            return NONE, [0] * len(STATISTICS)
        plain = _ADDRESS.sub(" ", text) if "@" in text or "://" in text or "www." in text else text
        words = _WORD.findall(plain)
        n = len(words)
        known = [self.word(w) for w in words]
        solid = "".join(text.split())
        size = len(solid)
        letters = sum(map(str.isalpha, solid)) + len(_MARKS.findall(solid))
        digits = sum(map(str.isdigit, solid))
        symbols = max(0, size - letters - digits - len(_PLAIN_SIGNS.findall(solid)))
        lines = [x for x in text.split("\n") if x.strip()]
        other = len(_OTHER_SCRIPT.findall(solid))
        tongue, votes = Counter(k[0] for k in known if k[0]).most_common(1)[0] if any(k[0] for k in known) else (None, 0)
        language = "other" if other and other * 2 > letters else tongue if votes * 4 >= max(1, n) else ALL
        closed = _CLOSED.get(tongue, frozenset())
        verbs = sum(k[1] for k in known)
        if not verbs and (ending := _ENDINGS.get(tongue)):
            verbs = float(sum(ending.match(w.lower()) is not None for w in words))
        function = max(sum(k[2] for k in known), sum(w.lower() in closed for w in words)) + len(_SHORT.findall(plain))
        clause = verbs + function
        common = sum(1 for k in known if k[0])
        distinct = len({w.lower() for w in words})
        capital = sum(w[0].isupper() for w in words)
        spelt = [(k[3], k[4]) for w, k in zip(words, known) if len(w) > 1 and not _OTHER_SCRIPT.match(w)]
        parts = [x for x in _STRUNG.split(text) if _WORD.search(x)]
        of = lambda a, b: min(LEVELS, round(LEVELS * a / b)) if b else 0
        log = lambda x: min(LEVELS, round(60 * math.log2(1 + x)))
        values = {
            "words": log(n),
            "mean_length": log(sum(map(len, words)) / n) if n else 0,
            "longest": log(max(map(len, words), default=0)),
            "letters": of(letters, size),
            "symbols": of(symbols, size),
            "digits": of(digits, size),
            "code": of(len(_CODE.findall(plain)), size),
            "lines": log(len(lines)),
            "line_ends": of(sum(1 for x in lines if _LINE_END.search(x)), len(lines)),
            "markers": of(len(_MARKER.findall(text)), len(lines)) if len(lines) > 1 else 0,
            "leaders": of(sum(1 for x in lines if _CONTENTS.search(x)), len(lines)),
            "common": of(common, n),
            "verbs": of(verbs, n),
            "function": of(function, n),
            "clause": of(clause, n),
            "clauseless": min(n, 12) if clause * 10 < n or not n else 0,
            "distinct": of(distinct, n),
            "repeated": of(n - distinct, n) if clause * 8 < n else 0,
            "strung": of(len(parts) - 1, n) if verbs < 0.5 and len(parts) > 1 else 0,
            "titles": capital if n > 1 and clause < 0.5 and capital == n else 0,
            "sentence": LEVELS if _SENTENCE.match(text) else 0,
            "strangeness": min(LEVELS, round(80 * sum(b for b, _ in spelt) / len(spelt))) if spelt else 0,
            "unspoken": of(sum(r for _, r in spelt), len(spelt)) if len(spelt) > 1 else 0,
        }
        return language, [values[s] for s in STATISTICS]


def _rows(model: Plausibility, lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measurer = Measurer(model, lexicon)
        for batch in batches:
            encoded = pc.dictionary_encode(batch.column("text"))
            found = [measurer.measure(t) for t in encoded.dictionary.to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string()), *(pa.array([f[1][i] for f in found], pa.int32()) for i in range(len(STATISTICS)))]
            yield pa.RecordBatch.from_arrays([batch.column("sent_key"), *(c.take(encoded.indices) for c in columns)], names=["sent_key", "language", *STATISTICS])

    return run


def lexicon(sentences: DataFrame, forms: DataFrame) -> tuple[Plausibility, Lexicon]:
    """The character model of all forms, and language, share of finite verbs and of function words of every form.

    The shares come from the tags of all parsed sentences. Of a form with several languages the first
    in order counts."""
    rows = forms.where("form IS NOT NULL").groupBy(F.lower("form").alias("form")).agg(F.coalesce(F.min("lang"), F.lit("und")).alias("lang")).where(F.col("form").rlike("\\p{L}"))
    token = sentences.select(F.explode("tokens").alias("t")).select(F.lower("t.text").alias("form"), F.upper(F.trim("t.pos")).alias("pos"), "t.feats")
    tagged = token.where(F.col("pos").isNotNull() & ~F.col("pos").isin("X", "PUNCT"))
    verb = (F.col("pos") == "VERB") & (F.coalesce(F.col("feats"), F.lit("")).contains("VerbForm=Fin") | F.coalesce(F.col("feats"), F.lit("")).contains("Tense="))
    shares = tagged.groupBy("form").agg(F.avg(verb.cast("double")).alias("verb"), F.avg(F.col("pos").isin("ADP", "PRON", "CCONJ", "SCONJ", "PART", "DET", "AUX").cast("double")).alias("function"))
    table = rows.join(shares, "form", "left").select(F.xxhash64("form").alias("hash"), "lang", F.coalesce("verb", F.lit(0.0)).cast("float").alias("verb"), F.coalesce("function", F.lit(0.0)).cast("float").alias("function"))
    bounded(rows)
    kept = table.toArrow().sort_by("hash")
    lang = kept["lang"].combine_chunks().dictionary_encode()
    column = lambda c: kept[c].to_numpy()
    return learn(forms), Lexicon(lang.dictionary.to_pylist(), column("hash"), lang.indices.to_numpy().astype(np.int16), column("verb"), column("function"))


def _local_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running totals of (language, statistic) within one range."""
    from pyspark import TaskContext

    part, key, total = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        running = []
        for k, n in zip(zip(batch.column("language").to_pylist(), batch.column("statistic").to_pylist()), batch.column("n").to_pylist()):
            total = n if k != key else total + n
            key = k
            running.append(total)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(running, pa.int64()), pa.array([part] * batch.num_rows, pa.int32())], names=[*batch.schema.names, "running", "part"])


def tails(measured: DataFrame) -> DataFrame:
    """``language, statistic, step, total, low, high``: the number of the language's rows, and the shares of
    them with at most and at least this step, from exact ranks.

    Every step of every statistic of every language that occurs; ALL holds the whole collection. Rows
    of language NONE have no statistics.
    """
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("statistic"), F.col(s).alias("step")) for s in STATISTICS))).alias("x")
    counts = measured.where(F.col("language") != NONE).select("language", each).groupBy("language", "x.statistic", "x.step").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy(F.lit(ALL).alias("language"), "statistic", "step").agg(F.sum("n").alias("n"))
    counts = counts.where(F.col("language") != ALL).unionByName(whole)
    ranged = counts.repartitionByRange("language", "statistic", "step").sortWithinPartitions("language", "statistic", "step")
    # written once: the ranges of a second run could differ from those that the offsets belong to
    ranged = settle(ranged.mapInArrow(_local_ranks, "language string, statistic string, step int, n bigint, running bigint, part int"))
    parts = ranged.groupBy("language", "statistic", "part").agg(F.sum("n").alias("sum"))
    group = Window.partitionBy("language", "statistic")
    offsets = parts.select("language", "statistic", "part", (F.sum("sum").over(group.orderBy("part")) - F.col("sum")).alias("offset"), F.sum("sum").over(group).alias("total"))
    ranks = ranged.join(offsets, ["language", "statistic", "part"])
    low = (F.col("offset") + F.col("running")) / F.col("total")
    high = (F.col("total") - F.col("offset") - F.col("running") + F.col("n")) / F.col("total")
    return ranks.select("language", "statistic", "step", "total", low.alias("low"), high.alias("high"))


def score_tables(tail: list) -> dict[str, np.ndarray]:
    """language -> what each step of each statistic adds to the score. The exact shares of the whole collection
    count as much as BORROWED rows with every language, so that one of few rows has tails as well."""
    index = {s: i for i, s in enumerate(STATISTICS)}
    whole = {(r["statistic"], r["step"]): (r["low"], r["high"]) for r in tail if r["language"] == ALL}
    tables: dict[str, np.ndarray] = {}
    for r in tail:
        n, weights = r["total"], STATISTICS[r["statistic"]]
        table = tables.setdefault(r["language"], np.zeros((len(STATISTICS), LEVELS + 1)))
        shares = [(n * p + BORROWED * q) / (n + BORROWED) for p, q in zip((r["low"], r["high"]), whole[r["statistic"], r["step"]])]
        table[index[r["statistic"]], r["step"]] = sum(-w * math.log(p) for w, p in zip(weights, shares))
    return tables


def _scored(tables: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            language = batch.column("language").dictionary_encode()
            for i, name in enumerate(language.dictionary.to_pylist()):
                if name != NONE:
                    rows = np.flatnonzero(language.indices.to_numpy() == i)
                    table = tables.value[name]
                    for k, s in enumerate(STATISTICS):
                        score[rows] += table[k, batch.column(s).to_numpy()[rows]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(score, 9))], names=[*batch.schema.names, "score"])

    return run


def quality(sentences: DataFrame, forms: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``sent_key, language``, the steps of the statistics, ``score`` and ``prose`` of every row.

    ``prose`` is false from ``min_score`` on. NULL and empty texts have no statistics (all NULL) and
    count as prose of no kind: ``prose`` NULL. A text of which nothing can be read (blanks, or characters
    lost for good) has language NONE and score 0. Repeated rows get equal figures. Lengths are in steps
    of 60 log2(1 + x), shares in thousandths, ``clauseless`` and ``titles`` in words.
    """
    model, words = lexicon(sentences, forms)
    columns = ", ".join(f"{s} int" for s in STATISTICS)
    rows = sentences.where("sent_key IS NOT NULL AND text IS NOT NULL AND text <> ''").select("sent_key", "text")
    measured = settle(rows.mapInArrow(_rows(model, words), f"sent_key bigint, language string, {columns}"))
    # bounded: languages of the lexicon x statistics x (LEVELS + 1) numbers
    tables = sentences.sparkSession.sparkContext.broadcast(score_tables(tails(measured).collect()))
    out = measured.mapInArrow(_scored(tables), f"sent_key bigint, language string, {columns}, score double")
    empty = sentences.where("sent_key IS NOT NULL AND (text IS NULL OR text = '')").select("sent_key")
    return out.withColumn("prose", F.col("score") < min_score).unionByName(empty, allowMissingColumns=True)
