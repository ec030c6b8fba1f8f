"""The operators for training text: brute force, round trips, held-out rows and odd input."""

import datetime as dt
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lesograf.llm import confusables, consensus, encoding, langid, mixing, packing, quality, sentences, splitting, termfreq, tokencount
from lesograf.llm.seeds import SEEDS
from lesograf.schema import TOKEN

TOKENS = "array<struct<id:int,text:string,lemma:string,pos:string,feats:string,head_id:int,rel:string,start_char:int,end_char:int>>"
FORMS = "почтальон работал старый лампа уже и в на он она мы спали читал книгу дом окно из по я не это сегодня вчера город снег мотор около школа без общества новый вопрос открыла дорогу правду вот так нет сказала окна школе дома".split()


@pytest.fixture(scope="module")
def forms(spark):
    extra = [("zurück", "de"), ("naïve", "fr"), ("web-сайт", "ru"), ("1999", "ru"), ("ёлка", "ru"), ("йод", "ru")]
    return spark.createDataFrame([(i + 1, f, "ru") for i, f in enumerate(FORMS)] + [(100 + i, f, g) for i, (f, g) in enumerate(extra)], "form_id bigint, form string, lang string")


# --- p1 ----------------------------------------------------------------------------------------


def tokens_of(text):
    return [(i + 1, m[0], None, None, None, 0, None, m.start(), m.end()) for i, m in enumerate(re.finditer(r"\w+|[^\w\s]", text))]


def test_split_keeps_everything(spark):
    rng = random.Random(1)
    words = ["слово" + str(i) for i in range(50)]
    text = " ".join(rng.choice(words) + rng.choice(["", ".", ",", ""]) for _ in range(400))
    rows = [(1, text, tokens_of(text)), (2, text, None), (3, "x" * 1300, None), (4, "коротко.", tokens_of("коротко.")), (5, None, tokens_of("а " * 70)), (6, None, None), (7, "", []), (8, " " * 500, None), (9, "а " * 90, tokens_of("а " * 90)), (1, text, tokens_of(text))]
    bad = [(10, "один два три " * 60, [(i + 1, w, None, None, None, 0, None, None if i % 2 else 9, 3) for i, w in enumerate(("один два три " * 60).split())])]
    df = spark.createDataFrame(rows + bad, f"sent_key bigint, text string, tokens {TOKENS}").withColumn("piece", F.lit("clash")).withColumn("oversized", F.lit(1))
    out = defaultdict(list)
    for r in splitting.split_oversized(df).collect():
        out[r["sent_key"]].append(r)
    source = {r[0]: r for r in rows + bad}
    for key, pieces in out.items():
        pieces = sorted(pieces, key=lambda p: p["piece"])
        _, whole, toks = source[key]
        for p in pieces:
            assert p["text"] is None or len(p["text"]) <= 400 and p["text"] == whole[p["start_char"] : p["end_char"]]
            assert p["tokens"] is None or len(p["tokens"]) <= 60
        if whole and whole.strip():
            covered = {i for p in pieces for i in range(p["start_char"], p["end_char"])}
            assert all(i in covered or c.isspace() for i, c in enumerate(whole))
        if toks:
            assert {t["id"] for p in pieces for t in p["tokens"]} == {t[0] for t in toks}
        if key in (1, 2, 3) and pieces[0]["pieces"] > 1:
            assert all(p["overlap"] > 0 for p in pieces if p["piece"])
    assert {k for k, v in out.items() if v[0]["oversized"]} == {1, 2, 3, 5, 8, 9, 10}
    assert splitting.split_oversized(df.limit(0)).count() == 0


def test_split_keeps_tokens_without_place(spark):
    text = "один два три четыре пять " * 30
    good = tokens_of(text)

    def token(i, form, a, b):
        return (i, form, None, None, None, 0, None, a, b)

    cases = {
        1: [token(t[0], "ъъъ", None, None) for t in good],  # garbled forms, no offsets
        2: [token(t[0], None, None, None) for t in good],
        3: [token(t[0], t[1] if t[0] % 2 else "ъ", t[7] if t[0] % 2 else None, t[8]) for t in good],
        4: [token(t[0], t[1], 740, 745) if t[0] == 3 else t for t in good],  # one offset too large
        5: good + [token(1000 + i, None, None, None) for i in range(130)],  # a long run at the end
        6: [token(1000 + i, None, None, None) for i in range(130)] + good,  # and at the start
        7: good[:70] + [token(1000 + i, "ъ", 9, 3) for i in range(200)] + good[70:],
    }
    rows = [(k, text, v) for k, v in cases.items()] + [(8, "а", [token(i, None, None, None) for i in range(200)])]
    out = defaultdict(list)
    for r in splitting.split_oversized(spark.createDataFrame(rows, f"sent_key bigint, text string, tokens {TOKENS}")).collect():
        out[r["sent_key"]].append(r)
    for key, whole, tokens in rows:
        pieces = sorted(out[key], key=lambda p: p["piece"])
        assert all(len(p["tokens"]) <= 60 and len(p["text"]) <= 400 and p["text"] == whole[p["start_char"] : p["end_char"]] for p in pieces)
        assert {t["id"] for p in pieces for t in p["tokens"]} == {t[0] for t in tokens}, key
        covered = {i for p in pieces for i in range(p["start_char"], p["end_char"])}
        assert all(i in covered or c.isspace() for i, c in enumerate(whole))
    # what has a place lies in its piece, beside an offset that is too large as well
    for p in out[4]:
        assert all(p["start_char"] <= t["start_char"] < p["end_char"] for t in p["tokens"] if t["id"] != 3)


@pytest.mark.parametrize("sentence", ["昨日雨が降った、しかし私たちは公園へ行った。", "他说：「我们明天去北京。」", "我不知道你在说什么，真的！"])
@pytest.mark.parametrize("tokens", [False, True])
def test_split_without_blanks(sentence, tokens):
    text = sentence * 60
    spans = [(m.start(), m.end()) for m in re.finditer(r"\w{1,2}|[^\w\s]", text)] if tokens else None
    pieces = splitting.cut(text, spans)
    assert len(pieces) > 1 and all(b - a <= 400 for a, b, _ in pieces) and pieces[-1][1] == len(text)
    assert all(b % len(sentence) == 0 for _, b, _ in pieces)
    # without sentence ends at clause marks, and without any at a character
    clauses = splitting.cut("他说我们明天去北京，" * 60, None)
    assert len(clauses) > 1 and all(b % 10 == 0 for _, b, _ in clauses)
    bare = splitting.cut("昨日きゃく" * 100, None)
    assert all(b - a <= 400 for a, b, _ in bare) and all(b % 5 != 3 for _, b, _ in bare)


def test_cut_prefers_topic_change():
    a = "Кот спал на печи и кот ел рыбу. Кот любил рыбу и печь. Рыба была вкусная для кота. "
    b = "Поезд шёл на вокзал и вёз уголь. Вокзал ждал поезд и уголь. Уголь лежал на вокзале. "
    text = a * 2 + b * 3
    first = splitting.cut(text, None, 250, 60, 0)[0]
    assert text[first[0] : first[1]].endswith(".") and abs(first[1] - len(a * 2)) < 45


# --- p2 ----------------------------------------------------------------------------------------


def test_tails_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["ru", "en", "*"]), *(rng.choice([0, 1, 5, 999]) for _ in quality.STATISTICS)) for k in range(300)] + [(900, "-", *(0 for _ in quality.STATISTICS))]
    df = spark.createDataFrame(rows, "sent_key bigint, language string, " + ", ".join(f"{s} int" for s in quality.STATISTICS))
    tail = quality.tails(df).collect()
    got = {(r["language"], r["statistic"], r["step"]): r for r in tail}
    tables = quality.score_tables(tail)
    for i, (name, (low_weight, high_weight)) in enumerate(quality.STATISTICS.items()):
        every = [r[2 + i] for r in rows if r[1] != "-"]
        for lang in ("ru", "en", "*"):
            values = [r[2 + i] for r in rows if r[1] != "-" and lang in ("*", r[1])]
            for v in set(values):
                low, high = ([sum(x <= v for x in c) / len(c) for c in (values, every)], [sum(x >= v for x in c) / len(c) for c in (values, every)])
                assert (got[lang, name, v]["low"], got[lang, name, v]["high"], got[lang, name, v]["total"]) == (pytest.approx(low[0]), pytest.approx(high[0]), len(values))
                mixed = [(len(values) * a + quality.BORROWED * b) / (len(values) + quality.BORROWED) for a, b in (low, high)]
                assert tables[lang][i, v] == pytest.approx(-low_weight * np.log(mixed[0]) - high_weight * np.log(mixed[1]))


JUNK = ["Brot Fenster Schlüssel Zeitung Haus", "Fenster Schlüssel " * 6, "Brot, Fenster, Schlüssel, Zeitung", "1. Старый дом\n2. Новый вопрос\n3. Снег", "лампа;579;49.47;старый", "Глава 1 ........ 40\nГлава 2 ........ 51", "9a5f9d9HG3efe8567cd5K968e4bGea3e", "окно окно окно окно окно окно", "######## ####", "if (x_4 >= 28) { return y[4]; }", "12 55 817 3 90", "Пакет, интернет, кредит, договор, письмо, стол", "билет пакет интернет кредит стол окно дом", "письмо стол окно дом снег книга лампа город мотор лес река " * 3 + "работал", "Он работал ........ 12"]
PROSE = ["Почтальон работал в школе, и он читал книгу.", "Старый почтальон спал около дома.", "Вот так!!!", "Нет…", "— Она открыла окно? — сказала она.", "он работал она открыла окно мы спали", "Ìû ñïàëè áåç ëàìïû.", "Der Busfahrer konnte nicht einschlafen.", "Stary rybak otworzył okno.", "stary rybak otworzył okno", "Kupił chleb, mleko, ser i okno.", "Her husband bought fresh bread.", "Он работал, и он работал, и он работал, он работал", "он работал и письмо стол окно дом снег", "Снова капитан про́верил рубашку.", "Женщина стоялллла у ссссупа."]


def test_quality_verdicts(spark):
    """Ranks need a collection: the cases stand among the sentences of a treebank."""
    base = spark.read.parquet("/root/testdata/sf0.01/sentences.parquet").select("sent_key", "text", "tokens")
    forms = spark.read.parquet("/root/testdata/sf0.01/word_forms.parquet")
    rows = [(-1 - i, t) for i, t in enumerate(JUNK + PROSE)] + [(-900, None), (-901, ""), (-902, " \n"), (-1, JUNK[0])]
    df = base.unionByName(spark.createDataFrame(rows, "sent_key bigint, text string"), allowMissingColumns=True).withColumn("score", F.lit("clash"))
    out = quality.quality(df, forms).where("sent_key < 0").collect()
    got = {r["sent_key"]: r for r in out}
    assert len(out) == len(rows) and got[-900]["prose"] is None and got[-901]["prose"] is None and got[-902]["language"] == "-" and got[-902]["prose"]
    assert [t for i, t in enumerate(JUNK) if got[-1 - i]["prose"]] == []
    assert [t for i, t in enumerate(PROSE) if not got[-1 - len(JUNK) - i]["prose"]] == []
    assert quality.quality(df.limit(0), forms).count() == 0


def test_strangeness_comes_from_all_forms(spark):
    """A word is as strange as all forms make it, also where there are more than 200,000 of them."""
    digits = lambda text, to: f"translate(cast({text} AS string), '0123456789', '{to}')"
    forms = spark.range(210_000).selectExpr(f"concat('сл', {digits('id', 'абвгдежзик')}) AS form", "'ru' AS lang")
    s = spark.createDataFrame([(1, "слабвгде щщыщъ слкккк", None)], f"sent_key bigint, text string, tokens array<{TOKEN}>")
    model, words = quality.lexicon(s, forms)
    got = quality.Measurer(model, words).measure("слабвгде щщыщъ слкккк")
    whole = encoding.Plausibility(sorted(r["form"] for r in forms.collect()), model.known)
    assert got == quality.Measurer(whole, words).measure("слабвгде щщыщъ слкккк")
    assert [model.word(w) for w in ("слабвгде", "щщыщъ", "слкккк")] == [whole.word(w) for w in ("слабвгде", "щщыщъ", "слкккк")]


def test_the_score_decides(spark):
    d = "/root/testdata/sf0.001"
    s, forms = spark.read.parquet(f"{d}/sentences.parquet"), spark.read.parquet(f"{d}/word_forms.parquet")
    found = [quality.quality(s, forms, m).where("NOT prose").count() for m in (-1e9, quality.MIN_SCORE, 1e9)]
    assert found[0] == s.where("text <> ''").count() and 0 < found[1] < found[0] / 4 and found[2] == 0


# --- p3 ----------------------------------------------------------------------------------------


def brute_terms(tokens, sents):
    ids = {k: i for k, i in sents if k is not None and i is not None}
    occ, rec = Counter(), defaultdict(set)
    for key, tid, *values in tokens:
        if key in ids and tid and re.fullmatch("[0-9]+", tid):
            for f, v in zip(("lemma", "pos", "rel"), values):
                if v is not None:
                    t = (f, v.strip().lower().replace("ё", "е"))
                    occ[t] += 1
                    rec[t].add(ids[key])
    return {t: (occ[t], len(rec[t])) for t in occ}, len(set(i for _, i in sents if i is not None))


def test_terms_against_brute_force(spark):
    rng = random.Random(3)
    sents = [(k * 40_000 + 1, f"s{k // 2}") for k in range(40)] + [(7, None), (None, "x")]
    tokens = [(rng.choice([s[0] for s in sents] + [999_999_999]), rng.choice(["1", "2", "3-4", "8.1", None]), rng.choice([None, "Ёж", " еж", "a", "", "b"]), rng.choice([None, "NOUN", "noun"]), "dep") for _ in range(900)]
    tokens += [(1, "1", f"t{i % 400}", "X", None) for i in range(500)]
    t = spark.createDataFrame(tokens, "sent_key bigint, id string, lemma string, pos string, rel string").withColumn("record", F.lit("clash")).withColumn("term", F.lit(1)).repartition(6)
    s = spark.createDataFrame(sents, "sent_key bigint, sent_id string").withColumn("record", F.lit("clash"))
    want, n = brute_terms(tokens, sents)
    got = {(r["field"], r["term"]): r for r in termfreq.term_frequencies(t, s).collect()}
    assert {k: (r["occurrences"], r["records"]) for k, r in got.items()} == want
    assert all(r["mark"] == ("rare" if r["records"] < 3 else "common" if r["records"] > 0.2 * n else None) for r in got.values())
    assert termfreq.term_frequencies(t.limit(0), s).count() == 0


def test_dense_containers(spark):
    n = 20_000
    t = spark.range(n).selectExpr("id AS sent_key", "'1' AS id", "'x' AS lemma", "cast(NULL AS string) AS pos", "concat('r', id % 3) AS rel")
    s = spark.range(n).selectExpr("id AS sent_key", "concat('s', id) AS sent_id")
    got = {(r["field"], r["term"]): r["records"] for r in termfreq.term_frequencies(t, s).collect()}
    assert got == {("lemma", "x"): n, ("rel", "r0"): 6667, ("rel", "r1"): 6667, ("rel", "r2"): 6666}


# --- p4 ----------------------------------------------------------------------------------------

LOOKS = {"пoчтaльoн": "почтальон", "Пoчтaльон": "почтальон", "МЫ": None, "MЫ": "мы", "оκно": "окно", "ра​ботал": None, "рабо­тал": "работал", "окно ": "окно", "﻿дом": "дом", "ЛAМПA": "лампа", "web‐cайт": "web-сайт", "１９９９": "1999", "елка": None, "ёлка": None, "ёлка": "ёлка", "ëлка": "ёлка", "ла́мпа": None, "ламмпа": None, "иод": None, "йод": "йод", "naïve": "naïve", "Bопрос": "вопрос", "bопрос": None, "": None, None: None, "дoм": "дом"}


def test_look_alikes(spark, forms):
    rows = [(i, t) for i, t in enumerate(LOOKS)] + [(500, "дoм"), (None, "дoм")]
    df = spark.createDataFrame(rows, "tok_key bigint, text string").withColumn("form", F.lit("clash")).withColumn("char_start", F.lit(1)).withColumn("char_end", F.lit(2))
    name = {r["form_id"]: r["form"] for r in forms.collect()}
    got = {r["tok_key"]: name[r["form_id"]] for r in confusables.look_alikes(df, forms).collect()}
    want = {i: f for i, (t, f) in enumerate(LOOKS.items()) if f} | {500: "дом"}
    want |= {i: "работал" for i, t in enumerate(LOOKS) if t == "ра​ботал"}
    assert got == want
    assert confusables.look_alikes(df, forms.limit(0)).count() == 0 and confusables.look_alikes(df.limit(0), forms).count() == 0
    clean = {r["text"]: r["form"] for r in confusables.normal_tokens(df).collect()}
    assert clean["Пoчтaльон"] == "почтальон" and clean["１９９９"] == "1999" and clean[None] is None and clean[""] == "" and clean["ла́мпа"] != "лампа"


# --- p5 ----------------------------------------------------------------------------------------

TEXTS = [
    ["— Зелёный художник уехал! — сказала она.", " ", "— Спокойный капитан видел машину!"],
    ["Игнерт сказал: «Она читала слово. Мы спали».", " ", "В XX в. Кельмень рос."],
    ["Он читал в 1953 г.", " ", "В 1958 г. Дремин заболел."],
    ["Это был проф. Б. Н. Зойрен, т. е. старик.", "", "Рост 80 см, вес 83,0 кг, адрес: г. Эльбор, пр. Мира, стр. 45."],
    ["Вместо предисловия", "\n\n", "Он… сидел\nи молчал.", "\n", "1. сахар", "\n", "2. хлеб", "\n", "Мы пришли."],
    ["медленно он шёл.", " ", "она спала!", " ", "мы ели"],
    ["Mr. J. R. Dremin bought bread, tea, etc.", " ", "He said: \"It is late. Go home.\"", " ", "Well... he came at 5 p.m. and left."],
    ["„Wo ist es?“, fragte er.", " ", "Das kostet z. B. 20,5 Euro.", " ", "Am 3. Mai kam der 61. Zug."],
    ["老人は「もう帰る。待たないで。」と言った。", "", "昨日、雨が降った！"],
    ["她说：“回家了。你呢？”", "", "昨天他买了3.5公斤苹果。"],
    ["ตอนฝนตกชายชรากลับบ้าน", " ", "ในตอนบ่ายเพื่อนบ้านซื้อขนมปัง"],
    ["डॉ. वर्मेन 3.5 किलो सेब लाया।", " ", "वह आया?"],
    ["Адрес www.site7.example/page?x=7.html знал г-н Игнерт.", " ", "Версия v80.3.0 вышла."],
    ["Неужели?..", " ", "Мама пришла (никто не знал куда!), и всё стихло."],
    ["без знаков"],
]


def test_sentence_units(spark):
    rows, want = [], {}
    for k, parts in enumerate(TEXTS):
        at, units = 0, []
        for i, p in enumerate(parts):
            if i % 2 == 0:
                units.append((at, at + len(p)))
            at += len(p)
        rows.append((k, "".join(parts)))
        want[k] = units
    rows += [(90, None), (91, ""), (92, " \n "), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "text_id bigint, text string").withColumn("unit", F.lit("clash"))
    got = defaultdict(set)
    for r in sentences.sentence_units(df).collect():
        got[r["text_id"]].add((r["start_char"], r["end_char"]))
        assert dict(rows)[r["text_id"]][r["start_char"] : r["end_char"]] == r["text"]
    assert {k: sorted(v) for k, v in got.items()} == want
    assert sentences.sentence_units(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "parts",
    [
        ["ชายชรากลับบ้าน", "เพื่อนบ้านซื้อแอปเปิล 3.5 กิโลกรัม", "เด็กอ่านหนังสือ"],
        ["เขาเกิดในปี พ.ศ. 2560 ที่เมืองนี้", "เขากลับบ้านแล้ว"],
        ["เขาพบ ดร. สมชาย", "เขากลับบ้านแล้ว"],
        ["คุณไปไหน?", "ชายชรากลับบ้าน", "เพื่อนบ้านซื้อขนมปัง!", "เด็กอ่านหนังสือ"],
        ["เขามาเวลา 10.30 น.", "เพื่อนบ้านซื้อขนมปัง", "ชายชรากลับบ้าน."],
        ["เด็กอ่านหนังสือ", 'เขาพูดว่า "ไปบ้าน แล้วนอน"'],
        ["ລາວກັບບ້ານ", "ລາຄາ 3.5 ກີບ", "ເດັກອ່ານປຶ້ມ"],
        ["សិស្ស អានសៀវភៅ។", "គាត់ទៅផ្ទះ។"],
    ],
)
def test_blanks_beside_marks(parts):
    text = " ".join(parts)
    got = [text[a:b] for a, b in sentences.Segmenter().units(text)]
    assert got == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["「本当だ！」", "とても嬉しかった。"],
        ["「本当だ！」と言った。", "夜が来た。"],
        ["「来ない。」", "もう遅い。"],
        ["「来ない。」", "はじめて泣いた。"],
        ["「来ない。」は嘘だ。"],
        ["「着いた。」", "道を歩く。"],
        ["火事だ！と叫んだ。", "誰も来ない。"],
        ["火事だ！", "とても怖い。"],
        ["終わった。", "とある町に着いた。"],
        ["“你好！”老师笑着说。", "天黑了。"],
        ["“你好！”小王大声喊道。"],
        ["“你好！”", "老师笑着说：“天黑了。”"],
        ["“你好！”", "他说：“天黑了。”"],
        ["“你好！”", "小说出版了。"],
        ["“你好！”", "问题很多。"],
        ["“你好！”", "道路很长。"],
        ["“你好！”他说明天来。"],
        ["“你好！”", "他说明了原因。"],
        ["“你好！”", "老师什么也没说。"],
        ["“你好！”", "我不知道。"],
        ["“你好！”", "“说吧！”"],
    ],
)
def test_words_after_a_mark_decide(parts):
    text = "".join(parts)
    assert [text[a:b] for a, b in sentences.Segmenter().units(text)] == parts


def test_units_hold_every_character():
    rng = random.Random(4)
    alphabet = list("аБв .!?…\n\"«»—-()1г。」「 ก")
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        units = sentences.Segmenter().units(t)
        assert "".join(re.sub(r"\s", "", t[a:b]) for a, b in units) == re.sub(r"\s", "", t)
        assert all(not t[a].isspace() and not t[b - 1].isspace() for a, b in units)
        assert all(x[1] <= y[0] for x, y in zip(units, units[1:]))


# --- p6 ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("enc,dec", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "cp866"), ("utf-8", "koi8-r"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866")])
def test_wrong_decodings_are_undone(enc, dec):
    model = encoding.Plausibility(sorted(FORMS))
    text = "Почтальон работал около школы без общества"
    raw = text.encode(enc)
    wrong = "".join(encoding._DECODE.get(encoding_name(dec), {}).get(b, chr(b)) for b in raw)
    r = encoding.Restorer(model)
    spans = r.spans(wrong)
    assert spans and encoding.restore(wrong, spans).split()[:2] == ["Почтальон", "работал"]
    assert r.spans(text) == []


def encoding_name(n):
    return {"latin-1": "latin_1", "koi8-r": "koi8_r"}.get(n, n)


def test_texts_that_are_fine(spark, forms):
    model = encoding.learn(forms)
    r = encoding.Restorer(model)
    for t in ["NÃO ACEITOU A DECISÃO", "ÞESSI MAÐUR", "Пoчтaльoн рабoтaл", "ККККниги", "昨日、雨が降った", "Her naïve café", "100 % & more", "а\xa0я", ""]:
        assert r.spans(t) == [], t
    twice = "zurück".encode().decode("latin-1").encode().decode("latin-1")
    assert encoding.restore(twice, r.spans(twice)) == "zurück"
    assert encoding.restore("&#1076;&#1086;&#1084;", r.spans("&#1076;&#1086;&#1084;")) == "дом"


@pytest.mark.parametrize("wrong,right", [("schцn", "schön"), ("fьr", "für"), ("StraЯe", "Straße"), ("cafй", "café")])
def test_western_words_read_as_cyrillic(wrong, right):
    r = encoding.Restorer(encoding.Plausibility(sorted([*FORMS, "schön", "für", "straße", "café"])))
    spans = r.spans(wrong)
    assert spans and encoding.restore(wrong, spans) == right


@pytest.mark.parametrize("depth", [1, 2, 4, 6])
def test_utf8_read_wrongly_again_and_again(depth):
    """Every depth is undone: no limit but the text itself."""
    r = encoding.Restorer(encoding.Plausibility(sorted(FORMS)))
    for word in ("почтальон", "работал", "вопрос"):
        wrong = word
        for _ in range(depth):
            wrong = "".join(encoding._DECODE["cp1252"].get(b, chr(b)) for b in wrong.encode())
        assert encoding.restore(wrong, r.spans(wrong)) == word


def test_two_exchanges():
    r = encoding.Restorer(encoding.Plausibility(sorted(FORMS)))
    read = lambda t, enc, dec: encoding._encode(t, enc).decode("latin_1").translate(encoding._DECODE[dec])
    found = total = 0
    for word in ("почтальон", "работал", "вопрос", "читал", "школе"):
        for a, b, c, d in (("cp1251", "koi8_r", "cp866", "cp1251"), ("koi8_r", "cp1251", "cp866", "koi8_r"), ("cp1251", "cp866", "koi8_r", "cp1251")):
            try:
                wrong = read(read(word, a, b), c, d)
            except (AttributeError, TypeError):
                continue
            total += 1
            found += encoding.restore(wrong, r.spans(wrong)) == word if r.spans(wrong) else wrong == word
    assert total and found >= 0.9 * total


def test_order_of_the_search(monkeypatch):
    """The bounds hold, the first acceptable text is the cheapest of all, and few states are opened for it."""
    model = encoding.Plausibility(sorted(FORMS))
    table = model.exchanges = encoding.Exchanges(model)
    wrong = {encoding._encode(w, a).decode("latin_1").translate(encoding._DECODE[b]) for w in ("почтальон", "работал", "вопрос") for a, b in table.single if encoding._encode(w, a)}
    costs = {}
    for t in sorted(wrong - set(FORMS)):
        every = []
        for bound, k in table.below(table.codes(t), np.inf, False):
            v = table.apply(t, k)
            assert bound <= model.text(v) + encoding.SINGLE_BITS + 1e-3
            if not encoding._BROKEN.search(v) and not encoding._IRREGULAR.search(v) and encoding.acceptable(v, t, table.moves[k], model):
                every.append(model.text(v) + encoding.SINGLE_BITS)
        count = [0]
        _, cost, path = encoding.search(t, model, count=count)
        if path:
            costs[t] = cost
            assert cost <= min(every, default=cost) + 1e-9 and count[0] < 60  # of 3,192 maps and 8 readings as UTF-8
    monkeypatch.setattr(encoding.heapq, "heappop", lambda h: h.pop(h.index(max(h, key=lambda x: x[0]))))  # the worst first
    dearer = [encoding.search(t, model)[1] - c for t, c in costs.items()]
    assert len(costs) > 20 and min(dearer) > -1e-9 and max(dearer) > 1


def test_no_form_is_left_out(spark):
    """The set of known forms is whole even where the trigrams come from a sample."""
    forms = spark.range(3000).selectExpr("concat('слово', id) AS form").withColumn("lang", F.lit("ru"))
    model = encoding.learn(forms, 10)
    assert all(f"слово{i}" in model.known for i in range(3000)) and "слово3000" not in model.known


def test_trigrams_of_all_forms(spark):
    """The costs come from every form, however many there are and whoever counts them."""
    forms = spark.range(210_000).selectExpr("concat('слово', translate(cast(id AS string), '0123456789', 'абвгдежзик')) AS form").unionByName(spark.createDataFrame([("Naïve-Ünï2 x", ), ("",), (None,)], "form string"))
    texts = sorted({r["form"].lower() for r in forms.collect() if r["form"] is not None})
    want = encoding.Plausibility(texts)
    for model in (encoding.learn(forms), encoding.learn(forms, 3)):
        assert (model.bits, model.new, model.one, model.base) == (want.bits, want.new, want.one, want.base)


def test_garbled_records(spark, forms):
    bad = "ЛНРНП"  # мотор
    s = spark.createDataFrame([(1, f"Он читал {bad} Б доме"), (2, "Он спал"), (3, None), (4, ""), (5, "пЁя│ �")], "sent_key bigint, text string").withColumn("spans", F.lit(1))
    t = spark.createDataFrame([(1, 1, "Он", 0, 2), (2, 1, bad, 9, 14), (3, 1, "Б", 15, 16), (4, 2, "Б", 0, 1), (5, 2, bad, None, None), (6, None, bad, 0, 1), (7, 1, None, 0, 2), (None, 1, bad, 9, 14)], "tok_key bigint, sent_key bigint, text string, char_start int, char_end int").withColumn("restored", F.lit(1))
    got = {(r["record_type"], r["record_key"]): r["restored"] for r in encoding.garbled_records(s, t, forms).collect()}
    assert set(got) == {("sentence", 1), ("sentence", 5), ("token", 2), ("token", 3), ("token", 5), ("token", 6)}
    assert got["sentence", 1] == "Он читал мотор в доме" and got["token", 2] == "мотор"
    assert encoding.garbled_records(s.limit(0), t.limit(0), forms).count() == 0


# --- p7 ----------------------------------------------------------------------------------------


def test_consensus_finds_spammers_and_copies(spark):
    rng, rows, truth = random.Random(5), [], {}
    labels = ["NOUN", "VERB", "ADJ", "ADV", "PRON"]
    at = dt.datetime(2024, 1, 1)
    for k in range(300):
        truth[k] = rng.choice(labels)
        copied = truth[k] if rng.random() < 0.5 else rng.choice(labels)
        for a in range(1, 9):
            if a in (1, 2, 3, 4):
                v = truth[k] if rng.random() < 0.9 else rng.choice(labels)
            elif a in (5, 6, 7):
                v = copied
            else:
                v = "NOUN"
            rows.append((len(rows), k, a, rng.choice([v, v.lower(), f" {v} "]), None, None if a == 2 else k % 7, "ёж", at))
    rows += [(9001, 0, 1, truth[0], None, 0, "еж", at + dt.timedelta(1)), (9002, 0, 1, None, None, None, None, at + dt.timedelta(2)), (9003, None, 1, "X", "x", 1, "x", at), (9004, 5, None, "X", "x", 1, "x", at)]
    kind = "ann_key bigint, tok_key bigint, annotator_id int, pos string, rel string, head_id int, lemma string, annotated_at timestamp"
    df = spark.createDataFrame(rows + rows[:50], kind).withColumn("label", F.lit("clash")).withColumn("answers", F.lit(1))
    out, who = consensus.consensus(df)
    got = {(r["tok_key"], r["field"]): r for r in out.collect()}
    right = sum(got[k, "pos"]["label"] == v for k, v in truth.items())
    majority = sum(Counter(r[3].strip().upper() for r in rows if r[1] == k and r[3]).most_common(1)[0][0] == v for k, v in truth.items())
    assert right > 285 and right > majority
    assert all(got[k, "lemma"]["label"] == "еж" and got[k, "lemma"]["agreement"] == 1.0 for k in truth)
    assert got[3, "head_id"]["label"] == "3" and (3, "rel") not in got
    c = {(r["annotator_id"], r["field"]): r["competence"] for r in who.collect()}
    assert min(c[a, "pos"] for a in (1, 2, 3, 4)) > 0.75 > max(c[a, "pos"] for a in (5, 6, 7)) and c[8, "pos"] < 0.3
    empty, nobody = consensus.consensus(df.limit(0))
    assert empty.count() == 0 and nobody.count() == 0


def test_consensus_of_many_annotators(spark):
    """Any ids, negative ones among them, and far more annotators than an item has answers."""
    rng = random.Random(4)
    rows, truth = [], {}
    for k in range(1500):
        truth[k] = rng.choice(["NOUN", "VERB", "ADJ"])
        for a in rng.sample(range(-1000, 1000), 5):
            rows.append((len(rows), k, a, truth[k] if rng.random() < 0.85 else rng.choice(["NOUN", "VERB", "ADJ"]), None, None, None, "2024-01-01"))
    df = spark.createDataFrame(rows, "ann_key bigint, tok_key bigint, annotator_id int, pos string, rel string, head_id int, lemma string, annotated_at string")
    labels, people = consensus.consensus(df)
    got = {r["tok_key"]: r["label"] for r in labels.collect()}
    assert len(got) == 1500 and sum(got[k] == v for k, v in truth.items()) > 1450
    assert {r["annotator_id"] for r in people.collect()} == {r[2] for r in rows}


# --- p8 and p9 ---------------------------------------------------------------------------------


def test_bounds_and_packing():
    rng = np.random.default_rng(6)
    for _ in range(60):
        cap = int(rng.integers(5, 60))
        sizes = rng.integers(1, cap + 1, int(rng.integers(1, 80)))
        w = packing.best_fit_decreasing(sizes, cap)
        load = np.bincount(w, weights=sizes)
        assert load.max() <= cap and len(load) == w.max() + 1
        bound = packing.lower_bound(np.bincount(sizes, minlength=cap + 1), cap)
        assert -(-sizes.sum() // cap) <= bound <= len(load)


def test_windows(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["дом", "лес", "река", "hello", "12"]) for _ in range(rng.choice([0, 1, 3, 20, 60, 200]))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (5, texts[5]), (901, "слово " * 700)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("tokens", F.lit("clash")).withColumn("window", F.lit(1))
    out = packing.pack(df, 256).collect()
    encode = tokencount.encoder().encode_ordinary
    load, held = Counter(), Counter()
    for r in out:
        load[r["window"]] += r["tokens"]
        held[r["doc_id"]] += r["tokens"]
        assert r["first"] == r["part"] * 256
    assert max(load.values()) <= 256
    want = Counter()
    for k, t in rows:
        if t:
            want[k] += len(encode(t))
    assert held == want
    cert = packing.certificate(packing.pack(df, 256), 256).first()
    assert cert["windows"] == len(load) and 0 <= cert["gap"] <= 1 + 0.02 * len(load) and cert["bound"] >= sum(want.values()) / 256
    assert packing.pack(df.limit(0), 256).count() == 0 and packing.certificate(packing.pack(df.limit(0), 256), 256).first()["windows"] == 0


def test_allotment():
    share, repeats = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 2, "c": 3}
    out = mixing.allot({"a": 100.0, "b": 10.0}, share, repeats, 100.0)
    assert out == pytest.approx({"a": 80.0, "b": 20.0, "c": 0.0})
    assert mixing.reachable({"a": 100.0, "b": 100.0, "c": 100.0}, share, repeats, 1.0) == pytest.approx(200.0)
    w = mixing.rake([("a", "ru", 1), ("a", "en", 1), ("b", "ru", 1)], np.array([50.0, 50.0, 10.0]), {"a": 60.0, "b": 20.0}, {"a": 1, "b": 2})
    assert np.dot(w, [50, 50, 10]) == pytest.approx(80.0, abs=0.01) and w.max() <= 2


def test_mixture(spark):
    rng = random.Random(8)
    rows = [(i, "слово дерево река " * rng.randint(1, 30), rng.choice(["ru", "RU", None, "en"]), rng.choice(["big", "BIG ", "b-i g", "mid", "mid", "tiny" if i < 6 else "mid", None, "other"]), rng.choice(["x", "y", None])) for i in range(1500)]
    rows += [(2000, None, "ru", "mid", "x"), (2001, "", "ru", "mid", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, genre string").withColumn("tokens", F.lit("clash")).withColumn("weight", F.lit(1)).withColumn("topic", F.lit(1))
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.6, 2), ("tiny", 0.05, 4), ("gone", 0.05, 3)], "source string, target_share double, max_repeats int")
    taken, shares = mixing.mix(df, targets)
    s = {r["source"]: r for r in shares.collect()}
    assert s["gone"]["tokens"] == 0 and s["tiny"]["tokens"] <= 4 * s["tiny"]["available"]
    assert s["big"]["share"] / s["mid"]["share"] == pytest.approx(0.5, rel=0.05)
    assert sum(r["share"] for r in s.values()) == pytest.approx(1.0)
    limit = {"big": 1, "mid": 2, "tiny": 4}
    assert all(1 <= r["copies"] <= limit[r["source"]] for r in taken.collect())
    none, empty = mixing.mix(df.limit(0), targets)
    assert none.count() == 0 and {r["tokens"] for r in empty.collect()} == {0}


def test_mixture_of_odd_sources(spark):
    """A source in any spelling counts, absent ones with much of the weight leave the others their shares,
    and a small allotment of large documents is filled by size."""
    rows = [(i, "слово " * (300 if i % 10 else 7), "ru", ["My  Source", "my-source", "plain"][i % 3], "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, genre string")
    targets = spark.createDataFrame([("My  Source", 0.4, 1), ("plain", 0.4, 1), ("absent", 0.2, 3), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    shares = {r["source"]: r for r in mixing.mix(df, targets)[1].collect()}
    assert set(shares) == {"My  Source", "plain", "absent"} and shares["My  Source"]["available"] > shares["plain"]["available"] > 0
    assert shares["absent"]["tokens"] == 0 and shares["plain"]["share"] == pytest.approx(0.5, rel=0.02) == shares["My  Source"]["share"]
    small = {r["source"]: r for r in mixing.mix(df, targets, total=5000)[1].collect()}
    assert all(r["tokens"] <= r["allotted"] + 1 and r["tokens"] >= 0.8 * r["allotted"] for r in small.values())


# --- p10 ---------------------------------------------------------------------------------------


def test_code_lengths_are_codes():
    tree = langid.ByteTree(Counter({"дом": 3, "дома": 1, "лес": 2}))
    for node in tree.bits.values():
        assert sum(2.0**-b for b in node[1].values()) + 2.0 ** -node[0] == pytest.approx(1.0)
    assert tree.cost("дом") < tree.cost("лис") < tree.cost("zzz") + 100


def test_held_out_languages():
    def half(text, k):
        return " ".join(text.split(". ")[k::2])

    rows = [(lang, half(t, 0)) for lang, t in SEEDS.items()]
    models = langid.fit(rows * 2)
    labeller = langid.Labeller(models)
    right = total = 0
    for lang, text in SEEDS.items():
        for s in text.split(". "):
            found = labeller.label([s])[0]
            total += 1
            right += found[0][2] == lang
    assert right / total > 0.95
    mixed = "Вчера мы долго ждали поезд. Yesterday we waited a long time for the train. Она ничего не знает об этом."
    assert [x[2] for x in labeller.label([mixed])[0]] == ["ru", "en", "ru"]
    assert [x[2] for x in labeller.label(["Vchera my dolgo zhdali poezd, potomu chto on opozdal na dva chasa."])[0]] == ["ru"]
    assert [x[2] for x in labeller.label(["昨日、私は家に帰った。", "ตอนฝนตกชายชรากลับบ้าน"])[1]] == ["th"]
    assert labeller.label(["12 34 !!", ""]) == [[], []]


def test_found_languages(spark):
    en, ru = SEEDS["en"], SEEDS["ru"]
    rows = [(1, en, "en"), (2, en, "ENG"), (3, en, "ru"), (4, ru, None), (5, ru, "und"), (6, ru, "ru_RU"), (7, ru + " " + en, "ru"), (8, None, "ru"), (9, "", None), (10, "123", None), (11, ru + " (web script)", "ru"), (12, "# sent_id = 1\n# text = Она ничего не знает об этом.\n1\tОна\tона\tPRON\t_\t_\t2\tnsubj\t_\t_\n", "rus")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("label", F.lit(1)).withColumn("segments", F.lit("clash"))
    got = sorted((r["doc_id"], r["lang"]) for r in langid.found_languages(df).collect())
    assert got == [(3, "en"), (4, "ru"), (5, "ru"), (7, "en"), (7, "ru")]
    assert langid.found_languages(df.limit(0)).count() == 0
    assert [langid.code_of(x) for x in ("sr-Cyrl", "fre", " Deu", "xx", "", None, "?")] == ["sr", "fr", "de", None, None, None, None]


def test_languages_of_all_codes(spark, monkeypatch):
    lettered = {"ca", "da", "et", "fi", "hu", "la", "lt", "lv", "no", "ro", "sk", "sl", "sv", "tt", "vi"}
    assert lettered <= set(SEEDS)
    labeller = langid.Labeller(langid.fit([(k, SEEDS[k]) for k in lettered]))
    said = {"sv": "Hunden sprang genom skogen, och barnen skrattade åt den.", "fi": "Koira juoksi metsän läpi, ja lapset nauroivat sille.", "hu": "A kutya átszaladt az erdőn, és a gyerekek nevettek rajta.", "ro": "Câinele a fugit prin pădure, iar copiii au râs de el.", "lt": "Šuo bėgo per mišką, ir vaikai iš jo juokėsi."}
    assert {k: labeller.label([t])[0][0][2] for k, t in said.items()} == {k: k for k in said}
    two = "Вчера мы долго ждали поезд, потому что он опоздал. Danke schön! Она ничего не знает об этом."
    german = langid.Labeller(langid.fit([("de", SEEDS["de"] + " Danke schön! Danke schön!"), ("ru", SEEDS["ru"])] * 3))
    assert [x[2] for x in german.label([two])[0]] == ["ru", "de", "ru"]
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 300)
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 4 = 0 THEN 'ru' END AS lang", "repeat('слово ', 10) AS text")
    assert len(langid.sample(df)) == 300
