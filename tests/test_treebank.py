"""Known answers and edge cases of the core operators."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lesograf.functions import scalars as S
from lesograf.functions import udfs
from lesograf.operators import align, audit, decode, metrics, profile, report, sampling, tokenize, validate
from lesograf.schema import SPAN, TOKEN
from lesograf.sources import conllu, fetch, sinks
from lesograf.streaming import treebank

TOKENS = f"array<{TOKEN}>"


def tok(i, head, text="x", lemma=None, pos=None, rel=None, a=0, b=1):
    return (i, text, lemma, pos, None, head, rel, a, b)


def sents(spark, rows):
    """rows: (sent_key, sent_id, text, tokens)"""
    return spark.createDataFrame([(*r, "cobald_x.conllu") for r in rows], f"sent_key bigint, sent_id string, text string, tokens {TOKENS}, source_file string")


def one(spark, heads, f):
    s = sents(spark, [(1, "a", "t", [tok(i + 1, h) for i, h in enumerate(heads)])])
    return s.select(f(F.col("tokens"))).first()[0]


@pytest.mark.parametrize("heads,v1,v2,v3", [([0, 1, 2], 2, 2, 3), ([], 0, 0, 0), ([None], 0, 0, 0), ([1], 0, 0, 0), ([2, 1, 0], 0, 0, 0), ([9, 1], 0, 2, 2), ([0, 0, 2], 1, 1, 2), ([None, 1], 0, 1, 1)])
def test_depths(spark, heads, v1, v2, v3):
    assert [one(spark, heads, f) for f in (profile.depth_v1, profile.depth_v2, profile.depth_v3)] == [v1, v2, v3]


def test_depths_against_walks(spark):
    rng, rows, want = random.Random(7), [], {}
    for k in range(60):
        n = rng.randint(1, 40)
        heads = [rng.randint(0, n) for _ in range(n)] if k % 2 else [rng.randint(0, i) for i in range(n)]
        rows.append((k, str(k), "t", [tok(i + 1, h) for i, h in enumerate(heads)]))
        steps, looped = [], False
        for i in range(n):
            c, cur = 0, i + 1
            while cur and c <= n:
                cur, c = heads[cur - 1], c + 1
            looped |= bool(cur)
            if not cur:
                steps.append(c)
        arcs = [(min(i + 1, h), max(i + 1, h)) for i, h in enumerate(heads) if h]
        cross = any(a < c < b < d for a, b in arcs for c, d in arcs)
        want[k] = (max(steps, default=1) - 1, 0 if looped else max(steps) - 1, 0 if looped else max(steps), cross)
    t = F.col("tokens")
    got = sents(spark, rows).select("sent_key", profile.depth_v1(t), profile.depth_v2(t), profile.depth_v3(t), profile.non_projective(t)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want


def test_crossing(spark):
    assert one(spark, [3, 4, 0, 3], profile.non_projective)
    assert not one(spark, [2, 0, 2], profile.non_projective)


def test_dialogues(spark):
    said = [tok(1, 0, "сказал", "сказать")]
    s = sents(spark, [(1, "a", "- Привет, - сказал он.", said), (2, "b", "Мама мыла раму.", [tok(1, 0, "мыла", "мыть")]), (3, "c", " — Да, — крикнул он.", [tok(1, 0, "крикнул", "крикнуть")]), (4, "d", "Он: «Да», сказал.", said), (5, "e", None, said), (6, "f", "− Сказать", [tok(1, 0, "сказать", None)])])
    t, x = F.col("tokens"), F.col("text")
    r = {row[0]: tuple(row[1:]) for row in s.select("sent_key", profile.dialogue_v1(x, t), profile.dialogue_v2(x, t), profile.dialogue_v3(x, t)).collect()}
    assert r == {1: (True, True, True), 2: (False,) * 3, 3: (False, False, True), 4: (True, False, False), 5: (False,) * 3, 6: (False, False, True)}


def test_profiles_of_odd_rows(spark):
    s = sents(spark, [(1, "a", None, []), (2, None, "", None), (3, "c", "А. Б.", [tok(1, None, "а-б", None, "PROPN")])]).withColumn("score", F.lit("clash"))
    p = {r["sent_key"]: r for r in profile.profile_v2(s).collect()}
    assert set(p) == {1, 3} and p[1]["length"] == 0 and p[1]["propn_ratio"] == 0 and p[3]["abbr_count"] == 2 and p[3]["hyphen_density"] == 1.0
    assert profile.profile_v3(s.limit(0)).count() == 0


def spans(*x):
    return [(i, a, b) for i, a, b in x]


def pair(spark, sys, gold):
    return spark.createDataFrame([(1, sys, gold)], f"sent_key bigint, sys array<{SPAN}>, gold array<{SPAN}>")


def test_align_best(spark):
    best = lambda s, g: [tuple(x) for x in pair(spark, s, g).select(align.align_best(F.col("sys"), F.col("gold"))).first()[0]]
    assert best(spans((1, 0, 4)), spans((10, 0, 4))) == [(1, 10, 1.0, "exact")]
    assert best(spans((1, 0, 9)), spans((10, 0, 6), (11, 6, 9)))[0][:2] == (1, 10)
    assert best(spans((1, 0, 10)), spans((10, 0, 9))) == [(1, 10, 0.9, "partial")]
    assert best(spans((1, 0, 2)), spans((10, 2, 4))) == [(1, None, 0.0, "none")]
    assert best(spans((1, 0, 4)), spans((10, 0, 2), (11, 2, 4)))[0][1] == 10  # a tie: the earlier
    assert best([], spans((1, 0, 1))) == []


def test_align_groups(spark):
    def groups(s, g):
        return [(list(x[0]), list(x[1]), x[2]) for x in pair(spark, s, g).select(align.align_groups(F.col("sys"), F.col("gold"))).first()[0]]

    assert groups(spans((1, 0, 4), (2, 4, 5)), spans((1, 0, 2), (2, 2, 4), (3, 7, 8))) == [([0], [0, 1], "split"), ([1], [], "error"), ([], [2], "error")]
    assert groups(spans((1, 0, 10)), spans((1, 9, 10))) == [([0], [], "error"), ([], [0], "error")]  # 0.1 is no edge
    assert groups([], []) == []


def test_align_groups_against_union_find(spark):
    rng, rows, want = random.Random(3), [], {}
    for k in range(80):
        def cut():
            at, out = 0, []
            for i in range(rng.randint(0, 8)):
                a = at + rng.randint(0, 2)
                at = a + rng.randint(1, 5)
                out.append((i, a, at))
            return out

        s, g = cut(), cut()
        rows.append((k, s, g))
        parent = {("s", i): ("s", i) for i in range(len(s))} | {("g", j): ("g", j) for j in range(len(g))}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, (_, a, b) in enumerate(s):
            for j, (_, c, d) in enumerate(g):
                inter = min(b, d) - max(a, c)
                if inter > 0 and inter / (b - a + d - c - inter) > 0.1:
                    parent[find(("s", i))] = find(("g", j))
        comps = {}
        for x in parent:
            comps.setdefault(find(x), []).append(x)
        want[k] = sorted((sorted(i for t, i in c if t == "s"), sorted(i for t, i in c if t == "g")) for c in comps.values())
    df = spark.createDataFrame(rows, f"k int, sys array<{SPAN}>, gold array<{SPAN}>")
    got = df.select("k", align.align_groups(F.col("sys"), F.col("gold")).alias("x")).collect()
    assert {r["k"]: sorted((list(x["sys_indices"]), list(x["gold_indices"])) for x in r["x"]) for r in got} == want


def test_offsets(spark):
    r = spark.createDataFrame([("Мама мыла раму", ["Мама", "раму", "нет"])], "t string, f array<string>").select(align.reconstruct_offsets(F.col("t"), F.col("f"))).first()[0]
    assert [tuple(x) for x in r] == [(0, 4), (10, 14), (-1, -1)]
    r = spark.createDataFrame([("- Привет! 🙂 да",)], "t string").select(tokenize.token_spans(F.col("t")).alias("s")).first()[0]
    assert [(x[1], x[2]) for x in r] == [(0, 1), (2, 8), (8, 9), (10, 11), (12, 14)]


def test_projection():
    assert udfs.project("Ёлка стоит", ["елка", "стоит", "", None]) == [(0, 4), (5, 10), None, None]
    assert udfs.project("аб деревня", ["деревья"]) == [(3, 10)]
    assert udfs.project("абв", ["щщщщ"]) == [None]
    assert udfs.project_prefix("деревня", ["деревня"]) == [(0, 7)]
    assert udfs.partial_ratio("abc", "xxabcxx") == 100.0 and udfs.partial_ratio("", "a") == 0.0


def soft(spark, sys, gold):
    kind = "array<struct<id:int,head_id:int,rel:string,pos:string,start_char:int,end_char:int>>"
    return spark.createDataFrame([(1, sys, gold)], f"sent_key bigint, sys {kind}, gold {kind}")


def test_soft_scores(spark):
    a = [(1, 2, "nsubj", "N", 0, 4), (2, 0, "root", "V", 5, 9)]
    assert tuple(metrics.soft_scores_v1(soft(spark, a, a)).first()) == (2, 1.0, 1.0)
    bad = [(1, 0, "nsubj", "N", 0, 4), (2, 0, "ROOT", "V", 5, 9)]
    assert tuple(metrics.soft_scores_v1(soft(spark, bad, a)).first()) == (2, 0.5, 0.0)
    assert tuple(metrics.soft_scores_v2(soft(spark, bad, a)).first()) == (2, 0.5, 0.5)
    assert tuple(metrics.backend_scores(soft(spark, bad, a)).first()) == (1, 1.0, 1.0, 0.5, 0.0)
    assert tuple(metrics.soft_scores_v1(soft(spark, [], [])).first()) == (0, 0.0, 0.0)


def test_segmentation(spark):
    r = spark.createDataFrame([([0, 10, 20, 20], [0, 10, 25])], "s array<int>, g array<int>").select(*metrics.segmentation_counts(F.col("s"), F.col("g"))).select(*metrics.prf(F.col("tp"), F.col("fp"), F.col("fn"))).first()
    assert r["f1"] == pytest.approx(2 / 3)


def test_misc(spark):
    r = spark.createDataFrame([("SpaceAfter=No|TokenRange=0:4",), ("_",), ("Translit",), (None,), ("",), ("A=b=c|A=d",)], "m string").select(S.misc_map(F.col("m"))).collect()
    assert [x[0] for x in r] == [{"SpaceAfter": "No", "TokenRange": "0:4"}, {}, {"Translit": "true"}, {}, {}, {"A": "d"}]


def test_lemma_rules(spark):
    d = spark.createDataFrame([("сек.", "секунда"), ("дом", "дом"), ("шла", "идти"), (None, "а"), ("", "б")], "w string, l string")
    d = d.withColumn("r", udfs.lemma_rule_build("w", "l")).withColumn("b", S.lemma_rule_apply(F.col("w"), F.col("r")))
    rows = d.collect()
    assert rows[0]["r"] == "cut_prefix=0|cut_suffix=1|append_suffix=унда"
    assert [x["b"] for x in rows] == ["секунда", "дом", "идти", None, "б"]


BLOCK = "# sent_id = s1\n# text = Мама и я\n# flag\n1-2\tМама и\t_\t_\t_\t_\t_\t_\t_\t_\n1\tМама\tмама\tNOUN\t_\tCase=Nom\t0\troot\t_\tSpaceAfter=No\n2\tи\tи\tCCONJ\t_\t_\t1\tcc\t_\t_\n2.1\t#NULL\t_\tVERB\t_\t_\t_\t_\t_\t_\n3\tя\tя\tPRON\t_\t_\tx\tconj\t_\t_\tслот\tкласс\n# late = 1\nbad line"


def test_conllu(spark, tmp_path):
    (tmp_path / "a.conllu").write_text(BLOCK + "\n\n\n" + BLOCK.replace("s1", "s2"), encoding="utf-8")
    (tmp_path / "b.conllu").write_bytes((BLOCK.replace("s1", "s3") + "\n\n" + BLOCK.replace("s1", "s4") + "\n\n").replace("\n", "\r\n").encode())
    s = conllu.read_conllu(spark, f"{tmp_path}/a.conllu").orderBy("ordinal").collect()
    assert [x["sent_id"] for x in s] == ["s1", "s2"]  # the last block counts without a blank line
    t = s[0]["tokens"]
    assert [x["kind"] for x in t] == ["range", "word", "word", "empty", "word"] and t[4]["misc"] == "Sem=слот|класс" and t[4]["head_id"] is None and s[0]["meta"]["flag"] is None
    assert [x["sent_id"] for x in conllu.read_conllu(spark, f"{tmp_path}/b.conllu", crlf=True).orderBy("ordinal").collect()] == ["s3", "s4"]
    b = conllu.read_blocks(spark, f"{tmp_path}/a.conllu")
    assert [len(x[0]) for x in b.select(conllu.simple_v1(F.col("block"))).collect()] == [2, 2]
    assert [y["head_id"] for y in b.select(conllu.parser_output(F.col("block"))).first()[0]] == [0, 1, 0]
    df = conllu.read_conllu(spark, f"{tmp_path}/a.conllu")
    sinks.write_conllu(df.select(sinks.conllu_block(F.col("meta"), F.col("tokens")).alias("block")), f"{tmp_path}/out")
    again = conllu.read_conllu(spark, f"{tmp_path}/out")
    assert sorted(map(str, again.select("sent_id", "text", "tokens").collect())) == sorted(map(str, df.select("sent_id", "text", "tokens").collect()))
    assert conllu.clean_metadata(df, "taiga").select("sent_id").distinct().count() == 2
    assert conllu.texts(df, 1).count() == 1


def test_validation(spark):
    s = sents(spark, [(1, "a", "t", [tok(1, 0), tok(2, 1)]), (2, "a", "t", [tok(1, 0)]), (3, None, None, [tok(1, 5, ""), tok(2, 0), tok(3, 0)]), (4, "d", "t", None)])
    e = {r["sent_key"]: list(r["errors"]) for r in validate.sentence_errors(s).collect()}
    assert e == {1: [], 2: [], 3: ["sent_id", "form:1", "head:1", "text", "roots:2"], 4: ["roots:0"]}
    assert tuple(validate.batch_stats(s).first()) == (4, 1, 3, 2, 1)
    assert tuple(validate.batch_stats(s.limit(0)).first()) == (0, 0, 0, 0, 0)
    good, bad = validate.split_valid(s, strict=False)
    assert sorted(r[0] for r in good.select("sent_key").collect()) == [1, 2, 4] and bad.count() == 1


def test_predicates(spark):
    p = sampling.predicate
    assert p("genre.str.contains('lit|prose', case=False, na=False) and is_dialogue == True") == "coalesce(genre rlike '(?i)lit|prose', false) and is_dialogue = True"
    d = spark.createDataFrame([(1, None, 5), (2, "fiction", 15), (3, "news", 15)], "k int, genre string, length int")
    assert sorted(r["k"] for r in sampling.where_query(d, "genre != 'fiction'").collect()) == [1, 3]
    assert [r["k"] for r in sampling.where_query(d, "10 < length < 20 and genre == 'news'").collect()] == [3]
    for bad in ("__import__('os')", "k; drop table x", "length ** 2 > 1", "@x"):
        with pytest.raises(ValueError):
            p(bad)


def test_top_k_ties_and_splits(spark):
    d = spark.createDataFrame([(k, float(k % 3)) for k in range(20)], "sent_key bigint, score double").repartition(5)
    assert sorted(r[0] for r in sampling.top_k(d, ["score"], 4).select("sent_key").collect()) == [2, 5, 8, 11]
    s = sampling.split_by_fraction(d, "score", 0.2)
    assert sorted(r["sent_key"] for r in s.where("set = 'dev'").collect()) == [2, 5, 8, 11]
    o = sampling.with_ordinal(d, "sent_key").collect()
    assert all(r["ordinal"] == r["sent_key"] + 1 for r in o)
    a, b = (sorted(r[0] for r in sampling.hash_sample(x, 5).select("sent_key").collect()) for x in (d, d.repartition(3)))
    assert a == b and len(a) == 5


def test_audit(spark):
    d = spark.createDataFrame([("D", "s", "кое-как шёл", ["кое-как", "шёл"], {"plain": ["кое", "-", "как", "шёл"], "none": None, "one": ["кое-как шёл"]})], "dataset string, sent_id string, text string, gold array<string>, models map<string,array<string>>")
    e = {(r["model"], r["error_type"]) for r in audit.audit(d).collect()}
    assert e == {("plain", "SPLIT_OVER_TOK"), ("one", "MERGE_UNDER_TOK")}
    t = {(r[0], r[1]): r[2] for r in audit.crosstab(audit.audit(d), "model", "error_type").collect()}
    assert t[("one", "SPLIT_OVER_TOK")] == 0 and sum(t.values()) == 2
    assert audit.top_errors(audit.audit(d)).count() == 2


def test_decoding(spark):
    d = spark.createDataFrame([(["[CLS]", "a", "b"], [1, 0, 2])], "w array<string>, n array<int>")
    assert list(d.select(decode.add_nulls(F.col("w"), F.col("n"))).first()[0]) == ["[CLS]", "#NULL", "a", "b", "#NULL", "#NULL"]
    assert list(d.select(decode.replace_masked(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(True), F.lit(False)))).first()[0]) == [1.0, -1e8]
    t = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "sent_key bigint, i int")
    a = spark.createDataFrame([(1, 2, 1, 0), (1, 2, 2, 1)], "sent_key bigint, `from` int, `to` int, rel int")
    r = {x["i"]: (x["head_id"], x["deprel"]) for x in decode.arcs_to_tokens(t, a, ["nsubj", "root"]).collect()}
    assert r == {1: (2, "nsubj"), 2: (0, "root"), 3: (0, "root")}
    assert [tuple(x) for x in spark.range(1).select(decode.top_entries(F.array(*map(F.lit, [0.1, 0.5, 0.5])), 2)).first()[0]] == [(1, 0.5), (2, 0.5)]


def test_arborescence():
    rng = np.random.default_rng(5)

    def brute(e):
        n, best = len(e), (-1e18, None)
        for code in range(n ** (n - 1)):
            heads, c = [0], code
            for _ in range(n - 1):
                heads.append(c % n)
                c //= n
            if any(heads[d] == d for d in range(1, n)):
                continue
            ok = True
            for d in range(1, n):
                v, k = d, 0
                while v and k <= n:
                    v, k = heads[v], k + 1
                ok &= not v
            if ok:
                best = max(best, (sum(e[heads[d], d] for d in range(1, n)), heads))
        return best[1]

    for _ in range(40):
        e = rng.normal(size=(5, 5))
        assert udfs.arborescence(e) == brute(e)


def test_tokenizers(spark):
    d = spark.createDataFrame([("Первое предложение. Второе предложение.",), ("",), (None,)], "text string").withColumn("doc_id", F.monotonically_increasing_id())
    s = tokenize.sentences_with_spans(d).collect()
    assert [(x["text"], x["start_char"]) for x in s] == [("Первое предложение.", 0), ("Второе предложение.", 20)] and s[1]["tokens"][0]["start_char"] == 20
    assert tokenize.tokenizer("missing") is None
    g = spark.createDataFrame([(["пе", "##рв", "##ый", "день", "##"],)], "p array<string>").select(tokenize.glue_pieces(F.col("p"))).first()[0]
    assert list(g) == ["первый", "день"]
    tokenize.register("letters", lambda c: F.split(c, ""))
    assert tokenize.tokenizer("letters") is not None


def test_cache(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "key string")
    have = spark.createDataFrame([("a", "old")], "key string, value string")
    out, new = tokenize.cached(rows, have, lambda r: r.withColumn("value", F.lit("new")))
    assert sorted(map(tuple, out.collect())) == [("a", "old"), ("b", "new")] and new.count() == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.conllu").write_text(BLOCK + "\n\n" + BLOCK + "\n\n", encoding="utf-8")
    s = treebank.first_of_each(treebank.read_stream(spark, f"{tmp_path}/in"))
    treebank.run_once(s, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_reports(spark):
    d = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, None)], "g int, x double")
    r = {x["g"]: x for x in report.describe(d, "x", "g").collect()}
    assert r[1]["p50"] == 2.0 and r[2]["count"] == 0 and r[2]["mean"] is None
    assert [x["ecdf"] for x in report.ecdf(d.where("g = 1"), "x").orderBy("x").collect()] == [0.5, 1.0]
    assert sum(x["n"] for x in report.histogram(d, "x").collect()) == 2 and report.histogram(d.limit(0), "x").count() == 0
    assert report.markdown(d.limit(1)).startswith("| g | x |")


def test_fetch(tmp_path):
    (tmp_path / "src.txt").write_text("<!DOCTYPE html>")
    (tmp_path / "c.json").write_text('{"taiga": {"train": {"user": "u", "repo": "r", "path": "p"}, "dev": "file://%s/src.txt", "test": "file://%s/none"}}' % (tmp_path, tmp_path))
    urls = fetch.source_urls(fetch.load_config(f"{tmp_path}/c.json"))
    assert urls["taiga"]["train"] == "https://raw.githubusercontent.com/u/r/master/p"
    del urls["taiga"]["train"]
    got = fetch.download_all(urls, f"{tmp_path}/land")
    assert list(got["taiga"]) == ["dev"] and fetch.is_markup(got["taiga"]["dev"])


def test_decoded_trees_against_all_trees():
    """The decoded tree has the greatest sum of probabilities among all trees with that root."""
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 4):
        for _ in range(20):
            scores = rng.normal(size=(n, n)) * 2
            got = udfs.decode_tree(scores)
            e = np.exp(scores - scores.max(axis=0))
            p = e / e.sum(axis=0)
            root = int(p.diagonal().argmax())
            best = -1.0
            for heads in itertools.product(range(n), repeat=n):
                if heads[root] != root or any(h == d for d, h in enumerate(heads) if d != root):
                    continue
                if all(root in _chain(heads, d, n) for d in range(n)):
                    best = max(best, sum(p[h, d] for d, h in enumerate(heads) if d != root))
            assert got[root] == root and all(root in _chain(got, d, n) for d in range(n))
            assert sum(p[h, d] for d, h in enumerate(got) if d != root) == pytest.approx(max(best, 0.0))


def test_decoded_trees_twice_in_a_session(spark, tmp_path):
    """Each call gives the stored trees, whatever the order of the tokens."""
    from lesograf.plans import catalog

    trees = {1: [(2, 0), (1, 2), (3, 2)], 2: [(1, 2), (2, 1), (3, 0)], 3: [(1, 0), (2, None)], 4: []}
    sents(spark, [(k, "a", "t", [tok(*t) for t in v]) for k, v in trees.items()]).write.parquet(f"{tmp_path}/sentences.parquet")
    for _ in range(2):
        got = catalog.queries()["decoded_trees"](spark, str(tmp_path)).collect()
        assert sorted(map(tuple, got)) == [(1, 1, 2), (1, 2, 0), (1, 3, 2)]


def _chain(heads, d, n):
    out = [d]
    for _ in range(n):
        out.append(heads[out[-1]])
    return out


def test_small_shapers(spark):
    from lesograf.operators import adapters, align, report, tokenize

    assert adapters.first_result(lambda: None, lambda: (_ for _ in ()).throw(OSError("x")), lambda: {"uas": 1.0}, lambda: {"uas": 0.0}) == {"uas": 1.0}
    assert adapters.first_result() is None
    df = spark.createDataFrame([("а  б\tв\nг",)], "text string").select("text", F.expr("array(named_struct('start_char', 0, 'end_char', 1), named_struct('start_char', 3, 'end_char', 4), named_struct('start_char', 5, 'end_char', 6), named_struct('start_char', 7, 'end_char', 8))").alias("tokens"))
    assert df.select(tokenize.spaces_after(F.col("text"), F.col("tokens")).alias("m")).first()["m"] == ["SpacesAfter='  '", "_", "_", "_"]
    assert df.select(tokenize.simple_sentences(F.lit("Да! Он спал...  Нет?")).alias("s")).first()["s"] == [["Да"], ["Он", "спал"], ["Нет"]]
    pieces = "array(named_struct('text', 'кое', 'lemma', 'кое', 'pos', 'ADV', 'head_id', 3, 'rel', 'dep'), named_struct('text', '-', 'lemma', '-', 'pos', 'PUNCT', 'head_id', 1, 'rel', 'punct'), named_struct('text', 'как', 'lemma', 'как', 'pos', 'ADV', 'head_id', 4, 'rel', 'x'), named_struct('text', 'шёл', 'lemma', 'идти', 'pos', 'VERB', 'head_id', 0, 'rel', 'root'), named_struct('text', 'он', 'lemma', 'он', 'pos', 'PRON', 'head_id', 9, 'rel', 'nsubj'))"
    got = df.select(align.merge_parsed(F.expr("array('кое-как', 'шёл', 'он', 'мимо')"), F.expr(pieces)).alias("t")).first()["t"]
    assert [(t["id"], t["text"], t["head_id"], t["rel"], t["n"]) for t in got] == [(1, "кое-как", 1, "flat:merged", 3), (2, "шёл", 0, "root", 1), (3, "он", 0, "nsubj", 1)]
    assert report.markdown(spark.range(5), 3).endswith("only the first 3 rows") and "only" not in report.markdown(spark.range(3), 3)


def test_settled_tables_are_forgotten(spark):
    import os

    from lesograf.sources import tables

    t = tables.settle(spark.range(3))
    assert t.count() == 3
    path = tables._SETTLED[spark.sparkContext.applicationId][-1]
    assert os.path.isdir(path) and tables.forget_settled(spark) >= 1 and not os.path.isdir(path)
