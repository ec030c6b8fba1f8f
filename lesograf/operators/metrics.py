"""Attachment, segmentation and backend metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lesograf.functions.scalars import let
from lesograf.operators.align import align_best, align_groups, align_window


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def strict_rows(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Words of both sides by (sent_key, id): ``head_ok, rel_ok, in_pred``; gold keeps all its words."""
    p = pred.select("sent_key", "id", F.col("head_id").alias("p_head"), F.col("rel").alias("p_rel"), F.lit(True).alias("there"))
    rows = gold.select("sent_key", "id", "head_id", "rel").join(p, ["sent_key", "id"], "left")
    head = F.coalesce(F.col("head_id") == F.col("p_head"), F.lit(False))
    return rows.select("sent_key", "id", head.alias("head_ok"), (head & F.coalesce(F.col("rel") == F.col("p_rel"), F.lit(False))).alias("rel_ok"), F.coalesce("there", F.lit(False)).alias("in_pred"))


def strict_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Over all gold words: ``words, uas, las``."""
    r = strict_rows(gold, pred)
    n = F.count(F.lit(1))
    return r.agg(n.alias("words"), ratio(F.count_if("head_ok"), n).alias("uas"), ratio(F.count_if("rel_ok"), n).alias("las"))


def strict_equal_length(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Sentences with as many words on both sides; the others are counted: ``words, skipped, uas, las``."""
    g, p = gold.groupBy("sent_key").agg(F.count(F.lit(1)).alias("n")), pred.groupBy("sent_key").agg(F.count(F.lit(1)).alias("m"))
    sizes = g.join(p, "sent_key", "left").withColumn("same", F.coalesce(F.col("n") == F.col("m"), F.lit(False)))
    r = strict_rows(gold, pred).groupBy("sent_key").agg(F.count(F.lit(1)).alias("k"), F.count_if("head_ok").alias("u"), F.count_if("rel_ok").alias("l"))
    j = sizes.join(r, "sent_key")
    words = F.coalesce(F.sum(F.when(F.col("same"), F.col("k"))), F.lit(0))
    return j.agg(words.alias("words"), F.count_if(~F.col("same")).alias("skipped"), ratio(F.coalesce(F.sum(F.when(F.col("same"), F.col("u"))), F.lit(0)), words).alias("uas"), ratio(F.coalesce(F.sum(F.when(F.col("same"), F.col("l"))), F.lit(0)), words).alias("las"))


def strict_common_ids(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Over the words whose id both sides have: ``words, uas, las``."""
    r = strict_rows(gold, pred).where("in_pred")
    n = F.count(F.lit(1))
    return r.agg(n.alias("words"), ratio(F.count_if("head_ok"), n).alias("uas"), ratio(F.count_if("rel_ok"), n).alias("las"))


def strict_macro(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Mean of the sentences' scores: ``sentences, uas, las``."""
    r = strict_rows(gold, pred).groupBy("sent_key").agg(F.avg(F.col("head_ok").cast("int")).alias("u"), F.avg(F.col("rel_ok").cast("int")).alias("l"))
    return r.agg(F.count(F.lit(1)).alias("sentences"), F.coalesce(F.avg("u"), F.lit(0.0)).alias("uas"), F.coalesce(F.avg("l"), F.lit(0.0)).alias("las"))


def content_las(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Labelled score without function words: ``words, clas``."""
    rel = F.coalesce("rel", F.lit(""))
    return strict_scores(gold.where(~rel.isin("det", "clf", "case", "cc", "fixed", "flat", "cop", "mark", "punct")), pred).select("words", F.col("las").alias("clas"))


def _by_id(tokens: Column, key: Column) -> Column:
    return F.get(F.filter(tokens, lambda t: t["id"] == key), F.lit(0))


def soft_counts_v1(pairs: DataFrame) -> DataFrame:
    """Per sentence over aligned system tokens: ``sent_key, aligned, uas_ok, las_ok``.

    ``pairs``: sent_key, sys and gold (id, head_id, rel, start_char, end_char). A root must meet a
    root; another head must be aligned with the gold head."""
    def check(al: Column, sys: Column, gold: Column, x: Column) -> Column:
        def judge(s: Column, g: Column) -> Column:
            aligned = F.get(F.filter(al, lambda y: y["sys_id"] == s["head_id"]), F.lit(0))["gold_id"]
            head = F.when(s["head_id"] == 0, F.coalesce(g["head_id"] == 0, F.lit(False))).otherwise(aligned.eqNullSafe(g["head_id"]))
            return F.struct(head.alias("h"), s["rel"].eqNullSafe(g["rel"]).alias("r"))

        return let(_by_id(sys, x["sys_id"]), lambda s: let(_by_id(gold, x["gold_id"]), lambda g: judge(s, g)))

    def whole(sys: Column, gold: Column) -> Column:
        found = F.filter(align_best(sys, gold), lambda x: x["gold_id"].isNotNull())
        return let(found, lambda al: F.transform(al, lambda x: check(al, sys, gold, x)))

    # the spans may be derived in the same plan: bound once, they aren't derived for every token
    checked = let(F.col("sys"), lambda s: let(F.col("gold"), lambda g: whole(s, g)))
    counts = let(checked, lambda c: F.struct(F.size(c).alias("aligned"), F.size(F.filter(c, lambda x: x["h"])).alias("uas_ok"), F.size(F.filter(c, lambda x: x["h"] & x["r"])).alias("las_ok")))
    return pairs.select("sent_key", counts.alias("n")).select("sent_key", "n.*")


def soft_scores_v1(pairs: DataFrame) -> DataFrame:
    c = soft_counts_v1(pairs)
    n = F.coalesce(F.sum("aligned"), F.lit(0))
    return c.agg(n.alias("aligned"), ratio(F.sum("uas_ok"), n).alias("soft_uas"), ratio(F.sum("las_ok"), n).alias("soft_las"))


def soft_scores_v2(pairs: DataFrame) -> DataFrame:
    """Over all gold tokens, by aligned groups; ids count from 1 in the order of the arrays, the first
    system token of a group stands for it, labels are compared without case."""
    none = F.expr("cast(array() as array<int>)")

    def check(groups: Column, sys: Column, g: Column, j: Column) -> Column:
        of_gold = lambda k: F.coalesce(F.get(F.filter(groups, lambda x: F.array_contains(x["gold_indices"], k)), F.lit(0))["sys_indices"], none)

        def judge(mine: Column) -> Column:
            s = F.get(sys, F.get(mine, F.lit(0)))
            head = F.when(g["head_id"] == 0, s["head_id"] == 0).otherwise((s["head_id"] > 0) & F.array_contains(of_gold(g["head_id"] - 1), s["head_id"] - 1))
            return let(F.coalesce((F.size(mine) > 0) & head, F.lit(False)), lambda ok: F.struct(ok.alias("h"), F.coalesce(ok & (F.lower(s["rel"]) == F.lower(g["rel"])), F.lit(False)).alias("r")))

        return let(of_gold(j), judge)

    def whole(sys: Column, gold: Column) -> Column:
        return let(align_groups(sys, gold), lambda groups: F.transform(gold, lambda g, j: check(groups, sys, g, j)))

    checked = let(F.col("sys"), lambda s: let(F.col("gold"), lambda g: whole(s, g)))
    counts = let(checked, lambda c: F.struct(F.size(c).alias("n"), F.size(F.filter(c, lambda x: x["h"])).alias("h"), F.size(F.filter(c, lambda x: x["r"])).alias("r")))
    c = pairs.select(counts.alias("x")).select("x.*")
    n = F.coalesce(F.sum("n"), F.lit(0))
    return c.agg(n.alias("tokens"), ratio(F.sum("h"), n).alias("soft_uas"), ratio(F.sum("r"), n).alias("soft_las"))


def segmentation_counts(sys: Column, gold: Column) -> list[Column]:
    """tp, fp, fn of two arrays of offsets taken as sets."""
    s, g = F.array_distinct(sys), F.array_distinct(gold)
    return [F.size(F.array_intersect(s, g)).alias("tp"), F.size(F.array_except(s, g)).alias("fp"), F.size(F.array_except(g, s)).alias("fn")]


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")]


def segmentation_scores(pairs: DataFrame) -> DataFrame:
    starts = lambda c: F.transform(c, lambda t: t["start_char"])
    c = pairs.select(*segmentation_counts(starts("sys"), starts("gold")))
    sums = c.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fp", "fn")))
    return sums.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def backend_scores(pairs: DataFrame) -> DataFrame:
    """Mean over sentences of token coverage, tag accuracy, and raw-id attachment scores."""
    def check(sys: Column, gold: Column, x: Column) -> Column:
        def judge(g: Column, s: Column) -> Column:
            head = g["head_id"].eqNullSafe(s["head_id"])
            return F.struct(g["pos"].eqNullSafe(s["pos"]).alias("p"), head.alias("h"), (head & g["rel"].eqNullSafe(s["rel"])).alias("r"))

        return let(_by_id(gold, x["gold_id"]), lambda g: let(F.get(sys, x["sys_index"]), lambda s: judge(g, s)))

    def whole(sys: Column, gold: Column) -> Column:
        return let(align_window(gold, sys), lambda al: F.struct(F.size(al).alias("n"), F.transform(F.filter(al, lambda x: x["sys_index"].isNotNull()), lambda x: check(sys, gold, x)).alias("c")))

    checked = let(F.col("sys"), lambda s: let(F.col("gold"), lambda g: whole(s, g)))
    count = lambda x, k: F.size(F.filter(x["c"], lambda y: y[k])).alias(k)
    counts = let(checked, lambda x: F.struct(x["n"].alias("n"), F.size(x["c"]).alias("m"), count(x, "p"), count(x, "h"), count(x, "r")))
    b = pairs.select(counts.alias("x")).select("x.*")
    m = F.col("m")
    per = b.select(ratio(m, F.col("n")).alias("t"), ratio(F.col("p"), m).alias("p"), ratio(F.col("h"), m).alias("u"), ratio(F.col("r"), m).alias("l"))
    return per.agg(F.count(F.lit(1)).alias("sentences"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(n) for c, n in (("t", "token_f1"), ("p", "pos_accuracy"), ("u", "uas"), ("l", "las"))))


def confidence(tokens: DataFrame) -> DataFrame:
    """Mean, least and greatest of the tag's, the chosen head's and the chosen relation's probability.

    ``tokens``: upos_proba double, head int, heads_proba array<double> (0 is the root), deprel string,
    deps_proba map<string,double>; missing ones are skipped."""
    each = {"upos": F.col("upos_proba"), "head": F.get("heads_proba", F.col("head")), "deprel": F.col("deps_proba")[F.col("deprel")]}
    return tokens.agg(*(f(c).alias(f"{k}_{n}") for k, c in each.items() for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))))
