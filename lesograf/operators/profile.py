"""Profiles of sentences: everything is computed within the row from the nested tokens, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lesograf.functions.scalars import let, score_v1, score_v2

# Verbs of speech; the later profilers know fewer or more of them.
VERBS_V1 = "сказать говорить ответить отвечать спросить спрашивать промолвить заявить подумать воскликнуть шептать пояснить заметить продолжить добавить".split()
VERBS_V2 = "сказать говорить ответить отвечать спросить спрашивать промолвить заявить подумать воскликнуть шептать пояснить".split()
VERBS_V3 = [*VERBS_V1, "прошептать", "крикнуть"]


def tree(tokens: Column) -> Column:
    """``p``: top of every token's chain of heads (0 root, -1 a head that isn't there, -2 no head, else a
    token in a cycle); ``d``: steps to it. Pointer doubling: chains halve in each of log2(n) rounds."""
    p = let(F.transform(tokens, lambda t: t["id"]), lambda ids: F.transform(tokens, lambda t: F.when(t["head_id"].isNull(), F.lit(-2)).when(t["head_id"] == 0, F.lit(0)).otherwise(F.coalesce(F.nullif(F.array_position(ids, t["head_id"]).cast("int"), F.lit(0)), F.lit(-1)))))
    d = F.transform(tokens, lambda t: F.when(t["head_id"].isNull(), F.lit(0)).otherwise(F.lit(1)))
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(tokens) + 1)).cast("int") + 1)

    def double(a: Column, _: Column) -> Column:
        return F.struct(
            F.transform(a["p"], lambda x: F.when(x > 0, F.get(a["p"], x - 1)).otherwise(x)).alias("p"),
            F.transform(F.arrays_zip(a["p"].alias("p"), a["d"].alias("d")), lambda z: z["d"] + F.when(z["p"] > 0, F.get(a["d"], z["p"] - 1)).otherwise(0)).alias("d"),
        )

    return F.aggregate(rounds, F.struct(p.alias("p"), d.alias("d")), double)


def _deepest(t: Column, keep, value) -> Column:
    zipped = F.arrays_zip(t["p"].alias("p"), t["d"].alias("d"))
    return F.coalesce(F.array_max(F.transform(F.filter(zipped, keep), value)), F.lit(0))


def depth_v1(tokens: Column) -> Column:
    """Greatest distance from a root among the tokens that a root reaches; 0 without a root."""
    return let(tree(tokens), lambda t: _deepest(t, lambda z: z["p"] == 0, lambda z: z["d"] - 1))


def depth_v2(tokens: Column) -> Column:
    """Longest chain of arcs between tokens (a head that isn't there counts); 0 if there is a cycle."""
    return let(tree(tokens), lambda t: F.when(F.exists(t["p"], lambda p: p > 0), 0).otherwise(_deepest(t, lambda z: z["p"] <= 0, lambda z: z["d"] - F.when(z["p"] == 0, 1).otherwise(0))))


def depth_v3(tokens: Column) -> Column:
    """As depth_v2 with the arc from the virtual root."""
    return let(tree(tokens), lambda t: F.when(F.exists(t["p"], lambda p: p > 0), 0).otherwise(_deepest(t, lambda z: z["p"] <= 0, lambda z: z["d"])))


def non_projective(tokens: Column) -> Column:
    """Whether two arcs cross; arcs from the root and without head are left out."""
    arcs = F.transform(F.filter(tokens, lambda t: t["head_id"] > 0), lambda t: F.struct(F.least(t["id"], t["head_id"]).alias("s"), F.greatest(t["id"], t["head_id"]).alias("e")))
    return let(arcs, lambda arcs: F.exists(arcs, lambda a: F.exists(arcs, lambda b: (a["s"] < b["s"]) & (b["s"] < a["e"]) & (a["e"] < b["e"]))))


def _speaks(tokens: Column, verbs: list[str], form_too: bool) -> Column:
    def word(t: Column) -> Column:
        lemma = F.lower(t["lemma"])
        return F.coalesce(F.nullif(lemma, F.lit("")), F.lower(t["text"])) if form_too else lemma

    return F.exists(tokens, lambda t: F.coalesce(word(t).isin(verbs), F.lit(False)))


def _starts(text: Column, dashes: str) -> Column:
    return F.coalesce(text.rlike(f"(?U)^\\s*[{dashes}]"), F.lit(False))


def dialogue_v1(text: Column, tokens: Column) -> Column:
    """A dash at the start or both quotation marks, and a verb of speech among lemmas (else forms)."""
    quoted = F.coalesce(F.contains(text, F.lit("«")) & F.contains(text, F.lit("»")), F.lit(False))
    return (_starts(text, "\\-–—") | quoted) & _speaks(tokens, VERBS_V1, True)


def dialogue_v2(text: Column, tokens: Column) -> Column:
    return _starts(text, "\\-—–") & _speaks(tokens, VERBS_V2, False)


def dialogue_v3(text: Column, tokens: Column) -> Column:
    return _starts(text, "\\-—–−") & _speaks(tokens, VERBS_V3, True)


def count_pos(tokens: Column, pos: str) -> Column:
    return F.size(F.filter(tokens, lambda t: F.coalesce(t["pos"] == pos, F.lit(False))))


def count_hyphens(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: F.coalesce(F.contains(t["text"], F.lit("-")) & (F.length(t["text"]) > 1), F.lit(False))))


def count_abbreviations(text: Column) -> Column:
    """A capital letter with a period that begins a word."""
    return F.coalesce(F.regexp_count(text, F.lit("(?<![\\p{L}\\p{M}\\p{N}_])[А-ЯЁA-Z]\\.")), F.lit(0))


def count_clusters(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[.?!,:;\\-]{2,}")), F.lit(0))


def profile_v1(sentences: DataFrame) -> DataFrame:
    """``sent_key, text_len, is_dialogue, tree_depth, non_projectivity``."""
    s = sentences.where("tokens IS NOT NULL")
    return s.select("sent_key", F.size("tokens").alias("text_len"), dialogue_v1(F.col("text"), F.col("tokens")).alias("is_dialogue"), depth_v1(F.col("tokens")).alias("tree_depth"), non_projective(F.col("tokens")).alias("non_projectivity"))


def profile_v2(sentences: DataFrame, *keep: str) -> DataFrame:
    """The enriched profile, with the columns ``keep`` of the input; densities unrounded. Sentences without
    tokens are left out."""
    t, text = F.col("tokens"), F.col("text")
    s = sentences.where("tokens IS NOT NULL").select("sent_key", F.struct("source_file", *keep).alias("_own"), F.size(t).alias("length"), depth_v2(t).alias("depth"), non_projective(t).alias("non_proj"), dialogue_v2(text, t).alias("is_dialogue"), count_pos(t, "PRON").alias("pronouns"), count_pos(t, "PROPN").alias("propn"), count_hyphens(t).alias("hyphens"), count_abbreviations(text).alias("abbr_count"), count_clusters(text).alias("punct_clusters"), F.coalesce(F.array_max(F.transform(t, lambda x: F.length(x["text"]))), F.lit(0)).alias("max_token_len"))
    bonus = F.contains(F.lower("_own.source_file"), F.lit("cobald"))
    share = lambda c: F.when(F.col("length") > 0, F.col(c) / F.col("length")).otherwise(0.0)
    return s.select("sent_key", score_v1(F.col("depth"), F.col("non_proj"), F.col("is_dialogue"), F.col("pronouns"), F.coalesce(bonus, F.lit(False))).alias("score"), "length", "depth", "non_proj", (F.col("depth") + 10 * F.col("non_proj").cast("int")).alias("syntax_complexity"), "is_dialogue", "pronouns", share("propn").alias("propn_ratio"), share("hyphens").alias("hyphen_density"), "abbr_count", "punct_clusters", "max_token_len", *(F.col("_own")[k].alias(k) for k in keep))


def profile_v3(sentences: DataFrame) -> DataFrame:
    t, text = F.col("tokens"), F.col("text")
    s = sentences.where("tokens IS NOT NULL").select("sent_key", "source_file", depth_v3(t).alias("depth"), non_projective(t).alias("non_proj"), dialogue_v3(text, t).alias("is_dialogue"), count_pos(t, "PRON").alias("pronouns"), count_pos(t, "PROPN").alias("propn"), count_pos(t, "VERB").alias("verbs"), F.size(t).alias("length"))
    bonus = F.coalesce(F.contains(F.lower("source_file"), F.lit("cobald")), F.lit(False))
    return s.select("sent_key", score_v2(F.col("depth"), F.col("non_proj"), F.col("is_dialogue"), F.col("pronouns"), F.col("verbs"), bonus).alias("score"), F.col("is_dialogue").cast("double").alias("dialogue_score"), (F.col("depth") + 10.0 * F.col("non_proj").cast("int")).alias("syntax_complexity"), "depth", "non_proj", "pronouns", "propn", "verbs", "length")
