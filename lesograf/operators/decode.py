"""Decoding of what neural taggers and parsers give: tags, ids, arcs, probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lesograf.functions.scalars import softmax

NULL_WORD, START = "#NULL", "[CLS]"


def enumerate_words(words: Column) -> Column:
    """Ids of words and null words: ``1, 2, 2.1, 2.2, 3``; null words before the first are ``0.1``..."""
    start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("k"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        null = x == NULL_WORD
        w, k = F.when(null, a["w"]).otherwise(a["w"] + 1), F.when(null, a["k"] + 1).otherwise(0)
        return F.struct(w.alias("w"), k.alias("k"), F.concat(a["out"], F.array(F.when(null, F.concat_ws(".", w.cast("string"), k.cast("string"))).otherwise(w.cast("string")))).alias("out"))

    return F.aggregate(words, start, step, lambda a: a["out"])


def prepend_start(words: Column) -> Column:
    return F.concat(F.array(F.lit(START)), words)


def remove_nulls(words: Column) -> Column:
    return F.filter(words, lambda w: w != NULL_WORD)


def add_nulls(words: Column, counts: Column) -> Column:
    """``counts[i]`` null words after word i; the first word is the start sign. NULL if the lengths differ."""
    filled = F.flatten(F.transform(F.arrays_zip(words.alias("w"), counts.alias("n")), lambda z: F.concat(F.array(z["w"]), F.array_repeat(F.lit(NULL_WORD), z["n"]))))
    return F.when(F.size(words) == F.size(counts), filled)


def padding_mask(words: Column, length: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), length), lambda i: i <= F.size(words))


def null_mask(words: Column) -> Column:
    return F.transform(words, lambda w: w != NULL_WORD)


def pairwise_mask(mask: Column) -> Column:
    return F.transform(mask, lambda a: F.transform(mask, lambda b: a & b))


def replace_masked(values: Column, mask: Column, fill: float = -1e8) -> Column:
    return F.zip_with(values, mask, lambda v, m: F.when(m, v).otherwise(F.lit(fill)))


def id_mapping(words: Column) -> Column:
    """Position (0-based) of each word -> id: the start sign 0, null words none, others 1..n."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.expr("cast(array() as array<struct<i:int,id:int>>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        word = (x != NULL_WORD) & (x != START)
        n = F.when(word, a["n"] + 1).otherwise(a["n"])
        mine = F.when(x == START, F.array(F.struct(a["i"].alias("i"), F.lit(0).alias("id")))).when(word, F.array(F.struct(a["i"].alias("i"), n.alias("id")))).otherwise(F.expr("cast(array() as array<struct<i:int,id:int>>)"))
        return F.struct((a["i"] + 1).alias("i"), n.alias("n"), F.concat(a["out"], mine).alias("out"))

    return F.map_from_entries(F.aggregate(words, start, step, lambda a: a["out"]))


def dependency(text: Column) -> Column:
    """``head:rel`` as a struct; without a colon the head alone."""
    return F.struct(F.split(text, ":", 2)[0].alias("head"), F.get(F.split(text, ":", 2), F.lit(1)).alias("rel"))


def label_of(vocabulary: list[str], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, vocabulary)), index)


def arcs_to_tokens(tokens: DataFrame, arcs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Tokens (sent_key, i) with head and relation of their arc (sent_key, from, to, rel); a self-arc is
    the root; without arc (0, root)."""
    a = arcs.select("sent_key", F.col("to").alias("i"), F.when(F.col("from") == F.col("to"), 0).otherwise(F.col("from")).alias("head_id"), label_of(vocabulary, F.col("rel")).alias("deprel"))
    return tokens.join(a, ["sent_key", "i"], "left").withColumn("head_id", F.coalesce("head_id", F.lit(0))).withColumn("deprel", F.coalesce("deprel", F.lit("root")))


def greedy_heads(scores: DataFrame) -> DataFrame:
    """Best arc of every (sent_key, to); ties go to the first head."""
    w = Window.partitionBy("sent_key", "to").orderBy(F.desc("score"), "from")
    return scores.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def multi_arcs(scores: DataFrame) -> DataFrame:
    """Arcs with a probability above one half, which is a score above 0."""
    return scores.where("score > 0")


def label_arcs(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    return arcs.join(labels, ["sent_key", "from", "to"])


def mean_pool(pieces: DataFrame) -> DataFrame:
    """Mean vector of the pieces of every (sent_key, word); vectors of one length."""
    e = pieces.select("sent_key", "word", F.posexplode("vector").alias("k", "x")).groupBy("sent_key", "word", "k").agg(F.avg("x").alias("x"))
    return e.groupBy("sent_key", "word").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("vector"))


def probabilities(tokens: DataFrame) -> DataFrame:
    """upos_proba, heads_proba, deps_proba from energies; 0.95, uniform and root where they are missing."""
    n = F.greatest(F.col("n") + 1, F.lit(1))
    heads = F.coalesce(softmax(F.col("head_energies")), F.array_repeat(F.lit(1.0) / n, n))
    return tokens.withColumn("upos_proba", F.coalesce(F.array_max(softmax(F.col("upos_energies"))), F.lit(0.95))).withColumn("heads_proba", heads).withColumn("deps_proba", F.coalesce(F.map_from_arrays("labels", softmax(F.col("deprel_energies"))), F.create_map(F.lit("root"), F.lit(0.95))))


def top_entries(values: Column, k: int = 5) -> Column:
    """The k greatest of an array with their indices; equal values in order."""
    z = F.transform(values, lambda v, i: F.struct((-v).alias("m"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(z), 1, k), lambda x: F.struct(x["i"].alias("index"), (-x["m"]).alias("value")))
