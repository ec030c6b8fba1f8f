"""Scalar functions as Columns; everything that Spark has stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Part-of-speech tags of a dictionary analyser and their universal tags.
POS_MAP = {"S": "NOUN", "A": "ADJ", "V": "VERB", "ADV": "ADV", "PR": "ADP", "CONJ": "CCONJ", "PART": "PART", "INTJ": "INTJ", "NUM": "NUM", "SPRO": "PRON", "APRO": "DET", "ADVPRO": "ADV", "ANUM": "ADJ", "COM": "NOUN"}
# Fixed value: signs that are punctuation whatever the analyser says (a form that occurs in this text).
PUNCTUATION = ".!?,;:—–-\"«»()[]{}"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for a row: as a lambda's variable it isn't copied
    into every place that names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def misc_map(misc: Column) -> Column:
    """``k=v|flag`` as a map; values keep later ``=`` signs, flags are ``true``; ``_`` and empty give an empty map.

    NULL gives an empty map; of a repeated key the last value stays."""
    parts = F.filter(F.split(F.coalesce(misc, F.lit("_")), "\\|"), lambda p: (p != "_") & (p != ""))
    entry = F.transform(parts, lambda p: F.struct(F.split(p, "=", 2)[0].alias("key"), F.when(F.contains(p, F.lit("=")), F.split(p, "=", 2)[1]).otherwise(F.lit("true")).alias("value")))
    keys = F.array_distinct(F.transform(entry, lambda e: e["key"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(entry, lambda e: e["key"] == k), -1)["value"])
    return F.map_from_arrays(keys, last)


def feats_map(feats: Column) -> Column:
    return misc_map(feats)


def head_int(head: Column) -> Column:
    """``1_5`` is 5; NULL and what is no number is 0."""
    return F.coalesce(F.element_at(F.split(head, "_"), -1).try_cast("int"), F.lit(0))


def head_digits(head: Column) -> Column:
    """Digits as a number, anything else 0."""
    return F.when(head.rlike("^[0-9]+$"), head.try_cast("int")).otherwise(F.lit(0))


def id_kind(id_: Column) -> Column:
    return F.when(id_.rlike("^[0-9]+$"), "word").when(id_.rlike("^[0-9]+-[0-9]+$"), "range").when(id_.rlike("^[0-9]+\\.[0-9]+$"), "empty").otherwise("bad")


def norm_lemma(word: Column) -> Column:
    return F.translate(F.lower(word), "ё", "е")


def falsy(text: Column, other: Column | str) -> Column:
    """The text, or ``other`` where it is NULL or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), other if isinstance(other, Column) else F.lit(other))


def lemma_rule_apply(word: Column, rule: Column) -> Column:
    """``cut_prefix=a|cut_suffix=b|append_suffix=c`` applied to a word, its case kept.

    A rule that can't be read gives the word in lower case."""
    a = F.nullif(F.regexp_extract(rule, "cut_prefix=([0-9]+)", 1), F.lit("")).cast("int")
    b = F.nullif(F.regexp_extract(rule, "cut_suffix=([0-9]+)", 1), F.lit("")).cast("int")
    c = F.regexp_extract(rule, "append_suffix=([^|]*)", 1)
    cut = F.substring(word, a + 1, F.greatest(F.length(word) - a - b, F.lit(0)))
    return F.when(a.isNull() | b.isNull(), F.lower(word)).otherwise(F.concat(cut, c))


def tag_part(tag: Column, part: int) -> Column:
    """UPOS, XPOS or feats of ``UPOS#XPOS#Feats``; ``_`` where it is missing."""
    return falsy(F.split(tag, "#")[part], "_")


def universal_pos(grammar: Column, form: Column) -> Column:
    """Universal tag of a dictionary tag such as ``S,жен=им``; X if unknown; punctuation by its form."""
    tag = F.split(grammar, "[,=]")[0]
    table = F.create_map(*(F.lit(x) for kv in POS_MAP.items() for x in kv))
    return F.when(F.contains(F.lit(PUNCTUATION), form), "PUNCT").otherwise(F.coalesce(table[tag], F.lit("X")))


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two spans; 0 for NULL, disjoint and touching spans."""
    inter = F.least(a1, b1) - F.greatest(a0, b0)
    return F.coalesce(F.when(inter > 0, inter / (a1 - a0 + b1 - b0 - inter)), F.lit(0.0))


def coverage(gold0: Column, gold1: Column, sys0: Column, sys1: Column) -> Column:
    """Share of the gold span that the other covers."""
    inter = F.least(gold1, sys1) - F.greatest(gold0, sys0)
    return F.coalesce(F.when(inter > 0, inter / (gold1 - gold0)), F.lit(0.0))


def offset_fits(text: Column, form: Column, start: Column, end: Column) -> Column:
    return F.coalesce(F.substring(text, start + 1, end - start) == form, F.lit(False))


def standard_id(file_name: Column, ordinal: Column) -> Column:
    """``PREFIX_0000001``: the first part of the file name in upper case, and a running number."""
    return F.format_string("%s_%07d", F.upper(F.split(file_name, "_")[0]), ordinal)


def dataset_name(file_name: Column) -> Column:
    """The corpus that a file name names, else its stem in upper case."""
    up = F.upper(file_name)
    stem = F.regexp_replace(F.element_at(F.split(up, "/"), -1), "\\.[^.]*$", "")
    out = stem
    for name in ("COBALD", "SYNTAGRUS", "TAIGA"):
        out = F.when(F.contains(up, F.lit(name)), name).otherwise(out)
    return out


def clean_stem(stem: Column) -> Column:
    for part in ("_full", "_adapted", "_clean"):
        stem = F.replace(stem, F.lit(part), F.lit(""))
    return stem


def cache_key(text: Column, fmt: str) -> Column:
    return F.sha2(F.concat(text, F.lit(f"_{fmt}")), 256)


def raw_url(user: str, repo: str, branch: str, path: str) -> str:
    return f"https://raw.githubusercontent.com/{user}/{repo}/{branch}/{path}"


def score_v1(depth: Column, crossing: Column, dialogue: Column, pronouns: Column, bonus: Column) -> Column:
    """1.5 (depth + 10 crossing) + 15 dialogue + 2 pronouns + 20 for the semantic corpus."""
    return (depth + 10 * crossing.cast("int")) * 1.5 + 15.0 * dialogue.cast("int") + 2.0 * pronouns + 20.0 * bonus.cast("int")


def score_v2(depth: Column, crossing: Column, dialogue: Column, pronouns: Column, verbs: Column, bonus: Column) -> Column:
    return score_v1(depth, crossing, dialogue, pronouns, bonus) + verbs


def softmax(energies: Column) -> Column:
    top = F.array_max(energies)
    e = F.transform(energies, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def match_label(gold_head: Column, head: Column, gold_rel: Column, rel: Column) -> Column:
    """``ok``, ``rel`` or ``head``: a wrong head outweighs a wrong relation."""
    return F.when(~gold_head.eqNullSafe(head), "head").when(~gold_rel.eqNullSafe(rel), "rel").otherwise("ok")
