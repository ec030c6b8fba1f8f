"""Alignment of two tokenizations of one text by character spans, all within the sentence's row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lesograf.functions.scalars import coverage, iou, let
from lesograf.schema import ALIGNMENT, GROUP, SPAN


def covering_spans(text: Column, pattern: str, blank: str = "\\s+") -> Column:
    """Spans of the matches of ``pattern``, numbered from 1: the text is cut into matches, blanks and
    single other characters, whose lengths add up to the offsets."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)({blank}|{pattern}|.)"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out"))

    def step(a: Column, p: Column) -> Column:
        end = a["at"] + F.length(p)
        span = F.struct((F.size(a["out"]) + 1).alias("id"), a["at"].alias("start_char"), end.alias("end_char"))
        return F.struct(end.alias("at"), F.when(p.rlike(f"^(?s:{pattern})$"), F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda a: a["out"])


def reconstruct_offsets(text: Column, forms: Column) -> Column:
    """Span of each form, searched left to right from where the last one ended; (-1, -1) where it isn't."""
    start = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<struct<start_char:int,end_char:int>>)").alias("out"))

    def step(a: Column, f: Column) -> Column:
        found = F.call_function("locate", f, text, a["at"])
        hit = F.coalesce(found > 0, F.lit(False))
        span = F.struct(F.when(hit, found - 1).otherwise(-1).alias("start_char"), F.when(hit, found - 1 + F.length(f)).otherwise(-1).alias("end_char"))
        return F.struct(F.when(hit, found + F.length(f)).otherwise(a["at"]).alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    return F.aggregate(forms, start, step, lambda a: a["out"])


def align_best(sys: Column, gold: Column) -> Column:
    """For every system token the gold token of greatest IoU, the earliest of several; ``exact`` above
    0.9, else ``partial``; ``none`` without overlap. Gold tokens may be taken several times."""

    def best(s: Column, gold: Column) -> Column:
        near = F.filter(gold, lambda g: (g["start_char"] < s["end_char"]) & (g["end_char"] > s["start_char"]))
        scored = F.transform(near, lambda g, i: F.struct(iou(s["start_char"], s["end_char"], g["start_char"], g["end_char"]).alias("iou"), (-i).alias("i"), g["id"].alias("gold_id")))
        return let(F.array_max(scored), lambda top: F.struct(s["id"].alias("sys_id"), top["gold_id"].alias("gold_id"), F.coalesce(top["iou"], F.lit(0.0)).alias("iou"), F.when(top.isNull(), "none").when(top["iou"] > 0.9, "exact").otherwise("partial").alias("type")).cast(ALIGNMENT))

    return let(gold, lambda g: let(sys, lambda s: F.transform(s, lambda x: best(x, g))))


def align_window(gold: Column, sys: Column, reach: int = 5) -> Column:
    """For every gold token the system token that covers more than half of it, among those within
    ``reach`` of the last match: ``gold_id, sys_index`` (0-based, NULL without match)."""
    start = F.struct(F.lit(0).alias("cursor"), F.expr("cast(array() as array<struct<gold_id:int,sys_index:int>>)").alias("out"))
    numbered = F.transform(sys, lambda s, i: F.struct(i.alias("i"), s["start_char"].alias("a"), s["end_char"].alias("b")))

    def step(numbered: Column, a: Column, g: Column) -> Column:
        low = F.greatest(a["cursor"] - reach, F.lit(0))
        near = F.slice(numbered, low + 1, F.greatest(a["cursor"] + reach - low, F.lit(0)))
        scored = F.transform(near, lambda s: F.struct(coverage(g["start_char"], g["end_char"], s["a"], s["b"]).alias("c"), (-s["i"]).alias("i")))
        best = F.array_max(F.filter(scored, lambda s: s["c"] > 0.5))
        return let(best, lambda top: F.struct(F.coalesce(-top["i"], a["cursor"]).alias("cursor"), F.concat(a["out"], F.array(F.struct(g["id"].alias("gold_id"), (-top["i"]).alias("sys_index")))).alias("out")))

    return let(numbered, lambda n: F.aggregate(gold, start, lambda a, g: step(n, a, g), lambda a: a["out"]))


def match_type(n_sys: Column, n_gold: Column) -> Column:
    return F.when((n_sys == 1) & (n_gold == 1), "exact").when((n_sys == 1) & (n_gold > 1), "split").when((n_sys > 1) & (n_gold == 1), "merge").when((n_sys > 1) & (n_gold > 1), "complex").otherwise("error")


def align_groups(sys: Column, gold: Column, threshold: float = 0.1) -> Column:
    """Connected components of the pairs with IoU above the threshold, and every other token alone as
    ``error``. Spans run left to right, so an edge that shares no end with the last group opens a new one."""
    spans = F.transform(gold, lambda g, j: F.struct(j.alias("j"), g["start_char"].alias("a"), g["end_char"].alias("b")))
    edges = let(spans, lambda gs: F.flatten(F.transform(sys, lambda s, i: F.transform(F.filter(gs, lambda g: iou(s["start_char"], s["end_char"], g["a"], g["b"]) > threshold), lambda e: F.struct(i.alias("s"), e["j"].alias("g"))))))
    pair = "struct<s:array<int>,g:array<int>>"

    def step(acc: Column, e: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joins = F.coalesce(F.array_contains(last["s"], e["s"]) | F.array_contains(last["g"], e["g"]), F.lit(False))
        merged = F.struct(F.array_union(last["s"], F.array(e["s"])).alias("s"), F.array_union(last["g"], F.array(e["g"])).alias("g"))
        alone = F.struct(F.array(e["s"]).alias("s"), F.array(e["g"]).alias("g"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(acc, F.array(alone)))

    none = F.expr("cast(array() as array<int>)")

    def whole(groups: Column) -> Column:
        rest_s = F.array_except(F.transform(sys, lambda _, i: i), F.flatten(F.transform(groups, lambda x: x["s"])))
        rest_g = F.array_except(F.transform(gold, lambda _, i: i), F.flatten(F.transform(groups, lambda x: x["g"])))
        every = F.concat(groups, F.transform(rest_s, lambda i: F.struct(F.array(i).alias("s"), none.alias("g"))), F.transform(rest_g, lambda j: F.struct(none.alias("s"), F.array(j).alias("g"))))
        return F.transform(every, lambda x: F.struct(F.array_sort(x["s"]).alias("sys_indices"), F.array_sort(x["g"]).alias("gold_indices"), match_type(F.size(x["s"]), F.size(x["g"])).alias("type")).cast(GROUP))

    return let(F.aggregate(edges, F.expr(f"cast(array() as array<{pair}>)"), step), whole)


def merge_pieces(words: Column, pieces: Column) -> Column:
    """Detokenization: for every word the indices (0-based) of the pieces whose letters it holds.

    Pieces are taken greedily until they are as long as the word."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<int>>)").alias("out"))
    lengths = F.transform(pieces, lambda p: F.length(p))

    def step(a: Column, w: Column) -> Column:
        rest = F.slice(lengths, a["at"] + 1, F.greatest(F.size(lengths) - a["at"], F.lit(0)))
        grow = F.aggregate(rest, F.struct(F.lit(0).alias("n"), F.lit(0).alias("len")), lambda b, x: F.when(b["len"] < F.length(w), F.struct((b["n"] + 1).alias("n"), (b["len"] + x).alias("len"))).otherwise(b))
        took = F.when(grow["n"] > 0, F.sequence(a["at"], a["at"] + grow["n"] - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.struct((a["at"] + grow["n"]).alias("at"), F.concat(a["out"], F.array(took)).alias("out"))

    return F.aggregate(words, start, step, lambda a: a["out"])


def merge_parsed(words: Column, parsed: Column) -> Column:
    """Parsed pieces put together to words: each word takes lemma, tag, head and relation of its first piece.

    ``parsed``: structs (text, lemma, pos, head_id, rel) whose heads count pieces from 1. A head becomes
    the word that holds that piece, 0 where no word does; a word that would hang on itself gets the
    relation ``flat:merged``. Words without pieces are left out, the others keep their numbers."""
    texts = F.transform(parsed, lambda p: F.coalesce(p["text"], F.lit("")))

    def whole(w: Column, p: Column, groups: Column) -> Column:
        holder = lambda k: F.coalesce(F.array_position(F.transform(groups, lambda g: F.array_contains(g, k)), True), F.lit(0)).cast("int")

        def one(g: Column, i: Column) -> Column:
            first = F.get(p, F.get(g, F.lit(0)))
            head = F.when(F.coalesce(first["head_id"], F.lit(0)) == 0, 0).otherwise(holder(first["head_id"] - 1))
            return let(head, lambda h: F.struct((i + 1).alias("id"), F.get(w, i).alias("text"), first["lemma"].alias("lemma"), first["pos"].alias("pos"), h.alias("head_id"), F.when(h == i + 1, "flat:merged").otherwise(first["rel"]).alias("rel"), F.size(g).alias("n")))

        return F.filter(F.transform(groups, one), lambda x: x["n"] > 0)

    return let(words, lambda w: let(parsed, lambda p: let(merge_pieces(w, texts), lambda g: whole(w, p, g))))
