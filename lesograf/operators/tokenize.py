"""Rule-based segmentation, the registry of tokenizers, and space marks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lesograf.functions.scalars import let
from lesograf.operators.align import covering_spans

#: Patterns of the shipped tokenizers; a blank is Unicode's everywhere.
WORDS = "[\\p{L}\\p{M}]+(?:-[\\p{L}\\p{M}]+)*|\\p{N}+|[^\\s\\p{Z}\\p{L}\\p{M}\\p{N}]"
PLAIN = "[\\p{L}\\p{M}]+|\\p{N}+|[^\\s\\p{L}\\p{M}\\p{N}]"
_REGISTRY: dict[str, Callable[[Column], Column]] = {
    "words": lambda text: F.regexp_extract_all(text, F.lit(f"({WORDS})"), F.lit(1)),
    "plain": lambda text: F.regexp_extract_all(text, F.lit(f"({PLAIN})"), F.lit(1)),
    "blanks": lambda text: F.regexp_extract_all(text, F.lit("(\\S+)"), F.lit(1)),
}


def register(name: str, tokenizer: Callable[[Column], Column]) -> None:
    """Add a tokenizer: a Column of texts to a Column of array<string>; an Arrow function fits as well."""
    _REGISTRY[name] = tokenizer


def tokenizer(name: str) -> Callable[[Column], Column] | None:
    """The registered tokenizer, None if it isn't available."""
    return _REGISTRY.get(name)


def run_models(text: Column, names: list[str]) -> Column:
    """map of tokenizer -> tokens; one that isn't available gives NULL."""
    none = F.lit(None).cast("array<string>")
    return F.create_map(*(x for n in names for x in (F.lit(n), (_REGISTRY[n](text) if n in _REGISTRY else none))))


def token_spans(text: Column, pattern: str = PLAIN) -> Column:
    return covering_spans(text, pattern)


def split_sentences(text: Column) -> Column:
    """Sentences of plain text: cut after end marks before a blank and a capital, a digit or a mark."""
    marked = F.regexp_replace(text, "([.!?…]+[»”\")]*)\\s+(?=[«“\"(—–-]?\\s*[\\p{Lu}\\p{N}])", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def sentences_with_spans(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, sent, text, start_char, end_char, tokens`` with spans in the document; lines end sentences."""
    cut = F.regexp_replace("text", "([.!?…]+[»”\")]*)(\\s+)(?=[«“\"(—–-]?\\s*[\\p{Lu}\\p{N}])", "$1\u0001$2")
    cut = F.regexp_replace(cut, "(\\n+)", "\u0001$1")  # a line's end is a sentence's end
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,raw:string>>)").alias("out"))
    place = F.aggregate(F.split(cut, "\u0001"), start, lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), p.alias("raw")))).alias("out")), lambda a: a["out"])
    placed = documents.where("text IS NOT NULL").select(key, F.posexplode(place).alias("sent", "p"))
    lead = F.length(F.regexp_extract("p.raw", "^\\s*", 0))
    text = F.regexp_replace(F.regexp_replace("p.raw", "^\\s+", ""), "\\s+$", "")
    out = placed.select(key, "sent", text.alias("text"), (F.col("p.start") + lead).alias("start_char")).where("text <> ''")
    spans = let(F.col("text"), lambda x: F.transform(token_spans(x), lambda t: F.struct(t["id"].alias("id"), F.substring(x, t["start_char"] + 1, t["end_char"] - t["start_char"]).alias("text"), (F.col("start_char") + t["start_char"]).alias("start_char"), (F.col("start_char") + t["end_char"]).alias("end_char"))))
    return out.select(key, "sent", "text", "start_char", (F.col("start_char") + F.length("text")).alias("end_char"), spans.alias("tokens"))


def space_after(tokens: Column) -> Column:
    """``SpaceAfter=No`` for every token that the next one follows without a gap, else ``_``; the last ``_``."""
    return F.transform(tokens, lambda t, i: F.when(F.get(tokens, i + 1)["start_char"] == t["end_char"], "SpaceAfter=No").otherwise("_"))


def spaces_after(text: Column, tokens: Column) -> Column:
    """``SpaceAfter=No`` where nothing follows a token before the next, ``SpacesAfter='..'`` with the blanks
    quoted where more than one does, else ``_``; the last token ``_``. Line breaks, returns and tabs are
    written as escapes."""
    quoted = lambda g: F.concat(F.lit("SpacesAfter='"), F.replace(F.replace(F.replace(g, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t")), F.lit("'"))

    def mark(t: Column, i: Column) -> Column:
        after = F.get(tokens, i + 1)["start_char"]
        return F.when(after == t["end_char"], "SpaceAfter=No").when(after > t["end_char"] + 1, quoted(F.substring(text, t["end_char"] + 1, after - t["end_char"]))).otherwise("_")

    return F.transform(tokens, mark)


def simple_sentences(text: Column) -> Column:
    """The simplest reading: cut at runs of ``.!?``, blank parts dropped, words between blanks."""
    parts = F.filter(F.transform(F.split(text, "[.!?]+"), lambda p: F.regexp_replace(p, "^\\s+|\\s+$", "")), lambda p: p != "")
    return F.transform(parts, lambda p: F.split(p, "\\s+"))


def space_flags(tokens: Column) -> Column:
    """Whether a gap follows each token; the last False."""
    return F.transform(tokens, lambda t, i: F.coalesce(t["end_char"] < F.get(tokens, i + 1)["start_char"], F.lit(False)))


def glue_pieces(pieces: Column) -> Column:
    """Word pieces ``##x`` glued to the piece before."""
    none = F.expr("cast(array() as array<string>)")
    return F.aggregate(pieces, none, lambda a, p: F.when(p.startswith("##") & (F.size(a) > 0), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), F.substring(p, F.lit(3), F.length(p)))))).otherwise(F.concat(a, F.array(p))))


def drop_blank(tokens: Column) -> Column:
    """Blank tokens dropped, the others stripped and numbered from 1."""
    kept = F.filter(F.transform(tokens, lambda t: F.trim(t)), lambda t: t != "")
    return F.transform(kept, lambda t, i: F.struct((i + 1).alias("id"), t.alias("text")))


def trivial_heads(tokens: Column) -> Column:
    """Head and relation by rule: the first verb is the root, later tokens hang on it, earlier ones on 0."""
    first = F.coalesce(F.array_position(F.transform(tokens, lambda t: F.coalesce(t["pos"].isin("VERB", "INFN"), F.lit(False))), True), F.lit(0)).cast("int")
    return let(first, lambda verb: F.transform(tokens, lambda t, i: F.struct((i + 1).alias("id"), F.when((verb > 0) & (i + 1 > verb), verb).otherwise(0).alias("head_id"), F.when((verb > 0) & (i + 1 > verb), "dep").otherwise("root").alias("rel"))))


def cached(rows: DataFrame, cache: DataFrame, run: Callable[[DataFrame], DataFrame], key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(results of all rows, new entries): keys that the cache lacks are run, the others taken from it."""
    new = run(rows.join(cache.select(key), key, "left_anti"))
    return rows.select(key).join(cache.unionByName(new), key), new
