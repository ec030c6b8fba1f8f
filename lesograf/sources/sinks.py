"""Sinks: treebank text, JSON, CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lesograf.functions.scalars import falsy


def cell(value: Column) -> Column:
    """One cell of a line: tabs and line breaks, which would end it, as blanks."""
    return F.translate(value.cast("string"), "\t\n\r", "   ")


def line(*values: Column) -> Column:
    return F.concat_ws("\t", *(falsy(cell(v), "_") for v in values))


def conllu_block(meta: Column, tokens: Column) -> Column:
    """Comments and ten columns a line, from a map and LINE structs; without the blank line after it."""
    comments = F.transform(F.map_entries(meta), lambda e: F.concat(F.lit("# "), e["key"], F.coalesce(F.concat(F.lit(" = "), e["value"]), F.lit(""))))
    rows = F.transform(tokens, lambda t: line(*(t[c] for c in ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"))))
    return F.array_join(F.concat(comments, rows), "\n")


def parsed_block(text: Column, tokens: Column) -> Column:
    """Treebank text of parsed tokens (TOKEN structs)."""
    rows = F.transform(tokens, lambda t: line(t["id"], t["text"], t["lemma"], t["pos"], F.lit(None), t["feats"], t["head_id"], t["rel"], F.lit(None), F.lit(None)))
    return F.array_join(F.concat(F.array(F.concat(F.lit("# text = "), F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))), rows), "\n")


def wide_block(text: Column, tokens: Column) -> Column:
    """Twelve columns: deps ``head:rel`` joined by ``|``, then slot and class; missing ones are empty."""

    def row(t: Column) -> Column:
        deps = F.array_join(F.transform(t["deps"], lambda d: F.concat_ws(":", d["head"], d["rel"])), "|")
        cells = [t[c] for c in ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel")]
        return F.concat_ws("\t", *(F.coalesce(c.cast("string"), F.lit("")) for c in (*cells, deps, t["misc"], t["deepslot"], t["semclass"])))

    return F.array_join(F.concat(F.array(F.concat(F.lit("# text = "), text)), F.transform(tokens, row)), "\n")


def semantic_misc(misc: Column, deepslot: Column, semclass: Column) -> Column:
    """MISC with slot and class; ``_`` if all are missing."""
    part = lambda k, v: F.concat(F.lit(f"{k}="), F.nullif(v, F.lit("")))
    return falsy(F.concat_ws("|", F.nullif(F.nullif(misc, F.lit("")), F.lit("_")), part("Deepslot", deepslot), part("Semclass", semclass)), "_")


def write_conllu(blocks: DataFrame, path: str, column: str = "block", mode: str = "error") -> None:
    """One block a record, a blank line after each."""
    blocks.select(F.col(column).alias("value")).write.mode(mode).option("lineSep", "\n\n").text(path)


def write_json(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).json(path)


def write_csv(rows: DataFrame, path: str, *by: str, mode: str = "error") -> None:
    w = rows.write.mode(mode).option("header", True)
    (w.partitionBy(*by) if by else w).csv(path)
