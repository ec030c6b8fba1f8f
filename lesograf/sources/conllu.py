"""Treebank files: blocks of lines separated by blank lines, 10 or 12 tab-separated columns.

A block is one row of a splittable text source; its lines are parsed by array functions in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lesograf.functions.scalars import falsy, head_digits, id_kind
from lesograf.schema import COLUMNS, LINE, PROFILE


def _lines(block: Column) -> Column:
    return F.filter(F.split(F.replace(block, F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(x) != "")


def metadata(block: Column) -> Column:
    """``# key = value`` lines as a map; of a repeated key the last stays, a key without value is NULL."""
    rows = F.filter(_lines(block), lambda x: x.startswith("#"))
    pairs = F.transform(rows, lambda x: F.struct(F.trim(F.regexp_extract(x, "(?s)^#\\s*([^=]*)", 1)).alias("key"), F.nullif(F.regexp_extract(x, "(?s)^#[^=]*=\\s*(.*?)\\s*$", 1), F.lit("")).alias("value")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]))


def fold(columns: Column) -> Column:
    """12 columns to 10: columns 11 and on go to MISC as ``Sem=a|b``."""
    extra = F.array_join(F.slice(columns, F.lit(11), F.greatest(F.size(columns) - 10, F.lit(0))), "|")
    misc = F.get(columns, F.lit(9))
    folded = F.concat(F.slice(columns, 1, 9), F.array(F.concat(F.when((misc != "_") & (misc != ""), F.concat(misc, F.lit("|"))).otherwise(F.lit("")), F.lit("Sem="), extra)))
    return F.when(F.size(columns) > 10, folded).otherwise(columns)


def parse_lines(block: Column, least: int = 10) -> Column:
    """Lines with at least ``least`` columns as structs of LINE; others are left out. ``_`` is NULL
    where it stands for nothing (lemma, tags, feats, head, relation, deps, misc), not as a form."""
    rows = F.transform(F.filter(_lines(block), lambda x: ~x.startswith("#")), lambda x: fold(F.split(x, "\t")))
    rows = F.filter(rows, lambda c: F.size(c) >= least)

    def line(c: Column) -> Column:
        raw = [F.get(c, F.lit(i)) if n in ("id", "form") else F.nullif(F.get(c, F.lit(i)), F.lit("_")) for i, n in enumerate(COLUMNS)]
        kind = id_kind(raw[0])
        return F.struct(*(v.alias(n) for v, n in zip(raw, COLUMNS)), kind.alias("kind"), F.when(kind == "word", raw[0].try_cast("int")).alias("word"), raw[6].try_cast("int").alias("head_id")).cast(LINE)

    return F.transform(rows, line)


def read_blocks(spark: SparkSession, path: str | list[str], crlf: bool = False, recursive: bool = False) -> DataFrame:
    """``file, ordinal, block``: one row a non-empty block; ``ordinal`` follows the order in the file.

    The last block counts with or without a blank line after it. ``crlf`` for files with CRLF ends."""
    sep = "\r\n\r\n" if crlf else "\n\n"
    reader = spark.read.option("lineSep", sep).option("recursiveFileLookup", str(recursive).lower())
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("block"))
    return raw.where(F.trim(F.regexp_replace("block", "[\\s]+", " ")) != "").select("file", F.struct("_start", "_at").alias("ordinal"), "block")


def read_conllu(spark: SparkSession, path: str | list[str], least: int = 10, crlf: bool = False, recursive: bool = False) -> DataFrame:
    """``file, ordinal, sent_id, text, meta, tokens`` of every block with a token line or a comment."""
    b = read_blocks(spark, path, crlf, recursive)
    s = b.select("file", "ordinal", metadata(F.col("block")).alias("meta"), parse_lines(F.col("block"), least).alias("tokens"))
    return s.select("file", "ordinal", F.col("meta")["sent_id"].alias("sent_id"), F.col("meta")["text"].alias("text"), "meta", "tokens")


def words(tokens: Column) -> Column:
    """The words among the lines: ranges and empty nodes dropped."""
    return F.filter(tokens, lambda t: t["kind"] == "word")


def without_empty(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t["kind"] != "empty")


def clean_metadata(sentences: DataFrame, prefix: str) -> DataFrame:
    """Only text and a new id ``prefix_oldid`` stay of the metadata."""
    return sentences.withColumn("sent_id", F.concat_ws("_", F.lit(prefix), F.coalesce("sent_id", F.lit("unknown")))).drop("meta")


def simple_v1(block: Column) -> Column:
    """Word forms with head and relation, the first simple reading: ids with ``-`` or ``_`` and rows whose
    id or head is no number are skipped."""
    t = F.filter(parse_lines(block, 7), lambda x: ~x["id"].rlike("[-_]") & x["id"].try_cast("int").isNotNull() & x["head_id"].isNotNull())
    return F.transform(t, lambda x: F.struct(x["word"].alias("id"), x["form"].alias("form"), x["head_id"].alias("head_id"), x["deprel"].alias("rel")))


def simple_v2(block: Column) -> Column:
    """The second one: ids with ``-`` or ``.`` are skipped, rows with a bad number as well."""
    t = F.filter(parse_lines(block, 8), lambda x: ~x["id"].rlike("[-.]") & x["id"].try_cast("int").isNotNull() & x["head_id"].isNotNull())
    return F.transform(t, lambda x: F.struct(x["word"].alias("id"), x["form"].alias("form"), x["head_id"].alias("head_id"), x["deprel"].alias("rel")))


def parser_output(block: Column) -> Column:
    """A parser's output: words only, a head that is no number is 0, all ten columns."""
    t = F.filter(parse_lines(block, 10), lambda x: ~x["id"].rlike("[-.]"))
    return F.transform(t, lambda x: F.struct(x["word"].alias("id"), x["form"].alias("text"), x["lemma"].alias("lemma"), x["upos"].alias("pos"), x["feats"].alias("feats"), head_digits(F.coalesce(x["head"], F.lit("_"))).alias("head_id"), x["deprel"].alias("rel")))


def texts(sentences: DataFrame, limit: int | None = None) -> DataFrame:
    """The ``# text`` values in file order, the first ``limit`` of them."""
    t = sentences.where("text IS NOT NULL").orderBy("file", "ordinal").select("text")
    return t if limit is None else t.limit(limit)


def with_metrics(sentences: DataFrame) -> DataFrame:
    """``sent_id, genre, text`` and the profile in the ``metrics`` JSON; broken JSON gives NULLs."""
    m = F.from_json(F.col("meta")["metrics"], PROFILE)
    sid = falsy(F.col("meta")["sent_id_new"], F.col("meta")["sent_id"])
    return sentences.select("file", "ordinal", sid.alias("sent_id"), F.coalesce(F.col("meta")["genre"], F.lit("unknown")).alias("genre"), F.coalesce("text", F.lit("")).alias("text"), m.alias("m")).select("file", "ordinal", "sent_id", "genre", "text", "m.*")
