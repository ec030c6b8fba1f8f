"""The workflows: corpus to profiles and samples, text to parses, audit of a slice, scores of models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lesograf.functions.scalars import dataset_name, let
from lesograf.operators import audit, metrics, profile, report, sampling, tokenize, validate
from lesograf.sources.conllu import clean_metadata, read_conllu, without_empty, words


def parsed_tokens(sentences: DataFrame) -> DataFrame:
    """Sentences of read_conllu with their words as parsed tokens, and a key for each."""
    t = F.transform(words(F.col("tokens")), lambda x: F.struct(x["word"].alias("id"), x["form"].alias("text"), x["lemma"].alias("lemma"), x["upos"].alias("pos"), x["feats"].alias("feats"), x["head_id"].alias("head_id"), x["deprel"].alias("rel"), F.lit(None).cast("int").alias("start_char"), F.lit(None).cast("int").alias("end_char")))
    return sentences.select(F.monotonically_increasing_id().alias("sent_key"), "file", F.element_at(F.split("file", "/"), -1).alias("source_file"), "ordinal", "sent_id", "text", t.alias("tokens"))


def corpus_to_profiles(spark: SparkSession, paths: dict[str, str], out: str, strict: bool = False) -> DataFrame:
    """corpus -> path: read, clean, validate, profile; written once as Parquet by corpus, then read.

    Samples and reports filter this table; no second pass over the text is needed."""
    parts = []
    for corpus, path in sorted(paths.items()):
        s = clean_metadata(read_conllu(spark, path).withColumn("tokens", without_empty(F.col("tokens"))), corpus)
        parts.append(parsed_tokens(s).withColumn("corpus", F.lit(corpus)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows.write.mode("overwrite").partitionBy("corpus").parquet(f"{out}/sentences")
    stored = spark.read.parquet(f"{out}/sentences")
    good, bad = validate.split_valid(stored, strict)
    bad.select("corpus", "source_file", "sent_id", F.array_join("errors", ";").alias("errors")).write.mode("overwrite").parquet(f"{out}/quarantine")
    key = ["corpus", "source_file", "sent_key"]
    good.select(*key, "ordinal", "sent_id", "text", "tokens", *_columns(good)).write.mode("overwrite").partitionBy("corpus").parquet(f"{out}/profiles")
    return spark.read.parquet(f"{out}/profiles")


def _columns(rows: DataFrame) -> list[Column]:
    t, x = F.col("tokens"), F.col("text")
    return [F.size(t).alias("length"), profile.depth_v1(t).alias("tree_depth"), profile.non_projective(t).alias("non_proj"), profile.dialogue_v1(x, t).alias("is_dialogue"), profile.depth_v3(t).alias("depth"), profile.count_pos(t, "PRON").alias("pronouns"), profile.count_pos(t, "VERB").alias("verbs")]


def samples(profiles: DataFrame, dialogues: int = 1000, complex_: int = 500, baseline: int = 1000) -> dict[str, DataFrame]:
    """The three samples of one profile table, in file order."""
    order = ["source_file", "ordinal"]
    return {
        "dialogues": sampling.top_k(profiles.where("is_dialogue"), ["length"], dialogues).orderBy(*order),
        "complex": sampling.top_k(profiles, ["non_proj", "tree_depth"], complex_).orderBy(*order),
        "baseline": sampling.hash_sample(profiles, baseline).orderBy(*order),
    }


def process(documents: DataFrame, parse: Callable[[Column], Column] | None = None, key: str = "doc_id") -> DataFrame:
    """Text to sentences with tokens and spans; ``parse`` maps the tokens (an Arrow function or an
    expression) to head_id and rel, which are merged by place. Without one the trivial heads are taken."""
    s = tokenize.sentences_with_spans(documents, key)
    if parse is not None:
        return s.withColumn("tokens", _merged(F.col("tokens"), parse(F.col("tokens"))))
    untagged = lambda t: F.transform(t, lambda x: F.struct(x["id"].alias("id"), F.lit(None).cast("string").alias("pos")))
    return s.withColumn("tokens", let(F.col("tokens"), lambda t: let(untagged(t), lambda u: _merged(t, tokenize.trivial_heads(u)))))


def _merged(tokens: Column, heads: Column) -> Column:
    pairs = F.zip_with(tokens, heads, lambda t, h: F.struct(t["id"].alias("id"), t["text"].alias("text"), h["head_id"].alias("head_id"), F.coalesce(h["rel"], F.lit("_")).alias("rel"), t["start_char"].alias("start_char"), t["end_char"].alias("end_char")))
    return F.filter(pairs, lambda t: t["text"].isNotNull())


def audit_slice(sentences: DataFrame, metadata: DataFrame, query: str, limit: int, models: list[str]) -> dict[str, DataFrame]:
    """Sentences that fulfil a query, at most ``limit`` of them by hash, audited: errors and tables."""
    kept = sampling.hash_sample(sampling.where_query(metadata, query), limit).select("sent_key")
    s = sentences.join(kept, "sent_key", "left_semi").where("text <> '' AND tokens IS NOT NULL")
    rows = s.select(dataset_name(F.col("source_file")).alias("dataset"), "sent_id", "text", F.transform("tokens", lambda t: t["text"]).alias("gold"), tokenize.run_models(F.col("text"), models).alias("models"))
    errors = audit.audit(rows)
    return {"errors": errors, "by_dataset": audit.crosstab(errors, "model", "dataset"), "by_type": audit.crosstab(errors, "model", "error_type"), "top": audit.top_errors(errors)}


def benchmark(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Scores of every model at once: ``predictions`` (model, sent_key, id, head_id, rel)."""
    p = predictions.select("model", "sent_key", "id", F.col("head_id").alias("p_head"), F.col("rel").alias("p_rel"))
    models = p.select("model").distinct()
    every = gold.select("sent_key", "id", "head_id", "rel").withColumn("model", F.explode(F.array_sort(F.array(*(F.lit(r["model"]) for r in models.collect()))))) if models.count() else gold.limit(0).withColumn("model", F.lit(""))
    rows = every.join(p, ["model", "sent_key", "id"], "left")
    head = F.coalesce(F.col("head_id") == F.col("p_head"), F.lit(False))
    per = rows.groupBy("model", "sent_key").agg(F.count(F.lit(1)).alias("n"), F.count_if(head).alias("u"), F.count_if(head & F.coalesce(F.col("rel") == F.col("p_rel"), F.lit(False))).alias("l"))
    return per.groupBy("model").agg(F.sum("n").alias("words"), metrics.ratio(F.sum("u"), F.sum("n")).alias("uas"), metrics.ratio(F.sum("l"), F.sum("n")).alias("las"), F.avg(F.col("u") / F.col("n")).alias("macro_uas"), F.avg(F.col("l") / F.col("n")).alias("macro_las"))


def corpus_report(profiles: DataFrame) -> str:
    """Counts and lengths by corpus as Markdown."""
    return report.markdown(report.describe(profiles, "length", "corpus").orderBy("corpus"))
