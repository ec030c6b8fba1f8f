"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

Every source is allotted its target share as far as its tokens and max_repeats allow; what a source
can't give goes to the others in proportion to their targets. Cells of source, language and topic are
then raked, so that the sources meet their allotments while languages and topics keep the shares
that the collection has. A document is taken as often as its cell's weight says: whole repeats, and
one more if its hash falls below the rest; a threshold per source, read from a histogram of these
hashes, brings the source's tokens up to the allotment, and documents picked by size fill what is left.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lesograf.llm.langid import label_code
from lesograf.llm.tokencount import VOCABULARY, numbered, token_counts
from lesograf.sources.tables import settle

TOPICS = 64  # cells that topics are hashed to: a bound whatever genre holds
BINS = 4000
RAKINGS = 60
REACH = 0.9  # the default size lets sources with so much of the target weight reach their shares


def source_key(source: Column) -> Column:
    """One spelling of a source: lower case, outer blanks gone, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), "[\\s-]+", "_")


def allot(available: dict[str, float], share: dict[str, float], repeats: dict[str, int], total: float) -> dict[str, float]:
    """Tokens of every source: min(cap, level x share), the level such that they add up to ``total``
    (or to all caps, where these are less)."""
    cap = {s: available.get(s, 0.0) * repeats[s] for s in share}
    goal = min(total, sum(cap.values()))
    open_, out = {s for s in share if cap[s] > 0 and share[s] > 0}, {s: 0.0 for s in share}
    left = goal
    while open_:
        weight = sum(share[s] for s in open_)
        capped = {s for s in open_ if left * share[s] / weight >= cap[s] - 1e-9}
        if not capped:
            out |= {s: left * share[s] / weight for s in open_}
            break
        for s in capped:
            out[s] = cap[s]
            left -= cap[s]
        open_ -= capped
    return out


def reachable(available: dict[str, float], share: dict[str, float], repeats: dict[str, int], reach: float = REACH) -> float:
    """Greatest total at which sources with ``reach`` of the weight of all sources that have any tokens
    keep the proportions of their targets; the others give what they have."""
    cap = {s: available.get(s, 0.0) * repeats[s] for s in share}
    there = {s: w for s, w in share.items() if w > 0 and cap[s] > 0}
    short = 0.0
    for level, weight in sorted((cap[s] / w, w) for s, w in there.items()):
        short += weight
        if short > (1 - reach) * sum(there.values()) + 1e-9:
            return sum(min(cap[s], level * w) for s, w in there.items())
    return 0.0


def fill(left: float, sizes: list[int]) -> list[int]:
    """Sizes, each taken once, that together fill ``left`` as far as the greatest that still fits does."""
    out = []
    for n in sorted(sizes, reverse=True):
        if 0 < n <= left:
            out.append(n)
            left -= n
    return out


def rake(cells: list[tuple[str, str, int]], tokens: np.ndarray, allotted: dict[str, float], repeats: dict[str, int]) -> np.ndarray:
    """Weight of every cell (copies of each of its documents), at most max_repeats."""
    if not len(cells):
        return np.zeros(0)
    limit = np.array([repeats.get(s, 0) for s, _, _ in cells], float)
    axes = []
    for k in range(3):
        names = sorted({c[k] for c in cells}, key=str)
        axes.append(np.array([names.index(c[k]) for c in cells]))
    names = sorted({c[0] for c in cells})
    goal = np.array([allotted.get(s, 0.0) for s in names])
    share = [np.bincount(a, weights=tokens) / max(1.0, tokens.sum()) for a in axes]
    weight = np.minimum(1.0, limit)
    for _ in range(RAKINGS):
        for k in (1, 2):
            now = np.bincount(axes[k], weights=weight * tokens)
            factor = np.divide(share[k] * goal.sum(), now, out=np.ones_like(now), where=now > 0)
            weight = np.minimum(weight * factor[axes[k]], limit)
        for _ in range(8):  # what the caps cut off goes to the source's other cells
            now = np.bincount(axes[0], weights=weight * tokens)
            factor = np.divide(goal, now, out=np.ones_like(now), where=now > 0)
            if np.allclose(factor[now > 0], 1.0, atol=1e-6):
                break
            weight = np.minimum(weight * factor[axes[0]], limit)
    return weight


def _prepared(documents: DataFrame, targets: DataFrame, vocabulary: str) -> tuple[DataFrame, list]:
    rows = targets.where("source IS NOT NULL").select("source", source_key(F.col("source")).alias("key"), "target_share", "max_repeats").collect()  # a row a source, fixed
    keep = sorted({r["key"] for r in rows})
    sizes = token_counts(documents, "lang", "source", "genre", vocabulary=vocabulary)
    sizes = numbered(sizes).withColumn("key", source_key(F.col("source")))
    sizes = sizes.withColumn("language", F.coalesce(label_code("lang"), F.lit("und"))).withColumn("topic", F.when(F.col("genre").isNull(), -1).otherwise(F.pmod(F.xxhash64(F.lower(F.trim("genre"))), F.lit(TOPICS)).cast("int")))
    return settle(sizes.where(F.col("key").isin(keep)).select("row", "doc_id", "key", "language", "topic", "tokens")), rows


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(documents, shares).

    documents: ``doc_id, source, tokens, copies`` of those taken at least once. shares: ``source,
    target_share, max_repeats, available, allotted, tokens, share, documents, copies`` of every
    target, absent sources with zeros. ``total`` is the size of the collection in tokens, by default
    what ``reachable`` gives: more would dilute the shares, less would waste documents. Sources are compared
    in one spelling; documents without source, or of a source without target, are left out; a NULL share
    or repeat counts as 0. A source's tokens never exceed its allotment by more than rounding, unless the
    whole repeats that its cells' weights demand do.
    """
    spark = documents.sparkSession
    sizes, rows = _prepared(documents, targets, vocabulary)
    share, repeats, name = {}, {}, {}
    for r in rows:
        k = r["key"]
        share[k], repeats[k], name[k] = share.get(k, 0.0) + float(r["target_share"] or 0.0), max(repeats.get(k, 0), int(r["max_repeats"] or 0)), r["source"]
    # sources x languages x TOPICS rows at most
    table = sizes.groupBy("key", "language", "topic").agg(F.sum("tokens").alias("tokens")).orderBy("key", "language", "topic").collect()
    cells = [(r["key"], r["language"], r["topic"]) for r in table]
    tokens = np.array([r["tokens"] for r in table], float)
    available: dict[str, float] = {}
    for (s, _, _), n in zip(cells, tokens):
        available[s] = available.get(s, 0.0) + n
    allotted = allot(available, share, repeats, float(total) if total is not None else reachable(available, share, repeats))
    weight = rake(cells, tokens, allotted, repeats)
    weights = spark.createDataFrame([(*c, float(w)) for c, w in zip(cells, weight)], "key string, language string, topic int, weight double")
    draw = (F.pmod(F.xxhash64("doc_id", "row"), F.lit(1 << 40)) / float(1 << 40)).alias("draw")
    placed = sizes.select("*", draw).join(F.broadcast(weights), ["key", "language", "topic"])
    limit = F.create_map(*(F.lit(x) for k in sorted(repeats) for x in (k, repeats[k])))[F.col("key")] if repeats else F.lit(0)
    placed = placed.withColumn("base", F.floor("weight").cast("int")).withColumn("over", F.col("draw") - (F.col("weight") - F.floor("weight"))).withColumn("limit", limit)
    # tokens of one more copy by the bin of draw - rest: a threshold per source meets its allotment
    # copies beyond the limit are no copies
    at = F.floor((F.col("over") + 1) * (BINS / 2)).cast("int")
    spare = F.when(F.col("base") < F.col("limit"), F.col("tokens")).otherwise(0)
    bins = placed.groupBy("key", at.alias("bin")).agg(F.sum(spare).alias("tokens"), F.sum(F.col("base") * F.col("tokens")).alias("sure")).collect()  # sources x BINS rows at most
    edge, left = {}, {}
    for s in available:
        own = sorted((r["bin"], r["tokens"]) for r in bins if r["key"] == s)
        taken, edge[s] = sum(r["sure"] for r in bins if r["key"] == s), 0
        for b, n in own:
            if taken + n > allotted.get(s, 0.0) + 0.5:
                break
            taken, edge[s] = taken + n, b + 1
        left[s] = allotted.get(s, 0.0) + 0.5 - taken
    lookup = lambda d: F.create_map(*(F.lit(x) for k in sorted(d) for x in (k, d[k])))[F.col("key")] if d else F.lit(0)
    below, more = at < lookup(edge), F.col("base") < F.col("limit")
    # what is left of an allotment is filled by documents beyond the edge, one of each size: sources x sizes rows
    spares = placed.where(~below & more & (F.col("tokens") > 0) & (F.col("tokens") <= lookup(left))).groupBy("key", "tokens").agg(F.min_by("row", F.struct("over", "row")).alias("row")).collect()
    by_source: dict[str, dict[int, int]] = {}
    for r in spares:
        by_source.setdefault(r["key"], {})[r["tokens"]] = r["row"]
    extra = [(d[n],) for k, d in sorted(by_source.items()) for n in fill(left[k], list(d))]
    extra_rows = spark.createDataFrame(extra, "row bigint").withColumn("extra", F.lit(1))
    placed = placed.join(F.broadcast(extra_rows), "row", "left")
    copies = F.col("base") + F.when(below & more, 1).otherwise(0) + F.coalesce("extra", F.lit(0))
    spelling = F.create_map(*(F.lit(x) for k in sorted(name) for x in (k, name[k])))[F.col("key")] if name else F.col("key")
    taken = settle(placed.select("doc_id", spelling.alias("source"), "tokens", copies.cast("int").alias("copies")).where("copies > 0"))
    sums = taken.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"))
    goals = spark.createDataFrame([(name[k], share[k], repeats[k], int(available.get(k, 0)), float(allotted[k])) for k in sorted(share)], "source string, target_share double, max_repeats int, available bigint, allotted double")
    whole = taken.agg(F.coalesce(F.sum(F.col("tokens") * F.col("copies")), F.lit(0)))
    counted = goals.join(sums, "source", "left").fillna(0, ["tokens", "documents", "copies"])
    shares = counted.withColumn("share", F.col("tokens") / F.nullif(whole.scalar(), F.lit(0))).select("source", "target_share", "max_repeats", "available", "allotted", "tokens", "share", "documents", "copies")
    return taken, shares
