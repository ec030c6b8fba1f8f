"""Filling windows of fixed capacity with documents: bound-certified repacking.

The documents are dealt to groups of about GROUP items by their row numbers, so that every group has
the same mix of sizes, and each group is packed by best fit decreasing. Dual feasible functions give
a lower bound on the windows that a group needs; where the bound is met the group is certified.
Groups with a gap give the documents of all windows that aren't full to a pool, certified groups those
of the few half-empty windows that the rounding up leaves; pools join the documents of several groups
and are packed again, and the new packing is kept where it takes fewer windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lesograf.llm.tokencount import VOCABULARY, numbered, token_counts
from lesograf.sources.tables import settle

CAPACITY = 2048
GROUP = 20_000  # items of a group
POOLED = 8  # groups whose emptiest windows meet in one pool
ROUNDS = 2
KEPT_FILL = 0.9  # windows filled so far are kept by a certified group; one with a gap keeps full ones only


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window number of each item; of equal room the window opened last is taken."""
    order = np.argsort(-sizes, kind="stable")
    window = np.zeros(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # windows by the room left
    mask, opened = 0, 0  # bit r is set where a window with room r is open
    for i in order.tolist():
        size = int(sizes[i])
        fit = mask >> size
        if fit:
            r = size + (fit & -fit).bit_length() - 1
            w = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            r, w, opened = capacity, opened, opened + 1
        window[i] = w
        if r > size:
            room[r - size].append(w)
            mask |= 1 << (r - size)
    return window


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Windows that items need at least; ``histogram[s]`` items have size s (0 < s <= capacity).

    The greatest value of three families of dual feasible functions: the sizes themselves; sizes with
    those below a threshold dropped and those above its complement rounded up to the capacity; and
    sizes rounded to k-ths of the capacity.
    """
    size = np.arange(len(histogram), dtype=np.int64)
    weight = histogram.astype(np.int64) * size
    best = -(-int(weight.sum()) // capacity)
    mass, number = np.cumsum(weight), np.cumsum(histogram)
    at = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - at]  # items above capacity - threshold
    middle = mass[capacity - at] - mass[at - 1]
    if len(at):
        best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, min(100, capacity)):
        scaled = (k + 1) * size
        share = np.where(scaled % capacity == 0, size * k / capacity, scaled // capacity)
        total = float((share * histogram).sum()) / k
        best = max(best, int(np.ceil(total - 1e-9)))
    return best


def _bound(sizes: np.ndarray, capacity: int) -> int:
    return lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)


_KIND = "row bigint, doc_id bigint, part int, tokens bigint, team bigint, window bigint, gap bigint"


def _whole(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    """The columns of some rows: those of one group, whose size is bounded."""
    names = ("row", "doc_id", "part", "tokens", "team", "window")
    held = [[b.column(n).to_numpy(zero_copy_only=False) for n in names if n in b.schema.names] for b in batches if b.num_rows]
    present = names if not held or len(held[0]) == len(names) else names[:-1]
    return {n: np.concatenate([h[i] for h in held]) for i, n in enumerate(present)} if held else {}


def _emit(c: dict[str, np.ndarray], window: np.ndarray, gap: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c["row"], pa.int64()), pa.array(c["doc_id"], pa.int64()), pa.array(c["part"].astype(np.int32)), pa.array(c["tokens"], pa.int64()), pa.array(c["team"], pa.int64()), pa.array(window, pa.int64()), pa.array(gap, pa.int64())], names=["row", "doc_id", "part", "tokens", "team", "window", "gap"])


def _teams(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of one team after the other; the rows come sorted by team, and one team is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        team = batch.column("team").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(team)) + 1).tolist(), len(team)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[-1].column("team")[0].as_py() != team[a]:
                yield _whole(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield _whole(held)


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _teams(batches):
            window = np.zeros(len(c["row"]), np.int64)
            at = np.lexsort((c["part"], c["row"]))
            window[at] = best_fit_decreasing(c["tokens"][at], capacity)
            gap = np.full(len(window), window.max() + 1 - _bound(c["tokens"], capacity))
            yield _emit(c, window + (c["team"] << 32), gap)

    return run


def _repack(capacity: int):
    """Windows of several groups packed anew; the old ones stay where that takes as few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _teams(batches):
            window = c["window"].copy()
            at = np.lexsort((c["part"], c["row"]))
            old = np.unique(window)
            new = best_fit_decreasing(c["tokens"][at], capacity)
            used = min(len(old), int(new.max()) + 1)
            if new.max() + 1 < len(old):
                window[at] = old[new]  # names of windows that these documents held before
            yield _emit(c, window, np.full(len(window), used - _bound(c["tokens"], capacity)))

    return run


def items(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """``row, doc_id, part, first, tokens``: a document, or its parts where it alone exceeds a window."""
    sizes = settle(numbered(token_counts(documents, vocabulary=vocabulary)))
    last = F.floor((F.col("tokens") - 1) / capacity).cast("int")
    rows = sizes.where("tokens > 0").select("row", "doc_id", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    return rows.select("row", "doc_id", "part", (F.col("part").cast("long") * capacity).alias("first"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("part").cast("long") * capacity).alias("tokens"))


def pack(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, part, first, tokens, window`` of every document with a token.

    ``part`` and ``first`` (its first token in the document) are 0 unless the document exceeds a
    window. Documents without tokens (NULL or empty text) take no window; repeated rows are items of
    their own. No window holds more than ``capacity`` tokens.
    """
    all_items = settle(items(documents, capacity, vocabulary))
    full = all_items.where(F.col("tokens") == capacity)
    rest = all_items.where(F.col("tokens") < capacity).select("row", "doc_id", "part", "tokens")
    groups = max(1, -(-rest.count() // GROUP))
    team = F.pmod(F.xxhash64("row", "part"), F.lit(groups))
    parts = min(groups, 10_000)
    packed = settle(rest.withColumn("team", team).repartition(parts, "team").sortWithinPartitions("team").mapInArrow(_pack(capacity), _KIND))
    done: list[DataFrame] = []
    for r in range(ROUNDS):
        if groups < 2:
            break
        fill = packed.groupBy("window").agg((F.sum("tokens") / capacity).alias("fill"))
        marked = settle(packed.join(fill, "window"))
        loose = (F.col("fill") < KEPT_FILL) | (F.col("gap") > 0) & (F.col("fill") < 1)
        done.append(marked.where(~loose).drop("fill"))
        groups = max(1, -(-groups // POOLED))
        # a group's loose windows go to one pool together
        pool = F.pmod(F.xxhash64(F.shiftright("window", 32), F.lit(r)), F.lit(groups))
        packed = settle(marked.where(loose).drop("fill", "gap").withColumn("team", pool).repartition(min(groups, 10_000), "team").sortWithinPartitions("team").mapInArrow(_repack(capacity), _KIND))
    for d in done:
        packed = packed.unionByName(d)
    windows = packed.select("doc_id", "part", (F.col("part").cast("long") * capacity).alias("first"), "tokens", F.concat(F.lit("g"), F.shiftright("window", 32), F.lit("-"), F.col("window").bitwiseAND(0xFFFFFFFF)).alias("window"))
    whole = full.select("doc_id", "part", "first", "tokens", F.concat(F.lit("f"), F.col("row"), F.lit("-"), F.col("part")).alias("window"))
    return windows.unionByName(whole)


def certificate(windows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, tokens, windows, the lower bound of all items together, the gap and the fill."""
    spark = windows.sparkSession
    windows = settle(windows)
    counts = windows.groupBy("tokens").count().collect()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts:
        histogram[r["tokens"]] = r["count"]
    used = windows.agg(F.count_distinct("window")).scalar()
    total = int((histogram * np.arange(capacity + 1)).sum())
    row = windows.agg(F.count(F.lit(1)).alias("items")).withColumn("tokens", F.lit(total)).withColumn("windows", used)
    bound = lower_bound(histogram, capacity)
    return row.select("items", "tokens", "windows", F.lit(bound).alias("bound"), (F.col("windows") - bound).alias("gap"), (F.col("tokens") / (F.col("windows") * capacity)).alias("fill")) if total else spark.createDataFrame([(0, 0, 0, 0, 0, None)], "items bigint, tokens bigint, windows bigint, bound int, gap bigint, fill double")
