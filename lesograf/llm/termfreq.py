"""Occurrences and document frequency of every distinct term (vertical layout).

Each term owns a set of record identifiers, kept as compressed containers of 2**16 identifiers: a
sorted uint16 array below 4,096 members, a bitmap of 8 KiB from there on. Tasks build containers and
occurrence counters for their rows, containers of one term and bucket are merged by union, and the
document frequency is the sum of the containers' cardinalities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("lemma", "pos", "rel")
DENSE = 4096  # members from which a container is a bitmap
BITMAP_BYTES = 8192
FLUSH_ROWS = 2_000_000

_PART = pa.schema([("field", pa.string()), ("term", pa.string()), ("bucket", pa.int64()), ("occurrences", pa.int64()), ("members", pa.binary())])
_COUNT = pa.schema([("field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def normal_term(value: str) -> str:
    """Lower case without outer blanks, ё as е."""
    return value.strip().lower().replace("ё", "е")


def _bitmap(low: np.ndarray) -> bytes:
    bits = np.zeros(1 << 16, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _members(container: bytes) -> np.ndarray:
    if len(container) == BITMAP_BYTES:
        return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8), bitorder="little")).astype(np.uint16)
    return np.frombuffer(container, np.uint16)


def _containers(field: str, terms: list[str], codes: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """One row for each (term, bucket) among the rows given by term code and record identifier."""
    order = np.lexsort((records, codes))
    codes, records = codes[order], records[order]
    bucket = records >> 16
    new_group = np.r_[True, (codes[1:] != codes[:-1]) | (bucket[1:] != bucket[:-1])]
    starts = np.flatnonzero(new_group)
    occurrences = np.diff(np.r_[starts, len(codes)])
    first = np.r_[True, new_group[1:] | (records[1:] != records[:-1])]
    low = (records[first] & 0xFFFF).astype(np.uint16)
    group = (np.cumsum(new_group) - 1)[first]
    sizes = np.bincount(group, minlength=len(starts))
    offsets = np.r_[0, np.cumsum(sizes)]
    if (sizes >= DENSE).any():
        members = pa.array([_bitmap(low[a:b]) if b - a >= DENSE else low[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
    else:
        members = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((offsets * 2).astype(np.int32).tobytes()), pa.py_buffer(low.tobytes())])
    names = pa.array(terms, pa.string()).take(pa.array(codes[starts]))
    return pa.RecordBatch.from_arrays([pa.array([field] * len(starts), pa.string()), names, pa.array(bucket[starts]), pa.array(occurrences), members], schema=_PART)


def _build(fields: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: dict[str, dict[str, int]] = {f: {} for f in fields}
        held: dict[str, list] = {f: [] for f in fields}
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for f in fields:
                if held[f]:
                    yield _containers(f, list(code[f]), np.concatenate([c for c, _ in held[f]]), np.concatenate([r for _, r in held[f]]))
                code[f], held[f] = {}, []

        for batch in batches:
            record = batch.column("record").to_numpy(zero_copy_only=False)
            for f in fields:
                column = batch.column(f)
                encoded = pc.dictionary_encode(column)
                known = code[f]
                mapped = np.array([known.setdefault(normal_term(v), len(known)) for v in encoded.dictionary.to_pylist()] or [0], np.int64)
                present = np.flatnonzero(pc.is_valid(column).to_numpy(zero_copy_only=False))
                if len(present):
                    index = encoded.indices.fill_null(0).to_numpy(zero_copy_only=False)
                    held[f].append((mapped[index[present]], record[present]))
            rows += batch.num_rows
            if rows >= FLUSH_ROWS:
                yield from flush()
                rows = 0
        yield from flush()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union of the containers of equal (field, term, bucket); the input is sorted by these."""
    key, bits, count = None, None, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"field": key[0], "term": key[1], "occurrences": count, "records": int(bits.sum())}], schema=_COUNT)

    for batch in batches:
        field, term, bucket = (batch.column(c) for c in ("field", "term", "bucket"))
        n = batch.num_rows
        if not n:
            continue
        same = np.ones(n, bool)
        same[0] = False
        for c in (field, term, bucket):
            if n > 1:
                same[1:] &= pc.equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(~same)
        group = np.cumsum(~same) - 1
        parts = [_members(m) for m in batch.column("members").to_pylist()]
        sizes = np.array([len(p) for p in parts])
        occurrences = batch.column("occurrences").to_numpy(zero_copy_only=False)
        heads = list(zip(field.take(pa.array(starts)).to_pylist(), term.take(pa.array(starts)).to_pylist(), bucket.take(pa.array(starts)).to_pylist()))
        if key is not None and heads[0] != key:
            yield row()
            key = None
        # inner groups are whole; the first may go on from the last batch, the last into the next one
        last = len(starts) - 1
        carried = [0] if key is not None else []
        loose = set(carried) | {last}
        inner = np.array([g for g in range(len(starts)) if g not in loose], np.int64)
        if len(inner):
            packed = np.unique((np.repeat(group, sizes).astype(np.int64) << 16) | np.concatenate(parts).astype(np.int64))
            cardinality = np.bincount(packed >> 16, minlength=len(starts))
            total = np.bincount(group, weights=occurrences, minlength=len(starts)).astype(np.int64)
            at = pa.array(starts[inner])
            yield pa.RecordBatch.from_arrays([field.take(at), term.take(at), pa.array(total[inner]), pa.array(cardinality[inner].astype(np.int64))], schema=_COUNT)
        for g in sorted(loose):
            if key is None or heads[g] != key:
                if key is not None:
                    yield row()
                key, bits, count = heads[g], np.zeros(1 << 16, bool), 0
            end = starts[g + 1] if g < last else n
            for i in range(starts[g], end):
                bits[parts[i]] = True
                count += int(occurrences[i])
    if key is not None:
        yield row()


def record_map(sentences: DataFrame) -> DataFrame:
    """(sent_key, record): record is the least sent_key of the rows that share a sent_id, so that a
    sentence delivered again is the same record. Rows without sent_id or sent_key have no record."""
    s = sentences.select("sent_key", "sent_id").where("sent_key IS NOT NULL AND sent_id IS NOT NULL")
    first = s.groupBy("sent_id").agg(F.min("sent_key").alias("record"))
    return s.join(first, "sent_id").select("sent_key", "record")


def term_frequencies(tokens: DataFrame, sentences: DataFrame, fields: tuple[str, ...] = FIELDS, rare_below: int = 3, common_share: float = 0.2) -> DataFrame:
    """Rows, records and mark of every distinct term: ``field, term, occurrences, records, mark``.

    A term is the value without outer blanks, in lower case, ё as е; NULL is no term, an empty value
    is the empty term. Only rows whose ``id`` is digits count. ``mark`` is ``rare`` below
    ``rare_below`` records, ``common`` above ``common_share`` of all distinct ``sent_id``, else NULL.
    Repeated rows count as occurrences again, not as records. Tokens whose sentence is unknown are
    left out. Empty tables give no rows; other columns are not read.
    """
    total = sentences.where("sent_id IS NOT NULL").agg(F.count_distinct("sent_id").cast("double").alias("n"))
    words = tokens.where(F.col("id").rlike("^[0-9]+$")).select("sent_key", *fields)
    rows = words.join(record_map(sentences), "sent_key").select("record", *fields)
    parts = rows.mapInArrow(_build(fields), "field string, term string, bucket bigint, occurrences bigint, members binary")
    merged = parts.repartition("field", "term", "bucket").sortWithinPartitions("field", "term", "bucket").mapInArrow(_merge, "field string, term string, occurrences bigint, records bigint")
    counts = merged.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > total.scalar() * F.lit(common_share), "common")
    return counts.withColumn("mark", mark)
