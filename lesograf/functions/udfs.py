"""Arrow functions for what Spark has no built-in for."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

_INTS = ArrayType(IntegerType())
_SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
_OPCODES = ArrayType(StructType([StructField("tag", StringType()), *(StructField(k, IntegerType()) for k in ("i1", "i2", "j1", "j2"))]))


def normalize(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text).lower().replace("ё", "е") if text else ""


@F.pandas_udf(StringType())
def norm_text(text: pd.Series) -> pd.Series:
    """Compatibility composition, lower case, ё as е; NULL gives an empty text."""
    return text.map(normalize)


@F.pandas_udf(StringType())
def lemma_rule_build(word: pd.Series, lemma: pd.Series) -> pd.Series:
    """Rule that turns the word into the lemma: the longest common block stays."""

    def one(w, l):
        if w is None or l is None:
            return None
        a, b = w.lower().replace("ё", "е"), l.lower().replace("ё", "е")
        m = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match(0, len(a), 0, len(b))
        if not m.size:
            return f"cut_prefix=0|cut_suffix={len(a)}|append_suffix={b}"
        if m.b:  # what precedes the block in the lemma can't be appended: the whole word is replaced
            return f"cut_prefix={len(a)}|cut_suffix=0|append_suffix={b}"
        return f"cut_prefix={m.a}|cut_suffix={len(a) - m.a - m.size}|append_suffix={b[m.b + m.size :]}"

    return pd.Series([one(w, l) for w, l in zip(word, lemma)], dtype=object)


@F.pandas_udf(_OPCODES)
def diff_opcodes(gold: pd.Series, pred: pd.Series) -> pd.Series:
    """Differing blocks of two token lists; equal blocks are left out."""

    def one(a, b):
        a, b = [] if a is None else list(a), [] if b is None else list(b)
        return [dict(zip(("tag", "i1", "i2", "j1", "j2"), op)) for op in difflib.SequenceMatcher(None, a, b, autojunk=len(b) >= 200).get_opcodes() if op[0] != "equal"]

    return pd.Series([one(a, b) for a, b in zip(gold, pred)], dtype=object)


def partial_ratio(a: str, b: str) -> float:
    """Best similarity (0..100) of the shorter text with a stretch of the longer one of its length."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0

    def common(x: str, y: str) -> int:
        row = [0] * (len(y) + 1)
        for c in x:
            last = 0
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
        return row[-1]

    best, n = 0.0, len(short)
    for i in range(1 - n, len(long)):
        part = long[max(0, i) : i + n]
        best = max(best, 200.0 * common(short, part) / (n + len(part)))
    return best


def project(text: str | None, forms: list[str], window: int = 20, threshold: float = 75.0) -> list[tuple[int, int] | None]:
    """Spans of the forms in the text, left to right: exact, else near the cursor by partial similarity."""
    raw, cursor, out = normalize(text), 0, []
    for form in forms:
        clean = normalize(form)
        if not clean:
            out.append(None)
            continue
        start = raw.find(clean, cursor)
        if start < 0 or start - cursor > window:
            near = raw[cursor : cursor + window + len(clean)]
            if near and partial_ratio(clean, near) > threshold and clean[0] in near:
                start = cursor + near.index(clean[0])
        if start < 0:
            out.append(None)
            continue
        cursor = start + len(clean)
        out.append((start, cursor))
    return out


def project_prefix(text: str | None, forms: list[str]) -> list[tuple[int, int] | None]:
    """The second projection: exact within 50 characters, else the most similar prefix of a length within two."""
    raw, cursor, out = normalize(text), 0, []
    for form in forms:
        clean = normalize(form)
        if not clean:
            out.append(None)
            continue
        at = raw[cursor : cursor + 50 + len(clean)].find(clean)
        if at >= 0:
            out.append((cursor + at, cursor + at + len(clean)))
            cursor += at + len(clean)
            continue
        scores = [(difflib.SequenceMatcher(None, clean, raw[cursor : cursor + 20][:n]).ratio(), -n) for n in range(max(1, len(clean) - 2), len(clean) + 3)]
        score, n = max(scores)
        if score > 0.8:
            out.append((cursor, cursor - n))
            cursor -= n
        else:
            out.append(None)
    return out


def _spans(function):
    @F.pandas_udf(_SPANS)
    def run(text: pd.Series, forms: pd.Series) -> pd.Series:
        rows = [[None if s is None else {"start": s[0], "end": s[1]} for s in function(t, [] if f is None else list(f))] for t, f in zip(text, forms)]
        return pd.Series(rows, dtype=object)

    return run


project_spans = _spans(project)
project_spans_prefix = _spans(project_prefix)


def arborescence(energy: np.ndarray) -> list[int]:
    """Heads of the maximum spanning arborescence rooted in node 0; ``energy[h, d]`` scores the arc h -> d.

    Every node takes its best head; a cycle is contracted to one node whose incoming arcs are worth
    what they gain over the arc they break, until no cycle is left.
    """
    n = len(energy)
    score = energy.astype(float).copy()
    np.fill_diagonal(score, -np.inf)
    score[:, 0] = -np.inf
    heads = [0] + [int(score[:, d].argmax()) for d in range(1, n)]

    def cycle() -> list[int]:
        state = [0] * n
        for start in range(1, n):
            path, v = [], start
            while v and not state[v]:
                state[v] = 1
                path.append(v)
                v = heads[v]
            if v and v in path:
                return path[path.index(v) :]
            for u in path:
                state[u] = 2
        return []

    ring = cycle()
    if not ring:
        return heads
    inside = set(ring)
    outer = [v for v in range(n) if v not in inside]
    place = {v: i for i, v in enumerate(outer)}
    k = len(outer)
    small = np.full((k + 1, k + 1), -np.inf)
    enter, leave = {}, {}
    for h in outer:
        for d in outer:
            small[place[h], place[d]] = score[h, d]
        gain, d = max((score[h, d] - score[heads[d], d], d) for d in ring)
        small[place[h], k], enter[h] = gain, d
    for d in outer:
        if d:
            best, h = max((score[h, d], h) for h in ring)
            small[k, place[d]], leave[d] = best, h
    solved = arborescence(small)
    out = heads[:]
    for d in outer[1:]:
        out[d] = leave[d] if solved[place[d]] == k else outer[solved[place[d]]]
    h = outer[solved[k]]
    out[enter[h]] = h
    return out


@F.pandas_udf(_INTS)
def mst_heads(energies: pd.Series) -> pd.Series:
    """Heads of nodes 0..n-1 from an energy matrix (array of rows, row = head); node 0 is the root."""
    return pd.Series([[] if m is None or not len(m) else arborescence(np.array([list(r) for r in m])) for m in energies], dtype=object)


def decode_tree(scores: np.ndarray) -> list[int]:
    """Heads of all nodes from scores[head, node]; the node with the greatest self-arc is the root and its
    own head. Scores become probabilities of each node's heads; nodes that no arc reaches take their
    best head."""
    e = np.exp(scores - scores.max(axis=0, keepdims=True))
    p = e / e.sum(axis=0, keepdims=True)
    root = int(p.diagonal().argmax())
    order = [root, *(i for i in range(len(p)) if i != root)]
    inner = p[np.ix_(order, order)].copy()
    inner[:, 0] = 0.0
    solved = arborescence(inner)
    heads = [root] * len(p)
    for i, h in enumerate(solved):
        if i:
            heads[order[i]] = order[h] if inner[h, i] > 0 else int(scores[:, order[i]].argmax())
    return heads


def tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``sent_key, heads`` (``decode_tree``) of rows ``sent_key, scores`` (array of rows, row = head); NULL
    and empty scores give none. For ``mapInArrow``: as a scalar function over nested lambdas it is taken
    out of the plan of only the first query of a session, the others fail."""
    for batch in batches:
        heads = [[] if not m else decode_tree(np.array(m, float)) for m in batch.column("scores").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("sent_key"), pa.array(heads, pa.list_(pa.int32()))], names=["sent_key", "heads"])
