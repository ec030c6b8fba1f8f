"""One label from several annotators: competence-and-spamming mixture, fitted by EM.

Every answer is either the truth (with the annotator's competence) or drawn from the annotator's own
guess distribution. The items stay distributed: an iteration is one pass over them that returns sums
per annotator and guessed label, whose number is bounded by annotators x fields x GUESS_CELLS; a round
ends when no annotator's share of guesses changes any more.

The mixture takes annotators as independent. Where two of them give the same wrong answer far more
often than chance allows (one copies the other, or both follow one habit), their equal answers to an
item count as one: such groups are found from the sums of a pass as well, first over all fields, then
field by field, each followed by more iterations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lesograf.sources.tables import settle

FIELDS = ("pos", "rel", "head_id", "lemma")
GUESS_CELLS = 1024  # cells that guessed labels are hashed to; small label sets fall in cells of their own almost always
SPAM_PRIOR, TRUE_PRIOR = 1.0, 4.0  # pseudo-answers: a new annotator is trusted in 4 of 5 answers
GUESS_PRIOR = 0.05
ITERATIONS = 6  # of each of the three rounds at most
CONVERGED = 0.002  # change of every annotator's share of guesses below which a round ends
CELL_BITS, PERSON_BITS = 10, 40  # of the number that names field, annotator and cell
LEAST_SAME = 5  # equal wrong answers from which a pair may copy
SAME_OF_WRONG, SAME_OF_ALL = 0.8, 0.08  # a pair copies if it agrees in so many of its common wrong answers, and so many of all its common answers are wrong and the same


def latest_answers(annotations: DataFrame) -> DataFrame:
    """``tok_key, field, annotator_id, label``: each annotator's last answer per token and field.

    Labels lose outer blanks; ``pos`` upper case, ``rel`` and ``lemma`` lower case, ё in lemmas as е.
    NULL and blank answers count as left out; repeated rows count once; equal times are decided by
    the greater ``ann_key``. Rows without token or annotator are left out.
    """
    text = {
        "pos": F.upper(F.trim(F.regexp_replace("pos", "[\\s\\u00a0]+", " "))),
        "rel": F.lower(F.trim(F.regexp_replace("rel", "[\\s\\u00a0]+", " "))),
        "head_id": F.col("head_id").cast("string"),
        "lemma": F.translate(F.lower(F.trim(F.regexp_replace("lemma", "[\\s\\u00a0]+", " "))), "ё", "е"),
    }
    rows = annotations.where("tok_key IS NOT NULL AND annotator_id IS NOT NULL")
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), text[f].alias("label")) for f in FIELDS)))
    rows = rows.select("tok_key", "annotator_id", F.struct("annotated_at", "ann_key").alias("at"), each.alias("a"))
    rows = rows.select("tok_key", "annotator_id", "at", "a.*").where("label IS NOT NULL AND label <> ''")
    return rows.groupBy("tok_key", "field", "annotator_id").agg(F.max_by("label", "at").alias("label"))


class _Params:
    """Competence and guess distribution of every (field, annotator) known so far, as sorted arrays.

    ``key`` of an answer: field, annotator and cell in one number; its annotator part without the cell."""

    def __init__(self, people: np.ndarray | None = None, spam: np.ndarray | None = None, floor: np.ndarray | None = None, keys: np.ndarray | None = None, guess: np.ndarray | None = None, cells: np.ndarray | None = None, groups: dict | None = None):
        none = np.zeros(0)
        self.people = np.zeros(0, np.int64) if people is None else people
        self.spam, self.floor = none if spam is None else spam, none if floor is None else floor
        self.keys = np.zeros(0, np.int64) if keys is None else keys
        self.guess = none if guess is None else guess
        self.cells = np.full(len(FIELDS), GUESS_CELLS) if cells is None else cells
        self.groups = groups or {}
        self.copied = np.array(sorted(self.groups), np.int64)
        self.leader = np.array([self.groups[k] for k in sorted(self.groups)], np.int64)

    @staticmethod
    def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each key."""
        if not len(sorted_keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return at, sorted_keys[at] == keys

    def of(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of guesses of each answer's annotator, and probability of the guess."""
        person = key >> CELL_BITS
        spam, guess = np.full(len(key), SPAM_PRIOR / (SPAM_PRIOR + TRUE_PRIOR)), 1.0 / self.cells[person >> PERSON_BITS]
        at, there = self._find(self.people, person)
        spam[there], guess[there] = self.spam[at[there]], self.floor[at[there]]
        at, there = self._find(self.keys, key)
        guess[there] = self.guess[at[there]]
        return np.clip(spam, 1e-4, 1 - 1e-4), np.maximum(guess, 1e-9)

    def crowd(self, person: np.ndarray) -> np.ndarray:
        at, there = self._find(self.copied, person)
        return np.where(there, self.leader[at], person) if len(self.copied) else person


def _posteriors(batch: pa.RecordBatch, params: _Params):
    """Flat answers of a batch with the probabilities of the mixture: item, key, label, label group of each
    answer; the groups, item of each and its posterior; P(truthful) of each answer."""
    answers = batch.column("answers")
    flat = answers.flatten()
    key = flat.field("key").to_numpy()
    label = flat.field("label").dictionary_encode()
    item = np.repeat(np.arange(batch.num_rows), np.diff(answers.offsets.to_numpy()))
    spam, guess = params.of(key)
    known, random = 1 - spam, spam * guess
    groups, group = np.unique(item.astype(np.int64) * (len(label.dictionary) + 1) + label.indices.to_numpy(), return_inverse=True)
    of_item = groups // (len(label.dictionary) + 1)
    # equal answers of annotators who copy count as one
    people, crowd = np.unique(params.crowd(key >> CELL_BITS), return_inverse=True)
    _, same, times = np.unique(group * len(people) + crowd, return_inverse=True, return_counts=True)
    score = np.bincount(group, weights=np.log1p(known / random) / times[same], minlength=len(groups))
    top = np.full(batch.num_rows, -np.inf)
    np.maximum.at(top, of_item, score)
    e = np.exp(score - top[of_item])
    posterior = e / np.bincount(of_item, weights=e, minlength=batch.num_rows)[of_item]
    return item, key, label, groups, group, of_item, posterior, posterior[group] * known / (known + random)


def _sums(params: _Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, key, *_, truthful = _posteriors(batch, params)
            keys, inverse = np.unique(key, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(inverse, weights=1 - truthful)), pa.array(np.bincount(inverse).astype(float))], names=["key", "guessed", "answers"])

    return run


def _wrong(batch: pa.RecordBatch, params: _Params):
    """Item and person of each answer, its label group, and whether a better label is known."""
    item, key, _, _, group, of_item, posterior, _ = _posteriors(batch, params)
    best = np.full(batch.num_rows, -1.0)
    np.maximum.at(best, of_item, posterior)
    return item, key >> CELL_BITS, group, posterior[group] < best[item]


def _same_wrong(params: _Params):
    """How often two annotators gave the same wrong answer to an item: pairs are made only of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, person, group, wrong = _wrong(batch, params)
            person, group = person[wrong], group[wrong]
            order = np.lexsort((person, group))
            person, group = person[order], group[order]
            pairs: list[np.ndarray] = []
            shift = 1
            while shift < len(group) and (near := group[shift:] == group[:-shift]).any():
                pairs.append(np.stack([person[:-shift][near], person[shift:][near]]))
                shift += 1
            both, n = np.unique(np.concatenate(pairs, axis=1), axis=1, return_counts=True) if pairs else (np.zeros((2, 0), np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(n.astype(float))], names=["a", "b", "same"])

    return run


def _common(params: _Params, pairs: list[tuple[int, int]]):
    """Common items of the given pairs, and those that both answered wrongly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            item, person, _, wrong = _wrong(batch, params)
            wanted = {p for pair in pairs for p in pair}
            own = {p: (item[at := person == p], item[at & wrong]) for p in np.unique(person).tolist() if p in wanted}
            sums = [(a, b, float(len(np.intersect1d(own[a][0], own[b][0]))), float(len(np.intersect1d(own[a][1], own[b][1])))) for a, b in pairs if a in own and b in own]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in sums], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["a", "b", "common", "wrong"])

    return run


def _copiers(items: DataFrame, params: _Params, by_field: bool) -> dict:
    """person (field and annotator) -> the least one of the group that copies; bounded by the annotators."""
    name = (lambda c: F.col(c)) if by_field else (lambda c: F.col(c).bitwiseAND((1 << PERSON_BITS) - 1))
    merge = lambda df, *sums: df.groupBy(name("a").alias("a"), name("b").alias("b")).agg(*(F.sum(c).alias(c) for c in sums))
    same = merge(items.mapInArrow(_same_wrong(params), "a bigint, b bigint, same double"), "same").where(f"same >= {LEAST_SAME}").collect()
    if not same:
        return params.groups
    fields = [0] if by_field else range(len(FIELDS))
    pairs = [(f << PERSON_BITS | r["a"], f << PERSON_BITS | r["b"]) for r in same for f in fields]
    common = {(r["a"], r["b"]): r for r in merge(items.mapInArrow(_common(params, pairs), "a bigint, b bigint, common double, wrong double"), "common", "wrong").collect()}
    groups = dict(params.groups)
    for a, b, n in sorted((r["a"], r["b"], r["same"]) for r in same):
        c = common[a, b]
        if n < c["wrong"] * SAME_OF_WRONG or n < c["common"] * SAME_OF_ALL:
            continue
        for f in fields:
            p, q = f << PERSON_BITS | a, f << PERSON_BITS | b
            x, y = groups.get(p, p), groups.get(q, q)
            for k in [k for k, v in groups.items() if v in (x, y)]:
                groups[k] = min(x, y)
            groups[p] = groups[q] = min(x, y)
    return groups


def _params(table: pa.Table, cells: np.ndarray, groups: dict) -> _Params:
    table = table.sort_by("key")
    keys, guessed, answers = (table[c].to_numpy() for c in ("key", "guessed", "answers"))
    people, inverse = np.unique(keys >> CELL_BITS, return_inverse=True)
    g, n = np.bincount(inverse, weights=guessed), np.bincount(inverse, weights=answers)
    whole = g + GUESS_PRIOR * cells[people >> PERSON_BITS]
    return _Params(people, (g + SPAM_PRIOR) / (n + SPAM_PRIOR + TRUE_PRIOR), GUESS_PRIOR / whole, keys, (guessed + GUESS_PRIOR) / whole[inverse], cells, groups)


def _items(answers: DataFrame) -> DataFrame:
    field = F.array_position(F.array(*map(F.lit, FIELDS)), F.col("field")) - 1
    cell = F.pmod(F.xxhash64("label"), F.lit(GUESS_CELLS))
    person = F.shiftleft(field, PERSON_BITS).bitwiseOR(F.col("annotator_id").cast("bigint").bitwiseAND((1 << PERSON_BITS) - 1))
    key = F.shiftleft(person, CELL_BITS).bitwiseOR(cell).alias("key")
    return answers.groupBy("tok_key", "field").agg(F.collect_list(F.struct("label", key)).alias("answers"))


def _fit(items: DataFrame) -> _Params:
    cell = F.col("key").bitwiseAND(GUESS_CELLS - 1)
    start = items.select(F.explode("answers.key").alias("key")).select(F.shiftright("key", CELL_BITS + PERSON_BITS).alias("field"), cell.alias("cell")).distinct().groupBy("field").count()
    cells = np.full(len(FIELDS), 2)
    for r in start.collect():  # one row a field
        cells[r["field"]] = max(2, r["count"])
    params = _Params(cells=cells)
    for stage in range(3):
        groups = _copiers(items, params, stage == 2) if stage else {}
        if stage and groups == params.groups:
            continue  # no copiers: the fit stays as it is
        params = _Params(params.people, params.spam, params.floor, params.keys, params.guess, cells, groups)
        for _ in range(ITERATIONS):
            # annotators x fields x GUESS_CELLS rows at most
            sums = items.mapInArrow(_sums(params), "key bigint, guessed double, answers double").groupBy("key").agg(F.sum("guessed").alias("guessed"), F.sum("answers").alias("answers")).toArrow()
            last, params = params, _params(sums, cells, groups)
            if len(last.spam) == len(params.spam) and (not len(params.spam) or np.abs(last.spam - params.spam).max() < CONVERGED):
                break
    return params


def _label(params: _Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            item, _, label, groups, group, of_item, posterior, _ = _posteriors(batch, params)
            votes = np.bincount(group, minlength=len(groups))
            names = label.dictionary.to_pylist()
            rank = np.argsort(np.argsort(np.array(names, object), kind="stable"), kind="stable") if names else np.zeros(0, int)
            code = groups % (len(names) + 1)
            order = np.lexsort((rank[code], -votes, -np.round(posterior, 9), of_item))
            first = order[np.r_[True, of_item[order][1:] != of_item[order][:-1]]]
            total = np.bincount(item, minlength=batch.num_rows)
            pairs = np.bincount(of_item, weights=votes * (votes - 1), minlength=batch.num_rows)
            at = of_item[first]
            n = total[at]
            agreement = pa.array(pairs[at] / np.maximum(1, n * (n - 1)), mask=n < 2)
            yield pa.RecordBatch.from_arrays([batch.column("tok_key").take(pa.array(at)), batch.column("field").take(pa.array(at)), pa.array([names[c] for c in code[first].tolist()]), pa.array(posterior[first]), agreement, pa.array(n.astype(np.int32))], names=["tok_key", "field", "label", "probability", "agreement", "answers"])

    return run


def consensus(annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, annotators).

    labels: ``tok_key, field, label, probability, agreement, answers`` - one row for each token and
    field with an answer; ``agreement`` is the share of agreeing pairs of answers, NULL for a single
    one. annotators: ``annotator_id, field, competence``. Ties of the posterior go to the label with
    more answers, then the first in code point order. Empty input gives empty results.
    """
    spark = annotations.sparkSession
    items = settle(_items(latest_answers(annotations)))
    params = _fit(items)
    labels = items.mapInArrow(_label(params), "tok_key bigint, field string, label string, probability double, agreement double, answers int")
    sign = 1 << (PERSON_BITS - 1)
    rows = [(((p & ((1 << PERSON_BITS) - 1)) ^ sign) - sign, FIELDS[p >> PERSON_BITS], float(1 - s)) for p, s in zip(params.people.tolist(), params.spam)]
    return labels, spark.createDataFrame(rows, "annotator_id int, field string, competence double")
