"""BM25 scores of blocks of chunks inside tasks: what a question shares with a chunk is summed where the chunk lies, so that
no row for each pair of question, word and chunk is moved or kept.

Questions are numbered, grouped by scope and sent to all tasks as arrays of numbers; chunks come as the numbers of the asked
words that they hold. A block holds whole groups (chunks of one message and one leading text), sorted by scope, group, row_idx
and doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

K1, B = 1.5, 0.75
#: Rows of a block, and rows of a batch of scores.
BLOCK, EMIT = 40_000, 200_000
#: What rounding to four digits may hide, with what the order of a sum may change.
_ROUNDING = 2e-4


def counted(lists: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, word, times) of lists of words, by list and word; words outside the vocabulary are left out."""
    found = pc.index_in(pc.list_flatten(lists), vocabulary)
    of = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    kept = found.is_valid().to_numpy(zero_copy_only=False)
    both, times = np.unique(of[kept] * max(1, len(vocabulary)) + found.drop_null().to_numpy(zero_copy_only=False), return_counts=True)
    return both // max(1, len(vocabulary)), (both % max(1, len(vocabulary))).astype(np.int32), times.astype(np.int32)


class Asked:
    """Questions (q, scope, key) as arrays: ``of`` has the range of each scope, ``terms`` and ``weights`` lie at ``at``."""

    def __init__(self, questions: pa.Table, terms: pa.Table, avg_length: float):
        self.vocabulary, self.avg_length = terms["term"].combine_chunks(), avg_length
        questions = questions.sort_by([("scope", "ascending"), ("q", "ascending")])
        self.q = questions["q"].to_numpy()
        scopes = questions["scope"].to_pylist()
        edges = [i for i in range(len(scopes)) if not i or scopes[i] != scopes[i - 1]]
        self.of = {scopes[a]: (a, b) for a, b in zip(edges, [*edges[1:], len(scopes)])}
        keys = questions["key"].combine_chunks()
        of, self.terms, times = counted(pc.split_pattern(keys, " "), self.vocabulary)
        self.weights = times * terms["idf"].to_numpy()[self.terms]
        self.at = np.searchsorted(of, np.arange(len(scopes) + 1))

    @classmethod
    def sent(cls, value: "Asked | dict") -> "Asked":
        """The questions in a task, where they come as a plain dict of their fields."""
        if isinstance(value, cls):
            return value
        made = cls.__new__(cls)
        made.__dict__.update(value)
        return made

    def of_question(self, i: int) -> tuple[list[int], list[float]]:
        a, b = self.at[i], self.at[i + 1]
        return self.terms[a:b].tolist(), self.weights[a:b].tolist()


def packed(asked) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces the column words of chunks by ids and times of asked words; chunks without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Asked.sent(asked.value).vocabulary
        for batch in batches:
            of, ids, times = counted(batch.column("words"), vocabulary)
            offsets = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32) * 4
            column = lambda x: pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x, np.int32))])  # noqa: B023, E731
            kept = [n for n in batch.schema.names if n != "words"]
            out = pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], column(ids), column(times)], [*kept, "ids", "times"])
            yield out.filter(pa.array(np.diff(offsets) > 0))

    return run


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of packed ones, and how many each row has."""
    chunks = [c.cast(pa.binary()) for c in column.chunks]
    data, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for c in chunks:
        at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        data.append(np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]].copy().view(np.int32))
        sizes.append(np.diff(at).astype(np.int64) // 4)
    return np.concatenate(data), np.concatenate(sizes)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows cut into blocks between groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < BLOCK:
            continue
        table = pa.Table.from_batches(held)
        scope, grp = table["scope"], table["grp"].to_numpy()
        same = (grp[1:] == grp[:-1]) & pc.equal(scope.slice(1), scope.slice(0, len(scope) - 1)).to_numpy()
        cuts = np.flatnonzero(~same)
        if len(cuts):
            yield table.slice(0, cuts[-1] + 1)
            held = table.slice(cuts[-1] + 1).to_batches()
    if held:
        yield pa.Table.from_batches(held)


class _Postings:
    """The words of some chunks of one scope, by word."""

    def __init__(self, doc: np.ndarray, word: np.ndarray, part: np.ndarray, n: int):
        order = np.argsort(word, kind="stable")
        word, self.doc, self.part, self.n = word[order], doc[order], part[order], n
        starts = np.flatnonzero(np.diff(word, prepend=-1)) if len(word) else np.empty(0, np.int64)
        top = np.maximum.reduceat(self.part, starts) if len(word) else np.empty(0)
        self.of = dict(zip(word[starts].tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(word)], top.tolist())))
        self.sums = np.zeros(n)

    def asked(self, terms: list[int], weights: list[float]) -> list[tuple[float, float, int, int]]:
        """(most that the word can add, weight, from, to) of the words that are here."""
        return [(w * x[2], w, x[0], x[1]) for t, w in zip(terms, weights) if (x := self.of.get(t))]

    def add(self, slots: list[tuple[float, float, int, int]]) -> np.ndarray:
        self.sums.fill(0)
        for _, w, a, b in slots:
            self.sums[self.doc[a:b]] += w * self.part[a:b]
        return self.sums


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e4 + 0.5) / 1e4


def _scopes(table: pa.Table, asked: Asked) -> Iterator[tuple]:
    """(questions from, to, chunks from, to, their lengths of packed words' arrays) for each asked scope of a block."""
    ids, sizes = _numbers(table["ids"])
    times, _ = _numbers(table["times"])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(table.num_rows), sizes)
    tf, dl = times.astype(np.float64), table["dl"].to_numpy().astype(np.float64)[doc]
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / asked.avg_length)) if len(tf) else tf
    encoded = table["scope"].combine_chunks()
    change = np.flatnonzero(pc.not_equal(encoded.slice(1), encoded.slice(0, len(encoded) - 1)).to_numpy(zero_copy_only=False)) + 1
    edges = [0, *change.tolist(), table.num_rows]
    for lo, hi in zip(edges, edges[1:]):
        if (questions := asked.of.get(encoded[lo].as_py())) is not None:
            a, b = ends[lo], ends[hi]
            yield *questions, lo, hi, doc[a:b] - lo, ids[a:b], part[a:b]


def every(asked) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(q, doc_id, row_idx, grp, score) of all chunks that share a word with a question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Asked.sent(asked.value)
        names, qs, docs, scores, held = ("doc_id", "row_idx", "grp"), [], [], [], 0
        for table in _blocks(batches):
            table = table.combine_chunks()

            def made() -> Iterator[pa.RecordBatch]:
                rows = pa.array(np.concatenate(docs))
                taken = [table[n].combine_chunks().take(rows) for n in names]  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(qs), [len(d) for d in docs])), *taken, pa.array(np.concatenate(scores))], ["q", *names, "score"])

            for first, last, lo, hi, doc, word, part in _scopes(table, known):
                here = _Postings(doc, word, part, hi - lo)
                for i in range(first, last):
                    score = _rounded(here.add(here.asked(*known.of_question(i))))
                    rows = np.flatnonzero(score > 0)
                    if len(rows):
                        qs.append(known.q[i])
                        docs.append(rows + lo)
                        scores.append(score[rows])
                        held += len(rows)
                    if held >= EMIT:
                        yield from made()
                        qs, docs, scores, held = [], [], [], 0
            if held:
                yield from made()
                qs, docs, scores, held = [], [], [], 0

    return run


def best(asked, top_k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(q, doc_id, row_idx, score): the ``top_k`` chunks of each question in a task, of each group the first that shares a word.

    Words that together stay below a question's ``top_k``-th score so far can't bring a chunk among its best: chunks are looked
    up by the others, and these words are added for what may still reach that score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Asked.sent(asked.value)
        kept: dict[int, list[tuple]] = {}
        kind = None
        for table in _blocks(batches):
            kind = table.schema.field("doc_id").type
            grp, doc_id, row_idx = table["grp"].to_numpy(), table["doc_id"].combine_chunks(), pc.fill_null(table["row_idx"], -(1 << 63)).to_numpy()
            place = np.empty(table.num_rows, np.int64)  # in the order that settles ties
            place[pc.sort_indices(table.select(["row_idx", "doc_id"]), [("row_idx", "ascending"), ("doc_id", "ascending")], null_placement="at_start").to_numpy()] = np.arange(table.num_rows)
            for first, last, lo, hi, doc, word, part in _scopes(table, known):
                g = grp[lo:hi]
                same = g[1:] == g[:-1]
                many = np.concatenate([same, [False]]) | np.concatenate([[False], same])
                among = many[doc]
                # groups of one chunk, and those whose first chunk that shares a word must be found
                ones = _Postings(doc[~among], word[~among], part[~among], hi - lo)
                groups = _Postings(doc[among], word[among], part[among], hi - lo) if among.any() else None
                for i in range(first, last):
                    terms, weights = known.of_question(i)
                    so_far = kept.get(i, [])
                    least = -so_far[-1][0] if len(so_far) == top_k else 0.0
                    rows, score = _reaching(ones, ones.asked(terms, weights), least)
                    if groups is not None and (slots := groups.asked(terms, weights)):
                        whole = _rounded(groups.add(slots))
                        shared = np.flatnonzero(whole > 0)
                        if len(shared):
                            shared = shared[np.concatenate([[True], g[shared[1:]] != g[shared[:-1]]])]
                            rows, score = np.concatenate([rows, shared]), np.concatenate([score, whole[shared]])
                    if len(rows) > top_k:
                        able = score >= np.partition(score, len(score) - top_k)[len(score) - top_k]
                        rows, score = rows[able], score[able]
                        if len(rows) > top_k:
                            order = np.lexsort((place[rows + lo], -score))[:top_k]
                            rows, score = rows[order], score[order]
                    if len(rows):
                        new = [(-s, int(row_idx[r + lo]), doc_id[r + lo].as_py()) for r, s in zip(rows.tolist(), score.tolist())]
                        kept[i] = sorted(so_far + new)[:top_k]
        if kept:
            each = [(i, x) for i, found in kept.items() for x in found]
            rows = pa.array([x[1] if x[1] != -(1 << 63) else None for _, x in each], pa.int64())
            columns = [pa.array(known.q[[i for i, _ in each]]), pa.array([x[2] for _, x in each], kind), rows, pa.array([-x[0] for _, x in each], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["q", "doc_id", "row_idx", "score"])

    return run


def _reaching(of: _Postings, slots: list[tuple[float, float, int, int]], least: float) -> tuple[np.ndarray, np.ndarray]:
    """The chunks whose rounded score is above 0 and no less than ``least``."""
    bound, rest, light = least - _ROUNDING, 0.0, 0
    slots = sorted(slots)
    while light < len(slots) and rest + slots[light][0] < bound:
        rest += slots[light][0]
        light += 1
    if light == len(slots):
        return np.empty(0, np.int64), np.empty(0)
    sums = of.add(slots[light:])
    rows = np.flatnonzero(sums >= bound - rest if bound > rest else sums > 0)
    score = sums[rows]
    for _, w, a, b in slots[:light] if len(rows) else ():
        docs = of.doc[a:b]
        at = np.minimum(np.searchsorted(docs, rows), b - a - 1)
        score = score + np.where(docs[at] == rows, w * of.part[a:b][at], 0.0)
    score = _rounded(score)
    reached = (score > 0) & (score >= least)
    return rows[reached], score[reached]
