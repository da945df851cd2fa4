"""Evaluation texts leaking into training text (problem 9).

Method: the test items are the indexed side: a BM25 inverted index over their passages, its postings split into blocks of
items with the block maximum of every term. Every training passage (a window of WINDOW words; neighbours share N - 1
words, so that no run of N words falls between two) is a query. Block-max WAND: the query's terms with the smallest maxima
that together stay below the threshold open no postings (the pivot); a block that the other terms open is skipped if the
sum of its maxima over all terms stays below the threshold; the blocks left are scored in full and all items at or above
the threshold are retrieved. Retrieved pairs are verified word by word, and the overlap of question and answer is measured.
Postings are sparse; the corpus is read once for each PASS bytes of test items (the bound of what is broadcast).

Threshold: of each item the smallest BM25 score that any N consecutive words of its passage give (term by term, each
once); weights are divided by it, so that 1 is the threshold of all items. A window that holds N consecutive words of
an item scores at least 1: nothing is lost, whatever the corpus.

Defined results: words are runs of letters and digits, case ignored; passages of fewer than N words leak nowhere; null
and empty texts hold nothing; repeated rows (one doc_id, one eval_id) give one pair.
"""

from __future__ import annotations

import functools
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pressloom.runtime import table

#: Consecutive words that make a leak.
N = 13
WINDOW = 64
#: Items of one WAND block; bytes of test items that are broadcast at once; windows that are scored at once.
BLOCK, PASS, AT_ONCE = 32, 64 << 20, 4096
K1, B = 1.2, 0.75
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


class Index:
    """BM25 postings of items by term, weights over the item's threshold, and the maxima of their blocks."""

    def __init__(self, items: list[tuple[int, str, str, str]]):
        self.ids = [i for i, *_ in items]
        bags = [words(p) for _, p, _, _ in items]
        self.grams = [{" ".join(b[i : i + N]) for i in range(len(b) - N + 1)} for b in bags]
        self.question = [set(words(q)) for _, _, q, _ in items]
        self.answer = [" ".join(words(a)) for *_, a in items]
        df = Counter(w for b in bags for w in set(b))
        self.vocab = {w: i for i, w in enumerate(df)}
        mean = sum(map(len, bags)) / max(1, len(bags)) or 1
        term, item, weight = [], [], []
        for k, b in enumerate(bags):
            tf = Counter(b)
            norm = K1 * (1 - B + B * len(b) / mean)
            w = {t: math.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in tf.items()}
            least = min((sum(w[t] for t in set(b[i : i + N])) for i in range(len(b) - N + 1)), default=None)
            if least:
                term += [self.vocab[t] for t in w]
                item += [k] * len(w)
                weight += [x / least for x in w.values()]
        term, self.item, self.weight = np.array(term, np.int64), np.array(item, np.int64), np.array(weight)
        order = np.lexsort((self.item, term))
        term, self.item, self.weight = term[order], self.item[order], self.weight[order]
        # postings lie by (term, block); entry e has the postings at[e] to at[e + 1]
        key = term * (len(items) // BLOCK + 1) + self.item // BLOCK
        self.at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.block = self.item[self.at] // BLOCK
        self.most = np.maximum.reduceat(self.weight, self.at) if len(key) else np.zeros(0)
        self.first = np.searchsorted(term[self.at], np.arange(len(df) + 1))
        self.top = np.zeros(len(df))
        np.maximum.at(self.top, term[self.at], self.most)
        self.at = np.r_[self.at, len(key)]

    def search(self, docs: list[list[str]]) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first word, words) of each window and each item retrieved for it."""
        get, step = self.vocab.get, WINDOW - N + 1
        doc, at, term = [], [], []
        for d, ws in enumerate(docs):
            ids = [get(w, -1) for w in ws]
            known = [i for i, t in enumerate(ids) if t >= 0]
            doc += [d] * len(known)
            at += known
            term += [ids[i] for i in known]
        if not term:
            return
        doc, at, term = np.array(doc), np.array(at), np.array(term)
        # a word belongs to the window of its step, and if among the first N - 1 words of a step also to the one before
        win = at // step
        again = (at % step < N - 1) & (win > 0)
        doc, win, term = np.r_[doc, doc[again]], np.r_[win, win[again] - 1], np.r_[term, term[again]]
        key = (doc.astype(np.int64) << 32) | win
        # the terms of a window by their maxima
        order = np.lexsort((term, self.top[term], key))
        key, term = key[order], term[order]
        once = np.r_[True, (np.diff(key) != 0) | (np.diff(term) != 0)]
        key, term = key[once], term[once]
        starts = np.flatnonzero(np.r_[True, np.diff(key) != 0])
        ends = np.r_[starts[1:], len(key)]
        for lo in range(0, len(starts), AT_ONCE):
            s, e = starts[lo : lo + AT_ONCE], ends[lo : lo + AT_ONCE]
            for w, k in zip(*self._retrieve(term[s[0] : e[-1]], s - s[0]), strict=True):
                x = int(key[s[w]])
                yield x >> 32, int(k), (x & 0xFFFFFFFF) * step, WINDOW

    def _retrieve(self, term: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all items at or above the threshold, of windows whose terms lie in a row (by their maxima)."""
        n = len(starts)
        window = np.repeat(np.arange(n), np.diff(np.r_[starts, len(term)]))
        sums = np.cumsum(self.top[term])
        sums -= np.r_[0.0, sums[starts[1:] - 1]][window] if n else 0
        opens = sums >= 0.999  # the terms before the pivot cannot reach the threshold together
        blocks = int(self.block.max(initial=0)) + 1

        def entries(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            count = self.first[term[some] + 1] - self.first[term[some]]
            return runs(self.first[term[some]], count), np.repeat(window[some], count)

        e, w = entries(opens)
        candidates = np.unique(w * blocks + self.block[e])
        if not len(candidates):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        e, w = entries(np.isin(window, candidates // blocks))
        pair = w * blocks + self.block[e]
        place = np.minimum(np.searchsorted(candidates, pair), len(candidates) - 1)
        ok = candidates[place] == pair
        e, w, place = e[ok], w[ok], place[ok]
        bound = np.bincount(place, self.most[e], len(candidates))
        ok = bound[place] >= 0.999
        e, w = e[ok], w[ok]
        count = self.at[e + 1] - self.at[e]
        post = runs(self.at[e], count)
        items = len(self.ids)
        key, where = np.unique(np.repeat(w, count) * items + self.item[post], return_inverse=True)
        score = np.bincount(where, self.weight[post], len(key)) if len(key) else np.zeros(0)
        hit = key[score >= 0.999]
        return hit // items, hit % items


@functools.lru_cache(2)
def _index(data: bytes) -> Index:
    return Index(pickle.loads(data))


def passes(items: Iterable[Row], size: int = PASS) -> Iterator[list[tuple[int, str, str, str]]]:
    """Test items in parts of at most ``size`` bytes of text (or of one item)."""
    part, held = [], 0
    for r in items:
        if r.eval_id is None:
            continue
        x = (r.eval_id, r.passage or "", r.question or "", r.answer or "")
        n = sum(len(t.encode("utf-8", "surrogatepass")) for t in x[1:])
        if part and held + n > size:
            yield part
            part, held = [], 0
        part.append(x)
        held += n
    if part:
        yield part


def leaks(documents: DataFrame, items: Iterable[Row], size: int = PASS) -> DataFrame:
    """eval_id, doc_id, n_grams, question_share, answer_found: documents (doc_id, text) that hold N consecutive words
    of an item (eval_id, passage, question, answer)."""
    spark = documents.sparkSession
    schema = "eval_id long, doc_id long, n_grams long, question_share double, answer_found boolean"
    parts = []
    for some in passes(items, size):
        data = spark.sparkContext.broadcast(pickle.dumps(some))

        def run(batches: Iterator[pa.RecordBatch], data=data) -> Iterator[pa.RecordBatch]:
            ix = _index(data.value)
            for b in batches:
                ids, docs = b.column("doc_id").to_pylist(), [words(t) for t in b.column("text").to_pylist()]
                rows, hits = [], {}
                for d, k, first, size in ix.search(docs):
                    ws = docs[d][first : first + size]
                    got = {g for i in range(len(ws) - N + 1) if (g := " ".join(ws[i : i + N])) in ix.grams[k]}
                    if got:
                        hits.setdefault((d, k), set()).update(got)
                for (d, k), got in hits.items():
                    have, q = set(docs[d]), ix.question[k]
                    share = len(q & have) / len(q) if q else 0.0
                    found = bool(ix.answer[k]) and f" {ix.answer[k]} " in f" {' '.join(docs[d])} "
                    rows.append((ix.ids[k], ids[d], len(got), share, found))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
                names = ["eval_id", "doc_id", "n_grams", "question_share", "answer_found"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=names)

        parts.append(documents.select("doc_id", "text").mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = functools.reduce(DataFrame.unionByName, parts)
    return out.dropDuplicates(["eval_id", "doc_id"])


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the test items are the stated query set; they come to the driver part by part (one part is held at a time)
    items = table(spark, sf_dir, "eval_items").select("eval_id", "passage", "question", "answer").dropDuplicates(["eval_id"])
    return leaks(table(spark, sf_dir, "documents"), items.toLocalIterator())


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("eval_id", "doc_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report: which test items leaked, into how many documents, and how much of them at most."""
    got = _leaks(spark, sf_dir).groupBy("eval_id").agg(
        F.count(F.lit(1)).alias("n_documents"), F.max("n_grams").alias("most_grams"), F.max("question_share").alias("question_share")
    )
    return got


QUERIES = {"p9_found": p9_found, "p9_items": p9_items}

_GRAMS = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
e AS (SELECT eval_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
eg AS (SELECT DISTINCT eval_id, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT eval_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM e WHERE len(w) >= 13))
"""
ORACLES = {
    "p9_found": _GRAMS + "SELECT DISTINCT eval_id, doc_id FROM dg JOIN eg USING (g)",
    "p9_items": _GRAMS
    + r""", h AS (SELECT eval_id, doc_id, count(DISTINCT g) AS n FROM dg JOIN eg USING (g) GROUP BY ALL),
q AS (SELECT eval_id, list_distinct(regexp_extract_all(lower(question), '[\p{L}\p{N}]+')) AS q FROM eval_items),
s AS (SELECT eval_id, doc_id, n, CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, list_distinct(w))) / len(q) END AS share FROM h JOIN q USING (eval_id) JOIN d USING (doc_id))
SELECT eval_id, count(*) AS n_documents, max(n) AS most_grams, max(share) AS question_share FROM s GROUP BY eval_id""",
}
