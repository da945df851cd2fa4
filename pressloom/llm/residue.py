"""Template residue and error-page text (problem 2).

Method: a regularised linear classifier over hashed n-grams of what stands in the article's place, with length and
title features. Weak labels come from phrases of response statuses, script notices, filler and template slots, on a
bounded sample of items; the classifier is validated on sources (hosts) that training never saw (p2_validation).

Defined results: null and blank texts are no residue; slots or phrases that an article quotes are none; an article
with at least one unfilled slot is residue; repeated rows give repeated results of one id once.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pressloom.llm.pages import PHRASES, PageModel, line_model, load, open_slots, page_label, residue_pages, sample, train_pages, weak_labels
from pressloom.runtime import table


def residue(items: DataFrame, bound: int | None = None) -> DataFrame:
    """item_id of the items (item_id, source, title, text) whose text is residue."""
    spark = items.sparkSession
    _, weights, model = train_pages(items, bound) if bound else train_pages(items)
    data = spark.sparkContext.broadcast(pickle.dumps((weights, model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, model = load(data.value)
        for b in batches:
            hit = residue_pages(b.column("text").to_pylist(), b.column("title").to_pylist(), weights, model)
            yield pa.RecordBatch.from_arrays([b.column("item_id").filter(pa.array(hit))], names=["item_id"])

    some = items.filter("text is not null and text <> ''").select("item_id", "title", "text")
    return some.mapInArrow(run, "item_id long").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "items"))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items kept for triage: those with text that is no residue, and those without text."""
    items = table(spark, sf_dir, "items")
    return items.join(residue(items), "item_id", "left_anti").select("item_id", "source", "title")


def held_out(train: list, test: list) -> tuple[int, int, int, int, int, int]:
    """Pages and residue pages of ``test``, hits, false hits, misses, and hits without the page's n-grams."""
    weights = line_model(train).astype(np.float32)
    model = PageModel().fit(train, weights)
    known = [(r, y) for r, labelled in test if (y := page_label(labelled)) is not None]
    y = np.array([y for _, y in known], bool)
    find = lambda: residue_pages([r.text for r, _ in known], [r.title for r, _ in known], weights, model)
    hit = find()
    model.w = np.zeros_like(model.w)
    return len(known), int(y.sum()), int((hit & y).sum()), int((hit & ~y).sum()), int((~hit & y).sum()), int((find() & y).sum())


def phrase_of(labelled: list) -> str | None:
    """The first phrase that a residue page without slots was labelled by."""
    if page_label(labelled) != 1 or any(open_slots(s) for _, s, _ in labelled):
        return None
    return next((re.sub(r"\d+", "0", m[0].lower()) for _, s, _ in labelled if (m := PHRASES.search(s))), None)


def p2_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out checks against weak labels: on a fifth of the sources (hosts), and on pages whose phrase training never saw
    (a third of the phrases; their pages are left out of training)."""
    pages = weak_labels(sample(table(spark, sf_dir, "items")))
    part = lambda s, n: zlib.crc32((s or "").encode()) % n == 0
    hosts = [part(r.source, 5) for r, _ in pages]
    phrases = [(p := phrase_of(labelled)) is not None and part(p, 3) for _, labelled in pages]
    rows = []
    for name, out in (("unseen sources", hosts), ("unseen phrases", phrases)):
        train, test = [p for p, o in zip(pages, out, strict=True) if not o], [p for p, o in zip(pages, out, strict=True) if o]
        rows.append((name, *held_out(train, test)))
    return spark.createDataFrame(rows, "held_out string, n_pages long, n_residue long, hits long, false_hits long, missed long, hits_without_page_ngrams long")


QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean, "p2_validation": p2_validation}
