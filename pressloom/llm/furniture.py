"""Page boilerplate mixed with main content (problem 3).

Method: gradient-boosted trees over the nodes of the page tree (page - block - line; the texts keep no markup, so blocks
are runs of lines of one form). Features: subtree density (characters, words and sentence ends of line and block),
attribute tokens (the line model's log-odds over hashed tokens; in how many of the source's titles, and how large a share
of them, the line stands), depth and order (place in page and block, place to the headline and to the first and last
sentence), sibling statistics (the kinds and lengths of neighbours). Hierarchical decoding: each block and its lines are
labelled together by maximum likelihood, and a block that is dropped keeps no line. Labels for training are weak ones, on
a bounded sample of items; the repetition statistics cover all lines of all items, whatever their length.

The texts are read once: every line's numbers and hash go into one narrow row a page. Counts of (source, line) are
aggregated by hash and joined back on the hash, salted; nothing that grows with lines or sources is collected or broadcast.

Defined results: items of p2 (residue) give no lines; null and blank texts neither; blank lines are never returned but
counted; repeated rows give repeated results of one (item_id, line_no) once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm.learn import Boosted
from pressloom.llm.linewise import Lines, in_chunks, mixed
from pressloom.llm.pages import FURNITURE, HEADLINE, KINDS, PROSE, RESIDUE, SAMPLE, SUBHEAD, load, title_words, train_pages
from pressloom.runtime import cut, salted_join, table

#: Least number of a source's titles with which a line must stand to count as repeated. Log-share of other lines.
LEAST, UNSEEN = 3, -9.2
#: Lines of one call of the trees.
MANY = 200_000
PAGE = "uid long, item_id long, s long, t long, residue boolean, no array<int>, h array<long>, x binary"


def page_rows(items: DataFrame, weights: np.ndarray, page_model) -> DataFrame:
    """PAGE rows: of each page with text its lines' numbers, hashes (with the source), log-probabilities and forms."""
    data = items.sparkSession.sparkContext.broadcast(pickle.dumps((weights, page_model)))
    names = [c.split()[0] for c in PAGE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, page_model = load(data.value)
        for b in batches:
            texts, titles = b.column("text").to_pylist(), b.column("title").to_pylist()
            for lo, hi, lines in in_chunks(texts, titles):
                logp = lines.logp(weights)
                own = b.column("s").slice(lo, hi - lo).to_numpy()
                offsets = pa.array(np.searchsorted(lines.page, np.arange(lines.pages + 1)), pa.int32())
                numbers = np.concatenate([logp.clip(-30, 0), np.minimum(lines.form, 60_000)], axis=1).astype(np.float16)
                size = numbers.itemsize * numbers.shape[1]
                blob = pa.Array.from_buffers(pa.binary(), lines.pages, [None, pa.array(offsets.to_numpy() * size, pa.int32()).buffers()[1], pa.py_buffer(numbers.tobytes())])
                cols = [b.column(k).slice(lo, hi - lo) for k in ("uid", "item_id", "s", "t")] + [
                    pa.array(page_model.residue(lines, logp, weights)),
                    pa.ListArray.from_arrays(offsets, pa.array(lines.no, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(line_keys(lines, own[lines.page]))),
                    blob,
                ]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    folded_title = F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"[^\p{L}\p{N}]+", "")
    some = items.filter("text is not null and text <> ''").select(
        F.xxhash64("item_id", "source", "title", "text").alias("uid"), F.col("item_id").cast("long").alias("item_id"),
        F.xxhash64(F.coalesce("source", F.lit(""))).alias("s"), F.xxhash64(folded_title).alias("t"), "title", "text",
    )
    return some.mapInArrow(run, PAGE)


def line_keys(lines: Lines, source: np.ndarray) -> np.ndarray:
    return mixed(lines.hashes() ^ mixed(source.view(np.uint64), 7)).view(np.int64)


def repetition(pages: DataFrame) -> DataFrame:
    """h, n, total: of each line (hash with its source) that stands with at least LEAST titles of its source their number,
    and the number of all the source's titles. Counts are partial by (line, title) before any line's rows meet."""
    each = pages.select("s", "t", F.explode(F.array_distinct("h")).alias("h"))
    sums = each.groupBy("s", "h").agg(F.countDistinct("t").alias("n")).filter(F.col("n") >= LEAST)
    total = pages.groupBy("s").agg(F.countDistinct("t").alias("total"))
    return salted_join(sums, total, ["s"], "h").select("h", F.col("n").cast("float").alias("n"), F.col("total").cast("float").alias("total"))


def nodes(page: np.ndarray, m: int, logp: np.ndarray, form: np.ndarray, n_titles: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every line of ``m`` pages, and the number of its block."""
    n = len(page)
    share = np.where(n_titles > 0, np.log(np.maximum(n_titles, 1) / np.maximum(total, 1)), UNSEEN)
    base = np.concatenate([share[:, None], np.log1p(n_titles)[:, None], form], axis=1).astype(np.float32)
    if not n:
        return np.zeros((0, KINDS + base.shape[1] + 26), np.float32), np.zeros(0, np.int64)
    base[:, 2] = np.log1p(base[:, 2])
    size_log, ends, marks, separators, cover, within = base[:, 2], base[:, 5], base[:, 6], base[:, 7], base[:, 10], base[:, 9]
    at = np.arange(n)
    count_page = np.bincount(page, minlength=m)
    pos = at - (np.cumsum(count_page) - count_page)[page]
    size = count_page[page]
    p = np.exp(logp)
    kind = logp.argmax(axis=1)
    # blocks: neighbours on one page of one form (list entry or not; short, middle, long; sentence end or not)
    shape = marks * 8 + np.digitize(size_log, [3.8, 4.7]) * 2 + ends
    start = np.r_[True, (page[1:] != page[:-1]) | (shape[1:] != shape[:-1])]
    block = np.cumsum(start) - 1
    count = np.bincount(block).astype(float)
    mean = lambda v: (np.bincount(block, v) / count)[block]
    first = np.flatnonzero(start)
    # order: own headline, first and last sentence of the page
    own = (cover >= 0.8) & (within >= 0.6) & (separators < 1)
    prose = (kind == PROSE) & (share < -6)

    def extreme(mask: np.ndarray, last: bool) -> np.ndarray:
        out = np.full(m, -1 if last else n)
        (np.maximum if last else np.minimum).at(out, page[mask], at[mask])
        return out[page]

    head, one, end = extreme(own, False), extreme(prose, False), extreme(prose, True)

    def near(v: np.ndarray, step: int, fill: float) -> np.ndarray:
        out = np.full_like(v, fill, dtype=np.float32)
        if step > 0:
            out[step:] = np.where(page[step:] == page[:-step], v[:-step], fill)
        else:
            out[:step] = np.where(page[:step] == page[-step:], v[-step:], fill)
        return out

    headish = ((p[:, HEADLINE] > 0.5) & ~own).astype(np.float32)
    context = np.stack([
        pos / np.maximum(size - 1, 1), np.minimum(pos, 30), np.minimum(size - 1 - pos, 30), np.minimum(size, 60),
        own, np.clip(at - head, -20, 20), np.clip(at - one, -20, 20), np.clip(end - at, -20, 20),
        count[block], at - first[block], mean(size_log), mean(share), mean(p[:, FURNITURE]), mean(p[:, PROSE]),
        near(p[:, PROSE], 1, -1), near(p[:, PROSE], -1, -1), near(p[:, FURNITURE], 1, -1), near(p[:, FURNITURE], -1, -1),
        near(size_log, 1, -1), near(size_log, -1, -1), near(headish, 1, -1), near(headish, -1, -1),
        near(base[:, 0], 1, 0), near(base[:, 0], -1, 0), near(ends, 1, -1), near(ends, -1, -1),
    ], axis=1)
    return np.concatenate([logp.clip(-12, 0), base, context], axis=1).astype(np.float32), block


def node_labels(labelled: list[tuple[int, str, int]], logp: np.ndarray, title: str | None) -> list[int]:
    """Weak labels of a page's lines: 1 not the article's, 0 the article's, -1 unclear."""
    tw = title_words(title)
    own_words = set(tw)
    out = []
    for k, (_, s, kind) in enumerate(labelled):
        ws = set(title_words(s))
        cover, within = (len(ws & own_words) / len(own_words), len(ws & own_words) / len(ws)) if own_words and ws else (0, 0)
        if kind in (FURNITURE, RESIDUE):
            out.append(1)
        elif kind in (PROSE, SUBHEAD):
            out.append(0)
        elif cover >= 0.8 and within >= 0.6 and " > " not in s:
            out.append(0)
        elif kind == HEADLINE or (logp[k, HEADLINE] > -0.1 and cover < 0.5 and len(s) > 45):
            out.append(1)
        elif logp[k, PROSE] > -0.1 and (k == len(labelled) - 1 or len(s) > 60):
            out.append(0)
        else:
            out.append(-1)
    return out


def decode(logit: np.ndarray, block: np.ndarray) -> np.ndarray:
    """True for lines that are not the article's. A block is dropped as a whole, or kept with its lines free."""
    if not len(logit):
        return np.zeros(0, bool)
    drop, keep = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
    m = int(block[-1]) + 1
    whole = np.bincount(block, drop, m)
    free = np.bincount(block, np.maximum(drop, keep), m)
    mean = np.bincount(block, logit, m) / np.bincount(block, minlength=m)
    # the block's own evidence is that of its mean line
    gone = whole - np.logaddexp(0, -mean) > free - np.logaddexp(0, mean)
    return np.where(gone[block], True, logit > 0)


def train_nodes(sampled: list, weights: np.ndarray, known: dict[int, tuple[float, float]], source_hash: dict[str, int]) -> Boosted:
    """``known``: number of titles and total of the sampled lines that are repeated."""
    x, logp = [], []
    for lo, hi, lines in in_chunks(["\n".join(s for _, s, _ in labelled) for _, labelled in sampled], [r.title for r, _ in sampled]):
        logp.append(lines.logp(weights))
        got = np.array([known.get(k, (0.0, 1.0)) for k in sample_keys(lines, sampled[lo:hi], source_hash).tolist()], np.float32).reshape(-1, 2)
        x.append(nodes(lines.page, lines.pages, logp[-1], lines.form, got[:, 0], got[:, 1])[0])
    if not x:
        return Boosted(trees=0).fit(np.zeros((2, KINDS + Lines.FORM + 28)), np.array([0.0, 1.0]))
    x, logp = np.concatenate(x), np.concatenate(logp)
    y, i = [], 0
    for r, labelled in sampled:
        y += node_labels(labelled, logp[i : i + len(labelled)], r.title)
        i += len(labelled)
    y = np.array(y)
    clear = y >= 0
    if not clear.any():
        return Boosted(trees=0).fit(np.zeros((2, x.shape[1])), np.array([0.0, 1.0]))
    return Boosted().fit(x[clear].astype(float), y[clear].astype(float))


def sample_keys(lines: Lines, sampled: list, source_hash: dict[str, int]) -> np.ndarray:
    return line_keys(lines, np.array([source_hash[r.source or ""] for r, _ in sampled], np.int64)[lines.page])


def furniture(items: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """item_id, line_no of the non-blank lines of the items (item_id, source, title, text) that are not the article's."""
    spark = items.sparkSession
    sampled, weights, page_model = train_pages(items, bound)
    pages = cut(page_rows(items, weights, page_model))
    repeated = cut(repetition(pages))
    # the trees learn on the sample: only its lines' counts are fetched
    names = sorted({r.source or "" for r, _ in sampled})
    hashes = spark.createDataFrame([(s,) for s in names], "source string").select("source", F.xxhash64("source").alias("s")).collect() if names else []
    source_hash = {r.source: r.s for r in hashes}
    wanted: set[int] = set()
    for lo, hi, lines in in_chunks(["\n".join(s for _, s, _ in labelled) for _, labelled in sampled]):
        wanted.update(sample_keys(lines, sampled[lo:hi], source_hash).tolist())
    keys = spark.createDataFrame([(k,) for k in wanted], "h long") if wanted else None
    known = {r.h: (r.n, r.total) for r in repeated.join(keys, "h", "left_semi").collect()} if keys is not None else {}
    trees = train_nodes(sampled, weights, known, source_hash)
    data = spark.sparkContext.broadcast(pickle.dumps(trees))
    occurrences = pages.filter("not residue").select("uid", F.posexplode("h").alias("pos", "h"))
    hits = salted_join(occurrences, repeated, ["h"], "uid").groupBy("uid").agg(F.collect_list(F.struct("pos", "n", "total")).alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = load(data.value)
        for b in batches:
            sizes = np.array([len(x) for x in b.column("no").to_pylist()], np.int64) if b.num_rows else np.zeros(0, np.int64)
            group = np.cumsum(sizes) // MANY
            for g in np.unique(group):
                lo, hi = np.searchsorted(group, g), np.searchsorted(group, g, side="right")
                yield dropped(b.slice(int(lo), int(hi - lo)), sizes[lo:hi], trees)

    some = pages.filter("not residue").select("uid", "item_id", "no", "x").join(hits, "uid", "left")
    return some.mapInArrow(run, "item_id long, line_no long").distinct()


def dropped(b: pa.RecordBatch, sizes: np.ndarray, trees: Boosted) -> pa.RecordBatch:
    page = np.repeat(np.arange(len(sizes)), sizes)
    x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.float16).astype(np.float32).reshape(len(page), -1)
    n_titles, total = np.zeros(len(page), np.float32), np.ones(len(page), np.float32)
    hits = b.column("hits")
    first = np.cumsum(sizes) - sizes
    flat = hits.flatten()
    if len(flat):
        counts = np.array([len(v) if v is not None else 0 for v in hits.to_pylist()], np.int64)
        at = np.repeat(first, counts) + flat.field("pos").to_numpy(zero_copy_only=False)
        n_titles[at], total[at] = flat.field("n").to_numpy(zero_copy_only=False), flat.field("total").to_numpy(zero_copy_only=False)
    f, block = nodes(page, len(sizes), x[:, :KINDS], x[:, KINDS:], n_titles, total)
    gone = decode(trees.logit(f), block)
    no = b.column("no").flatten().to_numpy(zero_copy_only=False)
    ids = np.repeat(b.column("item_id").to_numpy(zero_copy_only=False), sizes)
    return pa.RecordBatch.from_arrays([pa.array(ids[gone], pa.int64()), pa.array(no[gone], pa.int64())], names=["item_id", "line_no"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture(table(spark, sf_dir, "items"))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's own lines (items without furniture keep their text as it is)."""
    items = table(spark, sf_dir, "items").select("item_id", "text")
    gone = furniture(table(spark, sf_dir, "items")).groupBy("item_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", (i + 1).cast("long"))), "\n")
    return items.join(gone, "item_id", "left").select("item_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"))


QUERIES = {"p3_found": p3_found, "p3_clean": p3_clean}
