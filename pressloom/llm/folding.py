"""Records that differ only in white space, letter case, punctuation or field order (problem 6).

Method: the code points of a whole Arrow batch run through a skip-and-fold lookup table (letters and digits fold, all
else is skipped) straight into rolling polynomial hashes; no canonical string is built. Two independent 64-bit hashes
make the group key. Every row of a group is then verified against the group's first row by a two-pointer comparison
that skips and folds on the fly.

Defined results:
* a url is scheme+host+path, a *set* of (name, value) query parameters and a fragment; percent escapes count as the
  characters they stand for
* rows without url (null or blank) group by source_type and title; those with url by title and url alone
* a row whose fields hold no letter and no digit at all is no copy of anything; null keys likewise
* rows with one and the same id are one row
* texts are compared in NFC, each by itself
* the hashes of a group agreeing while the folded texts differ raises an error (never seen: 128 bits)
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from pressloom.runtime import cut, extended, table

#: No letter or digit stands above this code point.
TOP = 0x33000
#: Ways into which the rows of one group are spread when they meet their group's first row.
SALTS = 16
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@functools.lru_cache(1)
def fold_table() -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
    """Of each code point: its fold, how many code points the fold has (0: skipped), and the folds longer than one."""
    fold, size, more = np.arange(TOP, dtype=np.uint32), np.zeros(TOP, np.uint8), {}
    for c in range(TOP):
        ch = chr(c)
        if ch.isalnum():
            f = ch.casefold()
            f = "".join(x for x in f if x.isalnum()) or f
            fold[c], size[c] = ord(f[0]), len(f)
            if len(f) > 1:
                more[c] = f
    return fold, size, more


@functools.lru_cache(1)
def mixers() -> tuple[np.ndarray, np.ndarray]:
    """Random 64-bit value of each folded code point, one set for each hash."""
    rng = np.random.default_rng(20240601)
    return tuple(rng.integers(1, 2**63, TOP, dtype=np.uint64) | np.uint64(1) for _ in BASES)


@functools.lru_cache(16)
def powers(n: int, which: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(n - 1, BASES[which], np.uint64), out=out[1:]) if n > 1 else None
    return out


def fold_hash(values: pa.Array) -> np.ndarray:
    """(rows, 2) polynomial hashes of the folded letters and digits of each string; null and empty give 0."""
    values = pc.fill_null(values.cast(pa.large_string()), "")
    n = len(values)
    out = np.zeros((n, 2), np.uint64)
    if not n:
        return out
    # every row in NFC, whatever rows share its batch
    texts = [t if t.isascii() else unicodedata.normalize("NFC", t) for t in values.to_pylist()]
    lengths = np.fromiter(map(len, texts), np.int64, n)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp):
        return out
    return _hash(cp, lengths, out)


def _hash(cp: np.ndarray, lengths: np.ndarray, out: np.ndarray) -> np.ndarray:
    fold, size, more = fold_table()
    low = np.minimum(cp, TOP - 1)
    k = np.where(cp < TOP, size[low], 0)
    row = np.repeat(np.arange(len(lengths)), lengths)
    rows = np.repeat(row, k)
    f = np.repeat(fold[low], k)
    if more and (k > 1).any():
        ends = np.cumsum(k)
        for i in np.flatnonzero(k > 1):
            f[ends[i] - k[i] : ends[i]] = [ord(c) for c in more[int(cp[i])]]
    if not len(f):
        return out
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    pos = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    with np.errstate(over="ignore"):
        for w in (0, 1):
            p = powers(1 << int(pos.max() + 1).bit_length(), w)
            out[rows[starts], w] = np.add.reduceat(mixers()[w][f] * p[pos], starts)
    return out


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    """Finalise so that sums of hashes of different roles do not cancel. Zero (nothing there) stays zero."""
    with np.errstate(over="ignore"):
        x = h * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(32)
    return np.where(h == 0, np.uint64(0), x)


def unescape(a: pa.Array) -> pa.Array:
    has = pc.fill_null(pc.match_substring(a, "%"), False)
    if not pc.any(has).as_py():
        return a
    return pa.array([unquote(x) if x and "%" in x else x for x in a.to_pylist()], pa.large_string())


def url_hash(urls: pa.Array) -> np.ndarray:
    """(rows, 2) hashes of path, parameter set and fragment; 0 for null."""
    parts = pc.extract_regex(pc.fill_null(urls.cast(pa.large_string()), ""), r"(?s)^(?P<p>[^?#]*)(?:\?(?P<q>[^#]*))?(?:#(?P<f>.*))?$")
    get = lambda k: pc.fill_null(pc.struct_field(parts, k), "")
    out = mix(fold_hash(unescape(get("p"))), 1)
    frag = mix(fold_hash(unescape(get("f"))), 2)
    lists = pc.split_pattern(get("q"), "&")
    owner, params = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), pc.list_flatten(lists)
    kv = pc.extract_regex(params, r"(?s)^(?P<n>[^=]*)(?:=(?P<v>.*))?$")
    field = lambda k: unescape(pc.fill_null(pc.struct_field(kv, k), ""))
    with np.errstate(over="ignore"):
        one = mix(fold_hash(field("n")), 3) + mix(fold_hash(field("v")), 4)
        one = mix(one, 5)
        order = np.lexsort((one[:, 0], owner))
        first = np.r_[True, (np.diff(one[order, 0]) != 0) | (np.diff(owner[order]) != 0)] if len(order) else np.zeros(0, bool)
        kept = order[first]
        total = np.zeros_like(out)
        for w in (0, 1):
            np.add.at(total[:, w], owner[kept], one[kept, w])
        return out + frag + total


def skipping_equal(a: str | None, b: str | None) -> bool:
    """Two pointers over both strings, skipping what is neither letter nor digit and folding on the fly."""
    if a == b:
        return True

    def folded(s: str) -> Iterator[str]:
        for c in s:
            if c.isalnum():
                for x in c.casefold():
                    if x.isalnum():
                        yield x

    a, b = unicodedata.normalize("NFC", a or ""), unicodedata.normalize("NFC", b or "")
    return all(x == y for x, y in itertools.zip_longest(folded(a), folded(b)))


def same_url(a: str | None, b: str | None) -> bool:
    if a == b:
        return True

    def split(u: str | None) -> tuple[str, list[str], str]:
        head, _, frag = (u or "").partition("#")
        path, _, query = head.partition("?")
        return unquote(path), [x for x in query.split("&")], unquote(frag)

    (p, q, f), (r, s, g) = split(a), split(b)
    if not (skipping_equal(p, r) and skipping_equal(f, g)):
        return False

    def pairs(ps: list[str]) -> list[tuple[str, str]]:
        cut_up = [p.partition("=") for p in ps if any(c.isalnum() for c in p)]
        return [(unquote(n), unquote(v)) for n, _, v in cut_up]

    def within(xs: list, ys: list) -> bool:
        return all(any(skipping_equal(n, m) and skipping_equal(v, w) for m, w in ys) for n, v in xs)

    x, y = pairs(q), pairs(s)
    return within(x, y) and within(y, x)


def copy_hashes(df: DataFrame) -> DataFrame:
    """Append h1, h2 (bigint, null: no copy of anything; columns of these names are replaced) to rows with source_type, title and url."""
    df = df.drop("h1", "h2")
    schema = extended(df, h1="long", h2="long")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            url = b.column("url")
            blank = pc.fill_null(pc.equal(pc.utf8_trim_whitespace(url), ""), True).to_numpy(zero_copy_only=False)
            t, u, s = fold_hash(b.column("title")), url_hash(url), fold_hash(b.column("source_type"))
            with np.errstate(over="ignore"):
                h = mix(t, 11) + np.where(blank[:, None], mix(s, 12), mix(u, 13)) + np.where(blank, np.uint64(17), np.uint64(29))[:, None]
            none = (t[:, 0] == 0) & (blank | (u[:, 0] == 0))
            cols = [pa.array(h[:, w].view(np.int64), mask=none) for w in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in names] + cols, names=[*names, "h1", "h2"])

    return df.mapInArrow(run, schema)


@F.pandas_udf(BooleanType())
def _same(t1: pd.Series, u1: pd.Series, s1: pd.Series, t2: pd.Series, u2: pd.Series, s2: pd.Series) -> pd.Series:
    blank = lambda u: u is None or not u.strip()
    return pd.Series(
        [
            skipping_equal(a, b) and blank(x) == blank(y) and (skipping_equal(p, q) if blank(x) else same_url(x, y))
            for a, b, x, y, p, q in zip(t1, t2, u1, u2, s1, s2, strict=True)
        ]
    )


def copies(df: DataFrame) -> DataFrame:
    """tab, keep_id, dup_id of rows (tab, id, source_type, title, url): each further copy with its group's first id."""
    rows = cut(copy_hashes(df).filter(F.col("h1").isNotNull()))
    groups = (
        rows.groupBy("tab", "h1", "h2")
        .agg(F.min("id").alias("keep_id"), F.max("id").alias("last_id"))
        .filter("keep_id < last_id")
        .drop("last_id")
    )
    # the first rows' fields ride along once for each salt; a hot group's rows spread over the salts
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    members = rows.withColumn("salt", salt).join(salted, ["tab", "h1", "h2", "salt"])
    firsts = (
        members.filter("id = keep_id")
        .groupBy("tab", "keep_id")
        .agg(*(F.min_by(c, F.struct("title", "url", "source_type")).alias(f"k_{c}") for c in ("title", "url", "source_type")))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    pairs = members.filter("id > keep_id").join(firsts, ["tab", "keep_id", "salt"])
    same = _same("title", "url", "source_type", "k_title", "k_url", "k_source_type")
    checked = pairs.select("tab", "keep_id", F.col("id").alias("dup_id"), same.alias("same")).select(
        "tab",
        "keep_id",
        "dup_id",
        F.when(F.col("same"), F.lit(True)).otherwise(F.raise_error(F.lit("hash collision between different records"))).alias("same"),
    )
    return checked.filter("same").select("tab", "keep_id", "dup_id").dropDuplicates(["tab", "dup_id"])


def p6_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "items").select(
        F.lit("items").alias("tab"), F.col("item_id").alias("id"), "source_type", "title", "url"
    )
    ledger = table(spark, sf_dir, "seen_items").select(
        F.lit("seen_items").alias("tab"),
        F.col("seen_id").alias("id"),
        F.lit("").alias("source_type"),
        F.col("key").alias("title"),
        F.lit(None).cast("string").alias("url"),
    )
    return items.unionByName(ledger)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(p6_rows(spark, sf_dir))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each group of copies: its first id and how many copies there are; single records count 1."""
    found = copies(p6_rows(spark, sf_dir))
    more = found.groupBy("tab", "keep_id").agg(F.count(F.lit(1)).alias("n"))
    ids = p6_rows(spark, sf_dir).select("tab", "id").distinct()
    kept = ids.join(found.select("tab", F.col("dup_id").alias("id")), ["tab", "id"], "left_anti")
    return kept.join(more.withColumnRenamed("keep_id", "id"), ["tab", "id"], "left").select(
        "tab", F.col("id").alias("keep_id"), (F.coalesce("n", F.lit(0)) + 1).alias("n_copies")
    )


QUERIES = {"p6_found": p6_found, "p6_counts": p6_counts}


def _f(x: str) -> str:
    return rf"regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', '', 'g')"


_GROUPS = rf"""
WITH i AS (SELECT item_id AS id, source_type, coalesce(title, '') AS title, coalesce(url, '') AS url FROM items),
u AS (SELECT *, regexp_extract(url, '(?s)^([^?#]*)(?:\?([^#]*))?(?:#(.*))?$', ['p', 'q', 'f']) AS u FROM i),
g AS (
  SELECT 'items' AS tab, id, {_f("title")} AS t, CASE WHEN trim(url) = '' THEN 'n' || {_f("source_type")} ELSE 'u' || {_f("url_decode(u.p)")} || '?' ||
    array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(u.q, '&'), lambda x: {_f("x")} <> ''),
      lambda x: {_f("url_decode(regexp_extract(x, '^([^=]*)', 1))")} || '=' || {_f("url_decode(regexp_extract(x, '(?s)=(.*)$', 1))")}))), '&')
    || '#' || {_f("url_decode(u.f)")} END AS k FROM u
  UNION ALL SELECT 'seen_items', seen_id, {_f("coalesce(key, '')")}, 'n' FROM seen_items),
k AS (SELECT tab, id, t, k, min(id) OVER (PARTITION BY tab, t, k) AS keep_id FROM g WHERE t <> '' OR k LIKE 'u_%')"""
ORACLES = {
    "p6_found": _GROUPS + " SELECT DISTINCT tab, keep_id, id AS dup_id FROM k WHERE id > keep_id",
    "p6_counts": _GROUPS + """ SELECT tab, keep_id, count(DISTINCT id) AS n_copies FROM k GROUP BY tab, keep_id
UNION ALL SELECT DISTINCT tab, id, 1 FROM g WHERE t = '' AND NOT k LIKE 'u_%'""",
}
