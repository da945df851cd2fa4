"""Garbled text from wrong character encoding (problem 10).

Method: noisy-channel decoding. A first pass over the whole corpus counts, for every non-ASCII character, in how many
documents it stands between which classes of neighbours, and in how many documents each word with a non-ASCII letter
stands: the language model. Spans that some channel decodes as UTF-8 are left out of it, so that garbling, however
frequent, does not speak for itself. A second pass looks at every document with non-ASCII text. For every channel
(UTF-8 read as one of several single-byte encodings, once or repeatedly, or one single-byte encoding read as another)
a span (a run of non-ASCII characters) becomes a lattice of bytes, with wildcards where a byte was lost (U+FFFD: the bytes
that the encoding leaves undefined; or the no-break space 0xA0 that was tidied to a space). A Viterbi search over the
lattice, whose states are the characters decoded last, gives the likeliest characters under the contexts, and readings of
a word with lost bytes are weighed by the frequencies of the words they make; the best channel of a document is taken for
its damaged spans.

Defined results:
* spans are decoded or left each by itself: a line may hold sound and damaged ones; a line is changed where that gains
* garbling shown between quotation marks in a sound line is an example and no case
* U+FFFD (or a character that no channel explains) outside such examples means that characters are lost for good: 'lost'
* of readings that the model cannot tell apart the one with the smallest code points is taken
* null and empty texts are sound; repeated rows give repeated results
"""

from __future__ import annotations

import functools
import itertools
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.runtime import table

# Encodings that text is wrongly read with, and those it is written with.
READ_AS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859-15", "cp1254", "koi8-r", "cp866", "iso8859-2"]
WRITTEN = ["cp1252", "mac_roman", "cp850", "cp437"]
#: Smallest share, and number, of documents of a context or word that the model keeps. The share bounds the model: no more
#: entries than the mean number of different ones in a document over it.
SHARE, LEAST = 0.0005, 2
#: Log-likelihood by which a channel must win.
MARGIN = 3.0
ROUNDS = 3
#: Share of documents of what the model does not know.
FLOOR = 1e-4
#: What a lost byte costs where the encoding leaves none undefined (something else must have lost it).
GUESSED = 10.0
#: Combinations of lost bytes (and of readings of one span) that are listed; more are sought among the model's characters
#: (the others all weigh the same).
LISTED = 4096
NON_ASCII = re.compile(r"[^\x00-\x7f]")
WORD = re.compile(r"[^\W\d_]*[^\x00-\x7f\W\d_][^\W\d_]*")
EXAMPLE = re.compile(r"[“\"«„‘'`(‹]\s?[^\s“”\"«»„`()‹›]{0,8}[^\x00-\x7f][^\s“”\"«»„`()‹›]{0,8}\s?[”\"»“’'`)›]")
EXAMPLE_SIGN = re.compile(r"[\x80-\x9f�ÃÂâÐÑΓ├┬√ÔРГв]")


def _kind(c: str) -> str:
    if not c or c.isspace():
        return "S"
    if c > "\x7f":
        return "n"
    return "l" if c.islower() else "U" if c.isupper() else "d" if c.isdigit() else "p"


def contexts(text: str) -> Iterator[str]:
    """Each non-ASCII character between the classes of its neighbours."""
    n = len(text)
    for m in NON_ASCII.finditer(text):
        i = m.start()
        yield _kind(text[i - 1] if i else "") + m[0] + _kind(text[i + 1] if i + 1 < n else "")


def accented(text: str) -> list[str]:
    """The words with a non-ASCII letter."""
    return [w for t in text.split() if not t.isascii() for w in WORD.findall(t)]


class Model:
    def __init__(self, n: int, chars: dict[str, int], words: dict[str, int]):
        self.n = max(1, n)
        self.log = {k: math.log(v / self.n) for k, v in chars.items()}
        self.floor = math.log(FLOOR)
        #: by how much a known word is likelier than an unknown one
        self.words = {w: x for w, v in words.items() if (x := math.log(v / self.n) - self.floor) > 0}
        self.char: dict[str, float] = {}
        for k, v in chars.items():
            self.char[k[1]] = max(self.char.get(k[1], self.floor), math.log(v / self.n))
        self.in_word: dict[str, float] = {}
        for w, x in self.words.items():
            for c in set(NON_ASCII.findall(w + w.upper() + w.title())):
                self.in_word[c] = max(self.in_word.get(c, 0.0), x)
        self.encoded = [(c.encode(), c) for c in sorted(self.char)]
        self.memo: dict[str, dict[str, str | None]] = {n: {} for n in READ_AS}
        self.readable: dict[str, tuple[frozenset[str], frozenset[str]]] = {}
        self.tokens: dict[str, tuple[float, np.ndarray, np.ndarray]] = {}
        self.gains: dict[tuple[str, int], float] = {}
        self.bounds: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def at_most(self, c: str) -> float:
        """What a character adds to a score at most, as the sole non-ASCII letter of a known word."""
        return (0.0 if c == "\xa0" else max(self.floor, self.char.get(c, self.floor))) + self.in_word.get(c, 0.0)

    def bound(self, c: str) -> tuple[np.ndarray, np.ndarray]:
        """Of each channel of SINGLE: what the character it turns ``c`` into adds at most (a no-break space out of nothing costs
        as much as an unknown character), and whether that is another one."""
        if c not in self.bounds:
            to = [_pairs(*x).get(c) for x in SINGLE]
            most = [-1e9 if t is None else self.floor if t == "\xa0" != c else self.at_most(t) for t in to]
            self.bounds[c] = np.array(most), np.array([t is not None and t != c for t in to])
        return self.bounds[c]

    def channels_of(self, run: str) -> tuple[frozenset[str], frozenset[str]]:
        """The encodings as which all of a run may have been read, and those as which a part of it may that makes characters
        the corpus knows (kept: runs come again)."""
        got = self.readable.get(run)
        if got is None:
            if len(self.readable) > 200_000:
                self.readable.clear()
            fits, known = set(), set()
            for n in READ_AS:
                wider = run if run.endswith(" ") else run + " "
                spans = [run[i:j] for i, j in pieces(run, n, self)]
                if spans == [run] or _fits(wider, n, self):
                    fits.add(n)
                    spans = spans or [wider]
                if any("\ufffd" in x or self.knows(_to_its_end(x, n, self)) for x in spans):
                    known.add(n)
            got = self.readable[run] = frozenset(fits), frozenset(known)
        return got

    def knows(self, text: str) -> bool:
        return all(c in self.char or c == "\xa0" for c in text if c > "\x7f")

    def token(self, t: str) -> tuple[float, np.ndarray, np.ndarray]:
        """Score of a piece between spaces, the most that each channel of SINGLE can make of it, and whether it changes it."""
        got = self.tokens.get(t)
        if got is None:
            if len(self.tokens) > 100_000:
                self.tokens.clear()
                self.gains.clear()
            most, moved = np.zeros(len(SINGLE)), np.zeros(len(SINGLE), bool)
            for c in NON_ASCII.findall(t):
                m, other = self.bound(c)
                most, moved = most + m, moved | other
            got = self.tokens[t] = self.score(t), most - self.floor * t.count("\xa0"), moved
        return got

    def gain(self, t: str, k: int) -> float:
        """What a channel of SINGLE gains on a piece between spaces, new no-break spaces not counted."""
        key = (t, k)
        got = self.gains.get(key)
        if got is None:
            to = undo_single(t, *SINGLE[k])
            got = self.gains[key] = -1e9 if to is None else self.score(to) - self.token(t)[0]
        return got

    def context(self, before: str, c: str, after: str) -> float:
        return 0.0 if c == "\xa0" else self.log.get(before + c + after, self.floor)

    def score(self, text: str) -> float:
        """Log-likelihood of the non-ASCII characters (no-break spaces stand anywhere) and of the words that hold any."""
        get, words = self.log.get, self.words
        s = sum(get(c, self.floor) for c in contexts(text) if c[1] != "\xa0")
        return s + sum(words.get(w.lower(), 0.0) for w in accented(text))


@functools.lru_cache(64)
def _encoder(name: str) -> dict[str, int]:
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b  # undefined bytes pass as control characters
    return out


@functools.lru_cache(64)
def _decoder(name: str) -> dict[int, str]:
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            out[b] = ""
    return out


@functools.lru_cache(64)
def _pairs(read_as: str, written: str) -> dict[str, str]:
    """Each character that was read and the one that was written."""
    dec = _decoder(written)
    return {c: dec[b] for c, b in _encoder(read_as).items() if dec[b]}


SINGLE = [(r, w) for r in READ_AS for w in WRITTEN if r != w and {r, w} != {"cp1252", "latin-1"}]


@functools.lru_cache(64)
def undefined_bytes(name: str) -> tuple[int, ...]:
    dec = _decoder(name)
    return tuple(b for b in range(0x80, 0xC0) if not dec[b])


def lost_bytes(name: str) -> tuple[int, ...]:
    """Bytes that a reader of the encoding cannot show: those it leaves undefined; of a full encoding any further byte of UTF-8."""
    return undefined_bytes(name) or tuple(range(0x80, 0xC0))


#: A span: non-ASCII characters, and the space behind them that may once have been a no-break space.
RUN = re.compile(r"[^\x00-\x7f]+(?: (?=[^\x00-\x7f]| ))?")


def _units(options: list[tuple[int, ...]], i: int, size: int, model: Model) -> list[str]:
    """The characters that ``size`` bytes from place i may be."""
    first = {2: range(0xC2, 0xE0), 3: range(0xE0, 0xF0), 4: range(0xF0, 0xF5)}[size]
    sets = [[b for b in options[i] if b in first], *([b for b in o if 0x80 <= b < 0xC0] for o in options[i + 1 : i + size])]
    total = math.prod(map(len, sets))
    if not total:
        return []
    if total <= LISTED:
        raw = [bytes(x) for x in itertools.product(*sets)]
    else:
        raw = [e for e, _ in model.encoded if len(e) == size and all(x in o for x, o in zip(e, sets, strict=True))] or [bytes(o[0] for o in sets)]
    out = []
    for x in raw:
        try:
            c = x.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if c.isprintable() or c in "\xa0\xad" or "\x80" <= c <= "\x9f" or c.isspace():
            out.append(c)
    return out


def _utf8(options: list[tuple[int, ...]], model: Model, before: str, after: str) -> list[str]:
    """Readings of a lattice (the possible bytes of each place) as whole UTF-8 characters between two kinds of neighbours: all
    of them if they can be listed, else the likeliest by Viterbi, the state being the character decoded last."""
    n = len(options)
    units: list[dict[int, list[str]]] = [{} for _ in range(n)]
    ends = [False] * n + [True]  # places from which the rest can be read
    for i in range(n - 1, -1, -1):
        for size in (2, 3, 4):
            if i + size <= n and ends[i + size] and (got := _units(options, i, size, model)):
                units[i][size] = got
                ends[i] = True
    if not ends[0]:
        return []
    count = [0] * n + [1]
    for i in range(n - 1, -1, -1):
        count[i] = sum(len(got) * count[i + size] for size, got in units[i].items())
    if count[0] <= LISTED:
        texts: list[list[str]] = [[] for _ in range(n)] + [[""]]
        for i in range(n - 1, -1, -1):
            texts[i] = [c + rest for size, got in units[i].items() for c in got for rest in texts[i + size]]
        return texts[0]
    # a non-ASCII neighbour is of kind n, whichever it is: the state need not remember more than what ends where
    best: list[tuple[float, str] | None] = [(0.0, "")] + [None] * n
    for i in range(n):
        if best[i] is None:
            continue
        for size, got in units[i].items():
            a, z = before if i == 0 else "n", after if i + size == n else "n"
            w, c = max(((model.context(a, c, z), c) for c in got), key=lambda x: (x[0], -ord(x[1])))
            old = best[i + size]
            if old is None or best[i][0] + w > old[0]:
                best[i + size] = (best[i][0] + w, best[i][1] + c)
    return [best[n][1]]


def _read(run: str, name: str, model: Model, before: str = "", after: str = "") -> list[str]:
    enc, options = _encoder(name), []
    for c in run:
        b = enc.get(c)
        if b is not None:
            options.append((b,))
        elif c == "\ufffd":
            options.append(lost_bytes(name))
        elif c == " ":
            options.append((0xA0,))
        else:
            return []
    return _utf8(options, model, _kind(before), _kind(after))


def _sure(run: str, name: str, model: Model) -> str | None:
    """The span as ``name`` was to be read, if no byte is lost (kept: spans come again)."""
    known = model.memo[name]
    if run in known:
        return known[run]
    got = _read(run, name, model)
    if len(known) > 200_000:
        known.clear()
    known[run] = got[0] if got else None
    return known[run]


def _fits(run: str, name: str, model: Model) -> bool:
    return bool(_read(run, name, model)) if "\ufffd" in run else _sure(run, name, model) is not None


def pieces(run: str, name: str, model: Model) -> list[tuple[int, int]]:
    """The parts of a run that decode: all of it (but perhaps for a space behind), else the longest ones from the left, sound
    characters between them."""
    if _fits(run, name, model):
        return [(0, len(run))]
    if len(run) < 3 and not run.endswith(" "):
        return []
    out, i = [], 0
    while i < len(run) - 1:
        j = next((j for j in range(len(run), i + 1, -1) if run[i:j] != run and _fits(run[i:j], name, model)), None)
        if j is None:
            i += 1
        else:
            out.append((i, j))
            i = j
    return out


def _to_its_end(span: str, name: str, model: Model) -> str:
    """A span (without lost bytes) that was read as ``name`` so often, or what one reading gives of a longer one."""
    t = _sure(span, name, model) or span
    for _ in range(ROUNDS - 1):
        if RUN.fullmatch(t) is None or (u := _sure(t, name, model)) is None:
            break
        t = u
    return t


def undo_utf8(line: str, name: str, model: Model) -> tuple[str, bool] | None:
    """The line with its spans read anew that decode, their UTF-8 bytes having been read as ``name``, and whether all do; None
    if none does. Where sound characters stand beside damaged spans, a span is read anew only if that makes it likelier and
    gives characters that the corpus knows."""
    fresh: list[tuple[int, int, list[str]]] = []
    whole = True
    for m in RUN.finditer(line):
        run, at, end = m[0], m.start(), m.end()
        if line[end : end + 1] == " " and not run.endswith(" ") and not _fits(run, name, model) and _fits(run + " ", name, model):
            parts, end = [(0, len(run) + 1)], end + 1
        else:
            parts = pieces(run, name, model)
        covered = sum(j - i for i, j in parts)
        whole &= covered >= len(run.rstrip(" "))
        for i, j in parts:
            span = line[at + i : at + j]
            fresh.append((at + i, at + j, _read(span, name, model, line[at + i - 1 : at + i], line[at + j : at + j + 1]) if "\ufffd" in span else [_sure(span, name, model)]))
    if not fresh:
        return None
    out, last = [], 0
    for at, end, got in fresh:
        a, z = line[max(0, at - 12) : at], line[end : end + 12]
        t = got[0] if len(got) == 1 else max(got, key=lambda t: (model.score(a + t + z), [-ord(c) for c in t]))
        if not whole:  # beside sound characters a span is read to its end before it is judged
            t = _to_its_end(t, name, model) if "\ufffd" in line[at:end] else _to_its_end(line[at:end], name, model)
            if not model.knows(t) or model.score(a + t + z) <= model.score(a + line[at:end] + z):
                continue
        out += [line[last:at], t]
        last = end
    return ("".join([*out, line[last:]]), whole) if out else None


FLAT = Model(1, {}, {})


def undo_single(line: str, read_as: str, written: str) -> str | None:
    pairs = _pairs(read_as, written)
    if not all(c in pairs for c in NON_ASCII.findall(line)):
        return None
    return NON_ASCII.sub(lambda m: pairs[m[0]], line)


def without_examples(line: str) -> str:
    """The line without garbling that it quotes."""
    return EXAMPLE.sub(lambda m: " " if EXAMPLE_SIGN.search(m[0]) else m[0], line)


def restore(text: str, model: Model) -> str | None:
    """None: sound. 'lost' in the second place: characters are gone. Else the restored text."""
    lines = text.split("\n")
    looks = [i for i, s in enumerate(lines) if NON_ASCII.search(s)]
    seen = {i: without_examples(lines[i]) for i in looks}
    looks = [i for i in looks if NON_ASCII.search(seen[i])]
    # UTF-8 read as a single-byte encoding
    best: tuple[float, str, dict[int, str]] = (0.0, "", {})
    names: dict[int, frozenset[str]] = {}
    for i in looks:
        each = [model.channels_of(m[0]) for m in RUN.finditer(lines[i])]
        names[i] = frozenset.intersection(*(fits for fits, _ in each)).union(*(known for _, known in each))
    some = set().union(*names.values())
    for name in (n for n in READ_AS if n in some):
        gains, done = 0.0, {}
        for i in looks:
            if name not in names[i]:
                continue
            s, bare = lines[i], seen[i]
            if bare != s and undo_utf8(bare, name, model) is None:
                continue
            got = undo_utf8(s, name, model)
            rounds = 0
            while got is not None and rounds < ROUNDS:
                done[i] = got[0]
                rounds += 1
                if undo_utf8(without_examples(got[0]), name, model) is None:
                    break
                got = undo_utf8(got[0], name, model)
            if i in done:
                gain = model.score(done[i]) - model.score(s)
                if "\ufffd" in s and not undefined_bytes(name):
                    gain -= GUESSED * (s.count("\ufffd") - done[i].count("\ufffd"))
                if gain > 0:
                    gains += gain
                else:
                    del done[i]
        if done and gains > best[0]:
            best = (gains, name, done)
    fixed = dict(best[2])
    # one single-byte encoding read as another
    rest = [i for i in looks if i not in fixed and "�" not in seen[i]]
    channels: list[tuple[float, dict[int, str]]] = []
    # both the score and what a channel changes add up over the pieces between spaces
    split = {i: [t for t in seen[i].split(" ") if not t.isascii()] for i in rest}
    bounds: dict[int, np.ndarray] = {}
    for i in rest:
        parts = [model.token(t) for t in split[i]]
        most, moved = sum(p[1] for p in parts) - sum(p[0] for p in parts), functools.reduce(np.logical_or, [p[2] for p in parts])
        # no line gains more than its characters can, and one that a channel leaves as it is gains nothing
        bounds[i] = np.where(moved, np.maximum(most, 0), 0)
    hopeful = np.flatnonzero(sum(bounds.values()) > MARGIN) if bounds else []
    for k in hopeful:
        gains, done = 0.0, {}
        for i in (i for i in rest if bounds[i][k] > 0):
            g = sum(model.gain(t, k) for t in split[i])
            if g <= 0:
                continue
            t = undo_single(seen[i], *SINGLE[k])
            g += model.floor * max(0, t.count("\xa0") - seen[i].count("\xa0"))
            if g > 0 and (whole := undo_single(lines[i], *SINGLE[k])) is not None:
                gains += g
                done[i] = whole
        if gains > MARGIN:
            channels.append((gains, done))
    if channels:
        fixed.update(max(channels, key=lambda c: c[0])[1])
    lost = any("�" in seen[i] and "�" in without_examples(fixed.get(i, lines[i])) for i in looks)
    if lost:
        return "lost"
    if not fixed:
        return None
    return "\n".join(fixed.get(i, s) for i, s in enumerate(lines))


# Latin letters and the typographic signs that texts in Latin script use.
LATIN = re.compile(r"[\x00-\u024f\u1e00-\u1eff\u2000-\u20cf\u2122]+")


def sound(line: str) -> str:
    """What of a line speaks for the language: nothing if one channel decodes all its spans; else the line without the spans of
    two and more characters that some channel decodes to Latin text (other readings of sound spans come about by chance)."""
    runs = [m[0] for m in RUN.finditer(line)]
    if any(len(r.rstrip(" ")) > 1 for r in runs) and any(all(_sure(r, n, FLAT) is not None for r in runs) for n in READ_AS):
        return ""
    some = {r: any((t := _sure(r, n, FLAT)) is not None and LATIN.fullmatch(t) for n in READ_AS) for r in runs if len(r.rstrip(" ")) > 1}
    return RUN.sub(lambda m: " " if some.get(m[0]) else m[0], line)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    chars, words, n = Counter(), Counter(), 0
    for b in batches:
        for t in b["text"]:
            n += 1
            if t and not t.isascii():
                lines = [sound(s) for s in t.split("\n") if not s.isascii()]
                chars.update({c for s in lines for c in contexts(s)})
                words.update({w.lower() for s in lines for w in accented(s)})
    rows = [("n", "", n), *(("c", k, v) for k, v in chars.items()), *(("w", k, v) for k, v in words.items())]
    yield pd.DataFrame(rows, columns=["kind", "token", "n"])


def corpus_model(documents: DataFrame) -> tuple[int, dict[str, int], dict[str, int]]:
    """Counts over all documents but for spans that decode, kept from a share of SHARE upward (which bounds what the driver receives)."""
    got = documents.select("text").mapInPandas(_counts, "kind string, token string, n long")
    sums = got.groupBy("kind", "token").agg(F.sum("n").alias("n"))
    total = documents.count()
    least = max(LEAST, SHARE * total)
    rows = sums.filter((F.col("kind") != "n") & (F.col("n") >= least)).collect()
    return total, {r.token: r.n for r in rows if r.kind == "c"}, {r.token: r.n for r in rows if r.kind == "w"}


@functools.lru_cache(2)
def _model(data: bytes) -> Model:
    return Model(*pickle.loads(data))


def restored(documents: DataFrame) -> DataFrame:
    """doc_id, restored (null if lost), of the documents (doc_id, text) with wrongly decoded text."""
    spark = documents.sparkSession
    data = spark.sparkContext.broadcast(pickle.dumps(corpus_model(documents)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(data.value)
        for b in batches:
            ids, out = [], []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                if not t or t.isascii():
                    continue
                r = restore(t, model)
                if r is not None and r != t:
                    ids.append(i)
                    out.append(None if r == "lost" else r)
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "restored": pd.Series(out, dtype="object")})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, restored string")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = restored(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.coalesce(F.md5("restored"), F.lit("lost")).alias("restored_md5"))


def p10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected documents of each source, and how many of them could not be restored."""
    docs = table(spark, sf_dir, "documents")
    got = restored(docs).select("doc_id", F.col("restored").isNull().alias("lost"))
    return (
        docs.select("doc_id", "source")
        .join(got, "doc_id", "left")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_documents"), F.count("lost").alias("n_garbled"), F.count_if("lost").alias("n_lost"))
    )


QUERIES = {"p10_found": p10_found, "p10_report": p10_report}
