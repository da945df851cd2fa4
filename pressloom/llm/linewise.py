"""Lines of many texts at once: code points of a whole Arrow batch in NumPy, no Python loop over lines or words.

A chunk of texts is one array of code points. Lines, words, hashed n-grams and the form of each line come out of class
tables, prefix sums and sorts. The operators on residue (2), page furniture (3) and truncation (7) score all their lines
through it. Whole texts are read, whatever their length; a chunk holds about CHUNK code points or one longer text.

Words: runs of letters (an apostrophe between letters belongs to them), runs of digits, every other visible character
alone. Capitalised words after a line's first count as names and are masked; runs of names count as one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

#: Hash space of n-gram features, and code points of a chunk.
DIM, CHUNK = 1 << 16, 1_000_000
#: No letter or digit stands above this code point.
TOP = 0x33000
SPACE, LETTER, DIGIT, OTHER = range(4)
UPPER, LOWER, STOP, WORDLY, RULED, BARRED, SIGN, QUOTE = (1 << k for k in range(8))
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_U = np.uint64
NAME = _U(0x5851F42D4C957F2D)
NUMBER = _U(0x14057B7EF767814F)


@functools.lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, flags and random value (of the lower-case form) of each code point."""
    kind, flags, lower = np.full(TOP, OTHER, np.uint8), np.zeros(TOP, np.uint8), np.arange(TOP, dtype=np.int64)
    for c in range(TOP):
        ch = chr(c)
        if ch.isspace():
            kind[c] = SPACE
        elif ch.isdecimal():
            kind[c] = DIGIT
        elif ch.isalnum():
            kind[c] = LETTER
            small = ch.lower()
            lower[c] = ord(small[0]) if ord(small[0]) < TOP else c
            flags[c] = UPPER * ch.isupper() + LOWER * ch.islower()
        if ch.isalnum() or ch == "_":
            flags[c] |= WORDLY
    for chars, flag in ((".!?", STOP), ("|·/>»•—", RULED), ("|·>", BARRED), ("©@", SIGN), ("“\"«„‘'`‹(", QUOTE)):
        for ch in chars:
            flags[ord(ch)] |= flag
    value = np.random.default_rng(20240607).integers(1, 2**63, TOP, dtype=np.uint64) | _U(1)
    return kind, flags, value[lower]


@functools.lru_cache(4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    out = []
    with np.errstate(over="ignore"):
        for b in (BASE, INVERSE):
            p = np.full(n, _U(b))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h ^ _U(salt)) * _U(0xFF51AFD7ED558CCD)
        x ^= x >> _U(32)
        x *= _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(29))


class Words:
    """Words of an array of code points: where they start and end, kinds, hashes, which are capitalised."""

    def __init__(self, cp: np.ndarray):
        kinds, flags, values = tables()
        low = np.minimum(cp, TOP - 1)
        high = cp >= TOP
        self.kind, self.flag = kinds[low], flags[low]
        value = values[low]
        if high.any():
            self.kind[high], self.flag[high] = OTHER, 0
            value[high] = mixed(cp[high].astype(np.uint64), 1)
        kind, n = self.kind, len(cp)
        letter = kind == LETTER
        inner = np.zeros(n, bool)
        if n > 2:
            inner[1:-1] = ((cp[1:-1] == 0x27) | (cp[1:-1] == 0x2019)) & letter[:-2] & letter[2:]
        joined = letter | inner
        start = kind != SPACE
        if n:
            run = np.where(joined, LETTER, kind)
            start[1:] &= (run[1:] != run[:-1]) | (run[1:] == OTHER)
        self.start = np.flatnonzero(start)
        m = len(self.start)
        with np.errstate(over="ignore"):
            up, down = _powers(max(4, int(n).bit_length()))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(np.where(kind == SPACE, _U(0), value * up[:n]), out=sums[1:])
            end = np.append(self.start[1:], n)
            # a word ends where the next one starts or at the first space before it
            spaces = np.flatnonzero(kind == SPACE)
            at = np.searchsorted(spaces, self.start)
            nearest = np.append(spaces, n)[at]
            self.end = np.minimum(end, nearest)
            self.hash = mixed((sums[self.end] - sums[self.start]) * down[self.start])
        first = self.start
        self.digit = kind[first] == DIGIT
        self.word = self.digit | (kind[first] == LETTER)
        lowers = np.append(0, np.cumsum((self.flag & LOWER) > 0))
        small = lowers[self.end] - lowers[self.start]
        self.name = ((self.flag[first] & UPPER) > 0) & ((small > 0) | (self.end - self.start == 1)) if m else np.zeros(0, bool)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Lines:
    """The non-blank lines of texts, trimmed: page (index of the text), no (from 1, blank ones count), start, end, and

    form: (lines, FORM) numbers that describe a line by itself; flat, starts: its hashed n-grams (each once), in DIM."""

    FORM = 13

    def __init__(self, texts: list[str | None], titles: list[str | None] | None = None):
        texts = [t or "" for t in texts]
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.cp = cp = code_points("\n".join(texts))
        self.words = w = Words(cp)
        breaks = np.flatnonzero(cp == 10)
        begin, stop = np.append(0, breaks + 1), np.append(breaks, len(cp))
        firsts = np.cumsum(sizes + 1) - (sizes + 1)  # where each text starts
        page = np.searchsorted(firsts, begin, side="right") - 1
        of_first = np.searchsorted(begin, firsts)
        no = np.arange(len(begin)) - of_first[page] + 1 if len(texts) else np.zeros(0, np.int64)
        solid = np.flatnonzero(w.kind != SPACE)
        i, j = np.searchsorted(solid, begin), np.searchsorted(solid, stop)
        keep = i < j
        self.page, self.no = page[keep], no[keep]
        self.start, self.end = solid[i[keep]], solid[j[keep] - 1] + 1
        self.n, self.pages = len(self.page), len(texts)
        self.w0, self.w1 = np.searchsorted(w.start, self.start), np.searchsorted(w.start, self.end)
        self._grams()
        self._form(titles)

    def strings(self) -> list[str]:
        text = self.cp.tobytes().decode("utf-32-le", "surrogatepass")
        return [text[a:b] for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)]

    def _of_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Index of each word of a line, and its line."""
        count = self.w1 - self.w0
        line = np.repeat(np.arange(self.n), count)
        return np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.w0, count), line

    def _grams(self) -> None:
        w = self.words
        word, line = self._of_words()
        self.word, self.line = word, line
        h, first = w.hash[word], np.zeros(len(word), bool)
        if len(word):
            first[0] = True
            first[1:] = line[1:] != line[:-1]
        name = w.name[word] & ~first
        names = np.bincount(line, name, self.n)
        drop = np.zeros(len(word), bool)
        if len(word):
            drop[1:] = name[1:] & name[:-1] & ~first[1:]
        h = np.where(name, NAME, np.where(w.digit[word], NUMBER, h))[~drop]
        line = line[~drop]
        n_words = np.bincount(line, minlength=self.n)
        with np.errstate(over="ignore"):
            same = line[1:] == line[:-1]
            two = mixed(h[:-1] * _U(1000003) ^ h[1:], 2)[same]
            ends = np.cumsum(n_words)
            a, b = mixed(h[ends - n_words], 3), mixed(h[ends - 1], 4)
        flag, size = w.flag, self.end - self.start
        last = self.cp[self.end - 1] if self.n else np.zeros(0, np.uint32)
        tail = np.where(flag[self.end - 1] & WORDLY > 0, 0, last) if self.n else last
        lowers, uppers = (np.append(0, np.cumsum((flag & f) > 0)) for f in (LOWER, UPPER))
        self.shout = (lowers[self.end] == lowers[self.start]) & (uppers[self.end] > uppers[self.start])
        forms = [
            np.minimum(np.frexp(size)[1], 10) + 0x51000, tail.astype(np.int64) + 0x520000, np.minimum(names, 4).astype(np.int64) + 0x53000,
            np.minimum(n_words, 12) + 0x54000, self.shout + 0x55000,
        ]
        own = np.arange(self.n)
        # for window sums: each kept word's own n-gram and the pair it ends
        self.gram_line, self.gram_one = line, (h >> _U(48)).astype(np.int64)
        self.gram_two = np.full(len(h), -1, np.int64)
        if len(h):
            self.gram_two[1:][same] = (two >> _U(48)).astype(np.int64)
        all_h = np.concatenate([h, two, a, b, *(mixed(x.astype(np.uint64), 5) for x in forms)])
        all_line = np.concatenate([line, line[1:][same], own, own, *[own] * len(forms)])
        key = np.sort((all_line.astype(np.uint64) << _U(16)) | (all_h >> _U(48)))
        if len(key):
            key = key[np.append(True, key[1:] != key[:-1])]
        self.of, self.flat = (key >> _U(16)).astype(np.int64), (key & _U(DIM - 1)).astype(np.int64)
        self.starts = np.searchsorted(self.of, own)

    def _form(self, titles: list[str | None] | None) -> None:
        """size, words, size a word, sentence end, list mark, separators, digits, share of the title's words in the line and
        of the line's in the title, first letter capital, colon or comma at the end, all capitals, sign."""
        w, n, cp, flag, kind = self.words, self.n, self.cp, self.words.flag, self.words.kind
        f = self.form = np.zeros((n, self.FORM), np.float32)
        if not n:
            return
        space = kind == SPACE
        before, after = np.append(True, space[:-1]), np.append(space[1:], True)
        count = lambda mask: (lambda c: c[self.end] - c[self.start])(np.append(0, np.cumsum(mask)))
        f[:, 0] = self.end - self.start
        f[:, 1] = count(space) + 1
        f[:, 2] = f[:, 0] / f[:, 1]
        open_, ends = np.ones(n, bool), np.zeros(n, bool)
        for k in range(4):  # a full stop with at most three characters behind it, none of a word
            at = np.maximum(self.end - 1 - k, self.start)
            ends |= open_ & ((flag[at] & STOP) > 0)
            open_ &= (flag[at] & WORDLY) == 0
        f[:, 3] = ends
        first, second = self.start, np.minimum(self.start + 1, len(cp) - 1)
        mark = np.isin(cp[first], np.array([ord(c) for c in "-*•–·‣"], np.uint32)) & space[second] & (self.end - self.start > 1)
        number = w.digit[self.w0] & (np.isin(cp[np.minimum(w.end[self.w0], len(cp) - 1)], (0x2E, 0x29))) & space[np.minimum(w.end[self.w0] + 1, len(cp) - 1)]
        f[:, 4] = mark | number
        f[:, 5] = count(((flag & RULED) > 0) & before & after | ((flag & BARRED) > 0) | space & ~before & after)
        f[:, 6] = count(kind == DIGIT) > 0
        if titles is not None:
            f[:, 7], f[:, 8] = self._title_overlap(titles)
        f[:, 9] = (flag[first] & UPPER) > 0
        f[:, 10] = np.isin(cp[self.end - 1], (0x3A, 0x2C))
        f[:, 11] = self.shout
        f[:, 12] = count((flag & SIGN) > 0) > 0

    def _title_overlap(self, titles: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Share of each line's words that the title holds, and share of the title's different words that the line holds."""
        cp = code_points("\n".join((x or "").replace("\n", " ") for x in titles))
        tw = Words(cp)
        page = np.searchsorted(np.flatnonzero(cp == 10), tw.start)
        ok = tw.word
        with np.errstate(over="ignore"):
            own = np.unique(mixed(tw.hash[ok] + page[ok].astype(np.uint64) * _U(0xD6E8FEB86659FD93), 6))
            # of which page each of the title's different words is
            key = mixed(tw.hash[ok] + page[ok].astype(np.uint64) * _U(0xD6E8FEB86659FD93), 6)
            where = np.unique(key, return_index=True)[1]
            total = np.bincount(page[ok][where], minlength=self.pages)
            sel = self.words.word[self.word]
            word, line = self.word[sel], self.line[sel]
            mine = mixed(self.words.hash[word] + self.page[line].astype(np.uint64) * _U(0xD6E8FEB86659FD93), 6)
        at = np.minimum(np.searchsorted(own, mine), max(0, len(own) - 1))
        hit = own[at] == mine if len(own) else np.zeros(len(mine), bool)
        n_words = np.bincount(line, minlength=self.n)
        within = np.bincount(line, hit, self.n) / np.maximum(n_words, 1)
        pair = np.unique((line[hit].astype(np.uint64) << _U(32)) | at[hit].astype(np.uint64))
        cover = np.bincount((pair >> _U(32)).astype(np.int64), minlength=self.n) / np.maximum(total[self.page], 1)
        return within, cover

    def hashes(self) -> np.ndarray:
        """Hash of each folded line (digit runs as one digit, runs of space as one, case ignored)."""
        h = np.where(self.words.digit[self.word], NUMBER, self.words.hash[self.word])
        with np.errstate(over="ignore"):
            count = self.w1 - self.w0
            pos = np.arange(len(self.word)) - np.repeat(np.cumsum(count) - count, count)
            up = _powers(max(4, int(pos.max(initial=0) + 1).bit_length()))[0]
            # a space before the word is part of the line's form
            gap = np.append(True, self.words.kind[:-1] == SPACE)[self.words.start[self.word]]
            return mixed(np.add.reduceat((h + gap.astype(np.uint64)) * up[pos], np.cumsum(count) - count)) if self.n else np.zeros(0, np.uint64)

    def logp(self, weights: np.ndarray) -> np.ndarray:
        """(lines, classes) log-probabilities under the line model."""
        if not self.n:
            return np.zeros((0, weights.shape[1]), np.float32)
        z = np.add.reduceat(weights[self.flat], self.starts, axis=0) + weights[-1]
        z -= z.max(axis=1, keepdims=True)
        return (z - np.log(np.exp(z).sum(axis=1, keepdims=True))).astype(np.float32)


    def peaks(self, weight: np.ndarray, window: int = 6) -> np.ndarray:
        """Of each page the largest sum of ``weight`` (by n-gram) over ``window`` words of a line: what stands out inside long lines."""
        out = np.zeros(self.pages)
        n = len(self.gram_one)
        if not n:
            return out
        own = weight[self.gram_one] + np.where(self.gram_two >= 0, weight[self.gram_two], 0)
        sums = np.append(0, np.cumsum(own, dtype=float))
        first = np.searchsorted(self.gram_line, np.arange(self.n))
        at = np.arange(n)
        got = sums[at + 1] - sums[np.maximum(at + 1 - window, first[self.gram_line])]
        out[:] = got.min()
        np.maximum.at(out, self.page[self.gram_line], got)
        return out


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices (from, to) of about CHUNK code points; a longer text has a slice of its own."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > CHUNK:
            yield lo, i
            lo, size = i, 0
        size += n + 1
    if lo < len(texts):
        yield lo, len(texts)


def in_chunks(texts: list[str | None], titles: list[str | None] | None = None) -> Iterator[tuple[int, int, Lines]]:
    """(from, to, lines) of each chunk: what is kept of it must be small."""
    for lo, hi in chunks(texts):
        yield lo, hi, Lines(texts[lo:hi], titles[lo:hi] if titles is not None else None)
