"""What the lines of a page are: shared by the operators on residue (2), page furniture (3) and truncation (7).

A page is read as a small tree: the text, its blocks (runs of lines of one form), its lines. A softmax regression over
hashed n-grams gives every line's likeliest kind. It is trained on weak labels of a bounded, hash-chosen sample of
items (SAMPLE): phrases of error pages and template slots, lines that a source repeats, titles, sentences.
"""

from __future__ import annotations

import functools
import pickle
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from pressloom.llm.learn import softmax_regression, tokens
from pressloom.llm.linewise import DIM, Lines, in_chunks

#: Most items of the training sample.
SAMPLE = 5000
PROSE, HEADLINE, SUBHEAD, FURNITURE, RESIDUE = range(5)
KINDS = 5

# Placeholder syntaxes of common template languages.
SLOT = re.compile(
    r"\{\{\{?[^{}\n]{1,200}\}?\}\}|\{%[^%\n]{1,200}%\}|<%=?[^%\n]{1,200}%>|\$\{[^}\n]{1,200}\}|#\{[^}\n]{1,200}\}|%%[\w .|:-]{1,200}%%"
    r"|%\([\w .|:-]{1,200}\)[sd]|\[\[[^\]\n]{1,200}\]\]|\[%[^%\n]{1,200}%\]|\*\|[^|\n]{1,120}(?:\|[^|\n]{1,120})?\|\*|<!--[^>\n]{1,200}-->"
    r"|@@[^@\n]{1,200}@@|__[a-zA-Z][\w. |:-]{1,200}?__|\$[a-zA-Z][\w .|:-]{1,200}\$|\{[a-zA-Z][\w .|:-]{1,120}\}"
)
SIGN = re.compile(r"[{}%$@\]>*_]")
QUOTE = "“\"«„‘'`‹("
# Phrases of error pages, blocked access, script notices, filler and editing marks, in the feeds' languages.
PHRASES = re.compile(
    r"(?i)\b(?:page not found|not found on this server|404 not found|40[0-9] (?:error|forbidden)|50[0-9] (?:bad gateway|service|internal|gateway)|http/\d\.\d [45]\d\d"
    r"|internal server error|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|temporarily unavailable|try again (?:in|later)|access denied|permission to access"
    r"|request blocked|you have been blocked|too many requests|fatal error|uncaught exception|timeouterror|timed out|connection failed|errno|stack trace|traceback"
    r"|down for maintenance|be back shortly|session has expired|sitzung ist abgelaufen|session (?:a|est) expiré|sesión ha (?:caducado|expirado)|sessão expirou|nothing to see here|something went wrong|can.t find the page|page you are looking for|you requested (?:has|was|is|could)|no longer (?:available|exists)|(?:has been|was) (?:removed|deleted) or|failed to open stream|couldn.t load|sample post|edit or delete it"
    r"|enable (?:javascript|scripts|cookies|js)|javascript (?:is )?(?:turned on|required|disabled|to continue)|without scripts enabled|turn on js|requires? (?:a modern browser|javascript)"
    r"|checking your browser|verify you are human|complete the captcha|<title>error"
    r"|page introuvable|n’existe pas|n'existe pas|accès refusé|une erreur est survenue|momentanément indisponible|activer javascript|activez javascript|texte factice|texte provisoire"
    r"|seite nicht gefunden|existiert nicht|zugriff verweigert|interner serverfehler|ein fehler ist aufgetreten|vorübergehend nicht|aktivieren sie javascript|platzhaltertext|blindtext"
    r"|página no encontrada|no existe\.|acceso denegado|se ha producido un error|no disponible|active javascript|texto de relleno|texto provisional"
    r"|página não encontrada|não existe\.|acesso negado|ocorreu um erro|indisponível|ative o javascript|texto provisório"
    r"|lorem|ipsum|asdf|placeholder|\[object object\])"
)
BARE = re.compile(r"(?i)^\W*(?:undefined|null|nan|none|todo|tbd|error|test|xxx+|n/?a|\{\"error\".*)\W*$")
ENDS = re.compile(r"[.!?]\W{0,3}$|[.!?][”\"»“’')\]]?$")
BULLET = re.compile(r"^\s*(?:[-*•–·‣]|\d+[.)])\s+")
SENTENCE = re.compile(r"(?<=[.!?”])\s+")
TITLE = re.compile(r"[^\W_]+")
# Words that introduce a list of tags.
TAGS = re.compile(r"(?i)^\W*(?:tags?|topics?|keywords|etiquetas|temas|palabras clave|mots-clés|sujets|étiquettes|schlagwörter|themen|assuntos|palavras-chave)\s*:")


def open_slots(line: str) -> int:
    """Slots that are not shown as an example between quotation marks."""
    if not SIGN.search(line):
        return 0
    return sum(1 for m in SLOT.finditer(line) if line[m.start() - 1 : m.start()] not in QUOTE or not m.start())


def folded(line: str) -> str:
    return re.sub(r"\d+", "0", " ".join(line.split())).lower()


def title_words(s: str | None) -> list[str]:
    return TITLE.findall((s or "").lower())


@functools.lru_cache(50_000)
def is_phrase(line: str) -> bool:
    rest = SLOT.sub("", line)
    return bool(PHRASES.search(line) or BARE.match(line) or (rest != line and len(re.sub(r"\W", "", rest)) < 4))


NAMED = re.compile(r"[a-zà-ÿ,] [A-ZÀ-Þ][\w’]+ [A-ZÀ-Þ][\w’]+")


def speaks_of(line: str) -> bool:
    """A long sentence that names somebody: it tells of such a phrase, it is not one."""
    return len(line) > 80 and NAMED.search(line) is not None


def sample(items: DataFrame, bound: int = SAMPLE) -> list[Row]:
    """At most ``bound`` items with text, chosen by the hash of the id."""
    some = items.filter("text is not null and trim(text) <> ''").select("item_id", "source", "title", "text")
    part = min(1.0, 0.95 * bound / max(1, some.count()))
    # a share of all 64-bit hashes: as fine for billions of items as for a few
    got = some.filter(F.xxhash64("item_id", F.lit("sample")) < int((part - 0.5) * 2**64 * (1 - 2**-40))).limit(bound).collect()
    return sorted(got, key=lambda r: (r.item_id, r.text))


def weak_labels(sampled: list[Row]) -> list[tuple[Row, list[tuple[int, str, int]]]]:
    """(item, [(line number, line, kind or -1)]) of the non-blank lines of each sampled item."""
    held: dict[tuple[str, str], set[str]] = defaultdict(set)
    hosts: dict[str, set[str]] = defaultdict(set)
    titles = {" ".join(title_words(r.title)) for r in sampled if r.title}
    stories: dict[str, set[str]] = defaultdict(set)
    masks: dict[str, set[str]] = defaultdict(set)
    early, mask_n = Counter(), Counter()
    pages = []
    for r in sampled:
        key = " ".join(title_words(r.title))
        lines = [(n, s.strip()) for n, s in enumerate(r.text.split("\n"), 1) if s.strip()]
        top = True
        for _, s in lines:
            f, m = folded(s), " ".join(tokens(s))
            held[r.source or "", f].add(key)
            hosts[f].add(r.source or "")
            stories[f].add(key)
            masks[m].add(f)
            mask_n[m] += 1
            early[m] += top
            if len(s) > 80 and ENDS.search(s) and f not in titles:
                top = False
        pages.append((r, lines, key))
    out = []
    for r, lines, key in pages:
        labelled = []
        for k, (n, s) in enumerate(lines):
            f, m, w = folded(s), " ".join(tokens(s)), " ".join(title_words(s))
            ends, wordy = bool(ENDS.search(s)), sum(t.islower() and t != "x" for t in tokens(s)) >= 5
            sentence = len(s) >= 50 and ends and wordy and "X" in m
            # several sources may tell one story in the same sentence, so that alone makes it no furniture
            many = len(held[r.source or "", f]) >= 3 or (len(hosts[f]) >= 3 and not sentence) or ("X" not in m and len(stories[f]) >= 2)
            kind = -1
            if open_slots(s):
                kind = RESIDUE
            elif is_phrase(s):
                kind = RESIDUE if not many or PHRASES.search(s) else FURNITURE
            elif w and (w == key or w in titles):
                kind = HEADLINE
            elif many or " > " in s or " | " in s or TAGS.match(s):
                kind = FURNITURE
            elif sentence:
                kind = PROSE  # sentences that name nobody stay open: they may be notices
            elif not ends and len(s) < 90 and mask_n[m] >= 4 and len(masks[m]) >= 3 and early[m] >= 0.9 * mask_n[m] and "X" in m:
                kind = FURNITURE  # bylines: one form, many names, always above the first paragraph
            elif not ends and len(s) < 70 and 0 < k < len(lines) - 1 and early[m] <= 0.5 * mask_n[m]:
                after = lines[k + 1][1]
                if len(after) > 60 and ENDS.search(after) and len(held[r.source or "", folded(after)]) < 3:
                    kind = SUBHEAD
            labelled.append((n, s, kind))
        if any(kind == PROSE for *_, kind in labelled):
            # where an article stands, a sentence with such a phrase is one of its own, and a short line may be anything
            own = lambda s: PROSE if len(s) > 60 and ENDS.search(s) else -1
            labelled = [(n, s, own(s) if kind == RESIDUE and not open_slots(s) else kind) for n, s, kind in labelled]
        out.append((r, labelled))
    return out


def line_model(pages: list) -> np.ndarray:
    """Weights of the softmax regression over the five kinds. Residue lines are learnt with and without their phrase."""
    rng = random.Random(7)
    xs, ys, seen = [], [], Counter()

    def add(s: str, kind: int) -> None:
        s = " ".join(s.split("\n")).strip()
        if s:
            xs.append(s)
            ys.append(kind)

    for r, labelled in pages:
        if r.title:
            add(r.title, HEADLINE)
        for _, s, kind in labelled:
            if kind < 0:
                continue
            seen[s] += 1
            if seen[s] > 3:
                continue
            if kind == RESIDUE and len(s) > 60 and open_slots(s):  # of a long line, the sentences with slots are residue
                for part in SENTENCE.split(s):
                    add(part, RESIDUE if open_slots(part) else PROSE)
                continue
            add(s, kind)
            if kind == PROSE and rng.random() < 0.3:  # prose that stops somewhere is still prose
                add(s[: rng.randint(min(25, len(s) - 1), len(s) - 1)], PROSE)
            if kind == RESIDUE:
                rest = PHRASES.sub(" ", s)
                if rest != s and len(title_words(rest)) >= 3:
                    add(rest, RESIDUE)
                if rng.random() < 0.5:
                    add(s.upper(), RESIDUE)
    if not xs:
        xs, ys = ["."], [PROSE]
    flat, starts, n = [], [], 0
    for _, _, lines in in_chunks(xs):
        flat.append(lines.flat.astype(np.int32))
        starts.append(lines.starts + n)
        n += len(lines.flat)
    return softmax_regression(np.concatenate(flat), np.concatenate(starts), np.array(ys), KINDS)


# ---- whole pages: residue or not ----------------------------------------------------------------------------------

EXTRA = 14


def page_numbers(lines: Lines, logp: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(pages, EXTRA) length and title features, what the line model takes a page's lines for, and its strongest few words for
    residue inside any line. No label rule is among them."""
    page, m = lines.page, lines.pages
    kind, residue = logp.argmax(axis=1), np.exp(logp[:, RESIDUE])
    total = lambda v: np.bincount(page, v, m)
    # a sentence that breaks off can only be the last line; elsewhere a line without an end is no prose
    last = np.append(page[1:] != page[:-1], True) if lines.n else np.zeros(0, bool)
    prose = (kind == PROSE) & ((lines.form[:, 3] > 0) | last)
    n, n_prose, chars = total(None), total(prose), lines.form[:, 0]
    most = np.zeros(m)
    np.maximum.at(most, page, residue)
    peak = lines.peaks(weights[:-1, RESIDUE] - weights[:-1, PROSE])
    bare = n_prose == 0  # what else the page says counts most where no article stands
    return np.stack(
        [
            n_prose > 0, np.minimum(10, n_prose) / 10, np.log1p(total(prose * chars)) / 10, most, bare * (total(kind == RESIDUE) > 0), bare * most,
            bare * total(residue) / np.maximum(n, 1), bare * np.log1p(total(chars)) / 10, n == 1, total(kind == HEADLINE) > 0,
            np.minimum(1, total(prose * lines.form[:, 8])), bare, np.clip(peak / 10, -2, 5), np.clip(peak / 10, -2, 5) * bare,
        ], axis=1,
    ).astype(float)


def page_label(labelled: list[tuple[int, str, int]]) -> int | None:
    """Weak label of a sampled page: 1 residue, 0 article, None unclear."""
    if any(open_slots(s) for _, s, _ in labelled):
        return 1
    prose = sum(k == PROSE for *_, k in labelled)
    if prose:
        return 0
    return 1 if any(k == RESIDUE for *_, k in labelled) else None


def page_grams(lines: Lines, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(page, n-gram) of the lines that are neither furniture nor headline, each once: of what stands in the article's place."""
    kind = logp.argmax(axis=1)
    own = np.isin(kind, (PROSE, RESIDUE, SUBHEAD))[lines.of] if lines.n else np.zeros(0, bool)
    key = np.unique((lines.page[lines.of[own]] << 16) | lines.flat[own])
    return key >> 16, key & 0xFFFF


class PageModel:
    """L2-regularised linear classifier of pages over hashed n-grams of what stands in the article's place, length and
    title features, all on one scale."""

    def fit(self, pages: list, weights: np.ndarray) -> PageModel:
        known = [(labelled, r.title, y) for r, labelled in pages if (y := page_label(labelled)) is not None]
        each, grams, extra = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, EXTRA))]
        for lo, _, lines in in_chunks(["\n".join(s for _, s, _ in labelled) for labelled, *_ in known], [t for _, t, _ in known]):
            logp = lines.logp(weights)
            pages_, got = page_grams(lines, logp)
            each.append(pages_ + lo)
            grams.append(got)
            extra.append(page_numbers(lines, logp, weights))
        self._train(np.concatenate(each), np.concatenate(grams), np.concatenate(extra), np.array([y for *_, y in known], int))
        return self

    def _train(self, each: np.ndarray, grams: np.ndarray, extra: np.ndarray, y: np.ndarray, rounds: int = 150) -> None:
        n = len(y)
        if not n or y.min() == y.max():  # one class only: what the line model says decides
            self.w, self.v, self.b = np.zeros(DIM), np.zeros(EXTRA), -3.0
            self.mean, self.std = np.zeros(EXTRA), np.ones(EXTRA)
            self.v[[0, 5]] = -2.0, 6.0
            return
        self.mean, self.std = extra.mean(axis=0), extra.std(axis=0) + 1e-3
        x = (extra - self.mean) / self.std
        used, where = np.unique(grams, return_inverse=True)
        scale = 1 / np.sqrt(np.maximum(np.bincount(each, minlength=n), 1))
        u, v, b = np.zeros(len(used)), np.zeros(EXTRA), 0.0
        m = s = np.zeros(len(used) + EXTRA + 1)
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        for t in range(1, rounds + 1):
            z = np.bincount(each, u[where], n) * scale + x @ v + b
            r = (1 / (1 + np.exp(-z)) - y) * weight
            g = np.r_[np.bincount(where, (r * scale)[each], len(used)) + 1e-5 * u, x.T @ r + 1e-3 * v, r.sum()]
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            step = 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
            u, v, b = u - step[: len(used)], v - step[len(used) : -1], b - step[-1]
        self.w = np.zeros(DIM)
        self.w[used] = u
        self.v, self.b = v, float(b)

    def logit(self, lines: Lines, logp: np.ndarray, weights: np.ndarray) -> np.ndarray:
        each, grams = page_grams(lines, logp)
        z = np.bincount(each, self.w[grams], lines.pages) / np.sqrt(np.maximum(np.bincount(each, minlength=lines.pages), 1))
        return z + (page_numbers(lines, logp, weights) - self.mean) / self.std @ self.v + self.b

    def residue(self, lines: Lines, logp: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """True for each page that holds residue in the place of an article, or an article with unfilled slots."""
        return (self.logit(lines, logp, weights) > 0) & (np.bincount(lines.page, minlength=lines.pages) > 0)


def residue_pages(texts: list[str | None], titles: list[str | None], weights: np.ndarray, model: PageModel) -> np.ndarray:
    out = np.zeros(len(texts), bool)
    for lo, hi, lines in in_chunks(texts, titles):
        out[lo:hi] = model.residue(lines, lines.logp(weights), weights)
    return out


def train_pages(items: DataFrame, bound: int = SAMPLE) -> tuple[list, np.ndarray, PageModel]:
    """The labelled sample, the line model's weights and the page model."""
    pages = weak_labels(sample(items, bound))
    weights = line_model(pages).astype(np.float32)
    return pages, weights, PageModel().fit(pages, weights)


@functools.lru_cache(2)
def load(data: bytes):
    return pickle.loads(data)
