"""Lexicon matching and the scores that rest on it. Lexicons are parameters; the defaults are below."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressloom.functions.text import age_days

# The default lexicons.
# fmt: off
STRONG = [
    "artificial intelligence", "machine learning", "deep learning", "neural network", "large language model", "language model", "foundation model",
    "frontier model", "generative ai", "genai", "llm", "llms", "gpt", "chatgpt", "claude", "gemini", "llama", "mistral", "deepseek", "qwen",
    "transformer", "diffusion model", "stable diffusion", "midjourney", "openai", "anthropic", "deepmind", "hugging face", "mixture of experts",
    "fine-tune", "fine-tuning", "fine-tuned", "rlhf", "reinforcement learning", "embeddings", "inference", "ai agent", "agentic", "copilot", "agi",
    "superintelligence", "alignment", "multimodal", "prompt injection", "prompt engineering", "model weights", "open-weight", "open weights",
    "training data", "hallucination", "chain of thought", "computer vision", "speech recognition", "recommendation algorithm",
]
WEAK = [
    "ai", "a.i.", "algorithm", "algorithmic", "chatbot", "automation", "automate", "data center", "datacenter", "gpu", "gpus", "nvidia", "chip",
    "chips", "semiconductor", "compute", "robot", "robotics", "autonomous", "deepfake", "synthetic media", "facial recognition", "self-driving",
    "model", "models", "benchmark", "benchmarks", "token", "tokens", "parameters", "training", "trained", "dataset", "reasoning", "assistant",
    "agent", "agents", "context window", "open-source model", "lab", "labs",
]
EVENT = [
    "launch", "launches", "launched", "release", "releases", "released", "unveil", "unveils", "announce", "announces", "announced", "ship", "ships",
    "shipped", "raise", "raises", "raised", "funding", "acquire", "acquires", "acquisition", "merger", "ipo", "ban", "bans", "banned", "rule",
    "rules", "ruling", "regulate", "regulation", "lawsuit", "sues", "sued", "settle", "settlement", "breach", "leak", "resign", "resigns", "fired",
    "layoff", "layoffs", "shut down", "open-source", "open sources", "partnership", "deal",
]
LOW_VALUE = [
    "best", "top 10", "top 5", "how to", "why you should", "everything you need", "review:", "hands-on", "deals", "roundup", "explainer", "opinion:",
    "guide to",
]
TOPICS = {
    "policy-and-regulation": [
        "regulat", "law", "bill", "congress", "senate", "parliament", "commission", "court", "lawsuit", "sued", "ban", "policy", "antitrust",
        "copyright", "compliance", "executive order",
    ],
    "business-and-funding": [
        "funding", "raise", "raised", "valuation", "ipo", "acquire", "acquisition", "merger", "revenue", "profit", "layoff", "hire", "resign", "ceo",
        "startup", "investor", "deal",
    ],
    "compute-and-infrastructure": [
        "data center", "datacenter", "gpu", "chip", "nvidia", "tpu", "semiconductor", "cluster", "capacity", "energy", "power", "supply",
    ],
    "safety-and-alignment": [
        "safety", "alignment", "misuse", "jailbreak", "red team", "guardrail", "risk", "bioweapon", "prompt injection", "abuse",
    ],
    "research": [
        "paper", "preprint", "arxiv", "benchmark", "study", "researchers", "we propose", "state-of-the-art", "evaluation",
    ],
    "models-and-releases": [
        "model", "release", "launch", "version", "preview", "open-source", "open weights", "api", "context window",
    ],
    "products-and-tools": [
        "app", "feature", "product", "tool", "integration", "plugin", "assistant", "rollout", "users",
    ],
    "society-and-labor": [
        "jobs", "workers", "employment", "school", "student", "artist", "writer", "union", "public",
    ],
}
# fmt: on
EDGE = r"[\p{L}\p{N}_\-]"


@dataclass(frozen=True)
class Lexicon:
    strong: list[str] = field(default_factory=lambda: STRONG)
    weak: list[str] = field(default_factory=lambda: WEAK)
    event: list[str] = field(default_factory=lambda: EVENT)
    low_value: list[str] = field(default_factory=lambda: LOW_VALUE)
    topics: dict[str, list[str]] = field(default_factory=lambda: TOPICS)
    #: Source types that are on topic as such, with the topic they get.
    on_topic: dict[str, str] = field(default_factory=lambda: {"arxiv": "research"})


def pattern(terms: list[str]) -> str:
    """The terms as whole words (a hyphen is part of a word), the longest first."""
    alternatives = "|".join(re.escape(t).replace("\\ ", " ") for t in sorted(terms, key=len, reverse=True))
    return f"(?<!{EDGE})({alternatives})(?!{EDGE})"


def distinct_terms(text: Column, terms: list[str]) -> Column:
    """How many different terms the text holds."""
    return F.size(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern(terms)), 1)))


def holds_any(text: Column, terms: list[str]) -> Column:
    """Any term as a substring, case ignored."""
    low = F.lower(text)
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(low, F.lit(t.lower()))
    return out


def haystack(title: Column, summary: Column) -> Column:
    return F.concat(title, F.lit("\n"), F.left(F.coalesce(summary, F.lit("")), F.lit(1500)))


def topical_source(source: Column, source_type: Column, lx: Lexicon) -> Column:
    return source_type.isin(*lx.on_topic) | source.rlike(rf"(?i)(?<!{EDGE})(ai|ml|llm)(?!{EDGE})")


def related(title: Column, summary: Column, source: Column, source_type: Column, lx: Lexicon) -> Column:
    """On topic: by source type, headline terms, or several terms together."""
    h = haystack(title, summary)
    ts, tw, s, w = distinct_terms(title, lx.strong), distinct_terms(title, lx.weak), distinct_terms(h, lx.strong), distinct_terms(h, lx.weak)
    return (
        source_type.isin(*lx.on_topic) | (ts >= 1) | (tw >= 2) | (s >= 2) | ((s >= 1) & (w >= 1)) | ((w >= 2) & (tw >= 1))
        | (topical_source(source, source_type, lx) & ((tw >= 1) | (s >= 1)))
    )


def engagement(points: Column, score: Column) -> Column:
    return F.greatest(F.coalesce(points, F.lit(0)), F.coalesce(score, F.lit(0)))


def importance(title: Column, summary: Column, points: Column, n_also: Column, published: Column, now: Column, lx: Lexicon) -> Column:
    """2, one more each for several strong terms, an event word, much engagement, other carriers; one less each for a
    low-value headline and age above 10 days; within 1 and 5."""
    one = lambda c: F.when(c, 1).otherwise(0)
    s = distinct_terms(haystack(title, summary), lx.strong)
    n = (
        F.lit(2) + one(s >= 2) + one(distinct_terms(title, lx.event) >= 1) + one(points >= 500) + one(n_also >= 1)
        - one(holds_any(title, lx.low_value)) - one(age_days(published, now) > 10)
    )
    return F.greatest(F.lit(1), F.least(F.lit(5), n)).cast("int")


def topic(text: Column, source_type: Column, lx: Lexicon) -> Column:
    """The first topic with any term as a substring; 'other' where there is none."""
    out = F.lit("other")
    for name, terms in reversed(lx.topics.items()):
        out = F.when(holds_any(text, terms), name).otherwise(out)
    for kind, name in lx.on_topic.items():
        out = F.when(source_type == kind, name).otherwise(out)
    return out
