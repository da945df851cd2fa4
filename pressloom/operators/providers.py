"""Verdicts from a provider (a model, a service, the lexicon), with a cache in front and batches of bounded size."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.operators.items import batches
from pressloom.operators.reports import shrink
from pressloom.operators.state import probe

#: What a provider gets: up to a batch of payloads (dicts with index_in_batch). What it gives: verdicts by that index.
Provider = Callable[[list[dict[str, Any]]], list[dict[str, Any]]]


class Refused(Exception):
    """The provider's credentials do not work: stop, do not go on with other batches."""


VERDICT = "batch long, index_in_batch long, ai_related boolean, importance int, topic string, one_liner string, error string"


def ask(payloads: DataFrame, provider: Provider) -> DataFrame:
    """VERDICT rows for payloads (batch, index_in_batch, any further columns). A batch whose call fails gives one row with
    ``error`` and no verdicts; entries without a valid index are ignored; importance is kept within 1 and 5."""

    def call(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        known, rows = set(pdf["index_in_batch"]), []
        try:
            for v in provider(pdf.sort_values("index_in_batch").to_dict("records")):
                i = v.get("index_in_batch")
                if i in known:
                    known.discard(i)
                    rows.append((key[0], i, bool(v["ai_related"]), max(1, min(5, int(v["importance"]))), v.get("topic"), v.get("one_liner"), None))
        except Refused:
            raise
        except Exception as e:
            rows = [(key[0], None, None, None, None, None, f"{type(e).__name__}: {e}")]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in VERDICT.split(", ")]).astype({"index_in_batch": "Int64", "importance": "Int32"})

    return payloads.groupBy("batch").applyInPandas(call, VERDICT)  # a batch is a group of bounded size


def triage(
    items: DataFrame, cache: DataFrame, provider: Provider, now: Column, order: list[Column], size: int = 40, max_age_days: int = 30
) -> tuple[DataFrame, DataFrame]:
    """(judged, failed): items (key and payload columns) with their verdicts, cached or fresh, and failed batches.

    ``cache``: key, created, ai_related, importance, topic, one_liner. Items without a verdict are dropped."""
    probed = probe(items, cache, now, max_age_days, F.col("ai_related").isNotNull() & F.col("importance").isNotNull())
    verdict = ["ai_related", "importance", "topic", "one_liner"]
    hits = probed.filter("hit").select(*items.columns, *verdict)
    asked = batches(probed.filter("not hit").select(*items.columns), size, order)
    got = ask(asked, provider)
    fresh = asked.join(got.filter("error is null"), ["batch", "index_in_batch"]).select(*items.columns, *verdict)
    return hits.unionByName(fresh), got.filter("error is not null").select("batch", "error")


#: Gets the cluster payloads, gives groups: [{headline, topic, importance, members: [index]}].
Grouper = Callable[[list[dict[str, Any]]], list[dict[str, Any]]]


def grouped(selected: list[dict[str, Any]], grouper: Grouper) -> list[dict[str, Any]]:
    """Clusters (headline, topic, importance, members) of the selected items (title, source, topic, importance, one_liner, in
    rank order; a selection is cut to the digest's size), by importance and size.

    Members out of range or already taken are ignored; items that no group names stand alone, and so do all of them if
    the call fails. A single item is not sent."""
    alone = lambda i: {"headline": selected[i]["title"], "topic": selected[i]["topic"], "importance": selected[i]["importance"], "members": [i]}
    if len(selected) < 2:
        return [alone(i) for i in range(len(selected))]
    try:
        reply = grouper([{"index": i, **{k: s.get(k) for k in ("title", "source", "topic", "importance", "one_liner")}} for i, s in enumerate(selected)])
    except Refused:
        raise
    except Exception:
        return [alone(i) for i in range(len(selected))]
    out, taken = [], set()
    for g in reply:
        members = [i for i in dict.fromkeys(g.get("members") or []) if isinstance(i, int) and 0 <= i < len(selected) and i not in taken]
        if members:
            taken.update(members)
            first = alone(members[0])
            out.append({k: g.get(k) or first[k] for k in ("headline", "topic", "importance")} | {"members": members})
    out += [alone(i) for i in range(len(selected)) if i not in taken]
    return sorted(out, key=lambda c: (-int(c["importance"] or 0), -len(c["members"])))


def written(payload_of: Callable[[int], dict], writer: Callable[[str], str], fallback: Callable[[], str], per_item: int = 8000, limit: int = 500_000) -> str:
    """The digest by ``writer`` from the payload as JSON, its bodies halved until it fits; ``fallback`` if the call fails."""
    size = shrink(lambda n: len(json.dumps(payload_of(n), ensure_ascii=False)), per_item, limit)
    try:
        return writer(json.dumps(payload_of(size), ensure_ascii=False))
    except Refused:
        raise
    except Exception:
        return fallback()
