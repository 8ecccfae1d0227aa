"""Documents that arrive again and again: what each version changes against the one before, kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import reader
from ..operators.structure import flatten

CHANGES = "doc_id long, at timestamp, title string, kind string, old_number long, new_number long"
_NAMES = [c.split()[0] for c in CHANGES.split(", ")]


def articles(text: str | None) -> list[tuple[str, int | None, str]]:
    """title, number, body of each article of a text; of articles with one title the first keeps it, the others add how many came before."""
    out: list[list] = []
    for node in flatten(reader.read((text or "").split("\n"))):
        if node["type"] == "article":
            out.append([node.get("title") or node.get("number_str") or "", node.get("number"), []])
        elif node.get("article_no") and out and node.get("body"):
            out[-1][2].append(node["body"])
    seen: dict[str, int] = {}
    for a in out:
        seen[a[0]] = seen.get(a[0], 0) + 1
        a[0] += f"#{seen[a[0]]}" if seen[a[0]] > 1 else ""
    return [(t, n, "\n".join(b)) for t, n, b in out]


class LastVersion(StatefulProcessor):
    """State of a document: when its last version was made, and that version's articles by their titles."""

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.made = handle.getValueState("made", "at timestamp")
        self.held = handle.getMapState("held", "title string", "number long, body string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        out = []
        for v in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples():
            last = self.made.get()[0] if self.made.exists() else None
            if last is not None and v.at <= pd.Timestamp(last):
                out.append((key[0], v.at, None, "late", None, None))
                continue
            old = {k[0]: (x[0], x[1]) for k, x in self.held.iterator()}
            new = {a["title"]: (a["number"], a["body"]) for a in v.articles}
            for title in [*new, *(t for t in old if t not in new)]:
                (m, was), (n, now) = old.get(title, (None, None)), new.get(title, (None, None))
                kind = "added" if title not in old else "deleted" if title not in new else "changed" if was != now else "renumbered" if m != n else None
                if kind:
                    out.append((key[0], v.at, title, kind, m, n))
            for title in [t for t in old if t not in new]:
                self.held.removeKey((title,))
            for title, value in new.items():
                if old.get(title) != value:
                    self.held.updateValue((title,), value)
            self.made.update((v.at.to_pydatetime(),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame(out, columns=_NAMES).astype({"old_number": "Int64", "new_number": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.made.clear()
        self.held.clear()
        yield pd.DataFrame([], columns=_NAMES)

    def close(self) -> None:
        pass


def changes(docs: DataFrame, idle_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """doc_id, at, title, kind (added, deleted, changed, renumbered), old_number, new_number of streamed versions (doc_id, at, text) against the version before.

    A version that isn't newer than the last has one row, of kind late, and changes nothing; the first version's articles are all added. A
    document that is idle for idle_ms is forgotten. The state needs the RocksDB provider (spark.sql.streaming.stateStore.providerClass).
    """

    @F.pandas_udf("array<struct<title:string,number:long,body:string>>")
    def read(batch: pd.Series) -> pd.Series:
        return batch.map(articles)

    rows = docs.filter("doc_id is not null and at is not null").select("doc_id", "at", read("text").alias("articles"))
    return rows.groupBy("doc_id").transformWithStateInPandas(LastVersion(idle_ms), CHANGES, "append", "processingTime")
