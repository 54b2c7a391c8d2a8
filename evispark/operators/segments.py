"""Segments of a text that belong to its own titles: each runs from a title's mention to the next mention of another one."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

#: Characters of a segment at most; it is what the rule says, not a bound on work.
LONGEST = 2200
_AI, _COPY, _ROLE_COPY, _LINE = (re.compile(x) for x in (rules.AI_MENTION, rules.COMPANY_COPY, rules.ROLE_COPY, f"(?m){rules.ROLE_LINE}"))


def source_titles(cells: Column) -> Column:
    """The distinct titles in an array of cells, each cell with several of them, in order."""
    parts = F.flatten(F.transform(F.filter(cells, lambda x: x.isNotNull()), lambda x: F.split(x, "[,，、;；\\n]+", -1)))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, "\\s+", " "))), lambda x: x != ""))


def _anchors(title: str) -> list[str]:
    """What stands for a title in a text: itself, and what comes before its first bracket."""
    short = title.replace("(", "（").partition("（")[0]
    return [title, short] if short and short != title else [title]


def _places(text: str, anchor: str, step: int) -> Iterator[int]:
    """Where an anchor stands; the search goes on ``step`` characters after each place."""
    at = text.find(anchor)
    while at >= 0:
        yield at
        at = text.find(anchor, at + step)


def tells_of_ai(title: str, segment: str) -> bool:
    """As ``audit.role_mentions_ai``."""
    return bool(_AI.search(title)) or any(_AI.search(x) and (not _COPY.search(x) or _ROLE_COPY.search(x)) for x in segment.splitlines())


def segments_of(text: str, titles: list[str]) -> Iterator[tuple[str, str, int]]:
    """(title, segment, mentions) of each title; time goes with the length of the text and the number of mentions."""
    mentions = sorted({(at, i) for i, t in enumerate(titles) for a in _anchors(t) for at in _places(text, a, 1)})
    places = [at for at, _ in mentions]
    # From each mention, the next one of another title.
    other = [len(mentions)] * len(mentions)
    for k in range(len(mentions) - 2, -1, -1):
        other[k] = k + 1 if mentions[k + 1][1] != mentions[k][1] else other[k + 1]
    lines = [m.start() for m in _LINE.finditer(text)]
    for i, title in enumerate(titles):
        own = [_places(text, a, len(a)) for a in _anchors(title)]  # those of one anchor don't overlap
        starts = sorted(set().union(*own))

        def cut(start: int, i: int = i, title: str = title) -> str:
            end = min(len(text), start + LONGEST)
            k = bisect_right(places, start)
            if k < len(mentions) and mentions[k][1] == i:
                k = other[k]
            if k < len(mentions):
                end = min(end, places[k])
            line = bisect_right(lines, start + len(title))
            return text[start : min(end, lines[line])] if line < len(lines) else text[start:end]

        found = next((s for s in map(cut, starts) if tells_of_ai(title, s)), None)
        yield title, found if found is not None else cut(starts[0]) if starts else title, len(starts)


def role_segments(docs: DataFrame, key: str, text: str, titles: str) -> DataFrame:
    """(key, title, segment, mentions): for each distinct title of a row (``titles``, an array), the part of its text that is about it.

    A segment begins where the title or its short form stands and ends before the next mention of another of the row's titles, or
    before the next line that names a role, or after LONGEST characters. Of several the first that tells of AI is
    taken, else the first; a title that isn't in the text is its own segment. ``mentions`` counts the title's places. Null and
    blank titles, and rows without any, give no row; a null text is empty; equal rows give equal results.

    A row's titles are searched in its text where the row is read: texts are neither shuffled nor repeated for each title.
    """
    names = F.array_distinct(F.filter(F.col(titles), lambda x: x.isNotNull() & (F.trim(x) != "")))
    asked = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), names.alias("_names")).where(F.size("_names") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = list(segments_of(batch.column(1)[row].as_py(), batch.column(2)[row].as_py()))
                columns = [pa.array([batch.column(0)[row].as_py()] * len(found), batch.schema.field(0).type)]
                columns += [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, [key, "title", "segment", "mentions"])

    return asked.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, title string, segment string, mentions int")
