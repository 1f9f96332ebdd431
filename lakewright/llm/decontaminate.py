"""Benchmark decontamination with a generalised suffix automaton of the normalised items.

The automaton reads the words of all items. Each training text is streamed through it once; the state keeps the
longest suffix read so far that occurs in an item, so every occurrence of a window (WINDOW consecutive item words,
or the whole of a shorter item) is found in time linear in the text; what a window's state says is collected once a
text. The automaton is broadcast, so its size is checked: items beyond MAX_WORDS words go into further automata. The
texts pass through one after the other, with what was found written in between, so that one is held at a time.

Cases: a null or empty text has no words, no hits and isn't contaminated; an item without words is no window;
repeated rows are judged each on its own; items that share a window all count; an empty table of texts gives an
empty result, an empty table of items gives no hits; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import LOWER, WORD, Scratch, free_name, table, words

WINDOW = 13
#: Words of items in one automaton; below 300 MB in each worker.
MAX_WORDS = 400_000
#: A text is contaminated if at least one in this many of its words is hit.
COVERAGE = 20


class SuffixAutomaton:
    """States with a length, a suffix link and word transitions; items are marked where their windows end."""

    def __init__(self, items: list[tuple[object, list[str]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[str, int] = {}
        self.length, self.link, self.next = [0], [-1], [{}]
        self.shortest = window
        read = []
        for item, ws in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]
            if not ids:
                continue
            last = 0
            for k in ids:
                last = self._extend(last, k)
            read.append((item, ids))
            self.shortest = min(self.shortest, len(ids))
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        #: For each state the one of the last window words of what it stands for, if it is so long.
        self.ends = [0] * len(self.length)
        for state in order:
            above = self.link[state]
            self.ends[state] = self.ends[above] if self.length[above] >= window else state
        #: The items whose windows end in a state.
        self.items: dict[int, set] = {}
        whole: dict[int, dict[int, set]] = {}
        for item, ids in read:
            state = matched = 0
            for k in ids:
                state, matched = self.step(state, matched, k)
                if matched >= window:
                    self.items.setdefault(self.ends[state], set()).add(item)
            if len(ids) < window:
                whole.setdefault(state, {}).setdefault(len(ids), set()).add(item)
        # A shorter item ends in its own state and in all states whose suffix links lead there: (length, items), by length.
        self.short_ends: list[tuple] = [()] * len(self.length)
        for state in order:
            self.short_ends[state] = self.short_ends[self.link[state]] + tuple(sorted(whole.get(state, {}).items()))

    def _extend(self, last: int, k: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if k in nxt[last]:
            q = nxt[last][k]
            return q if length[q] == length[last] + 1 else self._clone(last, q, k)
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        nxt.append({})
        p = last
        while p >= 0 and k not in nxt[p]:
            nxt[p][k] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][k]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, k)
        return cur

    def _clone(self, p: int, q: int, k: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        nxt.append(dict(nxt[q]))
        link[q] = new
        while p >= 0 and nxt[p].get(k) == q:
            nxt[p][k] = new
            p = link[p]
        return new

    def step(self, state: int, matched: int, k: int) -> tuple[int, int]:
        nxt, link = self.next, self.link
        while state and k not in nxt[state]:
            state = link[state]
            matched = self.length[state]
        to = nxt[state].get(k)
        return (0, 0) if to is None else (to, matched + 1)

    def scan(self, ws: list[str]) -> tuple[list[tuple[int, int]], set]:
        """The hit spans (start, end), disjoint and in order, and the items of the windows in them."""
        ids = list(map(self.vocabulary.get, ws))
        spans: list[tuple[int, int]] = []
        found: set = set()
        if len(ids) < self.shortest:
            return spans, found
        window, link, length, nxt, short, ends = self.window, self.link, self.length, self.next, self.short_ends, self.ends
        seen: set[int] = set()
        state = matched = 0
        for i, k in enumerate(ids):
            if k is None:
                state = matched = 0
                continue
            while state and k not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(k)
            if to is None:
                state = matched = 0
                continue
            state, matched = to, matched + 1
            start = i + 1
            if matched >= window:
                start = i + 1 - matched
                if ends[state] not in seen:
                    seen.add(ends[state])
                    found |= self.items[ends[state]]
            for n, items in short[state]:
                if n > matched:
                    break
                start = min(start, i + 1 - n)
                if id(items) not in seen:
                    seen.add(id(items))
                    found |= items
            if start <= i:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, found


def automata(items: DataFrame, key: str, window: int, max_words: int) -> Iterator[SuffixAutomaton]:
    """Automata over the items, each of at most max_words words (one item may be longer)."""
    block, size = [], 0
    for r in items.select(key, "text").orderBy(key, "text").toLocalIterator():
        ws = words(r["text"])
        if block and size + len(ws) > max_words:
            yield SuffixAutomaton(block, window)
            block, size = [], 0
        block.append((str(r[key]), ws))
        size += len(ws)
    yield SuffixAutomaton(block, window)


FOUND = "n_words long, spans array<array<int>>, items array<string>"


def left_of(automaton: SuffixAutomaton, text: str | None, n_words: int, spans: list[tuple[int, int]], coverage: int) -> str | None:
    """A text that isn't contaminated without its long hit spans; null where there is nothing to cut."""
    n_hit = sum(b - a for a, b in spans)
    if coverage * n_hit >= n_words or all(b - a < automaton.window for a, b in spans):
        return None
    return cut_spans(automaton, text)


def scanner(shared, coverage: int, cut: bool):
    """An Arrow-batched function from a text to hit spans and items; with `cut`, to what is left of it by this automaton too.

    One function does it all, as each Python function in a task takes a worker of its own.
    """

    @F.pandas_udf(f"{FOUND}, cut string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = shared.value
        for texts in batches:
            rows = []
            for text in texts:
                ws = words(text)
                spans, found = automaton.scan(ws)
                rows.append((len(ws), [list(s) for s in spans], sorted(found), left_of(automaton, text, len(ws), spans, coverage) if cut else None))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items", "cut"])

    return scan.asNondeterministic()


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(list, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def further_scanner(shared):
    """An Arrow-batched function from a text, and the spans and items that earlier automata found, to all spans and items."""

    @F.pandas_udf(FOUND)
    def scan(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton = shared.value
        for texts, spans, items in batches:
            rows = []
            for text, before, names in zip(texts, spans, items, strict=True):
                ws = words(text)
                new, found = automaton.scan(ws)
                rows.append((len(ws), merged([*before, *new]), sorted({*names, *found})))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return scan.asNondeterministic()


def match_benchmark(docs: DataFrame, items: DataFrame, *, item_key: str = "item_id", window: int = WINDOW, coverage: int = COVERAGE, max_words: int = MAX_WORDS, found: str = "hits", cut: str | None = None) -> DataFrame:
    """docs with a struct column: n_words, n_hit, n_items, items_sha256, spans (word offsets), items, contaminated.

    Where one automaton holds all items, the column `cut`, if named, is what is left of texts that aren't contaminated but have long spans.
    """
    spark = docs.sparkSession
    # A column of docs with the same name gives way.
    df = docs.drop(found)
    scratch = held = last = None
    for automaton in automata(items, item_key, window, max_words):
        if held is not None:
            # Nothing needs the automaton before any more once this is written.
            scratch = scratch or Scratch(spark, "decontaminate")
            written = df = scratch.save(df, "found")
            held.destroy()
            if last is not None:
                scratch.drop(last)
            last = written
        first, held = held is None, spark.sparkContext.broadcast(automaton)
        hit = F.col(found)
        df = df.withColumn(found, scanner(held, coverage, cut is not None)(F.col("text")) if first else further_scanner(held)(F.col("text"), hit["spans"], hit["items"]))
    x = F.col(found)
    if cut is not None and first:
        df = df.withColumn(cut, x["cut"])
    n_hit = F.aggregate(x["spans"], F.lit(0).cast("long"), lambda acc, s: acc + F.get(s, F.lit(1)) - F.get(s, F.lit(0)))
    return df.withColumn(
        found,
        F.struct(
            x["n_words"].alias("n_words"),
            n_hit.alias("n_hit"),
            F.size(x["items"]).cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", x["items"]), 256).alias("items_sha256"),
            ((n_hit > 0) & (coverage * n_hit >= x["n_words"])).alias("contaminated"),
            x["spans"].alias("spans"),
            x["items"].alias("items"),
        ),
    )


def without_spans(text: str | None, spans: list[list[int]], longest: int = WINDOW) -> str | None:
    """The text without its hit spans of at least `longest` words."""
    if text is None:
        return None
    at = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    out, last = [], 0
    for a, b in spans:
        if b - a >= longest:
            out.append(text[last : at[a][0]])
            last = at[b - 1][1]
    return "".join(out) + text[last:]


def cut_spans(automaton: SuffixAutomaton, text: str) -> str:
    """The text without hit spans of at least a window's words, those that a cut puts together included."""
    while True:
        spans, _ = automaton.scan(words(text))
        if all(b - a < automaton.window for a, b in spans):
            return text
        text = without_spans(text, spans, automaton.window)


def cleaner(shared):
    """An Arrow-batched function from a text to the text without long hit spans."""

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = shared.value
        for texts in batches:
            yield pd.Series([None if t is None else cut_spans(automaton, t) for t in texts], dtype=object)

    return cleaned.asNondeterministic()


def cut_by_all(out: DataFrame, items: DataFrame, cut: str, item_key: str, max_words: int) -> DataFrame:
    """The texts in the column `cut` without long hit spans of any of several automata; each pass reads what the one before has written."""
    scratch = Scratch(out.sparkSession, "cut-spans")
    held = last = left = None
    more = True
    while more:
        for automaton in automata(items, item_key, WINDOW, max_words):
            written = scratch.save(out, "cut")
            if held is not None:
                held.destroy()
                scratch.drop(last)
            last, held = written, out.sparkSession.sparkContext.broadcast(automaton)
            out = written.withColumn(cut, cleaner(held)(F.col(cut)))
        # What one automaton cuts may put words together that another one knows.
        before, left = left, out.agg(F.sum(F.length(cut))).first()[0]
        more = before != left
    return out


def uncontaminated(docs: DataFrame, items: DataFrame, *, item_key: str = "item_id", max_words: int = MAX_WORDS) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns; hit spans of at least WINDOW words are cut from `text`, and `n_chars`, where it is a column, counted anew."""
    hits, cut = free_name(docs, "hits"), free_name(docs, "cut")
    out = match_benchmark(docs, items, item_key=item_key, max_words=max_words, found=hits, cut=cut).where(~F.col(hits)["contaminated"])
    if cut not in out.columns:
        long = F.exists(F.col(hits)["spans"], lambda s: F.get(s, F.lit(1)) - F.get(s, F.lit(0)) >= WINDOW)
        out = cut_by_all(out.withColumn(cut, F.when(long, F.col("text"))).drop(hits), items, cut, item_key, max_words)
    out = out.drop(hits)
    out = out.withColumn("text", F.coalesce(cut, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.drop(cut)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = match_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", *(F.col("hits")[c].alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(coalesce(" + _LOWER + r", ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format("text")} AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len(ws) AS n, ws AS w FROM item WHERE len(ws) BETWEEN 1 AND 12
  UNION
  SELECT DISTINCT item_id, 13 AS n, ws[i:i+12] AS w FROM item, LATERAL (SELECT unnest(range(1, len(ws) - 11)) AS i) WHERE len(ws) >= 13),
doc AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format("text")} AS ws FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
cut AS (
  SELECT r, s.n, i, ws[i:i+s.n-1] AS w FROM doc, sizes s, LATERAL (SELECT unnest(range(1, len(ws) - s.n + 2)) AS i) WHERE len(ws) >= s.n),
hit AS (SELECT c.r, c.i, c.n, win.item_id FROM cut c JOIN win ON win.n = c.n AND win.w = c.w),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM doc LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
