"""Evaluation passages inside training text, by a suffix automaton of all test items.

The items, a bounded set, are normalised to words and built into one generalised suffix automaton.
Training words are streamed through it; the longest matching length is tracked at every word. Where
it is long enough, the runs around it are aligned with the item and joined over odd changed words.
"""

from __future__ import annotations

import difflib
import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import textform
from foliospark.sources.tables import table

#: A passage has at least so many words, of which fewer than one in ``ODD_WORDS`` may be changed.
LEAST_WORDS, ODD_WORDS = 15, 10
#: Any such passage has a run of so many unchanged words: (N - k) / (k + 1) for k < N / 10 and N >= 15.
SEED_WORDS = 6
#: Characters of test items in one automaton; more items are taken in blocks, each with a scan of its own.
BLOCK_CHARS = 8_000_000
#: Spellings that a worker remembers; beyond that it forgets all. Changes speed only.
MEMO = 400_000

#: A passage is removed from training text if it has so many words, or covers such a share of its item.
REMOVE_WORDS, REMOVE_COVERAGE = 25, 0.3

#: Scripts without blanks between words: each of their characters counts as a word.
_SOLID_CHARS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_SOLID = re.compile(f"[{_SOLID_CHARS}]")
_CHUNK = re.compile(f"[{_SOLID_CHARS}]|[^\\s{_SOLID_CHARS}]+")
_CITATION = re.compile(r"\[\s*\d{1,4}(?:\s*[,;–-]\s*\d{1,4})*\s*\]|\[\^?\w{1,12}\]")
_WRAPPED = re.compile(r"(?<=\w)[-‐­]\r?\n[ \t>]*(?=\w)")
_INNER = re.compile(r"[\W_]*(.*?)[\W_]*\Z", re.DOTALL)
_NOT_WORD = re.compile(r"[\W_]+")
_SKIP, _UNKNOWN = -2, -1


def clean(text: str) -> str:
    """Lower case, words that were broken at a line end rejoined, citation marks blanked; every character keeps its place."""
    if "\n" in text:
        text = _WRAPPED.sub(lambda m: "\0" * len(m[0]), text)
    if "[" in text:
        text = _CITATION.sub(lambda m: " " * len(m[0]), text)
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def chunks(cleaned: str) -> list[str]:
    """Runs without blanks; of scripts without blanks single characters."""
    return _CHUNK.findall(cleaned) if _SOLID.search(cleaned) else cleaned.split()


def word_form(chunk: str) -> str:
    """A lower-case run without blanks in the form for comparison: letters and digits only."""
    return _NOT_WORD.sub("", textform.fold(chunk).lower())


class SuffixAutomaton:
    """All runs of words of the items; each state knows the items that hold its runs."""

    def __init__(self, items: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.items = [-1], [0], [set()]
        self.short: dict[int, dict[int, int]] = {}  # the suffix state of just so many words, as far as asked for
        for n, words in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, w)
            at = 0
            for w in words:  # every prefix belongs to the item; suffix links pass that on
                at = self.next[at][w]
                self.items[at].add(n)
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.items[self.link[s]] |= self.items[s]

    def _new(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.items.append(set())
        return len(self.next) - 1

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        cur = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def runs(self, words: list[int], least: int) -> list[tuple[int, int, set[int]]]:
        """(end, length, items) of the longest matches of at least ``least`` words that can't be extended to the right."""
        out, state, n = [], 0, 0
        nxt, link, length = self.next, self.link, self.length
        for i, w in enumerate(words):
            if w not in nxt[state]:
                if n >= least:
                    out.append((i, n, self.items[state]))
                while state and w not in nxt[state]:
                    state = link[state]
                    n = length[state]
            to = nxt[state].get(w)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
        if n >= least:
            out.append((len(words), n, self.items[state]))
        return out

    def holders(self, words: list[int], least: int) -> Iterator[tuple[int, set[int]]]:
        """(end, items) at every position: all items that hold the last ``least`` words, not only those of the longest match."""
        state, n = 0, 0
        nxt, link, length, short = self.next, self.link, self.length, self.short.setdefault(least, {})
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            to = nxt[state].get(w)
            if to is None:
                n = 0
                continue
            state, n = to, n + 1
            if n >= least:
                s = short.get(state)
                if s is None:
                    s = state
                    while length[link[s]] >= least:
                        s = link[s]
                    short[state] = s
                yield i + 1, self.items[s]


def passages(doc: list[int], item: list[int], least: int = LEAST_WORDS, odd: int = ODD_WORDS) -> list[tuple[int, int, int]]:
    """(first, last, words) in ``doc`` of the longest passages of ``item``: unchanged runs in order, joined over
    changed, left-out or added words as long as these are fewer than one in ``odd`` of the words."""
    blocks = [b for b in difflib.SequenceMatcher(None, doc, item, autojunk=False).get_matching_blocks() if b.size]
    out = []
    for i in range(len(blocks)):
        best, matched, changed = None, 0, 0
        for j in range(i, len(blocks)):
            b = blocks[j]
            if j > i:
                a = blocks[j - 1]
                changed += max(b.a - a.a - a.size, b.b - a.b - a.size)
            matched += b.size
            n = matched + changed
            if n >= least and changed * odd < n:
                best = (blocks[i].a, b.a + b.size, n)
            if changed * odd > n + sum(x.size for x in blocks[j + 1 :]):
                break
        if best and (not out or best[1] > out[-1][1]):
            out.append(best)
    return out


class Finder:
    """The automaton of one block of items with its vocabulary."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.words = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for c in chunks(clean(t)) if (w := word_form(c))] for _, t in items]
        self.automaton = SuffixAutomaton(self.words)
        finder = self

        class Memo(dict):
            def __missing__(self, chunk: str) -> int:
                if len(self) > MEMO:
                    self.clear()
                w = word_form(chunk)
                self[chunk] = n = finder.vocabulary.get(w, _UNKNOWN) if w else _SKIP
                return n

        self.memo = Memo()

    def leaks(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item id, first word, last word, words, words of the item) of every passage in ``text``."""
        ids = np.fromiter(map(self.memo.__getitem__, chunks(clean(text))), np.int32)
        ids = ids[ids != _SKIP]
        # A match can't hold a word that no item has: only long runs of known words are streamed.
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]])))
        begins, ends = edges[::2], edges[1::2]
        near: dict[int, list[tuple[int, int]]] = {}
        for b, e in zip(begins[ends - begins >= SEED_WORDS].tolist(), ends[ends - begins >= SEED_WORDS].tolist()):
            for end, items in self.automaton.holders(ids[b:e].tolist(), SEED_WORDS):
                end += b
                for it in items:
                    seeds = near.setdefault(it, [])
                    if seeds and seeds[-1][1] == end - 1:
                        seeds[-1] = (seeds[-1][0], end)
                    else:
                        seeds.append((end - SEED_WORDS, end))
        out = []
        for it, seeds in near.items():
            item, reach = self.words[it], len(self.words[it]) + 8
            spans: list[list[int]] = []
            for f, e in sorted(seeds):
                f, e = max(0, f - reach), min(len(ids), e + reach)
                if spans and f <= spans[-1][1]:
                    spans[-1][1] = max(e, spans[-1][1])
                else:
                    spans.append([f, e])
            out += [(self.ids[it], f + a, f + z, n, len(item)) for f, e in spans for a, z, n in passages(ids[f:e].tolist(), item)]
        return out


    def places(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item id, first character, behind the last character, words, words of the item) of every passage in ``text``."""
        found = self.leaks(text)
        if not found:
            return []
        at = [m for m in _CHUNK.finditer(clean(text)) if self.memo[m[0]] != _SKIP]
        # Signs around the first and the last word stay outside.
        return [(it, at[f].start() + _INNER.match(at[f][0]).start(1), at[e - 1].start() + _INNER.match(at[e - 1][0]).end(1), n, whole) for it, f, e, n, whole in found]


@functools.lru_cache(1)
def _finder(items: tuple[tuple[int, str], ...]) -> Finder:
    return Finder(list(items))


def blocks_of(items: DataFrame, limit: int = BLOCK_CHARS) -> list[tuple[tuple[int, str], ...]]:
    """The test items in blocks of at most ``limit`` characters (a longer item is a block of its own).

    Test items are a bounded query set; they alone are brought to the driver. Null texts are left out.
    """
    out: list[list[tuple[int, str]]] = []
    size = limit + 1
    for r in items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().toLocalIterator():
        if size + len(r["text"]) > limit:
            out.append([])
            size = 0
        out[-1].append((r["item_id"], r["text"]))
        size += len(r["text"])
    return [tuple(sorted(b)) for b in out]


_SPANS = "doc_id bigint, item_id bigint, first_word int, last_word int, words int, item_words int"


def leak_spans(documents: DataFrame, items: DataFrame, characters: bool = False) -> DataFrame:
    """One row per leaked passage: its words by number in the document and the words of the item.

    With ``characters`` the first two columns of places count characters of the text instead of words.
    Null, empty and wordless texts give no row; a document that stands twice gives its rows twice.
    The corpus is scanned once per block of items and never shuffled.
    """
    spark = documents.sparkSession
    docs = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in blocks_of(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = _finder(shared.value)
            look = finder.places if characters else finder.leaks
            for b in batches:
                rows = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in look(t)]
                cols = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 2 + [pa.int32()] * 4)], names=["doc_id", "item_id", "first_word", "last_word", "words", "item_words"])

        part = docs.mapInArrow(run, _SPANS)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], _SPANS)


def without_leaks(documents: DataFrame, items: DataFrame, words: int = REMOVE_WORDS, coverage: float = REMOVE_COVERAGE) -> DataFrame:
    """(doc_id, removed, text): documents that lose passages, without them, and how many characters were removed.

    A passage goes if it has at least ``words`` words or covers at least ``coverage`` of its item; shorter
    ones stay. Overlapping passages go together, one blank stands for each. Rows of a document that
    stands twice are handled alike; documents without such passages have no row.
    """
    gone = leak_spans(documents, items, characters=True).where((F.col("words") >= words) | (F.col("words") >= coverage * F.col("item_words")))
    spans = gone.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct(F.col("first_word").alias("f"), F.col("last_word").alias("e")))).alias("spans"))

    @F.pandas_udf("removed int, text string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, ss in zip(texts, spans):
            kept, at, n = [], 0, 0
            for s in ss:
                f, e = s["f"], s["e"]
                if e <= at or e > len(t):
                    continue
                f = max(f, at)
                if f > at or not kept:
                    kept.append(t[at:f])
                n += e - f
                at = e
            rows.append((n, " ".join(x for x in (*(k.strip(" ") for k in kept), t[at:].strip(" ")) if x)))
        return pd.DataFrame(rows, columns=["removed", "text"]).astype({"removed": "int32"})

    docs = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.join(spans, "doc_id").select("doc_id", cut("text", "spans").alias("c")).select("doc_id", "c.*")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


SQL: dict[str, str] = {}
QUERIES = {"p8_found": p8_found, "p8_spans": p8_spans, "p8_removed": p8_removed}
