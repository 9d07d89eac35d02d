"""Evaluation texts leaking into training text (problem 9).

Each Python task cuts its documents into shards, builds an FM-index over each shard's words and searches all phrases of
the evaluation items in it: backward search by wavelet ranks, positions by sampled suffixes, then overlapping hits merge
to removal spans. A word that no item has can't be part of a hit, so it stands in the index as a separator; stretches
between separators that are shorter than a phrase are left out. No shuffle of documents, no pairs: what leaves a task is
one row per document, item and span.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.common import durable, per_worker
from lexweave.llm.fmindex import FMIndex

SPANS = "doc_id long, item_id long, word_from int, word_to int"


def make_splitter():
    """Text to words, in which letter case, punctuation, markup signs, line breaks, spaces and invisible characters don't
    matter, and a word broken over two lines by a hyphen is one word."""
    word = re.compile(r"[^\W_]+")
    hidden = re.compile("[​-‏‪-‮⁠-⁤﻿᠎؜͏︀-️]+")
    broken = re.compile(r"(?<=\w)[-‐‑­][^\S\n]*\n[\s>|*#/]*(?=\w)")
    tag = re.compile(r"</?[a-z][^<>\n]{0,200}>|&(?:nbsp|amp|quot|lt|gt|shy|#\d{1,6});")

    def words(text: str) -> list[str]:
        t = text.lower()
        if not t.isascii():
            t = hidden.sub("", unicodedata.normalize("NFC", t))
        if "\n" in t or "\r" in t:
            t = broken.sub("", t.replace("\r\n", "\n").replace("\r", "\n"))
        if "­" in t:
            t = t.replace("­", "")
        if "<" in t or "&" in t:
            t = tag.sub(" ", t)
        return word.findall(t)

    return words


class Phrases:
    """All phrases of ``min_words`` words of some items: words as numbers, one line a phrase, and the items that have it."""

    def __init__(self, items: list[tuple[int, str]], min_words: int) -> None:
        split = make_splitter()
        self.number: dict[str, int] = {}
        phrases: dict[tuple[int, ...], list[int]] = {}
        for item_id, text in items:
            ws = [self.number.setdefault(w, len(self.number) + 1) for w in split(text or "")]
            for i in range(len(ws) - min_words + 1):
                owners = phrases.setdefault(tuple(ws[i : i + min_words]), [])
                if not owners or owners[-1] != item_id:
                    owners.append(item_id)
        self.patterns = np.array(list(phrases), np.int64).reshape(-1, min_words)
        self.lengths = np.array([len(o) for o in phrases.values()], np.int64)
        self.owner_of = np.array([o for owners in phrases.values() for o in owners], np.int64)
        self.owner_at = np.concatenate(([0], np.cumsum(self.lengths))).astype(np.int64)


def _search(documents: DataFrame, items: list[tuple[int, str]], min_words: int, shard_words: int) -> DataFrame:
    """Hits of these items. Their phrases are made by the tasks, once per Python worker."""
    mark = zlib.crc32(repr((items, min_words)).encode())

    def shard(p: Phrases, runs: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch | None:
        """runs: (doc_id, number of the first word in the document, words)."""
        seq = np.zeros(sum(len(r[2]) + 1 for r in runs), np.int64)
        at = np.cumsum([0] + [len(r[2]) + 1 for r in runs])[:-1]
        for a, (_, _, ws) in zip(at.tolist(), runs):
            seq[a : a + len(ws)] = ws
        index = FMIndex(seq)
        low, high = index.ranges(p.patterns)
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return None
        times = high[hit] - low[hit]
        rows = np.repeat(low[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        pos, pattern = index.locate(rows), np.repeat(hit, times)
        run = np.searchsorted(at, pos, side="right") - 1
        doc = np.array([r[0] for r in runs], np.int64)[run]
        start = np.array([r[1] for r in runs], np.int64)[run] + pos - at[run]
        n = p.lengths[pattern]  # a phrase may belong to several items
        item = p.owner_of[np.repeat(p.owner_at[pattern], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        doc, start = np.repeat(doc, n), np.repeat(start, n)
        order = np.lexsort((start, item, doc))
        doc, item, start = doc[order], item[order], start[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] > start[:-1] + min_words)
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:] - 1, [len(doc) - 1]))
        cols = [pa.array(doc[first]), pa.array(item[first]), pa.array(start[first].astype(np.int32)), pa.array((start[last] + min_words).astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "word_from", "word_to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, p = make_splitter(), per_worker(("phrases", mark), lambda: Phrases(items, min_words))
        get = p.number.get
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text or doc_id is None:
                    continue
                ids = np.array([get(w, 0) for w in words(text)] + [0], np.int64)
                if len(ids) <= min_words:
                    continue
                gaps = np.flatnonzero(ids == 0)
                starts = np.concatenate(([0], gaps[:-1] + 1))
                long_ = gaps - starts >= min_words
                for a, z in zip(starts[long_].tolist(), gaps[long_].tolist()):
                    held.append((doc_id, a, ids[a:z]))
                    size += z - a + 1
                if size >= shard_words:
                    if (out := shard(p, held)) is not None:
                        yield out
                    held, size = [], 0
        if held and (out := shard(p, held)) is not None:
            yield out

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SPANS)


def leaked_spans(documents: DataFrame, eval_items: DataFrame, min_words: int = 12, shard_words: int = 1_000_000, chars_at_once: int = 20_000_000) -> DataFrame:
    """(doc_id, item_id, word_from, word_to): merged stretches of a document that hold at least ``min_words`` consecutive
    words of an item in order. Null and empty texts have none; neither have items shorter than ``min_words``.

    Items go to the tasks with the code. Their size is summed first: above ``chars_at_once`` they are searched in several
    passes one after the other, each of items of about that size and with its hits kept in a durable table, so neither the
    driver nor a task ever holds more items than those of one pass. A row without id is left out.
    """
    items = eval_items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-total // chars_at_once))
    of = lambda some: _search(documents, sorted(tuple(r) for r in some.collect()), min_words, shard_words)
    if passes == 1:
        return of(items)
    return reduce(DataFrame.unionByName, [durable(of(items.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k))) for k in range(passes)])


def leaks_found(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id), once each."""
    return leaked_spans(documents, eval_items).select("doc_id", "item_id").distinct()
