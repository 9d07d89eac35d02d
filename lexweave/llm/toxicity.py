"""Abusive, hateful or sexual content (problem 10): character n-grams scaled by naive Bayes log-count ratios, linear classifier.

Labels belong to documents, but one passage makes a document abusive, so training finds the passages: all passages of
documents labelled abusive start as suspects, and log-count ratios against the whole corpus narrow them. A second count,
over the suspicious passages of all documents, tells abuse from harmless passages that merely look unusual. A logistic
regression on the scaled n-grams then sets the suspects apart from the worst passages of clean documents. The score of a
document is that of its worst passage. Everything is vectorised over characters: no n-gram becomes a Python object.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.common import durable, norm_id, per_worker

SIZES = (3, 4, 5)
BITS = 19
LABELLED_DOCS = 6_000
LABELLED_CHARS = 20_000_000
PASSAGE = 130
TURNS = 4
PRIOR = 0.5
SEEN = 3
DOWN = 3.0
CLEAN, USUAL = 0.9, 0.8
HARD = 1
FOLDS, ROUNDS = 5, 50
BETA = 0.5  # recall counts that much beside precision: of few labels a careful cut comes
APART = 6.0  # an n-gram is harmless where suspects hold it that much more rarely than abuse has its n-grams
NAIVE = 0.75
EDGES = np.linspace(-40.0, 40.0, 641)  # of the histogram of documents' scores
SCRAP, SCRAP_CHARS = 3.0, 18  # a passage of fewer characters, five line breaks included, has to score that much more


# Classes of characters after folding.
_LETTER, _DIGIT, _SIGN, _SPACE, _STOP, _DROP, _OTHER = range(7)
# Letters that stand in for a Latin one; folding both scripts to one hides no Russian word from its n-grams.
_ALIKE = dict(zip("асеорхуіѕһԁԛԝјқγοναρτικ", "aceopxyishdqwjkyovaptik"))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Folded character and its class for every code below 0x10000: lower case, no accents, no width, one script for
    look-alikes, one blank, one digit."""
    fold, kind = np.zeros(0x10000, np.uint32), np.full(0x10000, _OTHER, np.uint8)
    for code in range(0x10000):
        c = chr(code)
        category = unicodedata.category(c)
        if c == "\n" or c == "\r":
            fold[code], kind[code] = 10, _SPACE
            continue
        if category in ("Cf", "Mn", "Cs") or code == 0:
            kind[code] = _DROP
            continue
        if category in ("Zs", "Cc"):
            fold[code], kind[code] = 32, _SPACE
            continue
        base = unicodedata.normalize("NFKD", c)[:1].lower()[:1] or c
        base = _ALIKE.get(base, base)
        fold[code] = ord(base) & 0xFFFF
        if base in "$@#*€":
            kind[code] = _SIGN
        elif base.isdigit():
            fold[code], kind[code] = 48, _DIGIT
        elif base.isalpha():
            kind[code] = _LETTER
        elif base in ".!?…":
            kind[code] = _STOP
    return fold, kind


_SPELT = re.compile(r"(?<!\w)[^\W\d_](?:([.\-_*~|/])[^\W\d_])(?:\1[^\W\d_])+(?!\w)|(?<!\w)[^\W\d_](?: [^\W\d_]){3,}(?!\w)")
_PAD = "\n" * 5
_HIGH = re.compile("[\U00010000-\U0010ffff]")


@cache
def _low(c: str) -> str:
    """The letter, digit or sign below 0x10000 that a character above stands for: by its compatibility form, or the letter
    in a filled circle or square or of a flag. Invisible ones vanish, others stay."""
    if unicodedata.category(c) in ("Cf", "Mn"):
        return ""
    for first in (0x1F150, 0x1F170, 0x1F1E6):
        if 0 <= ord(c) - first < 26:
            return chr(65 + ord(c) - first)
    plain = unicodedata.normalize("NFKC", c)
    return next((x for x in plain if x.isalnum()), plain)




class Normaliser:
    """Texts to one array of folded characters, whose disguises are undone: letter forms of any plane fold, invisible signs go, spelt-out words are joined,
    a digit or sign in place of a letter becomes *, numbers become 0, blanks shrink to one."""

    def __init__(self) -> None:
        self.fold, self.kind = _tables()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(characters, start of each text); every text ends with line breaks, so that none touches the next."""
        joined = [t + _PAD for t in texts]
        raw = _codes("".join(joined))
        if (raw >= 0x10000).any():
            joined = [_HIGH.sub(lambda m: _low(m[0]), t) for t in joined]
            raw = _codes("".join(joined))
        lengths = np.array([len(t) for t in joined], np.int64)
        raw = np.where(raw < 0x10000, raw, 0x25A1).astype(np.uint16)
        kind = self.kind[raw]
        # spelt-out words: letter, other, letter, other, letter with nothing longer between
        letter = kind == _LETTER
        if len(raw) > 6:
            single = np.zeros(len(raw), bool)  # a letter alone between others
            single[1:-1] = letter[1:-1] & ~letter[:-2] & ~letter[2:]
            pair = single[:-2] & single[2:]
            same = np.zeros(len(pair), bool)
            same[: len(pair) - 2] = pair[:-2] & pair[2:] & (raw[1 : len(pair) - 1] == raw[3 : len(pair) + 1])
            gap = raw[1:-1] == 32
            spelt = same & ~gap[: len(same)]
            spelt[:-2] |= same[:-2] & same[2:] & gap[: len(same) - 2]
            if spelt.any():
                starts = np.cumsum(lengths) - lengths
                for d in np.unique(np.searchsorted(starts, np.flatnonzero(spelt), side="right") - 1).tolist():
                    joined[d] = _SPELT.sub(lambda m: re.sub(r"[\W_]+", "", m[0]), joined[d])
                lengths = np.array([len(t) for t in joined], np.int64)
                raw = _codes("".join(joined))
                raw = np.where(raw < 0x10000, raw, 0x25A1).astype(np.uint16)
                kind = self.kind[raw]
        doc = np.repeat(np.arange(len(joined), dtype=np.int32), lengths)
        keep = kind != _DROP
        x, kind, doc = self.fold[raw[keep]], kind[keep], doc[keep]
        letter, digit, sign = kind == _LETTER, kind == _DIGIT, kind == _SIGN
        stand_in = digit | sign
        left, right = np.zeros(len(x), bool), np.zeros(len(x), bool)
        left[1:], right[:-1] = letter[:-1], letter[1:]
        for _ in range(3):  # runs of up to four stand-ins inside a word
            left[1:] |= stand_in[1:] & stand_in[:-1] & left[:-1]
            right[:-1] |= stand_in[:-1] & stand_in[1:] & right[1:]
        money = (x == 36) | (x == 64)
        inner = stand_in & left & right | money & (left | right)
        x = np.where(inner, np.uint32(42), x)
        digit &= ~inner
        again = np.zeros(len(x), bool)
        again[1:] = (digit[1:] & digit[:-1]) | ((x[1:] == 32) & (x[:-1] == 32))
        x, doc = x[~again], doc[~again]
        return x, np.searchsorted(doc, np.arange(len(joined)))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(x: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each character but the last size - 1."""
    h = np.full(len(x) - size + 1, np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF))
    for k in range(size):
        h ^= x[k : len(x) - size + 1 + k]
        h *= np.uint32(0x01000193)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - BITS)


def _cuts(x: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Starts of passages: of texts, after a sentence's end or a blank line, and of pieces of what is longer than PASSAGE."""
    stop = (x == 46) | (x == 33) | (x == 63) | (x == 8230)
    line = x == 10
    space = (x == 32) | line
    end = np.zeros(len(x), bool)
    end[2:] = ~space[2:] & space[1:-1] & (stop[:-2] | (line[1:-1] & line[:-2]))
    end[docs] = True
    starts = np.flatnonzero(end)
    wide = np.flatnonzero(np.diff(np.append(starts, len(x))) > PASSAGE)
    if len(wide):
        spaces, more = np.flatnonzero(space), []
        for i in wide.tolist():
            a, z = int(starts[i]), int(starts[i + 1]) if i + 1 < len(starts) else len(x)
            while z - a > PASSAGE:
                k = np.searchsorted(spaces, a + PASSAGE // 2)
                a = int(spaces[k]) if k < len(spaces) and spaces[k] < a + PASSAGE else a + PASSAGE
                if a >= z:
                    break
                more.append(a)
        starts = np.unique(np.concatenate((starts, np.array(more, np.int64))))
    return starts


def _scale(lengths: np.ndarray) -> np.ndarray:
    """What the sum over a passage's n-grams is divided by."""
    return np.sqrt(np.maximum(lengths, 30) * len(SIZES))


def _passage_scores(x: np.ndarray, cuts: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    total = np.zeros(len(x), np.float32)
    for n in SIZES:
        total[: len(x) - n + 1] += w[_hashes(x, n)]
    lengths = np.diff(np.append(cuts, len(x)))
    return b + np.add.reduceat(total, cuts) / _scale(lengths) - SCRAP * (lengths < SCRAP_CHARS)


@dataclass
class Model:
    """score = b + sum of w over a passage's n-grams / root of their number."""

    w: np.ndarray
    b: float
    threshold: float
    share: float = 1.0  # no larger part of a corpus is called abusive

    def passages(self, x: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and scores of the passages of folded texts."""
        cuts = _cuts(x, docs)
        return cuts, _passage_scores(x, cuts, self.w, self.b)

    def scores(self, texts: list[str], normalise: Normaliser) -> np.ndarray:
        """Worst passage of each text."""
        x, docs = normalise(texts)
        cuts, s = self.passages(x, docs)
        return np.maximum.reduceat(s, np.searchsorted(cuts, docs))


def _blocks(texts: list[str], chars: int = 1_000_000) -> Iterator[list[str]]:
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


class Passages:
    """All passages of some texts: their folded characters by block, the text and the length of each passage."""

    def __init__(self, texts: list[str]) -> None:
        normalise, owner, lengths, at = Normaliser(), [], [], 0
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []
        for block in _blocks(texts):
            x, docs = normalise(block)
            cuts = _cuts(x, docs)
            self.blocks.append((x.astype(np.uint16), cuts))
            owner.append(np.searchsorted(docs, cuts, side="right") - 1 + at)
            lengths.append(np.diff(np.append(cuts, len(x))))
            at += len(block)
        self.texts, self.owner, self.lengths = at, np.concatenate(owner), np.concatenate(lengths)

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.concatenate([_passage_scores(x.astype(np.uint32), cuts, w, b) for x, cuts in self.blocks])

    def worst(self, scores: np.ndarray) -> np.ndarray:
        """Highest score of each text."""
        return np.maximum.reduceat(scores, np.searchsorted(self.owner, np.arange(self.texts)))

    def grams(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, bucket) pairs of the chosen passages, each once."""
        keys, done = [], 0
        for x, cuts in self.blocks:
            n = np.diff(np.append(cuts, len(x)))
            place = np.repeat(np.arange(done, done + len(cuts), dtype=np.int64), n)
            inside = np.repeat(chosen[done : done + len(cuts)], n)
            wide = x.astype(np.uint32)
            keys += [place[: len(x) - k + 1][keep] << BITS | _hashes(wide, k)[keep] for k in SIZES for keep in (inside[: len(x) - k + 1],)]
            done += len(cuts)
        key = np.unique(np.concatenate(keys))
        return key >> BITS, key & ((1 << BITS) - 1)


def _regress(j, i, v, y, weight, size, rounds: int | None = None, l2=1.0):
    """Logistic regression on sparse (row i, column j, value v) by accelerated gradient steps."""
    n = len(y)
    w, b, mw, mb, k = np.zeros(size), 0.0, np.zeros(size), 0.0, 1.0
    lip = 0.25 * (weight * np.bincount(i, v * v, n)).sum() / weight.sum() + 0.25
    scale = weight.sum()
    step = min(4.0 / lip, scale / l2)  # the penalty weighs most on few rows and has to converge too
    for _ in range(rounds or ROUNDS):
        z = np.bincount(i, v * mw[j], n) + mb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / scale
        nw, nb = mw - step * (np.bincount(j, v * g[i], size) + l2 * mw / scale), mb - step * g.sum()
        nk = (1 + np.sqrt(1 + 4 * k * k)) / 2
        mw, mb = nw + (k - 1) / nk * (nw - w), nb + (k - 1) / nk * (nb - b)
        w, b, k = nw, nb, nk
    return w, b


@dataclass
class Suspicion:
    """What naive Bayes alone finds: weights of n-grams, the cut that most clean documents (USUAL) stay below, and ``share``,
    the part of all abuse in the corpus that lies in the labelled documents, as the n-grams of suspects show it."""

    w: np.ndarray
    cut: float
    share: float


def _log_ratios(held: np.ndarray, expected: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Log of how much more often suspects hold each n-gram than expected. An n-gram that all documents hold less than SEEN
    times can't tell anything; none speaks against abuse more than by -DOWN, so that one clear passage isn't outvoted."""
    r = np.log((held + PRIOR) / (expected + PRIOR))
    return np.where(corpus < SEEN, 0.0, np.maximum(r, -DOWN))


def suspect(passages: Passages, labels: np.ndarray, corpus: np.ndarray, corpus_passages: int) -> tuple[Suspicion, np.ndarray]:
    """Log-count ratios narrow all passages of documents labelled abusive to the suspects among them. Each turn compares with
    the middle, on a log scale, of the rate in the corpus at large and of the rate that n-grams of abuse have."""
    bad = labels[passages.owner]
    i, j = passages.grams(bad)
    suspects, share, usual = bad, 0.0, bad.sum() / max(1, corpus_passages)
    for turn in range(TURNS):
        held = np.bincount(j, suspects[i], len(corpus))
        if turn:
            rate = np.where(held >= SEEN, held / np.maximum(corpus, 1), 0.0)[j] * suspects[i]
            best = np.zeros(len(bad))
            np.maximum.at(best, i, rate)
            best = best[suspects & (best > 0)]
            share = min(1.0, float(np.median(best))) if len(best) else usual
            usual = suspects.sum() / max(1, corpus_passages)
        w = _log_ratios(held, (np.sqrt(share * usual) if turn else usual) * corpus, corpus)
        scores = passages.scores(w, 0.0)
        worst = passages.worst(scores)
        cut = float(np.quantile(worst[~labels], CLEAN))  # annotators err, so the worst few don't bind
        suspects = bad & (scores > cut)
        if not suspects.any():
            suspects = bad & (scores >= worst[passages.owner] - 1e-12)
    return Suspicion(w.astype(np.float32), float(np.quantile(worst[~labels], USUAL)), share), suspects


class Examples:
    """Suspects and the HARD worst passages of each clean document, with their n-grams: what the regression learns from."""

    def __init__(self, passages: Passages, labels: np.ndarray, found: Suspicion, suspects: np.ndarray) -> None:
        scores = passages.scores(found.w, 0.0)
        order = np.lexsort((-scores, passages.owner))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - np.searchsorted(passages.owner[order], passages.owner[order])
        chosen = suspects | ~labels[passages.owner] & (place < HARD)
        i, j = passages.grams(chosen)
        self.row, self.text = (np.cumsum(chosen) - 1)[i], passages.owner[chosen]
        self.known, self.column = np.unique(j, return_inverse=True)
        self.bad, self.scale = suspects[chosen], _scale(passages.lengths[chosen])
        self.labelled_bad = labels


def refine(examples: Examples, use: np.ndarray, found: Suspicion, corpus: np.ndarray, corpus_passages: int, high: np.ndarray) -> Model:
    """The classifier from the documents in ``use``: a logistic regression of suspects against the worst passages of clean
    documents on n-grams scaled by their log-count ratios, interpolated with naive Bayes. ``high`` counts each n-gram over
    all suspicious passages of the corpus: what is frequent among them but rare in documents labelled abusive is a harmless
    look-alike, whether or not some labelled document shows it."""
    mine = use[examples.text]
    here = mine[examples.row]
    row, column = (np.cumsum(mine) - 1)[examples.row[here]], examples.column[here]
    y, scale = examples.bad[mine].astype(float), examples.scale[mine]
    held = np.zeros(len(corpus))
    held[examples.known] = np.bincount(column, y[row], len(examples.known))
    part = use[examples.labelled_bad].mean()
    r = _log_ratios(held, np.maximum(high * (found.share * part / APART), corpus * (y.sum() / max(1, corpus_passages))), corpus)
    weight = np.where(y > 0, 0.3 / max(1, y.sum()), 0.7 / max(1, (1 - y).sum())) * len(y)
    fitted, b = _regress(column, row, r[examples.known][column] / scale[row], y, weight, len(examples.known))
    mean = np.abs(fitted).mean()
    w = np.full(len(corpus), NAIVE * mean)
    w[examples.known] += (1 - NAIVE) * fitted
    return Model((w * r).astype(np.float32), float(b), 0.0)


def abusive_share(corpus_worst: np.ndarray, labelled_worst: np.ndarray, labels: np.ndarray, edges: np.ndarray) -> float:
    """The part of all documents that is abusive, by adjusted count: at the cut that parts labelled documents best, as many
    documents of the corpus lie above as the share makes with the rates of both labels. ``corpus_worst`` is a histogram. One
    more clean document than seen is taken to lie above the cut, which matters where few are labelled. Where the corpus has
    no more above the cut than clean documents have, the count tells nothing: then it is the labelled share."""
    above = np.append(np.cumsum(corpus_worst[::-1])[::-1], 0) / max(1, corpus_worst.sum())
    count = lambda y: np.append(np.cumsum(np.bincount(np.searchsorted(edges, labelled_worst[labels == y], side="right"), minlength=len(corpus_worst))[::-1])[::-1], 0)
    tpr, fpr = count(True) / max(1, labels.sum()), (count(False) + 1) / (max(1, (~labels).sum()) + 2)
    k = int(np.argmax(tpr - fpr))
    if not above[k] > fpr[k] or not tpr[k] > fpr[k]:
        return float(labels.mean())
    return float(min((above[k] - fpr[k]) / (tpr[k] - fpr[k]), 0.5))


def corpus_counts(documents: DataFrame, found: Suspicion | None = None, slices: int = 64) -> tuple[np.ndarray, int, np.ndarray]:
    """Counts of each n-gram bucket over all documents (over their passages above ``found``'s cut, if given), the number of
    passages counted, and a histogram of the documents' worst scores. Each task sends its counts in slices; the slices are
    summed by as many groups, so what comes to the driver is 2^BITS numbers whatever the corpus."""
    step, bins = (1 << BITS) // slices, len(EDGES) + 1
    shared = documents.sparkSession.sparkContext.broadcast((found.w, found.cut)) if found else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normalise, total, passages, worst = per_worker("normaliser", Normaliser), np.zeros(1 << BITS, np.int64), 0, np.zeros(bins, np.int64)
        for batch in batches:
            for block in _blocks([t for t in batch.column(0).to_pylist() if t]):
                x, docs = normalise(block)
                cuts, inside = _cuts(x, docs), None
                if shared:
                    w, cut = shared.value
                    scores = _passage_scores(x, cuts, w, 0.0)
                    worst += np.bincount(np.searchsorted(EDGES, np.maximum.reduceat(scores, np.searchsorted(cuts, docs)), side="right"), minlength=bins)
                    inside = np.repeat(scores > cut, np.diff(np.append(cuts, len(x))))
                    passages += int((scores > cut).sum())
                else:
                    passages += len(cuts)
                for n in SIZES:
                    h = _hashes(x, n)
                    total += np.bincount(h if inside is None else h[inside[: len(h)]], minlength=1 << BITS)
        parts = [total[k * step : (k + 1) * step].tobytes() for k in range(slices)]
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array(parts, pa.binary()), pa.array([passages] * slices, pa.int64()), pa.array([worst.tobytes()] * slices, pa.binary())], names=["part", "counts", "passages", "worst"])

    def add(key, groups: Iterator) -> Iterator:
        import pandas as pd

        total, passages, worst = np.zeros(step, np.int64), 0, np.zeros(bins, np.int64)
        for pdf in groups:
            for c, h in zip(pdf["counts"], pdf["worst"]):
                total += np.frombuffer(c, np.int64)
                worst += np.frombuffer(h, np.int64)
            passages += int(pdf["passages"].sum())
        yield pd.DataFrame({"part": [key[0]], "counts": [total.tobytes()], "passages": [passages], "worst": [worst.tobytes()]})

    schema = "part int, counts binary, passages long, worst binary"
    sums = documents.select("text").mapInArrow(count, schema).groupBy("part").applyInPandas(_typed(add), schema)
    rows = sorted(sums.collect())
    if not rows:
        return np.zeros(1 << BITS), 0, np.zeros(bins)
    return np.concatenate([np.frombuffer(r.counts, np.int64) for r in rows]), rows[0].passages, np.frombuffer(rows[0].worst, np.int64)


def _typed(fn):
    """Names the types by which Spark hands a group over batch by batch."""
    import pandas as pd

    fn.__annotations__ = {"key": tuple[int, ...], "groups": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return fn


def best_threshold(scores: np.ndarray, labels: np.ndarray, share: float) -> float:
    """The cut with the best F-measure (BETA) in a corpus of which ``share`` is abusive: labelled documents are no random
    sample, so clean ones count as often as makes that share. The middle of the gap the cut falls into."""
    order = np.argsort(-scores)
    s, y = scores[order], labels[order]
    weight = max(1.0, (1 - share) / share * y.sum() / max(1, (~y).sum()))
    tp, fp = np.cumsum(y), np.cumsum(~y) * weight
    k = int(np.argmax((1 + BETA**2) * tp / (tp + fp + BETA**2 * max(1, y.sum()))))
    low = s[k + 1] if k + 1 < len(s) and np.isfinite(s[k + 1]) else s[k] - 1
    return float((s[k] + low) / 2)


def labelled_texts(documents: DataFrame, doc_label: DataFrame, max_docs: int, max_chars: int) -> tuple[list[str], np.ndarray, list[int]]:
    """Texts, labels and ids of at most ``max_docs`` labelled documents of ``max_chars`` characters together: those whose ids
    hash lowest, the same ones in each run. Several labels of a document count by majority, ties as abusive."""
    votes = doc_label.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.avg("toxic").alias("y"))
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    mine = documents.select("doc_id", "text").filter("text <> ''").join(F.broadcast(chosen), "doc_id")
    kept, chars = [], 0
    for r in sorted(mine.select("doc_id", F.length("text").alias("n"), F.xxhash64("doc_id").alias("h")).collect(), key=lambda r: (r.h, r.doc_id)):
        if chars + r.n <= max_chars:
            kept.append(r.doc_id)
            chars += r.n
    if not kept:
        return [], np.zeros(0, bool), []
    few = documents.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(kept)], "doc_id long")
    rows = sorted(mine.join(F.broadcast(few), "doc_id").collect(), key=lambda r: (r.doc_id, r.text))
    return [r.text for r in rows], np.array([r.y >= 0.5 for r in rows], bool), [r.doc_id for r in rows]


def train(documents: DataFrame, doc_label: DataFrame, max_docs: int = LABELLED_DOCS, max_chars: int = LABELLED_CHARS) -> Model:
    """A model from a bounded sample of labelled documents (see :func:`labelled_texts`) and counts over all documents.
    Without two labelled documents of each kind nothing is ever abusive."""
    texts, labels, ids = labelled_texts(documents, doc_label, max_docs, max_chars)
    if not len(labels) or min(labels.sum(), (~labels).sum()) < 2:
        return Model(np.zeros(1 << BITS, np.float32), -1.0, 0.0)
    corpus, n, _ = corpus_counts(documents)
    passages = Passages(texts)
    found, suspects = suspect(passages, labels, corpus, n)
    high, _, worst = corpus_counts(documents, found)
    return fit(passages, labels, ids, found, suspects, corpus, n, high, worst)


def fit(passages: Passages, labels: np.ndarray, ids: list[int], found: Suspicion, suspects: np.ndarray, corpus: np.ndarray, corpus_passages: int, high: np.ndarray, worst: np.ndarray) -> Model:
    """The model of all labelled documents, and the best cut of their scores by models of the other folds."""
    examples = Examples(passages, labels, found, suspects)
    make = lambda use: refine(examples, use, found, corpus, corpus_passages, high)
    model, fold, held = make(np.ones(len(labels), bool)), folds(labels, ids), np.empty(len(labels))
    for k in np.unique(fold):
        part = make(fold != k)
        held[fold == k] = passages.worst(passages.scores(part.w, part.b))[fold == k]
    share = abusive_share(worst, passages.worst(passages.scores(found.w, 0.0)), labels, EDGES)
    model.threshold, model.share = best_threshold(held, labels, share), share
    return model


def folds(labels: np.ndarray, ids: list[int]) -> np.ndarray:
    """The fold of each document, by the order of its id's hash among those of its class: all folds hold both classes if
    there are as many documents of each."""
    fold, mark = np.zeros(len(ids), np.int64), np.array([zlib.crc32(str(i).encode()) for i in ids], np.int64)
    for y in (False, True):
        at = np.flatnonzero(labels == y)
        fold[at[np.argsort(mark[at], kind="stable")]] = np.arange(len(at)) % FOLDS
    return fold


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, source, score, abusive). Null, empty and too short texts score null and aren't abusive. The scores are a
    durable table first: no more of the documents are called abusive than the share of abuse that the model's counts showed,
    so a cut from few labels can't run away."""
    shared = documents.sparkSession.sparkContext.broadcast((model.w, model.b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, normalise = Model(*shared.value, 0.0), per_worker("normaliser", Normaliser)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            have = [k for k, t in enumerate(texts) if t]
            scores = np.full(len(texts), np.nan)
            if have:
                scores[have] = np.concatenate([m.scores(block, normalise) for block in _blocks([texts[k] for k in have])])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64(), mask=np.isnan(scores))], names=["doc_id", "source", "score"])

    scored = documents.select(F.col("doc_id").cast("long"), "source", "text").mapInArrow(run, "doc_id long, source string, score double")
    if model.share >= 1:
        return scored.withColumn("abusive", F.coalesce(F.col("score") > model.threshold, F.lit(False)))
    scored = durable(scored)
    least = scored.agg(F.percentile_approx("score", 1.0 - model.share, 100_000)).first()[0]
    return scored.withColumn("abusive", F.coalesce(F.col("score") > F.lit(max(model.threshold, model.threshold if least is None else least)), F.lit(False)))


def rates(scored: DataFrame) -> DataFrame:
    """(source, n_docs, n_abusive, rate): sources compare trimmed and in lower case; documents without one count under ''."""
    source = F.coalesce(norm_id(F.col("source")), F.lit(""))
    return scored.groupBy(source.alias("source")).agg(F.count("*").alias("n_docs"), F.count_if("abusive").alias("n_abusive"), F.avg(F.col("abusive").cast("int")).alias("rate"))
