"""Mapping of freely typed values to a canonical list (problem 5).

The reference's labels and synonyms are forms: multisets of words. Two BK-trees under the Levenshtein distance are searched
with a radius of two edits, and give every answer within it: one of the reference's words, for each word of a value that no
form has, and one of the entries' whole forms without spaces, for values split into words otherwise than the form. Of the
answers an edit of one letter, one exchange of neighbours, an inflection or a marked abbreviation counts. A value
stands for a form if its words and the form's match one to one; the cheapest entry wins. A word that the reference knows
is never read as another one, and a word left over means something else. Slips count in words of at least four letters in
the reference; neither the words of a value nor their letters nor their candidates are otherwise limited.

Rows are mapped where they lie: no shuffle, no pairs. A reference above ``forms_at_once`` forms is sharded by entry, and
distinct values are matched with each shard in blocks; the shards' winners then merge by a minimum per value.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import product
from math import inf, prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.common import durable, heavy_keys, non_blank, norm_id, per_worker, split_join
from lexweave.llm.bktree import BKTree, swapped

# Words that add nothing to a value.
FILLERS = frozenset("a an the term terms see etc tbc tba tbd ie eg cf aka called so named and or der die das ein eine siehe usw bzw begriff термин см смотри это и тд др или".split())
# Latin writing of Russian letters, and the Russian letters on the keys of a Latin keyboard.
LATIN = dict(zip("абвгдезийклмнопрстуфыэ", "abvgdeziyklmnoprstufye")) | {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya"}
KEYS = dict(zip("qwertyuiop[]asdfghjkl;'zxcvbnm,.`", "йцукенгшщзхъфывапролджэячсмитьбюе"))
# Endings by which Russian word forms differ, the empty one included.
ENDINGS = frozenset("а я о е и ы у ю ь й ов ев ей ам ям ом ем ём ой ах ях ами ями ого его ому ему ый ий ая яя ое ее ые ие ых их ым им ую юю ью ия ию ии ием иям иями иях".split()) | {""}
RUSSIAN = re.compile("[а-я]")
JOINED, JOINED_SLIP = 100.0, 200.0  # costs of a form split into words otherwise: it counts only where no form's words match
CHOICES = 1_000  # choices of candidates that are tried one by one; of more, forms are looked up and assigned


def clean(value: str) -> str:
    t = unicodedata.normalize("NFKC", value).lower().replace("ё", "е")
    return "".join(c for c in t if unicodedata.category(c) != "Cf")


def words_of(text: str) -> list[tuple[str, bool]]:
    """Words of a cleaned text, and whether a full stop follows each."""
    return [(m[1], bool(m[2])) for m in re.finditer(r"([^\W_]+)(\.)?", text)]


def swap_keys(text: str) -> str:
    """What was meant if Russian was typed with a Latin keyboard."""
    return "".join(KEYS.get(c, c) for c in text)


def swapped_reading(text: str) -> list[tuple[float, list[tuple[str, bool]]]]:
    """(cost, words) of a text of Latin letters if Russian was meant."""
    words = words_of(swap_keys(text.strip())) if re.search("[a-z]", text) and not RUSSIAN.search(text) else []
    return [(0.05, words)] if words else []


def inflected(word: str, known: str) -> bool:
    """Whether both are forms of one word: equal but for an ending."""
    if RUSSIAN.match(known):
        n = 0
        while n < min(len(word), len(known)) and word[n] == known[n]:
            n += 1
        return n >= max(3, len(known) - 3) and any(word[k:] in ENDINGS and known[k:] in ENDINGS for k in range(max(3, n - 1), n + 1))
    return word in (known + "s", known + "es", known + "'s") or known.endswith("y") and word == known[:-1] + "ies"


def cheapest(costs: list[list[float]]) -> float:
    """Sum of the cheapest one-to-one assignment of rows to columns of a square matrix (Hungarian method), inf without one."""
    if any(min(row) == inf for row in costs):
        return inf
    n, never = len(costs), 1e6
    rows, cols, taken = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        taken[0], at, least, back, seen = i, 0, [inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while taken[at]:
            seen[at], row, step, to = True, taken[at], inf, 0
            for j in range(1, n + 1):
                if not seen[j]:
                    d = min(costs[row - 1][j - 1], never) - rows[row] - cols[j]
                    if d < least[j]:
                        least[j], back[j] = d, at
                    if least[j] < step:
                        step, to = least[j], j
            for j in range(n + 1):
                if seen[j]:
                    rows[taken[j]] += step
                    cols[j] -= step
                else:
                    least[j] -= step
            at = to
        while at:
            taken[at], at = taken[back[at]], back[at]
    chosen = sorted((taken[j], costs[taken[j] - 1][j - 1]) for j in range(1, n + 1))
    return sum(c for _, c in chosen)


class Reference:
    """Compiled forms of some entries; ``known`` are the words of all entries."""

    def __init__(self, forms: list[tuple[str, str]], known: set[str]) -> None:
        self.by_words: dict[tuple[str, ...], str] = {}
        self.by_word: dict[tuple[int, str], list[tuple[str, ...]]] = {}  # forms by their number of words and each word
        self.joined: dict[str, str] = {}
        self.parts: dict[str, set[int]] = {}  # numbers of words that the forms with these joined letters have
        self.latin: dict[str, list[str]] = {}
        self.words: set[str] = set()
        for entry, form in sorted(forms):
            ws = [w for w, _ in words_of(clean(form))]
            if not ws:
                continue
            self.by_words.setdefault(tuple(sorted(ws)), entry)
            self.joined.setdefault("".join(ws), entry)
            self.parts.setdefault("".join(ws), set()).add(len(ws))
            self.words.update(ws)
        self.sizes = set(map(len, self.by_words))
        for w in self.words:
            if RUSSIAN.match(w):
                self.latin.setdefault("".join(LATIN.get(c, c) for c in w), []).append(w)
        for j, e in list(self.joined.items()):
            if RUSSIAN.match(j):
                self.joined.setdefault(latin := "".join(LATIN.get(c, c) for c in j), e)
                self.parts.setdefault(latin, set()).update(self.parts[j])
        self.known = known | self.words
        self.tree = BKTree([*self.words, *self.latin])
        self.entry_tree: BKTree | None = None
        self.prefixes: dict[str, set[str]] = {}
        for w in self.words:
            for k in range(3, len(w)):
                self.prefixes.setdefault(w[:k], set()).add(w)
        for t, ws in self.latin.items():
            for k in range(4, len(t)):
                self.prefixes.setdefault(t[:k], set()).update(ws)
        self.near: dict[str, list[tuple[str, float]]] = {}
        self.near_joined: dict[str, list[tuple[str, int]]] = {}

    def _search(self, words: set[str]) -> None:
        """Fills ``near`` for words that the reference doesn't have."""
        longest = max(map(len, self.tree.words), default=0) + 2  # longer words are out of the radius
        todo = sorted(w for w in words if w not in self.near and 3 <= len(w) <= longest)
        for w, hits in zip(todo, self.tree.search(todo, 2)):
            best: dict[str, float] = {}
            for hit, d in hits:
                slip = d == 1 or swapped(w, hit)
                if not slip or len(hit) < 4:
                    continue
                for known in [hit] * (hit in self.words) + self.latin.get(hit, []):
                    best[known] = min(best.get(known, 9.0), 1.0)
            self.near[w] = list(best.items())

    def candidates(self, word: str, stop: bool) -> list[tuple[str, float]]:
        if word in self.words:
            return [(word, 0.0)]
        best: dict[str, float] = {w: 0.05 for w in self.latin.get(word, ())}
        if stop:
            for w in self.prefixes.get(word, ()):
                best[w] = 0.2
        if word not in self.known:
            for k in range(3, len(word) + 1):
                for w in self.prefixes.get(word[:k], ()) if k >= len(word) - 4 else ():
                    if w not in best and inflected(word, w):
                        best[w] = 0.1
                if word[:k] in self.words and inflected(word, word[:k]):
                    best[word[:k]] = 0.1
            for w, cost in self.near.get(word, ()):
                best[w] = min(best.get(w, 9.0), cost)
        return list(best.items())

    def _assemble(self, words: list[tuple[str, bool]]) -> tuple[float, str] | None:
        """Cheapest entry whose form these words are."""
        if len(words) not in self.sizes:
            return None
        exact = self.by_words.get(tuple(sorted(w for w, _ in words)))
        if exact is not None:
            return 0.0, exact
        sets = [self.candidates(w, stop) for w, stop in words]
        if any(not s for s in sets):
            return None
        if prod(len(s) for s in sets) > CHOICES:
            return self._assemble_by_form(sets)
        best = None
        for choice in product(*sets):
            entry = self.by_words.get(tuple(sorted(w for w, _ in choice)))
            if entry is not None:
                found = (sum(c for _, c in choice), entry)
                best = found if best is None or found < best else best
        return best

    def _assemble_by_form(self, sets: list[list[tuple[str, float]]]) -> tuple[float, str] | None:
        """The same for many choices: of all forms of so many words that hold a candidate of the rarest word, the one whose
        words are assigned most cheaply."""
        if not self.by_word:
            for form in self.by_words:
                for w in set(form):
                    self.by_word.setdefault((len(form), w), []).append(form)
        n, costs = len(sets), [dict(s) for s in sets]
        rarest = min(sets, key=lambda s: sum(len(self.by_word.get((n, w), ())) for w, _ in s))
        best = None
        for form in {f for w, _ in rarest for f in self.by_word.get((n, w), ())}:
            cost = cheapest([[c.get(w, inf) for w in form] for c in costs])
            if cost < inf:
                found = (cost, self.by_words[form])
                best = found if best is None or found < best else best
        return best

    def match(self, values: list[str]) -> list[tuple[float, str] | None]:
        """Cheapest entry of each value."""
        readings = []
        for v in values:
            text = clean(v)
            these = [(0.0, words_of(text))]
            if any(w not in self.known and w not in FILLERS for w, _ in these[0][1]):
                these += swapped_reading(text)
            readings.append(these)
        self._search({w for these in readings for _, ws in these for w, _ in ws if w not in self.words and w not in FILLERS and not w.isdigit()})
        longest = max(map(len, self.joined), default=0) + 2
        out: list[tuple[float, str] | None] = []
        left: list[tuple[int, str, int]] = []
        for k, these in enumerate(readings):
            found = []
            for cost, ws in these:
                bare = [x for x in ws if x[0] not in FILLERS]
                for extra, some in ((0.0, ws), (0.01, bare)):
                    if (hit := self._assemble(some)) is not None:
                        found.append((hit[0] + cost + extra, hit[1]))
                if not found:
                    for some in (ws, bare):
                        j = "".join(w for w, _ in some)
                        if j in self.joined:
                            found.append((JOINED + cost, self.joined[j]))
                        elif 3 <= len(j) <= longest and j not in self.known and any(w not in self.known for w, _ in some):
                            left.append((k, j, len(some)))
            out.append(min(found) if found else None)
        left = [x for x in left if out[x[0]] is None]
        todo = sorted({j for _, j, _ in left if j not in self.near_joined})
        if todo and self.entry_tree is None:
            self.entry_tree = BKTree(list(self.joined))
        for j, hits in zip(todo, self.entry_tree.search(todo, 2) if todo else ()):
            self.near_joined[j] = [(w, d) for w, d in hits if len(w) > 3 and (d == 1 or swapped(j, w))]
        for k, j, n in left:
            for w, _ in self.near_joined[j]:
                if self.parts[w] != {n}:  # split alike, the words have to match one to one
                    found = (JOINED_SLIP, self.joined[w])
                    out[k] = found if out[k] is None or found < out[k] else out[k]
        return out


def typed_values(text_entity: DataFrame, test_glossary: DataFrame) -> DataFrame:
    """(tbl, row_id, value): values typed by people. The filter on the extractor reaches the scan."""
    a = text_entity.filter(F.col("extractor_type") == "manual").select(F.lit("text_entity").alias("tbl"), F.col("te_id").alias("row_id"), F.col("text").alias("value"))
    b = test_glossary.filter(norm_id(F.col("source")) == "intake_form").select(F.lit("test_glossary").alias("tbl"), F.col("entry_id").alias("row_id"), F.col("label").alias("value"))
    return a.unionByName(b)


def _map(values: DataFrame, forms: list[tuple[str, str]], known: set[str], rows_at_once: int = 20_000) -> DataFrame:
    schema = pa.schema([("tbl", pa.string()), ("row_id", pa.int64()), ("value", pa.string()), ("core_id", pa.string()), ("cost", pa.float64())])

    key = zlib.crc32(repr((sorted(forms), sorted(known))).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref = None
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            tbl, row, value = ([x for b in held for x in b.column(c).to_pylist()] for c in range(3))
            distinct = sorted({v for v in value if v and not v.isspace()})
            found = dict(zip(distinct, ref.match(distinct)))
            hits = [found.get(v) for v in value]
            return pa.RecordBatch.from_arrays([pa.array(tbl, pa.string()), pa.array(row, pa.int64()), pa.array(value, pa.string()), pa.array([h and h[1] for h in hits], pa.string()), pa.array([h and h[0] for h in hits], pa.float64())], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            ref = ref or per_worker(("reference", key), lambda: Reference(forms, known))
            held.append(b)
            if sum(x.num_rows for x in held) >= rows_at_once:
                yield flush()
                held = []
        if held:
            yield flush()

    return values.select("tbl", F.col("row_id").cast("long"), "value").mapInArrow(run, "tbl string, row_id long, value string, core_id string, cost double")


def map_values(values: DataFrame, reference: DataFrame, forms_at_once: int = 100_000, values_at_once: int = 50_000) -> DataFrame:
    """(tbl, row_id, value, core_id, cost) of all rows of values(tbl, row_id, value); core_id is null for unmatched, null
    and blank values. ``reference(id, label, synonyms)`` is counted first; up to ``forms_at_once`` forms go to the tasks
    with the code, more are matched in blocks (see :func:`_map_in_blocks`) with the same answers. Ids come out trimmed and in lower case; equal costs go to the smallest id."""
    forms = reference.select(norm_id(F.col("id")).alias("id"), F.explode(F.concat(F.array("label"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("form")).filter("form IS NOT NULL AND id <> ''")
    n_forms = forms.count()
    if n_forms <= forms_at_once:
        return _map(values, [tuple(r) for r in forms.collect()], set())
    return _map_in_blocks(values, forms, -(-n_forms // forms_at_once), values_at_once)


def _words(df: DataFrame, column: str, readings: bool) -> DataFrame:
    """(column, word): the words of a column's cleaned text, with ``readings`` also those of the other keyboard and the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = set()
            for v in b.column(0).to_pylist():
                every = [words_of(clean(v))] + ([ws for _, ws in swapped_reading(clean(v))] if readings else [])
                pairs |= {(v, w) for ws in every for w in [*(w for w, _ in ws), *(["".join(w for w, _ in ws)] if readings else [])]}
            both = sorted(pairs)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in both], pa.string()) for k in (0, 1)], names=[column, "word"])

    return df.select(column).mapInArrow(run, f"{column} string, word string")


def _map_in_blocks(values: DataFrame, forms: DataFrame, shards: int, values_at_once: int) -> DataFrame:
    """The mapping for any reference: a grid of blocks, each of one shard of the entries and about ``values_at_once`` distinct
    values, that one task matches at a time. A value comes with those of its words that some entry anywhere knows, so all
    shards decide alike, and the cheapest of the shards' winners is that of the whole reference. Nothing goes through the
    driver; hot values skip the shuffle of the join back."""
    asked = values.filter(non_blank(F.col("value"))).select("value").distinct()
    known = _words(asked, "value", True).join(_words(forms, "form", False).select("word").distinct(), "word", "left_semi")
    asked = durable(asked.join(known.groupBy("value").agg(F.collect_set("word").alias("known")), "value", "left"))
    blocks = max(1, -(-asked.count() // values_at_once))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.select("value", "known", place("value", blocks).alias("block"), every(shards).alias("shard"))
    right = forms.select("id", "form", place("id", shards).alias("shard"), every(blocks).alias("block"))

    def run(mine: pa.Table, those: pa.Table) -> pa.Table:
        found, texts = list(zip(those.column("id").to_pylist(), those.column("form").to_pylist())), mine.column("value").to_pylist()
        hits = Reference(found, {w for ws in mine.column("known").to_pylist() for w in ws or ()}).match(texts)
        return pa.table({"value": pa.array(texts, pa.string()), "core_id": pa.array([h and h[1] for h in hits], pa.string()), "cost": pa.array([h and h[0] for h in hits], pa.float64())})

    hits = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, "value string, core_id string, cost double")
    best = hits.filter("core_id IS NOT NULL").groupBy("value").agg(F.min(F.struct("cost", "core_id")).alias("b"))
    best = durable(best.select("value", "b.core_id", "b.cost"))
    hot = heavy_keys(values.groupBy("value").agg(F.count("*").alias("n")), "value")
    return split_join(values.select("tbl", F.col("row_id").cast("long").alias("row_id"), "value"), best, "value", hot).select("tbl", "row_id", "value", "core_id", "cost")


def mapped_found(text_entity: DataFrame, test_glossary: DataFrame, core_glossary: DataFrame) -> DataFrame:
    return map_values(typed_values(text_entity, test_glossary), core_glossary).filter("core_id IS NOT NULL").select("tbl", "row_id", "core_id")
