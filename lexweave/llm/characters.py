"""Visually identical text with different characters (problem 3).

A transducer is compiled once from Unicode data: its keys are grapheme clusters (a base with its marks, or one sign), its
values the plain form. Three mappings exist, one for each script a word can belong to (Latin, Cyrillic, none); each is
checked for conflicts: a key has one value, and no value holds a key. A value is read once, left to right: for each word
the script is settled by the letters that only one script has, then the longest key at each place is replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.common import durable, heavy_keys, per_worker, split_join

# Letters of other scripts that look like a Latin letter.
CYRILLIC_AS_LATIN = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Ӏ": "I", "Һ": "h",
}
GREEK_AS_LATIN = {
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
}
# Letters of other scripts that look like a Russian letter.
LATIN_AS_RUSSIAN = {
    "a": "а", "c": "с", "e": "е", "o": "о", "p": "р", "x": "х", "y": "у",
    "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "K": "К", "M": "М", "O": "О", "P": "Р", "T": "Т", "X": "Х", "Y": "У",
}
GREEK_AS_RUSSIAN = {
    "α": "а", "ο": "о", "ρ": "р", "χ": "х", "ϲ": "с", "γ": "у",
    "Α": "А", "Β": "В", "Ε": "Е", "Η": "Н", "Κ": "К", "Μ": "М", "Ο": "О", "Ρ": "Р", "Τ": "Т", "Χ": "Х", "Υ": "У", "Ϲ": "С", "Γ": "Г", "Π": "П", "Φ": "Ф",
}
# Hyphens that look like the ordinary one, the script g, and signs that are invisible though not of category Cf.
HYPHENS = "‐‑﹣－"
SINGLE = {"ɡ": "g"}
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))

_MARKS = "".join(map(chr, range(0x300, 0x370)))


def _general() -> dict[str, str]:
    """What doesn't depend on the word's script: widths, spaces, hyphens, invisible signs, ligatures, composed accents."""
    out = {c: "-" for c in HYPHENS} | SINGLE | {c: "" for c in INVISIBLE}
    for code in range(0x80, 0x20000):
        c = chr(code)
        kind, split = unicodedata.category(c), unicodedata.decomposition(c)
        if kind == "Cf":
            out[c] = ""
        elif kind == "Zs":
            out[c] = " "
        elif c in out:
            continue
        elif split.startswith(("<wide>", "<narrow>", "<font>")) or split.startswith("<compat>") and (0xFB00 <= code <= 0xFB06 or 0x2160 <= code <= 0x217F):
            out[c] = unicodedata.normalize("NFKC", c)
        elif split and split[0] != "<":
            if (plain := unicodedata.normalize("NFC", c)) != c:
                out[c] = plain
            apart = unicodedata.normalize("NFD", c)
            if 1 < len(apart) <= 3 and apart[1] in _MARKS and unicodedata.normalize("NFC", apart) == c:
                out[apart] = c
                if len(apart) == 3 and len(half := unicodedata.normalize("NFC", apart[:2])) == 1:
                    out[half + apart[2]] = c
    return out


def _lookalikes(*tables: dict[str, str]) -> dict[str, str]:
    """Look-alike letters, alone and with marks: the look-alike of an accented letter is the look-alike base's accented form."""
    out: dict[str, str] = {}
    for table in tables:
        for a, b in table.items():
            if out.setdefault(a, b) != b:
                raise ValueError(f"conflict: {a!r} to {out[a]!r} and {b!r}")
            for m in _MARKS:
                marked = unicodedata.normalize("NFC", b + m)
                if len(marked) == 1:
                    out.setdefault(a + m, marked)
                    if len(one := unicodedata.normalize("NFC", a + m)) == 1:
                        out.setdefault(one, marked)
    return out


def _closed(table: dict[str, str]) -> dict[str, str]:
    """The table with every value itself brought to plain form, so that one pass suffices."""

    def settle(text: str) -> str:
        for n in (3, 2, 1):
            for i in range(len(text) - n + 1):
                hit = table.get(text[i : i + n])
                if hit is not None and hit != text[i : i + n]:
                    return settle(text[:i] + hit + text[i + n :])
        return text

    return {k: v for k, v in ((k, settle(v)) for k, v in table.items()) if k != v}


class Transducer:
    """Compiled mapping with longest match over grapheme clusters."""

    def __init__(self) -> None:
        base = _general()
        latin, russian = _lookalikes(CYRILLIC_AS_LATIN, GREEK_AS_LATIN), _lookalikes(LATIN_AS_RUSSIAN, GREEK_AS_RUSSIAN)
        self.maps = {name: _closed(base | more) for name, more in (("", {}), ("L", latin), ("C", russian))}
        for name, table in self.maps.items():
            self._check(name, table)
        self.longest = max(len(k) for t in self.maps.values() for k in t)
        self.russian = {c for c in CYRILLIC_AS_LATIN if c in "асеорхуАВСЕНКМОРТХУ"}
        self.either = self.russian | set(LATIN_AS_RUSSIAN)
        self.foreign = set(CYRILLIC_AS_LATIN) - self.russian
        self.invisible = regex.compile("[" + regex.escape("".join(c for c, v in base.items() if not v)) + "]+")
        self.word = regex.compile(r"[\p{L}\p{M}\p{Cf}Ⅰ-ⅿ" + regex.escape(INVISIBLE) + "]+")
        self.one_script = regex.compile(r"[\p{Latin}\p{M}\p{Cf}]+|[\p{Cyrillic}\p{M}\p{Cf}]+|[\p{Greek}\p{M}\p{Cf}]+")
        self.ascii_either = regex.compile(rf"(?<![A-Za-z])[{''.join(sorted(c for c in self.either if c.isascii()))}]++(?![A-Za-z])")
        # Russian and plain signs only, each word with a letter that no Latin one looks like: nothing to replace.
        sure = "".join(sorted(set("абвгдеёжзийклмнопрстуфхцчшщъыьэюя" + "абвгдеёжзийклмнопрстуфхцчшщъыьэюя".upper()) - self.russian))
        self.plain = regex.compile(rf"(?:[\x00-\x40\x5b-\x60\x7b-\x7f«»“”„–—…№]|[{''.join(self.russian)}]*+[{sure}][а-яёА-ЯЁ]*+(?![A-Za-z]))*+")

    @staticmethod
    def _check(name: str, table: dict[str, str]) -> None:
        for value in set(table.values()):
            if any(value[i : i + n] in table for n in (1, 2, 3) for i in range(len(value) - n + 1)):
                raise ValueError(f"mapping {name!r} has {value!r} both as a value and as a key")

    def script(self, word: str) -> tuple[str, str]:
        """('L', 'C' or 'G', '') if some letter settles the script of a word, else ('', skeleton): its Latin form in lower case."""
        latin = cyrillic = greek = foreign = 0
        skeleton = []
        base = self.maps[""]
        for c in word:
            for x in unicodedata.normalize("NFD", base.get(c, c))[:1]:
                if x in self.either or x in self.foreign:
                    skeleton.append(CYRILLIC_AS_LATIN.get(x, x))
                    foreign += x in self.foreign
                elif x.isascii() or "À" <= x < "ɐ":
                    latin += 1
                elif "Ѐ" <= x < "\u0530":
                    cyrillic += 1
                elif "Ͱ" <= x < "Ѐ" or "ἀ" <= x < "\u2000":
                    greek += 1
                    skeleton.append(GREEK_AS_LATIN.get(x, x))
        if latin or cyrillic:
            return ("L" if latin >= cyrillic else "C"), ""
        if greek and len(skeleton) == greek:
            return "G", ""  # a Greek word, or one Greek letter as a symbol
        if foreign:
            return "L", ""  # no Russian word has these letters
        return "", "".join(skeleton).lower()

    def apply(self, value: str, votes: dict[str, str]) -> str:
        """The value in plain form. ``votes`` names the usual script of words whose letters could be of either; such a word
        without a vote follows the other words' script if it mixes both, and else stays as it is."""
        if value.isascii():
            if not any(votes.get(m[0].lower()) == "C" for m in self.ascii_either.finditer(value)):
                return value
        elif self.plain.fullmatch(value):
            return value
        words = [m.span() for m in self.word.finditer(value)]
        scripts = [self.script(value[a:b]) for a, b in words]
        sure = {s for s, _ in scripts if s in ("L", "C")}
        out, end = [], 0
        for (a, b), (s, skeleton) in zip(words, scripts):
            if not s and skeleton:
                word = value[a:b]
                s = votes.get(skeleton) or (min(sure) if len(sure) == 1 and not self.one_script.fullmatch(word) else "")
            out += [self._run(value[end:a], ""), self._run(value[a:b], "" if s == "G" else s)]
            end = b
        return "".join([*out, self._run(value[end:], "")])

    def _run(self, text: str, script: str) -> str:
        if not text or text.isascii() and script != "C":
            return text
        table = self.maps[script]
        text = self.invisible.sub("", text)
        out: list[str] = []
        i, n = 0, len(text)
        while i < n:
            for size in range(min(self.longest, n - i), 0, -1):
                hit = table.get(text[i : i + size])
                if hit is not None:
                    break
            else:
                hit, size = text[i], 1
            if out and hit and (pair := table.get(out[-1] + hit)) is not None:
                out[-1] = pair  # a mark after a letter that was itself replaced
            else:
                out.extend(hit)
            i += size
        return "".join(out)


def values(text_entity: DataFrame, test_glossary: DataFrame) -> DataFrame:
    """(tbl, row_id, pos_no, value) of every non-null value."""
    a = text_entity.select(F.lit("text_entity").alias("tbl"), F.col("te_id").alias("row_id"), F.lit(0).alias("pos_no"), F.col("original_text").alias("value"))
    b = test_glossary.select(F.lit("test_glossary").alias("tbl"), F.col("entry_id").alias("row_id"), F.posexplode("synonyms").alias("pos_no", "value"))
    return a.unionByName(b).filter("value IS NOT NULL")


_PLAIN, _RUSSIAN, _OTHER = 0xE000, 0xE100, 0xE200  # private blocks: plain Latin letters, plain Russian ones, other writings


@cache
def _skeletons() -> tuple[str, str]:
    """A translation that turns every letter that may stand for one of either script into the Latin letter of its skeleton, in
    the private block that says how it is written; what vanishes has no counterpart and stands at the end."""
    t = Transducer()
    base, letters, gone = t.maps[""], {}, ""
    for c in {*map(chr, (*range(0xD800), *range(0xE000, 0x10000))), *(k for k in base if len(k) == 1)}:
        if t.word.fullmatch(c) and not regex.match(r"[\p{M}\p{Cf}]", c):
            x = unicodedata.normalize("NFD", base.get(c, c))[:1]
            if not x:
                gone += c
            elif (one := CYRILLIC_AS_LATIN.get(x, x) if x in t.either else GREEK_AS_LATIN.get(x, "")) and len(one) == 1:
                block = _PLAIN if c in LATIN_AS_RUSSIAN else _RUSSIAN if c in t.russian else _OTHER
                letters[c] = chr(block + ord(one.lower()))
    alike = "".join(sorted(letters))
    hidden = "".join(c for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if unicodedata.category(c) == "Cf")
    private = "".join(map(chr, range(_PLAIN, _OTHER + 0x100)))  # a value's own signs of these blocks part words
    return alike + private + gone + hidden, "".join(letters[c] for c in alike) + " " * len(private)


def _words() -> Column:
    """The words of ``value`` whose letters could be of either script, translated (see :func:`_skeletons`). A translation and
    ranges keep the pattern short: it runs over every value."""
    private = rf"{chr(_PLAIN)}-{chr(_OTHER + 0xFF)}"
    pattern = rf"(?<![\p{{L}}\p{{M}}{private}])([{private}\p{{M}}]++)(?!\p{{L}})"
    return F.regexp_extract_all(F.translate("value", *_skeletons()), F.lit(pattern), F.lit(1))


def _key(word: Column) -> Column:
    """The skeleton of a translated word."""
    ascii_letters = [chr(x) for x in range(97, 123)]
    return F.translate(F.regexp_replace(word, r"\p{M}", ""), "".join(chr(b + ord(c)) for b in (_PLAIN, _RUSSIAN, _OTHER) for c in ascii_letters), "".join(ascii_letters) * 3)


def script_votes(vals: DataFrame) -> DataFrame:
    """(k, script): the usual script of each word whose letters could be Latin or Russian, where it is written in more than
    one way (in one script, in both mixed, with Greek, accented or wide letters): what most of all values use of the two
    plain ones. Counts come from all values."""
    only = lambda block: F.col("w").rlike(f"^[{chr(block)}-{chr(block + 0xFF)}]+$")
    counts = vals.select(F.explode(_words()).alias("w")).groupBy(_key(F.col("w")).alias("k")).agg(F.count_if(only(_PLAIN)).alias("l"), F.count_if(only(_RUSSIAN)).alias("c"), F.count("*").alias("n"))
    return counts.filter("l < n AND c < n AND l <> c").select("k", F.when(F.col("l") > F.col("c"), "L").otherwise("C").alias("script"))


def plain_values(vals: DataFrame, votes: DataFrame, bound: int = 50_000) -> DataFrame:
    """Adds ``plain``: the value in its one consistent form, in one pass over Arrow batches. Up to ``bound`` votes, counted
    first, go to the tasks with the code, without a shuffle; more are joined to the values that hold their words."""
    few = votes.limit(bound + 1).collect()
    known = {r.k: r.script for r in few} if len(few) <= bound else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = per_worker("transducer", Transducer)
        for b in batches:
            own = [dict(x or ()) for x in b.column("votes").to_pylist()] if known is None else [known] * b.num_rows
            plain = [t.apply(v, w) for v, w in zip(b.column("value").to_pylist(), own)]
            kept = [c for c in b.schema.names if c != "votes"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(plain, pa.string())], names=[*kept, "plain"])

    if known is None:
        asked = vals.select("value").distinct().select("value", F.explode(F.array_distinct(F.transform(_words(), _key))).alias("k"))
        found = asked.join(votes, "k").groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("k", "script"))).alias("votes"))
        hot = heavy_keys(vals.groupBy("value").agg(F.count("*").alias("n")), "value")
        vals = split_join(vals, found, "value", hot, "left").select(*vals.columns, "votes")
    return vals.mapInArrow(run, "tbl string, row_id long, pos_no int, value string, plain string")


def one_form(text_entity: DataFrame, test_glossary: DataFrame) -> DataFrame:
    """(tbl, row_id, pos_no, value, plain) of all values. Null values have no row; empty ones stay empty."""
    vals = values(text_entity, test_glossary)
    return plain_values(vals, durable(script_votes(vals)))


def lookalikes_found(text_entity: DataFrame, test_glossary: DataFrame) -> DataFrame:
    return one_form(text_entity, test_glossary).filter("value <> plain").select("tbl", "row_id", "pos_no")
