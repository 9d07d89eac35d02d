"""Terms by part-of-speech patterns. Each pattern is compiled to a regular expression over one letter per token; where some
pattern is open, all become one automaton that follows each document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.common import py_strip
from lexweave.operators.tokens import texts_of

# The patterns used by default.
DEFAULT_PATTERNS = (
    ({"POS": "NOUN"}, {"POS": "NOUN"}),
    ({"POS": "ADJ"}, {"POS": "NOUN"}),
    ({"POS": "NOUN"}, {"POS": "ADJ"}),
    ({"POS": "NOUN"}, {"POS": "VERB"}, {"POS": "NOUN"}),
    ({"POS": "NOUN"}, {"IS_PUNCT": True}, {"POS": "NOUN"}),
)
# A letter for each universal part of speech.
CODES = dict(zip("ADJ ADP ADV AUX CCONJ DET INTJ NOUN NUM PART PRON PROPN PUNCT SCONJ SYM VERB X SPACE".split(), "abcdefghijklmnopqs"))
SPAN_TOKENS = 200_000  # tokens of the spans that one Arrow batch holds
CUT = 256  # characters between the places from which a text is read, as reading at an offset passes all before it


def compile_pattern(pattern) -> tuple[str, int, int | None]:
    """(regular expression, fewest tokens, most tokens). Keys POS, IS_PUNCT and OP are understood; others raise. An open
    pattern (OP + or *) has no most."""
    out, low, high = "", 0, 0
    for token in pattern:
        rest = dict(token)
        op = rest.pop("OP", "1")
        if op not in ("1", "+", "*", "?", "!"):
            raise ValueError(f"unsupported OP {op!r}")
        if len(rest) != 1:
            raise ValueError(f"unsupported token pattern {token!r}")
        (key, value), = rest.items()
        if key == "POS" and value in CODES:
            one = f"(?:{CODES[value]}.)"
        elif key == "IS_PUNCT" and isinstance(value, bool):
            one = f"(?:.{'1' if value else '0'})"
        else:
            raise ValueError(f"unsupported token pattern {token!r}")
        if op == "!":
            one = f"(?:(?!{one})..)"
        out += one + (op if op in "+*?" else "")
        low += op in "1+!"
        high += 1
    if not high:
        raise ValueError("empty pattern")
    return f"^{out}$", max(1, low), None if any(x.get("OP") in ("+", "*") for x in pattern) else high


class Automaton:
    """All patterns in one automaton, whose states are bit sets, made as they occur. Unlike windows it follows a span as
    far as some pattern can go on, so open patterns have no bound."""

    def __init__(self, patterns) -> None:
        self.steps: list[tuple[str, object, str]] = []  # (key, value, OP) at each bit; a + is the token and a * of it
        self.begin, self.ends = 0, []
        for pattern in patterns:
            self.begin |= 1 << len(self.steps)
            for token in pattern:
                rest = dict(token)
                op = rest.pop("OP", "1")
                (key, value), = rest.items()
                self.steps += [(key, value, "1"), (key, value, "*")] if op == "+" else [(key, value, op)]
            self.ends.append(len(self.steps))
            self.steps.append(("", None, "end"))
        self.begin, self.next = self._skip(self.begin), {}

    def _skip(self, state: int) -> int:
        for bit, (_, _, op) in enumerate(self.steps):
            if state >> bit & 1 and op in "?*":
                state |= 1 << bit + 1
        return state

    def _step(self, state: int, code: str) -> tuple[int, int]:
        """The state after a token and the first pattern that ends with it, or -1."""
        out = 0
        for bit, (key, value, op) in enumerate(self.steps):
            if op != "end" and state >> bit & 1:
                fits = code[0] == CODES[value] if key == "POS" else code[1] == "01"[value]
                if fits != (op == "!"):
                    out |= 1 << bit + (op != "*")
        out = self._skip(out)
        return out, next((k for k, bit in enumerate(self.ends) if out >> bit & 1), -1)

    def spans(self, codes: list[str]) -> Iterator[tuple[int, int, int]]:
        """(start, tokens, first pattern) of every span that some pattern matches."""
        for start in range(len(codes)):
            state = self.begin
            for at in range(start, len(codes)):
                known = self.next.get((state, codes[at]))
                if known is None:
                    known = self.next[state, codes[at]] = self._step(state, codes[at])
                state, k = known
                if k >= 0:
                    yield start, at - start + 1, k
                if not state:
                    break


def _follow(tokens: DataFrame, patterns) -> DataFrame:
    """(doc_id, tok_idx, sent_id, char_start, ts, n, k) of every span, for patterns without a longest window: tokens sorted by
    document stream through the automaton. A task holds one document and SPAN_TOKENS tokens of its spans."""
    t = tokens.select("doc_id", "tok_idx", "sent_id", "char_start", F.struct("token", "lemma", "pos", "char_end").alias("t"), "code")
    schema = T.StructType([*t.schema.fields[:4], T.StructField("ts", T.ArrayType(t.schema["t"].dataType)), T.StructField("n", T.IntegerType()), T.StructField("k", T.IntegerType())])

    def rows(doc: pa.Table, found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        start, n, k = np.array(found, np.int64).T
        ends = np.cumsum(n)
        places = np.repeat(start - (ends - n), n) + np.arange(ends[-1])
        values = doc.column("t").combine_chunks().take(pa.array(places))
        columns = [doc.column(c).combine_chunks().take(pa.array(start)) for c in ("doc_id", "tok_idx", "sent_id", "char_start")]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)
        return pa.RecordBatch.from_arrays([*columns, lists, pa.array(n, pa.int32()), pa.array(k, pa.int32())], names=["doc_id", "tok_idx", "sent_id", "char_start", "ts", "n", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, held = Automaton(patterns), []

        def flush() -> Iterator[pa.RecordBatch]:
            doc, found, size = pa.Table.from_batches(held), [], 0
            for span in automaton.spans(doc.column("code").to_pylist()):
                found.append(span)
                size += span[1]
                if size >= SPAN_TOKENS:
                    yield rows(doc, found)
                    found, size = [], 0
            if found:
                yield rows(doc, found)

        last = None
        for b in batches:
            ids, a = b.column(0).to_pylist(), 0
            for z in range(1, len(ids) + 1):
                if z == len(ids) or ids[z] != ids[a]:
                    if held and ids[a] != last:
                        yield from flush()
                        held.clear()
                    held.append(b.slice(a, z - a))
                    last, a = ids[a], z
        if held:
            yield from flush()

    return t.repartition("doc_id").sortWithinPartitions("doc_id", "tok_idx").mapInArrow(run, schema)


def _windows(t: DataFrame, compiled: list[tuple[int, str, int, int]]) -> DataFrame:
    """(doc_id, tok_idx, sent_id, char_start, ts, n, k) of every span, for patterns with a longest window: one window of
    ``lead`` over the tokens, and one explode of the lengths that fit."""
    most = max(high for *_, high in compiled)
    w = Window.partitionBy("doc_id").orderBy("tok_idx")
    t = t.withColumn("t", F.struct("token", "lemma", "pos", "char_end", "code"))
    wide = t.select("doc_id", "tok_idx", "sent_id", "char_start", *[(F.lead("t", j).over(w) if j else F.col("t")).alias(f"t{j}") for j in range(most)])
    fits: dict[int, Column] = {}
    for n in range(min(low for _, _, low, _ in compiled), most + 1):
        codes = F.concat(*[F.col(f"t{j}.code") for j in range(n)])  # null where the document ends before
        fit = [F.when(codes.rlike(regex), F.lit(k)) for k, regex, low, high in compiled if low <= n <= high]
        if fit:
            fits[n] = F.coalesce(*fit)
    found = [F.when(k.isNotNull(), F.struct(F.lit(n).alias("n"), k.alias("k"))) for n, k in fits.items()]
    hits = wide.withColumn("hit", F.explode(F.array_compact(F.array(*found))))
    ts = F.slice(F.array(*[F.col(f"t{j}") for j in range(most)]), F.lit(1), F.col("hit.n"))
    return hits.select("doc_id", "tok_idx", "sent_id", "char_start", ts.alias("ts"), "hit.n", "hit.k")


def rule_matches(tokens: DataFrame, documents: DataFrame | None = None, patterns=DEFAULT_PATTERNS, score: float = 0.5, extractor: int = 0) -> DataFrame:
    """Terms in the columns of the C-value extractor: every window of a document's tokens that some pattern matches, sentence
    ends notwithstanding, each span once. Spans are token indices, end exclusive. ``tokens`` need ``pos``.

    If ``documents`` are given, the text is that of the document between the tokens' offsets, and the sentence that between
    the runs of .!? around it, stripped, where ``sent_id`` counts those runs; else the text is the tokens joined by blanks and
    the sentence empty. Tokens that bring a column ``sentence`` give theirs.
    """
    if "pos" not in tokens.columns:
        raise ValueError("the rule extractor needs parts of speech: give a tagger")
    compiled = [(k, *compile_pattern(p)) for k, p in enumerate(patterns)]
    code = reduce(lambda c, x: c.when(F.col("pos") == x[0], x[1]), CODES.items(), F.when(F.lit(False), "z")).otherwise("z")
    t = tokens.withColumn("code", F.concat(code, F.when(F.col("is_punct"), "1").otherwise("0")))
    if any(high is None for *_, high in compiled):
        rows = _follow(t, patterns)
    else:
        rows = _windows(t, compiled)
    text, sentence = F.array_join(F.transform("ts", lambda x: x["token"]), " "), F.lit("")
    if documents is not None:
        ends = F.split(F.col("doc_text"), r"(?<=[.!?])(?![.!?])")
        cuts = F.transform(F.sequence(F.lit(0), F.floor(F.length("doc_text") / CUT).cast("int")), lambda k: F.substring(F.col("doc_text"), k * CUT + 1, F.lit(2 * CUT)))
        rows = rows.join(texts_of(documents).select("doc_id", F.col("text").alias("doc_text")).withColumns({"sentences": ends, "cuts": cuts}), "doc_id")
        start, size = F.col("char_start"), F.element_at("ts", -1)["char_end"] - F.col("char_start")
        near = F.substring(F.get("cuts", F.floor(start / CUT).cast("int")), F.pmod(start, F.lit(CUT)) + 1, size)
        text = F.when(size <= CUT, near).otherwise(F.substring(F.col("doc_text"), start + 1, size))
        sentence = py_strip(F.coalesce(F.get("sentences", F.col("sent_id")), F.lit("")))
    if "sentence" in tokens.columns:
        rows = rows.join(tokens.groupBy("doc_id", "sent_id").agg(F.first("sentence", True).alias("_sentence")), ["doc_id", "sent_id"], "left")
        sentence = F.coalesce("_sentence", sentence)
    ids = reduce(lambda c, x: c.when(F.col("k") == x, F.lit(zlib.crc32(repr(patterns[x]).encode()))), range(len(patterns)), F.when(F.lit(False), F.lit(0)))
    order = Window.partitionBy("doc_id").orderBy("span_start", "span_end")
    return rows.select(
        "doc_id", F.lit(extractor).alias("extractor"), text.alias("text"), F.array_join(F.transform("ts", lambda x: x["lemma"]), " ").alias("lemma"), F.col("tok_idx").alias("span_start"),
        (F.col("tok_idx") + F.col("n")).alias("span_end"), F.lit(float(score)).alias("score"), F.transform("ts", lambda x: x["pos"]).alias("pos_tags"), sentence.alias("sentence"), F.col("n").alias("token_count"), ids.cast("decimal(20,0)").alias("pattern_id"),
    ).select(
        "doc_id", "extractor", (F.row_number().over(order) - 1).alias("seq"), "text", F.col("text").alias("original_text"), "lemma", "span_start", "span_end", "score", "pos_tags", "sentence",
        F.lit(1).alias("frequency"), F.lit("rule").alias("extractor_type"), F.lit(None).cast("int").alias("length"), "token_count", "pattern_id",
    )
