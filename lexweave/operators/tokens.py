"""Texts to tokens. One shuffle, of the texts by doc_id before they explode; every later window and group keeps to it."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.common import partitions_for, per_worker

# Stop words of the heuristic mode.
STOP_WORDS = ("и", "в", "на", "с", "по", "для", "не", "от", "за", "до", "из", "о", "об", "and", "in", "on", "for", "not", "with", "at", "to", "of", "a", "the")
PIECES = r"[\p{L}\p{N}_]+|[.!?]+|[^\p{L}\p{N}_.!?]+"
# PIECES with what lies between words and stops taken into the next one, so half as many rows count the offsets.
LED_PIECES, LEAD = r"[^\p{L}\p{N}_.!?]*+(?:[\p{L}\p{N}_]++|[.!?]++)", r"^[^\p{L}\p{N}_.!?]++"
KEPT = r"^(?:[а-яёА-ЯЁa-zA-Z]{3,}|[.!?]+)\z"
FINER = 4  # partitions of the texts for each of the session's: as rows their tokens take many times the room
TOKEN_COLUMNS = ("doc_id", "tok_idx", "token", "lemma", "pos", "char_start", "char_end", "sent_id", "is_stop", "is_punct")


def texts_of(documents: DataFrame) -> DataFrame:
    """(doc_id, text), one partitioning by document for all that is made of the texts: plans that need them twice reuse it.
    Its partitions are a fixed number, as Spark would merge them by the size of the texts, and the windows over their tokens
    wouldn't fit an executor."""
    return documents.filter("text <> ''").select("doc_id", F.regexp_replace("text", "\r\n?", "\n").alias("text")).repartition(FINER * partitions_for(documents), "doc_id")


def tokenize(documents: DataFrame) -> DataFrame:
    """(TOKEN_COLUMNS) of documents(doc_id, text): words of three or more Latin or Russian letters. A run of .!? ends a
    sentence and is no token. Offsets count code points. Null and empty texts have no tokens."""
    pieces = F.regexp_extract_all("text", F.lit(LED_PIECES), F.lit(0))
    doc = Window.partitionBy("doc_id").orderBy("i")
    rows = texts_of(documents).select("doc_id", F.posexplode(pieces).alias("i", "token"))
    rows = rows.withColumn("char_end", F.sum(F.length("token")).over(doc).cast("int"))
    rows = rows.withColumn("token", F.regexp_replace("token", LEAD, ""))
    rows = rows.filter(F.col("token").rlike(KEPT)).withColumn("stop", F.col("token").rlike("^[.!?]"))
    rows = rows.withColumn("sent_id", F.sum(F.col("stop").cast("int")).over(doc).cast("int")).filter("NOT stop")
    lemma = F.lower("token")
    return rows.select(
        "doc_id",
        (F.row_number().over(doc) - 1).alias("tok_idx"),
        "token",
        lemma.alias("lemma"),
        F.lit(None).cast("string").alias("pos"),
        (F.col("char_end") - F.length("token")).alias("char_start"),
        "char_end",
        "sent_id",
        lemma.isin(*STOP_WORDS).alias("is_stop"),
        F.lit(False).alias("is_punct"),
    )


TAGGED = "tok_idx int, token string, lemma string, pos string, char_start int, char_end int, sent_id int, is_stop boolean, is_punct boolean, sentence string"


class MissingModel(RuntimeError):
    """A language model isn't installed."""


def tokenize_with(documents: DataFrame, load: Callable[[], Callable[[str], Iterable]], key: str) -> DataFrame:
    """(TOKEN_COLUMNS, sentence) by a model: ``load`` makes, once per Python worker, a function from a text to its sentences,
    each (text, tokens) with tokens (token, lemma, pos, char_start, is_stop, is_punct). Punctuation is kept, white space
    isn't. Batches pass through Arrow; a document stays whole in its row. ``key`` names the model."""
    schema = T.StructType([documents.schema["doc_id"], *T.StructType.fromDDL(TAGGED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, names = per_worker(("model", key), load), schema.names
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1).to_pylist()):
                rows, k = [], 0
                for sent_id, (sentence, tokens) in enumerate(tag(text)):
                    for token, lemma, pos, start, stop, punct in tokens:
                        if not token.isspace():
                            rows.append((k, token, lemma.lower(), pos, start, start + len(token), sent_id, stop, punct, sentence.strip()))
                            k += 1
                if rows:
                    columns = [pa.array(c, arrow_types[j]) for j, c in enumerate(zip(*rows))]
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(rows), batch.schema.field(0).type), *columns], names=names)

    arrow_types = [{"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[f.dataType.simpleString()] for f in schema.fields[1:]]
    return texts_of(documents).mapInArrow(run, schema)


def model_tagger(model: str) -> Callable[[DataFrame], DataFrame]:
    """Tokens by an installed spaCy model. Without the library or the model MissingModel is raised at once."""
    try:
        import spacy
    except ImportError as e:
        raise MissingModel(f"{model}: spaCy isn't installed") from e
    if not spacy.util.is_package(model) and not os.path.isdir(model):
        raise MissingModel(f"model {model} isn't installed")

    def load():
        import spacy

        nlp = spacy.load(model)
        return lambda text: [(s.text, [(t.text, t.lemma_, t.pos_, t.idx, t.is_stop, t.is_punct) for t in s]) for s in nlp(text).sents]

    return lambda documents: tokenize_with(documents, load, model)


def sentence_counts(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_id, n_tokens, first_idx): tokens by sentence; sentence numbers may have gaps."""
    return tokens.groupBy("doc_id", "sent_id").agg(F.count("*").alias("n_tokens"), F.min("tok_idx").alias("first_idx"))


def choose_tokenizer(documents: DataFrame, use_ling_filter: bool, tagger=None) -> tuple[DataFrame, bool]:
    """Tokens and whether they carry parts of speech: those of ``tagger`` (documents to tokens with ``pos``) if wanted and
    given, else those of the regex tokenizer."""
    if use_ling_filter and tagger is not None:
        return tagger(documents).select(*TOKEN_COLUMNS), True
    return tokenize(documents), False
