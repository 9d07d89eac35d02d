"""Fixed schemas of glossary entities and extracted terms."""

from pyspark.sql import types as T

ENTITY = T.StructType(
    [
        T.StructField("entity_pos", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("synonyms", T.ArrayType(T.StringType())),
        T.StructField("relations", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("definition", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)
TERM = "doc_id string, extractor int, seq long, text string, original_text string, lemma string, span_start int, span_end int, score double, pos_tags array<string>, sentence string, frequency int, extractor_type string, properties map<string,string>"
STATUSES = ("MATCHED", "UNKNOWN", "AMBIGUOUS", "NEAR_MATCH")
REPORT_TYPES = ("extraction", "processing", "verification", "ontology_update", "quality_gate")
