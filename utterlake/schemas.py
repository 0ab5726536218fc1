"""Column layouts shared by the jobs."""

from pyspark.sql import types as T

UTTERANCE_COLUMNS = ["text", "intent", "response", "language", "channel", "source"]

UTTERANCES = T.StructType([T.StructField(c, T.StringType()) for c in UTTERANCE_COLUMNS])

POSITIONED_UTTERANCES = T.StructType([T.StructField("row_id", T.LongType()), *UTTERANCES.fields])

BENCHMARK = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("label_name", T.StringType()),
    ]
)

PROMPT_CORPUS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("prompt", "response", "category")]
)

TEXT_CORPUS = T.StructType([T.StructField("text", T.StringType())])

FAQ = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("intent", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)

EXAMPLE = T.StructType([T.StructField("text", T.StringType()), T.StructField("response", T.StringType())])

ANSWER_TABLE_DOCUMENT = T.MapType(T.StringType(), T.ArrayType(EXAMPLE))

ANSWER_ROWS = T.StructType(
    [
        T.StructField(c, T.StringType())
        for c in (
            "question",
            "predicted_intent",
            "intent_confidence",
            "similar_question",
            "similarity_score",
            "response",
            "fallback_type",
        )
    ]
)
