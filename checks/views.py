"""The driver's tables seen as utterances, questions and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.functions.text import sentences
from utterlake.rules import Rules

ROUTES = [
    {"intent": "en", "patterns": ["(^|[^a-z])the([^a-z]|$)"], "neg_patterns": ["(^|[^a-z])und([^a-z]|$)"], "priority": 10},
    {"intent": "fr", "patterns": ["(^|[^a-z])(le|les|des)([^a-z]|$)"], "neg_patterns": ["(^|[^a-z])der([^a-z]|$)"], "priority": 8},
    {"intent": "de", "patterns": ["(^|[^a-z])(der|die)([^a-z]|$)", "(^|[^a-z])und([^a-z]|$)"], "neg_patterns": [], "priority": 8},
]

RULES = Rules(
    templates={
        "en": "Open the help page. It lists the usual steps.",
        "fr": "Ouvrez la page d'aide.",
        "de": "Die Hilfe steht auf der Startseite. Dort sind alle Schritte.",
        "es": "Abra la ayuda.",
        "it": "Aprire la guida. Poi seguire i passi.",
        "pt": "Veja a ajuda.",
    },
    default_response="Please contact support for this request.",
    variants={
        "en": ["Look at the help page.", "Ask the help desk. Keep your number ready.", "See the guide. It is short. It has pictures."],
        "fr": ["Voyez l'aide. Elle est courte.", "Demandez au guichet.", "Lisez le guide! Il est clair."],
        "de": ["Bitte die Hilfe lesen.", "Fragen Sie uns. Wir antworten.", "Der Weg ist kurz. Er ist klar. Er ist frei. Danke."],
    },
    patterns={"es": ["abrir cuenta", "ver saldo", "pagar factura"], "pt": ["abrir conta", "ver saldo"]},
    follow_ups=[
        "About {focus}, read the details first.",
        "About {focus}, check the last message.",
        "About {focus}, keep the reference.",
        "About {focus}, update your profile.",
    ],
    regionals=["Local rules apply.", "Times differ by place.", "Ask the branch for limits.", "Fees depend on the region."],
    generic={"en": "A general answer in English.", "fr": "Une reponse generale."},
    taxonomy={
        "alpha": ["src0", "src1", "src2", "src3"],
        "beta": ["src2", "src4", "src5"],
        "gamma": ["src3", "src6", "src7", "src8", "src0"],
    },
    keywords=["nicht", "une", "that a", "(x)", "el la"],
    focus_source="src3",
    full_length_sources=["src1", "src4", "src9"],
    routes=ROUTES,
)
#: Rules of the queries in which every rung of both ladders occurs.
RUNG_RULES = Rules(**{**RULES.__dict__, "routes": [], "generic": {"en low": "A general answer.", "fr": "Une reponse generale."}})
#: Intents that the model knows and the index does not.
UNINDEXED = ["fr", "es"]
TAXONOMY_TEMPLATES = {"alpha": "Answer for alpha.", "beta": "Answer for beta."}
LABEL_NAMES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
CLASS_NAMES = [f"class_{n:02d}" for n in range(48)]
MIN_PER_INTENT = 200
#: Accuracy that each model must reach on held-out documents, by language.
LEAST_ACCURACY = {"naive_bayes": 0.9, "logreg": 0.9, "svm": 0.9}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the language is the intent, the second sentence the response."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"),
        "text",
        F.col("lang").alias("intent"),
        F.get(sentences("text"), F.lit(1)).alias("response"),
        F.col("lang").alias("language"),
        F.lit("web").alias("channel"),
        "source",
    )


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utterances(spark, sf_dir).select("intent", F.col("row_id").alias("ex_id"), "text", "response")


def parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with English cut in three by source, so that a model is often unsure."""
    number = F.regexp_extract("source", "[0-9]+", 0).try_cast("int")
    part = F.when(number < 14, "en low").when(number < 17, "en mid").otherwise("en high")
    return utterances(spark, sf_dir).withColumn("intent", F.when(F.col("intent") == "en", part).otherwise(F.col("intent")))


def short_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions, names of parts among words of three languages, and names of customers, which are in no document."""
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") + 2_000_000_000).alias("qid"), F.concat("p_name", F.lit(" der le el")).alias("text"))
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 3_000_000_000).alias("qid"), F.col("c_name").alias("text"))
    return questions(spark, sf_dir).unionByName(parts).unionByName(customers)


def messages(df: DataFrame) -> DataFrame:
    """User turns of the conversations as questions."""
    return df.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns and benchmark items."""
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("qid"), "text")
    return messages(table(spark, sf_dir, "conversations")).unionByName(items)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn with the assistant turn right after it."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", "text")
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return asked.join(said, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text", "response"
    )


def sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """An external table with free column names, and a regional one without optional columns."""
    external = utterances(spark, sf_dir).select("row_id", F.col("text").alias(" Query "), F.col("intent").alias("Category"), F.col("response").alias("Answer"))
    regional = pairs(spark, sf_dir).withColumn("intent", F.lit(" IT "))
    return [external, regional]
