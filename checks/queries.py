"""Registered queries: every operator over the whole tables."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as v
from utterlake.functions import numeric as num
from utterlake.functions import text as tx
from utterlake.operators import augment, checks, corpus, dedup, evaluate, features, respond, retrieve, split, stats, taxonomy
from utterlake.operators.classify import NaiveBayesModel, fit_naive_bayes
from utterlake.plans.prepare import PrepareOptions, clean_rows, focus_filter, min_length, prepare_dataset
from utterlake.plans.train import train_classical
from utterlake.rules import MODEL_ORDER
from utterlake.session import materialize, scratch_path, scratch_scope
from utterlake.sources import readers, writers
from utterlake.streaming.answers import answer_stream

DIGITS = 6


def r6(name: str):
    return F.round(name, DIGITS).alias(name)


# Fitted artefacts are written once per application and table folder, then read by every query.


@lru_cache(maxsize=None)
def _model_path(app: str, spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "model")
    with scratch_scope(spark, "fit"):
        fit_naive_bayes(v.utterances(spark, sf_dir)).save(path)
    return path


def model(spark: SparkSession, sf_dir: str) -> NaiveBayesModel:
    return NaiveBayesModel.load(spark, _model_path(spark.sparkContext.applicationId, spark, sf_dir))


@lru_cache(maxsize=None)
def _index_path(app: str, spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "index")
    retrieve.build_index(v.examples(spark, sf_dir), path)
    return path


def index(spark: SparkSession, sf_dir: str) -> retrieve.AnswerIndex:
    return retrieve.AnswerIndex.load(spark, _index_path(spark.sparkContext.applicationId, spark, sf_dir))


@lru_cache(maxsize=None)
def _prepared(app: str, spark: SparkSession, sf_dir: str):
    external, regional = v.sources(spark, sf_dir)
    frames = [readers.load_external(external, "ext", v.RULES), readers.with_source_defaults(regional)]
    return prepare_dataset(frames, v.RULES, PrepareOptions(min_per_intent=v.MIN_PER_INTENT))


def prepared(spark: SparkSession, sf_dir: str):
    return _prepared(spark.sparkContext.applicationId, spark, sf_dir)


def positioned(spark, d) -> DataFrame:
    return v.utterances(spark, d).withColumn("position", F.col("row_id"))


# Sources


def external_alias_load(spark, d):
    return readers.load_external(v.sources(spark, d)[0], "ext", v.RULES)


def source_defaults(spark, d):
    return readers.with_source_defaults(v.sources(spark, d)[1])


def taxonomy_load(spark, d):
    train = v.utterances(spark, d).select("row_id", "text", F.col("source").alias("label_name"))
    test = v.table(spark, d, "benchmark").select(
        F.col("item_id").alias("row_id"), "text", F.concat(F.lit("src"), F.col("item_id") % 20).alias("label_name")
    )
    rules = v.Rules(templates=v.TAXONOMY_TEMPLATES, taxonomy=v.RULES.taxonomy)
    return readers.load_taxonomy_corpus(train, test, rules, "benchmark")


def label_name_lookup(spark, d):
    return taxonomy.add_label_name(v.table(spark, d, "embeddings").select("vec_id", "label"), v.LABEL_NAMES)


# Projections and filters


def clean_text(spark, d):
    return v.utterances(spark, d).select("row_id", tx.clean_text("text").alias("text"))


def normalize_intent(spark, d):
    raw = F.concat(F.lit("  "), F.initcap("language"), F.lit(" "), F.upper("source"), F.lit("\t"))
    return v.utterances(spark, d).select("row_id", tx.normalize_intent(raw).alias("intent"))


def length_filter(spark, d):
    return min_length(v.utterances(spark, d).withColumn("text", tx.clean_text("text")), 400).select("row_id", "text")


def focus_rows(spark, d):
    return focus_filter(v.utterances(spark, d), v.RULES).select("row_id", "source", "text")


def allowlist_semi(spark, d):
    return taxonomy.allow_intents(v.utterances(spark, d), ["en", "es", "xx"]).select("row_id", "intent")


def taxonomy_map(spark, d):
    return taxonomy.map_taxonomy(v.utterances(spark, d), "source", v.RULES.taxonomy, "docs", v.TAXONOMY_TEMPLATES)


def default_response(spark, d):
    rows = v.utterances(spark, d).withColumn("intent", F.when(F.col("source") == "src5", "none").otherwise(F.col("intent")))
    return taxonomy.default_response(rows, v.RULES.templates, v.RULES.default_response).select("row_id", "intent", "response")


def class_label_lookup(spark, d):
    rows = v.table(spark, d, "embeddings").select("vec_id", "label")
    return taxonomy.lookup_label(rows, v.LABEL_NAMES[:7])


def keyword_route(spark, d):
    predictions = model(spark, d).predict(v.questions(spark, d), "qid")
    return respond.keyword_route(predictions, v.ROUTES).select("qid", "predicted_intent", F.col("routed").cast("int").alias("routed"))


def split_leakage(spark, d):
    marked = split.random_split(v.utterances(spark, d), 0.2)
    found = split.split_leakage(marked.where("split = 'train'"), marked.where("split = 'eval'"))
    return found.select("row_id", F.col("leaked").cast("int").alias("leaked"))


# Counts and statistics


def intent_counts(spark, d):
    rows = clean_rows(v.utterances(spark, d).withColumn("position", F.col("row_id")))
    known = taxonomy.allow_intents(rows, v.RULES.templates)
    return stats.group_counts(dedup.dedup_first(known), "intent")


def source_counts(spark, d):
    return stats.group_counts(v.utterances(spark, d), "source")


def dataset_stats(spark, d):
    return prepared(spark, d).stats


def corpus_stats(spark, d):
    return stats.corpus_stats(positioned(spark, d))


def null_drop(spark, d):
    return checks.null_rows(v.utterances(spark, d), ["text", "response"])


def response_pool(spark, d):
    return stats.response_pool(v.utterances(spark, d))


def answer_table(spark, d):
    return stats.build_answer_table(v.utterances(spark, d))


def _judged(spark, d):
    guess = F.coalesce(respond.route_intent("text", v.ROUTES), F.lit("other"))
    return v.utterances(spark, d).select("row_id", F.col("intent").alias("truth"), guess.alias("predicted"))


def accuracy(spark, d):
    return evaluate.accuracy(_judged(spark, d), "truth", "predicted").select(r6("accuracy"))


def classification_report(spark, d):
    report = evaluate.classification_report(_judged(spark, d), "truth", "predicted")
    return report.select("label", r6("precision"), r6("recall"), r6("f1"), "support")


def macro_f1(spark, d):
    return evaluate.macro_f1(_judged(spark, d), "truth", "predicted").select(r6("accuracy"), r6("f1_macro"))


def confusion_matrix(spark, d):
    return evaluate.confusion_matrix(_judged(spark, d), "truth", "predicted")


def confusion_pivot(spark, d):
    return evaluate.confusion_pivot(_judged(spark, d), "truth", "predicted", ["de", "en", "es", "fr", "other"])


def metrics_long(spark, d):
    long = evaluate.metrics_long(evaluate.classification_report(_judged(spark, d), "truth", "predicted"))
    return long.select("metric", r6("value"))


def best_model(spark, d):
    judged = v.table(spark, d, "labels").join(v.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    guesses = F.array(
        F.struct(F.lit("naive_bayes").alias("model"), (1 - F.col("toxic")).alias("guess")),
        F.struct(F.lit("logreg").alias("model"), (F.col("lang") == "en").cast("int").alias("guess")),
        F.struct(F.lit("svm").alias("model"), (1 - F.col("toxic")).alias("guess")),
    )
    long = judged.select("quality", F.inline(guesses))
    metrics = long.groupBy("model").agg(F.avg((F.col("quality") == F.col("guess")).cast("double")).alias("accuracy"))
    return evaluate.best_model(metrics, MODEL_ORDER).select("model", r6("accuracy"))


def perplexity(spark, d):
    losses = v.table(spark, d, "events").select("event_type", (F.col("value") / 8).alias("loss"))
    found = evaluate.perplexity(losses, "loss", "event_type")
    logged = F.when(F.col("mean_perplexity") < float("inf"), F.log("mean_perplexity"))
    return found.select("event_type", r6("eval_loss"), r6("eval_perplexity"), F.round(logged, DIGITS).alias("ln_mean_perplexity"))


def class_weights(spark, d):
    return evaluate.class_weights(v.utterances(spark, d), "intent").select("intent", "n", r6("weight"))


# Duplicates, samples, splits, order


def dedup_first(spark, d):
    twice = dedup.union_sources([v.utterances(spark, d), v.utterances(spark, d).withColumn("source", F.lit("second"))])
    return dedup.dedup_first(twice).select("position", "row_id", "intent", "source")


def dedup_pair(spark, d):
    rows = checks.drop_null(positioned(spark, d), ["text", "response"])
    return dedup.dedup_pair(rows).select("position", "text", "response")


def seeded_sample(spark, d):
    return split.seeded_sample(v.utterances(spark, d), 150).select("row_id", "intent")


def stratified_split(spark, d):
    return split.stratified_split(v.utterances(spark, d)).select("row_id", "intent", "split")


def three_way_split(spark, d):
    return split.three_way_split(v.utterances(spark, d)).select("row_id", "intent", "split")


def split_fallback(spark, d):
    rows = v.utterances(spark, d).withColumn("label", F.length("text").cast("string"))
    return split.stratified_split(rows, "label", strict=False).select("row_id", "split")


def random_split(spark, d):
    return split.random_split(v.utterances(spark, d), 0.1).select("row_id", "split")


def argmax_class(spark, d):
    long = v.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "score"))
    named = long.select("vec_id", F.format_string("c%02d", "at").alias("class"), F.col("score").cast("double").alias("score"))
    return evaluate.argmax_class(named, "vec_id").select("vec_id", "class", r6("score"))


def positions(spark, d):
    return dedup.with_rank(v.questions(spark, d), "qid").select("qid", "place")


def preview(spark, d):
    rows = v.questions(spark, d)
    return rows.select("qid", tx.preview("text", 80).alias("short"), tx.preview("text", 100, always=False).alias("line"))


def union_sources(spark, d):
    frames = [external_alias_load(spark, d), source_defaults(spark, d)]
    return dedup.union_sources(frames).select("position", "row_id", "intent", "language", "channel", "source")


# Fill and composition


def synthetic_fill(spark, d):
    rows = clean_rows(v.utterances(spark, d))
    return augment.synthetic_fill(rows, v.MIN_PER_INTENT, v.RULES)


def synthetic_fill_focus(spark, d):
    rows = focus_filter(clean_rows(v.utterances(spark, d)), v.RULES)
    return augment.synthetic_fill_focus(rows, v.MIN_PER_INTENT, v.RULES)


def hash_pick(spark, d):
    key = tx.variant_key("intent", "text", "source")
    picked = augment.pick_variant(v.utterances(spark, d), v.RULES)
    return picked.select("row_id", tx.hash_mod(key, 84).alias("m"), "variant")


def focus_phrase(spark, d):
    cleaned = tx.clean_text("text")
    return v.utterances(spark, d).select("row_id", tx.focus_phrase(cleaned, v.RULES.stop_words, "your request").alias("focus"))


def sentence_split(spark, d):
    rows = v.utterances(spark, d).select("row_id", F.posexplode(tx.sentences("text")).alias("at", "sentence"))
    return rows.select("row_id", F.col("at").cast("bigint").alias("at"), "sentence")


def compose_response(spark, d):
    rows = v.utterances(spark, d).withColumn("text", tx.clean_text("text"))
    return augment.compose_response(rows, v.RULES).select("row_id", "composed")


def diversify_responses(spark, d):
    rows = v.utterances(spark, d).withColumn("text", tx.clean_text("text")).drop("source")
    return augment.diversify_responses(rows, v.RULES).select("row_id", "source", "response")


# Corpora


def corpus_prompt_response(spark, d):
    return corpus.prompt_response(v.utterances(spark, d))


def lm_corpus(spark, d):
    return corpus.to_lm_corpus(positioned(spark, d), include_intent=True)


def lm_corpus_eval(spark, d):
    return corpus.to_lm_corpus(positioned(spark, d), is_test=True)


def format_prompt(spark, d):
    text = tx.format_prompt("text", "response", eos="<|endoftext|>")
    return v.pairs(spark, d).select("row_id", text.alias("text"))


def format_eval_prompt(spark, d):
    rows = v.utterances(spark, d).withColumn("intent", F.nullif(F.col("intent"), F.lit("es")))
    return rows.select("row_id", tx.format_prompt("text", intent="intent").alias("text"))


def corpus_unify(spark, d):
    separate = v.pairs(spark, d).select(F.col("text").alias("prompt"), "response")
    combined = v.utterances(spark, d).select("text", "intent")
    return corpus.unify_corpus(separate, eos="<|endoftext|>").unionByName(corpus.unify_corpus(combined))


def extract_reply(spark, d):
    made = v.pairs(spark, d).select("row_id", tx.format_prompt("text", "response").alias("text"))
    plain = v.utterances(spark, d).select((F.col("row_id") + 1_000_000_000).alias("row_id"), "text")
    return made.unionByName(plain).select("row_id", tx.extract_reply("text").alias("reply"))


# Features and scores


def word_ngrams(spark, d):
    grams = v.questions(spark, d).select("qid", F.posexplode(tx.word_ngrams("text")).alias("at", "gram"))
    return grams.select("qid", F.col("at").cast("bigint").alias("at"), "gram")


def char_ngrams(spark, d):
    rows = features.term_rows(features.char_bags(v.questions(spark, d), "qid"), "qid")
    return rows.select("qid", features.gram_text("term").alias("gram"), F.col("tf").cast("bigint").alias("tf"))


def _summary(vectors: DataFrame, key: str, term) -> DataFrame:
    """Terms, weight sum and heaviest term of each vector; the first term wins ties."""
    rows = vectors.select(key, "terms", F.transform("weights", lambda w: F.round(w, 10)).alias("w"))
    rows = rows.withColumn("best", F.array_max("w"))
    heaviest = F.filter(F.arrays_zip("w", "terms"), lambda p: p["w"] == F.col("best"))
    return rows.select(
        key,
        F.size("terms").cast("bigint").alias("n_terms"),
        F.round(F.aggregate("w", F.lit(0.0), lambda a, w: a + w), 5).alias("weight_sum"),
        F.round("best", DIGITS).alias("weight_max"),
        term(F.array_min(F.transform(heaviest, lambda p: p["terms"]))).alias("top_term"),
    )


def tfidf_word(spark, d):
    rows = v.utterances(spark, d)
    bags = materialize(features.word_bags(rows, "row_id"), "bags")
    fitted = features.Tfidf(materialize(features.fit_idf(bags, rows.count()), "vocabulary"))
    return _summary(fitted.vectors(bags, "row_id"), "row_id", lambda c: c)


def tfidf_char(spark, d):
    return _summary(index(spark, d).vectors, "ex_id", features.gram_text)


def naive_bayes(spark, d):
    marked = split.stratified_split(v.utterances(spark, d)).select("row_id", "intent", "text", "split")
    marked = materialize(marked, "split")  # read by each pass of the fit
    fitted = fit_naive_bayes(marked.where("split = 'train'"))
    scored = fitted.predict(marked.where("split = 'eval'"), "row_id")
    return scored.select("row_id", "intent", "predicted_intent", r6("confidence"))


def predict_batch(spark, d):
    return respond.predict(v.questions(spark, d), model(spark, d)).select("qid", "predicted_intent", r6("confidence"))


def _reached(spark, d, model: str, names):
    """Evaluation rows of each model, its accuracy if the SQL can tell it, and whether it converged and meets the accuracy asked of it."""
    result = train_classical(v.utterances(spark, d), model)
    parts = []
    for name in names:
        fitted = result.models[name]
        own = result.reports[name].where("label = 'accuracy'").select(F.lit(name).alias("model"), F.col("support").cast("bigint").alias("eval_rows"))
        good = (F.col("accuracy") >= v.LEAST_ACCURACY[name]) & F.lit(getattr(fitted, "converged", True))
        exact = F.when(F.lit(name == "naive_bayes"), F.round("accuracy", 6)).alias("accuracy")
        parts.append(own.join(result.metrics, "model").select("model", "eval_rows", exact, good.alias("reached")))
    return reduce(DataFrame.unionByName, parts)


def logreg(spark, d):
    return _reached(spark, d, "logreg", ["logreg"]).drop("accuracy")


def svm(spark, d):
    return _reached(spark, d, "svm", ["svm"]).drop("accuracy")


def train_compare(spark, d):
    return _reached(spark, d, "all", MODEL_ORDER)


# Files


def csv_roundtrip(spark, d):
    """Whole documents, line breaks and quotes included, written as CSV and read back."""
    path = writers.write_csv(v.table(spark, d, "documents").select(F.col("doc_id").cast("string"), "text", "lang"), scratch_path(spark, "csv"))
    return readers.read_csv(spark, path).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")


def jsonl_roundtrip(spark, d):
    path = writers.write_jsonl(v.table(spark, d, "conversations"), scratch_path(spark, "jsonl"))
    return readers.read_jsonl(spark, path, v.table(spark, d, "conversations").schema).select("conv_id", "turn", "role", "text")


def answer_table_roundtrip(spark, d):
    path = writers.write_answer_table(stats.build_answer_table(v.utterances(spark, d)), scratch_path(spark, "answers"))
    return writers.read_answer_table(spark, path)


def sigmoid_confidence(spark, d):
    rows = v.table(spark, d, "embeddings")
    return rows.select("vec_id", F.round(num.sigmoid(F.array_max("embedding").cast("double")), DIGITS).alias("confidence"))


def softmax_argmax(spark, d):
    rows = v.table(spark, d, "embeddings").select("vec_id", num.softmax("embedding").alias("p"), "embedding")
    at = num.argmax("embedding")
    return rows.select("vec_id", at.alias("place"), F.round(F.col("p")[at], DIGITS).alias("confidence"))


def score_logits(spark, d):
    scored = respond.score_logits(v.table(spark, d, "embeddings"), "embedding", v.CLASS_NAMES)
    return scored.select("vec_id", "predicted_intent", r6("confidence"))


def pad_truncate(spark, d):
    ids = F.transform(F.split(tx.clean_text("text"), " "), lambda t: F.length(t))
    rows = v.utterances(spark, d).select("row_id", ids.alias("tokens"))
    return rows.select(
        "row_id",
        F.array_join(num.pad_truncate("tokens", 128).cast("array<string>"), ",").alias("ids"),
        F.array_join(num.attention_mask("tokens", 128).cast("array<string>"), "").alias("mask"),
    )


def label_encode(spark, d):
    train, held = evaluate.label_encode(v.utterances(spark, d), v.table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.col("lang").alias("intent")), "intent")
    return train.select("row_id", "intent", "label_id").join(held.select("row_id", F.col("label_id").alias("eval_id")), "row_id")


# Retrieval and answers


def _asked(spark, d):
    predictions = respond.predict(v.questions(spark, d), model(spark, d))
    return predictions.select("qid", F.col("predicted_intent").alias("intent"), "text")


def similarity_top1(spark, d):
    return retrieve.similarity_top1(_asked(spark, d), index(spark, d)).select("qid", "intent", "ex_id", r6("sim"))


def similarity_join(spark, d):
    return retrieve.similarity_join(_asked(spark, d), index(spark, d)).select("qid", "ex_id", r6("sim"), "copies")


def first_example(spark, d):
    return respond.first_example(index(spark, d))


def _unrouted():
    rules = v.Rules(**{**v.RULES.__dict__, "routes": []})
    return rules


def answer_batch(spark, d):
    out = respond.answer(v.questions(spark, d), model(spark, d), index(spark, d), _unrouted())
    return out.select("qid", "predicted_intent", r6("confidence"), r6("sim"), "response", "fallback_type")


def answer_routed(spark, d):
    out = respond.answer(v.questions(spark, d), model(spark, d), index(spark, d), v.RULES)
    return out.select("qid", "predicted_intent", r6("sim"), "response", "fallback_type")


def answer_batch_report(spark, d):
    return respond.answer(v.questions(spark, d), model(spark, d), index(spark, d), _unrouted(), report=True)


@lru_cache(maxsize=None)
def _rung_paths(app: str, spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """A model of all intents and an index of some."""
    paths = scratch_path(spark, "rung-model"), scratch_path(spark, "rung-index")
    rows = v.parted(spark, sf_dir)
    with scratch_scope(spark, "fit"):
        fit_naive_bayes(rows).save(paths[0])
    known = rows.where(~F.col("intent").isin(v.UNINDEXED))
    retrieve.build_index(known.select("intent", F.col("row_id").alias("ex_id"), "text", "response"), paths[1])
    return paths


def _rungs(spark, d, report):
    of_model, of_index = _rung_paths(spark.sparkContext.applicationId, spark, d)
    known = retrieve.AnswerIndex.load(spark, of_index)
    return respond.answer(v.short_questions(spark, d), NaiveBayesModel.load(spark, of_model), known, v.RUNG_RULES, report=report)


def answer_rungs(spark, d):
    out = _rungs(spark, d, False)
    return out.select("qid", "predicted_intent", r6("confidence"), r6("sim"), "response", "fallback_type")


def answer_rungs_report(spark, d):
    return _rungs(spark, d, True)


def answer_stream_rows(spark, d):
    schema = v.table(spark, d, "conversations").schema
    # A pattern, as the table is one file or a folder of files; a stream takes no single file, and a folder holds other names.
    stream = spark.readStream.schema(schema).parquet(f"{d}/conversations.parque[t]")
    sink = scratch_path(spark, "answers")
    query = answer_stream(
        v.messages(stream), model(spark, d), index(spark, d), _unrouted(), sink, scratch_path(spark, "stream")
    )
    query.awaitTermination()
    out = spark.read.parquet(sink)
    return out.select("qid", "predicted_intent", r6("confidence"), r6("sim"), "response", "fallback_type")


def prepare_dataset_rows(spark, d):
    return prepared(spark, d).full.select("position", "text", "intent", "response", "source", "split")


QUERIES = {
    "external_alias_load": external_alias_load,
    "source_defaults": source_defaults,
    "taxonomy_load": taxonomy_load,
    "label_name_lookup": label_name_lookup,
    "clean_text": clean_text,
    "normalize_intent": normalize_intent,
    "length_filter": length_filter,
    "focus_filter": focus_rows,
    "allowlist_semi": allowlist_semi,
    "taxonomy_map": taxonomy_map,
    "default_response": default_response,
    "class_label_lookup": class_label_lookup,
    "keyword_route": keyword_route,
    "split_leakage": split_leakage,
    "intent_counts": intent_counts,
    "source_counts": source_counts,
    "dataset_stats": dataset_stats,
    "corpus_stats": corpus_stats,
    "null_drop": null_drop,
    "response_pool": response_pool,
    "answer_table": answer_table,
    "accuracy": accuracy,
    "classification_report": classification_report,
    "macro_f1": macro_f1,
    "confusion_matrix": confusion_matrix,
    "confusion_pivot": confusion_pivot,
    "metrics_long": metrics_long,
    "best_model": best_model,
    "perplexity": perplexity,
    "class_weights": class_weights,
    "dedup_first": dedup_first,
    "dedup_pair": dedup_pair,
    "seeded_sample": seeded_sample,
    "stratified_split": stratified_split,
    "three_way_split": three_way_split,
    "split_fallback": split_fallback,
    "random_split": random_split,
    "argmax_class": argmax_class,
    "positions": positions,
    "preview": preview,
    "union_sources": union_sources,
    "synthetic_fill": synthetic_fill,
    "synthetic_fill_focus": synthetic_fill_focus,
    "hash_pick": hash_pick,
    "focus_phrase": focus_phrase,
    "sentence_split": sentence_split,
    "compose_response": compose_response,
    "diversify_responses": diversify_responses,
    "corpus_prompt_response": corpus_prompt_response,
    "lm_corpus": lm_corpus,
    "lm_corpus_eval": lm_corpus_eval,
    "format_prompt": format_prompt,
    "format_eval_prompt": format_eval_prompt,
    "corpus_unify": corpus_unify,
    "extract_reply": extract_reply,
    "word_ngrams": word_ngrams,
    "char_ngrams": char_ngrams,
    "tfidf_word": tfidf_word,
    "tfidf_char": tfidf_char,
    "naive_bayes": naive_bayes,
    "predict_batch": predict_batch,
    "train_compare": train_compare,
    "logreg": logreg,
    "svm": svm,
    "csv_roundtrip": csv_roundtrip,
    "jsonl_roundtrip": jsonl_roundtrip,
    "answer_table_roundtrip": answer_table_roundtrip,
    "sigmoid_confidence": sigmoid_confidence,
    "softmax_argmax": softmax_argmax,
    "score_logits": score_logits,
    "pad_truncate": pad_truncate,
    "label_encode": label_encode,
    "similarity_top1": similarity_top1,
    "similarity_join": similarity_join,
    "first_example": first_example,
    "answer_batch": answer_batch,
    "answer_routed": answer_routed,
    "answer_batch_report": answer_batch_report,
    "answer_rungs": answer_rungs,
    "answer_rungs_report": answer_rungs_report,
    "answer_stream": answer_stream_rows,
    "prepare_dataset": prepare_dataset_rows,
}
