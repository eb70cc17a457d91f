"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, Tokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions import labels as lb
from reviewlens.functions import patterns as pt
from reviewlens.functions import text as tx
from reviewlens.operators import annotate, descent, metrics, phrases, rows, segment, terms, vectors
from reviewlens.operators.features import build_features, feature_pipeline
from reviewlens.operators.lookup import attach_by_key
from reviewlens.operators.net import AspectNet, AspectNetModel
from reviewlens.operators.wordtables import ranked_vocabulary as ranked_words
from reviewlens.plans import derived as dv
from reviewlens.plans import formulas, jobs
from reviewlens.schema import ANNOTATION_ASPECTS, ASPECTS
from reviewlens.session import cut_lineage, scratch_path, stored
from reviewlens.sources import annotations as an
from reviewlens.sources import models
from reviewlens.sources import reviews as rv
from reviewlens.streaming.score import score_stream, write_scores

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

PHRASE_THRESHOLD = 200.0
SEGMENT = {"least": 20, "threshold": 2.0}
NET = {"hidden": [32], "maxEpoch": 2, "numPartitions": 8}
MLP = {**NET, "hidden": [32, 16]}
WIDTH = 256
HASHED = 1000
BEGINNINGS = 20


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _text_query(name: str, build: Callable[[Column], Column]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dv.texts(spark, sf_dir).select("doc_id", build(F.col("cmt")).alias("cmt"))

    _QUERIES[name] = run


_text_query("nfc", tx.nfc)
_text_query("lower_text", tx.lower)
_text_query("remove_emoji", tx.remove_emoji)
_text_query("mask_hashtags", tx.mask_hashtags)
_text_query("mask_prices", tx.mask_prices)
_text_query("spelling_rules", lambda c: tx.spelling_rules(c, dv.RULES))
_text_query("apply_rules", lambda c: tx.apply_rules(c, dv.RULES))
_text_query("strip_special", tx.strip_special)
_text_query("autocorrect", lambda c: tx.autocorrect(tx.lower(c)))
_text_query("mask_prices_annotation", lambda c: tx.mask_prices(c, "giá_tiền"))
_text_query("mask_hashtags_annotation", lambda c: tx.mask_hashtags(c, "hashtag"))
_text_query("delete_special", lambda c: tx.strip_special(c, pt.SPECIAL_ANNOTATION, ""))
_text_query("clean_base", tx.clean_base)
_text_query("clean_basic", lambda c: tx.clean_text(c, "basic"))
_text_query("clean_advanced", lambda c: tx.clean_text(c, "advanced", dv.RULES))
_text_query("clean_annotation", tx.clean_annotation)


@query
def large_dictionary(spark, sf_dir):
    """Texts after a dictionary of all frequent beginnings of words, whose results hold one another's written forms."""
    words = dv.table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).filter(F.col("word").rlike("^[a-z]{6,}$"))
    found = words.groupBy(F.substring("word", 1, 5).alias("src")).count().filter(f"count >= {BEGINNINGS}")
    rules = found.select(F.col("src").alias("pos"), "src", F.concat(F.reverse(F.substring("src", 1, 3)), F.substring("src", 4, 2)).alias("dst"))
    return dv.texts(spark, sf_dir).select("doc_id", tx.apply_rules("cmt", rv.collect_rules(rules)).alias("cmt"))


# --- sources and sinks -----------------------------------------------------------------------


@query
def read_reviews(spark, sf_dir):
    """Reviews written as CSV and read back by name."""
    path = scratch_path(spark, "reviews-csv")
    table = dv.reviews(spark, sf_dir).withColumn("extra", F.lit("x")).select("extra", "doc_id", "cmt", *ASPECTS)
    (
        table.write.option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
    return rv.read_reviews(spark, path, keep=["doc_id"]).withColumn("doc_id", F.col("doc_id").cast("long"))


@query
def read_reviews_split(spark, sf_dir):
    """One large file, its reviews with line breaks in quotes, read by as many tasks as it has splits."""
    path = scratch_path(spark, "reviews-csv")
    table = dv.reviews(spark, sf_dir).select("doc_id", "cmt", *ASPECTS)
    (
        table.write.option("header", True).option("escape", '"').option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
    found = rv.read_reviews(spark, path, keep=["doc_id"], multi_line="split")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


@query
def read_reviews_two_folders(spark, sf_dir):
    """Two folders loaded and their rows put together."""
    paths = []
    table = dv.reviews(spark, sf_dir)
    for even in (0, 1):
        paths.append(scratch_path(spark, "reviews-part"))
        (
            table.filter(F.col("doc_id") % 2 == even).write.option("header", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(paths[-1])
        )
    return rv.read_reviews(spark, paths, keep=["doc_id"]).withColumn("doc_id", F.col("doc_id").cast("long"))


@query
def acronym_rules(spark, sf_dir):
    table = dv.table(spark, sf_dir, "part").select(
        "p_partkey", *[F.expr(sql).alias(c) for c, sql in dv.ACRONYMS.items()]
    )
    return rv.acronym_rules(table, list(dv.ACRONYMS), "p_partkey")


@query
def annotations_roundtrip(spark, sf_dir):
    """Annotations written in the text format and read back."""
    path = scratch_path(spark, "annotations-txt")
    table = dv.annotated(spark, sf_dir).withColumn("review", tx.clean_annotation("review"))
    an.write_annotations_txt(table, path)
    return an.read_annotations_txt(spark, {"a1": path}, offset=1)


@query
def annotations_csv(spark, sf_dir):
    """Annotations exported with index and byte order mark, and read back."""
    path = scratch_path(spark, "annotations-csv")
    an.write_annotations_csv(dv.annotated(spark, sf_dir), path)
    return an.read_annotations_csv(spark, path).withColumn("id", F.col("id").cast("long"))


@query
def annotations_csv_unlabelled(spark, sf_dir):
    """A two-column file gets seven empty aspect columns."""
    path = scratch_path(spark, "annotations-csv")
    (
        dv.annotated(spark, sf_dir).select("id", "review").write.option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
    return an.read_annotations_csv(spark, path).withColumn("id", F.col("id").cast("long"))


# --- rows and labels -------------------------------------------------------------------------


@query
def clean_reviews(spark, sf_dir):
    return rows.clean_reviews(dv.reviews(spark, sf_dir), acronyms=dv.RULES, keep=["doc_id"]).drop("label")


@query
def clean_sentences(spark, sf_dir):
    return rows.clean_sentences(dv.texts(spark, sf_dir), "basic", keep=["doc_id"])


@query
def row_index(spark, sf_dir):
    return rows.with_row_index(dv.texts(spark, sf_dir), order_by=["doc_id"]).select("doc_id", "cmt", "ColumnIndex")


@query
def document_at(spark, sf_dir):
    """The review at one position, with its label text."""
    table = dv.annotated(spark, sf_dir)
    # Only ids are sorted and kept; the row itself is looked up.
    indexed = rows.with_row_index(table.select("id"), order_by=["id"])
    found = table.join(F.broadcast(annotate.document(indexed, 42).select("id")), "id", "left_semi")
    return found.select("id", "review", lb.encode_label_text().alias("labels"))


@query
def hash_split(spark, sf_dir):
    train, test = rows.split_reviews(dv.texts(spark, sf_dir, spread=False))
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query
def random_split(spark, sf_dir):
    train, test = rows.split_reviews(dv.texts(spark, sf_dir, spread=False), method="random")
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query
def exact_split(spark, sf_dir):
    """Rows and words of both sides of a split of exact share, with the first side's rows as wanted."""
    train, test = rows.split_reviews(dv.texts(spark, sf_dir, spread=False), method="exact")
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def exact_split_difference(spark, sf_dir):
    """Both sides of a split of exact share, put together, against the whole table."""
    table = dv.texts(spark, sf_dir, spread=False)
    train, test = rows.split_reviews(table, method="exact")
    return _differing(train.unionByName(test), table)


@query
def parse_labels(spark, sf_dir):
    return dv.reviews(spark, sf_dir, text=False).select("doc_id", *[lb.parse_label(a).alias(a) for a in ASPECTS])


@query
def parse_labels_exact(spark, sf_dir):
    """Labels by exact spelling; every other row spells whole numbers without a point."""
    bare = [
        F.when(F.col("doc_id") % 2 == 0, F.replace(a, F.lit(".0"), F.lit(""))).otherwise(F.col(a)).alias(a)
        for a in ASPECTS
    ]
    return dv.reviews(spark, sf_dir, text=False).select("doc_id", *bare).select(
        "doc_id", *[lb.parse_label(a, "exact").alias(a) for a in ASPECTS]
    )


@query
def label_array(spark, sf_dir):
    """The label vector, taken apart again."""
    parsed = dv.reviews(spark, sf_dir, text=False).select("doc_id", *[lb.parse_label(a).alias(a) for a in ASPECTS])
    return rows.prediction_columns(parsed.select("doc_id", lb.label_array().alias("label")), "label", keep=["doc_id"])


@query
def snap_predictions(spark, sf_dir):
    snapped = dv.predictions(spark, sf_dir).withColumn("prediction", lb.snap_predictions())
    return rows.prediction_columns(snapped, keep=["doc_id"])


@query
def blank_absent(spark, sf_dir):
    return rows.sentence_result(dv.predictions(spark, sf_dir), keep=["doc_id"])


@query
def code_sentiment(spark, sf_dir):
    return dv.annotated(spark, sf_dir, "a2", text=False)


@query
def sentiment_codes(spark, sf_dir):
    table = dv.annotated(spark, sf_dir, "gold", text=False)
    return table.select("id", *[lb.sentiment_to_code(a).alias(a) for a in ANNOTATION_ASPECTS])


@query
def with_dne(spark, sf_dir):
    return rows.with_dne(dv.annotated(spark, sf_dir, text=False))


@query
def mentioned_aspects(spark, sf_dir):
    table = dv.annotated(spark, sf_dir, text=False)
    codes = table.select("id", *[lb.sentiment_to_code(a).alias(a) for a in ANNOTATION_ASPECTS])
    return rows.mentioned_aspects(codes, ["id"])


@query
def multilabel(spark, sf_dir):
    table = dv.annotations(spark, sf_dir).filter(F.col("annotator") == "a2")
    flags = table.select("rec", lb.to_multilabel("codes").alias("m"))
    return flags.select("rec", *[F.get("m", F.lit(i)).alias(f"m{i}") for i in range(21)])


@query
def encode_labels(spark, sf_dir):
    return dv.annotated(spark, sf_dir, text=False).select("id", lb.encode_label_text().alias("labels"))


@query
def decode_labels(spark, sf_dir):
    """Label text, with one aspect repeated at the end, back to columns."""
    text = F.concat(lb.encode_label_text(), F.lit(", {PRICE, neutral}"))
    coded = dv.annotated(spark, sf_dir, text=False).select("id", text.alias("labels"))
    return lb.decode_label_text(coded, keep=["id"])


@query
def unknown_label_names(spark, sf_dir):
    text = F.concat(lb.encode_label_text(), F.lit(", {PARKING, neutral}, {PRICE, neutral}"))
    coded = dv.annotated(spark, sf_dir, text=False).select("id", text.alias("labels"))
    return lb.unknown_label_names(coded, keep=["id"])


@query
def to_training(spark, sf_dir):
    return lb.to_training(dv.annotated(spark, sf_dir, "gold", text=False), ["id"]).drop("label")


# --- annotation tables -----------------------------------------------------------------------


@query
def apply_edits(spark, sf_dir):
    return annotate.apply_edits(dv.annotated(spark, sf_dir, text=False), dv.edits(spark, sf_dir), "id")


@query
def align_mismatches(spark, sf_dir):
    """Reader a2 lacks some records and has other text in some."""
    table = dv.annotations(spark, sf_dir, with_review=True)
    rec = F.col("rec")
    second = F.col("annotator") == "a2"
    changed = table.withColumn(
        "review", F.when(second & (rec % 10 == 3), F.concat("review", F.lit("!"))).otherwise(F.col("review"))
    ).filter(~(second & (rec % 10 == 7)) & ~((F.col("annotator") == "a1") & (rec % 20 == 9)))
    return annotate.misaligned(changed, "a1", "a2")


@query
def agreement(spark, sf_dir):
    return annotate.agreement(dv.annotations(spark, sf_dir), "a1", "a2").select(F.round("f1", 9).alias("f1"))


@query
def agreement_six(spark, sf_dir):
    """Agreement without the first aspect."""
    table = dv.annotations(spark, sf_dir).withColumn("codes", F.slice("codes", 2, 6))
    six = annotate.agreement(table, "a1", "a2", aspects=ANNOTATION_ASPECTS[1:])
    return six.select(F.round("f1", 9).alias("f1"))


@query
def benchmark(spark, sf_dir):
    marks = annotate.benchmark(dv.annotations(spark, sf_dir), "gold")
    return marks.select("annotator", F.round("f1", 9).alias("f1"))


# --- metrics ---------------------------------------------------------------------------------


@query
def aspect_accuracy(spark, sf_dir):
    report = metrics.aspect_correct(dv.predictions(spark, sf_dir))
    return report.withColumn("accuracy", F.round("accuracy", 9))


@query
def accuracy_report(spark, sf_dir):
    report = metrics.accuracy_report(dv.predictions(spark, sf_dir))
    return report.withColumn("accuracy", F.round("accuracy", 9))


@query
def constant_accuracy(spark, sf_dir):
    """Accuracy of answering "not mentioned" everywhere."""
    table = dv.predictions(spark, sf_dir).withColumn("prediction", F.array_repeat(F.lit(-2.0), 7))
    return metrics.accuracy_report(table).withColumn("accuracy", F.round("accuracy", 9))


def _f1_query(average: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = annotate.align(dv.annotations(spark, sf_dir), "gold", "a2")
        return metrics.multilabel_f1(pairs, average).select(F.round("f1", 9).alias("f1"))

    _QUERIES[f"multilabel_f1_{average}"] = run


for _average in ("micro", "macro", "weighted", "samples"):
    _f1_query(_average)


@query
def f1_per_class(spark, sf_dir):
    pairs = annotate.align(dv.annotations(spark, sf_dir), "gold", "a2")
    return metrics.f1_per_class(pairs).withColumn("f1", F.round("f1", 9))


@query
def cohen_kappa(spark, sf_dir):
    pairs = annotate.align(dv.annotations(spark, sf_dir), "a1", "a2")
    return metrics.cohen_kappa(pairs).select(
        "aspect", "n", *[F.round(c, 9).alias(c) for c in ("observed", "chance", "kappa")]
    )


@query
def compare_annotators(spark, sf_dir):
    """Agreement and benchmarks of three annotation tables whose records match."""
    tables = [
        dv.annotated(spark, sf_dir, r).select(F.lit(r).alias("annotator"), F.col("id").alias("rec"), "review", *ANNOTATION_ASPECTS)
        for r in dv.READERS
    ]
    table = tables[0].unionByName(tables[1]).unionByName(tables[2])
    return jobs.compare_annotators(table, "a1", "a2", "gold").withColumn("f1", F.round("f1", 9))


# --- features --------------------------------------------------------------------------------


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.clean_sentences(dv.texts(spark, sf_dir), "basic", keep=["doc_id"])


def _cleaned_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written: for queries that read the cleaned rows more than once."""
    return stored(_cleaned(spark, sf_dir), "cleaned")


def _sparse_cells(vector: str) -> Column:
    """(at, value) of a vector's stored entries; a dense one is numbered from 0."""
    v = F.unwrap_udt(vector)
    at = F.coalesce(v["indices"], F.transform(v["values"], lambda x, i: i))
    return F.arrays_zip(at.alias("at"), v["values"].alias("value"))


@query
def term_stats(spark, sf_dir):
    return terms.term_stats(_cleaned(spark, sf_dir))


@query
def vocabulary(spark, sf_dir):
    return terms.vocabulary(_cleaned(spark, sf_dir), 500)


@query
def term_tfidf(spark, sf_dir):
    return terms.term_tfidf(_cleaned(spark, sf_dir), "doc_id").withColumn("tfidf", F.round("tfidf", 6))


@query
def document_terms(spark, sf_dir):
    return terms.document_terms(_cleaned(spark, sf_dir), "doc_id")


@query
def count_vectors(spark, sf_dir):
    """The word-count pipeline over the whole vocabulary, its vectors as terms; the vocabulary is a table throughout."""
    table = _cleaned_once(spark, sf_dir)
    model = feature_pipeline("termcount", 0).fit(table)
    names = model.stages[0].table.select(F.col("rank").cast("int").alias("at"), "term", "n")
    cells = model.transform(table).select("doc_id", F.inline(_sparse_cells("features")))
    found = attach_by_key(cells.filter(F.col("value") != 0), names, "at", "n")
    return found.select("doc_id", "term", F.col("value").cast("long").alias("tf"))


@query
def ranked_vocabulary(spark, sf_dir):
    """All words of at least five reviews, ranked by frequency."""
    return ranked_words(_cleaned(spark, sf_dir), None)


@query
def cooccurrences(spark, sf_dir):
    """Words within two places of each other."""
    return vectors.cooccurrences(_cleaned(spark, sf_dir), window=2, least=20)


@query
def word_vectors(spark, sf_dir):
    """Mean word vectors from co-occurrence."""
    table = _cleaned_once(spark, sf_dir)
    out = feature_pipeline("wordvectors", 16).fit(table).transform(table)
    return out.select("doc_id", F.posexplode(vector_to_array("features")).alias("at", "value"))


@query
def hashing_tf(spark, sf_dir):
    """Words per review, as the sum over the hashed term frequencies."""
    table = _cleaned(spark, sf_dir)
    hashed = feature_pipeline("tfidf", 10_000).getStages()[1]
    words = feature_pipeline("tfidf", 10_000).getStages()[0].transform(table)
    total = F.aggregate(F.unwrap_udt("rawFeatures")["values"], F.lit(0.0), lambda s, x: s + x)
    return hashed.transform(words).select("doc_id", total.cast("long").alias("n_words"))


def _buckets(vector: str) -> Column:
    """(bucket, value) of the entries that are not 0."""
    return F.inline(F.filter(_sparse_cells(vector), lambda c: c["value"] != 0)).alias("bucket", "value")


@query
def hashed_counts(spark, sf_dir):
    """Hashed term frequencies, bucket by bucket."""
    words, hashed = feature_pipeline("tfidf", HASHED).getStages()[:2]
    return hashed.transform(words.transform(_cleaned(spark, sf_dir))).select("doc_id", _buckets("rawFeatures"))


@query
def split_features(spark, sf_dir):
    """Hashed tf-idf fitted on the training side only; vectors and labels of both sides."""
    cleaned = rows.clean_reviews(dv.reviews(spark, sf_dir), "basic", keep=["doc_id"])
    _, train, test = build_features(*rows.split_reviews(cleaned, 0.8, 50, "doc_id"), feature_pipeline("tfidf", HASHED), ("doc_id",))
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    cells = both.select("side", "doc_id", F.element_at("label", 1).alias("general"), _buckets("features"))
    return cells.withColumn("value", F.round("value", 6))


@query
def clean_advanced_phrases(spark, sf_dir):
    return dv.texts(spark, sf_dir).select("doc_id", tx.clean_text("cmt", "advanced", dv.RULES, formulas.PHRASES).alias("cmt"))


@query
def tfidf_vectors(spark, sf_dir):
    table = _cleaned(spark, sf_dir)
    out = feature_pipeline("tfidf", 10_000).fit(table).transform(table)
    return out.select("doc_id", F.inline(_sparse_cells("features")))


@query
def word2vec(spark, sf_dir):
    # Counting, fitting and scoring read the same cleaned rows, in the same partitions.
    table = cut_lineage(_cleaned(spark, sf_dir))
    out = feature_pipeline("word2vec", 16).fit(table).transform(table)
    return out.select("doc_id", F.posexplode(vector_to_array("features")).alias("at", "value"))


@query
def learn_phrases(spark, sf_dir):
    found = phrases.learn_phrases(_cleaned(spark, sf_dir), threshold=PHRASE_THRESHOLD)
    return found.withColumn("score", F.round("score", 6))


@query
def apply_phrases(spark, sf_dir):
    table = _cleaned_once(spark, sf_dir)
    found = phrases.learn_phrases(table, threshold=PHRASE_THRESHOLD, written=True)
    return phrases.apply_phrases(table, stored(found, "phrases"))


@query
def gram_lexicon(spark, sf_dir):
    """Runs of up to four syllables, with costs."""
    return segment.gram_lexicon(_cleaned(spark, sf_dir), **SEGMENT)


@query
def segment_words(spark, sf_dir):
    """Reviews cut into the cheapest words of that lexicon."""
    table = _cleaned_once(spark, sf_dir)
    return segment.segment(table, segment.gram_lexicon(table, **SEGMENT, written=True))


@query
def segment_words_joined(spark, sf_dir):
    """The same with a lexicon too large to be sent to every task."""
    table = _cleaned_once(spark, sf_dir)
    return segment.segment(table, segment.gram_lexicon(table, **SEGMENT, written=True), limit=0)


@query
def clean_advanced_words(spark, sf_dir):
    """The advanced cleaner with its last step, words of several syllables, from a stored lexicon."""
    plain = jobs.Prep(acronyms=dv.RULES)
    path = scratch_path(spark, "lexicon")
    segment.gram_lexicon(plain.sentences(dv.texts(spark, sf_dir)), **SEGMENT).write.parquet(path)
    return jobs.Prep(acronyms=dv.RULES, lexicon_path=path).sentences(dv.texts(spark, sf_dir), ["doc_id"])


@query
def learned_words(spark, sf_dir):
    """Words of several syllables after three rounds of cutting and counting."""
    return segment.learn_lexicon(_cleaned(spark, sf_dir)).filter(F.contains("word", F.lit(segment.JOINT)))


# --- models ----------------------------------------------------------------------------------


def _train(spark: SparkSession, sf_dir: str, arch: str, kind: str = "tfidf", **paths) -> jobs.Trained:
    net = MLP if arch == "mlp" else NET
    return jobs.train(
        dv.reviews(spark, sf_dir), arch, kind, WIDTH if kind != "word2vec" else 16, jobs.Prep("basic"),
        **net, **paths,
    )


def _train_query(arch: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _train(spark, sf_dir, arch).report

    _QUERIES[f"train_{arch}"] = run


for _arch in ("mlp", "rnn", "gru", "lstm"):
    _train_query(_arch)


def _forward_query(arch: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A network with fixed weights over order lines; its outputs where they equal the closed formula, else null."""
        net = AspectNetModel(formulas.weights(arch))
        net.set(net.arch, arch)
        lines = dv.table(spark, sf_dir, "lineitem").withColumn("features", array_to_vector(F.array(*map(F.expr, formulas.INPUTS))))
        scored = net.transform(lines)
        values = [F.expr(sql) for sql in formulas.outputs(arch)]
        return scored.select("l_orderkey", "l_linenumber", *[
            F.when(F.abs(F.get("prediction", F.lit(i)) - v) < 1e-5, F.round(v, 10)).alias(f"p{i}") for i, v in enumerate(values)
        ])

    _QUERIES[f"forward_{arch}"] = run


for _arch in ("mlp", "rnn", "gru", "lstm"):
    _forward_query(_arch)


def _gradient_query(arch: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """One full-batch gradient of a network with fixed weights over order lines, put together from all tasks."""
        lines = dv.table(spark, sf_dir, "lineitem").select(
            array_to_vector(F.array(*map(F.expr, formulas.SHIFTED))).alias("features"), F.array(*map(F.expr, formulas.TARGETS)).alias("label")
        )
        table = descent.numbered(lines, "features", "label", 50)
        _, found = descent.gradient(table, arch, formulas.weights(arch), 0, table.count())
        # As many rows as the network has weights.
        cells = [(name, i, float(v)) for name, g in found.items() for i, v in enumerate(g.ravel())]
        values = spark.createDataFrame(cells, "name string, at int, value double")
        return values.withColumn("value", F.round("value", 7) + 0.0)

    _QUERIES[f"gradient_{arch}"] = run


for _arch in ("mlp", "rnn"):
    _gradient_query(_arch)


@query
def train_together(spark, sf_dir):
    """Accuracy of a network trained by synchronous steps of 2,000 rows."""
    return jobs.train(
        dv.reviews(spark, sf_dir), "lstm", "tfidf", WIDTH, jobs.Prep("basic"), hidden=[32], maxEpoch=2, syncRows=2000
    ).report


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Number of rows that one of two tables has more often than the other."""
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("n_different"))


@query
def stored_model_difference(spark, sf_dir):
    """Scores of the stored features and network against those of the fitted ones."""
    saved = {"features_path": scratch_path(spark, "features"), "net_path": scratch_path(spark, "net")}
    done = _train(spark, sf_dir, "lstm", **saved)
    texts, prep = dv.texts(spark, sf_dir), jobs.Prep("basic")
    stored = jobs.load_features(saved["features_path"]), jobs.load_net(saved["net_path"])
    return _differing(jobs.score(texts, done.features, done.net, prep, ["doc_id"]), jobs.score(texts, *stored, prep, ["doc_id"]))


@query
def stream_score_difference(spark, sf_dir):
    """Scores of a stream of files against those of the table."""
    done, prep = _train(spark, sf_dir, "gru"), jobs.Prep("basic")
    source, out, mark = (scratch_path(spark, n) for n in ("texts", "scores", "scores-checkpoint"))
    dv.texts(spark, sf_dir).write.parquet(source)
    stream = spark.readStream.schema("doc_id long, cmt string").parquet(source)
    write_scores(score_stream(stream, done.features, done.net, prep, ["doc_id"]), out, mark).awaitTermination()
    return _differing(spark.read.parquet(out), jobs.score(spark.read.parquet(source), done.features, done.net, prep, ["doc_id"]))


@query
def random_split_difference(spark, sf_dir):
    """Both sides of a random split, put together, against the whole table."""
    table = dv.texts(spark, sf_dir).select("doc_id", "cmt")
    train, test = rows.split_reviews(table, method="random")
    return _differing(train.unionByName(test), table)


@query
def evaluate(spark, sf_dir):
    """Stored features and network over the whole table."""
    saved = {"features_path": scratch_path(spark, "features"), "net_path": scratch_path(spark, "net")}
    _train(spark, sf_dir, "gru", "wordcount", **saved)
    return jobs.evaluate(
        dv.reviews(spark, sf_dir), jobs.load_features(saved["features_path"]), jobs.load_net(saved["net_path"]),
        jobs.Prep("basic"),
    )


@query
def score(spark, sf_dir):
    done = _train(spark, sf_dir, "rnn", "word2vec")
    return jobs.score(dv.texts(spark, sf_dir), done.features, done.net, jobs.Prep("basic"), ["doc_id"])


@query
def score_streaming(spark, sf_dir):
    """Texts arriving as files, scored by a stream."""
    done = _train(spark, sf_dir, "gru")
    source, out, mark = (scratch_path(spark, n) for n in ("texts", "scores", "scores-checkpoint"))
    dv.texts(spark, sf_dir).write.parquet(source)
    stream = spark.readStream.schema("doc_id long, cmt string").parquet(source)
    scored = score_stream(stream, done.features, done.net, jobs.Prep("basic"), ["doc_id"])
    write_scores(scored, out, mark).awaitTermination()
    return spark.read.parquet(out)


@query
def compare_models(spark, sf_dir):
    """Three stored slots on one table."""
    slots = {}
    for arch, kind in (("mlp", "tfidf"), ("lstm", "tfidf"), ("gru", "wordcount")):
        saved = {"features_path": scratch_path(spark, "features"), "net_path": scratch_path(spark, "net")}
        _train(spark, sf_dir, arch, kind, **saved)
        slots[f"{arch}-{kind}"] = jobs.Slot(**saved, prep=jobs.Prep("basic"))
    return jobs.compare_models(dv.reviews(spark, sf_dir), slots)


def _annotator(spark: SparkSession, sf_dir: str):
    table = dv.annotated(spark, sf_dir)
    cleaned = cut_lineage(lb.to_training(
        table.withColumn("cmt", tx.clean_annotation("review")), ["id", "cmt"]
    ))
    features = feature_pipeline("tfidf", WIDTH).fit(cleaned)
    net = AspectNet(arch="rnn", keyCol="id", **NET).fit(features.transform(cleaned).select("id", "features", "label"))
    return table, features, net


@query
def classify(spark, sf_dir):
    table, features, net = _annotator(spark, sf_dir)
    codes = annotate.classify(table, features, net, keep=["id"])
    return codes.select("id", *[F.get("codes", F.lit(i)).alias(a) for i, a in enumerate(ANNOTATION_ASPECTS)])


@query
def auto_label_all(spark, sf_dir):
    table, features, net = _annotator(spark, sf_dir)
    return annotate.auto_label(table, features, net).drop("review")


@query
def auto_label_rest_difference(spark, sf_dir):
    """Rows that were not chosen to be labelled anew, before and after."""
    table, features, net = _annotator(spark, sf_dir)
    ids = dv.table(spark, sf_dir, "labels").filter(F.col("quality") == 0).select(F.col("doc_id").alias("id"))
    labelled = annotate.auto_label(table, features, net, ids=ids)
    return _differing(labelled.join(ids, "id", "left_anti").select(*table.columns), table.join(ids, "id", "left_anti"))


@query
def auto_label_some(spark, sf_dir):
    """Only documents with a negative quality mark are labelled anew."""
    table, features, net = _annotator(spark, sf_dir)
    ids = dv.table(spark, sf_dir, "labels").filter(F.col("quality") == 0).select(F.col("doc_id").alias("id"))
    return annotate.auto_label(table, features, net, ids=ids).drop("review")


# --- jobs with fixed models, whose results SQL can give -----------------------------------------


def _fixed_features() -> PipelineModel:
    counts = CountVectorizerModel.from_vocabulary(list(formulas.VOCABULARY), inputCol="words", outputCol="features_vec")
    return PipelineModel([
        Tokenizer(inputCol="cmt", outputCol="words"), counts, VectorAssembler(inputCols=["features_vec"], outputCol="features")
    ])


def _fixed_net(arch: str) -> AspectNetModel:
    net = AspectNetModel(formulas.model_weights(arch))
    net._set(arch=arch, hidden=list(formulas.HIDDEN[arch]))
    return net


@query
def score_fixed(spark, sf_dir):
    """Every text scored by a fixed network over word counts."""
    return jobs.score(dv.texts(spark, sf_dir), _fixed_features(), _fixed_net("mlp"), jobs.Prep("advanced", acronyms=dv.RULES), ["doc_id"])


@query
def score_stream_fixed(spark, sf_dir):
    """The same network over texts that arrive as files."""
    source, out, mark = (scratch_path(spark, n) for n in ("texts", "scores", "scores-checkpoint"))
    dv.texts(spark, sf_dir).write.parquet(source)
    stream = spark.readStream.schema("doc_id long, cmt string").parquet(source)
    prep = jobs.Prep("advanced", acronyms=dv.RULES)
    write_scores(score_stream(stream, _fixed_features(), _fixed_net("mlp"), prep, ["doc_id"]), out, mark).awaitTermination()
    return spark.read.parquet(out)


@query
def score_sentences(spark, sf_dir):
    """Sentences written inline, followed by those of a table, through the sentence job."""
    inline = rv.sentences_df(spark, list(formulas.SENTENCES)).withColumn("doc_id", F.lit(None).cast("long"))
    table = inline.unionByName(dv.texts(spark, sf_dir))
    return jobs.score(table, _fixed_features(), _fixed_net("rnn"), jobs.Prep("basic"), ["doc_id"])


@query
def evaluate_fixed(spark, sf_dir):
    return jobs.evaluate(dv.reviews(spark, sf_dir), _fixed_features(), _fixed_net("gru"), jobs.Prep("basic"))


def _fixed_slots(spark: SparkSession) -> dict[str, jobs.Slot]:
    """Stored slots: every network under both cleaners."""
    features = scratch_path(spark, "features")
    models.save_features(_fixed_features(), features)
    slots = {}
    for arch in formulas.HIDDEN:
        net = scratch_path(spark, "net")
        models.save_net(_fixed_net(arch), net)
        slots[f"{arch}-basic"] = jobs.Slot(features, net, jobs.Prep("basic"))
        slots[f"{arch}-advanced"] = jobs.Slot(features, net, jobs.Prep("advanced", acronyms=dv.RULES))
    return slots


@query
def compare_models_fixed(spark, sf_dir):
    return jobs.compare_models(dv.reviews(spark, sf_dir), _fixed_slots(spark))


def _dealt(texts: DataFrame, slots) -> DataFrame:
    """Every text with one of the slots by its doc_id."""
    return texts.withColumn("slot", F.get(F.array(*map(F.lit, sorted(slots))), (F.col("doc_id") % len(slots)).cast("int")))


@query
def score_slots_fixed(spark, sf_dir):
    """Every text scored by the stored slot that its row names."""
    slots = _fixed_slots(spark)
    return jobs.score_slots(_dealt(dv.texts(spark, sf_dir), slots), slots, keep=["doc_id", "slot"])


@query
def classify_fixed(spark, sf_dir):
    codes = annotate.classify(dv.annotated(spark, sf_dir), _fixed_features(), _fixed_net("mlp"), keep=["id"])
    return codes.select("id", *[F.get("codes", F.lit(i)).alias(a) for i, a in enumerate(ANNOTATION_ASPECTS)])


@query
def auto_label_all_fixed(spark, sf_dir):
    return annotate.auto_label(dv.annotated(spark, sf_dir), _fixed_features(), _fixed_net("mlp")).drop("review")


@query
def auto_label_some_fixed(spark, sf_dir):
    ids = dv.table(spark, sf_dir, "labels").filter(F.col("quality") == 0).select(F.col("doc_id").alias("id"))
    return annotate.auto_label(dv.annotated(spark, sf_dir), _fixed_features(), _fixed_net("mlp"), ids=ids).drop("review")
