"""Whole jobs: train, evaluate, score, compare stored models, compare annotators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.functions import labels as lb
from reviewlens.functions import text as tx
from reviewlens.operators import annotate, metrics
from reviewlens.operators.features import build_features, feature_pipeline
from reviewlens.operators.phrases import learn_phrases
from reviewlens.operators.net import AspectNet, AspectNetModel, predict_by_name, vector_parts
from reviewlens.operators.rows import clean_reviews, clean_sentences, sentence_result, split_reviews
from reviewlens.operators.segment import THRESHOLD, learn_lexicon, segment
from reviewlens.schema import ANNOTATION_ASPECTS, ASPECTS
from reviewlens.session import cut_lineage, scratch_path
from reviewlens.sources.models import load_features, load_net, save_features, save_net
from reviewlens.sources.reviews import sentences_df


# Learned phrases travel as literals; more are refused.
PHRASES = 20_000


@dataclass
class Prep:
    """Cleaning settings, to be the same in training and scoring."""

    mode: str = "advanced"
    label_mode: str = "numeric"
    acronyms: Sequence[tuple[str, str]] = ()
    phrases: Sequence[tuple[str, str]] | None = None
    missing_text: str = ""
    # A stored lexicon (see ``operators.segment``) by which cleaned text is cut into words.
    lexicon_path: str | None = None

    def words(self, df: DataFrame, text: str = "cmt") -> DataFrame:
        """Cleaned ``text`` as words of the lexicon."""
        return segment(df, df.sparkSession.read.parquet(self.lexicon_path), text) if self.lexicon_path else df

    def reviews(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return self.words(clean_reviews(
            df, self.mode, self.label_mode, self.acronyms, self.phrases, self.missing_text, keep
        ))

    def sentences(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return self.words(clean_sentences(df, self.mode, self.acronyms, self.phrases, keep))


@dataclass
class Trained:
    features: PipelineModel
    net: AspectNetModel
    report: DataFrame
    predictions: DataFrame = field(repr=False)
    prep: Prep = field(default_factory=Prep)


def train(
    reviews: DataFrame,
    arch: str,
    kind: str = "tfidf",
    num_features: int | None = None,
    prep: Prep | None = None,
    key: str | None = "doc_id",
    train_ratio: float = 0.8,
    seed: int = 50,
    features_path: str | None = None,
    net_path: str | None = None,
    w2v_partitions: int | None = None,
    w2v_min_count: int = 5,
    min_df: float = 5,
    phrase_threshold: float | None = None,
    segment_rounds: int | None = None,
    segment_threshold: float = THRESHOLD,
    lexicon_path: str | None = None,
    **net_params,
) -> Trained:
    """Clean, split, fit features on the training side, fit the network, score the test side.

    ``reviews`` holds ``key``, ``cmt`` and the seven label columns as text. Without a key the
    split is random. ``w2v_min_count`` and ``min_df`` bound the vocabularies, see ``feature_pipeline``.
    With ``phrase_threshold`` word pairs are learned from the cleaned training side and joined in all rows;
    the settings to score with, learned pairs included, are ``Trained.prep``.
    With ``segment_rounds`` a lexicon is learned from the cleaned training side, stored at ``lexicon_path``, and all
    text is cut into its words.
    """
    prep = prep or Prep()
    keep = [key] if key else []
    if phrase_threshold is not None:
        plain, _ = split_reviews(prep.reviews(reviews, keep), train_ratio, seed, key, method="hash" if key else "random")
        pairs = learn_phrases(plain, threshold=phrase_threshold).select("a", "b").limit(PHRASES + 1).collect()
        if len(pairs) > PHRASES:
            raise ValueError(f"more than {PHRASES} phrases; raise phrase_threshold")
        prep = replace(prep, phrases=sorted({*(prep.phrases or ()), *((r["a"], r["b"]) for r in pairs)}))
    if segment_rounds is not None:
        plain, _ = split_reviews(replace(prep, lexicon_path=None).reviews(reviews, keep), train_ratio, seed, key, method="hash" if key else "random")
        lexicon_path = lexicon_path or scratch_path(reviews.sparkSession, "lexicon")
        learn_lexicon(plain, rounds=segment_rounds, threshold=segment_threshold).write.parquet(lexicon_path)
        prep = replace(prep, lexicon_path=lexicon_path)
    # Fitting, training and scoring read the same cleaned rows, in the same partitions.
    cleaned = cut_lineage(prep.reviews(reviews, keep))
    train_rows, test_rows = split_reviews(
        cleaned, train_ratio, seed, key, method="hash" if key else "random"
    )
    pipeline = feature_pipeline(kind, num_features, min_df, w2v_partitions, w2v_min_count)
    features, train_set, test_set = build_features(train_rows, test_rows, pipeline, tuple(keep))
    if features_path:
        save_features(features, features_path)
    net = AspectNet(arch=arch, keyCol=key or "", seed=seed, **net_params).fit(train_set)
    if net_path:
        save_net(net, net_path)
    predictions = net.transform(test_set).select(*keep, "label", "prediction")
    return Trained(features, net, metrics.accuracy_report(predictions), predictions, prep)


def evaluate(
    reviews: DataFrame, features: PipelineModel, net: AspectNetModel, prep: Prep | None = None
) -> DataFrame:
    """Accuracy report of stored models over a whole review table."""
    cleaned = (prep or Prep()).reviews(reviews)
    return metrics.accuracy_report(net.transform(features.transform(cleaned).select("features", "label")))


def score(
    df: DataFrame,
    features: PipelineModel,
    net: AspectNetModel,
    prep: Prep | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Seven text columns per row of ``cmt``: ``-1.0``, ``0.0``, ``1.0`` or blank."""
    cleaned = (prep or Prep()).sentences(df, keep)
    scored = net.transform(features.transform(cleaned).select(*keep, "features"))
    return sentence_result(scored, keep=keep)


def predict_sentence(
    spark, sentence: str, features: PipelineModel, net: AspectNetModel, prep: Prep | None = None
) -> list[str]:
    """The one-row case of ``score``, in aspect order."""
    row = score(sentences_df(spark, sentence), features, net, prep).limit(1).collect()[0]
    return [row[a] for a in ASPECTS]


@dataclass
class Slot:
    """A stored combination of cleaning, features and network."""

    features_path: str
    net_path: str
    prep: Prep = field(default_factory=Prep)


def compare_models(reviews: DataFrame, slots: Mapping[str, Slot], overall: bool = True) -> DataFrame:
    """Accuracy of every slot on one table, as rows (slot, aspect, correct, total, accuracy).

    The table is read once. Each distinct cleaning and each distinct feature pipeline runs once
    per row however many networks use it, and one aggregate counts for all slots.
    """
    names = list(slots)
    modes: list[Prep] = []
    for slot in slots.values():
        if slot.prep not in modes:
            modes.append(slot.prep)
    rows = reviews.select("cmt", *ASPECTS)
    # Labels are parsed with each slot's own rule.
    for i, prep in enumerate(modes):
        rows = rows.withColumn(
            f"_text{i}",
            tx.clean_text("cmt", prep.mode, prep.acronyms, prep.phrases, prep.missing_text),
        ).withColumn(
            f"_label{i}", lb.label_array([lb.parse_label(a, prep.label_mode) for a in ASPECTS])
        )
        rows = prep.words(rows, f"_text{i}")
    kept = [c for c in rows.columns if c.startswith("_")]
    rows = rows.select(*kept)
    done: dict[tuple[int, str], str] = {}
    for at, slot in enumerate(slots.values()):
        mode = modes.index(slot.prep)
        use = (mode, slot.features_path)
        if use not in done:
            done[use] = f"_features{len(done)}"
            fitted = load_features(slot.features_path)
            before = rows.columns
            rows = fitted.transform(rows.withColumn("cmt", F.col(f"_text{mode}")))
            rows = rows.select(*before, F.col("features").alias(done[use]))
        net = load_net(slot.net_path)
        rows = net.copy({net.featuresCol: done[use], net.predictionCol: f"_out{at}"}).transform(rows)
    cells = F.array(*[
        F.struct(
            F.lit(name).alias("slot"),
            F.col(f"_label{modes.index(slots[name].prep)}").alias("label"),
            F.col(f"_out{at}").alias("prediction"),
        )
        for at, name in enumerate(names)
    ])
    flat = rows.select(F.inline(cells))
    return (metrics.accuracy_report if overall else metrics.aspect_correct)(flat, by=["slot"])


# Weights of all slots together, in bytes, that may go to a task.
SLOT_WEIGHTS = 1 << 30


def score_slots(df: DataFrame, slots: Mapping[str, Slot], slot: str = "slot", keep: Sequence[str] = ()) -> DataFrame:
    """``score`` where every row names its stored slot in column ``slot``; for tables and streams alike.

    The table is read once and not shuffled. A text is cleaned only by its own slot's rules, meets only its own network, and passes the
    other feature pipelines as empty text. A null slot gives nulls; an unknown one raises and is named. Weights of more than
    ``SLOT_WEIGHTS`` bytes in all are refused.
    """
    nets = {name: load_net(s.net_path) for name, s in slots.items()}
    size = sum(w.nbytes for net in nets.values() for w in net.weights.values())
    if size > SLOT_WEIGHTS:
        raise ValueError(f"the slots' networks hold {size} bytes, more than {SLOT_WEIGHTS}")
    wrong = F.raise_error(F.concat(F.lit("unknown slot: "), F.col(slot)))
    named = F.when(F.col(slot).isNull() | F.col(slot).isin(*nets), F.col(slot)).otherwise(wrong)
    kept = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    rows = df.select(*kept, named.alias("_slot"), F.col("cmt").alias("_raw"))
    base, uses = rows.columns, []
    for s in slots.values():
        if all((s.prep, s.features_path) != (u.prep, u.features_path) for u in uses):
            uses.append(s)
    vector = None
    for i, use in enumerate(uses):
        mine = F.col("_slot").isin(*[n for n, s in slots.items() if (s.prep, s.features_path) == (use.prep, use.features_path)])
        p = use.prep
        rows = rows.withColumn("cmt", F.when(mine, tx.clean_text("_raw", p.mode, p.acronyms, p.phrases, p.missing_text)).otherwise(""))
        rows = load_features(use.features_path).transform(p.words(rows)).select(*base, F.col("features").alias(f"_features{i}"))
        base = rows.columns
        vector = (F if vector is None else vector).when(mine, F.col(f"_features{i}"))
    scored = rows.withColumn("features", vector).withColumn("prediction", predict_by_name(df.sparkSession, nets)("_slot", *vector_parts("features")))
    scored = scored.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], "prediction")
    return sentence_result(scored, keep=keep)


def compare_annotators(
    annotations: DataFrame, a: str, b: str, gold: str, key: str = "rec",
    aspects: Sequence[str] = ANNOTATION_ASPECTS,
) -> DataFrame:
    """(measure, f1): agreement of two annotators, and each against gold.

    Refuses tables whose records do not match, and says which. Records are brought together once, by one shuffle
    whose result is written; the check and all measures read that.
    """
    others = [r[0] for r in annotations.select("annotator").distinct().collect()]
    names = [a, b, *sorted({*others, gold} - {a, b})]
    coded = annotate.with_codes(annotations, aspects)
    wide = cut_lineage(annotate.side_by_side(coded, names, key))
    wrong = annotate.misaligned_side_by_side(wide, names, gold, key).filter(F.col("annotator").isin(a, b)).limit(5).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['annotator']} and {gold} differ, for example: {[tuple(r) for r in wrong]}")
    g = names.index(gold)
    pairs = [(F.lit("agreement"), "y_0", "y_1")] + [(F.lit(f"benchmark {n}"), f"y_{g}", f"y_{i}") for i, n in enumerate(names) if i != g]
    cells = F.array(*[F.struct(m.alias("measure"), F.col(t).alias("y_true"), F.col(p).alias("y_pred")) for m, t, p in pairs])
    rows = wide.select(F.inline(cells)).filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    return metrics.multilabel_f1(rows, "micro", aspects=aspects, by=["measure"])
