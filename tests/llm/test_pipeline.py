import random

import corpus_pipeline as cp
from reviewlens.llm import decontaminate, jaccard, language

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = {"aa": ["ka", "ti", "mo"], "bb": ["sch", "eu", "ung"]}


def corpus(tmp_path, spark):
    rng = random.Random(8)

    def prose(lang, n):
        return " ".join("".join(rng.choices(PARTS[lang], k=rng.randrange(1, 6))) for _ in range(n))

    item = prose("aa", 40)
    rows = []
    for k in range(120):
        lang = rng.choice("ab") * 2
        rows.append((k, "\n".join(prose(lang, 30) for _ in range(4)), lang))
    rows += [(200, rows[3][1], "aa"), (201, rows[4][1].replace("\n", " "), rows[4][2])]
    rows += [(202, prose("aa", 50) + " " + item + " " + prose("aa", 50), "aa")]
    rows += [(203, None, "aa"), (204, "", "aa"), (205, "12 34", None), (206, "Жж Щщ Юю Яя Ыы " * 10, None), (207, "mokati", "aa")]
    near = rows[5][1].replace("\n", " ").split(" ")
    near[60] = "tititikaka"
    rows += [(208, "\n".join(" ".join(near[k : k + 17]) for k in range(0, len(near), 17)), rows[5][2])]
    docs = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose("bb", 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def test_every_stage_takes_effect(spark, tmp_path):
    sf, rows = corpus(tmp_path, spark)
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    names = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), COLUMNS)
        assert docs.columns == names
        seen.append({r.doc_id: r.text for r in docs.collect()})
    assert set(range(120)) <= set(seen[0]) and not {203, 204, 205, 206} & set(seen[0])
    assert {200, 201, 202, 207, 208} <= set(seen[0])
    assert 200 not in seen[1] and 201 in seen[1]
    assert not {201, 208} & set(seen[2]) and set(range(120)) <= set(seen[2])
    assert set(seen[2]) - set(seen[3]) == {202}
    packed = {r.doc_id for r in cp.run(spark, sf).collect()}
    assert packed == set(seen[3])


def test_stages_agree_with_their_operators(spark, tmp_path):
    sf, rows = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in cp.near_duplicate_stage(spark, docs, sf).collect()}
    assert kept == {r.doc_id for r in jaccard.classes(docs).collect() if r.component_id == r.doc_id}
    held = {r.doc_id for r in decontaminate.matches(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in cp.decontamination_stage(spark, docs, sf).collect()} == {i for i, *_ in rows} - held
    model = language.fit(docs.filter(language.training_rows(docs)))
    rejected = {r.doc_id for r in language.predict(docs, model).collect() if r.rejected}
    assert {r.doc_id for r in cp.language_stage(spark, docs, sf).collect()} == {i for i, *_ in rows} - rejected


def test_stages_on_an_empty_table(spark, tmp_path):
    sf, _ = corpus(tmp_path, spark)
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf).collect() == []


def test_near_duplicates_are_decided_by_row(spark, tmp_path):
    rng = random.Random(3)
    a, b, c = (" ".join(f"{n}{rng.randrange(900)}" for _ in range(60)) for n in "abc")
    rows = [(5, a), (5, a), (5, a), (None, a), (7, b), (5, b + " more"), (8, c), (8, "other"), (None, c), (None, "x y"), (9, None), (9, None), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS).repartition(3)
    kept = sorted(((r.doc_id or 0, r.text or "") for r in cp.near_duplicate_stage(spark, docs, "").collect()))
    assert kept == sorted([(5, a), (5, b + " more"), (8, c), (8, "other"), (0, "x y"), (9, ""), (9, ""), (10, "")])
