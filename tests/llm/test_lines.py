import random
import re

import pytest
from pyspark.sql import functions as F

from reviewlens.llm import lines


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs, minimum=lines.MIN_WORDS):
    first, text = {}, {}
    for doc, t in docs:
        for at, line in enumerate((t or "").split("\n") if t is not None else []):
            s = " ".join(re.findall(r"[^\x20\x09-\x0D]+", line))
            if s:
                first[s] = min(first.get(s, (doc, at)), (doc, at))
    words = {s: s.split() for s in first}
    near = {s for s in first for o in first if first[o] < first[s] and len(words[s]) >= minimum and len(words[o]) >= minimum and distance_one(words[s], words[o])}
    out = {}
    for doc, t in docs:
        if t is None:
            out[doc] = (None, 0, 0, 0)
            continue
        kept, exact, close = [], 0, 0
        for at, line in enumerate(t.split("\n")):
            s = " ".join(re.findall(r"[^\x20\x09-\x0D]+", line))
            if s and first[s] < (doc, at):
                exact += 1
            elif s in near:
                close += 1
            else:
                kept.append(line)
        out[doc] = ("\n".join(kept), len(t.split("\n")), exact, close)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)]
    base = [rng.choices(vocabulary, k=rng.choice([1, 3, 7, 8, 9, 12, 20])) for _ in range(25)]
    docs = []
    for k in range(60):
        own = []
        for _ in range(rng.randrange(6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(max(1, len(line)))
                line[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [*line[at : at + 1], rng.choice(vocabulary)]])
            own.append(rng.choice(["", "", " ", "\t"]) + " ".join(line) + rng.choice(["", "  "]))
        docs.append((k, "\n".join(own)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "é ñ\r\né \t ñ")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("removed", F.lit(1)).repartition(4)
    got = {r.row.doc_id: (r.text, r.n_lines, r.n_exact, r.n_near) for r in lines.deduplicated(frame).collect()}
    want = brute(docs)
    assert got == want
    assert sum(w[3] for w in want.values()) > 5


def test_long_line_hot_lines_repeated_rows_and_null_ids(spark):
    long = " ".join(f"v{k}" for k in range(20_000))
    docs = [(k, f"same line in every document here is long\nnumber {k} of many that differ in one word only") for k in range(300)]
    docs += [(1000, long), (1001, long.replace("v777 ", "")), (1001, long.replace("v777 ", "")), (None, "alone"), (None, "alone")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.row.doc_id: r.text for r in lines.deduplicated(frame).collect()}
    assert got[0] == docs[0][1] and all(got[k] == "" for k in range(1, 300))
    assert got[1000] == long and got[1001] == "" and got[None] == "alone"
    assert lines.deduplicated(frame.limit(0)).collect() == []
    assert lines.deduplicated(frame).count() == len(docs)


def test_columns_are_built_in_functions_only(spark):
    plan = lines.deduplicated(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_words_that_occur_twice_make_no_common_keys(spark):
    rows = [(k, " ".join(f"v{k}x{j} v{k}x{j}" for j in range(5))) for k in range(1200)]
    frame = spark.createDataFrame(rows, "id long, line string").select("id", F.split("line", " ").alias("words"))
    frame = frame.withColumn("whole", lines.words_sum(F.col("words")))
    keys = frame.select("id", F.explode(lines.shorter_keys(F.col("words"), F.col("whole"))).alias("key"))
    assert keys.count() == 1200 * 5 and keys.select("key").distinct().count() == 1200 * 5
    less = frame.select(F.slice("words", 2, 9).alias("words"))
    wholes = less.select(F.xxhash64(F.size("words"), lines.words_sum(F.col("words"))).alias("key"))
    assert keys.join(wholes, "key").count() == 1200
