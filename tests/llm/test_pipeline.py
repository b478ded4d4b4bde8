"""The pipeline's stages on their own inputs."""

import random

import corpus_pipeline
from llm_rows import ODD
from strandwork.llm import queries

import __spark_entry__


def test_stages(spark, make, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    bench = [text(30) + "." for _ in range(4)]
    rows, toxic = [], set()
    for i in range(240):
        t = text(80)
        if i % 6 == 0:
            t += " you idiot moron scum trash worthless"
            toxic.add(i)
        rows.append((i, t))
    near = rows[1][1].split()
    near[40] = "zzz"
    rows += [(300, " ".join(near)), (301, rows[2][1]), (302, text(40) + " " + bench[0] + " " + text(10)), (303, text(60) + " token = abcdefghijkl0123 end")] + [(400 + i, t) for i, (_, t) in enumerate(ODD)]
    docs = make(rows).select("doc_id", "text", "lang", "source", "n_chars")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    kept = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, kept, d)
        kept.write.parquet(f"{d}/{k}")
        kept = spark.read.parquet(f"{d}/{k}")
        seen[name] = {r.doc_id: r for r in kept.collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert kept.columns == docs.columns
    assert not toxic & set(seen["toxicity"]) and len(seen["toxicity"]) == len(rows) - len(toxic)
    assert {300, 301} & set(seen["near_copies"]) == set() and {1, 2, 303} <= set(seen["near_copies"])
    assert set(seen["near_copies"]) - set(seen["decontamination"]) == {302}
    assert set(seen["secrets"]) == set(seen["decontamination"]) and "[SECRET]" in seen["secrets"][303].text and "abcdefghijkl0123" not in seen["secrets"][303].text
    assert set(seen["packing"]) == set(seen["secrets"])
    assert corpus_pipeline.run(spark, d).count() == spark.read.parquet(f"{d}/{len(corpus_pipeline.STAGES) - 1}").count()


def test_empty_documents_and_rows_without_ids(spark, make, none, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    bench = "the only benchmark item that there is in this small table of one row"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    none.select(*columns).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    plain = "some words that no other document in this corpus has at all"
    rows = [(None, bench), (None, plain), (None, plain), (5, "first text of a shared id"), (5, "second text, of the same id"), (None, "token = abcdefghijkl0123")]
    make(rows).select(*columns).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.piece) for r in got) == [(0, 0), (0, 0), (5, 0), (5, 0)]


def test_registered():
    names = __spark_entry__.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11)) and "pipeline" in names
    assert set(queries.QUERIES) <= set(names)
