"""The pipeline on a small corpus with known junk, shared lines, copies and near-copies."""

import random

import corpus_pipeline
import __spark_entry__ as entry
from tests.llm.test_text_operators import plain_counts, prose

SHARED = "this boilerplate line stands in many of the documents, word for word"


def corpus():
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(200):
        text = "\n".join(prose(rng, 40) for _ in range(3))
        if i % 5 == 0:
            text = " ".join(w + "$$$" for w in text.split())
        elif i % 7 == 1:
            text += "\n" + SHARED
        docs.append((i, text))
        labels.append((i, 0 if i % 5 == 0 else 1, 0))
    words = docs[2][1].split(" ")
    words[30] = "changed"
    docs += [(200, docs[3][1]), (201, " ".join(words)), (202, "too short"), (203, None), (204, "a b c d e f g h i j " * 9)]
    return docs, labels


def test_pipeline(spark, tmp_path):
    docs, labels = corpus()
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "more") for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, score string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = frame, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == frame.columns, name
        kept.append({r.doc_id: r for r in now.collect()})
    good = {i for i, t in docs if i < 200 and i % 5}
    assert good <= set(kept[0]) and not {i for i in kept[0] if i < 200 and i % 5 == 0}
    assert good | {200, 201} == set(kept[1])  # the short, the null and the repetitive text fail the base rules
    assert all(plain_counts(r.text)[0] >= 10 for r in kept[1].values())
    holders = sorted(i for i in kept[1] if SHARED in kept[1][i].text)
    assert set(kept[2]) == set(kept[1]) and [i for i in kept[2] if SHARED in kept[2][i].text] == holders[-1:]
    assert all(r.n_chars == len(r.text) for r in kept[2].values())
    assert set(kept[3]) == set(kept[2]) - {200, 201}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(pieces.doc_id) == set(kept[3])
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.max()).all()
    assert "pipeline" in entry.queries() and len([q for q in entry.queries() if q.startswith("op")]) == 13


KIND = "doc_id long, text string, lang string, source string, n_chars long, line_dedup string, keeper int"


def staged(spark, folder, rows, labels):
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "more", 1) for i, t in rows], KIND)
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    now, kept = frame, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(folder))
        assert now.columns == frame.columns, name
        path = f"{folder}/after-{len(kept)}"
        now.write.parquet(path)
        now = spark.read.parquet(path)
        kept.append(sorted((r.doc_id, r.text) for r in now.collect()))
    return kept, corpus_pipeline.pack(spark, now, str(folder)).collect()


def test_stages_with_clashing_columns_repeated_rows_and_a_long_text(spark, tmp_path):
    docs, labels = corpus()
    long = "\n".join(prose(random.Random(i), 40) for i in range(1000, 1150))
    rows = [*docs[:100], docs[8], docs[8], (300, long), (301, "")]
    kept, pieces = staged(spark, tmp_path, rows, labels)
    assert [sum(i == 8 for i, _ in k) for k in kept] == [3, 3, 3, 3]  # rows of one document stay or go together
    assert all(sum(i == 300 for i, _ in k) == 1 for k in kept)
    whole = [r for r in pieces if r.doc_id == 300]
    assert sum(r.length for r in whole) == whole[0].doc_tokens > 2048


def test_stages_of_an_empty_table(spark, tmp_path):
    kept, pieces = staged(spark, tmp_path, [], [])
    assert kept == [[], [], [], []] and pieces == []
