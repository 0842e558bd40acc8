"""The pipeline on a small corpus, stage by stage."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402


def prose(rng, n):
    return ". ".join(" ".join("".join(rng.choices("aeioulnrstdm", k=rng.randint(2, 8))) for _ in range(9)).capitalize() for _ in range(n)) + "."


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    clean = [prose(rng, 14) for _ in range(40)]
    near = clean[0].replace(clean[0].split()[5], "other", 1).split(". ")
    shared = prose(rng, 8)
    texts = [*clean, clean[1], ". ".join(near), *(prose(rng, 9) + "\n" + prose(rng, 1) + " " + shared + " " + prose(rng, 5) for _ in range(4)), *(" ".join(w + "###" for w in prose(rng, 14).split()) for _ in range(12)), "short", "", None]
    rows = [(k, t, "en", "s", len(t) if t else 0) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name.replace(" ", "-")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        assert docs.columns == columns and docs.filter(F.char_length("text") != F.col("n_chars")).count() == 0
        kept.append({r.doc_id: r.text for r in docs.collect()})
    quality, lines, near, passages = kept
    assert set(quality) == set(range(46))  # junk, short, empty and null texts go
    assert not {40, 41} & set(near) and set(range(40)) <= set(near)
    assert all(lines[k] == clean[k] for k in range(40))
    middle = shared[60:-60]
    assert sum(middle in t for t in near.values()) == 4 and not any(middle in t for t in passages.values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(passages)
    assert max(Counter(r.sequence_id for r in packed).values()) >= 1 and all(r.offset + r.length <= 2048 for r in packed)


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
