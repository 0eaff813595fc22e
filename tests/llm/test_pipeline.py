"""The pipeline on planted cases: what each stage must catch and what it must leave alone."""

import random

import corpus_pipeline
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choices(["the", "ing", "er", "wo", "al"], k=3)) + str(rng.randrange(900)) for _ in range(n))
    passage = text(80)
    rows = [(d, text(150)) for d in range(40)]
    rows += [(100, rows[3][1]), (101, rows[4][1] + " one more"), (102, text(200) + " " + passage), (103, passage + " " + text(200)), (104, None), (105, "1 2 3")]
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 2}", len(t or "")) for d, t in rows], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    table = docs
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, str(tmp_path))
        out = f"{tmp_path}/{name}"
        table.write.parquet(out)
        table = spark.read.parquet(out)
        seen[name] = table
        if name != "packed":
            assert table.columns == docs.columns
    ids = lambda n: {r.doc_id for r in seen[n].select("doc_id").collect()}
    assert ids("language") == {d for d, _ in rows} - {104, 105}
    assert ids("near_duplicates") == ids("language") - {100, 101}
    assert ids("repeated_passages") == ids("near_duplicates")
    kept = {r.doc_id: r.text for r in seen["repeated_passages"].collect()}
    assert passage in kept[102] and passage not in kept[103] and kept[5] == rows[5][1]
    mixed = sum(len(brute.WORD.findall(r.text)) for r in seen["mixed"].collect())
    whole = sum(len(brute.WORD.findall(t)) for t in kept.values())
    assert abs(mixed - whole) <= 2
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packed"].count()


def test_awkward_tables_through_the_pipeline(spark, tmp_path):
    schema = DOCS + ", row string, score string, position string"
    text = "the words of the other thing are there to be thought of by the others " * 20
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text, None, None, None), (None, None, None, None, None), (2, "", "en", "", 0), (3, "Ein ganz anderer Text, der nicht englisch ist, sondern deutsch und kurz", "de", "b", 1)]
    for name, data in (("none", []), ("few", rows)):
        spark.createDataFrame([(*r, "?", "?", "?") for r in data], schema).write.parquet(str(tmp_path / name / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
    out = corpus_pipeline.run(spark, str(tmp_path / "few")).collect()
    assert {r.doc_id for r in out} <= {1, 3} and 1 in {r.doc_id for r in out}
    assert [r.sequence_id for r in sorted(out, key=lambda r: r.position)] == sorted(r.sequence_id for r in out)
