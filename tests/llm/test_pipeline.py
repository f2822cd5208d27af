import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORDS = {"en": "the of and with from that this house river green walk over under bright morning".split(), "de": "der die und nicht über grün haus fluß gehen unter hell morgen straße schön".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice("abcdefgh") * rng.randrange(3) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(6)
    rows = [(i, prose(rng, "de" if i % 3 == 0 else "en", rng.randrange(30, 120)), "de" if i % 3 == 0 else "en", "s", 1) for i in range(60)]
    rows += [(100, rows[0][1], "de", "s", 1), (101, rows[1][1] + " end", "en", "s", 1), (102, "123 456 !!!", "en", "s", 1), (103, None, "en", "s", None)]
    rows += [(104, "BUY!! " * 60, "en", "s", 1), (105, " ".join("w%d###$$$" % k for k in range(60)), "en", "s", 1), (106, "write to me@mail.example.com " + prose(rng, "en", 60), "en", "s", 1), (2, rows[2][1], "en", "s", 1)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_stages(spark, table):
    path, rows = table
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
        assert docs.columns == columns
        seen[name] = sorted(r.doc_id for r in docs.collect())
    assert not {102, 103} & set(seen["language_id"]) and len(seen["language_id"]) == len(rows) - 2
    assert not {104, 105} & set(seen["quality_rules"]) and set(range(60)) <= set(seen["quality_rules"])
    assert seen["near_dedup"] == sorted([*range(60), 106]) == seen["personal_data"]
    text = {r.doc_id: r.text for r in docs.collect()}
    assert text[106].startswith("write to [EMAIL] ") and text[5] == rows[5][1]
    packed = corpus_pipeline.packing(spark, docs, path).collect()
    assert {r.doc_id for r in packed} == set(text)


def test_run(spark, table):
    path, _ = table
    got = corpus_pipeline.run(spark, path)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {*range(60), 106}
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert re.fullmatch("[a-z_]+", corpus_pipeline.STAGES[0][0])
