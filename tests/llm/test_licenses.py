from glyphmill.llm import licenses
import duckdb
import pytest

from glyphmill.llm.licenses import KNOWN, _MIT, scan, sql

TEXTS = [
    (1, _MIT), (2, "Copyright (c) 2020 Somebody\nAll rights reserved.\n\nMIT Licence\n\n" + _MIT.upper().replace("\n\n", "\n \n")), (3, _MIT + " And one more."), (4, "Licensed under the Apache Licence, version 2.0\nSome prose follows."),
    (5, "prose\n\n* Released  under the\tMIT license! *\nmore"), (6, None), (7, ""), (8, "no such thing"), (9, "I give permission."), (9, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (None, "SPDX-License-Identifier: MIT"), (10, "x " * 50_000 + "license"),
]


def test_scan(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, license string")
    rows = scan(df).collect()
    assert len(rows) == len(TEXTS)
    got = {(r.doc_id, r.notices): r for r in rows}
    by = {r.doc_id: r for r in rows}
    assert by[1].license == by[2].license == "MIT" and by[3].license is None and by[8].notices == by[6].notices == "" and by[6].text_sha256 == by[7].text_sha256
    assert by[4].notices == "Apache-2.0" and by[4].license is None and by[5].notices == "MIT" and by[9].doc_id == 9 and (9, "CC-BY-NC-4.0,MIT") in got
    assert by[None].license == "MIT"
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", TEXTS)
    assert sorted(con.execute(sql()).fetchall(), key=str) == sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("name,text", KNOWN)
def test_known_texts_are_hinted(name, text):
    import re

    assert re.search("(?i)" + licenses.HINT, text)


def test_empty(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_licence_alone_and_inside(spark):
    rows, want = [], []
    for name, text, (start, mark) in licenses.TEXTS:
        changed = "Copyright (c) 1999 Someone Else\n\n" + text.upper().replace("LICENSE", "LICENCE").replace("(C)", "\u00a9")
        rows += [(len(rows), text), (len(rows) + 1, changed), (len(rows) + 2, f"# file.c: some code\n\n{text}\n\nint main(void);")]
        want += [name, name, None]
    got = sorted(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [r.license for r in got] == want
    for k, (_, _, (_, mark)) in enumerate(licenses.TEXTS):
        assert mark in got[3 * k + 2].notices.split(",")


def test_folder_of_texts(spark, tmp_path):
    (tmp_path / "House-1.txt").write_text("House License\n\nAll may read; none may shout.\n" * 40)
    docs = spark.createDataFrame([(1, "HOUSE LICENCE. All may read, none may shout " * 40), (2, "House License")], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.scan(docs, licenses.from_folder(spark, str(tmp_path))).collect()} == {1: "House-1", 2: None}
