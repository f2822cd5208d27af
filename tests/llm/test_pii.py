import hashlib
import random
import re

import pytest

from glyphmill.llm.pii import KINDS, find, redact

STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        s = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        return 12 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    spans = [(m.start(), i, m.end()) for i, k in enumerate(KINDS) for m in re.finditer(STATED[k], text or "") if good(k, m[0])]
    return ",".join(f"{KINDS[i]}:{a}:{b}" for a, i, b in sorted(spans))


def run(spark, rows):
    return find(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")).collect()


def test_base_equals_brute_force(spark):
    rng = random.Random(2)
    bits = ["a.b@c.de", "@", "x@y", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "007.1.2.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+1.....", "+12", " ", "\n", "é", "😀", "9", "-", ".", ",", "word", "79927398713", "4337166598464399"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(400)]
    texts += [None, "", "no digits", "7" * 50_000, "a" * 50_000 + "@", "1 " * 20_000, "a@b.cd " * 3000, "+1" + "." * 20_000, "+1 " * 5000]
    got = {r.doc_id: r for r in run(spark, list(enumerate(texts)))}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), repr(t)[:200]
        assert [got[i][f"n_{k}"] for k in KINDS] == [want.count(k + ":") for k in KINDS]
        assert set(want.split(",")) <= set(got[i].spans.split(","))


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"filler text number and more. write to user{i}@mail.example.com today please") for i in range(6)]
    rows += [(10, "somebody else said write to jane.doe7(at)example today please"), (11, "the 42 and the 17 are numbers"), (12, rows[0][1]), (12, rows[0][1])]
    got = {r.doc_id: r for r in run(spark, rows)}
    text = rows[6][1]
    at = text.index("jane")
    assert got[10].spans == f"email:{at}:{at + len('jane.doe7(at)example')}" and got[10].n_email == 0
    assert got[11].spans == ""
    assert got[10].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_one_copied_context_is_no_support(spark):
    rows = [(i, "please write to same@mail.example.com today") for i in range(9)] + [(20, "please write to jane7(at)example today")]
    assert {r.doc_id: r.spans for r in run(spark, rows)}[20] == ""


def test_any_word_in_a_slot_is_found(spark):
    rows = [(i, f"write to user{i}@mail.example.com today please") for i in range(6)] + [(10, "write to jane.doe(at)example today please")]
    assert {r.doc_id: r.spans for r in run(spark, rows)}[10] == "email:9:28"


def test_context_is_the_text_beside_other_tokens(spark):
    rows = [(i, f"ids 11x 22y user{i}@mail.example.com 33z") for i in range(6)] + [(10, "ids 11x 22y jane7(at)example 33z")]
    assert {r.doc_id: r.spans for r in run(spark, rows)}[10] == "email:12:28"


def test_rounds_go_on_until_nothing_is_new(spark):
    """Word k1 to k4 are only trusted once the instances found after the word before are labelled."""
    texts = [f"k{s} user{s}n{i}@mail.example.com" for s in range(5) for i in range(34)]
    hidden = [f"k{at} s{s}n{i}(at)x" for s in range(5) for i in range(6) for at in (s, s + 1) if at < 5]
    got = {r.doc_id: r.spans for r in run(spark, list(enumerate(texts + hidden)))}
    assert all(got[len(texts) + i] == f"email:3:{len(t)}" for i, t in enumerate(hidden))


def test_redact(spark):
    rows = [(1, "mail é@b c a@b.cd, ip 1.2.3.4.", "en", 5), (2, None, "en", None), (3, "clean", None, 5), (None, "+1 (743) 555-3824", "fr", 17), (3, "4111 1111 1111 1111 and +1.2.3.4 555 6666", "x", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").selectExpr("*", "lang as row", "1 as cuts", "lang as _row", "2 as _CUTS")
    out = redact(table)
    assert out.columns == table.columns
    got = sorted((tuple(r)[:4] for r in out.collect()), key=str)
    assert all(r.row == r.lang == r._row and r.cuts == 1 and r._CUTS == 2 for r in out.collect())
    assert (1, "mail é@b c [EMAIL], ip [IP].", "en", len("mail é@b c [EMAIL], ip [IP].")) in got
    assert (2, None, "en", None) in got and (3, "clean", None, 5) in got and (None, "[PHONE]", "fr", 7) in got
    assert any(r[1] and r[1].startswith("[CARD] and [PHONE]") for r in got) and len(got) == 5


@pytest.mark.parametrize("f", [find, redact])
def test_empty(spark, f):
    assert f(spark.createDataFrame([], "doc_id long, text string")).count() == 0
