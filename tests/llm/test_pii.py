import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frondlake.llm import pii

BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"),
     lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(re.sub("[^0-9]", "", m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def brute(text):
    return [(k, *m.span()) for k, (_, pattern, ok) in enumerate(BASE) for m in pattern.finditer(text) if ok(m.group())]


@settings(max_examples=800, deadline=None)
@given(st.one_of(st.text(alphabet="a1.@+- ()59x%", max_size=60), st.text(max_size=40),
                 st.lists(st.sampled_from(["4111 1111 1111 1111", "1.2.3.4", "300.1.1.1", "a@b.co", "+49 (30) 1234567",
                                           ".", "5", "@", " ", "-", "é"]), max_size=12).map("".join)))
def test_base_equals_brute_force(text):
    assert sorted(pii.plain_spans(text)) == sorted(brute(text))


def spans(text):
    return [(pii.KINDS[k], text[s:e]) for k, s, e, b in pii.find_spans(text) if not b]


@pytest.mark.parametrize("text, want", [
    ("write to jane.doe (at) mail (dot) example (dot) com today", [("email", "jane.doe (at) mail (dot) example (dot) com")]),
    ("write to jane[at]example.com now", [("email", "jane[at]example.com")]),
    ("mail jane dot doe at example dot org please", [("email", "jane dot doe at example dot org")]),
    ("mail jаne@exаmple.com", [("email", "jаne@exаmple.com")]),
    ("ja​ne@exam​ple.com", [("email", "ja​ne@exam​ple.com")]),
    ("call plus four nine three zero one two three four five six seven", [
        ("phone", "plus four nine three zero one two three four five six seven")]),
    ("call five five five one two three four five ok", [("phone", "five five five one two three four five")]),
    ("host one nine two dot one six eight dot zero dot seven up", [("ip", "one nine two dot one six eight dot zero dot seven")]),
    ("card four one one one one one one one one one one one one one one one.", [
        ("card", "four one one one one one one one one one one one one one one one")]),
    ("４１１１１１１１１１１１１１１１", [("card", "４１１１１１１１１１１１１１１１")]),
    ("ip １０.0.0.1", [("ip", "１０.0.0.1")]),
])
def test_disguises(text, want):
    assert spans(text) == want


@pytest.mark.parametrize("text, want", [
    ("dns eight dot eight dot eight dot eight ok", [("ip", "eight dot eight dot eight dot eight")]),
    ("dns one [dot] one [dot] one [dot] one ok", [("ip", "one [dot] one [dot] one [dot] one")]),
    ("host 192[.]168[.]0[.]1 up", [("ip", "192[.]168[.]0[.]1")]),
    ("host 192[.]168[.]0[.]1 443 open", [("ip", "192[.]168[.]0[.]1")]),
    ("host 10 dot 0 dot 0 dot 7 up", [("ip", "10 dot 0 dot 0 dot 7")]),
    ("host 10\tdot\t0\tdot\t0\tdot\t7 up", [("ip", "10\tdot\t0\tdot\t0\tdot\t7")]),
    ("host 1 9 2 dot 1 6 8 dot 0 dot 1 up", [("ip", "1 9 2 dot 1 6 8 dot 0 dot 1")]),
    ("call +49 one five one 2345678 now", [("phone", "+49 one five one 2345678")]),
    ("call plus 49 151 234 5678 now", [("phone", "plus 49 151 234 5678")]),
    ("call +49 151 234567 one now", [("phone", "+49 151 234567 one")]),
    ("call five   five   five   one   two   three   four   five ok", [
        ("phone", "five   five   five   one   two   three   four   five")]),
    ("call five , five , five , one , two , three , four , five ok", [
        ("phone", "five , five , five , one , two , three , four , five")]),
    ("call 555 one 2 three 4 five 6 seven ok", [("phone", "555 one 2 three 4 five 6 seven")]),
    ("call fİve ſix one two three four five six ok", [("phone", "fİve ſix one two three four five six")]),
    ("mail jane\tdot\tdoe\tat\texample\tdot\torg please", [("email", "jane\tdot\tdoe\tat\texample\tdot\torg")]),
])
def test_all_that_the_transducers_accept(text, want):
    assert spans(text) == want


@pytest.mark.parametrize("text", ["one two plus three", "rows 1, 2, 3, 4", "+ 12, 34, 56, 78", "version 1.2 3.4 5.6", "5 - 6 - 7 - 8"])
def test_plain_numbers_stay_clean(text):
    assert pii.find_spans(text) == []


@pytest.mark.parametrize("text", [
    "arrive at example.com soon", "at the end of the dot com era we met", "one two three", "the (at) sign",
    "we sat at home. Dot was there", "Привет мир", "un deux trois soleil", "look at this dot. and that",
    "values 1 2 3 4 5 6", "", "   ", "@@@@", "+++++", "one of two at nine dot"])
def test_clean_texts_stay_clean(text):
    assert pii.find_spans(text) == []


def test_addresses_of_any_length():
    """Neither the parts of a name nor the labels of a domain are limited, and long chains take linear time."""
    for local in ("x" * 70, ".".join("abcdefghijkl"), " dot ".join("abcdefghijkl"), "ab" * 400 + ".c"):
        for domain in ("a.b.c.d.e.f.g.example(dot)com", "[dot]".join(f"label{i}" for i in range(300)) + "[dot]org", "example dot org"):
            text = f"write to: {local}{{at}}{domain} !"
            assert spans(text) == [("email", f"{local}{{at}}{domain}")]
    chain = "a dot " * 100_000
    assert pii.find_spans(chain + "b") == [] and pii.find_spans("a." * 200_000 + " [at] ") == []
    assert spans(chain + "b (at) example (dot) org") == [("email", chain + "b (at) example (dot) org")]
    assert len(pii.find_spans("me (at) example (dot) org, " * 5_000)) == 5_000


DISGUISES = {
    "email": ["jane.doe (at) example (dot) org", "jane [at] example.org", "jane{at}mail{dot}example{dot}org", "jane at example dot org",
              "jane arroba ejemplo punto es", "jane@example dot org", "jane＠example.org", "jаne@exаmple.org", "ja\u200bne@example.org"],
    "ip": ["10[.]0[.]0[.]7", "10 dot 0 dot 0 dot 7", "１０.0.0.7", "eight dot eight dot eight dot eight"],
    "phone": ["+４９ 151 2345678", "plus four nine one five one two three four five", "five five five one two three four five"],
    "card": ["４111 1111 1111 1111", "four one one one one one one one one one one one one one one one"],
}


def test_recall_of_planted_disguises():
    """Every planted disguise is found in running text, and the text around it stays clean."""
    found = {}
    for kind, forms in DISGUISES.items():
        for form in forms:
            text = f"Please note that we met there. {form} was given, and nothing more at all."
            hit = any(k == kind and f"{form}".startswith(t[:2]) for k, t in spans(text))
            found.setdefault(kind, []).append(hit)
    print({k: sum(v) / len(v) for k, v in found.items()})
    assert all(all(v) for v in found.values())


def test_spans_map_back_in_long_text():
    text = "ü​" * 500 + " jane (at) x (dot) com " + "é" * 300 + " 10.0.0.1"
    found = pii.find_spans(text)
    assert [(pii.KINDS[k], text[s:e]) for k, s, e, _ in found] == [("email", "jane (at) x (dot) com"), ("ip", "10.0.0.1")]


@pytest.mark.parametrize("run", ["a", "1", "1 ", "+1 ", "@", "a@", "1.", " at ", "one ", "(", "[ ", ".", "a.", "x dot "])
def test_linear_on_runs(run):
    pii.find_spans(run * 20_000)


def test_redaction_and_frames(spark):
    rows = [(1, "a@b.co and 1.2.3.4", 18, "x"), (2, None, None, "y"), (3, "", 0, None), (1, "a@b.co and 1.2.3.4", 18, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, pii string")
    out = pii.redact(docs, length="n_chars")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    assert got == sorted([(1, "[EMAIL] and [IP]", 16), (1, "[EMAIL] and [IP]", 16), (2, None, None), (3, "", 0)], key=str)
    found = {r.doc_id: len(r.pii) for r in pii.with_spans(docs).collect()}
    assert found == {1: 2, 2: 0, 3: 0}
    assert pii.with_spans(docs.limit(0)).count() == 0


def test_query(spark):
    from frondlake.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op10_pii"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for doc in docs:
        base = brute(doc.text)
        row = got[doc.doc_id]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(b[0] == k for b in base) for k in range(4)]
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(base))
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(row.spans.split(","))
