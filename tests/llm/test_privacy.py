"""Personal data: plain spans against the bare patterns, disguised ones against their source text."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtone.llm import privacy

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(n):
    odd, even = n[-1::-2], n[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def plain(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        n = re.sub("[^0-9]", "", m.group())
        if 12 <= len(n) <= 19 and luhn(n):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["@", ".", "a", "b-c", "+", "1", "22", "255", "300", "0", " ", "-", "(", ")", "4242 4242 4242 4242", "+1 (555) 010-9999",
                                 "x@y.zz", "10.0.0.1", "é", "１", "\n", "%", "_"]), max_size=14).map("".join))
def test_plain_spans(text):
    assert privacy.identifiers(text) == plain(text)
    found = privacy.all_spans(text)
    assert [s[:3] for s in found if not s[3]] == plain(text)
    assert all(0 <= a < b <= len(text) for a, _, b, _ in found)


@pytest.mark.parametrize("source, kind", [
    ("jane.doe [at] example [dot] com", "email"), ("jane.doe(at)example(dot)co(dot)uk", "email"), ("jane_doe at example dot com", "email"),
    ("jane AT example DOT org", "email"), ("jane @ example.com", "email"), ("jane [at] example.com", "email"), ("jаne@exаmple.com", "email"),
    ("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email"), ("jane​@example.com", "email"), ("hans {at} beispiel {punkt} de", "email"),
    ("１９２.１６８.１.１", "ip"), ("one nine two dot one six eight dot one dot one", "ip"), ("10[.]0[.]0[.]1", "ip"),
    ("plus four nine three zero one two three four five six", "phone"), ("＋49 30 1234567", "phone"), ("+1 (５５５) 010-9999", "phone"),
    ("four two four two four two four two four two four two four two four two", "card"), ("4242‑4242‑4242‑4242", "card"),
    ("vier zwei vier zwei vier zwei vier zwei vier zwei vier zwei vier zwei vier zwei", "card")])
def test_disguises_map_back_to_their_source(source, kind):
    for before, after in (("", ""), ("Call é me: ", ", thanks — today"), ("ß\n", "\nok")):
        text = before + source + after
        found = [s for s in privacy.all_spans(text) if privacy.KINDS[s[1]] == kind]
        assert [(text[a:b]) for a, _, b, _ in found] == [source]


@pytest.mark.parametrize("source, kind", [
    ("10 [ . ] 0 [ . ] 0 [ . ] 1", "ip"), ("jo\tat\tsite\tdot\tcom", "email"), ("jo (\tat\t) site ( . ) com", "email"), ("jo\u00a0at\u00a0site\u00a0dot\u00a0com", "email"),
    ("jo {\n@ } site < . > com", "email"), ("10 dot\t0\u2003dot 0\tdot\t1", "ip")])
def test_blanks_of_any_kind_inside_disguises(source, kind):
    assert [(privacy.KINDS[k], source[a:b]) for a, k, b, _ in privacy.all_spans(source) if privacy.KINDS[k] == kind] == [(kind, source)]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["jo", "1", "AT", "at", "dot", "Punkt", ".", "@", "(", "]", "<", "{", " ", "\t", "\n", "\u2003"]), max_size=14).map("".join))
def test_the_hint_is_needed_by_every_sign(text):
    assert privacy._SIGN_HINT.search(text) or not privacy._SIGNS.search(text)


@pytest.mark.parametrize("text", ["Look at this. Dot com era", "one two three", "we met at noon dot", "five at a time. Then six", "the and attion at ounre dotted"])
def test_prose_is_left_alone(text):
    assert privacy.all_spans(text) == []


def test_rows(spark):
    rows = [(1, None), (2, ""), (2, "a@b.cc"), (2, "a@b.cc"), (None, "mail a@b.cc, ip 1.2.3.4"), (3, "x" * 300_000 + "@" + "9" * 300_000 + " a@b.cc"),
            (4, "1." * 100_000), (5, "+1" + "(" * 200_000)]
    loops = spark.createDataFrame(rows, "file_id bigint, report string").selectExpr("*", "1 spans", "2 plain")
    got = privacy.personal_data(loops).select("file_id", privacy.span_text(privacy.F.col("spans")).alias("s")).collect()
    expected = [(i, ",".join(f"{privacy.KINDS[k]}:{a}:{b}" for a, k, b, _ in privacy.all_spans(t or ""))) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    clean = {r.file_id: r.c for r in loops.where("file_id is null or file_id = 1").select("file_id", privacy.redact(privacy.F.col("report")).alias("c")).collect()}
    assert clean == {None: "mail <EMAIL>, ip <IP>", 1: None}
    assert privacy.personal_data(loops.limit(0)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = privacy.personal_data(docs, "doc_id", "text").collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        assert [(s.start, privacy.KINDS.index(s.kind), s.stop) for s in r.spans if not s.added] == plain(text[r.doc_id])
