"""Column functions and parsers against plain Python."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.functions import parsers
from corvane.functions import text as ft
from corvane.operators.items import convert, flat_metadata


def column(spark, values, f, kind="string"):
    from pyspark.sql import functions as F

    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f(F.col("v"))).collect()]


def test_cap(spark):
    assert column(spark, ["abc", "abcd", "ab  cd", None, "ééééé"], lambda c: ft.cap(c, 3)) == ["abc", "ab…", "ab…", "", "éé…"]


def test_document_of(spark):
    assert column(spark, ["x_m0001", "x_e07", "x_c1_c2", "x_m", "x_m1\r", None], ft.document_of) == ["x", "x", "x_c1", "x_m", "x_m1\r", ""]


CASES = ["a\\nb\\nc\\nd", "a\\nb", "a\\\\nb\\\\nc\\\\nd\\\\te", "l1\nl2\nl3\nl4\\nl5\\nl6\\nl7", "x\\r\\ny\\r\\nz\\n\\t", ""]


def test_unescape(spark):
    assert column(spark, CASES, ft.unescape) == [parsers.real_breaks(c) for c in CASES]
    assert parsers.real_breaks(CASES[0]) == "a\nb\nc\nd" and parsers.real_breaks(CASES[1]) == CASES[1]


def test_lists_addresses_hints(spark):
    assert column(spark, [" a@b , ,c@d\t,", None], ft.listed) == [["a@b", "c@d"], []]
    assert column(spark, ["HTTPS://Ex.org/A/?q#f", "ex.org/", "http://x//"], ft.endpoint) == ["https://ex.org/a", "https://ex.org", "http://x"]
    assert column(spark, ["Retry in 7 seconds", "no"], ft.retry_seconds) == [7, None]
    assert [tuple(r) for r in column(spark, ["confluence", "new"], ft.kind_of)] == [("knowledge_base", "notion"), ("custom", "new")]
    assert column(spark, [ft.THREAD_EPOCH + 45], ft.iso, "long") == ["2025-01-01T00:00:45Z"]
    assert column(spark, ["a title_field_name b", "clean"], ft.leaks) == [True, False]
    assert [len(x) for x in column(spark, ["From: a\n\nhi\n\nFrom: b\n\nyo", "From: a\n---\nFrom: b"], ft.email_blocks)] == [2, 2]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["Ann: hi", "Bob (Ops): yes", "", "```", "note: x", "plain", "Ann: again"]), max_size=14))
def test_chat_keeps_every_line_after_the_first_speaker(lines):
    got = parsers.chat("\n".join(lines))
    body = "\n".join(m["body"] for m in got)
    assert all(m["author"] in ("Ann", "Bob (Ops)") for m in got)
    assert sum(len(re.findall("plain", m["body"])) for m in got) <= lines.count("plain") and "\n\n\n\n\n\n\n\n\n\n\n\n\n\n" not in body


def test_chat():
    got = parsers.chat("dropped\n\nAnn Lee: one\nnote: not a speaker\n```\nBob: code\n```\n\nBob: two\nAnn Lee: three")
    assert [(m["author"], len(m["code_blocks"])) for m in got] == [("Ann Lee", 1), ("Bob", 0), ("Ann Lee", 0)]
    assert [m["author"] for m in parsers.chat("A: 1\nB: 2\nC: 3\nplain")] == ["A", "B", "C"]


def test_mail():
    text = "From: a@x\nTo: b@x, c@x\nSubject: Hi\nDate: Tue, 10 Jun 2025 09:12:00 +0200\n\nbody\n\nFrom: b@x\n\nreply"
    got = parsers.mail(text)
    assert [m["headers"].get("From") for m in got] == ["a@x", "b@x"] and got[1]["body"] == "reply"
    assert parsers.mail_date(got[0]["headers"]["Date"]) == "2025-06-10T09:12:00+02:00"
    assert parsers.mail_date("Tue, Jun 3, 2025 at 9:12 AM") == "2025-06-03T09:12:00"
    assert parsers.mail_date("soon") is None and parsers.mail_date(None) is None
    assert len(parsers.mail(repr([text, "no header"]))) == 3
    assert parsers.mail("no header")[0] == {"headers": {}, "body": "no header"}


def test_ticket():
    text = "Broken.\ncomments:\n2025-01-08 - Maya Chen: first\nmore\nQuestion: inside\nAva Chen: second\nbuild-bot (CI): third\nJo Day (Support) 2026-03-12T16:18:00Z: fourth\nXi Yu: \nrelease_notes:\ntail"
    description, comments = parsers.ticket(text)
    assert description == "Broken.\n\nrelease_notes:\ntail"
    assert [(c["author"], c["date"]) for c in comments] == [("Maya Chen", "2025-01-08"), ("Ava Chen", None), ("Jo Day (Support", "2026-03-12")]
    assert comments[0]["body"] == "first\nmore\nQuestion: inside" and "build-bot" in comments[1]["body"]
    assert parsers.ticket("plain") == ("plain", [])


def test_revisions_and_sections():
    text = "# Revision history\n- 2025/01/02 (Ann): made\n- 2025-02-03: fixed\n## Audit history\n## Changelog\nnothing"
    assert parsers.revisions(text) == [{"date": "2025-01-02", "note": "Ann: made"}, {"date": "2025-02-03", "note": "fixed"}]
    assert parsers.sections("intro\nkey points:\na\nnext steps:\nb") == {"body": "intro", "key_points": "a", "next_steps": "b"}
    assert parsers.sections("all") == {"body": "all"}


def test_convert():
    assert convert("d", "slack", "t", " \n") == []
    chat = convert("d", "slack", "general", "Ann: a\n\nBob: b")
    assert [i["id"] for i in chat] == ["d_m0000", "d_m0001"] and '"parent_id": "d_m0000"' in chat[1]["fields"]
    mails = convert("d", "gmail", "t", "From: a\n\nx\n\nFrom: b\n\ny")
    assert [i["id"] for i in mails] == ["d_e00", "d_e01"] and '"in_reply_to": "d_e00"' in mails[1]["fields"] and "in_reply_to" not in mails[0]["fields"]
    assert [i["id"] for i in convert("d", "gmail", "t", "only body")] == ["d"]
    ticket = convert("d", "jira", "t", "x\ncomments:\nAva Chen: one")
    assert [(i["id"], i["kind"]) for i in ticket] == [("d", "ticket"), ("d_c00", "comment")]
    page = convert("d", "confluence", "t", "Change log\n2025-03-04: note")
    assert page[0]["timestamp"] == "2025-03-04T00:00:00Z" and '"revision_count": 1' in page[0]["metadata"]
    assert "revision" not in convert("d", "fireflies", "t", "Change log\n2025-03-04: note")[0]["metadata"]
    assert len(convert("d", "jira", "t" * 3000, "x")[0]["title"]) == 1000


@pytest.mark.parametrize(("meta", "want"), [({"a": 1, "b": [{"d": "x", "n": None, "m": 2}, "y"]}, {"a": 1, "b": ["x: 2", "y"]}), ({"a": {"b": [1]}}, {"a": '{"b": [1]}'})])
def test_flat_metadata(meta, want):
    assert flat_metadata(meta) == want
