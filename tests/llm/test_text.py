"""License scan, URL filter and chats against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from recallspark.llm import chat_format, license_scan, url_filter
from tests.llm.rows import frame, odd_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def scanned(text):
    w = WORD.findall(lowered(text))
    at, labels = [], set()
    for phrase, label in license_scan.BASE_PHRASES:
        p = phrase.split()
        here = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_phrases_everywhere(spark):
    texts = odd_texts() + [(20, "MIT License."), (21, "the mit-license, Apache License (Version 2.0)"), (22, "Kit mit licenſe"),
                           (23, "cc by nc cc by nc"), (24, "mit\nLICENSE mit"), (25, "éMIT license"), (26, "mit license")]
    got = license_scan.scan_licenses(frame(spark, texts)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=key) == \
        sorted([(i, *scanned(t)) for i, t in texts], key=key)


def test_notices_with_changed_words(spark):
    texts = [(1, "Licensed under the Apache License, Version 2.0."), (2, "licensed under the old apache license version 2 0"),
             (3, "this work is Licensed under the GNU General Public License, version 3."), (4, "the license of the work"),
             (5, "licensed " + "x " * 60 + "under the apache " + "y " * 60 + "license version")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    assert [got[i].labels for i in range(1, 6)] == ["apache-2", "apache-2", "gpl-3", "", ""]
    assert got[1].score == 1 and 0.7 <= got[2].score < 1.01 and got[4].score == 0


def page(canonical=None, refresh=None):
    head = f'<link href="{canonical}" rel="canonical">' if canonical else ""
    return head + (f'<meta http-equiv="refresh" content="0; url={refresh}">' if refresh else "")


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "bad.com/"), ("allow", "bad.com/good/"), ("block", "com/de/")]


def test_longest_rule_and_aliases(spark):
    rows = [(1, "http://example.org/es/1", None), (2, "https://WWW.Example.org/en/1#x", None), (3, "http://a.net/x", page("http://bad.com/1")),
            (4, "http://a.net/y?q=1", page(None, "http://a.net/x")), (5, "http://bad.com/good/1", page("http://bad.com/2")),
            (6, "http://c.net/", page("http://bad.com/3")), (7, "http://d.net/", page("/es")), (8, "https://c.net/", None),
            (9, None, None), (10, "nothing", page("http://bad.com/4")), (11, "http://bad.com", None), (12, "http://e.net/", page("http://bad.com/5")),
            (13, "http://f.org/", page("http://e.net/")), (1, "http://example.org/es/1", None), (14, "http://notbad.com/x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'r' AS root", "'h' AS host", "'a' AS action")
    got = sorted((tuple(r) for r in url_filter.filter_urls(pages, url_filter.rule_table(spark, RULES)).collect()), key=str)
    found = {r[0]: r for r in got}
    assert len(got) == len(rows)
    assert found[1][3:] == ("example.org/es/", "block") and found[2][3:] == ("org/", "allow")
    assert found[3][3:] == (None, "block") and found[4][4] == "block"  # an alias of an alias
    assert found[5][3:] == ("bad.com/good/", "allow")  # an own allow comes first
    assert found[6][4] == found[8][4] == "block"  # the scheme makes no difference
    assert found[7][4] == "allow" and found[9][1:] == ("", "", None, "allow") and found[10][4] == "allow"
    assert found[11][3] is None and found[14][3] is None
    assert found[12][4] == "allow" and found[13][4] == "allow"  # an allowed alias outweighs a blocked one
    more = spark.createDataFrame([("http://d.net/", "http://bad.com/9")], "a string, b string")
    found = {r.page_id: r for r in url_filter.filter_urls(pages, url_filter.rule_table(spark, RULES), more).collect()}
    assert found[7].verdict == "block"


def test_relative_and_repeated_targets(spark):
    base = "http://a.net/x/y/page?k=1"
    cases = {"next.html": "a.net/x/y/next.html", "?p=2": "a.net/x/y/page?p=2", "../z?u#f": "a.net/x/z?u", "../../../up/..": "a.net/",
             "login?next=http://bad.com/1": "a.net/x/y/login?next=http://bad.com/1", "//b.net/q": "b.net/q", "/es": "a.net/es",
             "#top": "a.net/x/y/page?k=1", "mailto:x@bad.com": None, "HTTPS://B.net/./r": "b.net/./r", "./.": "a.net/x/y/"}
    rows = [(base, t, n) for t, n in cases.items()] + [("http://a.net", "next", "a.net/next"), ("nothing", "next", None)]
    found = spark.createDataFrame(rows, "url string, target string, want string").select(
        "target", "want", url_filter.node(url_filter.resolved(F.col("url"), F.col("target"))).alias("got")).collect()
    assert [(r.target, r.got) for r in found] == [(r.target, r.want) for r in found]
    pages = spark.createDataFrame([
        (1, "http://bad.com/d/1", page("http://a.net/1") + page("http://a.net/2", "http://a.net/3") + page(None, "http://a.net/4")),
        (2, "http://a.net/1", None), (3, "http://a.net/2", None), (4, "http://a.net/3", None), (5, "http://a.net/4", None),
        (6, "http://a.net/t/6", page("login?next=http://bad.com/1"))], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, url_filter.rule_table(spark, RULES)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow"}


def test_maximal_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"),
            (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"), (4, 0, "user", "a"), (4, 1, "assistant", "other"),
            (5, None, None, None), (None, 0, "user", "z"), (6, 0, "user", "a"), (6, 0, "user", "a"), (7, 0, "user", "q"), (7, 0, "user", "p"),
            *((8, i, "user", str(i)) for i in range(600)), *((9, i, "user", str(i)) for i in range(300))]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS id", "1 AS h1", "2 AS n", "'b' AS block")
    got = {(r.conv_id, r.part): r for r in chat_format.format_chats(chats).collect()}
    assert sorted({k[0] for k in got if k[0] is not None}) == [2, 4, 5, 7, 8] and (None, 0) in got
    assert got[2, 0].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert got[7, 0].rendered == "<|im_start|>user\np<|im_end|>\n<|im_start|>user\nq<|im_end|>\n"
    whole = "".join(got[8, p].rendered for p in range(3))
    assert whole == "".join(f"<|im_start|>user\n{i}<|im_end|>\n" for i in range(600)) and got[8, 0].n_turns == 600


def test_rows_of_a_null_id_are_cut(spark):
    rows = [(None, i % 9, "user", f"{i:04}") for i in range(900)] + [(1, 0, "user", "a"), (1, 1, "user", "b")] + [(2, None, "user", f"{i:03}") for i in range(250)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.part): r for r in chat_format.format_chats(chats, part_rows=100).collect()}
    line = lambda t: f"<|im_start|>user\n{t}<|im_end|>\n"
    assert sorted(p for i, p in got if i is None) == list(range(9)) and sorted(p for i, p in got if i == 2) == [0, 1, 2]
    assert max(r.rendered.count("<|im_start|>") for r in got.values()) == 100
    assert "".join(got[None, p].rendered for p in range(9)) == "".join(line(r[3]) for r in sorted(rows[:900], key=lambda r: (r[1], r[3])))
    assert "".join(got[2, p].rendered for p in range(3)) == "".join(line(r[3]) for r in rows[902:])
    assert got[1, 0].rendered == line("a") + line("b") and got[None, 0].n_turns == 900


@pytest.mark.parametrize("run", [
    lambda s: license_scan.scan_licenses(frame(s, [])),
    lambda s: url_filter.filter_urls(s.createDataFrame([], "page_id long, url string, html string"), url_filter.rule_table(s, RULES)),
    lambda s: chat_format.format_chats(s.createDataFrame([], "conv_id long, turn long, role string, text string"))])
def test_empty_tables(spark, run):
    assert run(spark).collect() == []
