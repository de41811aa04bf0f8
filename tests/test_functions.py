import re
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrykit.functions import citations, dates, markup, parsing, prompts, routing, text


def apply(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_markup(spark):
    cases = {
        "'''Bold''' and ''it''": "Bold and it", "[[Link]] [[A|shown]]": "Link shown", "[[Category:X]]y": "y", "[[file:a.png|t]]z": "z", "{{a {{b}} c}}d": "d",
        "a<ref name=x>cite</ref>b<ref name=y />c": "abc", "<b>kept</b>": "kept", "== Head ==\ntext": "Head\ntext", "[https://e.org shown] [https://e.org]": "shown", "": "", "plain": "plain",
        "<!-- a\nb -->c": "c", "* item\n# two\n: three\n; four": "item\ntwo\nthree\nfour", "a\n\n\n\nb  c": "a\n\nb c", "__TOC__x": "x", "{| t\n|}y": "y",
    }
    assert apply(spark, [*cases, None], text.strip_wiki_markup) == [*cases.values(), ""]


def test_dates(spark):
    cases = [
        ("2024-03-15", "2024-03-15", "day", False), ("2024-3-5", "2024-03-05", "day", False), ("03/15/2024", "2024-03-15", "day", False), ("15/03/2024", "2024-03-15", "day", False), ("March 15, 44 BC", "-0044-03-15", "day", False),
        ("15 March 2024", "2024-03-15", "day", False), ("March 2024", "2024-03", "month", False), ("Sept 1900", "1900-09", "month", False), ("476", "0476", "year", False), ("753 BCE", "-0753", "year", False), ("AD 79", "0079", "year", False),
        ("circa 1800", "1800", "year", True), ("ca. 1200", "1200", "year", True), ("~500", "0500", "year", True), ("1800s", "1800", "decade", False), ("1st May 1900", "1900-05-01", "day", False), ("1914–1918", None, None, False), ("", None, None, False), ("no date", None, None, False),
    ]
    for (raw, iso, precision, approximate), d in zip(cases, apply(spark, [c[0] for c in cases], dates.normalize_date), strict=True):
        assert (d["iso"], d["precision"], d["approximate"]) == (iso, precision, approximate), raw
        assert (d["error"] is None) == (iso is not None)
        assert (d["era"] is None) == (raw == "")


def test_routes(spark):
    cases = {"2 + 2": "math", "solve this": "math", "latest news": "web_research", "history of Rome": "timeline_research", "what is 5 and 6": "math", "who was he": "local_rag", "tell me": "ambiguous", "When was X?": "ambiguous", "several ways": "timeline_research"}
    assert apply(spark, list(cases), lambda c: routing.heuristic_route(c)[0]) == list(cases.values())
    assert apply(spark, ['"Math".\nx', "other", None], lambda c: routing.parse_route_label(c)[0]) == ["math", "local_rag", "local_rag"]


def test_sub_questions(spark):
    cases = ["SINGLE", "single.", '["a","b"]', '```json\n["a", " b "]\n```', '["a"]', "", "[1, 2]", '["a","","b"]', "nonsense", '["1","2","3","4","5","6"]']
    assert apply(spark, cases, parsing.parse_sub_questions) == [None, None, ["a", "b"], ["a", "b"], None, None, None, ["a", "b"], None, list("12345")]


def test_timeline(spark):
    good = '[{"date": "1", "event": "e", "supporting_chunk_ids": ["a", "z"]}, 5, {"date": "2"}, {"date": "3", "event": "f"},]'
    make = lambda c: F.struct(*(x.alias(n) for x, n in zip(parsing.parse_timeline(c, F.array(F.lit("a"))), ("items", "error"), strict=True)))
    a, b, c, d = apply(spark, [good, "", "bad", "{}"], make)
    assert [(x["date"], x["supporting_chunk_ids"]) for x in a["items"]] == [("1", ["a"]), ("3", [])]
    assert b["items"] == [] and b["error"] is None
    assert c["error"] and d["error"]


def test_citations(spark):
    kind = "array<struct<chunk_id:string,title:string,section:string,text:string>>"
    opened = [("2", "B", None, "x" * 200), ("abc", None, "s", "short")]
    rows = spark.createDataFrame([("[abc] then [2][abc] and [1] [zz]", opened), ("none", opened), ("", [])], f"a string, o {kind}")
    got = rows.select(*(c.alias(n) for c, n in zip(citations.numberize(F.col("a"), F.col("o")), ("text", "map"), strict=True))).collect()
    assert got[0]["text"] == "[1] then [2][1] and [1] [zz]"
    assert [(m["number"], m["chunk_id"], m["title"]) for m in got[0]["map"]] == [(1, "abc", "Untitled"), (2, "2", "B")]
    assert got[0]["map"][1]["snippet"] == "x" * 150 + "…"
    assert got[1]["text"] == "none" and got[1]["map"] == [] and got[2]["text"] == ""
    ids = F.array(F.lit("abc"), F.lit("d"))
    v = apply(spark, ["p [abc]\n\nq\n\nr\n\ns [no]"], lambda c: citations.validate(c, ids, citations.STRICT))[0]
    assert not v["valid"] and v["cited_ids"] == ["abc"] and v["hallucinated_ids"] == ["no"] and v["uncited_opened_ids"] == ["d"]
    assert (v["paragraph_count"], v["paragraphs_with_citations"], len(v["errors"]), len(v["warnings"])) == (4, 1, 2, 1)
    assert apply(spark, ["abcd"], lambda c: citations.extract_citations(c, F.array(F.lit("abc"), F.lit("")))) == [["abc"]]


def test_snippets_and_tokens(spark):
    assert apply(spark, ["a\nb", None], text.snippet) == ["a b", None]
    words = "word " * 40
    assert apply(spark, [words, "short", None], text.citation_snippet) == [words[:149] .rsplit(" ", 1)[0] + "…", "short", ""]
    assert apply(spark, ["", None, "ab", "a" * 9], text.estimate_tokens) == [0, 0, 1, 2]


def test_prompt_template(spark):
    rows = spark.createDataFrame([("q",)], "question string")
    assert prompts.build_prompts(rows, "Q: {question}!", "top").first()["prompt"] == "top\n\nQ: q!"
    with pytest.raises(ValueError, match="missing"):
        prompts.build_prompts(rows, "{absent}")


def test_html(spark):
    page = "<html><head><title>T &amp; U</title><style>p{}</style></head><body><nav>n</nav><!-- c --><p>One<p>Two</p><script>x</script><footer>f</footer></body></html>"
    assert apply(spark, [page, "", None], text.extract_html_text) == ["T & U\nOne\nTwo", "", ""]
    rare = ["<p>a &eacute; &#233; &lt;</p>"]
    assert apply(spark, rare, text.extract_html_text) == ["a é é <"]


class Plain(HTMLParser):
    """The standard library's parser with a stack of open elements."""

    def __init__(self):
        super().__init__()
        self.stack, self.nodes = [], [""]

    def cut(self):
        self.nodes.append("")

    def handle_starttag(self, tag, attrs):
        self.cut()
        if tag not in markup.VOID:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.cut()

    def handle_endtag(self, tag):
        self.cut()
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if not {*self.stack} & {*markup.DROPPED, *markup.HIDDEN}:
            self.nodes[-1] += data

    handle_comment = handle_decl = handle_pi = lambda self, data: self.cut()


def parsed(page):
    plain = Plain()
    plain.feed(page)
    plain.close()
    text = "\n".join(n.strip() for n in plain.nodes if n.strip())
    return re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", text)).strip()


PIECES = [
    "<p>", "</p>", "<nav>", "</nav>", "<NAV class='a>b'>", "<div title=\"x > y\" hidden>", "</div>", "<br>", "<img src=a>", "<br/>", "<span/>", "<aside>", "</aside>", "<form action='/a?b=1&c=2'>", "</form >",
    "<script>var q = 1; <p>t</p> </nav></script>", "<style>p > a {}</style>", "<!-- <nav> -->", "<!---->", "<!DOCTYPE html>", "<template>", "</template>", "<h1 id=x>", "</h1>", "</b>", "a", "b  c", " ", "\n", "&nbsp;",
    "&amp;nbsp;", "&#233;", "&eacute;", "1 < 2", "x&y", "é",
]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_html_equals_the_parser(page):
    assert markup.visible_text(page, 10**6) == parsed(page)


def test_html_of_given_pages_and_odd_ones(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    assert all(markup.visible_text(p, 10**6) == parsed(p) for p in pages)
    odd = "<p>a</p><td>&nbsp;</td><p>&nbsp;b</p><nav>x<nav>y</nav>z</nav><script>var q=1; <p>t</p>"
    assert markup.visible_text(odd) == "a\nb"
    assert markup.visible_text("<div><nav>x</div>y<footer>z") == "y" and markup.visible_text("a<!-- b") == "a" and markup.visible_text("a <p b='c") == "a <p b='c"
    assert markup.visible_text("<p>" + "ab " * 50, 10) == "ab ab ab a" and markup.visible_text(None) == ""
    assert markup.visible_text("<![CDATA[x <b>]]>y<ruby>k<rt>r</rt></ruby>") == "x <b>\ny\nk"
