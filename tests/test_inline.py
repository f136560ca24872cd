"""Line repairs on examples whose right answer is known."""

from __future__ import annotations

import textwrap

import pytest
from pyspark.sql import functions as F

from mdloom.functions import inline
from mdloom.functions import text as tx

AUTOLINKS = {
    "See https://e.org.": "See <https://e.org>.",
    "www.E.org, next": "<https://www.E.org>, next",
    "(see http://e.org/a_(b))": "(see <http://e.org/a_(b)>)",
    "http://e.org/a).) x": "<http://e.org/a>).) x",
    "(http://e.org)": "(http://e.org)",
    "(https://www.e.org)": "(https://<https://www.e.org>)",
    "[a](http://e.org) http://f.org": "[a](http://e.org) <http://f.org>",
    '[a](http://e.org "http://t.org") www.f.org': '[a](http://e.org "http://t.org") <https://www.f.org>',
    "[o http://i.org [n]](http://e.org)": "[o http://i.org [n]](http://e.org)",
    "[a [b](c) http://e.org": "[a [b](c) <http://e.org>",
    r"\[a](http://e.org)": r"\[a](http://e.org)",
    "[a] http://e.org": "[a] <http://e.org>",
    "![i](http://e.org/i.png)http://f.org": "![i](http://e.org/i.png)<http://f.org>",
    "`http://c.org` http://e.org": "`http://c.org` <http://e.org>",
    "`` a ` http://c.org `` http://e.org": "`` a ` http://c.org `` <http://e.org>",
    "` open http://e.org": "` open http://e.org",
    "<http://e.org> http://f.org": "<http://e.org> <http://f.org>",
    "< open http://e.org": "< open http://e.org",
    '"http://q.org" http://e.org': '"http://q.org" <http://e.org>',
    '"open http://e.org': '"open <http://e.org>',
    "it's http://e.org": "it's <http://e.org>",
    "https:// nothing": "https:// nothing",
    "www..": "<www>..",
    "[r]: http://e.org title": "[r]: <http://e.org> title",
    "  [r [s]]: www.e.org": "  [r [s]]: <https://www.e.org>",
    "[r]: <http://e.org>": "[r]: <http://e.org>",
    "[r] and ]: http://e.org": "[r] and ]: <http://e.org>",
    "HTTP://E.ORG": "HTTP://E.ORG",
    "[" * 20 + "x" + "]" * 20 + "(http://e.org)": "[" * 20 + "x" + "]" * 20 + "(http://e.org)",
    "[" * 40 + "x" + "]" * 40 + "(http://e.org) http://f.org": "[" * 40 + "x" + "]" * 40 + "(http://e.org) <http://f.org>",
    "[" * 3000 + "x http://i.org" + "]" * 3000 + "(" * 3000 + "http://e.org" + ")" * 3000 + " http://f.org": "[" * 3000 + "x http://i.org" + "]" * 3000 + "(" * 3000 + "http://e.org" + ")" * 3000 + " <http://f.org>",
    "[" * 41 + "x" + "]" * 40 + "(http://e.org) http://f.org": "[" * 41 + "x" + "]" * 40 + "(http://e.org) <http://f.org>",
    "[a] ![b] [c](u) http://f.org": "[a] ![b] [c](u) <http://f.org>",
    "[a]![b](http://u) http://f.org": "[a]![b](http://u) <http://f.org>",
    r"[a\]](http://u) http://f.org": r"[a\]](http://u) <http://f.org>",
    r"[a](http://u 'x) y') z') http://f.org": r"[a](http://u 'x) y') z') <http://f.org>",
    r"[a](http://u\) x) http://f.org": r"[a](http://u\) x) <http://f.org>",
    r"\\[a](http://u) b": r"\\[a](http://u) b",
    "[a](u) [b](http://open http://f.org": "[a](u) [b](http://open <http://f.org>",
    "x http://a [b](c) y www.d [e](f) z www.g": "x <http://a> [b](c) y <https://www.d> [e](f) z <https://www.g>",
}
ESCAPES = {
    "(a)[b]": "(a)&#91;b]",
    "`(a)[b]` (c)[d]": "`(a)[b]` (c)&#91;d]",
    '"(a)[b]" (c)[d]': '"(a)[b]" (c)&#91;d]',
    "it's (c)[d]": "it's (c)&#91;d]",
    "`open (c)[d]": "`open (c)&#91;d]",
}
HEADINGS = {
    "#  A. ": "# A", "   ## B ?!": "## B", "### ": "###", "#": "#", "# . .": "# .", "#x.": "#x.", "    # c.": "    # c.",
    "# a b.": "# a b", "#\tT:": "# T",
}


def check(spark, cases, change):
    frame = spark.createDataFrame(list(cases.items()), "given string, wanted string")
    rows = frame.select("given", "wanted", change(F.col("given")).alias("got")).filter("got != wanted").collect()
    assert not rows


@pytest.mark.parametrize(
    "cases, change",
    [
        (AUTOLINKS, inline.autolink_bare_urls),
        (ESCAPES, inline.escape_reversed_links),
        (HEADINGS, inline.clean_heading_punctuation),
    ],
)
def test_line_repairs(spark, cases, change):
    check(spark, cases, change)


def test_wrapping_equals_the_standard_library(spark):
    texts = [
        "", "a", "x" * 200, "a " * 200, "a  b   c " * 40, "tab\there\tand " * 20, "well-known hy-phens " * 20,
        "y" * 119 + " b", "y" * 120 + " b", "y" * 121 + " b", "éà " * 90, "  lead " + "w " * 100, " \t lead " + "w" * 118 + " z",
        "end " * 30 + " " * 130 + "far",
    ]
    options = {"width": 120, "break_long_words": False, "break_on_hyphens": False}
    cases = [(t, textwrap.wrap(t, **options)) for t in texts]
    frame = spark.createDataFrame(cases, "given string, wanted array<string>")
    rows = frame.withColumn("got", tx.wrapped_lines(F.col("given"))).filter("got != wanted").collect()
    assert not rows


def test_first_and_last_character_decide_like_the_patterns(spark):
    texts = [None, "", " ", "a", "~", "\x7f", "é", "a ", " a", "a ", "　a", "a\x1c", "é\xa0", "Z\n", "\n", "1. x", "# h", "```", "`a", "a¡", "﻿a", "{", "@", "[", "!", "x\x7f"]
    blanks = "\n\t\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", tx.is_blank(t), tx.rstrip(t), tx.strip(t), tx.starts_with_letter(t), tx.ends_visibly(t)).collect()
    for text, *found in rows:
        wanted = [None] * 5 if text is None else [not text.strip(blanks), text.rstrip(blanks), text.strip(blanks), text[:1].isascii() and text[:1].isalpha(), "!" <= text[-1:] <= "~"]
        assert found == wanted, repr(text)
