"""Repairs inside one line: ``Column -> Column`` on a line outside code fences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mdloom.functions import patterns as p
from mdloom.functions.text import extract_all, is_fence, let, rstrip, unless_letter


def _count(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def _autolink_url(url: Column) -> Column:
    """``<url>`` plus the punctuation and unbalanced closing parentheses that end the sentence."""
    stem = F.regexp_replace(url, p.URL_TAIL, "")
    tail = F.substr(url, F.length(stem) + 1)
    # Each surplus ")" of the whole URL may leave from the right; the others belong to it.
    surplus = F.greatest(_count(url, ")") - _count(url, "("), F.lit(0))
    kept = _count(tail, ")") - F.least(_count(tail, ")"), surplus)
    until_kept = F.call_function("substring_index", tail, F.lit(")"), kept)
    address = F.when(kept > 0, F.concat(stem, until_kept, F.lit(")"))).otherwise(stem)
    return let(
        address,
        lambda a: F.concat(
            F.lit("<"),
            F.when(a.rlike(r"(?i)\Awww[.]"), F.lit("https://")).otherwise(F.lit("")),
            a,
            F.lit(">"),
            F.substr(url, F.length(a) + 1),
        ),
    )


def _autolink_plain_text(text: Column) -> Column:
    return F.array_join(
        F.transform(
            extract_all(text, p.URL_UNITS),
            lambda u: F.when(u.rlike(p.URL_START), _autolink_url(u)).otherwise(u),
        ),
        "",
    )


def _may_hold_url(text: Column) -> Column:
    return text.contains("http") | text.contains("www.")


def _autolink_between_links(text: Column) -> Column:
    return F.array_join(
        F.transform(
            extract_all(text, p.INLINE_UNITS),
            lambda u: F.when(_may_hold_url(u) & u.rlike(rf"\A(?:{p.PLAIN_TEXT})\z"), _autolink_plain_text(u)).otherwise(u),
        ),
        "",
    )


def autolink_reference_definitions(line: Column) -> Column:
    """Put the bare destination of ``[label]: url`` into angle brackets."""
    www = F.regexp_replace(line, p.DEFINITION_WWW, "$1<https://$2>")
    return F.regexp_replace(www, p.DEFINITION_HTTP, "$1<$2>")


# Where a scan for links stands: in plain text, in a label, behind a label, in a target.
PLAIN, LABEL, BEHIND, TARGET = range(4)
_SCAN = "struct<at int, mode int, depth int, quote string, escaped boolean, before string, first int, links array<struct<first int, last int>>>"


def link_spans(tokens: Column) -> Column:
    """First and last token of each inline link, brackets of any depth: one pass that keeps the running depth.

    A label opens at a bracket that no backslash precedes, and takes a ``!`` before it along. It ends where the depth is back to none; behind
    it, and blanks, a target must open, in which quotations hide brackets. A label without target is plain text. A label or target that
    never ends leaves the rest of the line without links.
    """

    def step(s: Column, token: Column) -> Column:
        mode, depth, quote = s["mode"], s["depth"], s["quote"]
        opens_target = (mode == BEHIND) & (token == "(")
        plain = (mode == PLAIN) | ((mode == BEHIND) & ~opens_target & ~token.rlike(rf"\A{p.W}"))
        opens_label = plain & (token == "[") & (s["before"] != "\\")
        live = mode.isin(LABEL, TARGET) & ~s["escaped"]
        in_label, in_quote = live & (mode == LABEL), live & (mode == TARGET) & (quote != "")
        in_target = live & (mode == TARGET) & (quote == "")
        deeper = (in_label & (token == "[")) | (in_target & (token == "("))
        higher = (in_label & (token == "]")) | (in_target & (token == ")"))
        ends = higher & (depth == 1)
        return F.struct(
            (s["at"] + 1).alias("at"),
            F.when(opens_label, LABEL).when(plain, PLAIN).when(opens_target, TARGET).when(ends & (mode == LABEL), BEHIND).when(ends, PLAIN).otherwise(mode).alias("mode"),
            F.when(opens_label | opens_target, 1).when(deeper, depth + 1).when(higher, depth - 1).otherwise(depth).alias("depth"),
            F.when(in_quote & (token == quote), "").when(in_target & token.isin("'", '"'), token).otherwise(quote).alias("quote"),
            (live & (token == "\\")).alias("escaped"),
            F.when(token.isin("\\", "!"), token).otherwise("").alias("before"),
            F.when(opens_label, s["at"] - F.when(s["before"] == "!", 1).otherwise(0)).otherwise(s["first"]).alias("first"),
            F.when(ends & (mode == TARGET), F.concat(s["links"], F.array(F.struct(s["first"].alias("first"), s["at"].alias("last"))))).otherwise(s["links"]).alias("links"),
        )  # of the type of the start: a cast would copy the links at every token

    start = F.struct(
        F.lit(0).alias("at"), F.lit(PLAIN).alias("mode"), F.lit(0).alias("depth"), F.lit("").alias("quote"), F.lit(False).alias("escaped"), F.lit("").alias("before"),
        F.lit(0).alias("first"), F.array().alias("links"),
    ).cast(_SCAN)
    return F.aggregate(tokens, start, step, lambda s: s["links"])


def outside_links(line: Column, change: Callable[[Column], Column]) -> Column:
    """``change`` made to the stretches of a line before, between and behind its inline links."""

    def joined(tokens: Column, first: Column, size: Column) -> Column:
        return F.array_join(F.slice(tokens, first + 1, size), "")

    def pieces(tokens: Column, links: Column) -> Column:
        def piece(k: Column) -> Column:
            begins = F.when(k == 0, F.lit(0)).otherwise(F.get(links, k - 1)["last"] + 1)
            ends = F.coalesce(F.get(links, k)["first"], F.size(tokens))
            link = F.get(links, k)
            between = let(joined(tokens, begins, ends - begins), change)
            return F.concat(between, F.coalesce(joined(tokens, link["first"], link["last"] - link["first"] + 1), F.lit("")))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(links)), piece), "")

    with_links = let(extract_all(line, p.LINK_TOKENS), lambda tokens: let(link_spans(tokens), lambda links: pieces(tokens, links)))
    return F.when(line.rlike(p.MAY_HOLD_LINK), with_links).otherwise(change(line))


def autolink_bare_urls(line: Column) -> Column:
    """Turn bare URLs into autolinks, except inside links, code, angle brackets and quotations."""
    return (
        F.when(~_may_hold_url(line) | is_fence(line), line)
        .when(line.rlike(p.DEFINITION_LIKE), autolink_reference_definitions(line))
        .otherwise(outside_links(line, lambda text: F.when(_may_hold_url(text), _autolink_between_links(text)).otherwise(text)))
    )


def escape_reversed_links(line: Column) -> Column:
    """``)[`` would read as a link that lost its order; escape the bracket."""
    escaped = F.array_join(
        F.transform(
            extract_all(line, p.SPAN_UNITS),
            lambda u: F.when(u.rlike(p.SPAN_OR_QUOTE), u).otherwise(F.replace(u, F.lit(")["), F.lit(")&#91;"))),
        ),
        "",
    )
    return F.when(~line.contains(")[") | is_fence(line), line).otherwise(escaped)


def clean_heading_punctuation(line: Column) -> Column:
    """``#… text`` with one blank, no indent and no sentence punctuation at the end."""
    bare = let(
        F.regexp_replace(line, rf"\A {{0,3}}(#{{1,6}})(?:[ \t]++([^\n]*?))?{p.W}*+[.,;:!?]*+{p.W}*+\z", "$1 $2"), rstrip
    )
    return F.when(unless_letter(line, line.rlike(r"\A" + p.ATX)), bare).otherwise(line)


def demote_h1(line: Column) -> Column:
    """An H1 line as H2."""
    return let(F.regexp_replace(line, r"\A {0,3}#[ \t]*+", "## "), rstrip)
