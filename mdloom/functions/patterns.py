"""Regular expressions of the Markdown line grammar (Java syntax, as Spark evaluates them).

Three conventions keep them usable on a whole document:

* only ``\\n`` ends a line: ``EOL`` is a look-ahead because Java's ``$`` also stops at U+2028 and friends;
* every repetition over lines is possessive (``*+``): the engine then loops instead of recursing, so
  a document of any length is scanned in linear time and without deep stacks;
* a test that belongs to the start of a text begins with ``\\A``, which Java does not retry elsewhere.
"""

# Whitespace as Python's str.strip() sees it: all of it (W), or all but the line feed (H).
# Single characters below U+0100 share one bit set; the rest is tested only from U+1680 on.
_H = (
    r"\t\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)
W = rf"[\n{_H}]"
H = rf"[{_H}]"
NOT_W = rf"[^\n\t\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

EOL = r"(?![^\n])"
REST = r"(?>[^\n]*)"  # atomic: the tight loop of the greedy form, and no way back

# --- fixed line formats --------------------------------------------------------------------------
ATX = r" {0,3}#{1,6}(?![^ \t\n])"
ATX_H1 = r" {0,3}#(?![^ \t\n])"
LIST_ITEM = r"[ \t]*+(?:[-+*]|\p{Nd}++[.)])(?![^ \t\n])"
INDENTED = r"(?: {4}|\t)"
BLANK = rf"{H}*+{EOL}"
REFERENCE_DEFINITION = rf" {{0,3}}\[[^\]\n]++\]:{H}++{NOT_W}"
TABLE_LINE = rf"(?!{INDENTED}){H}*+\|"
TABLE_OR_QUOTE_START = rf"{H}*+[|>]"
TABLE_SEPARATOR = rf"^ {{0,3}}\|?(?:{H}*+:?-{{3,}}+:?{H}*+\|)++{H}*+\z"
FENCE_OPEN = rf" {{0,3}}(?:`{{3,}}+[^`\n]*+{EOL}|~{{3}})"
HARD_BREAK = r"(?: {2}|\\)\z"
FRONT_MATTER = rf"\A{H}*+(---|\+\+\+){H}*+\n(?:(?!{H}*+\1{H}*+{EOL}){REST}\n)*+{H}*+\1{H}*+{EOL}"
FRONT_MATTER_TITLE = rf"(?i)(?:\A|\n)title{W}*+:"

# --- blocks: one match is one unit of the document ------------------------------------------------
# A fence runs to a line with the same character, at least as many of them and nothing after, or to
# the end of the document.
FENCE = (
    rf"(?=[ `~]) {{0,3}}(?:(?<ticks>`{{3,}}+)[^`\n]*+{EOL}|(?<tildes>~{{3,}}+){REST})"
    rf"(?:\n(?! {{0,3}}(?:\k<ticks>`*+|\k<tildes>~*+){H}*+{EOL}){REST})*+(?:\n{REST})?+"
)
FENCE_CLOSED = (
    rf"\A {{0,3}}(?:(`{{3,}}+)[^`\n]*+|(~{{3,}}+){REST})"
    rf"(?:\n(?! {{0,3}}(?:\1`*+|\2~*+){H}*+{EOL}){REST})*+\n"
)
_LETTER = "(?=[a-zA-Z])"  # starts no block; told at once
SETEXT = rf"(?:{_LETTER}|(?!{BLANK}|{ATX}|{LIST_ITEM}|{INDENTED})){REST}\n {{0,3}}(?:=++|-++){EOL}"
LIST_RUN = rf"(?!{INDENTED}){LIST_ITEM}{REST}(?:\n(?!{ATX}|{BLANK}|{FENCE_OPEN}){REST})*+"
TABLE_RUN = rf"{TABLE_LINE}{REST}(?:\n{TABLE_LINE}{REST})*+"
BLANK_RUN = rf"{BLANK}(?:\n{BLANK})*+"
_PLAIN = (
    rf"(?:{_LETTER}|(?!{BLANK}|{INDENTED}|{ATX}|{LIST_ITEM}|{REFERENCE_DEFINITION}|{TABLE_OR_QUOTE_START}|{FENCE_OPEN}))"
    rf"{REST}"
)
PARAGRAPH = rf"{_PLAIN}(?:\n{_PLAIN})*+"
PARAGRAPH_START = rf"\A{_PLAIN}"
LOOKS_LIKE_DEFINITION = rf"(?:\A|\n){H}*+\[[^\n]*?\]:"


def units_of(*blocks):
    """One match per block, or per single line where no block starts.

    To be matched on a text with a line feed put before it: each match takes the line feed that ends
    the unit before, so none is empty and none starts inside another. Group 1 is the unit.
    """
    return r"\n(" + "|".join((FENCE, *blocks, REST)) + ")"


# --- inline grammar -------------------------------------------------------------------------------
_QUOTED = r""""(?:\\[\s\S]|[^"\\])*+"|'(?:\\[\s\S]|[^'\\])*+'"""
# What link detection steps over: each character that may matter by itself, runs of blanks, runs of the rest.
LINK_TOKENS = rf"""[\\\[\]()"']|!(?=\[)|{W}++|(?:(?![\\\[\]()"']|!\[|{W})[\s\S])++"""
MAY_HOLD_LINK = rf"\]{W}*+\("
CODE_SPAN = r"(`++)(?:[^`]|(?!\1(?!`))`++)*+\1(?!`)"
_QUOTED_TEXT = r""""(?:\\[^`<]|[^"\\`<])*+"|'(?:\\[^`<]|[^'\\`<])*+'"""
PLAIN_TEXT = rf"""(?:[^`<"']|(?!{_QUOTED_TEXT})["'])++"""
# Code spans, angle brackets and quotations are left alone; one that never closes covers the rest.
INLINE_UNITS = rf"{CODE_SPAN}|<[^>]*+>|[`<][\s\S]*+|{_QUOTED_TEXT}|{PLAIN_TEXT}"
_URL_CHARACTER = NOT_W.replace("[^", "[^<>")
URL = rf"(?<![<(\[])(?:https?://|www\.){_URL_CHARACTER}++"
URL_UNITS = rf"{URL}|(?:[^hw]++|(?!{URL})[\s\S])++"
URL_START = rf"\A(?:https?://|www\.){_URL_CHARACTER}"
URL_TAIL = r"""[.,;:!?'")]++\z"""
DEFINITION_LIKE = rf"\A{W}*+\[[\s\S]*?\]:"
_DESTINATION = rf"\A((?:(?!\]:)[\s\S])*+\]:{W}*+)"
DEFINITION_WWW = rf"{_DESTINATION}(www\.{NOT_W}*+)"
DEFINITION_HTTP = rf"{_DESTINATION}(https?://{NOT_W}*+)"
_SPAN_OR_QUOTE = "`+[^`]*`+|" + _QUOTED
SPAN_UNITS = rf"""{_SPAN_OR_QUOTE}|(?:[^`"']|(?!{_SPAN_OR_QUOTE})[`"'])++"""
SPAN_OR_QUOTE = rf"\A(?:{_SPAN_OR_QUOTE})\z"
