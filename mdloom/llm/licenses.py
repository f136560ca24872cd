"""Licence scans by sentence rules.

A text is brought to lower-case ASCII letters, digits and inner dots, one space between words, and cut into pieces at stops before white
space, at line feeds and around addresses. A blank line ends a paragraph; a line of comment marks only is blank. A sentence is one piece,
or several with nothing but line feeds or an address's edge between them, so wrapped sentences and titles without a stop are found alike.
Each sentence is looked up in a table of known sentences (``license_list``), the longest first where one piece starts several; sentences
such as "this project is licensed under the ..." are brought to the licence's name and looked up among the names, SPDX lines identifier by
identifier. Sentences that name a holder are known by what stands before and after the name, within a paragraph.

So a document becomes a sequence of identifiers in text order. Unknown sentences between two identifiers leave one ``GAP`` mark; copyright
lines and list numbers leave none. Ordered rules then match identifiers side by side in that sequence, gaps included; a rule takes what it
has matched away from the rules after it, so a full licence text is not also reported by its parts. Last, a name, title, address or SPDX
identifier that no rule took stands for its licence.

Null and empty texts have no sentences and no licence. Repeated rows get equal results, rows keep their place. Texts are read whole, in
time that grows with their length: a sentence tries no more pieces than the longest known sentence is long, and a holder's sentence that
does not end in a paragraph is looked for once there.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from mdloom.llm.license_list import HOLDERS, RULES, fold, names, sentences, spdx_names

GAP = "..."

#: What a sentence that states a licence may begin with, the verbs, and how it may end.
STARTERS = ("this", "the", "all", "our")
WORKS = ("project", "software", "work", "program", "file", "code", "source code", "library", "package", "module", "document", "documentation", "repository", "content", "text", "material", "article", "page", "site", "tool", "data", "dataset", "app", "crate", "plugin", "font", "book")
VERBS = ("licensed", "dual licensed", "relicensed", "released", "distributed", "published", "available", "made available", "provided", "offered")
STATED = (
    rf"(?:(?:it|they|(?:{'|'.join(STARTERS)}) (?:{'|'.join(WORKS)})) (?:is|are) )?(?:{'|'.join(VERBS)}) under (?:the terms of )?(?:the |a |an )?"
    r"(.+?)(?: the license)?(?: see (?:the )?(?:license|copying)(?:\.md|\.txt)?(?: (?:license|copying)(?:\.md|\.txt)?)?(?: file)? for (?:more )?(?:details|information))?"
)
SPDX = "spdx license identifier "
SPDX_WORDS = 7  # the longest identifier has five
#: Sentences that leave no gap: numbers of lists and marks of comments; copyright notices, up to the end of their line.
SKIPPED, NOTICE = r"dnl|rem|[ivx]+|[a-z]|[0-9]{1,2}", r"copyright(?: .*)?|c [0-9].*"

_PLAIN = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789.!?;\n\x1e" else ord(chr(c).lower()) if 65 <= c <= 90 else 32 for c in range(256))
_ADDRESS = re.compile(rb"[hH][tT][tT][pP][sS]?://(?:[wW]{3}\.)?([^\x00-\x20<>()\[\]\"']+)")
_SPACES = re.compile(r"  +")
_MARKED = re.compile(r"(\A|\n) ?(?:(?:dnl|rem)(?= |\n|\Z)|[.!?;]+)")
_CUT = re.compile(r"([.!?;]+(?=[ \n\x1e]|\Z)|\n(?: *\n)+|[\n\x1e])")
_INNER = re.compile(r"[!?;]+")
_SOFT, _STOP, _PARAGRAPH = range(3)


def pieces(text: str) -> tuple[list[str], list[int], list[int]]:
    """The pieces of a text, what stands after each (an end of a line or address, a stop, the end of a paragraph), and their lines."""
    data = text.encode()
    if b"://" in data:
        data = _ADDRESS.sub(b"\x1e\\1\x1e", data)
    plain = _SPACES.sub(" ", data.translate(_PLAIN).decode("ascii"))
    parts = _CUT.split(_MARKED.sub(r"\1", plain))
    said: list[str] = []
    ends: list[int] = []
    lines: list[int] = []
    line = 0
    for part, cut in zip(parts[::2], [*parts[1::2], "\n\n"]):
        end = _SOFT if cut in ("\n", "\x1e") else _PARAGRAPH if cut[0] == "\n" else _STOP
        part = part.strip(" ")
        if "!" in part or "?" in part or ";" in part:
            part = _INNER.sub("", part)
        if part:
            said.append(part)
            ends.append(end)
            lines.append(line)
        elif ends and end > ends[-1]:
            ends[-1] = end
        line += "\n" in cut
    return said, ends, lines


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[str, str], dict[str, str], dict[str, str], set[str], set[str], set[str], int]:
    """Sentences, names, SPDX identifiers, the first two, the first and the last words of all that may be found, and the longest sentence's length."""
    known, said = sentences(), names()
    starts = {f"{s} {w.split()[0]}" for s, w in product(STARTERS, WORKS)}
    starts |= {" ".join(f"{v} under".split()[:2]) for v in VERBS} | {f"{s} {v}" for s, v in (("it", "is"), ("they", "are"))}
    starts |= {" ".join(s.split(" ")[:2]) for s in (*known, *(s for s, _, _ in HOLDERS), SPDX)}
    starts |= {" ".join(("the " + s).split(" ")[:2]) for s, x in known.items() if x.startswith("title:")}
    starts |= {f"{first} {mark}" for first, _, rest in (s.partition(" ") for s in starts) if rest[:1].isdigit() for mark in ("version", "v.")}
    lasts = {s.rsplit(" ", 1)[-1] for s in (*known, *said)} | {"license", "details", "information"}
    firsts = {s.split(" ")[0] for s in starts}
    firsts |= {s.replace("licens", "licenc") for s in firsts}
    return known, said, spdx_names(), starts, firsts, lasts, max(map(len, known))


_STATED, _SKIPPED, _NOTICE = re.compile(STATED), re.compile(SKIPPED), re.compile(NOTICE)


def identifiers(sentence: str) -> list[str]:
    """The identifiers of one sentence; none if it is not known."""
    known, said, *_ = _tables()
    sentence = fold(sentence)
    found = known.get(sentence) or known.get(sentence.removeprefix("the "))
    if found:
        return [found]
    stated = _STATED.fullmatch(sentence)
    if stated and stated[1] in said:
        return [f"name:{said[stated[1]]}"]
    return []


def listed(line: str) -> list[str]:
    """The identifiers that an SPDX line lists; words that are none are left out."""
    if not line.startswith(SPDX):
        return []
    spdx = _tables()[2]
    words, found, at = fold(line[len(SPDX) :]).split(" "), [], 0
    while at < len(words):
        take = next((n for n in range(SPDX_WORDS, 0, -1) if " ".join(words[at : at + n]) in spdx), 0)
        found += [f"spdx:{spdx[' '.join(words[at : at + take])]}"] if take else []
        at += take or 1
    return found


class _Scan:
    """The pieces of one text, and what is known of the paragraph being read."""

    def __init__(self, text: str):
        self.said, self.ends, self.lines = pieces(text)
        self.begins, self.joined, self.last = [], "", -1  # of the pieces in the paragraph's text; its last piece
        self.first = 0
        self.missing: dict[str, int] = {}  # holder's sentence: the last piece of the paragraph that does not end it

    def sentence_at(self, at: int) -> tuple[list[str], int]:
        """The identifiers of the longest known sentence that starts at a piece, and the piece after it."""
        _, _, _, starts, _, lasts, longest = _tables()
        head = self.said[at].split(" ", 2)[:2]
        if len(head) == 1 and self.ends[at] == _SOFT and at + 1 < len(self.said):
            head.append(self.said[at + 1].split(" ", 1)[0])
        if head[0] not in starts and fold(" ".join(head)) not in starts:
            return [], at + 1
        ids = listed(self.said[at])
        if ids:
            return ids, at + 1
        tried, size = [], 0
        for i in range(at, len(self.said)):
            size += len(self.said[i]) + 1
            if i > at and size > longest + 100:  # folding takes a few letters away
                break
            tried.append(self.said[i])
            if self.ends[i] != _SOFT:
                break
        for n in range(len(tried), 0, -1):
            ids = fold(tried[n - 1].rsplit(" ", 1)[-1]) in lasts and identifiers(" ".join(tried[:n]))
            if ids:
                return ids, at + n
        for before, after, identifier in HOLDERS:
            if before.startswith(head[0] + " ") and self.missing.get(identifier, -1) < at:
                until = self._held(at, before, after)
                if until > at:
                    return [identifier], until
                if until == at:
                    self.missing[identifier] = self.last
        return [], at + 1

    def _held(self, at: int, before: str, after: str) -> int:
        """The piece after a sentence that names a holder; ``at`` if the paragraph does not end it, -1 if none begins."""
        if at > self.last:
            self.first, self.last = at, next(i for i in range(at, len(self.said)) if self.ends[i] == _PARAGRAPH)
            part = self.said[at : self.last + 1]
            self.begins, self.joined = list(accumulate((len(p) + 1 for p in part), initial=0)), " ".join(part) + " "
        begin = self.begins[at - self.first]
        if not self.joined.startswith(before, begin):
            return -1
        found = self.joined.find(after + " ", begin)
        while found >= 0:
            end = found + len(after) + 1
            n = bisect_left(self.begins, end)
            if self.begins[n] == end:
                return self.first + n
            found = self.joined.find(after + " ", found + 1)
        return at


def sequence(text: str | None) -> list[str]:
    """Identifiers of the known sentences in text order, one ``GAP`` for unknown ones between two."""
    if not text:
        return []
    scan, found, at, gap, notice = _Scan(text), [], 0, False, -1
    firsts = _tables()[4]
    while at < len(scan.said):
        first = scan.said[at].partition(" ")[0]
        may = first in firsts or (first[-1].isdigit() and fold(first) in firsts)
        ids, after = scan.sentence_at(at) if may else ([], at + 1)
        if ids:
            found += [GAP, *ids] if gap and found else ids
            gap = False
        elif _NOTICE.fullmatch(scan.said[at]):
            notice = scan.lines[at]
        elif not gap:
            gap = scan.lines[at] != notice and not _SKIPPED.fullmatch(scan.said[at])
        at = after
    return found


def licences(found: list[str]) -> list[str]:
    """Licences of a sequence of identifiers, in order of the rules; each once."""
    if not found:
        return []
    left, named = "," + ",,".join(found) + ",", []  # neighbours have delimiters of their own
    for licence, ids in RULES:
        pattern = "," + ",,".join(ids) + ","
        if pattern in left:
            left = left.replace(pattern, "#")
            named.append(licence)
    named += [x.partition(":")[2] for x in left.replace("#", ",").split(",") if ":" in x]
    return list(dict.fromkeys(named))


_ANSWER = pa.struct([("sentence_ids", pa.list_(pa.string())), ("licenses", pa.list_(pa.string()))])


@F.arrow_udf(StructType().add("sentence_ids", ArrayType(StringType())).add("licenses", ArrayType(StringType())))
def _scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        sequences = (sequence(t.as_py()) for t in texts)
        yield pa.array([{"sentence_ids": s, "licenses": licences(s)} for s in sequences], _ANSWER)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Rows of ``docs(text, ...)`` as ``row`` (all columns but ``text``), ``sentence_ids`` (with gaps) and ``licenses`` in order of the rules."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    found = docs.select(F.struct(*rest).alias("row"), _scanned(F.col("text")).alias("found"))
    return found.select("row", "found.sentence_ids", "found.licenses")
