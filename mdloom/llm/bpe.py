"""Byte-pair encoding and decoding with a memory-mapped lexicon of frequent words.

Texts are normalised (NFC, lower case by character) and cut into words by the tokenizer's pattern: contractions, runs of letters, single
digits, runs of other characters; white space is dropped. Each distinct word of a run of texts is encoded once:

* Frequent words are looked up in a minimal acyclic automaton. Words that end alike share states; the numbers on a word's transitions add
  up to its rank among all words, which points to its ids. The automaton, the merge table and the token texts form one file, which Spark
  ships to the executors and every Python worker maps into memory.
* All other words are merged exactly: per round, in all words at once, the leftmost pair of least rank; very long words with a heap.

The lexicon holds the most frequent words, ``LEXICON_WORDS`` at most, counted over all texts; it decides on speed only, never on ids. Special tokens
in a text become their ids. Decoding joins the token texts by one space, as a tokenizer file without a decoder asks for.

Null texts are empty, empty texts have no ids, texts of any length are encoded whole. Other columns are carried along in a struct.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.llm.common import Stage, mix64, most_frequent, powers, text_runs

LEXICON_WORDS = 100_000
RUN_BYTES = 1 << 20
COUNTED_AT_ONCE = 1_000_000
HEAP_FROM = 48  # symbols of a word from which merges are taken from a heap
PUNCTUATION, LETTER, NUMBER, BLANK = range(4)
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
NONE = np.int64(-1)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in token texts."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


# Tables of 64-bit keys ------------------------------------------------------------------------------------------------


def key_table(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """An open-addressing table as arrays: slot keys (-1: free) and the values of each slot."""
    size = 1 << max(4, int(2 * len(keys)).bit_length())
    slots = np.full(size, NONE)
    place = np.empty(len(keys), np.int64)
    left = np.arange(len(keys))
    at = (mix64(keys.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)
    while len(left):
        free = slots[at[left]] == NONE
        _, first = np.unique(at[left][free], return_index=True)
        winners = left[free][first]
        slots[at[winners]] = keys[winners]
        place[winners] = at[winners]
        left = np.setdiff1d(left, winners, assume_unique=True)
        taken = slots[at[left]] != NONE
        at[left[taken]] = (at[left[taken]] + 1) & (size - 1)
    spread = []
    for value in values:
        out = np.zeros(size, value.dtype)
        out[place] = value
        spread.append(out)
    return (slots, *spread)


def find_keys(slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where the table does not hold it."""
    mask = len(slots) - 1
    at = (mix64(keys.astype(np.uint64)) & np.uint64(mask)).astype(np.int64)
    seen = slots[at]
    open_ = np.flatnonzero((seen != keys) & (seen != NONE))
    while len(open_):
        at[open_] = (at[open_] + 1) & mask
        seen[open_] = slots[at[open_]]
        open_ = open_[(seen[open_] != keys[open_]) & (seen[open_] != NONE)]
    return np.where(seen == keys, at, -1)


# The automaton --------------------------------------------------------------------------------------------------------


def minimal_automaton(words: list[str]) -> dict[str, np.ndarray]:
    """Sorted distinct words to their minimal acyclic automaton, state 0 first: transitions with the rank they add, and final states."""
    finals, edges, known = [False], [{}], {}
    path = [0]  # states of the last word, not yet shared

    def settle(depth: int, last: str) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            form = (finals[state], tuple(edges[state].items()))
            edges[path[-1]][ord(last[len(path) - 1])] = known.setdefault(form, state)

    last = ""
    for word in words:
        common = 0
        while common < min(len(last), len(word)) and last[common] == word[common]:
            common += 1
        settle(common, last)
        for letter in word[common:]:
            finals.append(False)
            edges.append({})
            edges[path[-1]][ord(letter)] = len(edges) - 1
            path.append(len(edges) - 1)
        finals[path[-1]] = True
        last = word
    settle(0, last)
    below: dict[int, int] = {}
    rows: list[tuple[int, int, int, int]] = []
    stack = [0]
    while stack:  # children before parents
        state = stack[-1]
        waiting = [t for t in edges[state].values() if t not in below]
        if waiting:
            stack.extend(waiting)
            continue
        stack.pop()
        if state in below:
            continue
        total = int(finals[state])
        for letter, target in sorted(edges[state].items()):
            rows.append((state, letter, target, total))
            total += below[target]
        below[state] = total
    number = {state: i for i, state in enumerate(sorted(below))}
    table = np.array([(number[s] << 21 | c, number[t], r) for s, c, t, r in rows], np.int64).reshape(-1, 3)
    slots, target, rank = key_table(table[:, 0], table[:, 1].astype(np.int32), table[:, 2].astype(np.int32))
    return {"edge": slots, "target": target, "rank": rank, "final": np.array([finals[s] for s in sorted(below)], np.uint8)}


def ranks_of(auto: dict[str, np.ndarray], letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rank of each word ``letters[start:end]`` among the automaton's words, -1 for others."""
    state, rank = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    out = np.full(len(start), -1, np.int64)
    alive, step = np.arange(len(start)), 0
    while len(alive):
        done = end[alive] - start[alive] == step
        ended = alive[done]
        out[ended] = np.where(auto["final"][state[ended]] == 1, rank[ended], -1)
        alive = alive[~done]
        slot = find_keys(auto["edge"], state[alive] << 21 | letters[start[alive] + step].astype(np.int64))
        alive, slot = alive[slot >= 0], slot[slot >= 0]
        state[alive] = auto["target"][slot]
        rank[alive] += auto["rank"][slot]
        step += 1
    return out


# Merges ---------------------------------------------------------------------------------------------------------------


def _heap_merge(symbols: list[int], book: dict[str, np.ndarray]) -> list[int]:
    """One long word: always the leftmost pair of least rank."""
    after, before, alive = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1)), [True] * len(symbols)
    known: dict[tuple[int, int], tuple[int, int] | None] = {}

    def rule(a: int, b: int) -> tuple[int, int] | None:
        if (a, b) not in known:
            slot = int(find_keys(book["pair"], np.array([a << 20 | b]))[0])
            known[a, b] = (int(book["order"][slot]), int(book["merged"][slot])) if slot >= 0 else None
        return known[a, b]

    heap = [(r[0], i, symbols[i], symbols[i + 1]) for i in range(len(symbols) - 1) if (r := rule(symbols[i], symbols[i + 1]))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= len(symbols) or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], alive[j], after[i] = rule(a, b)[1], False, after[j]
        if after[i] < len(symbols):
            before[after[i]] = i
            if r := rule(symbols[i], symbols[after[i]]):
                heapq.heappush(heap, (r[0], i, symbols[i], symbols[after[i]]))
        if before[i] >= 0 and (r := rule(symbols[before[i]], symbols[i])):
            heapq.heappush(heap, (r[0], before[i], symbols[before[i]], symbols[i]))
    return [s for s, keep in zip(symbols, alive, strict=True) if keep]


def merge_words(book: dict[str, np.ndarray], data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words ``data[start:end]`` (UTF-8 bytes, none empty): how many each has, and all in order."""
    size = end - start
    word = np.repeat(np.arange(len(start)), size)
    first = np.cumsum(size) - size
    byte = data[np.arange(len(word)) - first[word] + start[word]]
    symbol = book["byte"][byte].astype(np.int64)
    tail = first + size - 1
    symbol[tail] = book["byte_end"][byte[tail]]
    settled_word, settled_symbol = [], []
    for k in np.flatnonzero(size >= HEAP_FROM):
        ids = _heap_merge(symbol[first[k] : first[k] + size[k]].tolist(), book)
        settled_word.append(np.full(len(ids), k))
        settled_symbol.append(np.array(ids, np.int64))
    short = size[word] < HEAP_FROM
    word, symbol = word[short], symbol[short]
    never = np.iinfo(np.int64).max
    while len(word):
        order = np.full(len(word), never)
        inner = np.flatnonzero(word[1:] == word[:-1])
        slot = find_keys(book["pair"], symbol[inner] << 20 | symbol[inner + 1])
        hit = inner[slot >= 0]
        order[hit] = (book["order"][slot[slot >= 0]].astype(np.int64) << 32) | slot[slot >= 0]
        begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        least = np.minimum.reduceat(order, begins)
        mine = np.repeat(least, np.diff(np.concatenate((begins, [len(word)]))))
        over = mine == never
        if over.any():
            settled_word.append(word[over])
            settled_symbol.append(symbol[over])
        found = np.flatnonzero((order == mine) & ~over)
        found = found[np.concatenate(([True], word[found[1:]] != word[found[:-1]]))] if len(found) else found
        symbol[found] = book["merged"][order[found] & 0xFFFFFFFF]
        keep = ~over
        keep[found + 1] = False
        word, symbol = word[keep], symbol[keep]
    words = np.concatenate(settled_word) if settled_word else np.zeros(0, np.int64)
    symbols = np.concatenate(settled_symbol) if settled_symbol else np.zeros(0, np.int64)
    return np.bincount(words, minlength=len(start)), symbols[np.argsort(words, kind="stable")]


# Words of texts -------------------------------------------------------------------------------------------------------

_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """Kind of every code point."""
    global _kinds
    if _kinds is None:
        of = {"L": LETTER, "N": NUMBER}
        _kinds = np.array([of.get(unicodedata.category(chr(c))[0], PUNCTUATION) for c in range(0x110000)], np.uint8)
        _kinds[WHITE_SPACE] = BLANK
    return _kinds


def normal(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # capital sigma has one small form per character
    return text.lower()


def word_spans(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word among code points."""
    count = len(letters)
    kind = kinds()[letters]
    begins = np.ones(count + 1, bool)
    begins[1:count] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    mark = np.flatnonzero(letters == ord("'"))
    if len(mark):
        opens = np.ones(len(mark), bool)
        opens[mark > 0] = kind[mark[mark > 0] - 1] != PUNCTUATION
        mark = mark[opens]
        one = letters[np.minimum(mark + 1, count - 1)]
        two = letters[np.minimum(mark + 2, count - 1)]
        is_ = lambda x, s: x == ord(s)
        single = (mark + 1 < count) & np.isin(one, [ord(c) for c in "stmd"])
        double = (mark + 2 < count) & ((is_(one, "r") & is_(two, "e")) | (is_(one, "v") & is_(two, "e")) | (is_(one, "l") & is_(two, "l")))
        taken = mark[single | double]
        stop = np.where(single, mark + 2, mark + 3)[single | double]
        begins[taken + 1] = False
        begins[stop] = True
    solid = kind != BLANK
    start = np.flatnonzero(begins[:count] & solid)
    last = solid.copy()
    last[:-1] &= begins[1:count] | ~solid[1:]
    return start, np.flatnonzero(last) + 1


class Run:
    """Words of a run of texts: spans in code points and bytes, distinct words, and the text each word belongs to."""

    def __init__(self, units: list[str]):
        joined = "\n".join(units)
        self.letters = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.data = np.frombuffer(joined.encode(), np.uint8)
        self.start, self.end = word_spans(self.letters)
        up, down = powers(len(self.letters) + 1)
        sums = np.zeros(len(self.letters) + 1, np.uint64)
        np.cumsum((self.letters.astype(np.uint64) + np.uint64(1)) * up[: len(self.letters)], out=sums[1:])
        hashes = mix64((sums[self.end] - sums[self.start]) * down[self.start])
        self.hash, self.example, self.which, self.count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        begins = np.cumsum([0] + [len(u) + 1 for u in units])
        self.first = np.searchsorted(self.start, begins)
        wide = 1 + (self.letters > 0x7F).astype(np.int64) + (self.letters > 0x7FF) + (self.letters > 0xFFFF)
        self.byte_at = np.concatenate(([0], np.cumsum(wide)))


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``data`` one after another, and the offsets of each among them."""
    offsets = np.concatenate(([0], np.cumsum(size)))
    return data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)], offsets


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    for low, high, data, offsets in text_runs(batch, limit=RUN_BYTES):
        whole = data.tobytes()
        yield low, high, [whole[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of a task with their counts; a bounded number is held before they are given out."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def given() -> pa.RecordBatch:
        hashes, counts, sizes = (np.concatenate([h[i] for h in held]) for i in range(3))
        data = np.concatenate([h[3] for h in held])
        _, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        chosen, offsets = gather(data, (np.cumsum(sizes) - sizes)[example], sizes[example])
        words = pa.StringArray.from_buffers(len(example), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(chosen.tobytes()))
        total = np.bincount(which, weights=counts, minlength=len(example)).astype(np.int64)
        held.clear()
        return pa.RecordBatch.from_arrays([words, pa.array(total)], names=["word", "n"])

    for batch in batches:
        for _, _, texts in _texts(batch):
            run = Run([normal(t) for t in texts])
            start, end = run.start[run.example], run.end[run.example]
            size = run.byte_at[end] - run.byte_at[start]
            held.append((run.hash, run.count, size, gather(run.data, run.byte_at[start], size)[0]))
            if sum(len(h[0]) for h in held) > COUNTED_AT_ONCE:
                yield given()
    if held:
        yield given()


def frequent_words(docs: DataFrame, limit: int = LEXICON_WORDS) -> list[str]:
    counts = docs.select("text").mapInArrow(_word_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = Stage(docs.sparkSession, "bpe").write(counts, "word-counts")
    return [r["word"] for r in most_frequent(counts, "n", limit).select("word").collect()]


# The shipped file -----------------------------------------------------------------------------------------------------


def build_book(tokenizer_path: str, words: list[str]) -> dict[str, np.ndarray]:
    """Everything that encodes and decodes, as arrays."""
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = json.load(file)
    vocabulary, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs], np.int64)
    keys, where = np.unique(keys[::-1], return_index=True)  # of equal rules the last counts
    order = (len(pairs) - 1 - where).astype(np.int32)
    merged = np.array([vocabulary[pairs[i][0] + pairs[i][1]] for i in order], np.int32)
    book = dict(zip(("pair", "order", "merged"), key_table(keys, order, merged), strict=True))
    shown = byte_characters()
    book["byte"] = np.array([vocabulary[c] for c in shown], np.int32)
    book["byte_end"] = np.array([vocabulary[c + suffix] for c in shown], np.int32)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    text_of = {i: t for t, i in (vocabulary | special).items()}
    texts = [text_of.get(i, "").encode() for i in range(max(text_of) + 1)]
    book["token_size"] = np.array([len(t) for t in texts], np.int32)
    book["token_text"] = np.frombuffer(b"".join(texts), np.uint8)
    book["special"] = np.frombuffer(json.dumps(special).encode(), np.uint8)
    words = sorted(set(words))
    book |= minimal_automaton(words)
    data = [w.encode() for w in words]
    size = np.array([len(w) for w in data], np.int64)
    count, ids = merge_words(book, np.frombuffer(b"".join(data), np.uint8), np.cumsum(size) - size, np.cumsum(size))
    book["word_count"], book["word_ids"] = count.astype(np.int32), ids.astype(np.int32)
    return book


def pack(book: dict[str, np.ndarray]) -> bytes:
    head, body, at = {}, [], 0
    for name, array in book.items():
        raw = np.ascontiguousarray(array).tobytes()
        head[name] = [array.dtype.str, len(array), at]
        raw += b"\0" * (-len(raw) % 8)
        body.append(raw)
        at += len(raw)
    start = json.dumps(head).encode()
    start += b" " * (-len(start) % 8)
    return len(start).to_bytes(8, "little") + start + b"".join(body)


def map_book(path: str) -> dict[str, np.ndarray]:
    """The file's arrays, mapped into memory; and what is derived from them once per process."""
    raw = np.asarray(np.memmap(path, np.uint8, "r"))
    begin = 8 + int.from_bytes(raw[:8].tobytes(), "little")
    book = {}
    for name, (kind, count, at) in json.loads(raw[8:begin].tobytes()).items():
        book[name] = raw[begin + at : begin + at + count * np.dtype(kind).itemsize].view(kind)
    for name in ("word", "token"):
        size = book[f"{name}_count" if name == "word" else f"{name}_size"].astype(np.int64)
        book[f"{name}_at"] = np.cumsum(size) - size
    return book


_mapped: dict[str, dict[str, np.ndarray]] = {}


def ship(spark: SparkSession, book: dict[str, np.ndarray]) -> str:
    """Write the file to the shared folder and let Spark hand it to the executors; its name there."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    folder = Stage(spark, "bpe").folder
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    data = pack(book)
    for low in range(0, len(data), 1 << 20):
        out.write(bytearray(data[low : low + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def opened(name: str) -> dict[str, np.ndarray]:
    if name not in _mapped:
        _mapped.clear()
        _mapped[name] = map_book(SparkFiles.get(name))
    return _mapped[name]


# Encoding and decoding ------------------------------------------------------------------------------------------------


def encode_texts(book: dict[str, np.ndarray], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, and each text's offset among them."""
    special = json.loads(book["special"].tobytes())
    pattern = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
    units, owner, inserted = [], [], []
    for i, text in enumerate(texts):
        parts = pattern.split(text) if pattern and any(s in text for s in special) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                inserted.append((len(units), special[part]))
            units.append("" if k % 2 else normal(part))
            owner.append(i)
    run = Run(units)
    start, end = run.start[run.example], run.end[run.example]
    rank = ranks_of(book, run.letters, start, end)
    known = rank >= 0
    count = np.zeros(len(start), np.int64)
    count[known] = book["word_count"][rank[known]]
    count[~known], rest = merge_words(book, run.data, run.byte_at[start[~known]], run.byte_at[end[~known]])
    ids = np.concatenate((book["word_ids"], rest, np.array([x for _, x in inserted], np.int64)))
    at = np.zeros(len(start), np.int64)
    at[known] = book["word_at"][rank[known]]
    at[~known] = len(book["word_ids"]) + np.cumsum(count[~known]) - count[~known]
    unit = np.repeat(np.arange(len(units)), np.diff(run.first))
    begins, sizes = at[run.which], count[run.which]
    if inserted:
        unit = np.concatenate((unit, [u for u, _ in inserted]))
        begins = np.concatenate((begins, len(ids) - len(inserted) + np.arange(len(inserted))))
        sizes = np.concatenate((sizes, np.ones(len(inserted), np.int64)))
        order = np.argsort(unit, kind="stable")
        unit, begins, sizes = unit[order], begins[order], sizes[order]
    found, _ = gather(ids, begins, sizes)
    per_text = np.bincount(np.array(owner, np.int64)[unit], weights=sizes, minlength=len(texts)).astype(np.int64)
    return found, np.concatenate(([0], np.cumsum(per_text)))


def decode_ids(book: dict[str, np.ndarray], ids: np.ndarray) -> bytes:
    if not len(ids):
        return b""
    size = book["token_size"][ids].astype(np.int64)
    at = np.concatenate(([0], np.cumsum(size + 1)))
    out = np.full(at[-1], ord(" "), np.uint8)
    text, offsets = gather(book["token_text"], book["token_at"][ids], size)
    out[np.arange(len(text)) + np.repeat(np.arange(len(ids)), size)] = text
    return out[:-1].tobytes()


def _passed(batch: pa.RecordBatch, low: int, high: int, *more: tuple[str, pa.Array], drop: tuple[str, ...]) -> pa.RecordBatch:
    kept = [name for name in batch.schema.names if name not in drop]
    return pa.RecordBatch.from_arrays([batch.column(n).slice(low, high - low) for n in kept] + [a for _, a in more], names=kept + [n for n, _ in more])


def _encoded(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, texts in _texts(batch):
            ids, offsets = encode_texts(opened(name), texts)
            yield _passed(batch, low, high, ("ids", pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))), drop=("text",))


def _decoded(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        book, rows = opened(name), batch.column("ids")
        texts = [decode_ids(book, x.values.to_numpy()) if x.is_valid else b"" for x in rows]
        yield _passed(batch, 0, len(rows), ("decoded", pa.array([t.decode() for t in texts], pa.string())), drop=())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [x.values.to_numpy() for x in batch.column("ids")]
        yield _passed(
            batch, 0, len(rows),
            ("n_tokens", pa.array([len(x) for x in rows], pa.int64())),
            ("ids_sha256", pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in rows], pa.string())),
            ("decoded_sha256", pa.array([hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in batch.column("decoded")], pa.string())),
            drop=("ids", "decoded"),
        )


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("row"), "text")
    return rows, f"row {rows.schema['row'].dataType.simpleString()}"


def prepare(docs: DataFrame, tokenizer_path: str, lexicon_words: int = LEXICON_WORDS) -> str:
    """Count the words of ``docs``, compile and ship the lexicon; its name for ``encode`` and ``decode``."""
    return ship(docs.sparkSession, build_book(tokenizer_path, frequent_words(docs, lexicon_words)))


def encode(docs: DataFrame, lexicon: str) -> DataFrame:
    """``docs(text, ...)`` as ``row`` (all columns but ``text``) and ``ids``."""
    rows, row = _rows(docs)
    return rows.mapInArrow(lambda batches: _encoded(lexicon, batches), f"{row}, ids array<int>")


def decode(encoded: DataFrame, lexicon: str) -> DataFrame:
    """Rows with ``ids`` plus ``decoded``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(lambda batches: _decoded(lexicon, batches), f"{schema}, decoded string")


def encode_and_decode_digests(docs: DataFrame, lexicon: str) -> DataFrame:
    """``encode``, ``decode`` and digests of both in one pass: ``row, n_tokens, ids_sha256, decoded_sha256``."""
    rows, row = _rows(docs)
    return rows.mapInArrow(lambda batches: _digests(_decoded(lexicon, _encoded(lexicon, batches))), f"{row}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
