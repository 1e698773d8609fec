"""Byte-level BPE encoding of whole corpora without a regular expression in the hot path.

Method: text is turned into an array of code-point classes; the pre-tokenizer is a finite automaton whose
transition functions form a small monoid, so the state before every code point comes from an associative
prefix scan over monoid elements (a few vectorised table look-ups, since nearly every element is a constant
function and constants absorb what is to their left).  The resulting slices are dictionary-encoded by Arrow and
only slices not seen before reach the pair-merging loop; ids (and byte offsets, for decoding) are then gathered
with array arithmetic.

Defined results: NULL and empty texts give the empty list; strings of special tokens are ordinary text; repeated
rows give repeated results; texts of any length are processed in blocks, whole.
"""

from __future__ import annotations

import base64
import heapq
import os
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files lie; every function takes the path as a parameter.
DEFAULT_DIR = os.environ.get("SFUMATO_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

# Code-point classes.  The letters that end a contraction have classes of their own.
OTHER, LETTER, NUMBER, BLANK, SPACE, QUOTE, CH_S, CH_T, CH_M, CH_D, CH_R, CH_E, CH_V, CH_L, RESET = range(15)
_N_CLASS = 15
_LETTERS = (LETTER, CH_S, CH_T, CH_M, CH_D, CH_R, CH_E, CH_V, CH_L)

# Automaton states: what the last code point was part of.
(S_START, S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_SPACE, S_QUOTE, S_QR, S_QV, S_QL, S_DONE) = range(11)
_N_STATE = 11

#: White space as the public pattern's \s has it (the Unicode property White_Space).
_WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Code points handled in one block of the scan.
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point; one entry past the last code point is the reset mark between texts."""
    table = np.zeros(0x110001, np.uint8)
    for cp in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(cp))[0]
        if major == "L":
            table[cp] = LETTER
        elif major == "N":
            table[cp] = NUMBER
    table[_WHITE] = SPACE
    table[0x20] = BLANK
    table[ord("'")] = QUOTE
    for ch, cls in zip("stmdrevl", (CH_S, CH_T, CH_M, CH_D, CH_R, CH_E, CH_V, CH_L), strict=True):
        table[ord(ch)] = cls
    table[0x110000] = RESET
    return table


def _step(state: int, cls: int) -> int:
    """The automaton's state after a code point of a class."""
    if cls == RESET:
        return S_START
    if cls == BLANK:
        return S_BLANK
    if cls == SPACE:
        return S_SPACE
    if cls == NUMBER:
        return S_NUMBER
    if cls == QUOTE:
        # After a blank the quote belongs to the blank's slice, and inside a run of other signs it opens nothing.
        # A quote that follows a quote at a slice's start is in that slice too.
        return S_OTHER if state in (S_BLANK, S_OTHER, S_QUOTE) else S_QUOTE
    if cls == OTHER:
        return S_OTHER
    if state == S_QUOTE:
        if cls in (CH_S, CH_T, CH_M, CH_D):
            return S_DONE
        return {CH_R: S_QR, CH_V: S_QV, CH_L: S_QL}.get(cls, S_LETTER)
    if (state, cls) in ((S_QR, CH_E), (S_QV, CH_E), (S_QL, CH_L)):
        return S_DONE
    return S_LETTER


def _begins(state: int, cls: int, after: int) -> bool:
    """Whether a slice begins at a code point of class cls, given the state before it and the class after it."""
    if cls == RESET or state == S_START:
        return True
    if cls in (BLANK, SPACE):
        # A run of white space begins a slice; so does its last code point when something visible follows.
        return state not in (S_BLANK, S_SPACE) or after not in (BLANK, SPACE, RESET)
    if state == S_BLANK:
        return False
    if state in (S_SPACE, S_DONE):
        return True
    if cls in _LETTERS:
        if state == S_QUOTE:
            if cls in (CH_S, CH_T, CH_M, CH_D):
                return False
            return (cls, after) not in ((CH_R, CH_E), (CH_V, CH_E), (CH_L, CH_L))
        if (state, cls) in ((S_QR, CH_E), (S_QV, CH_E), (S_QL, CH_L)):
            return False
        return state not in (S_LETTER, S_QR, S_QV, S_QL)
    if cls == NUMBER:
        return state != S_NUMBER
    return state not in (S_OTHER, S_QUOTE)


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, composition table, constant?, images of the elements, begin table)."""
    gens = [tuple(_step(s, c) for s in range(_N_STATE)) for c in range(_N_CLASS)]
    elements = dict.fromkeys(gens)
    queue = list(elements)
    while queue:  # closure under composition
        f = queue.pop()
        for g in gens:
            if (h := tuple(g[x] for x in f)) not in elements:
                elements[h] = None
                queue.append(h)
    order = list(elements)
    index = {f: i for i, f in enumerate(order)}
    n = len(order)
    if n > 255:
        raise AssertionError("the transition monoid no longer fits a byte")
    compose = np.array([[index[tuple(g[x] for x in f)] for g in order] for f in order], np.uint8)
    constant = np.array([len(set(f)) == 1 for f in order])
    images = np.array(order, np.uint8)
    begins = np.array(
        [[[_begins(s, c, a) for a in range(_N_CLASS)] for c in range(_N_CLASS)] for s in range(_N_STATE)], bool
    )
    return np.array([index[g] for g in gens], np.uint8), compose.ravel(), constant, images, begins.ravel()


def scan_states(cls: np.ndarray, start: int = S_START) -> tuple[np.ndarray, int]:
    """State before each code point and after the last: inclusive associative scan by doubling steps.

    After the step of width w element i holds the composition of the 2w transition functions up to i.  It stops as
    soon as every element is constant, which for real text is after the first few steps.
    """
    of_class, compose, constant, images, _ = _monoid()
    n = len(of_class)
    if not len(cls):
        return np.zeros(0, np.uint8), start
    size = len(images)
    acc = of_class[cls]
    # The prefix's own state enters as a constant function at the front.
    acc[0] = next(i for i in range(size) if constant[i] and images[i][0] == images[acc[0]][start])
    width = 1
    while width < len(acc):
        todo = np.flatnonzero(~constant[acc])  # constants have nothing to gain from what is on their left
        todo = todo[todo >= width]
        if not len(todo):
            break
        acc[todo] = compose[acc[todo - width].astype(np.intp) * size + acc[todo]]
        width *= 2
    del n
    after = images[acc, 0]
    before = np.empty(len(cls), np.uint8)
    before[0] = start
    before[1:] = after[:-1]
    return before, int(after[-1])


def boundaries(cps: np.ndarray) -> np.ndarray:
    """Mask of the code points that begin a slice; cps may hold several texts, each preceded by 0x110000."""
    table = class_table()
    begins = _monoid()[4]
    out = np.empty(len(cps), bool)
    state = S_START
    for at in range(0, len(cps), BLOCK):
        ahead = table[cps[at : at + BLOCK + 1]]
        cls = ahead[:BLOCK]
        before, state = scan_states(cls, state)
        after = np.full(len(cls), RESET, np.uint8)
        after[: len(ahead) - 1] = ahead[1 : len(cls) + 1]
        out[at : at + len(cls)] = begins[(before.astype(np.intp) * _N_CLASS + cls) * _N_CLASS + after]
    return out


class Bpe:
    """Pair merging over a rank file (base64 token and rank per line), cached by slice."""

    #: Slices remembered; beyond it the cache starts anew.  It bounds memory and has no effect on results.
    CACHE = 400_000

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self._byte = [self.ranks[bytes([b])] for b in range(256)]
        self._pair: dict[tuple[int, int], int] = {}
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def _rank(self, a: int, b: int) -> int:
        """Rank of the merge of two tokens, -1 if they don't merge."""
        key = (a, b)
        r = self._pair.get(key)
        if r is None:
            if len(self._pair) > 2_000_000:
                self._pair.clear()
            r = self._pair[key] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return r

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one slice: the pair of lowest rank, leftmost first, merges until none is left."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        ids = [self._byte[b] for b in piece]
        if len(ids) > 48:
            return self._merge_long(ids)
        rank = self._rank
        pairs = [rank(a, b) for a, b in zip(ids, ids[1:], strict=False)]
        top = 1 << 60
        while pairs:
            best, at = top, -1
            for i, r in enumerate(pairs):
                if -1 < r < best:
                    best, at = r, i
            if at < 0:
                break
            ids[at : at + 2] = [best]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(ids[at - 1], best)
            if at < len(pairs):
                pairs[at] = rank(best, ids[at + 1])
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same for slices of any length: by arrays while they are runs, then by heap and linked list."""
        ids = self._merge_frequent(np.array(ids, np.int64)).tolist()
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self._rank(ids[i], ids[i + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (x := self._rank(r, ids[k])) >= 0:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            if (h := left[i]) >= 0 and (x := self._rank(ids[h], r)) >= 0:
                heapq.heappush(heap, (x, h, ids[h], r))
        return tuple(x for x in ids if x >= 0)

    def _merge_frequent(self, ids: np.ndarray) -> np.ndarray:
        """Merge all places of the best pair at once, as long as a slice has few different pairs (long runs)."""
        while len(ids) > 48:
            keys = (ids[:-1] << 32) | ids[1:]
            pairs, which = np.unique(keys, return_inverse=True)
            if len(pairs) * 16 > len(keys):
                break
            ranks = [self._rank(int(k) >> 32, int(k) & 0xFFFFFFFF) for k in pairs]
            good = [(r, i) for i, r in enumerate(ranks) if r >= 0]
            if not good:
                break
            best, i = min(good)
            at = np.flatnonzero(which == i)
            # In a run of touching places every second one merges, from the left.
            fresh = np.concatenate(([True], np.diff(at) > 1))
            run_start = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
            at = at[(at - run_start) % 2 == 0]
            ids[at] = best
            ids = np.delete(ids, at + 1)
        return ids

    def encode_slices(self, slices: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into the distinct slices, length of each distinct one's ids, their ids end to end)."""
        coded = slices.dictionary_encode()
        if len(self.cache) > self.CACHE:
            self.cache.clear()
        cache, merge, found = self.cache, self.merge, []
        for piece in coded.dictionary.to_pylist():
            ids = cache.get(piece)
            if ids is None:
                ids = merge(piece)
                if len(piece) <= 64:
                    cache[piece] = ids
            found.append(ids)
        lens = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((x for ids in found for x in ids), np.int32, int(lens.sum()))
        return coded.indices.to_numpy(), lens, flat


@lru_cache(maxsize=4)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def _gather(idx: np.ndarray, lens: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of the id lists of idx, and the length of each."""
    first = np.concatenate(([0], np.cumsum(lens)[:-1])) if len(lens) else lens
    n = lens[idx]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    pos = np.arange(total, dtype=np.int64) + np.repeat(first[idx] - (ends - n), n)
    return flat[pos], n


def encode_texts(model: Bpe, texts: pa.Array, counts_only: bool = False):
    """(ids end to end or None, number of ids of each text, byte length of each id's token or None)."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    texts = texts.fill_null(b"")
    rows = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + rows + 1]
    lo, hi = (int(offsets[0]), int(offsets[-1])) if rows else (0, 0)
    if hi == lo:
        return (None if counts_only else np.zeros(0, np.int32)), np.zeros(rows, np.int64)
    data = texts.buffers()[2].slice(lo, hi - lo)
    raw = np.frombuffer(data, np.uint8)
    cps = np.frombuffer(bytes(data).decode("utf-8").encode("utf-32-le"), np.uint32)
    # Places of code points in bytes, and of texts in code points.
    at = np.flatnonzero((raw & 0xC0) != 0x80) if len(cps) != len(raw) else np.arange(len(raw))
    doc_cp = np.searchsorted(at, offsets - lo)
    filled = np.flatnonzero(doc_cp[1:] > doc_cp[:-1])
    marked = np.insert(cps, doc_cp[filled], 0x110000)
    keep = np.ones(len(marked), bool)
    keep[doc_cp[filled] + np.arange(len(filled))] = False
    starts = np.flatnonzero(boundaries(marked)[keep])
    edges = np.append(at[starts], len(raw))
    slices = pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int32)), data]
    )  # blocks are far below 2 GB
    idx, lens, flat = model.encode_slices(slices)
    per_doc = np.searchsorted(starts, doc_cp)
    n = lens[idx]
    ends = np.concatenate(([0], np.cumsum(n)))
    counts = ends[per_doc[1:]] - ends[per_doc[:-1]]
    if counts_only:
        return None, counts
    return _gather(idx, lens, flat)[0], counts


def _blocks(texts: pa.Array, limit: int = 4 << 20):
    """(first row, rows) of blocks of about limit bytes; a longer text is a block of its own."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield at, stop - at
        at = stop


def encode(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "ids",
    vocab: str = BYTE_BPE_50K, directory: str = DEFAULT_DIR, offsets: bool = False,
) -> DataFrame:
    """Ids of each text; with offsets also ``byte_ends``, the end of each id's bytes in the text, for decoding slices.

    NULL and empty texts give the empty list.  Only the id and the text are read; other columns, whatever their
    names, don't take part.
    """
    path = os.path.join(directory, vocab)
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    id_type = src.schema["_id"].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField(out_col, T.ArrayType(T.IntegerType(), False))])
    if offsets:
        schema.add("byte_ends", T.ArrayType(T.LongType(), False))

    def run(batches):
        model = bpe(path)
        width = None
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at, rows in _blocks(texts):
                part = texts.slice(at, rows)
                ids, counts = encode_texts(model, part)
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                cols = [keys.slice(at, rows), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))]
                if offsets:
                    if width is None:
                        width = np.zeros(max(model.tokens) + 1, np.int64)
                        for i, t in model.tokens.items():
                            width[i] = len(t)
                    run_ends = np.cumsum(width[ids]) if len(ids) else np.zeros(0, np.int64)
                    base = np.concatenate(([0], run_ends))[ends[:-1]]
                    local = run_ends - np.repeat(base, counts)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(local, pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(run, schema)


def count_tokens(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "tokens",
    vocab: str = BYTE_BPE_50K, directory: str = DEFAULT_DIR,
) -> DataFrame:
    """Number of ids of each text, without making the ids; 0 for NULL and empty texts."""
    path = os.path.join(directory, vocab)
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([T.StructField(id_col, src.schema["_id"].dataType), T.StructField(out_col, T.LongType())])

    def run(batches):
        model = bpe(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at, rows in _blocks(texts):
                _, counts = encode_texts(model, texts.slice(at, rows), counts_only=True)
                yield pa.RecordBatch.from_arrays([keys.slice(at, rows), pa.array(counts, pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)


def decode(
    df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", out_col: str = "text",
    vocab: str = BYTE_BPE_50K, directory: str = DEFAULT_DIR,
) -> DataFrame:
    """Texts of id lists; the empty list and NULL give the empty text.  Bytes that aren't UTF-8 become U+FFFD."""
    path = os.path.join(directory, vocab)
    src = df.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    schema = T.StructType([T.StructField(id_col, src.schema["_id"].dataType), T.StructField(out_col, T.StringType())])

    def run(batches):
        tokens = bpe(path).tokens
        for batch in batches:
            texts = [
                b"".join(map(tokens.__getitem__, ids or ())).decode("utf-8", "replace")
                for ids in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)
