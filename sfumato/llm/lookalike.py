"""One consistent form for texts that look the same but are stored as different characters.

Two steps, both functions of a text's look alone, so that equal looks give equal texts, whatever else the corpus holds:

1. The table: letters with a Latin shape to Latin, width variants to their plain form, blanks to the space, line ends to a
   line feed, ignorables to nothing; the result is composed (NFC).  Two texts look the same if this form is the same.
2. The spelling of letter runs that aren't plain ASCII.  A trie of canonical spellings is traversed by an automaton with
   weighted edits: a look-alike of the wanted letter and an ignorable cost nothing, any other edit costs 1, and the budget is 0
   unless a caller raises it.  A run that ends on a word takes that word's spelling.  Others go by the table: where all
   letters that belong to one script only are of the same script and it has a letter for each other shape, the run is spelled
   in that script, so words of one script keep it; mixed runs stay in the first step's form.  The trie decides what no letter
   of a run gives away (a Cyrillic word all of whose letters, but for their accents, look Latin).

The trie's words are the one-script words of a published, fixed vocabulary (a public tokenizer's, whose path is a parameter),
at most as many as it has entries.  Runs that look like ASCII take ASCII: their look is that of a Latin word.

Kept as visible differences: case, accents, raised, lowered and circled digits, fractions, mathematical alphabets, dashes
longer than a hyphen, number and kind of blanks' line ends apart, joiners between pictures and in scripts that join.
Defined results: NULL stays NULL, empty and blank texts are normalised like others; texts of any length are processed
whole; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import re
import string
import unicodedata
from collections import OrderedDict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts (and forms of Latin ones) with the shape of a Latin letter, beside the Latin letter.  Fixed values.
# Letters of one script that share a shape are left out, but for the rarer one of a pair, which stands after the usual one.
_SHAPES = {
    "АВЕКМНОРСТХЅІЈԌԚԜҮӀаеорсухѕіјһԁԛԝӏѵ": "ABEKMHOPCTXSIJGQWYIaeopcyxsijhdqwlv",  # Cyrillic
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳν": "ABEZHIKMNOPTYXocjv",  # Greek
    "ՕՏՍօս": "OSUou",  # Armenian
    "ᎠᎢᎪᎫᎬᎷᎻᏃᏙᏞᏟᏢᏦᏴ": "DTAJEMHZVLCPKB",  # Cherokee
    "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ": "BPDTGKJCZFMNLSRVHWXYAEIOU",  # Lisu
    "ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ": "HIKMNOPCTYXopc",  # Coptic
    "ɑɡᴄᴏᴜᴠᴡᴢꜱ": "agcouvwzs",  # Latin
    "․": ".",
}
#: Compatibility forms that look like their plain form; others (super, sub, circle, font, fraction) look different.
_PLAIN = ("<wide>", "<narrow>", "<small>", "<noBreak>")
# Ligatures and letters that are drawn as several plain letters or like one.  Fixed values.
_JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "ǆ": "dž", "ǉ": "lj", "ǌ": "nj", "µ": "μ"}
_ROMAN = range(0x2160, 0x2180)
#: Characters without a look of their own; joiners are treated apart.
IGNORABLE = frozenset(map(chr, [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180F), 0x200B, 0x200E, 0x200F,
                                *range(0x2060, 0x2065), *range(0x206A, 0x2070), *range(0xFE00, 0xFE0E), 0xFEFF]))
_JOINERS = chr(0x200C) + chr(0x200D)
_LINE_END = re.compile("\r\n?|[" + chr(0x85) + chr(0x2028) + chr(0x2029) + "]")
# A joiner shows after a letter of a script that joins, and between pictures (a variation selector may follow the first).
_JOINS_AFTER = "".join(chr(a) + "-" + chr(b) for a, b in ((0x600, 0x8FF), (0x900, 0x109F), (0x1780, 0x180A), (0x1810, 0x18AF)))
_PICTURE = "".join(chr(a) + "-" + chr(b) for a, b in ((0x2190, 0x2BFF), (0x1F000, 0x1FAFF)))
_JOINER = re.compile(f"(?<![{_JOINS_AFTER}{_PICTURE}{chr(0xFE0F)}])[{_JOINERS}]+|(?<=[{_PICTURE}{chr(0xFE0F)}])[{_JOINERS}]+(?![{_PICTURE}{_JOINERS}])")


@lru_cache(maxsize=1)
def table() -> dict[int, str]:
    """What each code point is drawn like, for those that have another plain form; ignorables map to nothing."""
    out: dict[int, str] = {}
    for cp in range(0x80, 0x20000):
        ch = chr(cp)
        kind = unicodedata.decomposition(ch)
        if unicodedata.category(ch) == "Zs":
            out[cp] = " "
        elif kind.startswith(_PLAIN) or cp in _ROMAN and kind.startswith("<compat>"):
            out[cp] = unicodedata.normalize("NFKC", ch)
    out.update({ord(k): v for k, v in _JOINED.items()})
    for a, b in _SHAPES.items():
        out.update({ord(x): y for x, y in zip(a, b, strict=True)})
    out |= {0x2010: "-", 0x2011: "-", **dict.fromkeys(map(ord, IGNORABLE), "")}
    # A width variant of a letter with a shape, and composed letters over such a letter.
    for cp in range(0x80, 0x20000):
        if cp not in out:
            parts = unicodedata.normalize("NFD", chr(cp))
            if (drawn := unicodedata.normalize("NFC", "".join(out.get(ord(x), x) for x in parts))) != chr(cp):
                out[cp] = drawn
    return out


def skeleton(text: str) -> str:
    """The table's form of a text: equal for equal looks.

    Ignorables go first, since they may stand between a letter and its mark, or within a line end.
    """
    if text.isascii():
        return _LINE_END.sub("\n", text) if "\r" in text else text
    parts = _WIDE.sub(_drawn, text)
    return unicodedata.normalize("NFC", _LINE_END.sub("\n", _JOINER.sub("", parts)))


_WIDE = re.compile("[^\x00-\x7f]+")


def _drawn(match: re.Match) -> str:
    """A span without ASCII by the table; short spans recur and are remembered."""
    return _drawn_short(match[0]) if len(match[0]) <= 24 else unicodedata.normalize("NFD", match[0]).translate(table())


@lru_cache(maxsize=100_000)
def _drawn_short(span: str) -> str:
    return unicodedata.normalize("NFD", span).translate(table())


_SCRIPTS = ("CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "LISU", "COPTIC")


def script(letter: str) -> str:
    """The first word of a letter's name."""
    return unicodedata.name(letter, "").partition(" ")[0]


@lru_cache(maxsize=1)
def inverse() -> dict[str, dict[int, str]]:
    """By script: each Latin letter that one of its letters looks like, with that letter."""
    out: dict[str, dict[int, str]] = {}
    for a, b in _SHAPES.items():
        if script(a[0]) in _SCRIPTS:
            out[script(a[0])] = {ord(y): x for x, y in reversed(list(zip(a, b, strict=True)))}
    return out


def in_script(run: str) -> str | None:
    """The run of a skeleton spelled in the one script its letters leave open; None if they leave none."""
    parts = unicodedata.normalize("NFD", run)
    own = {script(c) for c in parts if not c.isascii() and not unicodedata.combining(c)}
    back = inverse().get(next(iter(own))) if len(own) == 1 else None
    if back is None or not all(ord(c) in back for c in parts if c.isascii()):
        return None
    return unicodedata.normalize("NFC", parts.translate(back))


class Trie:
    """Canonical spellings, traversed by the edit automaton."""

    def __init__(self, words: dict[str, int]):
        """words: spelling and its count.  Of spellings that look the same the most frequent, then the least, is canonical."""
        self.next: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        taken: set[str] = set()
        for w in sorted(words, key=lambda w: (-words[w], w)):
            sk = skeleton(w)
            if sk.isascii() or sk in taken:
                continue
            taken.add(sk)
            node = 0
            for ch in unicodedata.normalize("NFD", w):
                if ch not in self.next[node]:
                    self.next[node][ch] = len(self.next)
                    self.next.append({})
                    self.word.append(None)
                node = self.next[node][ch]
            self.word[node] = w

    def find(self, run: str, budget: int = 0) -> str | None:
        """The word reached by a run at a cost within the budget; the cheapest, then the first in order.

        Costs: 0 for the letter itself, a look-alike, or an ignorable left out; 1 for a letter replaced, added or left out.
        """
        alive = {0: 0}
        drawn = table()
        marks = unicodedata.normalize("NFD", run)
        # Ligatures and width variants are read as the letters they are drawn as.
        letters = "".join(x if len(drawn.get(ord(x), x)) <= 1 else drawn[ord(x)] for x in marks)
        for ch in letters:
            look = drawn.get(ord(ch), ch)
            if look == "" or ch in _JOINERS:
                continue
            then: dict[int, int] = {}
            for node, cost in alive.items():
                for edge, to in self.next[node].items():
                    c = cost + (edge != ch and drawn.get(ord(edge), edge) != look)
                    if c <= budget and c < then.get(to, budget + 1):
                        then[to] = c
                if budget and cost < budget and cost + 1 < then.get(node, budget + 1):
                    then[node] = cost + 1
            if budget:  # letters of the word left out of the run
                queue = list(then)
                while queue:
                    node = queue.pop()
                    for to in self.next[node].values():
                        if then[node] + 1 < then.get(to, budget + 1):
                            then[to] = then[node] + 1
                            queue.append(to)
            if not then:
                return None
            alive = then
        ends = [(cost, self.word[node]) for node, cost in alive.items() if self.word[node] is not None]
        return min(ends)[1] if ends else None


# A letter run of the scripts with look-alikes from its first letter that isn't ASCII, in a skeleton.
_OTHER = "".join(chr(a) + "-" + chr(b) for a, b in (
    (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x370, 0x3FF), (0x400, 0x481), (0x48A, 0x52F), (0x531, 0x556), (0x561, 0x587), (0x13A0, 0x13FF), (0x1E00, 0x1FFF), (0x2C80, 0x2CFF),
    (0xA4D0, 0xA4F7)))
_MARKS = chr(0x300) + "-" + chr(0x36F) + chr(0x483) + "-" + chr(0x487)
_RUN = re.compile(f"[{_OTHER}{_MARKS}][A-Za-z{_OTHER}{_MARKS}]*")
_ASCII_LETTERS = frozenset(string.ascii_letters)


class Normalizer:
    """Texts to their consistent form; spellings of runs are remembered."""

    CACHE = 300_000

    def __init__(self, words: dict[str, int], budget: int = 0):
        """budget above 0 also takes runs to the nearest word within that many visible edits."""
        self.trie, self.budget = Trie(words), budget
        self.cache: OrderedDict[str, str] = OrderedDict()

    def spell(self, run: str) -> str:
        out = self.cache.get(run)
        if out is None:
            out = self.trie.find(run, self.budget) or in_script(run) or run
            if len(self.cache) >= self.CACHE:
                self.cache.popitem(last=False)
            if len(run) <= 64:
                self.cache[run] = out
        return out

    def text(self, text: str) -> str:
        look = skeleton(text)
        if look.isascii():
            return look
        out, at = [], 0
        for m in _RUN.finditer(look):
            first = m.start()
            while first > at and look[first - 1] in _ASCII_LETTERS:
                first -= 1
            out += (look[at:first], self.spell(look[first : m.end()]))
            at = m.end()
        return unicodedata.normalize("NFC", "".join((*out, look[at:])))


def visible(text: str) -> bool:
    """Whether anything is drawn: something besides blanks and ignorables."""
    return bool(text) and not text.isspace()


#: A public tokenizer's vocabulary (base64 token and rank a line), from which the canonical spellings come.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def public_words(path: str = VOCABULARY) -> dict[str, int]:
    """The vocabulary's tokens of two or more letters of one script with Latin look-alikes; greater is more usual."""
    out: dict[str, int] = {}
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            try:
                word = unicodedata.normalize("NFC", base64.b64decode(token).decode("utf-8").strip(" "))
            except UnicodeDecodeError:
                continue
            if len(word) > 1 and not word.isascii() and word.isalpha() and len(own := {script(c) for c in word}) == 1 and own <= set(_SCRIPTS):
                out.setdefault(word, -int(rank))
    return out


def normalize(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "text", words: dict[str, int] | None = None) -> DataFrame:
    """id and the text in its consistent form."""
    words = public_words() if words is None else words
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([T.StructField(id_col, src.schema["_id"].dataType), T.StructField(out_col, T.StringType())])
    shared = df.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        norm = Normalizer(shared.value)
        for batch in batches:
            texts = [None if t is None else norm.text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)


def look_keys(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: dict[str, int] | None = None) -> DataFrame:
    """id, look (digest of the consistent form) and stored (digest of the text as stored), of texts with something visible."""
    words = public_words() if words is None else words
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where(F.col("_text").isNotNull())
    schema = T.StructType([
        T.StructField(id_col, src.schema["_id"].dataType), T.StructField("look", T.BinaryType()), T.StructField("stored", T.BinaryType())])
    shared = df.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        norm = Normalizer(shared.value)
        digest = lambda t: hashlib.blake2b(t.encode("utf-8"), digest_size=16).digest()
        for batch in batches:
            ids, look, stored = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                same = norm.text(t)
                if visible(same):
                    ids.append(i)
                    stored.append(digest(t))
                    look.append(stored[-1] if same == t else digest(same))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.column(0).type), pa.array(look, pa.binary()), pa.array(stored, pa.binary())], names=schema.names
            )

    return src.mapInArrow(run, schema)


def look_classes(keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Members of the classes of equal look that hold more than one stored form.

    The classes are counted with map-side combining, so a class of a third of all rows is a few rows when it's shuffled.
    """
    mixed = keys.groupBy("look").agg(F.min("stored").alias("a"), F.max("stored").alias("b")).where(F.col("a") != F.col("b")).select("look")
    return keys.join(mixed, "look", "left_semi")


def look_pairs(keys: DataFrame, id_col: str = "doc_id", salts: int = 8) -> DataFrame:
    """All pairs of ids with the same look and different stored forms, as the result's definition asks for.

    An equi-join on the class; one side is salted by id and the other repeated, so that a large class is shared out.
    """
    members = look_classes(keys, id_col).select(id_col, "look", "stored").distinct()
    a = members.select(F.col(id_col).alias(f"{id_col}_a"), "look", F.col("stored").alias("stored_a"), F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int").alias("salt"))
    b = members.select(F.col(id_col).alias(f"{id_col}_b"), "look", F.col("stored").alias("stored_b"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return (
        a.join(b, ["look", "salt"])
        .where((F.col("stored_a") != F.col("stored_b")) & (F.col(f"{id_col}_a") < F.col(f"{id_col}_b")))
        .select(f"{id_col}_a", f"{id_col}_b")
    )


def representatives(keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """look, stored, the smallest id of each stored form and its number of copies, for classes of several forms."""
    return look_classes(keys, id_col).groupBy("look", "stored").agg(F.min(id_col).alias("representative"), F.count(F.lit(1)).alias("copies"))
