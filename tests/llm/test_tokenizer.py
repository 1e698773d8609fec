import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from sfumato.llm import tokenizer as tk

PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def model():
    return tk.bpe(f"{tk.DEFAULT_DIR}/{tk.BYTE_BPE_50K}")


def mine(texts):
    ids, n = tk.encode_texts(model(), pa.array(texts, pa.string()))
    e = np.concatenate(([0], np.cumsum(n)))
    return [ids[a:b].tolist() for a, b in zip(e, e[1:], strict=False)]


def theirs(library, texts):
    return [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="'strevlmdx  \n\tA1²é.,日", max_size=20))
def test_boundaries_are_those_of_the_pattern(text):
    cps = np.array([0x110000, *map(ord, text)], np.uint32)
    got = np.flatnonzero(tk.boundaries(cps)[1:]).tolist()
    assert got == [m.start() for m in PATTERN.finditer(text)]


def test_scan_is_associative():
    """Any split of the input into blocks with a carried state gives the same states."""
    rng = random.Random(3)
    cls = np.array([rng.randrange(tk._N_CLASS) for _ in range(3000)], np.uint8)
    whole, end = tk.scan_states(cls)
    state, parts, at = tk.S_START, [], 0
    while at < len(cls):
        step = rng.randint(1, 400)
        got, state = tk.scan_states(cls[at : at + step], state)
        parts.append(got)
        at += step
    assert np.array_equal(np.concatenate(parts), whole) and state == end
    s = tk.S_START
    for i, c in enumerate(cls.tolist()):
        assert whole[i] == s
        s = tk._step(s, c)


def test_random_texts_as_the_library(library):
    rng = random.Random(4)
    alphabet = "''''ssttrreevvllmmdd  \n\t aB12²½é.,!" + chr(0xA0) + chr(0x3000) + chr(0x85) + chr(0x1C) + "Ａ日本👩" + chr(0x200D) + chr(0x301)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    texts += ["", "<|endoftext|>", "a" * 5000, " " * 300 + "x", "=" * 1000, "Q" + "A" * 3000, "█" * 700, "don't we'll I'd ''s 'S"]
    assert mine(texts) == theirs(library, texts)


def test_every_code_point(library):
    texts = [f"a{chr(c)}b {chr(c)}1" for c in range(0x3100) if not 0xD800 <= c < 0xE000] + [chr(c) * 2 for c in range(0x3100, 0x110000, 331) if not 0xD800 <= c < 0xE000]
    assert mine(texts) == theirs(library, texts)


def test_long_slices(library):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["AB", "A", "theing", "=-", "█"]) * rng.choice([1, 2, 60]) for _ in range(40)) for _ in range(200)]
    assert mine(texts) == theirs(library, texts)


def test_block_borders(library, monkeypatch):
    text = "it's  we'll\n\n x1 'tis " * 20
    want = theirs(library, [text])
    for block in (1, 2, 3, 7):
        monkeypatch.setattr(tk, "BLOCK", block)
        assert mine([text]) == want


def test_cache_limit_has_no_effect(library, monkeypatch):
    monkeypatch.setattr(tk.Bpe, "CACHE", 3)
    texts = ["alpha beta gamma delta"] * 3
    assert [mine([t])[0] for t in texts] == theirs(library, texts)


def test_table_offsets_and_round_trip(spark, library):
    rows = [(1, "naïve café 👩"), (2, None), (3, ""), (3, ""), (4, "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 AS _id", "'y' AS _text", "2 AS ids")
    got = tk.encode(df, offsets=True)
    r = {x["doc_id"]: x for x in got.collect()}
    assert got.count() == 5 and r[2]["ids"] == r[3]["ids"] == [] and r[1]["ids"] == library.encode(rows[0][1]).ids
    assert r[1]["byte_ends"][-1] == len(rows[0][1].encode()) and len(r[1]["byte_ends"]) == len(r[1]["ids"])
    back = {x["doc_id"]: x["text"] for x in tk.decode(got).collect()}
    assert back == {1: rows[0][1], 2: "", 3: "", 4: rows[4][1]}
    assert {x["doc_id"]: x["tokens"] for x in tk.count_tokens(df).collect()} == {k: len(v["ids"]) for k, v in r.items()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert tk.encode(df).collect() == [] and tk.count_tokens(df).collect() == []


def test_monoid_is_small():
    assert len(tk._monoid()[3]) < 64
    with pytest.raises(FileNotFoundError):
        tk.bpe("/nowhere")
