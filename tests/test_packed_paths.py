"""One splitter of packed fields for all lengths: the same items as a plain state machine gives."""

import random

import pytest
from reference_split import split

from sfumato.operators import packed

MIXED = ["('a@1'),('b@2')", "'a@1'(x),\"b\"\"c\"(y)", '"a"",b', "'a'',b", "[x('a''b')]", '"a""",b', '1,"a"" b']
MORE = ['["a"]b', '"a"]b, c', 'x "a"]y', '"a]"]q', "[['1']z, 2]", '"x' + chr(0x85) + '"', '"" ""a "b', "'' ''a, '', 'b"]


def _check(spark, fields):
    df = spark.createDataFrame(list(enumerate(fields)), "id int, f string")
    got = {}
    for r in packed.split_packed(df, ["id"], "f").collect():
        got.setdefault(r["id"], []).append((r["pos"], r["item"]))
    for i, f in enumerate(fields):
        assert sorted(got.get(i, [])) == split(f), f


def test_mixed_parts_and_doubled_quotes(spark):
    _check(spark, MIXED + MORE)


def test_brackets_of_any_depth(spark):
    _check(spark, ["[[[1,2]]]", "[[[[1,2]]]]", "{([1,2])}", "[{([1] , 2)}]", "[[[1],[2]]]", "[[1],[2]],[[3]]", "[" * 50 + "1,2" + "]" * 50, "(([[{{ 1 2 }}]]))", "[(]),1", "[[[['a]',b]]]]"])


@pytest.mark.parametrize("alphabet", ["ab1@ ,;|/(\"'", "a1,['](", "1,[]", "a ,[](){}\"", "\"' a"])
def test_random_fields(spark, alphabet):
    rng = random.Random(11)
    _check(spark, ["".join(rng.choices(alphabet, k=rng.randint(1, 14))) for _ in range(3000)])


@pytest.mark.parametrize("length", [1_990, 2_000, 2_010])
def test_fields_either_side_of_any_length(spark, length):
    rng = random.Random(length)
    short = MIXED + MORE + ["".join(rng.choices("ab1@ ,;|/()[]\"'", k=12)) for _ in range(20)]
    _check(spark, [f + "," + "9," * ((length - len(f)) // 2) + "'z'" for f in short] + ["[" + "8 " * (length // 2) + f + "]" for f in short])


def test_long_fields_take_linear_time():
    n = 20_000
    assert packed.split_field("'a " * n) == [(k, "'a") for k in range(1, n + 1)]
    assert len(packed.split_field('"x,' * n + '""')) == n
    assert packed.split_field("[" * n + "1" + "]" * n) == [(1, "1")]
