import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from sfumato.llm import lookalike as la

C = chr
WORDS = {"система": 5, "мир": 3, "ещё": 2, "μια": 2}
NORM = la.Normalizer(WORDS)
SAME = [
    ("paypal", C(0x440) + C(0x430) + "ypal"), ("system", "s" + C(0x443) + "stem"), ("caf" + C(0xE9), "cafe" + C(0x301)), ("ABC 12", C(0xFF21) + C(0xFF22) + "C" + C(0xA0) + "1" + C(0xFF12)),
    ("final", C(0xFB01) + "nal"), ("word", "wo" + C(0x200B) + C(0xAD) + "rd" + C(0xFEFF)), ("a-b", "a" + C(0x2011) + "b"), ("3 K" + C(0x3A9), "3 " + C(0x212A) + C(0x2126)),
    ("система", "cиcтeмa"), ("ещё", "eщ" + C(0xEB)), ("a\nb", "a\r\nb"), ("a b", "a" + C(0x3000) + "b"), (C(0x3BC), C(0xB5)), ("x y", "x" + C(0x2007) + "y"),
    ("foo_bar", "foo" + C(0xFF3F) + "bar"), ("TODO", C(0x422) + C(0x555) + "D" + C(0x39F)), (C(0x3067), C(0x3066) + C(0x3099)), ("{x}", C(0xFF5B) + "x" + C(0xFF5D)),
]
DIFFERENT = [
    ("a", "A"), ("e", C(0xE9)), ("2", C(0xB2)), ("3", C(0x2462)), ("n", C(0xF1)), ("a b", "a  b"), ("a-b", "a" + C(0x2013) + "b"), ("word", "work"), ("1", "l"),
    (C(0x1F469) + C(0x1F52C), C(0x1F469) + C(0x200D) + C(0x1F52C)), (C(0x435), C(0x451)), ("o", "0"), ("1/2", C(0xBD)), (C(0x3B1), C(0x1D6FC)), ("a\nb", "a\n\nb"),
]


def test_same_looks_give_the_same_text():
    for a, b in SAME:
        assert NORM.text(a) == NORM.text(b), (a, b)
        assert la.Normalizer({}).text(a) == la.Normalizer({}).text(b), (a, b)


def test_different_looks_stay_different():
    for a, b in DIFFERENT:
        assert NORM.text(a) != NORM.text(b), (a, b)


def test_canonical_spelling_comes_from_the_vocabulary():
    assert NORM.text("cиcтeмa мuр") == "система " + la.skeleton("мuр")
    assert NORM.text("paypal") == NORM.text(C(0x440) + "aypal") == "paypal"
    assert NORM.text("x=cиcтeмa_1") == "x=система_1"


def test_trie_costs():
    t = la.Trie(WORDS)
    assert t.find("cиcтeмa") == "система" and t.find("cиcт" + C(0x200B) + "eмa") == "система"
    assert t.find("системы") is None and t.find("системы", 1) == "система" and t.find("систма", 1) == "система" and t.find("сиистема", 1) == "система"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcopsxi -_1\n") + list("асеорхі") + [C(0x3BF), C(0xFF41), C(0x200B), C(0x301), C(0xA0), C(0xFB01), C(0x200D), C(0x1F469)]), max_size=12))
def test_idempotent_and_composed(text):
    once = NORM.text(text)
    assert NORM.text(once) == once and unicodedata.normalize("NFC", once) == once


def test_table_queries(spark):
    a, b = C(0x440) + "aypal", "paypal"
    rows = [(1, a), (2, b), (3, b), (4, None), (5, ""), (6, " \n"), (7, C(0x200B)), (8, C(0xA0)), (9, "Paypal"), (10, b + C(0x200B)), (10, b + C(0x200B)), (11, "x" * 200_000 + C(0x430)), (12, "x" * 200_000 + "a")]
    df = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 AS look", "2 AS stored", "3 AS _text")
    keys = la.look_keys(df)
    got = {(r["doc_id_a"], r["doc_id_b"]) for r in la.look_pairs(keys).collect()}
    assert got == {(1, 2), (1, 3), (1, 10), (2, 10), (3, 10), (11, 12)}
    reps = la.representatives(keys).collect()
    assert sorted((r["representative"], r["copies"]) for r in reps) == [(1, 1), (2, 2), (10, 2), (11, 1), (12, 1)]
    text = {r["doc_id"]: r["text"] for r in la.normalize(df).collect()}
    assert text[1] == text[10] == b and text[4] is None and text[5] == "" and text[6] == " \n"


def test_public_words_are_fixed_and_of_one_script():
    words = la.public_words()
    assert len(words) > 2000 and all(len(w) > 1 and len({la.script(c) for c in w}) == 1 for w in words)
    norm = la.Normalizer(words)
    # Words of one script keep it, in the vocabulary or not, unless every letter looks Latin.
    for text in ("Простая проверка редкого слова Вжсторопь", "Καλημέρα σε όλους τους ανθρώπους", "Җәһәннәм һәм ұзақ", "Արագ շուն", "ᎠᏓᎾ", "её мнение"):
        assert norm.text(text) == text
    assert norm.text("сосед сор") == "сосед cop"


def test_the_form_depends_on_the_text_alone(spark):
    rare = "вжсторопь cтopoнa"
    for texts in ([rare], [rare] * 3, [rare, "другой сторона", None, ""]):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
        assert la.normalize(df).where("doc_id = 0").head()["text"] == "вжсторопь сторона"


def test_line_ends_and_joiners():
    norm = la.Normalizer(la.public_words())
    for a, b in [
        ("a\nb", "a\r" + C(0x200B) + C(0xFEFF) + "\nb"), ("a\n\nb", "a\r\n\rb"), ("a\nb", "a\r" + C(0x200D) + "\nb"), (C(0x1F642) + " x", C(0x1F642) + C(0x200D) + " x"),
        ("e" + C(0x301), "e" + C(0x200B) + C(0x301)), ("файл_имя", "файл" + C(0xFF3F) + "имя"), ("и.", "и" + C(0x2024)),
    ]:
        assert norm.text(a) == norm.text(b), (a, b)
    kept = C(0x645) + C(0x200C) + C(0x6CC)
    assert norm.text(kept) == kept


def test_planted_pairs_of_another_make():
    """Disguises drawn from the character database's names, apart from the operator's table; recall and precision are whole."""
    rng = random.Random(5)
    named = lambda n: unicodedata.lookup(n)
    swaps = {c: [named(f"FULLWIDTH LATIN SMALL LETTER {c.upper()}")] for c in "abcdefghijklmnopqrstuvwxyz"}
    swaps |= {c: [named(f"FULLWIDTH LATIN CAPITAL LETTER {c}")] for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {str(d): [chr(0xFF10 + d)] for d in range(10)}
    for c, n in {"a": "A", "e": "IE", "o": "O", "c": "ES", "p": "ER", "x": "HA", "y": "U", "s": "DZE", "i": "BYELORUSSIAN-UKRAINIAN I", "j": "JE"}.items():
        swaps[c].append(named(f"CYRILLIC SMALL LETTER {n}"))
    for c, n in {"A": "ALPHA", "B": "BETA", "E": "EPSILON", "H": "ETA", "I": "IOTA", "K": "KAPPA", "M": "MU", "N": "NU", "O": "OMICRON", "P": "RHO", "T": "TAU", "X": "CHI", "Y": "UPSILON", "Z": "ZETA"}.items():
        swaps[c].append(named(f"GREEK CAPITAL LETTER {n}"))
    swaps[" "] = [named("NO-BREAK SPACE"), named("IDEOGRAPHIC SPACE"), named("FIGURE SPACE")]
    nothing = [named("ZERO WIDTH SPACE"), named("SOFT HYPHEN"), named("WORD JOINER"), named("ZERO WIDTH NON-JOINER"), named("ZERO WIDTH NO-BREAK SPACE")]
    norm = la.Normalizer(la.public_words())
    base = "The model KPI fits 10 windows; Exact values stay.\nНовая строка и ещё одна: Όμορφη μέρα café naïve.\nLast"
    for _ in range(500):
        text = "".join(rng.choice(swaps.get(c, [c])) if rng.random() < 0.3 else c for c in base)
        text = unicodedata.normalize(rng.choice(("NFC", "NFD")), text).replace("\n", rng.choice(("\n", "\r\n", "\r")))
        text = "".join(c + rng.choice(nothing) if rng.random() < 0.2 else c for c in text)
        assert norm.text(text) == norm.text(base)
        at = rng.choice([i for i, c in enumerate(text) if c.isascii() and c.isalpha()])
        other = rng.choice([c for c in "bdfghklmqrtuvwz" if c != text[at]])
        assert norm.text(text[:at] + other + text[at + 1 :]) != norm.text(base)
