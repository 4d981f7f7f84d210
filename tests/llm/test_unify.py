from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.unify import canonical_words, consistent, folded, oddities, unify


ZW, NB, SHY, ZWJ, WJ, BOM = chr(0x200B), chr(0xA0), chr(0xAD), chr(0x200D), chr(0x2060), chr(0xFEFF)
MAN, LAPTOP, HEART, VS = chr(0x1F468), chr(0x1F4BB), chr(0x2764), chr(0xFE0F)
CASES = {
    "plain text": ("plain text", []),
    chr(0xFF21) + chr(0xFF42): ("Ab", ["wide"]),
    chr(0xFB01) + "ne": ("fine", ["wide"]),
    "cafe" + chr(0x301): ("caf" + chr(0xE9), ["decomposed"]),
    "x" + chr(0x32F) : ("x" + chr(0x32F), []),  # no single-character form
    "caf" + chr(0xE9) + " stra" + chr(0xDF) + "e": ("caf" + chr(0xE9) + " stra" + chr(0xDF) + "e", []),
    f"a{ZW}b{SHY}c{WJ}d{BOM}": ("abcd", ["invisible"]),
    f"{MAN}{ZWJ}{LAPTOP}": (f"{MAN}{ZWJ}{LAPTOP}", []),
    f"{HEART}{VS}{ZWJ}{MAN}": (f"{HEART}{VS}{ZWJ}{MAN}", []),
    f"a{ZWJ}b": ("ab", ["invisible"]),
    f"a{NB}b{chr(0x3000)}c": ("a b c", ["space"]),
    "a\tb\nc": ("a\tb\nc", []),
    "a" + chr(0x2011) + "b": ("a-b", ["hyphen"]),
    "p" + chr(0x430) + "y": ("pay", ["mixed_script"]),
    chr(0x43C) + chr(0x43E) + chr(0x434): (chr(0x43C) + chr(0x43E) + chr(0x434), []),
    chr(0x3B1) + "-helix": (chr(0x3B1) + "-helix", []),
    "": ("", []),
}


def test_cases():
    for text, (form, odd) in CASES.items():
        assert (consistent(text), oddities(text)) == (form, odd), ascii(text)


def test_folding_and_words():
    assert folded(consistent("STRASSE")) == folded(consistent("stra" + chr(0xDF) + "e"))
    assert canonical_words(f"One,{NB}TWO_three  " + chr(0xFF34) + "en!") == "one two three ten"


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_form_is_stable_and_odd_free(text):
    form = consistent(text)
    assert consistent(form) == form
    assert not set(oddities(form)) & {"space", "hyphen"}


def test_column(spark, rows):
    long = ("word " * 200000) + ZW
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, f"a{NB}b", "x"), (3, f"a{NB}b", "x"), (4, long, "x")], "id long, t string, extra string")
    got = unify(df, "t").select("id", "oddities").collect()
    assert sorted((r.id, r.oddities) for r in got if r.oddities is not None) == [(2, []), (3, ["space"]), (3, ["space"]), (4, ["invisible"])]
    assert unify(df.limit(0), "t").count() == 0
    try:
        unify(df.withColumnRenamed("extra", "form"), "t")
        raise AssertionError("clash accepted")
    except ValueError:
        pass


def test_rare_invisible_characters():
    for c in (0x1BCA0, 0x1BCA3, 0x1D173, 0x1D17A):
        assert consistent(f"ab{chr(c)}cd") == "abcd" and oddities(f"ab{chr(c)}cd") == ["invisible"]


def test_texts_in_the_form_hold_nothing_odd():
    import random

    r = random.Random(4)
    signs = ["a", "B", "e" + chr(0x301), chr(0xE9), chr(0xFF21), chr(0xFB01), chr(0x200B), chr(0xAD), chr(0xA0), chr(0x2011), chr(0x430), chr(0x3B1), " ", "-", chr(0x1F469), chr(0x200D), chr(0x1F4BB), chr(0xFE0F), chr(0x1100), chr(0xB2)]
    for _ in range(3000):
        t = "".join(r.choice(signs) for _ in range(r.randint(1, 9)))
        form = consistent(t)
        assert consistent(form) == form and oddities(form) == [], t
        if form == t:
            assert oddities(t) == [], t
