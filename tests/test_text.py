import pytest
from pyspark.sql import functions as F

from mnemix.functions import text as T


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("text", "words"), [
    ("Validate_Token", ["validate", "token"]), ("sessionUUID", ["session", "uuid"]), ("UUIDToken", ["uuid", "token"]), ("auth-module v2", ["auth", "module", "v", "2"]), ("", []), (None, []),
    ("日本語", ["日本", "本語"]), ("a字b", ["a", "字", "b"]),
])
def test_split_words(spark, text, words):
    assert one(spark, text, T.split_words) == words


def test_terms_keep_order_and_digits(spark):
    assert one(spark, "The rules of 7 x rules", T.terms) == ["rules", "7", "rules"]


@pytest.mark.parametrize(("a", "b"), [("rules", "rule"), ("validating", "validate"), ("policies", "policy"), ("boxes", "box"), ("authorization", "authorize")])
def test_stems_meet(spark, a, b):
    assert one(spark, a, T.stem) == one(spark, b, T.stem)


@pytest.mark.parametrize(("a", "b"), [("apply", "app"), ("news", "new"), ("family", "famil"), ("speed", "spe")])
def test_stems_stay_apart(spark, a, b):
    assert one(spark, a, T.stem) != one(spark, b, T.stem)


def test_sentences(spark):
    assert one(spark, "One. Two 1.5 x! ... 三。四", T.sentences) == ["One.", "Two 1.5 x!", "三。", "四"]


def test_fnv_low_bits(spark):
    def fnv(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = ((h ^ x) * 0x100000001B3) % (1 << 64)
        return f"{h & 0xFFFFFFFF:08x}"

    for t in ("", "a", "Größe 三"):
        assert one(spark, t, T.fnv32) == fnv(t.encode())


def test_scripts(spark):
    assert one(spark, "привет abc", T.script_profile).script == "cyrillic"
    assert one(spark, "ＡＢＣ", T.script_profile).non_latin_fraction == 0
    assert one(spark, "123", T.script_profile).letters == 0
    assert one(spark, "漢字かな", T.unreadable_for_english)


TEXTS = ["aBcD ABcDEf UUIDToken X", "auth-module v2 12a3b A1 ÄÖüß Straße ĐaƂ", "tag – “x” … €5 naïve ÉCOLE", "日本語 mixed Text", "İstanbul ª² x²y ½", "a\x00b\tc 7 x", "", None, "οδΌς Σ", "éa", "ǅx ŉa ǰb"]


def test_terms_by_batches_are_terms(spark):
    d = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in d.select("t", T.terms_of(F.col("t")).alias("a"), T.terms(F.col("t")).alias("b"), T.term_set_of(F.col("t")).alias("c"), F.array_sort(F.array_distinct(F.transform(T.terms(F.col("t")), T.capitalize))).alias("d")).collect():
        assert r.a == r.b and r.c == r.d, r.t


def test_a_script_profile_goes_through_a_text_twice(spark):
    d = spark.createDataFrame([(t,) for t in [*TEXTS, "привет мир abc", "abcdefgh я", "กขค ab", "ა ბ ⴰ"]], "t string")
    got = d.select("t", T.script_profile(F.col("t")).alias("p"))
    found = {r.t: tuple(r.p) for r in got.collect()}
    assert found["привет мир abc"] == (12, 0.75, "cyrillic") and found["abcdefgh я"] == (9, 0.1111, "latin") and found["กขค ab"] == (5, 0.6, "thai") and found[None] == (0, 0.0, "latin")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(coalesce(") == 1
