import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliolake.functions import lists as L
from foliolake.functions import longtext as LT
from foliolake.functions import text as T


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_translatable(spark):
    no, yes = ["", "...", "a b c", "12.04.2021", "https://x.org/a", "XIV.", "x . . . . . 3", "語"], ["ab", "1. Teil", "3 kg", "日本", "see http://x.org now", "Teil . . . . . 3"]
    assert column(spark, no + yes, T.translatable) == [False] * len(no) + [True] * len(yes)


def test_clean(spark):
    assert column(spark, ["a . . . . 3", "so...", "“x”", " y", "a — b – c", " z "], T.clean) == ["a 3", "so...", '"x"', "• y", "a - b - c", "z"]


def test_sentences(spark):
    got = column(spark, ["One. Two! Three? Four… Five", 'He said "Go." Then', "zzgl. MwSt. ist da. Ja.", "一。二。", " ", "one"], T.sentences)
    assert got == [["One. ", "Two! ", "Three? ", "Four… ", "Five"], ['He said "Go." ', "Then"], ["zzgl. MwSt. ist da. ", "Ja."], ["一。", "二。"], [" "], ["one"]]


def test_guard(spark):
    rows = spark.createDataFrame([("abc", "x" * 30, ""), ("My Story", "Meine Geschichte", ""), ("a", "[[a]]", ""), ("[[a]]", "[[b]]", ""), ("a", "的", "deu_Latn"), ("a", "的", "zho_Hans"), ("日本語です", "y" * 30, "")], "s string, o string, t string")
    assert [r[0] for r in rows.select(T.guard("s", "o", "t") == F.col("o")).collect()] == [False, True, False, True, False, True, True]


def test_ligatures(spark):
    assert column(spark, ["Anschaﬀung", "PosiƟon", "Ōsaka", "abruĩar"], lambda c: T.ligatures(c, small=True)) == ["Anschaffung", "Position", "Ōsaka", "abrufbar"]


def test_cells(spark):
    assert column(spark, ["49.99", "-1,5", "10.0.0.1", "10.0.0.0/8", "1.1.1.1 - 2.2.2.2", "AA:BB:CC:00:11:22", " ", "3 kg"], T.plain_cell) == [False] * 7 + [True]


def test_pages(spark):
    assert column(spark, ["", "1-3,2", "2-9", "9", "3-1", "x"], lambda c: L.pages(c, F.lit(4))) == [[1, 2, 3, 4], [1, 2, 3], [2, 3, 4], None, None, None]


def test_favourites(spark):
    assert column(spark, ["deu_Latn,xx,deu_Latn,fra_Latn,spa_Latn,ita_Latn"], L.favourites) == [["deu_Latn", "fra_Latn", "spa_Latn", "eng_Latn"]]


def test_longest_run(spark):
    assert column(spark, [[True, False, True, True], [], [False]], L.longest_run, "array<boolean>") == [2, 0, 0]


def test_leaders(spark):
    assert column(spark, ["..", "......", "ceessesessesess", "hængningen", "word"], T.dot_leader) == [True, True, True, False, False]


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab. !\n。é", max_size=80), st.integers(1, 5))
def test_token_pieces_make_up_the_text(text, limit):
    parts = LT.within_tokens(text, limit)
    assert "".join(parts) == text
    assert all(LT.words_of(p) <= limit or len(p) < 2 for p in parts)


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abc .;\n", max_size=120), st.integers(4, 30))
def test_chunks_keep_all_signs(text, most):
    parts = LT.chunks(text, most)
    assert all(len(p) <= most for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())


def test_logical_order():
    assert LT.logical("abc") == "abc"
    assert LT.logical("םולש abc") == "abc שלום"


def test_wrapped():
    assert LT.wrapped("aa bb cc", 5) == ["aa bb", "cc"]


@pytest.mark.parametrize(("spec", "n"), [("AA", 27), ("Z", 26), ("A", 1)])
def test_column_index(spark, spec, n):
    assert column(spark, [spec], T.column_index) == [n]
