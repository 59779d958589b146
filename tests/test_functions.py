import pytest
from pyspark.sql import functions as F

from foliospark.functions import patterns as P
from foliospark.functions import text as X
from foliospark.functions.python import nfkc, word_similarity


def value(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a yield of 8 m³ N₂ per h⁻¹ was kept", {"unicode_subsup": 4}), ("some $x_i$ beside T_{wall} and \\frac{a}{b}", {"latex": 3}), ("N<sub>2</sub> purge over SiO~2~ beds", {"markup": 3}), ("the pump costs $900 and moves SO2", {}), (None, {}), ("", {}),
    ],
)
def test_format_traces(spark, text, want):
    assert value(spark, text, X.format_traces) == want


def test_repair_of_glyphs(spark):
    text = "de\ue103ned for 18 bar /C0 2"
    assert value(spark, text, lambda c: X.repair_glyphs(c)[0]) == "defined for 18 bar − 2"
    assert value(spark, "de \ue103 ned", lambda c: X.repair_glyphs(c)[0]) == "defined"
    assert value(spark, text, lambda c: X.repair_glyphs(c)[1]) == 2
    assert value(spark, "¼ cup", lambda c: X.repair_glyphs(c)[0]) == "¼ cup"
    assert value(spark, "¼ cup", lambda c: X.repair_glyphs(c)[1]) == 0


@pytest.mark.parametrize(("text", "want"), [("q (t) = A0 + B t + C exp(D/RT) (12)", True), ("Here we insert n = 0.7 into relation (4)", False), ("a = b", False), ("sinh(x) = COSH + tanh (3a)", True)])
def test_equation_lines(spark, text, want):
    assert value(spark, text, X.is_equation_line) is want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2.1 Materials", True), ("3. Results and Discussion", True), ("Introduction", True), ("1. Introduction:", True), ("Acknowledgments", True), ("Acknowledgments were sent to every vendor.", False), ("Introduction of steam lines", False), ("4 Samples were dried at 60 °C", False), ("5 Toluene 110 111", False), ("II. Methods", True), ("6. In order of the", False), ("", False),
    ],
)
def test_heading_lines(spark, text, want):
    assert value(spark, text, X.is_heading_line) is want


@pytest.mark.parametrize(("text", "want"), [("0 50 100 150 200 Bed height (mm) (b) dp= 410 Pa", True), ("Peaks lay at 12, 19, 27, 33, 41 and 56 min.", False), ("The runs had 3 and 4 and 9 of the 11", False), ("1 2 3", False)])
def test_figure_text(spark, text, want):
    assert value(spark, text, X.is_figure_text) is want


def test_sentences(spark):
    text = "Olsen et al. saw slow drying. Their bed, e.g. Ref. 9, was deep. It is drawn in Fig. 6 below."
    assert value(spark, text, X.sentences) == ["Olsen et al. saw slow drying.", "Their bed, e.g. Ref. 9, was deep.", "It is drawn in Fig. 6 below."]
    assert value(spark, "", X.sentences) == []


@pytest.mark.parametrize(("text", "k", "want"), [("a\n\nb\n\n\nc\n", 3, ["a", "b", "c"]), ("a\n\nb", 3, None), ("a  b\n \nc", 2, ["a b", "c"])])
def test_split_output(spark, text, k, want):
    assert value(spark, text, lambda c: X.split_output(c, F.lit(k))) == want


def test_subfields(spark):
    make = lambda c: X.subfields(c, F.lit("Heat transfer and rates of a fixed bed"))
    assert {"catalysis", "separation", "reaction_engineering", "transport"} <= set(value(spark, "Zeolite catalysts beside distillation in a reactor", make))
    assert value(spark, "On the naming of colours", lambda c: X.subfields(c, F.lit(None).cast("string"))) == []


def test_unicode_space_and_case(spark):
    assert value(spark, "   a b　\x1c", X.strip) == "a b"
    assert value(spark, "Page 12 of 300", X.running_key) == "pageof"
    assert value(spark, "p3:L4-17", X.pdf_loc).asDict() == {"page": 3, "first": 4, "last": 17}
    assert value(spark, "body[1]/p[2]", X.pdf_loc) is None
    assert value(spark, "ﬁne", nfkc) == "fine" and value(spark, None, nfkc) is None
    assert value(spark, "a b c d", lambda c: word_similarity(c, F.lit("a b x d"))) == 0.75
    assert value(spark, "a\ue200\ufffdb\x01\t", X.broken_glyphs) == 3


def test_stop_and_number_tokens(spark):
    assert value(spark, "The of_the theory, THE 2the", lambda c: X.count(c, P.STOP_TOKEN)) == 5
    assert value(spark, "1,720 (3) −5 a1 7%", lambda c: X.count(c, P.NUMERIC_TOKEN)) == 4
