import unicodedata

import pytest
from pyspark.sql import functions as F

from weftlink.functions import text


def _apply(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select(expression("v").alias("o"), "i").orderBy("i").select("o").collect()]


def _names(spark, values):
    df = spark.createDataFrame([(str(i), v, None, None) for i, v in enumerate(values)], "entity_id string, business_name string, business_address string, country string")
    return [r[0] for r in text.normalized(df).orderBy(F.col("entity_id").cast("int")).select("name_norm").collect()]


def _addresses(spark, values):
    df = spark.createDataFrame([(str(i), None, v, None) for i, v in enumerate(values)], "entity_id string, business_name string, business_address string, country string")
    return [r[0] for r in text.normalized(df).orderBy(F.col("entity_id").cast("int")).select("addr_norm").collect()]


def test_missing_words(spark):
    values = ["nan", "NaN", "none", "None", "null", "NULL", "N/A", "na", "-", "", "  ", None, " ", "x", "n.a."]
    assert _apply(spark, values, text.is_missing) == [True] * 13 + [False] * 2


def test_safe_field_strips_all_white_space(spark):
    assert _apply(spark, ["　 a b\x1f", None, "-"], text.safe_field) == ["a b", "", ""]


def test_whitespace_collapses_but_not_zero_width(spark):
    assert _apply(spark, [" a  b\tc ", "a​b", "\n"], text.collapse) == ["a b c", "a​b", None]


def test_punctuation_classes(spark):
    assert _apply(spark, ["a–b_c(d)+e«"], text.replace_punctuation) == ["a-b c d  e "]
    assert _apply(spark, ["a-b"], lambda c: text.replace_punctuation(c, keep_hyphens=False)) == ["a b"]


@pytest.mark.parametrize("form", ["NFC", "NFD", "NFKC", "NFKD"])
def test_unicode_forms(spark, form):
    values = ["écafe", "ﬁn", "रिलायंस", "plain", None]
    assert _apply(spark, values, text.unicode_form(form)) == [None if v is None else unicodedata.normalize(form, v) for v in values]


def test_unknown_form_is_refused():
    with pytest.raises(ValueError):
        text.unicode_form("NFX")


def test_legal_forms_in_all_spellings(spark):
    spellings = {form: [form, *variants] for form, variants in text.LEGAL_FORMS.items()}
    for form in ("llc", "inc", "corp", "ltd", "co"):
        assert set(_names(spark, [f"Heron Lamps {x.upper()}" for x in spellings[form]])) == {f"heron lamps {form}"}
    # One spelling after another: what an earlier form has rewritten is what later ones see.
    assert _names(spark, ["Tern Private Limited", "Tern L.L.P.", "Limitedless Tern", "Tern Company Ltd"]) == ["tern pvt ltd", "tern l lp", "limitedless tern", "tern co ltd"]


def test_non_latin_names_survive(spark):
    assert _names(spark, ["ΑΛΦΑ, Ναυτική", "Łódź Młyn", "Łódź Młyn", "서울 등대"]) == ["αλφα ναυτική", "łódź młyn", "łódź młyn", "서울 등대"]


def test_sentinels_after_cleaning(spark):
    assert _names(spark, ["n/a", " None!", "…", "%%", "Heron-Tern", None]) == [None, None, None, None, "heron-tern", None]


def test_address_words(spark):
    got = _addresses(spark, ["8 Quay Rd", "30 Fern Ave.", "7-E Dune St", "Łąka 4", "Heron's Rd"])
    assert got == ["8 quay road", "30 fern avenue", "7-east dune street", "łąka 4", "heron south road"]


def test_countries(spark):
    values = ["us", " USA ", "United States of America", "india", "IN", "France", "Brazil", "NA", None]
    assert _apply(spark, values, text.normal_country) == ["US", "US", "US", "IN", "IN", "FR", "BRAZIL", None, None]


def test_normalised_plan_stays_small(spark):
    df = spark.createDataFrame([("1", "Acme", "St", "US")], "entity_id string, business_name string, business_address string, country string")
    plan = text.normalized(df)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000  # nested expressions are not multiplied
