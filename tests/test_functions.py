from pyspark.sql import functions as F

from clausewise.functions import probabilities as P
from clausewise.functions import records as R
from clausewise.functions import scoring as S
from clausewise.functions import text as T


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}"
                       for k, v in values.items()) or "x string"
    df = spark.createDataFrame([tuple(values.values()) or ("x",)], schema)
    return df.select(expr.alias("r")).first()["r"]


def test_spaces_and_ids(spark):
    assert one(spark, T.normalize_space("a"), a=" x \t y\x1c\n z ") == "x y z"
    assert one(spark, T.strip_invisible("a"), a="​ 4.1 T﻿ ") == "4.1 T"
    assert one(spark, T.normalized_id(F.lit("GDPR"), "a"), a=" Article 5 (1) ") == "gdpr::Article_5_1_"
    assert one(spark, T.uid_from_filename("a"), a="x/20_site.com.csv") == "20"
    assert one(spark, T.uid_from_filename("a"), a="_x.csv") is None


def test_clauses_keep_first_spelling_and_drop_short(spark):
    body = ("Privacy Policy\n\nWe collect your data with care.  WE COLLECT YOUR DATA WITH CARE.\r\n"
            "You may delete it at any time!")
    df = spark.createDataFrame([(1, body), (2, "tiny"), (3, "  ")], "doc_id int, t string")
    got = {r["doc_id"]: r["clauses"] for r in T.with_clauses(df, "t").collect()}
    assert got[1] == ["We collect your data with care.", "You may delete it at any time!"]
    assert got[2] == ["tiny"] and got[3] == []


def test_dates_and_numbers(spark):
    assert str(one(spark, R.parse_date("a"), a=" 2/8/2016 ")) == "2016-02-08"
    assert str(one(spark, R.parse_date("a"), a="2016-2-8")) == "2016-02-08"
    assert one(spark, R.parse_date("a"), a="2/8/16") is None
    assert one(spark, R.to_int("a"), a="1,234") == 1234
    assert one(spark, R.to_int("a"), a="1.5") is None
    assert one(spark, R.to_float("a"), a=" 1.5 ") == 1.5
    assert one(spark, R.to_float("a"), a="x") is None


def test_json_and_ddl(spark):
    assert one(spark, R.json_keys("a"), a='{"A": {"b c": [{"d\\"e": "x\\": 1"}]}}') == ["a", "b c", 'd"e']
    assert one(spark, R.json_keys("a"), a='"k": 1}') is None
    assert one(spark, R.selected_texts("a"),
               a='{"p": {"selectedText": " one  two "}, "q": [{"selectedText": "x"}, {"selectedText": "one two"}]}'
               ) == ["one two", "x"]
    assert one(spark, R.selected_texts("a"), a="{bad") == []
    ddl = "CREATE TABLE u (\n id INT,\n email TEXT,\n phone TEXT,\n created_at TIMESTAMP\n);"
    assert one(spark, R.schema_fields("a"), a=ddl) == ["created_at", "email", "id", "phone"]
    assert one(spark, R.table_names("a"), a='create table "u" (') == ["u"]
    fields = F.array(*[F.lit(x) for x in ("email", "health_status", "salary_amount", "created_at")])
    assert one(spark, R.pii_fields(fields)) == ["email"]
    assert one(spark, R.sensitive_fields(fields)) == ["health_status", "salary_amount"]


def test_long_json_text_does_not_overflow(spark):
    big = '{"selectedText": "' + "x\\n" * 50_000 + '"}'
    assert len(one(spark, R.selected_texts("a"), a=big)) == 1


def test_scores(spark):
    assert one(spark, S.missing_penalty("a"), a=3.0) == 0.15000000000000002
    assert one(spark, S.missing_penalty("a"), a=100.0) == 0.4
    assert one(spark, S.risk_band("a"), a=0.67) == "high"
    assert one(spark, S.grade("a"), a=70.0) == "B"
    assert one(spark, S.normalize_band("a"), a="Non-Compliant") == "low"
    assert one(spark, S.binary_band("a"), a="PARTIAL_match") == "compliant"
    assert one(spark, S.claim_adjusted_rate("a", F.lit("compliant")), a=0.5) == 0.12 * 0.65
    lo, hi = S.beta_interval(F.lit(1.0), F.lit(1.0))
    assert one(spark, lo) == 0.0 and one(spark, hi) == 1.0
    assert one(spark, S.positive_or_default("a", 1.5), a="-2") == 1.5


def test_probability_maps(spark):
    df = spark.createDataFrame([({"user": 2.0, "system": -1.0}, "user", 0.5), (None, "user", 0.6),
                                (None, "other", 0.6)],
                               "m map<string,double>, p string, c double")
    labels = ("user", "system", "organization")
    got = [r["x"] for r in df.select(P.probabilities_or_fallback("m", "p", "c", labels).alias("x")).collect()]
    assert got[0] == {"user": 1.0, "system": 0.0, "organization": 0.0}
    assert got[1] == {"user": 0.6, "system": 0.2, "organization": 0.2}
    assert abs(got[2]["system"] - 1 / 3) < 1e-12


def test_file_names_of_standards(spark):
    assert one(spark, T.standard_family("a"), a="BS ISO-IEC 15944-12-2025.docx") == "15944-12"
    assert one(spark, T.standard_year("a"), a="BS ISO-IEC 15944-12-2025.docx") == "2025"
    assert one(spark, T.standard_family("a"), a="ISO_27001_Standard-1.docx") == "27001"
