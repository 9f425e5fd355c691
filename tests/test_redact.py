import duckdb
from pyspark.sql import functions as F

from colloquy.functions import redact as rd
from colloquy.plans import oracle
from colloquy.session import read_table
from tests.conftest import SF_SMALL

CASES = [
    ("Call me at 555-123-4567.", "Call me at [PHONE]."),
    ("(555) 123-4567", "([PHONE]"),
    ("+1 555-123-4567", "+[PHONE]"),
    ("order 12345678901", "order [PHONE]"),
    ("Call 555-1234567, email me@test.com, SSN 123-45-6789", "Call [PHONE], email [EMAIL], SSN [SSN]"),
    ("Born 01/15/1990", "Born [DATE]"),
    ("123 Main Street.", "[ADDRESS]."),
    ("10 of the best", "[ADDRESS]"),
    ("12 weeks ago at her place", "[ADDRESS]"),
    ("5 minutes later the client felt best", "5 minutes later the client felt best"),
    ("no pii here", "no pii here"),
]


def by_sql(texts, names=()):
    """The oracle's nested SQL replacements in DuckDB."""
    con = duckdb.connect()
    sql = f"SELECT {oracle.redact_text('t', names)} FROM (SELECT unnest(?::VARCHAR[]) AS t)"
    return [r[0] for r in con.execute(sql, [list(texts)]).fetchall()]


def test_exact_outputs(spark):
    df = spark.createDataFrame([(t,) for t, _ in CASES], "t string")
    got = [r[0] for r in df.select(rd.redact_text("t")).collect()]
    assert got == [want for _, want in CASES]


def test_names_sequential_and_case_insensitive(spark):
    df = spark.createDataFrame([("john met John Doe and JOHNNY",), ("Dr. Smith",)], "t string")
    got = [r[0] for r in df.select(rd.redact_text("t", ["John", "John Doe", " ", "Dr."])).collect()]
    assert got == ["[NAME] met [NAME] Doe and JOHNNY", "Dr. Smith"]


def test_dynamic_names_equal_literal(spark):
    df = spark.createDataFrame([("Jane Smith met jane and a\\Eb", ["Jane Smith", "jane", "a\\Eb"])],
                               "t string, n array<string>")
    dyn = df.select(rd.redact_names_dynamic("t", F.col("n"))).first()[0]
    lit = df.select(rd.redact_names("t", ["Jane Smith", "jane", "a\\Eb"])).first()[0]
    assert dyn == lit == "[NAME] met [NAME] and [NAME]"


def test_unicode_boundaries_and_digits(spark):
    texts = ["é5551234567", "x 5551234567é", "Zoë's 12 Rue street", "١٢٣-٤٥-٦٧٨٩", "a_b@c-d.org"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(rd.redact_text("t", ["zoë"])).collect()]
    assert got == ["é5551234567", "x 5551234567é", "[NAME]'s [ADDRESS]", "[SSN]", "[EMAIL]"]


def test_documents_equal_sql(spark):
    docs = read_table(spark, SF_SMALL, "documents").where("text is not null").orderBy("doc_id").select("doc_id", "text")
    got = [r[1] for r in docs.select("doc_id", rd.redact_text("text", ["Anna"])).collect()]
    assert got == by_sql([r["text"] for r in docs.collect()], ["Anna"])
