"""Many names a session: equal to the fold over all of them."""

import random

from pyspark.sql import functions as F

from colloquy.functions.redact import redact_names_dynamic
from colloquy.operators import names as nm
from colloquy.operators.batch import observed_counts, report, report_observed, write_outcomes
from tests.conftest import rows

ROWS = "session_id long, seg_idx long, text string"
NAMES = "session_id long, ord long, name string"


def by_fold(spark, texts, names):
    each = names.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("n"))
    j = texts.join(each, "session_id", "left").withColumn("n", F.coalesce("n", F.array().cast("array<string>")))
    return sorted(rows(j.select("session_id", "seg_idx", redact_names_dynamic("text", F.col("n")).alias("text")), *["session_id", "seg_idx", "text"]), key=str)


def test_equal_to_the_fold_on_mixed_texts(spark):
    rng = random.Random(5)
    bits = ["John", "john", "Doe", "O'Neil", "Ann-Marie", "Zoë", "ZOË", "İpek", "ipek", "straße", "STRASSE", "Straſe", "Kelvin", "Kelvin", "name", "NAME",
            "[NAME]", "--", ".", "Dr.", "a\\Eb", "x_y", "12", "ΟΔΟΣ", "οδος", "οδοσ", "ı", "I", "é", "漢字", " ", "  ", "\n", "Smith"]
    some = lambda n: "".join(rng.choice(bits) + rng.choice([" ", "", "-", ", "]) for _ in range(rng.randrange(n)))
    texts = [(s, i, None if i == 7 else some(14)) for s in range(12) for i in range(20)]
    names = [(s, i, some(4)) for s in range(11) for i in range(40)] + [(3, 99, " "), (3, 98, ""), (3, 97, None)]
    t, n = spark.createDataFrame(texts, ROWS), spark.createDataFrame(names, NAMES)
    want = by_fold(spark, t, n)
    assert sum("[NAME]" in (r[2] or "") for r in want) > 100
    for block in (3, 1 << 16):
        assert sorted(rows(nm.redact_many_names(t, n, block=block)), key=str) == want


def test_only_names_that_occur_are_tried(spark):
    t = spark.createDataFrame([(1, i, f"word{i} said John Doe") for i in range(50)], ROWS)
    n = spark.createDataFrame([(1, i, f"Nobody{i} Else") for i in range(5000)] + [(1, 5000, "john doe"), (1, 5001, "--"), (2, 1, "John")], NAMES)
    assert sorted(r.name for r in nm.present_names(t, n).collect()) == ["--", "john doe"]
    assert {r.text for r in nm.redact_many_names(t, n).collect()} == {f"word{i} said [NAME]" for i in range(50)}


def test_names_of_a_list_equal_names_of_each_session(spark):
    rng = random.Random(6)
    bits = ["John", "Doe", "name", "Zoë", "--", "#", "customer", "Customer", "12", "0012", "é", "[NAME]", "K", "K", "x_y", "."]
    some = lambda n: "".join(rng.choice(bits) + rng.choice([" ", "", "-", "#"]) for _ in range(rng.randrange(n)))
    t = spark.createDataFrame([(s, i, some(14)) for s in range(12) for i in range(20)], ROWS)
    own = [(s, i, some(3)) for s in range(11) for i in range(5)]
    lists = [(k, 100 + i, some(5)) for k in range(3) for i in range(40)] + [(None, 1, "John"), (1, None, "Doe"), (1, 5, None)]
    has = [(s, s % 3) for s in range(12)] + [(4, 1), (5, 0), (None, 1), (6, None)]
    expanded = own + [(s, o, n) for s, k in sorted(set(has), key=str) for m, o, n in lists if k == m and k is not None and s is not None]
    want = by_fold(spark, t, spark.createDataFrame(expanded, NAMES))
    shared, members = spark.createDataFrame(lists, "list_id long, ord long, name string"), spark.createDataFrame(has, "session_id long, list_id long")
    got = nm.redact_many_names(t, spark.createDataFrame(own, NAMES), shared=shared, members=members)
    assert sorted(rows(got), key=str) == want and sum("[NAME]" in (r[2] or "") for r in want) > 100


def test_a_long_list_of_many_sessions_makes_no_row_for_each_name_of_each_session(spark):
    # 2,000 sessions with 300,000 names each; all say the word that all the names begin with
    t = spark.range(2000).selectExpr("id AS session_id", "0L AS seg_idx", "concat('customer ', id, ' met Customer#', lpad(id, 9, '0')) AS text")
    shared = spark.range(300_000).selectExpr("0L AS list_id", "id AS ord", "concat('Customer#', lpad(id, 9, '0')) AS name")
    members = spark.range(2000).selectExpr("id AS session_id", "0L AS list_id")
    none = spark.createDataFrame([], NAMES)
    assert nm.present_names(t, none, shared=shared, members=members).count() == 2000
    got = nm.redact_many_names(t, none, shared=shared, members=members)
    assert got.count() == 2000 == got.where("text = concat('customer ', session_id, ' met [NAME]')").count()


def test_a_shared_first_word_brings_no_names(spark):
    t = spark.createDataFrame([(1, 0, "a customer called about 000000007")], ROWS)
    n = spark.createDataFrame([(1, i, f"Customer#{i:09d}") for i in range(50)], NAMES)
    assert [r.name for r in nm.present_names(t, n).collect()] == ["Customer#000000007"]


def test_report_of_the_writing_job(spark, tmp_path):
    data = [(1, "ok", None), (2, "ok", None), (3, "failed", "input"), (4, "failed", "summarize"), (5, "failed", "input")]
    outs = spark.createDataFrame(data, "session_id long, status string, stage string")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    got = write_outcomes(outs, str(tmp_path / "outs"))
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before)
    assert len(jobs) == 1  # the write itself
    assert sorted(rows(got), key=str) == sorted(rows(report(outs)), key=str)
    assert spark.read.parquet(str(tmp_path / "outs")).count() == 5
    told, seen = observed_counts(outs.limit(0), "none")
    told.collect()
    assert report_observed(spark, seen).count() == 0
