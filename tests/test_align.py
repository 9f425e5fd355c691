import duckdb
import pytest

from colloquy.operators.align import align, assign_speakers, attribute_words, rejected_times
from colloquy.plans.oracle import ORACLE
from colloquy.sources import fixtures as fx
from tests.conftest import SF_SMALL, rows

WSCHEMA = "session_id long, word_idx long, text string, start_s double, end_s double"
TSCHEMA = "session_id long, turn_idx long, speaker string, start_s double, end_s double"


def run(spark, words, turns, **kw):
    w = spark.createDataFrame([(1, i, *x) for i, x in enumerate(words)], WSCHEMA).repartition(3)
    t = spark.createDataFrame([(1, i, *x) for i, x in enumerate(turns)], TSCHEMA)
    segs = align(w, t, **kw).orderBy("seg_idx")
    return rows(segs, "speaker", "text", "start_s", "end_s")


WORDS = [(" Good", 0.25, 0.5), (" morning", 0.5, 1.0), (" all.", 1.0, 1.25),
         (" Shall", 2.0, 2.25), (" we", 2.25, 2.5), (" begin?", 2.5, 3.0)]
TURNS = [("S1", 0.0, 1.5), ("S2", 1.75, 3.25)]


def test_two_speakers(spark):
    assert run(spark, WORDS, TURNS) == [("S1", "Good morning all.", 0.25, 1.25),
                                        ("S2", "Shall we begin?", 2.0, 3.0)]


def test_no_words(spark):
    assert run(spark, [], TURNS) == []


def test_no_turns(spark):
    assert run(spark, WORDS, []) == [("Speaker", "Good morning all. Shall we begin?", 0.25, 3.0)]


def test_aba_stays_three(spark):
    words = [(" a", 0.0, 1.0), (" b", 1.0, 2.0), (" c", 2.0, 3.0)]
    turns = [("A", 0.0, 1.0), ("B", 1.0, 2.0), ("A", 2.0, 3.0)]
    assert [r[0] for r in run(spark, words, turns)] == ["A", "B", "A"]


def test_gap_word_unknown(spark):
    words = [(" x", 5.0, 6.0)]
    assert run(spark, words, [("A", 0.0, 1.0), ("B", 10.0, 11.0)])[0][0] == "Unknown"


def test_zero_length_word_midpoint(spark):
    assert run(spark, [(" x", 1.0, 1.0)], [("A", 0.0, 2.0)])[0][0] == "A"
    assert run(spark, [(" x", 2.0, 2.0)], [("A", 0.0, 2.0), ("B", 2.0, 3.0)])[0][0] == "A"


def test_larger_overlap_and_tie(spark):
    assert run(spark, [(" x", 0.5, 1.5)], [("A", 0.0, 0.75), ("B", 0.75, 2.0)])[0][0] == "B"
    assert run(spark, [(" x", 0.5, 1.5)], [("A", 0.0, 1.0), ("B", 1.0, 2.0)])[0][0] == "A"


def joined(first, last):
    return " ".join("w%d" % i for i in range(first, last + 1))


@pytest.mark.parametrize("block,bin_s", [(1, 0.125), (2, 0.5), (3, 1.0), (1 << 16, 32.0)])
def test_block_and_bin_sizes_do_not_change_result(spark, block, bin_s):
    words = [(" w%d" % i, i * 0.25, i * 0.25 + 0.25) for i in range(23)]
    turns = [("A", 0.0, 1.125), ("B", 1.0, 2.625), ("A", 2.625, 2.75), ("C", 4.0, 9.0)]
    # w4 overlaps B more, w10 overlaps B and the second A alike, w11 to w15 lie in the gap
    want = [("A", joined(0, 3), 0.0, 1.0), ("B", joined(4, 10), 1.0, 2.75),
            ("Unknown", joined(11, 15), 2.75, 4.0), ("C", joined(16, 22), 4.0, 5.75)]
    assert run(spark, words, turns, block=block, bin_seconds=bin_s) == want


def test_properties_on_the_fixture(spark):
    f = fx.all_fixtures(spark, SF_SMALL)
    words, turns = f["words"].toPandas(), f["turns"].toPandas()
    spk = assign_speakers(f["words"], f["turns"]).toPandas()
    segs = align(f["words"], f["turns"], block=7, bin_seconds=2.0).toPandas()
    assert len(spk) == len(words)
    # no turn overlaps a word more than one of its speaker does
    pairs = words.merge(spk, on=["session_id", "word_idx"]).merge(turns, on="session_id", suffixes=("", "_t"))
    pairs["overlap"] = (pairs[["end_s", "end_s_t"]].min(axis=1) - pairs[["start_s", "start_s_t"]].max(axis=1)).clip(lower=0)
    most = pairs.groupby(["session_id", "word_idx"])["overlap"].max()
    own = pairs[pairs["speaker"] == pairs["speaker_t"]].groupby(["session_id", "word_idx"])["overlap"].max()
    assert (most[most > 0] == own.reindex(most[most > 0].index)).all()
    # the text of a session is that of its words, and neighbours differ in speaker
    for sid, own_words in words.sort_values("word_idx").groupby("session_id"):
        s = segs[segs["session_id"] == sid].sort_values("seg_idx")
        assert " ".join(s["text"]).split() == "".join(own_words["text"]).split()
        assert (s["speaker"].values[1:] != s["speaker"].values[:-1]).all()
        assert list(s["seg_idx"]) == list(range(len(s)))


@pytest.mark.parametrize("kw", [{}, {"block": 7, "bin_seconds": 2.0}])
def test_fixture_equals_sql(spark, kw):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF_SMALL}/conversations.parquet')")
    cols = ("session_id", "seg_idx", "speaker", "text", "start_s", "end_s")
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE['align_runs']})").fetchall())
    f = fx.all_fixtures(spark, SF_SMALL)
    assert sorted(rows(align(f["words"], f["turns"], **kw), *cols)) == want


def test_faulty_times_are_rejected_and_stop_nothing(spark):
    nan = float("nan")
    words = [(" a", 0.0, 1.0), (" b", None, None), (" c", 1.0, None), (" d", 1.0, nan), (" e", 1.0, 2.0)]
    turns = [("A", 0.0, 1e13), ("B", 0.0, 5.0), ("C", None, 2.0), ("D", 3.0, 1.0)]
    assert run(spark, words, turns) == [("B", "a e", 0.0, 2.0)]
    w = spark.createDataFrame([(1, i, *x) for i, x in enumerate(words)], WSCHEMA)
    t = spark.createDataFrame([(1, i, *x) for i, x in enumerate(turns)], TSCHEMA)
    assert sorted(rows(rejected_times(w), "word_idx", "reason")) == [
        (1, "missing time"), (2, "missing time"), (3, "implausible time")]
    assert sorted(rows(rejected_times(t), "turn_idx", "reason")) == [(0, "implausible time"), (2, "missing time")]
    assert assign_speakers(w, t).count() + rejected_times(w).count() == len(words)


def test_assign_speakers_labels(spark):
    w = spark.createDataFrame([(1, 0, " a", 0.0, 1.0), (2, 0, " b", 0.0, 1.0), (1, 1, " c", 5.0, 6.0)], WSCHEMA)
    t = spark.createDataFrame([(1, 0, "A", 0.0, 1.0)], TSCHEMA)
    got = sorted(rows(assign_speakers(w, t)))
    assert got == [(1, 0, "A"), (1, 1, "Unknown"), (2, 0, "Speaker")]


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_turns_and_words_against_all_pairs(spark):
    """Turns and words from parts of a second to the longest legal times."""
    import random
    rng = random.Random(11)
    span = lambda: rng.choice([0.0, 0.25, 3.0, 900.0, 1500.0, 40_000.0, 2e6, 9e6])
    words, turns = [], []
    for i in range(250):
        s = rng.choice([rng.uniform(-200, 200), rng.uniform(-9e6, 9e6)])
        words.append((f" w{i}", s, min(s + span(), 1e7)))
        s = rng.choice([rng.uniform(-200, 200), rng.uniform(-9e6, 9e6)])
        turns.append((f"S{i % 40}", s, min(s + span(), 1e7)))
    turns.append(("whole", -1e7, 1e7))
    want = []
    for _, s, e in words:
        mid = (s + e) / 2
        fits = [(-max(0.0, min(e, b) - max(s, a)), i) for i, (_, a, b) in enumerate(turns) if min(e, b) > max(s, a) or a <= mid <= b]
        want.append(turns[min(fits)[1]][0])
    w = spark.createDataFrame([(1, i, *x) for i, x in enumerate(words)], WSCHEMA)
    t = spark.createDataFrame([(1, i, *x) for i, x in enumerate(turns)], TSCHEMA)
    assert [r[1] for r in rows(assign_speakers(w, t).orderBy("word_idx"), "word_idx", "speaker")] == want
    assert [r[1] for r in rows(assign_speakers(w, t, bin_seconds=0.5).orderBy("word_idx"), "word_idx", "speaker")] == want


def test_rows_of_a_turn_do_not_grow_with_its_length(spark):
    from pyspark.sql import functions as F
    from colloquy.operators.align import FAN, N_WIDTHS, _keys, _level

    t = spark.createDataFrame([(float(10**k),) for k in range(8)], "e double")
    key = F.struct(F.lit("turn").alias("whose"), _level(F.lit(0.0), F.col("e"), 32.0).alias("level"))
    n = t.select(F.size(_keys(F.lit(0.0), F.col("e"), F.array(key), 32.0)).alias("n")).agg(F.max("n")).first()[0]
    assert n <= FAN and N_WIDTHS == 5


def test_a_turn_called_unknown_joins_words_without_a_turn(spark):
    words = [(" a", 0.0, 1.0), (" b", 5.0, 6.0), (" c", 9.0, 10.0)]
    assert run(spark, words, [("Unknown", 0.0, 1.0), ("B", 9.0, 10.0)]) == [("Unknown", "a b", 0.0, 6.0), ("B", "c", 9.0, 10.0)]


def test_labels_by_block_equal_labels_of_segments(spark):
    from colloquy.operators.speakers import label_speakers

    f = fx.all_fixtures(spark, SF_SMALL)
    for size in (3, 1 << 16):
        plain = label_speakers(align(f["words"], f["turns"], block=size), "Ann,Ben", block=2)
        named = align(f["words"], f["turns"], block=size, names="Ann,Ben")
        assert sorted(rows(named, *plain.columns)) == sorted(rows(plain))


def test_runs_are_merged_once_and_nothing_stays_cached(spark):
    from colloquy.plans.queries import q_transcript_pipeline

    p = executed(q_transcript_pipeline(spark, SF_SMALL))
    p = p[:p.index("== Initial Plan")] if "== Initial Plan" in p else p
    # the written pieces are read once with their texts: runs are merged once
    assert p.count("_txt") and sum("FileScan parquet" in line and "_txt" in line for line in p.splitlines()) == 1
    assert "InMemoryTableScan" not in p and spark._jsc.sc().getPersistentRDDs().isEmpty()


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def test_no_long_row_is_joined_by_its_session_alone(spark):
    """Joins by session alone carry blocks or speakers, not words or texts."""
    from colloquy.operators.align import block_runs, merge_runs, run_pieces
    from colloquy.operators.speakers import label_speakers, names_array

    f = fx.all_fixtures(spark, SF_SMALL)
    pieces = run_pieces(attribute_words(f["words"], f["turns"]))
    some = 0
    for df in (assign_speakers(f["words"], f["turns"]), label_speakers(f["segments"], "X"),
               merge_runs(pieces, block_runs(pieces, f["turns"], names_array("X")))):
        joins = [n for n in nodes(df._jdf.queryExecution().sparkPlan()) if n.nodeName().endswith("Join")]
        alone = [j for j in joins if j.leftKeys().size() == 1]
        out = [j.output().apply(i).name() for j in alone for i in range(j.output().size())]
        some += len(alone)
        assert joins and not {"text", "word_idx", "seg_idx", "_txt"} & set(out)
    assert some
