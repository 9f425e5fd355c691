"""Secrets in text, by DataFrame functions alone.

Base kinds are three patterns, matched leftmost and without overlap. The
battery adds ``random`` spans: every run of 20 or more characters of the usual
encodings that no base span touches is a candidate. Its encoding is inferred
(digits, hex, base32, lower-case or mixed letters and digits, base64) and its
symbols are tested three ways:

* chi-squared uniformity over the alphabet of the encoding,
* a runs test of the upper against the lower half of the alphabet,
* the serial correlation of neighbouring symbols.

A secret is random: none of the tests may reject randomness at ``KEEP_P``. And
it is not text: under the null hypothesis that the symbols are drawn like
characters of a text that are in the alphabet, whose chi-squared statistic is
non-central with a non-centrality in proportion to the length, its own
statistic must be too small. These p-values, whose power grows with the length, go through the
Benjamini-Hochberg rule within each class of encoding and length, over all
candidates of all documents: the counts by p-value bin are one small table,
whatever the corpus, and only the cut of each class comes to the driver.

Two passes over the texts (counts, then decisions), no join and no shuffle of
rows. Offsets are code points, ends exclusive. Defined results: a null text
counts as empty; an empty table gives no rows; repeated rows are judged each on
their own; columns that clash with results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the base kinds: pattern, and the least length of a group.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
#: What every assign match that passes holds; much faster to look for.
ASSIGN_NEEDS = r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""
ACCESS = "AKIA[A-Z0-9]+"
ACCESS_LEAST = 18
HEX = "[0-9a-f]{16,}"  # a run of 16 or more is a whole match of [0-9a-f]+ that passes

RANDOM = "random"
CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Chance that two characters of a text agree (its index of coincidence): two
#: letters of words; two of those letters that are A-F (English: 12.7 % E, 8.2 %
#: A, 4.3 % D, ...).
TEXT_AGREES, HEX_AGREES = 0.066, 0.261
#: Encodings by what all symbols match, with the chance for texts of their
#: alphabet; the first that fits is inferred. Runs of digits or lower-case hex
#: are base spans, so of the first two only upper-case hex is left to test.
ENCODINGS = (
    ("digits", "^[0-9]+$", "0123456789", TEXT_AGREES),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", HEX_AGREES),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", TEXT_AGREES),
    ("lower", "^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789", TEXT_AGREES),
    ("upper", "^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", TEXT_AGREES),
    ("alnum", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", TEXT_AGREES),
    ("base64", "^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", TEXT_AGREES),
    ("base64url", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", TEXT_AGREES),
)
KEEP_P = 0.001
FDR = 0.01
BIN = 0.05  # width of a bin of -log10 p
MASK = "[SECRET]"
STEP = 256  # matches whose offsets are added up together


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _spans(text: Column, pattern: str, kind: str, needs: str | None = None) -> Column:
    """array<struct<start,rank,kind,end,value>> of the matches. The pieces
    between the matches give the offsets; a text without ``needs`` has none
    that count."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    parts = F.zip_with(F.zip_with(found, group, lambda m, g: F.struct(m.alias("m"), g.alias("g"))),
                       F.slice(gaps, 1, F.size(found)), lambda a, b: F.struct(a["m"].alias("m"), a["g"].alias("g"), F.length(b).alias("gap")))
    rank = len(KINDS) if kind == RANDOM else KINDS.index(kind)
    span = "struct<start:int,rank:int,kind:string,end:int,value:string>"
    none = F.array().cast(f"array<{span}>")

    def walked(some: Column) -> Column:
        """(length of the text so far, spans) of some matches, from their first gap."""
        return F.aggregate(
            some, F.struct(F.lit(0).alias("at"), none.alias("spans")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + F.length(x["m"])).alias("at"),
                F.array_append(acc["spans"], F.struct(
                    (acc["at"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                    (acc["at"] + x["gap"] + F.length(x["m"])).alias("end"), x["g"].alias("value"))).alias("spans")))

    def moved(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"),
                                                     (s["end"] + by).alias("end"), s["value"].alias("value")))

    # in blocks, as each step copies what it appends to
    blocks = _let(parts, lambda p: F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / STEP)), lambda i: walked(F.slice(p, i * STEP + 1, STEP))))
    whole = F.aggregate(
        blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{span}>>").alias("all")),
        lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["all"], moved(x["spans"], acc["at"])).alias("all")),
        lambda acc: F.flatten(acc["all"]))
    return F.when(text.rlike(needs or pattern), whole).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds, sorted by start, then kind."""
    assign = F.filter(_spans(text, ASSIGN, "assign", ASSIGN_NEEDS), lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    access = F.filter(_spans(text, ACCESS, "access"), lambda s: s["end"] - s["start"] >= ACCESS_LEAST)
    return F.array_sort(F.concat(assign, access, _spans(text, HEX, "hex")))


def candidates(text: Column, base: Column) -> Column:
    """Runs of encoding characters that no base span touches. One walk over
    both, by start: a run is open until another starts; a base span that starts
    in it, or one before it that reaches into it, touches it."""
    runs = _spans(text, CANDIDATE, RANDOM)
    span = "struct<start:int,rank:int,kind:string,end:int,value:string>"
    start = F.struct(F.lit(None).cast(span).alias("open"), F.lit(0).alias("reach"), F.array().cast(f"array<{span}>").alias("free"))

    def step(acc: Column, s: Column) -> Column:
        closed = F.when(acc["open"].isNull(), acc["free"]).otherwise(F.array_append(acc["free"], acc["open"]))
        run = F.struct(F.when(s["start"] >= acc["reach"], s).alias("open"), acc["reach"].alias("reach"), closed.alias("free"))
        base_ = F.struct(F.when(s["start"] >= acc["open"]["end"], acc["open"]).alias("open"), F.greatest(acc["reach"], s["end"]).alias("reach"),
                         acc["free"].alias("free"))
        return F.when(s["kind"] == RANDOM, run).otherwise(base_)

    end = lambda acc: F.when(acc["open"].isNull(), acc["free"]).otherwise(F.array_append(acc["free"], acc["open"]))
    return F.when(F.size(base) == 0, runs).otherwise(F.aggregate(F.array_sort(F.concat(base, runs)), start, step, end))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (the usual five-term formula)."""
    def of(a: Column) -> Column:
        return _let(1 / (1 + 0.2316419 * a), lambda t: F.exp(-a * a / 2) / 2.5066282746310002 * (
            t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))))

    return _let(z, lambda x: _let(of(F.abs(x)), lambda upper: F.when(x >= 0, upper).otherwise(1 - upper)))


def battery(value: Column) -> Column:
    """struct<class,logp,random> of one candidate: its class of encoding and
    length, -log10 of the p-value under the text hypothesis, and whether no
    test rejects randomness."""
    def encoded(v: Column) -> Column:
        def of(name: str, alphabet: str, agrees: float) -> Column:
            return F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet"), F.lit(agrees).alias("agrees"))

        chosen = of(ENCODINGS[-1][0], *ENCODINGS[-1][2:])
        for name, pattern, alphabet, agrees in reversed(ENCODINGS[:-1]):
            chosen = F.when(v.rlike(pattern), of(name, alphabet, agrees)).otherwise(chosen)
        bare = F.when(v.rlike("^[0-9A-F]+$"), F.lower(v)).otherwise(F.rtrim(v, F.lit("=")))
        return _let(F.struct(chosen.alias("e"), bare.alias("s")), lambda x: _tests(x["e"], x["s"]))

    return _let(value, encoded)


def _count(s: Column, part: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, part, F.lit("")))).cast("double")


def _tests(encoding: Column, s: Column) -> Column:
    name, alphabet = encoding["name"], encoding["alphabet"]
    symbols = F.transform(F.split(s, ""), lambda c: F.instr(alphabet, c).cast("double"))

    def counts(x: Column) -> Column:
        """Sums that the three statistics are made of."""
        halves = F.array_join(F.transform(x["v"], lambda v: F.when(v * 2 > x["size"], "1").otherwise("0")), "")
        squares = F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0),
                              lambda acc, c: acc + F.pow(_count(s, c), F.lit(2.0)))
        return _let(F.struct(x["v"].alias("v"), x["size"].alias("size"), x["n"].alias("n"), squares.alias("squares"),
                             halves.alias("halves"), (F.aggregate(x["v"], F.lit(0.0), lambda a, v: a + v) / x["n"]).alias("centre")),
                    statistics)

    def statistics(x: Column) -> Column:
        n, c = x["n"], x["centre"]
        ones = _count(x["halves"], F.lit("1"))
        changes = (_count(x["halves"], F.lit("01")) + _count(x["halves"], F.lit("10"))) / 2
        power = F.aggregate(x["v"], F.lit(0.0), lambda a, v: a + (v - c) * (v - c))
        pairs = F.zip_with(F.slice(x["v"], 1, F.greatest(F.size(x["v"]) - 1, F.lit(0))), F.slice(x["v"], 2, F.size(x["v"])),
                           lambda a, b: (a - c) * (b - c))
        return _let(F.struct(n.alias("n"), x["size"].alias("size"), (x["size"] / n * x["squares"] - n).alias("chi"),
                             (2 * ones * (n - ones) / n + 1).alias("mean"), (changes + 1).alias("runs"), power.alias("power"),
                             F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v).alias("lag"), (x["size"] - 1).alias("free"),
                             (n * F.greatest(x["size"] * encoding["agrees"] - 1, F.lit(0.0))).alias("shift")), verdict)

    def verdict(x: Column) -> Column:
        n, free, shift = x["n"], x["free"], x["shift"]
        # uniformity (Wilson and Hilferty), runs of the halves, serial correlation
        z_chi = (F.pow(x["chi"] / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        var = (x["mean"] - 1) * (x["mean"] - 2) / (n - 1)
        z_runs = F.when((n > 1) & (var > 0), F.abs(x["runs"] - x["mean"]) / F.sqrt(var)).otherwise(10.0)
        z_lag = F.when(x["power"] > 0, F.abs(x["lag"] / x["power"] + 1 / n) * F.sqrt(n)).otherwise(10.0)
        random = (_tail(z_chi) >= KEEP_P) & (2 * _tail(z_runs) >= KEEP_P) & (2 * _tail(z_lag) >= KEEP_P)
        # under the text hypothesis the statistic is non-central
        z_text = (free + shift - x["chi"]) / F.sqrt(2 * (free + 2 * shift))
        logp = F.when(shift > 0, -F.log10(F.greatest(_tail(z_text), F.lit(1e-15)))).otherwise(0.0)
        return F.struct(F.concat_ws(":", name, F.floor(F.log2(n)).cast("string")).alias("class"),
                        F.coalesce(logp, F.lit(0.0)).alias("logp"), F.coalesce(random, F.lit(False)).alias("random"))

    return _let(F.struct(symbols.alias("v"), F.length(alphabet).cast("double").alias("size"),
                         F.greatest(F.length(s), F.lit(1)).cast("double").alias("n")), counts)


def _binned(logp: Column) -> Column:
    return F.floor(logp / BIN).cast("int")


def cuts(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """Least bin of -log10 p that Benjamini-Hochberg accepts, by class."""
    t = F.coalesce(F.col(text), F.lit(""))
    tested = (docs.where(F.col(text).rlike(CANDIDATE))
              .withColumn("_base", base_spans(t))
              .select(F.explode_outer(candidates(t, F.col("_base"))).alias("c")).where(F.col("c").isNotNull())
              .select(battery(F.col("c")["value"]).alias("b")))
    by_bin = tested.groupBy(F.col("b")["class"].alias("class"), _binned(F.col("b")["logp"]).alias("bin")).count()
    one = Window.partitionBy("class")
    ranked = by_bin.select("class", "bin", F.sum("count").over(one).alias("m"),
                           F.sum("count").over(one.orderBy(F.desc("bin"))).alias("rank"))
    # a bin's largest p-value is at its lower edge
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("bin") * BIN) * F.col("m") <= FDR * F.col("rank"))
    return {r["class"]: r["bin"] for r in passed.groupBy("class").agg(F.min("bin").alias("bin")).collect()}


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans`` (all): arrays of
    struct<start,rank,kind,end,value>, sorted by start, then kind."""
    cut = cuts(docs, text)
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("base", base_spans(t))
    if not cut:
        return out.withColumn("spans", F.col("base"))
    least = F.create_map(*(F.lit(x) for kv in sorted(cut.items()) for x in kv))

    def flagged(s: Column) -> Column:
        b = battery(s["value"])
        return F.exists(F.array(b), lambda x: x["random"] & (_binned(x["logp"]) >= F.coalesce(least[x["class"]], F.lit(1 << 30))))

    added = F.filter(candidates(t, F.col("base")), flagged)
    return out.withColumn("spans", F.when(t.rlike(CANDIDATE), F.array_sort(F.concat("base", added))).otherwise(F.col("base")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each stretch that spans cover replaced by the mask."""
    done = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.when(s["start"] < acc["at"], acc["parts"]).otherwise(F.concat(acc["parts"], F.array(
                F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK)))).alias("parts"))),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
