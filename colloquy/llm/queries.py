"""The operators as registered queries, each over its whole table with
production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import (chat_tools, collocations, decontaminate, entropy_mix, jaccard_join, language_id, periodic_runs, permutation_index,
               secret_scan, sentencepiece_codec, substring_dedup, token_counts, url_filter)
from .common import ship_package

MODEL = "/opt/tokenizers/piece_bpe_32k.model"

# Fixed values of the url filter's contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))

# Tools that the chats' derived calls name.
TOOLS = "name string, field string, kind string, required boolean"
SCHEMAS = [("search", "query", "string", True), ("search", "limit", "integer", False), ("search", "exact", "boolean", False),
           ("lookup", "query", "string", True), ("lookup", "limit", "integer", True),
           ("compute", "query", "string", True), ("compute", "limit", "number", False), ("compute", "exact", "boolean", True)]


def q_op1_sentencepiece(spark: SparkSession, sf: str, model: str = MODEL) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    coded = sentencepiece_codec.encode(docs, sentencepiece_codec.read_model(model))
    return coded.select("doc_id", "ids", "n_tokens", "n_fallback", "parity", "lossless")


def tool_rows(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that the conversations stand for. Every assistant
    turn is a call with arguments made of its text; every user turn is the
    result of the call in the turn before it. The length of the text decides
    which tool is called, what is wrong with its arguments, and whether it
    depends on the call two turns before or two turns later."""
    n = F.length("text")
    call_id = lambda t: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), t.cast("string"))
    name = F.when(n % 3 == 0, "search").when(n % 3 == 1, "lookup").otherwise("compute")
    limit = F.when(n % 7 == 0, F.concat(F.lit('"'), n.cast("string"), F.lit('"'))).otherwise(n.cast("string"))
    quoted = F.expr("substring(to_json(named_struct('q', text)), 6, length(to_json(named_struct('q', text))) - 6)")
    parts = F.concat_ws(", ", F.when(n % 11 != 0, F.concat(F.lit('"query": '), quoted)), F.concat(F.lit('"limit": '), limit),
                        F.when(n % 2 == 0, F.lit('"exact": true')))
    arguments = F.concat(F.lit("{ "), parts, F.when(n % 13 == 0, " } trailing").otherwise(" }"))
    on = F.array(F.when(n % 5 == 0, call_id(F.col("turn") + 2)).otherwise(call_id(F.col("turn") - 2)))
    calls = conversations.where("role = 'assistant'").select(
        "conv_id", "turn", call_id(F.col("turn")).alias("call_id"), name.alias("name"), arguments.alias("arguments"), on.alias("depends_on"))
    results = conversations.where("role = 'user' and turn > 0").select(
        "conv_id", "turn", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def q_op2_chat_tools(spark: SparkSession, sf: str) -> DataFrame:
    calls, results = tool_rows(read_table(spark, sf, "conversations"))
    return chat_tools.link_calls(calls, results, spark.createDataFrame(SCHEMAS, TOOLS))


def q_op3_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, read_table(spark, sf, "benchmark"), ["doc_id"])


def _number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def q_op4_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_scan.scan(read_table(spark, sf, "documents").select("doc_id", "text"))
    base = F.col("base")
    return found.select("doc_id", *(_number(base, k) for k in secret_scan.KINDS),
                        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def q_op5_token_counts(spark: SparkSession, sf: str, model: str = MODEL) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, sentencepiece_codec.read_model(model))


def q_op6_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def q_op7_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.similar(read_table(spark, sf, "documents"), 3, 90, 100).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id")


def q_op8_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def q_op9_nearest(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    return permutation_index.search(vectors, vectors.where("vec_id % 20 = 0"), 20)


def q_op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    samples = language_id.learn(docs.where(~language_id.is_held_out()))
    return language_id.identify(docs.select("doc_id", "text"), samples).select(
        "doc_id", language_id.is_held_out().alias("held_out"), "lang_pred", "score")


def looped(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with the repetition that the contract of
    periodic runs plants: in one of ten documents, by a checksum of doc_id,
    the words from a certain one on repeat those that follow it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n, g = F.size("ws").cast("long"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    # array positions are ints; the words before a keep their place
    tail = F.transform(F.sequence(a, n - 1), lambda i: F.get("ws", (a + (i - a) % p).cast("int")))
    turned = F.array_join(F.concat(F.slice("ws", F.lit(1), a.cast("int")), tail), " ")
    told = docs.withColumn("ws", F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    planted = (h % 10 == 0) & (F.size("ws") > 0)
    return told.select("doc_id", F.when(planted, turned).otherwise(F.col("text")).alias("text"))


def q_op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = looped(read_table(spark, sf, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    # runs come by start, so the first of the greatest length / period is the one to keep
    best = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda top, r: F.when(
        top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    return (found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256")))


def q_op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf, "documents").select("text", "lang"))


def q_op13_mix(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "source", entropy_mix.word_count().alias("size"))
    mixed = entropy_mix.entropy_mix(docs, entropy_mix.cyclic_weights(docs))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name.removeprefix("q_"): _shipped(query) for name, query in list(globals().items()) if name.startswith("q_op")}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE: dict[str, str] = {
    "op6_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM words),
win AS (
  SELECT doc_id, p, w, count(*) OVER nx AS n, sha256(string_agg(w, ' ') OVER nx) AS h FROM word
  WINDOW nx AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
flagged AS (
  SELECT doc_id, p, w, (n = 50 AND min(doc_id) OVER (PARTITION BY h) < doc_id)::INT AS bad FROM win),
covered AS (
  SELECT doc_id, p, w, max(bad) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM flagged)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(c.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(c.kept, '')) AS kept_sha256
FROM words d LEFT JOIN (
  SELECT doc_id, sum(gone) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM covered GROUP BY doc_id) c
USING (doc_id)""",
    "op7_jaccard_join": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node) r USING (doc_id)""",
    # crc32 bit by bit; repeated stretches of eight words propose periods, of which the maximal stretches are kept
    "op11_periodic_runs": r"""
WITH base AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda crc, c:
      list_reduce(range(8)::BIGINT[], lambda t, k: xor(t >> 1, (t & 1) * 3988292384), xor(crc, c)), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM documents),
parts AS (SELECT *, len(ws) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM base),
turned AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE ws[1:a] || list_transform(range(a, n), lambda i: ws[a + (i - a) % p + 1]) END AS ws
  FROM (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM parts) x),
word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM turned),
eight AS (
  SELECT doc_id, i, CASE WHEN count(*) OVER nx = 8 THEN string_agg(w, ' ') OVER nx END AS f FROM word
  WINDOW nx AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
periods AS (SELECT DISTINCT x.doc_id, y.i - x.i AS q FROM eight x JOIN eight y ON x.doc_id = y.doc_id AND x.f = y.f AND x.i < y.i),
same AS (
  SELECT p.doc_id, p.q, x.i, x.i - row_number() OVER (PARTITION BY p.doc_id, p.q ORDER BY x.i) AS island
  FROM periods p JOIN word x ON x.doc_id = p.doc_id JOIN word y ON y.doc_id = p.doc_id AND y.i = x.i + p.q AND y.w = x.w),
kept AS (
  SELECT doc_id, start, length, min(q) AS period FROM (
    SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM same GROUP BY doc_id, q, island) s
  WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
best AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM kept GROUP BY doc_id),
gone AS (SELECT DISTINCT k.doc_id, w.i FROM kept k JOIN word w ON w.doc_id = k.doc_id AND w.i >= k.start + k.period AND w.i < k.start + k.length),
left_ AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(l.n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period,
       (1000 * b.length // b.period)::BIGINT AS exponent_milli, sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(c.t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN best b USING (doc_id) LEFT JOIN listed l USING (doc_id) LEFT JOIN left_ c USING (doc_id)""",
    "op12_collocations": rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
seq AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(t, '[^\x20\x09]+') AS ws FROM piece),
word AS (SELECT id, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM seq),
win AS (SELECT lang, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM word WINDOW o AS (PARTITION BY id ORDER BY p)),
grams AS (
  SELECT lang, a AS phrase, 1 AS k FROM win
  UNION ALL SELECT lang, a || ' ' || b, 2 FROM win WHERE b IS NOT NULL
  UNION ALL SELECT lang, a || ' ' || b || ' ' || c, 3 FROM win WHERE c IS NOT NULL),
f AS (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL),
cand AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
inside AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, regexp_extract(phrase, '^(.*) [^ ]*$', 1) AS phrase, f FROM cand WHERE k = 3
    UNION ALL SELECT lang, regexp_extract(phrase, '^[^ ]* (.*)$', 1), f FROM cand WHERE k = 3) GROUP BY ALL),
free AS (SELECT c.* FROM cand c LEFT JOIN inside i USING (lang, phrase) WHERE i.f IS NULL OR 100 * i.f < 50 * c.f),
cuts AS (
  SELECT lang, phrase, f AS a, 1 AS cut, regexp_extract(phrase, '^[^ ]*') AS x, regexp_extract(phrase, '^[^ ]* (.*)$', 1) AS y FROM free
  UNION ALL SELECT lang, phrase, f, 2, regexp_extract(phrase, '^(.*) [^ ]*$', 1), regexp_extract(phrase, '[^ ]*$') FROM free WHERE k = 3),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.phrase = c.y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000""",
    "op8_url_filter": f"""
WITH parts AS (
  SELECT page_id, {_LOWER.format("regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's')")} AS host,
         regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
split AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path FROM parts),
rules(verdict, h, p) AS (VALUES {', '.join(str(r) for r in RULES)}),
fits AS (
  SELECT page_id, h || p AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(p) DESC) AS k
  FROM split JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN (SELECT * FROM fits WHERE k = 1) f USING (page_id)""",
}
