"""Queries over the benchmark tables, one per operator, with their DuckDB counterparts.

Text: an artifact is a document source, a class a document, a unit a word. Sequences: an event log per user.
Sets: the parts of a customer's orders. Hierarchies: region, nation, market segment.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigweave.functions import hashing, normalise
from sigweave.functions.formula import compile_formula
from sigweave.operators import assignment, catalogue, detection, kgrams, lifting, rollup, selection, sequences, similarity, sketches, text_pairs, votes
from sigweave.sources import archives, results, signatures
from sigweave.sources.storage import materialise

K = 5
PRIME = sketches.PRIMES[2]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- inputs, and the same in SQL

SQL_WORDS = "list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '')"
SQL_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split({0}, ''), lambda c: CASE WHEN c = '' THEN 0 ELSE unicode(c) END::BIGINT)), lambda a, b: (a * 31 + b) % 4294967296)"
SQL_DOC_GRAMS = f"""w AS (SELECT doc_id, source, lang, {SQL_WORDS} AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, source, lang, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS gram FROM w)"""
SQL_ITEM_GRAMS = f"""bw AS (SELECT item_id, {SQL_WORDS} AS ws FROM benchmark),
b AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS gram FROM bw)"""
SQL_FOLD = "1"
for _h in ("h", "h1", "h2", "h3", "h4"):
    SQL_FOLD = f"(({SQL_FOLD} * 31 + {_h}) % 4294967296)"
SQL_HASHES = f"""u AS (SELECT DISTINCT unnest({SQL_WORDS}) AS word FROM documents),
hw AS (SELECT word, {SQL_HASH.format("word")} AS h FROM u),
p AS (SELECT doc_id, source, lang, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, source, lang, {SQL_WORDS} AS ws FROM documents)),
s AS (SELECT doc_id, source, lang, i, h, lead(h, 1) OVER v AS h1, lead(h, 2) OVER v AS h2, lead(h, 3) OVER v AS h3, lead(h, 4) OVER v AS h4 FROM p JOIN hw USING (word) WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
h5 AS (SELECT source, lang, {SQL_FOLD} AS h FROM s WHERE h4 IS NOT NULL)"""
SQL_BITS = f"""{SQL_HASHES},
bits AS (SELECT DISTINCT source, lang, (h % {PRIME})::INT AS bit FROM h5)"""


def document_grams(spark: SparkSession, sf: str, hashed: bool = False) -> DataFrame:
    """(doc_id, source, lang, gram or h), distinct 5-word grams of whole documents, or their hashes."""
    return kgrams.text_kgrams(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), "text", K, hashed)


def item_grams(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, h)."""
    return kgrams.text_kgrams(table(spark, sf, "benchmark").select("item_id", "text"), "text", K, hashed=True)


def document_bits(spark: SparkSession, sf: str, columns: tuple[str, ...] = ("source",), prime: int = PRIME) -> DataFrame:
    """(columns, bit) of the documents' hashed 5-grams."""
    return sketches.text_bits(table(spark, sf, "documents").select(*columns, "text"), "text", K, prime)


def numbered(docs: DataFrame) -> bool:
    """Whether doc_id tells all documents that have one apart by a whole number, as the packed operators need it."""
    whole = docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    return whole and docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


# ---------------------------------------------------------------- k-grams


@query(f"WITH {SQL_DOC_GRAMS} SELECT doc_id, gram FROM g")
def kgram_linear_text(spark, sf):
    return document_grams(spark, sf).select("doc_id", "gram")


@query("""WITH s AS (SELECT user_id, event_type AS a, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, a || ' ' || b || ' ' || c AS gram, count(*) AS n FROM s WHERE c IS NOT NULL GROUP BY ALL""")
def kgram_linear_events(spark, sf):
    grams = kgrams.ordered_kgrams(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type", 3)
    return grams.groupBy("user_id", F.array_join("kgram", " ").alias("gram")).agg(F.count("*").alias("n"))


def transitions(spark, sf) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf, "events")
    nodes = events.select(F.col("user_id").alias("entity"), F.col("event_type").alias("node")).distinct().withColumn("unit", F.col("node"))
    pairs = kgrams.ordered_kgrams(events, "user_id", ["ts", "event_id"], "event_type", 2)
    return nodes, pairs.select(F.col("user_id").alias("entity"), F.element_at("kgram", 1).alias("node"), F.element_at("kgram", 2).alias("next")).distinct()


@query("""WITH e AS (SELECT DISTINCT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events QUALIFY b IS NOT NULL)
SELECT x.user_id, x.a || ' ' || x.b || ' ' || y.b AS gram, count(*) AS n FROM e x JOIN e y ON x.user_id = y.user_id AND x.b = y.a GROUP BY ALL""")
def kgram_cfg(spark, sf):
    nodes, following = transitions(spark, sf)
    return kgrams.graph_kgrams(nodes, following, 3).select(F.col("entity").alias("user_id"), F.array_join("kgram", " ").alias("gram"), "n")


# A control-flow graph as (units, blocks that follow), and the multiset of its walks of five units.
FIXTURE_BLOCKS = [("A B", (1, 4, 5)), ("C D", (2, 3)), ("E F G", (3,)), ("H", (6,)), ("C", (4, 5)), ("D E", (6,)), ("R", ())]
FIXTURE_GRAMS = "ABCDE ABCDH ABCCC ABCCD ABCDE ABDER BCDEF BCDHR BCCCC BCCCD BCCDE BCDER CDEFG DEFGH EFGHR CCCCC CCCCD CCCDE CCDER"


@query(f"SELECT gram, count(*) AS n FROM (SELECT unnest(string_split('{FIXTURE_GRAMS}', ' ')) AS gram) GROUP BY gram")
def kgram_fixture(spark, sf):
    blocks = spark.createDataFrame([(0, i, u.split()) for i, (u, _) in enumerate(FIXTURE_BLOCKS)], "entity int, block int, units array<string>")
    edges = spark.createDataFrame([(0, i, d) for i, (_, s) in enumerate(FIXTURE_BLOCKS) for d in s], "entity int, src int, dst int")
    return kgrams.graph_kgrams(*kgrams.unit_successors(blocks, edges), K).select(F.array_join("kgram", "").alias("gram"), "n")


@query("""WITH s AS (SELECT user_id, event_type AS a, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c,
(value < 50)::INT AS x, lead((value < 50)::INT, 1) OVER w AS y, lead((value < 50)::INT, 2) OVER w AS z FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, a || ' ' || b || ' ' || c AS gram FROM s WHERE c IS NOT NULL AND 'error' IN (a, b, c) GROUP BY ALL HAVING count(DISTINCT coalesce(x::VARCHAR, '') || ',' || coalesce(y::VARCHAR, '') || ',' || coalesce(z::VARCHAR, '')) = 1""")
def kgram_unique_condition(spark, sf):
    unit = F.struct(F.col("event_type").alias("instr"), F.coalesce((F.col("value") < 50).cast("int").cast("string"), F.lit("")).alias("ref"))
    grams = kgrams.ordered_kgrams(table(spark, sf, "events").withColumn("unit", unit), "user_id", ["ts", "event_id"], "unit", 3)
    grams = grams.select("user_id", F.col("kgram.instr").alias("instr"), F.array_join("kgram.ref", ",").alias("refs"))
    return kgrams.unique_kgrams(grams, "user_id", "instr", "refs", lambda u: u == "error").select("user_id", F.array_join("instr", " ").alias("gram"))


@query("SELECT p_partkey, " + SQL_HASH.format("p_name") + " AS h FROM part")
def java_hash_units(spark, sf):
    return table(spark, sf, "part").select("p_partkey", hashing.text_hash(F.col("p_name")).alias("h"))


@query("WITH u AS (SELECT p_partkey, list_transform(string_split(p_type, ' '), lambda s: " + SQL_HASH.format("s") + ") AS hs FROM part) SELECT p_partkey, list_reduce(list_prepend(1::BIGINT, hs), lambda a, b: (a * 31 + b) % 4294967296) AS h FROM u")
def kgram_hash(spark, sf):
    units = F.transform(F.split("p_type", " "), hashing.text_hash)
    return table(spark, sf, "part").select("p_partkey", hashing.sequence_hash(units).alias("h"))


# ---------------------------------------------------------------- sketches


@query(f"WITH {SQL_BITS} SELECT DISTINCT source, bit FROM bits")
def bit_bucket(spark, sf):
    return document_bits(spark, sf)


@query(f"WITH {SQL_BITS} SELECT source, count(DISTINCT bit) AS bits_set, round(count(DISTINCT bit) / {PRIME}.0::DOUBLE, 6) AS share FROM bits GROUP BY source")
def bit_popcount(spark, sf):
    return sketches.population(document_bits(spark, sf), "source", PRIME).withColumn("share", F.round("share", 6))


@query(f"""WITH {SQL_ITEM_GRAMS}, n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)
SELECT item_id, n, CASE WHEN n <= 13 THEN 0 WHEN n <= 37 THEN 1 WHEN n <= 105 THEN 2 WHEN n <= 299 THEN 3 ELSE 4 END AS prime_idx FROM n""")
def prime_index(spark, sf):
    n = item_grams(spark, sf).groupBy("item_id").agg(F.count("*").alias("n"))
    return n.withColumn("prime_idx", sketches.prime_index(F.col("n")))


@query(f"""WITH {SQL_BITS}, v AS (SELECT source, count(DISTINCT lang) AS k FROM bits GROUP BY source)
SELECT source, bit FROM bits JOIN v USING (source) GROUP BY source, bit, k HAVING count(DISTINCT lang) = k""")
def stats_bit_and(spark, sf):
    return sketches.common_bits(document_bits(spark, sf, ("source", "lang")), "source", "lang")


@query(f"""WITH {SQL_BITS}, f AS (SELECT bit, count(DISTINCT source) AS f FROM bits GROUP BY bit), e AS (SELECT unnest(range(1, f + 1)) AS freq FROM f), a AS (SELECT freq, count(*) AS bits FROM e GROUP BY freq)
SELECT freq, bits, round(bits / sum(bits) OVER ()::DOUBLE, 6) AS share, round(sum(bits) OVER (ORDER BY freq DESC ROWS UNBOUNDED PRECEDING) / sum(bits) OVER ()::DOUBLE, 6) AS running_share FROM a""")
def stats_bit_frequency(spark, sf):
    return sketches.bit_frequency(document_bits(spark, sf), "source")


SQL_CONTAINED = f"""{SQL_DOC_GRAMS}, {SQL_ITEM_GRAMS}, n AS (SELECT item_id, count(*) AS size FROM b GROUP BY item_id), sg AS (SELECT DISTINCT source, gram FROM g),
c AS (SELECT item_id, source, count(*) AS shared FROM b JOIN sg USING (gram) GROUP BY ALL), r AS (SELECT item_id, source, shared, size, shared / size::DOUBLE AS score FROM c JOIN n USING (item_id))"""


def contained(spark, sf) -> DataFrame:
    return sketches.containment(item_grams(spark, sf), document_grams(spark, sf, hashed=True).select("source", "h"), "item_id", "source")


@query(f"WITH {SQL_CONTAINED} SELECT item_id, source, shared, size, round(score, 6) AS score FROM r")
def containment(spark, sf):
    return contained(spark, sf).withColumn("score", F.round("score", 6))


@query(f"""WITH {SQL_CONTAINED}, {SQL_HASHES}, pops AS (SELECT source, count(DISTINCT h % {sketches.ARTIFACT_PRIME}) / {sketches.ARTIFACT_PRIME}::DOUBLE AS pop FROM h5 GROUP BY source)
SELECT item_id, r.source, round(score, 6) AS score FROM r JOIN pops ON pops.source IS NOT DISTINCT FROM r.source WHERE score >= greatest(0.1 + pop, 0.9 - 0.2 * log10(greatest(1, size)))""")
def sketch_filter(spark, sf):
    """Items that a source may hold; the threshold grows with the part of the whole sketch that the source's own bits fill."""
    pops = sketches.population(document_bits(spark, sf, prime=sketches.ARTIFACT_PRIME), "source", sketches.ARTIFACT_PRIME).select(F.col("source").alias("of"), F.col("share").alias("pop"))
    scores = contained(spark, sf)
    return selection.sketch_filter(scores.join(pops, scores["source"].eqNullSafe(pops["of"])), F.col("pop")).select("item_id", "source", F.round("score", 6).alias("score"))


@query("SELECT c_mktsegment, count(*) AS size, round(greatest(0.1, 0.7 - 0.15 * log10(greatest(1, count(*)))), 6) AS threshold FROM customer GROUP BY c_mktsegment")
def detection_threshold(spark, sf):
    sizes = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("size"))
    return sizes.withColumn("threshold", F.round(selection.detection_threshold(F.col("size")), 6))


@query("SELECT p_partkey, round(least(p_size / 50.0::DOUBLE, sqrt(p_retailprice) / 100) + power(greatest(1.0, log10(p_retailprice)), 2), 6) AS v FROM part")
def user_formula(spark, sf):
    v = compile_formula("min(size / 50, sqrt(price) / 100) + max(1, log10(price)) ^ 2", {"size": F.col("p_size"), "price": F.col("p_retailprice")})
    return table(spark, sf, "part").select("p_partkey", F.round(v, 6).alias("v"))


@query(f"""WITH {SQL_CONTAINED}, d AS (SELECT DISTINCT source, score FROM r), k AS (SELECT source, score, row_number() OVER (PARTITION BY source ORDER BY score DESC) AS i FROM d),
t AS (SELECT source, least(max(score) - 0.03, coalesce(max(score) FILTER (WHERE i = 2), 0)) AS lo FROM k GROUP BY source)
SELECT source, item_id, round(score, 6) AS score FROM r JOIN t USING (source) WHERE score > lo""")
def scan_window(spark, sf):
    return selection.scan_window(contained(spark, sf), within=["source"]).select("source", "item_id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- similarity joins


@query("""WITH s AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT c, count(*) AS n FROM s GROUP BY c),
x AS (SELECT a.c AS a, b.c AS b, count(*) AS shared FROM s a JOIN s b ON a.p = b.p AND a.c < b.c GROUP BY ALL)
SELECT a, b, shared, round(2 * shared / (m.n + k.n)::DOUBLE, 6) AS dice FROM x JOIN n m ON m.c = a JOIN n k ON k.c = b WHERE 2 * shared / (m.n + k.n)::DOUBLE > 0.08""")
def dice_customers(spark, sf):
    lines, orders = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    sets = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(F.col("o_custkey").alias("c"), F.col("l_partkey").alias("h"))
    return similarity.dice_self_join(sets, "c", least=0.08).withColumn("dice", F.round("dice", 6))


@query(f"""WITH {SQL_DOC_GRAMS}, n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT a, b, shared, round(2 * shared / (m.n + k.n)::DOUBLE, 6) AS dice FROM x JOIN n m ON m.doc_id = a JOIN n k ON k.doc_id = b WHERE 2 * shared / (m.n + k.n)::DOUBLE > 0.1""")
def dice_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    if not numbered(docs):
        return similarity.dice_self_join(document_grams(spark, sf, hashed=True).select("doc_id", "h"), "doc_id", least=0.1).withColumn("dice", F.round("dice", 6))
    return text_pairs.dice(docs.where("doc_id IS NOT NULL"), "doc_id", "text", K, 0.1).withColumn("dice", F.round("dice", 6))


@query(f"""WITH {SQL_DOC_GRAMS}, m AS (SELECT doc_id, source, lang, len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS methods, n_chars AS weight FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), x AS (SELECT a.doc_id AS l, b.doc_id AS a, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.source = 'src0' AND b.source <> 'src0' GROUP BY ALL)
SELECT l, a, round(shared / n::DOUBLE, 6) AS score FROM x JOIN n ON n.doc_id = l JOIN m lm ON lm.doc_id = l JOIN m am ON am.doc_id = a
WHERE shared / n::DOUBLE > 0.1 AND lm.methods > 0 AND am.methods > 0 AND lm.weight > 0 AND am.weight > 0 AND am.methods <= lm.methods AND (lm.lang IS NULL OR lm.lang = am.lang)""")
def class_candidates(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", F.size(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("methods"), "n_chars")
    grams = document_grams(spark, sf, hashed=True).select("doc_id", "source", "h")
    side = lambda p, c: docs.where(c).select(F.col("doc_id").alias(p), F.col("lang").alias(f"{p}_super"), F.col("methods").alias(f"{p}_methods"), F.col("n_chars").alias(f"{p}_weight"))
    library, app = F.col("source") == "src0", F.col("source") != "src0"
    sets = similarity.candidates(side("l", library), side("a", app), grams.where(library).select(F.col("doc_id").alias("l"), "h"), grams.where(app).select(F.col("doc_id").alias("a"), "h"))
    return sets.withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- votes

SQL_VOTES = """v AS (SELECT c_mktsegment AS k, o_orderpriority AS v, sum(o_totalprice / 1000) AS s, sum(o_totalprice) AS w FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
n AS (SELECT k, v, s / sum(w) OVER (PARTITION BY k) AS vote FROM v)"""


def segment_votes(spark, sf) -> DataFrame:
    orders, customers = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_totalprice"), table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    cast = rows.select(F.col("c_mktsegment").alias("k"), F.col("o_orderpriority").alias("v"), (F.col("o_totalprice") / 1000).alias("score"), F.col("o_totalprice").alias("weight"))
    return votes.normalised(cast)


@query(f"WITH {SQL_VOTES} SELECT k, v, round(vote, 9) AS vote FROM n")
def votes_normalised(spark, sf):
    return segment_votes(spark, sf).withColumn("vote", F.round("vote", 9))


@query(f"WITH {SQL_VOTES} SELECT k, v, round(vote, 9) AS vote FROM n QUALIFY row_number() OVER (PARTITION BY k ORDER BY vote DESC, v) = 1")
def votes_best(spark, sf):
    return votes.best(segment_votes(spark, sf)).withColumn("vote", F.round("vote", 9))


@query("""WITH r AS (SELECT n_regionkey AS l, n_nationkey AS item FROM nation), c AS (SELECT l, count(*) AS n FROM r GROUP BY l)
SELECT x.item AS k, y.item AS v, round(0.5 * 10 / (cx.n * cy.n), 6) AS score, 10 AS weight FROM r x JOIN r y ON y.l = (x.l + 1) % 5 JOIN c cx ON cx.l = x.l JOIN c cy ON cy.l = y.l""")
def interface_votes(spark, sf):
    nation = table(spark, sf, "nation")
    left = nation.select(F.col("n_regionkey").alias("l"), F.col("n_nationkey").alias("item"))
    pairs = left.select("l").distinct().select("l", ((F.col("l") + 1) % 5).alias("a"), F.lit(0.5).alias("sim"), F.lit(10).alias("w"))
    return votes.set_votes(pairs, left, left.withColumnRenamed("l", "a")).withColumn("score", F.round("score", 6))


@query(f"WITH {SQL_VOTES} SELECT k, v, round(0.01 * (length(v) / 100.0)::DOUBLE + 0.99 * vote, 9) AS blended FROM n")
def call_blend(spark, sf):
    return segment_votes(spark, sf).select("k", "v", F.round(votes.blended(F.length("v") / 100, F.col("vote")), 9).alias("blended"))


@query(f"""WITH {SQL_VOTES}, m AS (SELECT k, v, vote, length(v) AS lm, length(k) AS am, CASE WHEN length(v) = 5 THEN 1.0 ELSE 0.5 END AS init FROM n)
SELECT k, v, round(CASE WHEN init = 1 THEN greatest(CASE WHEN am > lm THEN 0 ELSE vote END, 1e-6) ELSE CASE WHEN am > lm THEN 0 ELSE vote END END, 9) AS sim FROM m""")
def next_matrix(spark, sf):
    init = F.when(F.length("v") == 5, 1.0).otherwise(0.5)
    return segment_votes(spark, sf).select("k", "v", F.round(votes.next_similarity(F.col("vote"), init, F.length("v"), F.length("k")), 9).alias("sim"))


# ---------------------------------------------------------------- hierarchies

SQL_TREE = """c AS (SELECT r_name || '.' || n_name || '.' || c_mktsegment || '.' || c_name AS name, count(*) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
e AS (SELECT unnest(range(0, len(string_split(name, '.')))) AS depth, string_split(name, '.') AS parts, w FROM c), t AS (SELECT array_to_string(parts[1:depth], '.') AS prefix, depth, sum(w)::BIGINT AS weight FROM e GROUP BY ALL)"""


def tree(spark, sf) -> DataFrame:
    customer, nation, region = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rollup.rollup(rows.select(F.concat_ws(".", "r_name", "n_name", "c_mktsegment", "c_name").alias("name"), F.lit(1).cast("long").alias("w")), "name", "w")


@query(f"WITH {SQL_TREE} SELECT prefix, depth, weight FROM t")
def pkg_rollup(spark, sf):
    return tree(spark, sf)


SQL_SHARES = f"""{SQL_TREE}, b AS (SELECT CASE WHEN depth = 1 THEN '' ELSE array_to_string(string_split(prefix, '.')[1:depth - 1], '.') END AS prefix, sum(weight) AS below, count(*) AS children FROM t WHERE depth > 0 GROUP BY 1),
o AS (SELECT t.prefix, depth, weight, (weight - coalesce(below, 0))::BIGINT AS own, coalesce(children, 0) AS children, max(weight) OVER () AS total FROM t LEFT JOIN b USING (prefix))"""


@query(f"WITH {SQL_SHARES} SELECT prefix, depth, weight, own, children, round(own / total::DOUBLE, 6) AS own_share, round(weight / total::DOUBLE, 6) AS total_share FROM o")
def pkg_own_share(spark, sf):
    shares = rollup.own_share(tree(spark, sf))
    return shares.withColumns({c: F.round(c, 6) for c in ("own_share", "total_share")})


@query(f"WITH {SQL_SHARES} SELECT prefix, weight FROM o WHERE depth = 0 OR own <> 0 OR children <> 1")
def pkg_collapsed(spark, sf):
    return rollup.collapsed(rollup.own_share(tree(spark, sf))).select("prefix", "weight")


@query(f"""WITH {SQL_SHARES} SELECT prefix, repeat('  ', depth) || CASE WHEN prefix = '' THEN '<default package>' ELSE prefix END || printf(' %.5f%%', own * 100 / total::DOUBLE) || CASE WHEN children > 0 THEN printf(' (%.5f%%)', weight * 100 / total::DOUBLE) ELSE '' END AS line FROM o""")
def pkg_report(spark, sf):
    return rollup.rendered(rollup.own_share(tree(spark, sf)))


# ---------------------------------------------------------------- catalogues, selection


@query("""WITH x AS (SELECT DISTINCT lang, upper(sha256(text)) AS digest, doc_id::VARCHAR AS v FROM documents)
SELECT lang, digest, string_agg(v, ', ' ORDER BY v) AS label, min(v) AS representative, count(*) AS n FROM x GROUP BY ALL""")
def dedup_index(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "doc_id", hashing.content_hash(F.col("text")).alias("digest"))
    return catalogue.content_index(docs, "lang", "doc_id", "digest").select("lang", "digest", "label", "representative", F.size("versions").cast("long").alias("n"))


@query("SELECT min(doc_id::VARCHAR) AS doc FROM documents GROUP BY lang, sha256(text)")
def dedup_representative(spark, sf):
    docs = table(spark, sf, "documents").select("lang", F.col("doc_id").cast("string").alias("doc"), hashing.content_hash(F.col("text")).alias("digest"))
    return catalogue.representatives(docs, "lang", "doc", "digest").select("doc")


def resolved(spark, sf) -> tuple[DataFrame, DataFrame]:
    results = table(spark, sf, "orders").select(F.col("o_orderkey").alias("result"), F.col("o_totalprice").alias("match"), F.col("o_custkey").alias("c"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("result"), F.col("l_suppkey").alias("member")).distinct()
    members = lines.join(results.select("result", "c"), "result")
    return members, selection.resolve(results, members, order=[F.desc("match"), F.asc("result")], within=["c"])


SQL_RESOLVED = """r AS (SELECT o_custkey AS c, o_orderkey AS result, o_totalprice AS match FROM orders), m AS (SELECT DISTINCT l_orderkey AS result, l_suppkey AS member FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY match DESC, result) AS rank FROM r), h AS (SELECT c, result, rank, member FROM k JOIN m USING (result)),
f AS (SELECT c, member, min(rank) AS first FROM h GROUP BY ALL), lost AS (SELECT DISTINCT result FROM h JOIN f ON h.c = f.c AND h.member = f.member WHERE rank > first)"""


@query(f"WITH {SQL_RESOLVED} SELECT k.result, lost.result IS NULL AS accepted FROM k LEFT JOIN lost USING (result)")
def conflict_resolution(spark, sf):
    return resolved(spark, sf)[1].select("result", "accepted")


@query(f"WITH {SQL_RESOLVED} SELECT DISTINCT c, member FROM h EXCEPT SELECT c, member FROM h WHERE result NOT IN (SELECT result FROM lost)")
def remaining_classes(spark, sf):
    members, results = resolved(spark, sf)
    held = members.drop("c").join(results.select("result", "c", "accepted"), "result")
    return catalogue.remaining(held.select("c", "member").distinct(), held.where("accepted").select("c", "member").distinct(), ["c", "member"])


@query("""WITH m AS (SELECT l_partkey AS key, max_by(l_suppkey, (l_quantity, l_orderkey, l_linenumber)) % 50 AS s FROM lineitem GROUP BY l_partkey),
x AS (SELECT key, CASE WHEN s < 40 THEN CASE WHEN s < 10 THEN key ELSE s END END AS found FROM m), j AS (SELECT x.*, p_partkey IS NOT NULL AS has FROM x LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 40) ON p_partkey = key)
SELECT count(*) FILTER (has AND found = key) AS correct, count(*) FILTER (has AND found <> key) AS wrong_assignment, count(*) FILTER (NOT has AND found IS NOT NULL) AS wrong_detection, count(*) FILTER (has AND found IS NULL) AS unmatched FROM j""")
def error_counters(spark, sf):
    m = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg((F.max_by("l_suppkey", F.struct("l_quantity", "l_orderkey", "l_linenumber")) % 50).alias("s"))
    found = m.select("key", F.when(F.col("s") < 40, F.when(F.col("s") < 10, F.col("key")).otherwise(F.col("s"))).alias("found"))
    return selection.error_counts(found, table(spark, sf, "part").where("p_size <= 40").select(F.col("p_partkey").alias("key")), "key", "found")


# ---------------------------------------------------------------- projections


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._+]+@[A-Za-z0-9.]+', '#', 'g'), '[0-9]+', '#', 'g') AS masked FROM documents")
def mask_identifiers(spark, sf):
    return table(spark, sf, "documents").select("doc_id", normalise.mask_identifiers(F.col("text")).alias("masked"))


@query("""SELECT p_partkey, '<' || CASE WHEN p_size > 25 THEN p_brand ELSE '#' END || ': ' || string_split(p_type, ' ')[1] || ' ' || CASE WHEN p_size > 25 THEN p_name ELSE '#' END || '(' || array_to_string(string_split(p_type, ' ')[2:], ',') || ')>' AS signature,
p_name || '(' || array_to_string(string_split(p_type, ' '), ', ') || ')' AS full_name FROM part""")
def method_signatures(spark, sf):
    platform, parts = F.col("p_size") > 25, F.split("p_type", " ")
    owner = normalise.type_name(F.col("p_brand"), platform)
    signature = normalise.method_signature(owner, F.get(parts, F.lit(0)), F.col("p_name"), F.slice(parts, F.lit(2), F.size(parts)), platform)
    return table(spark, sf, "part").select("p_partkey", signature.alias("signature"), normalise.full_name(F.col("p_name"), parts).alias("full_name"))


@query("SELECT c_mktsegment, printf('%.5f%%', count(*) * 100 / (SELECT count(*) FROM customer)::DOUBLE) AS share FROM customer GROUP BY c_mktsegment")
def percent_format(spark, sf):
    n = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return n.select("c_mktsegment", normalise.percent(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


SQL_TYPE = lambda k: f"CASE WHEN {k} % 4 = 0 THEN 'T' || {k} WHEN {k} % 4 = 3 THEN 'int' ELSE '#' END"
SQL_REFS = lambda k: f"CASE WHEN {k} % 4 IN (1, 2) THEN 1 ELSE 0 END"


def statement_rows(spark, sf) -> DataFrame:
    """Line items as statements of lifted code: an order is a method, the line number a kind of statement, and keys of parts and suppliers are types
    (a quarter each the platform's, the application's, unknown, and no class)."""
    kind = lambda k: F.when(k % 4 == 0, "platform").when(k % 4 == 1, "app").when(k % 4 == 2, "phantom")
    type_ = lambda k: F.struct(F.when(k % 4 == 3, "int").otherwise(F.concat(F.lit("T"), k.cast("string"))).alias("name"), kind(k).alias("status"))
    part, supplier, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    local = lambda k: F.struct(type_(k).alias("local"), F.lit(None).cast("string").alias("text"))
    number = F.struct(F.lit(None).cast(lifting.TYPE).alias("local"), F.col("l_quantity").cast("int").cast("string").alias("text"))
    member = lambda params: F.struct(type_(part).alias("owner"), F.lit("m").alias("name"), type_(supplier).alias("type"), params.cast(f"array<{lifting.TYPE}>").alias("params"), n.cast("int").alias("idx"))

    def value(kind_, **given):
        fields = {"text": F.lit("?"), "op": F.lit(None), "index": F.lit(None), "type": F.lit(None), "base": F.lit(None), "args": F.lit(None), "member": F.lit(None)} | given
        return F.struct(F.lit(kind_).alias("kind"), *(v.alias(k) for k, v in fields.items())).cast(lifting.VALUE)

    none = F.lit(None).cast(lifting.VALUE)
    left = F.when(n.isin(1, 5), value("local", args=F.array(local(part))))
    left = left.when(n == 2, value("invoke", op=F.lit("virtual"), base=local(supplier), args=F.array(number), member=member(F.array(type_(supplier)))))
    left = left.when(n == 3, value("binop", op=F.lit(" < "), args=F.array(local(part), number))).when(n.isin(4, 7), value("local", args=F.array(local(supplier)))).otherwise(none)
    right = F.when(n == 1, value("cast", type=type_(supplier), args=F.array(local(part)))).when(n == 5, value("field", base=local(supplier), member=member(F.lit(None))))
    right = right.when(n == 6, value("parameter", index=F.lit(1), type=type_(part))).otherwise(none)
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("assign", "invoke", "if", "return", "assign", "identity", "throw")]), n)
    rows = table(spark, sf, "lineitem").where("l_linenumber <= 7")
    return rows.select(F.lit("a").alias("artifact"), F.col("l_orderkey").cast("string").alias("cls"), F.lit(0).alias("method"), F.lit(0).alias("block"), n.alias("pos"), kinds.alias("kind"), left.alias("left"), right.alias("right"), F.lit(None).cast("array<string>").alias("keys"))


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, {SQL_TYPE("l_partkey")} AS tp, {SQL_TYPE("l_suppkey")} AS ts, {SQL_REFS("l_partkey")} AS rp, {SQL_REFS("l_suppkey")} AS rs,
CASE WHEN l_partkey % 4 = 0 THEN 'm' ELSE '#' END AS m, l_quantity::INT::VARCHAR AS q FROM lineitem WHERE l_linenumber <= 7)
SELECT l_orderkey::VARCHAR AS cls, n AS pos, CASE n WHEN 1 THEN '<' || tp || '> = (' || ts || ') <' || tp || '>' WHEN 2 THEN 'virtualinvoke <' || ts || '>.<' || tp || ': ' || ts || ' ' || m || '(' || ts || ')>(' || q || ')'
WHEN 3 THEN 'if <' || tp || '> < ' || q WHEN 4 THEN '<' || ts || '>' WHEN 5 THEN '<' || tp || '> = <' || ts || '>.<' || tp || ': ' || ts || ' ' || m || '>' WHEN 6 THEN 'identity @parameter1: ' || tp ELSE 'throw <' || ts || '>' END AS instr,
(CASE n WHEN 1 THEN 2 * rp + rs WHEN 2 THEN rp + 3 * rs WHEN 3 THEN rp WHEN 4 THEN rs WHEN 5 THEN 2 * rp + 2 * rs WHEN 6 THEN rp ELSE rs END)::INT AS refs, n = 2 AND p % 4 <> 0 AS invokes, CASE WHEN n = 2 AND p % 4 = 1 THEN 'T' || p ELSE '' END AS callee,
CASE WHEN p % 4 <> 0 THEN '' WHEN n = 2 THEN '<T' || p || ': ' || CASE WHEN s % 4 = 3 THEN 'int' ELSE 'T' || s END || ' m(' || CASE WHEN s % 4 = 3 THEN 'int' ELSE 'T' || s END || ')>' WHEN n = 5 THEN '<T' || p || ': ' || CASE WHEN s % 4 = 3 THEN 'int' ELSE 'T' || s END || ' m>' ELSE '' END AS platform_ref FROM t""")
def unit_texts(spark, sf):
    """Canonical instructions of line items read as lifted code, and what they refer to."""
    rows = lifting.instructions(statement_rows(spark, sf))
    return rows.select("cls", "pos", "instr", F.size("ref_types").alias("refs"), F.col("has_inv").alias("invokes"), F.coalesce("ref_cls", F.lit("")).alias("callee"), F.coalesce("platform_ref", F.lit("")).alias("platform_ref"))


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS cls, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS up, CASE c_nationkey % 3 WHEN 0 THEN 'platform' WHEN 1 THEN 'app' ELSE 'phantom' END AS status FROM customer),
w AS (SELECT cls, up AS at FROM c UNION ALL SELECT w.cls, c.up FROM w JOIN c ON c.cls = w.at WHERE c.status <> 'platform' AND c.up IS NOT NULL),
f AS (SELECT w.cls, w.at FROM w JOIN c ON c.cls = w.at WHERE c.status = 'platform')
SELECT cls::VARCHAR AS cls, coalesce(f.at::VARCHAR, '') AS lib_super FROM c LEFT JOIN f USING (cls)""")
def platform_superclass(spark, sf):
    """The nearest ancestor that is the platform's, in a tree of customers."""
    status = F.when(F.col("c_nationkey") % 3 == 0, "platform").when(F.col("c_nationkey") % 3 == 1, "app").otherwise("phantom")
    up = F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2).cast("string"))
    classes = table(spark, sf, "customer").select(F.lit("a").alias("artifact"), F.col("c_custkey").cast("string").alias("cls"), status.alias("status"), up.alias("superclass"))
    return lifting.platform_superclass(classes).select("cls", F.coalesce("lib_super", F.lit("")).alias("lib_super"))


SQL_LCS = "w AS (SELECT p_partkey AS k, string_split(p_type || ' ' || p_name, ' ') AS a FROM part), x AS (SELECT w.k, w.a, v.a AS b FROM w JOIN w v ON v.k = w.k + 1)"
_cells = "x"
for _i in range(1, 4):
    for _j in range(1, 4):
        _up, _back, _both = (f"coalesce(c{_i - 1}{_j}, 0)" if _i > 1 else "0"), (f"coalesce(c{_i}{_j - 1}, 0)" if _j > 1 else "0"), (f"coalesce(c{_i - 1}{_j - 1}, 0)" if _i > 1 and _j > 1 else "0")
        _cells = f"(SELECT *, greatest({_up}, {_back}, {_both} + CASE WHEN a[{_i}] = b[{_j}] THEN 1 ELSE 0 END) AS c{_i}{_j} FROM {_cells})"


@query(f"WITH {SQL_LCS} SELECT k, c33::INT AS lcs, round(2 * c33 / (len(a) + len(b))::DOUBLE, 6) AS similarity, round(c33 / len(b)::DOUBLE, 6) AS of_second FROM {_cells} WHERE len(a) = 3 AND len(b) = 3")
def lcs_types(spark, sf):
    """Common subsequences of the type and name (three words) of neighbouring parts: length, similarity, and as a part of the second one; the subsequence itself has that length."""
    w = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.split(F.concat_ws(" ", "p_type", "p_name"), " ").alias("a"))
    x = w.join(w.select((F.col("k") - 1).alias("k"), F.col("a").alias("b")), "k").where("size(a) = 3 AND size(b) = 3")
    a, b = F.col("a"), F.col("b")
    return x.select("k", F.size(sequences.common_units(a, b)).alias("lcs"), F.round(sequences.lcs_similarity(a, b), 6).alias("similarity"), F.round(sequences.reference_similarity(a, b), 6).alias("of_second"))


def segment_edges(spark, sf) -> DataFrame:
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    n = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name", "c_mktsegment").agg(F.count("*").alias("n"))
    return n.withColumn("sim", F.col("n") / F.max("n").over(Window.partitionBy("n_regionkey")))


SQL_SEGMENTS = """n AS (SELECT n_regionkey AS g, n_name AS l, c_mktsegment AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), s AS (SELECT g, l, r, n / max(n) OVER (PARTITION BY g)::DOUBLE AS sim FROM n),
rows AS (SELECT g, l, row_number() OVER (PARTITION BY g ORDER BY l) AS i FROM (SELECT DISTINCT g, l FROM s)), segs AS (SELECT DISTINCT g, r FROM s)"""


@query(f"""WITH RECURSIVE {SQL_SEGMENTS},
p AS (SELECT g, 0::BIGINT AS i, []::VARCHAR[] AS used, 0.0::DOUBLE AS total FROM (SELECT DISTINCT g FROM s)
UNION ALL SELECT p.g, p.i + 1, CASE WHEN s.r IS NULL THEN used ELSE list_append(used, s.r) END, total + coalesce(1 + s.sim, 0)
FROM p JOIN rows ON rows.g = p.g AND rows.i = p.i + 1 JOIN (SELECT g, r FROM segs UNION ALL SELECT DISTINCT g, NULL FROM segs) c ON c.g = p.g LEFT JOIN s ON s.g = p.g AND s.l = rows.l AND s.r = c.r
WHERE (c.r IS NULL OR s.r IS NOT NULL) AND (s.r IS NULL OR NOT list_contains(used, s.r)))
SELECT p.g AS n_regionkey, round(max(total), 6) AS total FROM p JOIN (SELECT g, max(i) AS i FROM rows GROUP BY g) e ON e.g = p.g AND e.i = p.i GROUP BY p.g""")
def assignment_total(spark, sf):
    """The sum of 1 + similarity of each region's best matching of nations and market segments."""
    best = assignment.assign(segment_edges(spark, sf), "n_regionkey", "n_name", "c_mktsegment")
    return best.groupBy("n_regionkey").agg(F.round(F.sum(1 + F.col("sim")), 6).alias("total"))


@query(r"""WITH l AS (SELECT item_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS line FROM (SELECT item_id, string_split(text, chr(10)) AS ls FROM benchmark)),
u AS (SELECT item_id, i, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') AS ws FROM l)
SELECT item_id::VARCHAR AS artifact, item_id || ':' || i AS cls, 0 AS method, 0 AS block, (generate_subscripts(ws, 1) - 1)::INT AS pos, unnest(ws) AS instr, '' AS refs, false AS has_inv, '' AS callee FROM u""")
def signature_instructions(spark, sf):
    """Stored records opened to instructions, with their references as text."""
    rows = signatures.units(text_records(table(spark, sf, "benchmark"), "item_id", "item_id"))
    return rows.select("artifact", "cls", "method", "block", "pos", "instr", F.array_join("ref_types", ",").alias("refs"), "has_inv", F.coalesce("ref_cls", F.lit("")).alias("callee"))


# Matched methods: the event logs of users 2n and 2n + 1; their class is the user modulo 7, a unit's reference a type by event, its callee the user who is as many events on.
SQL_LOGS = """e AS (SELECT user_id AS u, row_number() OVER w AS i, event_type AS t, CASE WHEN value < 20 THEN NULL WHEN value < 50 THEN 'X' || (event_id % 5) ELSE 'Y' END AS r, event_id % 3 AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT u, i, t || ' ' || lead(t, 1) OVER w || ' ' || lead(t, 2) OVER w AS h, [r, lead(r, 1) OVER w, lead(r, 2) OVER w] AS rs, [x, lead(x, 1) OVER w, lead(x, 2) OVER w] AS xs, lead(t, 2) OVER w AS last FROM e WINDOW w AS (PARTITION BY u ORDER BY i)),
k AS (SELECT u, h, min(rs) AS rs, min(xs) AS xs FROM (SELECT u, h, rs, xs FROM g WHERE last IS NOT NULL) GROUP BY u, h HAVING count(*) = 1),
z AS (SELECT u, count(*) AS w FROM e GROUP BY u), m AS (SELECT a.u AS l, b.u AS a, least(a.w, b.w) / greatest(a.w, b.w)::DOUBLE AS sim, a.w FROM z a JOIN z b ON a.u % 2 = 0 AND b.u = a.u + 1),
q AS (SELECT m.*, c.h, c.rs AS lr, d.rs AS ar, c.xs AS lx, d.xs AS ax FROM m JOIN k c ON c.u = m.l JOIN k d ON d.u = m.a AND d.h = c.h),
p AS (SELECT q.*, pos FROM q, (SELECT unnest([1, 2, 3]) AS pos) y)"""


def shared_log_units(spark, sf) -> DataFrame:
    """Units of 3-grams that stand once in each of two matched logs."""
    events = table(spark, sf, "events")
    ref = F.when(F.col("value") < 20, None).when(F.col("value") < 50, F.concat(F.lit("X"), (F.col("event_id") % 5).cast("string"))).otherwise("Y")
    unit = F.struct(F.col("event_type").alias("instr"), F.array(ref).alias("refs"), (F.col("event_id") % 3 < 2).alias("invokes"), (F.col("user_id") % 7).alias("ref_cls"), (F.col("event_id") % 3).alias("ref_idx"))
    grams = kgrams.ordered_kgrams(events.withColumn("unit", unit), "user_id", ["ts", "event_id"], "unit", 3)
    once = grams.groupBy("user_id", F.array_join("kgram.instr", " ").alias("h")).agg(F.count("*").alias("n"), F.first("kgram").alias("kgram")).where("n = 1")
    units = once.select("user_id", "h", F.posexplode("kgram").alias("pos", "unit"))
    sizes = events.groupBy("user_id").agg(F.count("*").alias("n"))
    l, a = sizes.select(F.col("user_id").alias("l"), F.col("n").alias("w")), sizes.select(F.col("user_id").alias("a"), F.col("n").alias("m"))  # noqa: E741
    pairs = l.where("l % 2 = 0").join(a, F.col("a") == F.col("l") + 1)
    pairs = pairs.select("l", "a", "w", (F.least("w", "m") / F.greatest("w", "m")).alias("sim"), F.lit(0.5).alias("class_sim"), F.lit("Y").alias("a_class"), (F.col("a") % 3 == 0).alias("constructor"))
    return votes.shared_kgrams(pairs, units.withColumnRenamed("user_id", "l"), units.withColumnRenamed("user_id", "a"))


@query(f"""WITH {SQL_LOGS}, v AS (SELECT lr[pos] AS k, ar[pos] AS v, w * sim * 0.5 AS score, w FROM p WHERE lr[pos] IS NOT NULL AND ar[pos] IS NOT NULL AND sim * 0.5 >= 0.3 AND NOT (a % 3 = 0 AND ar[pos] = 'Y'))
SELECT k, v, count(*) AS n, round(sum(score), 6) AS score, sum(w)::BIGINT AS weight FROM v GROUP BY k, v""")
def code_votes(spark, sf):
    cast = votes.code_votes(shared_log_units(spark, sf), least=0.3)
    return cast.groupBy("k", "v").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"), F.sum("weight").alias("weight"))


@query(f"""WITH {SQL_LOGS} SELECT (l % 7)::BIGINT AS cls, lx[pos]::BIGINT AS k, ax[pos]::BIGINT AS v, count(*) AS n, round(sum(w * sim * 0.5), 6) AS score FROM p WHERE lx[pos] < 2 AND ax[pos] < 2 AND a % 7 = (l + 1) % 7 AND l % 7 <> 6 GROUP BY ALL""")
def call_votes(spark, sf):
    matching = spark.range(6).select(F.col("id").alias("l_class"), (F.col("id") + 1).alias("a_class"))
    cast = votes.call_votes(shared_log_units(spark, sf), matching)
    return cast.groupBy("cls", "k", "v").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


SQL_ORDERS = """o AS (SELECT o_custkey AS c, o_orderkey AS k, o_totalprice AS w, o_orderpriority AS pr, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders),
m AS (SELECT a.c AS l, b.c AS a, CASE WHEN a.pr = b.pr THEN 1.0 ELSE 0.25 END::DOUBLE AS sim, a.w FROM o a JOIN o b ON a.c % 2 = 0 AND b.c = a.c + 1 AND b.i = a.i), z AS (SELECT c AS l, sum(w) AS weight FROM o GROUP BY c),
s AS (SELECT z.l, z.weight, coalesce(sum(m.sim * m.w) / any_value(z.weight), 0) AS sim FROM z LEFT JOIN m USING (l) WHERE z.l % 2 = 0 GROUP BY z.l, z.weight)"""


def matched_orders(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Orders of customers 2n and 2n + 1 matched by their rank, as methods of classes; and the classes' weights."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("w"), F.col("o_orderpriority").alias("p"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("i"))
    b = o.select((F.col("c") - 1).alias("l"), F.col("p").alias("q"), "i")
    pairs = o.where("c % 2 = 0").withColumnRenamed("c", "l").join(b, ["l", "i"]).select("l", "w", F.when(F.col("p") == F.col("q"), 1.0).otherwise(0.25).alias("sim"))
    return pairs, o.where("c % 2 = 0").groupBy(F.col("c").alias("l")).agg(F.sum("w").alias("weight"))


@query(f"WITH {SQL_ORDERS} SELECT l, round(CASE WHEN sim < 0.1 THEN 0 ELSE sim END, 6) AS sim FROM s")
def class_similarity(spark, sf):
    return votes.class_similarity(*matched_orders(spark, sf), ["l"]).withColumn("sim", F.round("sim", 6))


@query(f"""WITH {SQL_ORDERS}, g AS (SELECT l, weight, l % 10 AS lib, CASE WHEN sim < 0.1 THEN 0 ELSE sim END AS sim FROM s), y AS (SELECT lib, sum(weight) AS size, sum(CASE WHEN sim > 0 THEN weight END) AS w, sum(CASE WHEN sim > 0 THEN weight * sim END) AS t FROM g GROUP BY lib)
SELECT lib, round(t / w, 6) AS match, round(w / size, 6) AS cover, coalesce((t / w) * (w / size) >= greatest(0.1, 0.7 - 0.15 * log10(greatest(1, size / 1000))), false) AS found FROM y""")
def match_and_cover(spark, sf):
    """Ten libraries of customers: what their matched classes cover, and whether that is enough."""
    pairs, weights = matched_orders(spark, sf)
    sims = votes.class_similarity(pairs, weights, ["l"]).join(weights, "l").select((F.col("l") % 10).alias("lib"), "sim", F.col("weight").alias("w"))
    totals = sims.groupBy("lib").agg(F.sum("w").alias("size"))
    found = votes.match_and_cover(sims.where("sim > 0"), totals, ["lib"], selection.detection_threshold(F.col("size") / 1000))
    return found.withColumns({c: F.round(c, 6) for c in ("match", "cover")})


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, (c_acctbal + 1000) / 11000 AS sim, c_custkey % 50 AS w FROM customer)
SELECT k.n_name AS k, v.n_name AS v, count(*) AS n, round(sum(w * sim), 6) AS score, sum(w)::BIGINT AS weight FROM c a JOIN (SELECT c_custkey - 1 AS k, c_nationkey AS n FROM customer) b USING (k) JOIN nation k ON k.n_nationkey = a.n JOIN nation v ON v.n_nationkey = b.n WHERE k.n_regionkey > 0 AND v.n_regionkey < 4 AND sim >= 0.2 AND w * sim > 0 GROUP BY ALL""")
def superclass_votes(spark, sf):
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    of = lambda name, c: nation.select(F.col("n_nationkey").alias(f"{name}_n"), F.when(c, F.col("n_name")).alias(f"{name}_super"))
    a = customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("l_n"), ((F.col("c_acctbal") + 1000) / 11000).alias("sim"), (F.col("c_custkey") % 50).alias("w"))
    b = customer.select((F.col("c_custkey") - 1).alias("k"), F.col("c_nationkey").alias("a_n"))
    pairs = a.join(b, "k").join(of("l", F.col("n_regionkey") > 0), "l_n").join(of("a", F.col("n_regionkey") < 4), "a_n")
    return votes.superclass_votes(pairs, least=0.2).groupBy("k", "v").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"), F.sum("weight").alias("weight"))


@query(f"WITH {SQL_SHARES}, kept AS (SELECT * FROM o WHERE depth = 0 OR own <> 0 OR children <> 1), up AS (SELECT a.prefix, count(*) AS depth FROM kept a JOIN kept b ON a.prefix <> b.prefix AND (b.prefix = '' OR starts_with(a.prefix, b.prefix || '.')) GROUP BY a.prefix) SELECT kept.prefix, repeat('  ', coalesce(up.depth, 0)::INT) || CASE WHEN kept.prefix = '' THEN '<default package>' ELSE kept.prefix END || printf(' %.5f%%', own * 100 / total::DOUBLE) || CASE WHEN children > 0 THEN printf(' (%.5f%%)', weight * 100 / total::DOUBLE) ELSE '' END AS line FROM kept LEFT JOIN up USING (prefix)")
def pkg_report_collapsed(spark, sf):
    return rollup.rendered(rollup.own_share(tree(spark, sf)), collapse=True)


@query("WITH r AS (SELECT (o_orderkey % 9)::INT AS round, count(*) AS n, count(*) FILTER (o_totalprice > 1000) AS k FROM orders GROUP BY 1) SELECT round, (sum(n) OVER w)::BIGINT AS scanned, (sum(k) OVER w)::BIGINT AS accepted FROM r WINDOW w AS (ORDER BY round)")
def progress_counts(spark, sf):
    return selection.progress(table(spark, sf, "orders").select((F.col("o_orderkey") % 9).cast("int").alias("round"), (F.col("o_totalprice") > 1000).alias("accepted")))


@query("SELECT p_partkey, p_name FROM part WHERE NOT regexp_full_match(p_name, '(small|red) .*|.*bolt')")
def excluded_names(spark, sf):
    return archives.excluded(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "(small|red) .*|.*bolt")


@query(f"""WITH {SQL_ITEM_GRAMS}, {SQL_HASHES.replace("FROM documents", "FROM (SELECT item_id AS doc_id, text, item_id::VARCHAR AS source, '' AS lang FROM benchmark)")}, b5 AS (SELECT source::BIGINT AS item_id, unnest({list(sketches.PRIMES)}) AS prime, h FROM h5)
SELECT item_id, prime::INT AS prime, count(DISTINCT h % prime) AS bits_set FROM b5 GROUP BY item_id, prime""")
def class_bit_sets(spark, sf):
    """The five sketches of each item, by the number of their bits."""
    items = table(spark, sf, "benchmark").select("item_id", "text")
    parts = [sketches.text_bits(items, "text", K, p).groupBy("item_id").agg(F.count("*").alias("bits_set")).select("item_id", F.lit(p).alias("prime"), "bits_set") for p in sketches.PRIMES]
    return reduce(DataFrame.unionByName, parts)


@query("""WITH r AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 1000 / 1000.0::DOUBLE AS match, o_orderkey % 10 / 10.0::DOUBLE AS cover, o_orderstatus = 'F' AS ok FROM orders)
SELECT k, 'c' || c || ': o' || k || printf(' match %.5f%%, coverage %.5f%%', match * 100, cover * 100) || CASE WHEN ok THEN '' ELSE ' (alternative)' END AS line FROM r""")
def detection_report(spark, sf):
    rows = table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("app"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("library"), (F.col("o_orderkey") % 1000 / 1000).alias("match"), (F.col("o_orderkey") % 10 / 10).alias("cover"), (F.col("o_orderstatus") == "F").alias("accepted"), F.lit(1).alias("round"))
    return results.report(rows).select(F.regexp_extract("line", ": o([0-9]+) ", 1).cast("long").alias("k"), "line")


# ---------------------------------------------------------------- no SQL counterpart


@query()
def lcs_length(spark, sf):
    """Longest common subsequences of the whole event logs of neighbouring users."""
    logs = table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"))
    seqs = logs.select("user_id", F.col("s.event_type").alias("s"))
    pairs = seqs.join(seqs.select((F.col("user_id") - 1).alias("user_id"), F.col("s").alias("t")), "user_id")
    return pairs.select("user_id", sequences.lcs_length(F.col("s"), F.col("t")).alias("lcs"), F.round(sequences.lcs_similarity(F.col("s"), F.col("t")), 6).alias("similarity"))


@query()
def class_candidates_whole(spark, sf):
    """class_candidates between all documents of different sources, those without a source included: no source is singled out."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", F.size(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("methods"), "n_chars")
    texts = table(spark, sf, "documents").select("doc_id", "source", "lang", "text", "n_chars")
    if numbered(texts):
        lines = F.size(F.filter(F.split("text", "\n"), lambda x: x != ""))
        known = texts.where("doc_id IS NOT NULL AND n_chars > 0").where(lines > 0)
        return text_pairs.candidates(known, "doc_id", "text", K, "source", "lang", lines).select("l", "a", F.round("score", 6).alias("score"))
    grams = document_grams(spark, sf, hashed=True).select("doc_id", "h")
    side = lambda p: docs.select(F.col("doc_id").alias(p), F.col("lang").alias(f"{p}_super"), F.col("methods").alias(f"{p}_methods"), F.col("n_chars").alias(f"{p}_weight"))
    sets = similarity.candidates(side("l"), side("a"), grams.withColumnRenamed("doc_id", "l"), grams.withColumnRenamed("doc_id", "a"))
    of = lambda p: docs.select(F.col("doc_id").alias(p), F.col("source").alias(f"{p}_source"))
    apart = sets.join(of("l"), "l").join(of("a"), "a").where(~F.col("l_source").eqNullSafe(F.col("a_source")))
    return apart.select("l", "a", F.round("score", 6).alias("score"))


@query()
def assignment_max_weight(spark, sf):
    """Nations to market segments within each region, by their customers' part of the segment."""
    return assignment.assign(segment_edges(spark, sf), "n_regionkey", "n_name", "c_mktsegment").withColumn("sim", F.round("sim", 6))


def text_records(docs: DataFrame, artifact: str, cls: str) -> DataFrame:
    """Text as class records: a line is a class with one method of one block, a word a unit."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for a, c, text in zip(pdf["artifact"], pdf["cls"], pdf["text"], strict=True):
                for i, line in enumerate(text.split("\n")):
                    if line.split():
                        method = {"name": "line", "idx": 0, "blocks": [[signatures.unit(w) for w in line.split()]], "blockSuccs": {}}
                        rows.append((str(a), f"{c}:{i}", json.dumps({"name": f"{c}:{i}", "methods": [method], "interfaces": []})))
            yield pd.DataFrame(rows, columns=["artifact", "cls", "record"])

    return docs.select(F.col(artifact).alias("artifact"), F.col(cls).alias("cls"), "text").where("text IS NOT NULL").mapInPandas(run, "artifact string, cls string, record string")


@query()
def detect_library(spark, sf):
    """Benchmark items found in the document sources."""
    library = text_records(table(spark, sf, "benchmark"), "item_id", "item_id")
    lines = table(spark, sf, "documents").select("source", "doc_id", "text")
    named = lines.select(F.col("source").alias("artifact"), F.col("doc_id").alias("cls"), "text")
    return detection.detect(library, text_records(lines, "source", "doc_id"), keep=materialise, lines=named).select("app", "library", F.round("match", 6).alias("match"), F.round("cover", 6).alias("cover"), "accepted", "round")


@query()
def signature_units(spark, sf):
    """Stored records opened to instructions."""
    return signatures.units(text_records(table(spark, sf, "benchmark"), "item_id", "item_id"))
