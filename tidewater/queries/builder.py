"""Queries through the builder, each with SQL that says the same."""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidewater.functions import aggregates as A
from tidewater.operators import traverse, windows
from tidewater.operators.enrich import non_shared_service, shared_service
from tidewater.operators.joins import join_map_entries, on_keys
from tidewater.plans.stage import Pipeline, Stage
from tidewater.sources import sources

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
HOUR = 3_600_000


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        own = name or fn.__name__
        QUERIES[own] = lambda spark, sf_dir: fn(lambda t: Pipeline(spark).read_from(sources.parquet(f"{sf_dir}/{t}.parquet"))).df
        if sql:
            ORACLES[own] = sql
        return fn

    return add


def money(c: str):
    return F.round(F.col(c), 2)


# -- aggregation


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY ALL""")
def keyed_aggregate(t):
    got = t("lineitem").grouping_key("l_returnflag", "l_linestatus").aggregate(
        sum_qty=A.summing_double("l_quantity"), revenue=A.summing_double("l_extendedprice * (1 - l_discount)"), avg_disc=A.averaging_double("l_discount"), n=A.counting()
    )
    return got.map("l_returnflag", "l_linestatus", sum_qty=money("sum_qty"), revenue=money("revenue"), avg_disc=F.round("avg_disc", 6), n="n")


@query("SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS lines, round(sum(l_extendedprice), 1) AS total FROM lineitem")
def global_aggregate(t):
    return t("lineitem").aggregate(n=A.counting(), lines=A.summing_long("l_linenumber"), total=A.summing_double("l_extendedprice")).map("n", "lines", total=F.round("total", 1))


@query("SELECT 0::BIGINT AS n, 0::BIGINT AS s, 0.0::DOUBLE AS d, 'NaN'::DOUBLE AS a, 'NaN'::DOUBLE AS trend")
def empty_aggregate(t):
    """No rows: counts and sums 0, averages and trends NaN."""
    none = t("lineitem").filter("l_quantity < 0")
    return none.aggregate(n=A.counting(), s=A.summing_long("l_linenumber"), d=A.summing_double("l_tax"), a=A.averaging_long("l_linenumber"), trend=A.linear_trend("l_linenumber", "l_orderkey"))


@query("SELECT 1 AS item WHERE false")
def empty_max_by(t):
    """No rows, and a result that needs one: no row."""
    return t("lineitem").filter("l_quantity < 0").aggregate(item=A.max_by("l_linenumber", "l_quantity"))


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS dearest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest FROM orders GROUP BY o_custkey""")
def max_by_min_by(t):
    return t("orders").grouping_key("o_custkey").aggregate(dearest=A.max_by("o_orderkey", "o_totalprice", "o_orderkey"), cheapest=A.min_by("o_orderkey", "o_totalprice", "o_orderkey"))


@query("""SELECT o_orderpriority, array_to_string(list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey DESC)[1:5], ',') AS top,
array_to_string(list(o_orderkey ORDER BY o_totalprice, o_orderkey)[1:5], ',') AS bottom FROM orders GROUP BY o_orderpriority""")
def top_n_bottom_n(t):
    got = t("orders").grouping_key("o_orderpriority").aggregate(top=A.top_n(5, "o_orderkey", "o_totalprice", "o_orderkey"), bottom=A.bottom_n(5, "o_orderkey", "o_totalprice", "o_orderkey"))
    return got.map("o_orderpriority", top=F.array_join("top", ","), bottom=F.array_join("bottom", ","))


@query("SELECT o_orderpriority, round(coalesce(regr_slope(o_totalprice, epoch_ms(o_orderdate) / 86400000.0), 'NaN'), 4) AS slope FROM orders GROUP BY o_orderpriority")
def linear_trend(t):
    got = t("orders").grouping_key("o_orderpriority").aggregate(slope=A.linear_trend("unix_millis(CAST(o_orderdate AS TIMESTAMP)) / 86400000.0", "o_totalprice"))
    return got.map("o_orderpriority", slope=F.round("slope", 4))


@query("SELECT n_regionkey, '[' || string_agg(n_name, '; ' ORDER BY n_name) || ']' AS names FROM nation GROUP BY n_regionkey")
def concatenating(t):
    return t("nation").grouping_key("n_regionkey").aggregate(names=A.concatenating("n_name", "; ", "[", "]", order="n_name"))


@query("""SELECT c_mktsegment, array_to_string(list_sort(list(c_nationkey)), ',') AS every, array_to_string(list_sort(list(DISTINCT c_nationkey)), ',') AS once FROM customer GROUP BY c_mktsegment""")
def to_list_to_set(t):
    got = t("customer").grouping_key("c_mktsegment").aggregate(every=A.to_list("c_nationkey"), once=A.to_set("c_nationkey"))
    return got.map("c_mktsegment", every=F.array_join(F.sort_array("every"), ","), once=F.array_join(F.sort_array("once"), ","))


@query("SELECT n_regionkey, string_agg(n_nationkey || '=' || n_name, ',' ORDER BY n_nationkey) AS m FROM nation GROUP BY n_regionkey")
def to_map(t):
    got = t("nation").grouping_key("n_regionkey").aggregate(m=A.to_map("n_nationkey", "n_name"))
    return got.map("n_regionkey", m=F.array_join(F.transform(F.sort_array(F.map_entries("m")), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ","))


@query("""SELECT l_returnflag, string_agg(l_linenumber || '=' || n, ',' ORDER BY l_linenumber) AS m FROM
(SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_returnflag""")
def grouping_by(t):
    got = t("lineitem").grouping_key("l_returnflag").aggregate(m=A.grouping_by("l_linenumber", A.counting()))
    return got.map("l_returnflag", m=F.array_join(F.transform(F.sort_array(F.map_entries("m")), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ","))


@query("""SELECT o_orderstatus, string_agg(o_orderpriority || '=' || p, ',' ORDER BY o_orderpriority) AS m FROM
(SELECT o_orderstatus, o_orderpriority, max(o_orderkey) AS p FROM orders GROUP BY ALL) GROUP BY o_orderstatus""")
def to_map_merging(t):
    got = t("orders").grouping_key("o_orderstatus").aggregate(m=A.to_map("o_orderpriority", "o_orderkey", lambda v: A.max_by(v, v)))
    return got.map("o_orderstatus", m=F.array_join(F.transform(F.sort_array(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query("""SELECT l_shipdate::DATE AS day, count(*) FILTER (l_quantity > 25) AS big, count(CASE WHEN l_discount > 0.05 THEN l_tax END) AS taxed FROM lineitem GROUP BY 1""")
def filtering_mapping(t):
    got = t("lineitem").grouping_key(day="CAST(l_shipdate AS DATE)").aggregate(
        big=A.filtering("l_quantity > 25", A.counting()), taxed=A.mapping(lambda x: F.when(F.col("l_discount") > 0.05, x), lambda _: A.counting(), "l_tax")
    )
    return got


@query("""SELECT d.lang, count(*) AS words, max(length(w)) AS longest FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents) d GROUP BY d.lang""")
def flat_mapping(t):
    op = A.flat_mapping("split(text, ' ')", lambda w: A.counting(), "w")
    longest = A.flat_mapping("split(text, ' ')", lambda w: A.max_by(F.length(w), F.length(w)), "w")
    return t("documents").grouping_key("lang").aggregate(words=op, longest=longest)


@query("""SELECT n_regionkey, count(i) AS items, count(*) FILTER (g) AS nations FROM (SELECT n_regionkey, unnest(CASE WHEN n_regionkey = 1 OR n_nationkey % 2 = 0 THEN [NULL] ELSE [1, 2] END) AS i,
generate_subscripts(CASE WHEN n_regionkey = 1 OR n_nationkey % 2 = 0 THEN [NULL] ELSE [1, 2] END, 1) = 1 AS g FROM nation) GROUP BY n_regionkey""")
def flat_mapping_empty(t):
    """A group whose arrays are all empty stays, with the operations beside it."""
    odd = F.expr("CASE WHEN n_regionkey = 1 OR n_nationkey % 2 = 0 THEN array() ELSE array(1, 2) END")
    return t("nation").grouping_key("n_regionkey").aggregate(items=A.flat_mapping(odd, lambda i: A.counting(), "i"), nations=A.counting())


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderstatus, -o_orderkey)) AS item FROM orders GROUP BY o_custkey")
def max_by_status(t):
    """Equal keys, of which the first by number counts."""
    return t("orders").grouping_key("o_custkey").aggregate(item=A.max_by("o_orderkey", "o_orderstatus", "o_orderkey"))


@query("SELECT c_mktsegment, arg_min(c_custkey, c_name) AS item FROM customer GROUP BY c_mktsegment")
def max_by_text_ties(t):
    """All keys are equal: the first by text counts."""
    return t("customer").grouping_key("c_mktsegment").aggregate(item=A.max_by("c_custkey", F.lit(1), "c_name"))


@query("SELECT n_nationkey, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, sum(s_suppkey)::BIGINT s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey WHERE c IS NOT NULL OR s IS NOT NULL")
def co_aggregate_operation(t):
    """Two operations put together as one that takes both inputs."""
    op = A.aggregate_operation2(A.counting(), A.summing_long("s_suppkey"))
    got = t("customer").grouping_key(n_nationkey="c_nationkey").co_aggregate(op, t("supplier").grouping_key("s_nationkey"))
    return got.map("n_nationkey", customers="result.f0", suppliers="result.f1")


@query("SELECT p_brand, sum(p_size)::BIGINT AS total, max(p_size)::BIGINT AS most FROM part GROUP BY p_brand")
def reducing(t):
    return t("part").grouping_key("p_brand").aggregate(
        total=A.reducing(F.lit(0).cast("long"), F.col("p_size").cast("long"), lambda a, x: a + x), most=A.reducing(F.lit(0).cast("long"), F.col("p_size").cast("long"), lambda a, x: F.greatest(a, x))
    )


@query("SELECT n_regionkey, array_to_string(list(n_nationkey ORDER BY n_nationkey DESC), ',') AS sorted FROM nation GROUP BY n_regionkey")
def sorting(t):
    return t("nation").grouping_key("n_regionkey").aggregate(s=A.sorting("n_nationkey", True)).map("n_regionkey", sorted=F.array_join("s", ","))


@query("SELECT r_regionkey, true AS found FROM region")
def pick_any(t):
    got = t("nation").grouping_key(r_regionkey="n_regionkey").aggregate(any=A.pick_any(["n_name", "n_regionkey"]))
    return got.map("r_regionkey", found=F.col("any.n_regionkey") == F.col("r_regionkey"))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_mktsegment")
def all_of(t):
    got = t("customer").grouping_key("c_mktsegment").aggregate(A.all_of(n=A.counting(), total=A.summing_double("c_acctbal"), mean=A.averaging_double("c_acctbal")))
    return got.map("c_mktsegment", n="result.n", total=F.round("result.total", 2), mean=F.round("result.mean", 4))


@query("SELECT p_brand, round(sqrt(var_pop(p_retailprice)), 4) AS spread FROM part GROUP BY p_brand")
def custom_aggregate(t):
    """A Python accumulator with combine: pre-aggregated in each task."""
    op = (
        A.with_create(lambda: [0, 0.0, 0.0])
        .and_accumulate(lambda a, r: [a[0] + 1, a[1] + r["p_retailprice"], a[2] + r["p_retailprice"] ** 2])
        .and_combine(lambda a, b: [x + y for x, y in zip(a, b, strict=True)])
        .and_export_finish(lambda a: max(0.0, a[2] / a[0] - (a[1] / a[0]) ** 2) ** 0.5, "double")
    )
    return Stage(t("part").df.select("p_brand", "p_retailprice")).grouping_key("p_brand").aggregate(spread=op).map("p_brand", spread=F.round("spread", 4))


@query("SELECT n_nationkey, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey WHERE c IS NOT NULL OR s IS NOT NULL")
def co_aggregate2(t):
    got = t("customer").grouping_key(n_nationkey="c_nationkey").aggregate2(A.counting(), t("supplier").grouping_key("s_nationkey"), A.counting())
    return got.map("n_nationkey", customers="f0", suppliers="f1")


@query("""WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 48 GROUP BY 1), b AS (SELECT p_partkey AS k, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1),
c AS (SELECT l_partkey AS k, sum(l_linenumber)::BIGINT AS n FROM lineitem WHERE l_quantity < 2 GROUP BY 1)
SELECT coalesce(a.k, b.k, c.k) AS partkey, coalesce(a.n, 0) AS big, coalesce(b.n, 0) AS sized, coalesce(c.n, 0) AS small FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON coalesce(a.k, b.k) = c.k""")
def co_aggregate3(t):
    big = t("lineitem").filter("l_quantity > 48").grouping_key(partkey="l_partkey")
    sized = t("part").filter("p_size > 25").grouping_key("p_partkey")
    small = t("lineitem").filter("l_quantity < 2").grouping_key("l_partkey")
    return big.aggregate3(A.counting(), sized, A.counting(), small, A.summing_long("l_linenumber")).map("partkey", big="f0", sized="f1", small="f2")


@query("SELECT (SELECT count(*) FROM customer) AS customers, (SELECT round(sum(s_acctbal), 2) FROM supplier) AS balance")
def co_aggregate_builder(t):
    builder = t("customer").aggregate_builder(A.counting())
    builder.add("balance", t("supplier"), A.summing_double("s_acctbal"))
    return builder.build().map(customers="f0", balance=F.round("balance", 2))


@query("SELECT n_nationkey, round(coalesce(c, 0) - coalesce(s, 0), 2) AS balance FROM nation LEFT JOIN (SELECT c_nationkey, sum(c_acctbal) c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, sum(s_acctbal) s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey WHERE c IS NOT NULL OR s IS NOT NULL")
def co_group_custom(t):
    """One accumulator fed by two inputs."""
    op = (
        A.with_create(lambda: 0.0)
        .and_accumulate(lambda a, r: a + r["c_acctbal"])
        .and_accumulate(lambda a, r: a - r["s_acctbal"])
        .and_combine(lambda a, b: a + b)
        .and_export_finish(lambda a: a, "double")
    )
    one, two = t("customer").map("c_nationkey", "c_acctbal"), t("supplier").map("s_nationkey", "s_acctbal")
    got = one.grouping_key(n_nationkey="c_nationkey").co_aggregate(op, two.grouping_key("s_nationkey"))
    return got.map("n_nationkey", balance=F.round("result", 2))


# -- rows, sets, order


@query("SELECT o_orderkey, round(o_totalprice * 2, 2) AS double_price FROM orders WHERE o_orderstatus = 'F'")
def map_filter(t):
    return t("orders").filter("o_orderstatus = 'F'").map("o_orderkey", double_price=F.round(F.col("o_totalprice") * 2, 2))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def map_null_drops(t):
    return t("orders").map(o_orderkey=F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey")))


@query("SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[^a-zA-Z]+')) AS w FROM documents) WHERE w <> '' GROUP BY 1")
def word_count(t):
    words = t("documents").flat_map("split(text, '[^a-zA-Z]+')", "w").filter("w <> ''")
    return words.grouping_key(word="lower(w)").aggregate(n=A.counting())


@query("SELECT p_partkey, array_to_string(list_filter(range(1, p_size + 1), lambda x: x < 4), ',') AS head FROM part")
def traverser(t):
    items = traverse.take_while(F.sequence(F.lit(1), F.col("p_size")), lambda x: x < 4)
    return t("part").map("p_partkey", head=F.array_join(items, ","))


@query("""SELECT p_partkey, array_to_string(list_filter(range(1, p_size + 1), lambda x: x >= 4), ',') AS rest, array_to_string(list_concat([0], list_transform(list_filter(range(1, p_size + 1), lambda x: x % 2 = 0), lambda x: x * 10), [-1]), ',') AS tens,
array_to_string(flatten(list_transform(range(1, p_size + 1), lambda x: [x, -x])), ',') AS pairs FROM part""")
def traverser_combinators(t):
    items = F.sequence(F.lit(1), F.col("p_size"))
    rest = traverse.drop_while(items, lambda x: x < 4)
    even = traverse.map_items(traverse.filter_items(items, lambda x: x % 2 == 0), lambda x: x * 10)
    tens = traverse.append(traverse.prepend(even, F.lit(0)), F.lit(-1))
    pairs = traverse.flat_map_items(items, lambda x: F.array(x, -x))
    return t("part").map("p_partkey", rest=F.array_join(rest, ","), tens=F.array_join(tens, ","), pairs=F.array_join(pairs, ","))


@query("SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def merge(t):
    return t("customer").map(nation="c_nationkey").merge(t("supplier").map(nation="s_nationkey"))


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct(t):
    return t("customer").map("c_mktsegment", "c_nationkey").distinct()


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey")
def keyed_distinct(t):
    return t("orders").grouping_key("o_custkey").distinct("o_orderdate", "o_orderkey").map("o_custkey", first_order="o_orderkey")


@query("SELECT n_name FROM nation ORDER BY n_name")
def sort(t):
    return t("nation").map("n_name").sort("n_name")


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS so_far, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events")
def rolling_aggregate(t):
    got = t("events").grouping_key("user_id").rolling_aggregate("ts", "event_id", so_far=A.summing_double("value"), n=A.counting())
    return got.map("user_id", "event_id", so_far=F.round("so_far", 2), n="n")


@query("""WITH w AS (SELECT doc_id, lower(w) AS word, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^a-zA-Z]+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL)
SELECT doc_id, word, round(tf * (ln((SELECT count(*) FROM documents)) - ln(count(*) OVER (PARTITION BY word))), 6) AS score FROM w""")
def tf_idf(t):
    """Counts by document and word, joined with the number of documents of each word."""
    docs = t("documents")
    total = docs.aggregate(n=A.counting())
    counted = docs.filter("text IS NOT NULL").map("doc_id", text="text").rebalance("doc_id").custom_transform(_count_words)
    # words are dealt out once, by word: counting and joining both keep to that
    tf = counted.flat_map("words", "w", "doc_id").map("doc_id", word="w.word", tf="w.tf").rebalance("word")
    # the count looks at all columns, so that both branches ask for the same ones and share the shuffle
    df = tf.grouping_key("word").aggregate(df=A.filtering("tf > 0 OR doc_id IS NULL", A.counting()))
    idf = Stage(df.df.crossJoin(F.broadcast(total.df))).map("word", idf=F.log("n") - F.log("df"))  # one row
    # of the two sides only this one is held, a row for each word of a partition; no word is null
    return Stage(tf.df.join(idf.df.hint("shuffle_hash"), "word")).map("doc_id", "word", score=F.round(F.col("tf") * F.col("idf"), 6))


def _count_words(docs: DataFrame) -> DataFrame:
    """doc_id and its words with their counts, a row for each document (several rows of one doc_id are one document): what is held
    is one document's words, not those of all documents of a task."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = docs.select("doc_id").schema
    letters = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))
    most = 1 << 17

    def run(batches):
        made, held, now, counts = [], 0, None, Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if doc != now and counts:
                    made.append((now, counts))
                    held += len(counts)
                    counts = Counter()
                    if held > most:
                        yield packed(made)
                        made, held = [], 0
                now = doc
                counts.update(text.translate(letters).split())
        if counts:
            made.append((now, counts))
        if made:
            yield packed(made)

    def packed(made):
        words = pa.array([w for _, c in made for w in c], pa.binary()).cast(pa.string())
        times = pa.array([n for _, c in made for n in c.values()], pa.int64())
        ends = pa.array([0, *accumulate(len(c) for _, c in made)], pa.int32())
        pairs = pa.StructArray.from_arrays([words, times], ["word", "tf"])
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in made], arrow), pa.ListArray.from_arrays(ends, pairs)], ["doc_id", "words"])

    arrow = to_arrow_schema(ids).field(0).type
    return docs.sortWithinPartitions("doc_id").mapInArrow(run, f"doc_id {kind}, words array<struct<word: string, tf: bigint>>")


# -- joins and services


@query("SELECT o_orderkey, c_name AS customer FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def hash_join(t):
    rich = t("customer").filter("c_acctbal > 0")
    return t("orders").hash_join(rich, on_keys("o_custkey", "c_custkey").projecting("c_name")).map("o_orderkey", customer="right.c_name")


@query("SELECT o_orderkey, c_name AS customer FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def inner_hash_join(t):
    rich = t("customer").filter("c_acctbal > 0")
    return t("orders").inner_hash_join(rich, on_keys("o_custkey", "c_custkey").projecting("c_name")).map("o_orderkey", customer="right.c_name")


@query("SELECT s_suppkey, n_name AS nation, p_name AS part FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN part ON s_suppkey = p_size")
def hash_join2(t):
    got = t("supplier").hash_join2(t("nation"), on_keys("s_nationkey", "n_nationkey"), t("part"), on_keys("s_suppkey", "p_size"))
    return got.map("s_suppkey", nation="right1.n_name", part="right2.p_name")


@query("SELECT s_suppkey, n_name AS nation, p_name AS part FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN part ON s_suppkey = p_size")
def inner_hash_join2(t):
    got = t("supplier").inner_hash_join2(t("nation"), on_keys("s_nationkey", "n_nationkey"), t("part"), on_keys("s_suppkey", "p_size"))
    return got.map("s_suppkey", nation="right1.n_name", part="right2.p_name")


@query("""SELECT l_orderkey, l_linenumber, c_name AS customer, n_name AS nation, p_brand AS brand FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON l_partkey = p_partkey AND p_size > 20""")
def hash_join_builder(t):
    got = (
        t("lineitem").hash_join_builder()
        .add_inner("o", t("orders"), on_keys("l_orderkey", "o_orderkey").projecting("o_custkey"))
        .add_inner("c", t("customer"), on_keys("o.o_custkey", "c_custkey").projecting("c_name", "c_nationkey"))
        .add_inner("n", t("nation"), on_keys("c.c_nationkey", "n_nationkey").projecting("n_name"))
        .add("p", t("part").filter("p_size > 20"), on_keys("l_partkey", "p_partkey").projecting("p_brand"))
        .build()
    )
    return got.map("l_orderkey", "l_linenumber", customer="c.c_name", nation="n.n_name", brand="p.p_brand")


@query("SELECT a.n AS left_key, b.n AS right_key FROM (SELECT nullif(n_regionkey, 0) AS k, n_nationkey AS n FROM nation) a LEFT JOIN (SELECT nullif(n_regionkey, 0) AS k, n_nationkey AS n FROM nation) b ON a.k IS NOT DISTINCT FROM b.k")
def hash_join_null_keys(t):
    """Null keys match each other."""
    side = t("nation").map(k="nullif(n_regionkey, 0)", n="n_nationkey")
    return side.hash_join(side, on_keys("k", "k").projecting("n")).map(left_key="n", right_key="right.n")


@query("SELECT s_suppkey, n_name AS value FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey > 1")
def join_entries(t):
    table = t("nation").filter("n_regionkey > 1").map(key="n_nationkey", value="n_name")
    return t("supplier").hash_join(table, join_map_entries("s_nationkey")).map("s_suppkey", value="right.value")


@query("SELECT c_custkey, n_name AS value FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def map_using_map(t):
    table = t("nation").filter("n_regionkey < 3")
    return t("customer").map_using_map(table, "c_nationkey", table_key="n_nationkey", value="n_name").map("c_custkey", "value")


@query("SELECT r_regionkey, 'region ' || r_name AS label FROM region WHERE r_regionkey <> 2")
def map_using_service(t):
    service = shared_service("labels", lambda _: {"prefix": "region "})
    got = t("region").map_using_service(service, lambda s, r: {"r_regionkey": r["r_regionkey"], "label": s["prefix"] + r["r_name"]}, "r_regionkey int, label string")
    return got.filter_using_service(non_shared_service(lambda _: {2}), lambda s, r: r["r_regionkey"] not in s)


@query("SELECT n_nationkey, n_regionkey % 3 AS third FROM nation WHERE n_regionkey <> 4")
def map_using_service_keyed(t):
    """Rows of a key meet one service."""
    service = non_shared_service(lambda _: {"by": 3})
    got = t("nation").grouping_key("n_regionkey").map_using_service(service, lambda s, r: {"n_nationkey": r["n_nationkey"], "n_regionkey": r["n_regionkey"], "third": r["n_regionkey"] % s["by"]}, "n_nationkey int, n_regionkey int, third int")
    return got.grouping_key("n_regionkey").filter_using_service(non_shared_service(lambda _: 4), lambda s, r: r["n_regionkey"] != s).map("n_nationkey", "third")


@query("SELECT n_nationkey, n_regionkey AS key, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def map_using_map_keyed(t):
    got = t("nation").grouping_key("n_regionkey").map_using_map(t("region"), "region", table_key="r_regionkey", value="r_name")
    return got.map("n_nationkey", "region", key="n_regionkey")


@query("SELECT n_nationkey, length(n_name)::BIGINT AS n FROM nation")
def map_using_service_async(t):
    service = non_shared_service(lambda _: len)
    return t("nation").map_using_service_async(service, lambda s, r: {"n_nationkey": r["n_nationkey"], "n": s(r["n_name"])}, "n_nationkey int, n long", max_concurrent=4, preserve_order=False)


@query("SELECT n_nationkey, upper(n_name) AS name FROM nation")
def map_using_service_batched(t):
    service = non_shared_service(lambda _: str.upper)
    return t("nation").map_using_service_batched(service, lambda s, rows: [{"n_nationkey": r["n_nationkey"], "name": s(r["n_name"])} for r in rows], "n_nationkey int, name string", max_batch=7)


@query("SELECT n_nationkey, unnest(string_split(n_name, 'A')) AS part FROM nation")
def flat_map_using_service(t):
    service = non_shared_service(lambda _: "A")
    return t("nation").flat_map_using_service(service, lambda s, r: [{"n_nationkey": r["n_nationkey"], "part": p} for p in r["n_name"].split(s)], "n_nationkey int, part string")


@query("SELECT n_nationkey, reverse(n_name) AS result FROM nation")
def map_using_python(t):
    return t("nation").map_using_python("n_name", lambda names: [n[::-1] for n in names]).map("n_nationkey", "result")


# -- windows


def _events(t):
    return t("events").add_timestamps("ts")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_window(t):
    got = _events(t).grouping_key("event_type").window(windows.tumbling(24 * HOUR)).aggregate(n=A.counting(), total=A.summing_double("value"))
    return got.map("window_start", "window_end", "event_type", n="n", total=F.round("total", 2))


_SLIDES = "SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 2 HOUR]) AS window_start FROM events"


@query(f"SELECT window_start, window_start + INTERVAL 3 HOUR AS window_end, event_type, count(*) AS n FROM ({_SLIDES}) GROUP BY ALL")
def sliding_window(t):
    got = _events(t).grouping_key("event_type").window(windows.sliding(3 * HOUR, HOUR)).aggregate(n=A.counting())
    return got.map("window_start", "window_end", "event_type", "n")


_SESSIONS = """SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n, round(sum(value), 2) AS total, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM
(SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s"""


@query(_SESSIONS)
def session_window(t):
    """Gaps of exactly the timeout end a session."""
    got = _events(t).grouping_key("user_id").window(windows.session(HOUR)).aggregate(n=A.counting(), total=A.summing_double("value"), kinds=A.to_set("event_type"))
    return got.map("user_id", "window_start", "window_end", n="n", total=F.round("total", 2), kinds=F.array_join(F.sort_array("kinds"), ","))


@query("""SELECT time_bucket(INTERVAL 1 DAY, w) AS window_start, time_bucket(INTERVAL 1 DAY, w) + INTERVAL 1 DAY AS window_end, max(n) AS busiest FROM
(SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS n FROM events GROUP BY 1) GROUP BY ALL""")
def cascaded_windows(t):
    hourly = _events(t).window(windows.tumbling(HOUR)).aggregate(n=A.counting())
    return hourly.window(windows.tumbling(24 * HOUR)).aggregate(busiest=A.max_by("n", "n")).map("window_start", "window_end", "busiest")


@query("SELECT DISTINCT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, user_id FROM events")
def windowed_distinct(t):
    return _events(t).map("user_id", "event_time").apply(lambda s: Stage(s.df, "event_time")).window(windows.tumbling(24 * HOUR)).distinct().map("window_start", "window_end", "user_id")


@query("""WITH a AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS w, user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS w, user_id, round(sum(value), 2) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT coalesce(a.w, b.w) AS window_start, coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS clicks, coalesce(b.n, 0.0) AS spent FROM a FULL JOIN b ON a.w = b.w AND a.user_id = b.user_id""")
def windowed_co_aggregate(t):
    side = lambda kind: _events(t).filter(f"event_type = '{kind}'").grouping_key("user_id").window(windows.tumbling(24 * HOUR))
    return side("click").aggregate2(A.counting(), side("purchase"), A.summing_double("value")).map("window_start", "user_id", clicks="f0", spent=F.round("f1", 2))


@query("""SELECT window_start, event_type, round(coalesce(regr_slope(value, (epoch_us(ts) // 1000 - 1704067200000)::DOUBLE / 3600000), 'NaN'), 4) AS trend FROM (""" + _SLIDES + ") GROUP BY ALL")
def windowed_trend(t):
    got = _events(t).grouping_key("event_type").window(windows.sliding(3 * HOUR, HOUR)).aggregate(trend=A.linear_trend((F.unix_millis("event_time") - 1_704_067_200_000) / 3_600_000, "value"))
    return got.map("window_start", "event_type", trend=F.round("trend", 4))


# -- keyed state


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM events")
def map_stateful(t):
    def step(state, key, row):
        state[row["event_type"]] = state.get(row["event_type"], 0) + 1
        return {"user_id": row["user_id"], "event_id": row["event_id"], "nth": state[row["event_type"]]}

    return _events(t).grouping_key("user_id").map_stateful(dict, step, "user_id long, event_id long, nth long", order=["event_id"])


@query(_SESSIONS.replace("ts >= lag", "date_trunc('millisecond', ts) > date_trunc('millisecond', lag").replace("ORDER BY ts, event_id) + INTERVAL", "ORDER BY ts, event_id)) + INTERVAL").replace("SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n, round(sum(value), 2) AS total, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM", "SELECT user_id, count(*) AS n, epoch_us(max(ts)) // 1000 + 3600000 AS evicted FROM"))
def ttl_evict(t):
    """State that is dropped when not touched for an hour, with what it held given out."""
    def step(state, key, row):
        state["n"] = state.get("n", 0) + 1

    out = lambda state, key, now: {"user_id": key[0], "n": state["n"], "evicted": now}
    return _events(t).grouping_key("user_id").map_stateful(dict, step, "user_id long, n long, evicted long", ttl_ms=HOUR, on_evict=out, order=["event_id"])


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def filter_stateful(t):
    def first(state, key, row):
        new = row["event_type"] not in state
        state.add(row["event_type"])
        return new

    return _events(t).grouping_key("user_id").filter_stateful(set, first, order=["event_id"]).map("event_id")
