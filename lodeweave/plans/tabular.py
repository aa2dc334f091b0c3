"""Queries of the tabular verbs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeweave.operators import tabular as t
from lodeweave.plans.registry import query, table


@query("""SELECT n_name, round(avg(c_acctbal), 6) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey
          GROUP BY n_name ORDER BY mean DESC, n_name LIMIT 10""")
def group_mean_topk(spark, d):
    x = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return t.group_mean_top(x, "n_name", "c_acctbal").withColumn("mean", F.round("mean", 6))


@query("SELECT year(o_orderdate)::INTEGER AS year, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1 ORDER BY 1")
def group_mean_by_key(spark, d):
    x = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return t.group_mean(x, "year", ["o_totalprice"]).select("year", F.round("o_totalprice", 4).alias("mean")).orderBy("year")


@query("""SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice,
          round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1""")
def group_mean_all(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    x = t.group_mean(table(spark, d, "lineitem"), "l_returnflag", names)
    return x.select("l_returnflag", *[F.round(c, 4 if c == "l_extendedprice" else 6).alias(c) for c in names])


@query("""WITH r AS (SELECT lang, 1.0 * len(regexp_extract_all(text, '[.]')) / length(text) AS dots,
          1.0 * len(regexp_extract_all(text, '[0-9]')) / length(text) AS digits FROM documents)
          SELECT lang, round(avg(dots), 6) AS dots, round(avg(digits), 6) AS digits FROM r GROUP BY lang""")
def group_mean_ratios(spark, d):
    n = F.length("text")
    share = lambda p: F.when(n > 0, F.regexp_count("text", F.lit(p)) / n).when(n == 0, float("nan"))  # noqa: E731  0 / 0 is NaN in SQL, an error here
    x = table(spark, d, "documents").select("lang", share("[.]").alias("dots"), share("[0-9]").alias("digits"))
    return x.groupBy("lang").agg(F.round(F.avg("dots"), 6).alias("dots"), F.round(F.avg("digits"), 6).alias("digits"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type")
def value_counts(spark, d):
    return t.value_counts(table(spark, d, "events"), "event_type")


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1")
def group_size(spark, d):
    return table(spark, d, "orders").where("o_custkey is not null").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS orders, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total,
          count(*) FILTER (o_orderstatus = 'O') AS open FROM orders""")
def kpi_totals(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))


@query("""SELECT 'event_id' AS "column", count(*) FILTER (event_id IS NULL) AS n FROM events
          UNION ALL SELECT 'value', count(*) FILTER (value IS NULL OR value < 10) FROM events
          UNION ALL SELECT 'user_id', count(*) FILTER (user_id % 7 = 0) FROM events""")
def null_counts(spark, d):
    x = table(spark, d, "events").select("event_id", F.expr("if(value < 10, null, value) as value"), F.expr("if(user_id % 7 = 0, null, user_id) as user_id"))
    return t.null_counts(x)


@query("""SELECT 'value' AS "column", count(*) FILTER (value < 10) AS n FROM events HAVING count(*) FILTER (value < 10) > 0 ORDER BY n DESC""")
def null_counts_positive(spark, d):
    x = table(spark, d, "events").select("event_id", F.expr("if(value < 10, null, value) as value"))
    return t.null_counts(x, positive_only=True).orderBy(F.desc("n"), "column")


_DESCRIBE = """SELECT '{0}' AS "column", count({0}) AS count, round(avg({0}), 4) AS mean, round(stddev_samp({0}), 4) AS std, round(min({0}), 4)::DOUBLE AS min,
 round(quantile_cont({0}, 0.25), 4) AS q25, round(quantile_cont({0}, 0.5), 4) AS q50, round(quantile_cont({0}, 0.75), 4) AS q75, round(max({0}), 4)::DOUBLE AS max FROM lineitem"""


@query(" UNION ALL ".join(_DESCRIBE.format(c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def describe(spark, d):
    x = t.describe(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return x.select("column", "count", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in _CORR for b in _CORR))
def corr_matrix(spark, d):
    return t.correlations(table(spark, d, "lineitem"), _CORR).withColumn("r", F.round("r", 6))


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
          n AS (SELECT least(30, floor((value - lo) / ((hi - lo) / 30))::INTEGER + 1) AS bin, count(*) AS n FROM events, e GROUP BY 1)
          SELECT b.bin::INTEGER AS bin, round(lo + (hi - lo) / 30 * (b.bin - 1), 6) AS lo, round(lo + (hi - lo) / 30 * b.bin, 6) AS hi, coalesce(n, 0)::BIGINT AS n
          FROM range(1, 31) b(bin) CROSS JOIN e LEFT JOIN n ON n.bin = b.bin""")
def histogram(spark, d):
    return t.histogram(table(spark, d, "events"), "value", 30).select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@query("""SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3,
          round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY 1""")
def box_stats(spark, d):
    e = table(spark, d, "events")
    x = e.groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    x = x.join(t.quantiles(e, ["event_type"], "value", (0.25, 0.5, 0.75)), "event_type")
    return x.select("event_type", *[F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)], F.round("least", 6).alias("least"), F.round("most", 6).alias("most"))


@query("""WITH x AS (SELECT event_id, CASE WHEN value >= 10 THEN value END AS value FROM events)
          SELECT event_id, round(coalesce(value, (SELECT median(value) FROM x)), 6) AS value FROM x""")
def median_fill(spark, d):
    x = table(spark, d, "events").select("event_id", F.expr("if(value >= 10, value, null) as value"))
    return t.fill_median(x, ["value"]).select("event_id", F.round("value", 6).alias("value"))


@query("""SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS value FROM events""")
def zscore_pop(spark, d):
    x = t.scale_population(table(spark, d, "events").select("event_id", "value"), ["value"])
    return x.select("event_id", F.round("value", 6).alias("value"))


@query("SELECT c_custkey, c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment)::INTEGER - 1 AS code FROM customer")
def label_encode(spark, d):
    return t.label_encode(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "code")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0.0 WHEN 'F' THEN 1.0 END::DOUBLE AS code FROM orders")
def value_map(spark, d):
    return table(spark, d, "orders").select("o_orderkey", t.map_values(F.col("o_orderstatus"), {"O": 0, "F": 1}).cast("double").alias("code"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def dedupe_rows(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").dropDuplicates()


@query("""SELECT event_id, CASE WHEN lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) > value THEN 1 ELSE 0 END AS target FROM events""")
def next_row_target(spark, d):
    return t.next_row_target(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"]).select("event_id", "target")


@query("""SELECT o_orderkey, day(o_orderdate)::INTEGER AS day, month(o_orderdate)::INTEGER AS month, year(o_orderdate)::INTEGER AS year,
          CASE WHEN month(o_orderdate) % 3 = 0 THEN 1 ELSE 0 END AS quarter_end FROM orders""")
def date_parts(spark, d):
    parts = F.split(F.date_format("o_orderdate", "M/d/yyyy"), "/")
    x = table(spark, d, "orders").select("o_orderkey", *[parts[i].cast("int").alias(n) for n, i in (("day", 1), ("month", 0), ("year", 2))])
    return x.withColumn("quarter_end", F.when(F.col("month") % 3 == 0, 1).otherwise(0))


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_tax, 6) AS spread,
          round(l_quantity / (SELECT max(l_quantity) FROM lineitem) * 300, 6) AS size FROM lineitem WHERE l_linenumber = l_linenumber""")
def arithmetic_columns(spark, d):
    x = table(spark, d, "lineitem").where(F.col("l_linenumber") == F.col("l_linenumber"))
    most = F.broadcast(x.agg(F.max("l_quantity").alias("most")))  # one row
    return x.crossJoin(most).select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") - F.col("l_tax"), 6).alias("spread"), F.round(F.col("l_quantity") / F.col("most") * 300, 6).alias("size"))


@query("""SELECT c_custkey, c_name, coalesce(n, 0) AS n FROM customer LEFT JOIN
          (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def left_join_counts(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return c.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT o_orderkey, c_name, n_name, r_name, count(l_linenumber) AS lines FROM orders LEFT JOIN customer ON o_custkey = c_custkey
          LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN lineitem ON l_orderkey = o_orderkey
          GROUP BY ALL""")
def lookup_chain(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("l_linenumber").alias("lines"))
    x = o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    x = x.join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    x = x.join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    x = x.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return x.select("o_orderkey", "c_name", "n_name", "r_name", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def point_lookup(spark, d):
    return t.point_lookup(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 7)


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join(spark, d):
    keys = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).where("n > 1")


_PCT = "(('0x' || substr(md5(cast({} AS VARCHAR)), 1, 8))::BIGINT % 100)"


@query(f"SELECT o_orderkey, CASE WHEN {_PCT.format('o_orderkey')} < 20 THEN 'test' ELSE 'train' END AS part FROM orders")
def hash_split(spark, d):
    return t.hash_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("""SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5(cast(doc_id AS VARCHAR)), doc_id)
          <= floor(count(*) OVER (PARTITION BY quality) * 20 / 100) THEN 'test' ELSE 'train' END AS part FROM labels""")
def stratified_split(spark, d):
    return t.stratified_split(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality")


_RULE = "SELECT quality AS label, CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS predicted, n_chars / 1000.0 AS score FROM labels JOIN documents USING (doc_id)"


def _ruled(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return x.select(F.col("quality").alias("label"), F.when(F.col("n_chars") > 400, 1).otherwise(0).alias("predicted"), (F.col("n_chars") / 1000.0).alias("score"))


@query(f"WITH x AS ({_RULE}) SELECT label, predicted, count(*) AS n FROM x GROUP BY ALL")
def confusion_matrix(spark, d):
    return t.confusion(_ruled(spark, d), "label", "predicted")


@query(f"""WITH x AS ({_RULE}), k AS (SELECT DISTINCT label AS c FROM x UNION SELECT DISTINCT predicted FROM x),
    p AS (SELECT c, count(*) FILTER (label = c AND predicted = c) AS hit, count(*) FILTER (predicted = c) AS given, count(*) FILTER (label = c) AS support FROM k, x GROUP BY c),
    q AS (SELECT c, coalesce(hit / nullif(given, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, support FROM p),
    f AS (SELECT c, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM q)
    SELECT cast(c AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM f
    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM f""")
def classification_report(spark, d):
    return t.classification_report(_ruled(spark, d), "label", "predicted").select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH x AS ({_RULE}) SELECT round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM x")
def accuracy(spark, d):
    return t.accuracy(_ruled(spark, d), "label", "predicted").select(F.round("accuracy", 6).alias("accuracy"))


@query("""WITH x AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)
          SELECT round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
          round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2 FROM x""")
def regression_metrics(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    return t.regression_metrics(x, "y", "p").select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


@query(f"""WITH x AS ({_RULE}), r AS (SELECT label, avg(i) OVER (PARTITION BY score) AS r FROM (SELECT *, row_number() OVER (ORDER BY score) AS i FROM x))
          SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2)
          / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc FROM r""")
def roc_auc(spark, d):
    return t.roc_auc(_ruled(spark, d), "label", "score").select(F.round("auc", 6).alias("auc"))


@query("""SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
          round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""")
def linear_fit(spark, d):
    return t.linear_fit(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("""SELECT source, vec, round(coalesce(greatest(s, 0) / nullif(max(greatest(s, 0)) OVER (PARTITION BY source), 0), 0), 6) AS scaled
          FROM (SELECT source, doc_id AS vec, n_chars - 500.0 AS s FROM documents)""")
def scale_by_max(spark, d):
    x = table(spark, d, "documents").select("source", F.col("doc_id").alias("vec"), (F.col("n_chars") - 500.0).alias("s"))
    return x.select("source", "vec", F.round(t.scale_to_max(F.col("s"), ["source"]), 6).alias("scaled"))


@query("""WITH f AS (SELECT source, lang, min(doc_id) AS first FROM documents GROUP BY ALL)
          SELECT source, list(lang ORDER BY first) AS langs FROM f GROUP BY source""")
def distinct_in_order(spark, d):
    first = table(spark, d, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("first"))
    return first.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "lang"))), lambda x: x["lang"]).alias("langs"))


@query("SELECT max(CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END)::INTEGER AS worst, count(*) AS n FROM events")
def worst_status(spark, d):
    rank = t.map_values(F.col("event_type"), {"purchase": 2, "click": 1}).cast("int")
    return table(spark, d, "events").agg(F.max(F.coalesce(rank, F.lit(0))).alias("worst"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
          r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS r FROM c)
          SELECT user_id, event_type, n FROM r WHERE r <= 10""")
def top_per_class(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id"))
    return n.withColumn("r", r).where("r <= 10").drop("r")
