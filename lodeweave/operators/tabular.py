"""Tabular verbs: profiling, cleaning, encoding, grouping, ordering, evaluation. All lazy, all built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_names(df: DataFrame) -> DataFrame:
    """Column names stripped, blanks and hyphens to underscores."""
    return df.toDF(*[c.strip().replace(" ", "_").replace("-", "_") for c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df without the named columns; an unknown name raises."""
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}; known: {df.columns}")
    return df.drop(*names)


def first_rows(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def last_rows(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The last n rows in the given order, last one first."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def info(df: DataFrame) -> DataFrame:
    """(position, column, type, present): a row per column, one scan."""
    wide = df.agg(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count_if(~missing(df, f.name)).alias("present")) for i, f in enumerate(df.schema)]).alias("x"))
    return wide.select(F.inline("x"))


def missing(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def null_counts(df: DataFrame, columns: Sequence[str] | None = None, positive_only: bool = False) -> DataFrame:
    """(column, n) of missing values (null or NaN), one scan; optionally only columns that miss some."""
    columns = list(columns or df.columns)
    wide = df.agg(*[F.count_if(missing(df, c)).alias(c) for c in columns])
    long = wide.unpivot([], columns, "column", "n")
    return long.where("n > 0") if positive_only else long


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, v): a row per present number."""
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.when(~missing(df, c), F.col(f"`{c}`").cast("double")).alias("v")) for c in columns])))
    return rows.where(F.col("v").isNotNull())


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(by..., q array<double>): exact quantiles of each group's present values, interpolated linearly.

    Values are counted, the counts range-partitioned by group and value; a value is
    then found by the ranks it covers. So a group may be of any size, and no task
    holds all its values. A group without values has no row."""
    v = F.col(f"`{value}`").cast("double")
    counted = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("__x")).agg(F.count("*").alias("__n"))
    ranked = running_before(counted.withColumn("__o", F.struct(*by, "__x")), "__o", F.col("__n"), "__before").drop("__o")
    sizes = ranked.groupBy(*by).agg(F.min("__before").alias("__start"), F.sum("__n").alias("__size"))
    sizes = sizes.withColumnsRenamed({c: f"__by_{c}" for c in by})
    rows = ranked.join(sizes, reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`__by_{c}`")) for c in by], F.lit(True)))
    first = F.col("__before") - F.col("__start")
    at = lambda rank: F.max(F.when((first <= rank) & (rank < first + F.col("__n")), F.col("__x")))
    place = [(F.col("__size") - 1) * float(q) for q in shares]
    ends = [x for i, p in enumerate(place) for x in (at(F.floor(p)).alias(f"__lo{i}"), at(F.ceil(p)).alias(f"__hi{i}"), F.max(p - F.floor(p)).alias(f"__f{i}"))]
    found = rows.groupBy(*by).agg(*ends)
    return found.select(*by, F.array(*[F.col(f"__lo{i}") * (1 - F.col(f"__f{i}")) + F.col(f"__hi{i}") * F.col(f"__f{i}") for i in range(len(shares))]).alias("q"))


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max): sample deviation, exact linear quartiles, NaN as missing."""
    columns = list(columns or numeric_columns(df))
    v = {c: F.when(~missing(df, c), F.col(f"`{c}`").cast("double")) for c in columns}
    stats = lambda c: F.struct(F.count(v[c]).alias("count"), F.avg(v[c]).alias("mean"), F.stddev_samp(v[c]).alias("std"), F.min(v[c]).alias("min"), F.max(v[c]).alias("max"))
    long = df.agg(*[stats(c).alias(c) for c in columns]).unpivot([], columns, "column", "s")
    q = F.broadcast(quantiles(long_form(df, columns), ["column"], "v", (0.25, 0.5, 0.75)))  # a row a column
    return long.join(q, "column", "left").select("column", "s.count", "s.mean", "s.std", "s.min", *[F.col("q")[i].alias(f"q{25 * (i + 1)}") for i in range(3)], "s.max")


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(a, b, r) for every ordered pair: Pearson over the rows where both are present; one scan."""
    columns = list(columns or numeric_columns(df))
    v = {c: F.when(~missing(df, c), F.col(f"`{c}`").cast("double")) for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    got = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(v[a], v[b]).alias("r")) for a, b in pairs]).alias("x"))
    one = got.select(F.inline("x"))
    return one.union(one.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))


def histogram(df: DataFrame, name: str, bins: int = 30) -> DataFrame:
    """(bin from 1, lo, hi, n) with equal widths from the least to the greatest value; empty bins included."""
    c = F.col(f"`{name}`").cast("double")
    edge = df.where(~missing(df, name)).agg(F.min(c).alias("least"), F.max(c).alias("most"))
    width = (F.col("most") - F.col("least")) / bins
    at = F.when(width == 0, 1).otherwise(F.least(F.lit(bins), F.floor((F.col("v") - F.col("least")) / width).cast("int") + 1))
    n = df.where(~missing(df, name)).select(c.alias("v")).crossJoin(F.broadcast(edge)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # edge is one row
    all_bins = edge.where("least is not null").select("*", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return all_bins.join(n, "bin", "left").select("bin", (F.col("least") + width * (F.col("bin") - 1)).alias("lo"), (F.col("least") + width * F.col("bin")).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def fill_median(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing numbers replaced by the column's exact median (one row, broadcast)."""
    columns = list(columns or numeric_columns(df))
    found = quantiles(long_form(df, columns), ["column"], "v", (0.5,))
    medians = found.agg(*[F.max(F.when(F.col("column") == c, F.col("q")[0])).alias(f"__m_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(medians))
    return out.select(*[F.when(missing(df, c), F.col(f"`__m_{c}`")).otherwise(F.col(f"`{c}`").cast("double")).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def scale_population(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores with population deviation; a constant column becomes 0."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"__a_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])
    z = lambda c: F.when(F.col(f"__s_{c}") == 0, 0.0).otherwise((F.col(c) - F.col(f"__a_{c}")) / F.col(f"__s_{c}"))
    return df.crossJoin(F.broadcast(stats)).select(*[z(c).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def scale_to_max(value: Column, by: Sequence[str]) -> Column:
    """Negatives to 0, then divided by the partition's greatest; all stay 0 where that is 0."""
    up = F.greatest(value, F.lit(0.0))
    most = F.max(up).over(Window.partitionBy(*by))
    return F.when(most > 1e-12, up / most).otherwise(0.0)


def running_before(rows: DataFrame, order: str, amount: Column, out: str) -> DataFrame:
    """rows with the sum of amount over all rows before them by order (unique): range-partitioned, so no task has all.

    A range's rows are summed within the range, on top of the ranges before it (one number each)."""
    ranged = rows.repartitionByRange(order).withColumn("__p", F.spark_partition_id()).withColumn("__v", amount).persist()
    sums = {r["__p"]: r["s"] for r in ranged.groupBy("__p").agg(F.sum("__v").alias("s")).collect()}  # a row per range
    starts, total = [], 0
    for p in sorted(sums):
        starts += [F.lit(p), F.lit(total)]
        total += sums[p]
    start = F.element_at(F.create_map(*starts), F.col("__p")) if starts else F.lit(0)
    own = F.coalesce(F.sum("__v").over(Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn(out, start + own).drop("__p", "__v")


def label_encode(df: DataFrame, name: str, out: str) -> DataFrame:
    """Whole numbers for the distinct values in lexicographic order; the dictionary is numbered apart and joined."""
    values = df.select(name).where(F.col(name).isNotNull()).distinct()
    return df.join(running_before(values, name, F.lit(1), out).withColumn(out, F.col(out).cast("int")), name, "left")


def map_values(c: Column, mapping: Mapping) -> Column:
    """Values by a dictionary; others null."""
    out = F.lit(None)
    for key, value in mapping.items():
        out = F.when(c == key, value).otherwise(out)
    return out


def group_mean(df: DataFrame, by: str, values: Sequence[str]) -> DataFrame:
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(*[F.avg(F.when(~missing(df, v), F.col(v))).alias(v) for v in values])


def group_mean_top(df: DataFrame, by: str, value: str, k: int = 10, out: str = "mean") -> DataFrame:
    return group_mean(df, by, [value]).select(by, F.col(value).alias(out)).orderBy(F.desc(out), by).limit(k)


def value_counts(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def next_row_target(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], out: str = "target") -> DataFrame:
    """1 where the next row's value is greater; the last row of each series gets 0."""
    following = F.lead(value).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(out, F.when(following > F.col(value), 1).otherwise(0))


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The first row with the key, or none."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def hash_percent(key: Column) -> Column:
    """0 to 99 by an MD5 of the key: the same rows in every engine."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(100)).cast("int")


def hash_split(df: DataFrame, key: str, test_percent: int = 20, out: str = "part") -> DataFrame:
    return df.withColumn(out, F.when(hash_percent(F.col(key)) < test_percent, "test").otherwise("train"))


def stratified_split(df: DataFrame, key: str, by: str, test_percent: int = 20, out: str = "part") -> DataFrame:
    """Within each class the rows whose hash ranks in the first percents are test rows.

    Classes may be huge: ranks are taken per hash bucket of 100 and only whole buckets
    and the rows of the bucket that the cut falls in are compared, so no class meets in one task."""
    h = F.md5(F.col(key).cast("string"))
    rows = df.withColumn("__h", h).withColumn("__b", F.conv(F.substring(h, 1, 3), 16, 10).cast("int"))
    counts = rows.groupBy(by, "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(by).orderBy("__b")  # 4,096 rows a class at most
    counts = counts.withColumn("__before", F.sum("__n").over(w) - F.col("__n")).withColumn("__total", F.sum("__n").over(Window.partitionBy(by)))
    rank = F.row_number().over(Window.partitionBy(by, "__b").orderBy("__h", key)) + F.col("__before")
    out_rows = rows.join(counts, [by, "__b"]).withColumn(out, F.when(rank <= F.floor(F.col("__total") * test_percent / 100), "test").otherwise("train"))
    return out_rows.drop("__h", "__b", "__n", "__before", "__total")


# --- evaluation ---------------------------------------------------------------


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(class, precision, recall, f1, support) per class, then 'macro avg' and 'weighted avg'; 0 where undefined."""
    cells = confusion(df, label, predicted)
    per = lambda c, name: cells.groupBy(F.col(c).cast("string").alias("class")).agg(F.sum("n").alias(name))
    hit = cells.where(F.col(label) == F.col(predicted)).select(F.col(label).cast("string").alias("class"), F.col("n").alias("hit"))
    x = per(label, "support").join(per(predicted, "given"), "class", "full").join(hit, "class", "left").na.fill(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    x = x.withColumn("precision", ratio(F.col("hit"), F.col("given"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    x = x.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("class", "precision", "recall", "f1", "support")
    names = ("precision", "recall", "f1")
    macro = x.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = x.agg(F.lit("weighted avg").alias("class"), *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names], F.sum("support").alias("support"))
    return x.union(macro).union(weighted)


def accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def regression_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(mae, rmse, r2) in one scan."""
    e, y = F.col(label) - F.col(predicted), F.col(label)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / (F.var_pop(y) * F.count(y))).alias("r2"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by tied ranks: counts per distinct score, then a running sum over ranges of those."""
    per = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    per = running_before(per, "s", F.col("n") - F.col("p"), "below")
    won = per.withColumn("won", F.col("p") * (F.col("below") + (F.col("n") - F.col("p")) / 2))
    return won.agg((F.sum("won") / (F.sum("p") * F.sum(F.col("n") - F.col("p")))).alias("auc"))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


# --- predicates -----------------------------------------------------------------


def scope(tenant: str, *, tenant_column: str = "tenant_id", equals: Mapping | None = None, within: Mapping | None = None, page_range: tuple[int, int] | None = None, page_column: str = "page_number") -> Column:
    """An ANDed predicate, tenant first. A blank tenant raises; a page range may be given either way round."""
    if not (tenant or "").strip():
        raise ValueError("a tenant is required")
    parts = [F.col(tenant_column) == tenant]
    parts += [F.col(c) == v for c, v in (equals or {}).items()]
    parts += [F.col(c).isin(list(v)) for c, v in (within or {}).items()]
    if page_range:
        parts += [F.col(page_column) >= min(page_range), F.col(page_column) <= max(page_range)]
    return reduce(lambda a, b: a & b, parts)
