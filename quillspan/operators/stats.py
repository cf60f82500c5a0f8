"""Distribution and association statistics, exact, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspan.operators.prefix import running_total
from quillspan.sources.scratch import materialize

QUANTILES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


def shares(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share), most frequent first in meaning: ties have no order of their own."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def nested_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """(outer, counts): for each value, a map from the values of ``inner`` beside it to their number, in order."""
    per = df.groupBy(outer, F.coalesce(F.col(inner).cast("string"), F.lit("")).alias("_i")).agg(F.count("*").alias("_n"))
    return per.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_i", "_n")))).alias("counts"))


def quantile_profile(df: DataFrame, columns: list[str], group: str | None = None) -> DataFrame:
    """(group, field, n, mean, std, quantiles): linear quantiles and population deviation of each column.

    Values are counted, then ranked by running totals over ranges of (group, field, value), so no group is sorted
    or held in one task; a quantile is read off the two values around its place."""
    own = F.col(group) if group else F.lit("all")
    long = df.select(own.alias("group"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select("group", "e.*")
    counts = materialize(long.groupBy("group", "field", "x").agg(F.count("*").alias("c")), "quantile-counts")
    valid = counts.where("x is not null")
    run = running_total(valid, ["group", "field", "x"], {"before": "c"})
    ahead = run.groupBy(F.col("group").alias("g"), F.col("field").alias("f")).agg(F.sum("c").alias("n"), F.min("before").alias("first"))
    placed = run.join(F.broadcast(ahead) if len(columns) * 1000 > ahead.count() else ahead, F.col("group").eqNullSafe(F.col("g")) & (F.col("field") == F.col("f")))
    low = F.col("before") - F.col("first")
    at = lambda place: F.max(F.when((low <= place) & (place < low + F.col("c")), F.col("x")))

    def quantile(q: float) -> Column:
        place = q * (F.col("n") - 1)
        return (at(F.floor(place)) + (F.max(place) - F.max(F.floor(place))) * (at(F.ceil(place)) - at(F.floor(place)))).alias(f"q{int(q * 100):03d}")

    quantiles = placed.groupBy("group", "field").agg(*[quantile(q) for q in QUANTILES]).select(F.col("group").alias("g"), F.col("field").alias("f"), *[f"q{int(q * 100):03d}" for q in QUANTILES])
    moments = long.groupBy("group", "field").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return moments.join(quantiles, F.col("group").eqNullSafe(F.col("g")) & (F.col("field") == F.col("f")), "left").drop("g", "f")


def index_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """(value): the element at floor(n*q) of the sorted values, no interpolation. Sorted by a range shuffle, not in one task."""
    n = df.where(F.col(column).isNotNull()).count()
    at = min(int(n * q), n - 1)
    if n == 0:
        return df.select(F.col(column).alias("value")).limit(0)
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return running_total(counts, ["value"], {"before": "n"}).where(F.col("before") + F.col("n") > at).agg(F.min("value").alias("value"))


def mean_difference(df: DataFrame, side: Column, columns: list[str]) -> DataFrame:
    """(field, difference, smd): second side minus first, and over the pooled population deviation (1 if that is 0)."""
    long = df.select(side.alias("second"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select("second", "e.*")
    on = lambda f, s: f(F.when(F.col("second") == s, F.col("x")))
    g = long.groupBy("field").agg((on(F.avg, True) - on(F.avg, False)).alias("difference"), F.sqrt((on(F.var_pop, True) + on(F.var_pop, False)) / 2).alias("pooled"))
    return g.select("field", "difference", (F.col("difference") / F.when(F.col("pooled") == 0, 1.0).otherwise(F.col("pooled"))).alias("smd"))


def ks_statistic(df: DataFrame, side: Column, column: str) -> DataFrame:
    """(n_first, n_second, statistic, p_value): the largest gap of two empirical distributions, and its
    asymptotic p-value (the series over 100 terms)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count_if(~side).alias("a"), F.count_if(side).alias("b"))
    sums = counts.agg(F.sum("a").alias("n"), F.sum("b").alias("m")).first()
    n, m = sums["n"] or 0, sums["m"] or 0
    run = running_total(counts, ["x"], {"ra": "a", "rb": "b"})
    gap = F.abs((F.col("ra") + F.col("a")) / F.lit(max(n, 1)) - (F.col("rb") + F.col("b")) / F.lit(max(m, 1)))
    out = run.agg(F.lit(n).alias("n_first"), F.lit(m).alias("n_second"), F.max(gap).alias("statistic"))
    # the product of two counts passes 32 bits from some 100,000 rows on, so it is taken as double
    first, second = F.col("n_first").cast("double"), F.col("n_second").cast("double")
    z = F.col("statistic") * F.sqrt(first * second / (first + second))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, j: a + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * z * z))
    return out.withColumn("p_value", F.when(z < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))))


def total_variation(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(tvd): half the summed difference of two share tables over the union of their values."""
    p, q = shares(a, column).select(F.col("value").alias("v"), F.col("share").alias("p")), shares(b, column).select(F.col("value").alias("w"), F.col("share").alias("q"))
    both = p.join(q, F.col("v").eqNullSafe(F.col("w")), "full_outer")
    return both.agg((0.5 * F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0))))).alias("tvd"))


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all pairs of columns, from one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("x")).select("x.*")


def cramers_v(df: DataFrame, row: str, column: str) -> DataFrame:
    """(n, v): Cramer's V with the correction for small samples."""
    cells = df.groupBy(F.col(row).cast("string").alias("r"), F.col(column).cast("string").alias("c")).agg(F.count("*").cast("double").alias("o"))
    rows = cells.groupBy(F.col("r").alias("r2")).agg(F.sum("o").alias("rn"))
    cols = cells.groupBy(F.col("c").alias("c2")).agg(F.sum("o").alias("cn"))
    sizes = cells.agg(F.sum("o").alias("n"), F.count_distinct("r").alias("kr"), F.count_distinct("c").alias("kc"))
    # sum of (o-e)^2/e over all cells = sum of o^2/e over cells seen - n
    seen = cells.join(rows, F.col("r") == F.col("r2")).join(cols, F.col("c") == F.col("c2")).agg(F.sum(F.col("o") * F.col("o") / (F.col("rn") * F.col("cn"))).alias("q"))
    both = seen.withColumn("_k", F.lit(1)).join(sizes.withColumn("_k", F.lit(1)), "_k")
    n1 = F.greatest(F.lit(1.0), F.col("n") - 1)
    phi = F.greatest(F.lit(0.0), F.col("q") - 1 - (F.col("kc") - 1) * (F.col("kr") - 1) / n1)
    rc = F.col("kr") - (F.col("kr") - 1) * (F.col("kr") - 1) / n1
    kc = F.col("kc") - (F.col("kc") - 1) * (F.col("kc") - 1) / n1
    return both.select(F.col("n").cast("long").alias("n"), F.sqrt(phi / F.greatest(F.lit(1e-12), F.least(rc - 1, kc - 1))).alias("v"))


def vocabulary_overlap(a: DataFrame, b: DataFrame, token: str) -> DataFrame:
    """(vocab_a, vocab_b, shared, oov_rate): distinct tokens, shared ones, and the share of b's tokens not in a."""
    va = a.groupBy(F.col(token).alias("t")).agg(F.count("*").alias("na"))
    vb = b.groupBy(F.col(token).alias("u")).agg(F.count("*").alias("nb"))
    both = va.join(vb, F.col("t") == F.col("u"), "full_outer")
    return both.agg(F.count("t").alias("vocab_a"), F.count("u").alias("vocab_b"), F.count_if(F.col("t").isNotNull() & F.col("u").isNotNull()).alias("shared"),
                    (F.coalesce(F.sum(F.when(F.col("t").isNull(), F.col("nb"))), F.lit(0)) / F.greatest(F.lit(1), F.sum("nb"))).alias("oov_rate"))


def modes(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): the most frequent value of each key, ties to the smaller value."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"))
    return best.select(key, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def date_profile(df: DataFrame, column: str, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """(low, high, dates) and the days of most rows (ties to the earlier)."""
    day = df.select(F.date_format(column, "yyyy-MM-dd").alias("day"))
    return day.agg(F.min("day").alias("low"), F.max("day").alias("high"), F.count_distinct("day").alias("dates")), day.groupBy("day").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "day").limit(top)


def format_profile(docs: DataFrame, text: str = "text", group: str | None = None) -> DataFrame:
    """Mean newlines and blank lines a document, share of documents with a digit or an e-mail address."""
    t = F.col(text)
    key = F.col(group) if group else F.lit("all")
    blank = F.size(F.filter(F.split(t, "\n", -1), lambda x: ~x.rlike(r"(?U)\S")))
    lines = F.size(F.split(t, "\n", -1)) - 1
    rate = lambda c: F.avg(c.cast("double"))
    return docs.groupBy(key.alias("group")).agg(F.avg(lines).alias("mean_newlines"), F.avg(blank).alias("mean_blank_lines"), rate(t.rlike(r"(?U)\d")).alias("digit_rate"), rate(t.rlike(r"(?U)[\w.+-]+@[\w.-]+")).alias("email_rate"))


def column_profile(df: DataFrame) -> DataFrame:
    """(field, nulls, distinct) of every column, exact."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"{c}|n") for c in df.columns], *[F.count_distinct(F.col(f"`{c}`")).alias(f"{c}|d") for c in df.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}|n`").alias("nulls"), F.col(f"`{c}|d`").alias("distinct")) for c in df.columns])).alias("x")).select("x.*")


def cube_counts(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Measures for all rows, for each key alone and for all keys together (grouping sets)."""
    sets = [[], *[[k] for k in keys], *([keys] if len(keys) > 1 else [])]
    return df.groupingSets(sets, *keys).agg(*[c.alias(n) for n, c in measures.items()])


def bit_groups(df: DataFrame, flags: str, bits: int, measures: dict[str, Column]) -> DataFrame:
    """Measures by each set bit of a flag column; a row counts under every bit it has."""
    each = F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.when(F.getbit(F.col(flags).cast("long"), i) == 1, i)), lambda x: x.isNotNull()))
    return df.withColumn("bit", each).groupBy("bit").agg(*[c.alias(n) for n, c in measures.items()])


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    """(low, n): rows in steps of ``width``, each step named by its lower end."""
    return df.where(F.col(column).isNotNull()).groupBy((F.floor(F.col(column) / width) * width).cast("double").alias("low")).agg(F.count("*").alias("n"))


def leaf_sums(df: DataFrame, column: str) -> DataFrame:
    """(path, total): the sum of every number inside a nested struct column, by its dotted path."""
    from pyspark.sql import types as T

    def leaves(kind: T.DataType, path: str) -> list[str]:
        if isinstance(kind, T.StructType):
            return [x for f in kind for x in leaves(f.dataType, f"{path}.{f.name}")]
        return [path] if isinstance(kind, (T.NumericType, T.BooleanType)) else []

    paths = leaves(df.schema[column].dataType, column)
    one = df.agg(*[F.sum(F.col(p).cast("double")).alias(f"v{i}") for i, p in enumerate(paths)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(p.split(".", 1)[1]).alias("path"), F.col(f"v{i}").alias("total")) for i, p in enumerate(paths)])).alias("x")).select("x.*")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, when: str, take: list[str]) -> DataFrame:
    """``left`` with the ``take`` columns of the last ``right`` row of its key whose ``when`` is not after ``at``.

    One sort by key and place over both sides, no range join. Of right rows in one place the greatest wins.
    """
    mark = F.struct(F.col(when).alias("w"), *take)
    l = left.withColumns({"_at": F.col(at), "_side": F.lit(1), "_r": F.lit(None).cast(right.select(mark.alias("m")).schema["m"].dataType)})
    r = right.select(F.col(key), F.col(when).alias("_at"), F.lit(0).alias("_side"), mark.alias("_r"))
    both = l.unionByName(r, allowMissingColumns=True)
    run = Window.partitionBy(key).orderBy("_at", "_side", "_r").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("_m", F.last("_r", ignorenulls=True).over(run)).where("_side = 1").select(*left.columns, *[F.col(f"_m.{c}").alias(c) for c in take])
