"""Counters, gauges, histograms, rates and percentiles from event and sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import shortest
from tidemark.operators.scan import WIDTH, previous

#: Upper bounds of latency buckets, in seconds.
BOUNDS = [0.0001, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def status_class(status: Column) -> Column:
    return F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))


def totals(events: DataFrame, label: str) -> DataFrame:
    """A counter by one label."""
    return events.groupBy(label).agg(F.count("*").alias("total"))


def requests_by_class(requests: DataFrame) -> DataFrame:
    return requests.groupBy("method", "route", status_class(F.col("status")).alias("class")).agg(F.count("*").alias("n"))


def gauge_last(events: DataFrame, label: str, value: str, order: str) -> DataFrame:
    """Last reading of a gauge by label; order must be unique within a label."""
    return events.groupBy(label).agg(F.max_by(value, order).alias("value"))


def gauge_running(events: DataFrame, label: str, delta: str, order: str, width: int = WIDTH) -> DataFrame:
    """Readings of a gauge that is raised and lowered."""
    from tidemark.operators.scan import running

    return running(events, [label], order, F.col(delta), "value", "sum", inclusive=True, width=width)


def histogram(events: DataFrame, label: str, seconds: Column, bounds: list[float] = BOUNDS) -> DataFrame:
    """Cumulative buckets by label: le (text, +Inf last), n; values equal to a bound are within."""
    counts = [F.count_if(seconds <= b).alias(f"_{i}") for i, b in enumerate(bounds)]
    wide = events.groupBy(label).agg(*counts, F.count(seconds).alias("_all"))
    pairs = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("n")))
    return wide.select(label, F.inline(F.array(*pairs)))


def histogram_rows(events: DataFrame, label: str, seconds: Column) -> DataFrame:
    """Sum and count beside the buckets."""
    return events.groupBy(label).agg(F.sum(seconds).alias("sum"), F.count(seconds).alias("count"))


def mean_ms(sum_seconds: Column, count: Column) -> Column:
    return sum_seconds / F.nullif(count, F.lit(0)) * 1000


def rates(samples: DataFrame, keys: list[str], order: str, value: str, width: int = WIDTH) -> DataFrame:
    """samples with rate: the increase since the sample before per unit of order, 0 after a reset, null at first."""
    p = previous(samples, keys, order, [order, value], "_p", width)
    rise = F.greatest(F.col(value) - F.col(f"_p.{value}"), F.lit(0)) / (F.col(order) - F.col(f"_p.{order}"))
    return p.withColumn("rate", rise).drop("_p")


def percentiles(events: DataFrame, label: str, value: str, ps: list[float]) -> DataFrame:
    """Floor-rank percentiles: of n sorted values the one at int(p * (n - 1)); exact, in bounded memory.

    Values are counted first, so equal ones are one row, and ranks come from
    running sums over distinct values in blocks whose width follows their range.
    """
    n = events.where(F.col(value).isNotNull()).groupBy(label, value).agg(F.count("*").alias("_n"))
    block = n.withColumn("_block", F.floor(F.col(value).cast("double") / _width(events, value)))
    sums = block.groupBy(label, "_block").agg(F.sum("_n").alias("_s"))
    w = Window.partitionBy(label).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(label, "_block", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"))
    total = n.groupBy(label).agg(F.sum("_n").alias("_total"))
    inside = Window.partitionBy(label, "_block").orderBy(value)
    ranked = block.join(sums, [label, "_block"]).join(total, label).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    at = lambda p: F.floor(F.lit(p).cast("double") * (F.col("_total") - 1))
    return ranked.groupBy(label).agg(*[F.min(F.when(F.col("_upto") > at(p), F.col(value))).alias(f"p{round(p * 100)}") for p in ps])


def _width(events: DataFrame, value: str, blocks: int = 4096) -> float:
    """A width that cuts the range of the values into so many blocks."""
    low, high = events.agg(F.min(F.col(value).cast("double")), F.max(F.col(value).cast("double"))).first()
    return max((high - low) / blocks, 1e-9) if low is not None and high > low else 1.0


def throughput(events: DataFrame, ts: str) -> DataFrame:
    """Operations a second between the first and the last event; null if they coincide."""
    seconds = F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))
    return events.agg(F.count("*").alias("n"), (F.count("*") / F.nullif(seconds / 1e6, F.lit(0.0))).alias("per_second"))


def one_hot(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    return df.select("*", *[F.when(F.col(column) == n, 1).otherwise(0).alias(f"is_{n}") for n in names])


def active_label(samples: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """The label whose gauge is 1."""
    return samples.groupBy(*keys).agg(F.max(F.when(F.col(value) == 1, F.col(label))).alias("active"))


def recent(events: DataFrame, ts: str, minutes: int) -> DataFrame:
    """Events of the last minutes before the newest one."""
    top = events.agg((F.max(ts) - F.expr(f"interval {minutes} minutes")).alias("t")).scalar()
    return events.where(F.col(ts) > top)


def newest(events: DataFrame, order: list[str], n: int, where: Column | None = None) -> DataFrame:
    """The n newest events, newest first: a report, so the limit is its point."""
    return (events if where is None else events.where(where)).orderBy(*[F.desc(c) for c in order]).limit(n)


def sample(events: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """A uniform sample of at most n rows: those of the least hash, the same on every run and engine."""
    return events.orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")).cast("binary")), id_col).limit(n)


def render(samples: DataFrame) -> DataFrame:
    """Samples (name, label, label_value, value) as lines of the text exposition: name, line."""
    escaped = F.replace(F.replace(F.replace("label_value", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    labels = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("{"), "label", F.lit('="'), escaped, F.lit('"}')))
    return samples.select("name", F.concat("name", labels, F.lit(" "), shortest(F.col("value"))).alias("line"))


def exposition(samples: DataFrame, kinds: DataFrame) -> DataFrame:
    """One text per family (kinds: name, help, kind): comments, then its lines in order."""
    lines = render(samples).groupBy("name").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    head = F.concat(F.lit("# HELP "), "name", F.lit(" "), "help", F.lit("\n# TYPE "), "name", F.lit(" "), "kind", F.lit("\n"))
    return kinds.join(lines, "name").select("name", F.concat(head, F.array_join("lines", "\n"), F.lit("\n")).alias("text"))


#: Fixed pattern of an exposition line: name, labels, value.
LINE = r'^([a-zA-Z_:][a-zA-Z0-9_:]*)(\{(.*)\})?\s+(\S+)$'
LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'


def parse(texts: DataFrame, column: str) -> DataFrame:
    """Rows (name, labels, value) of exposition texts; comments, malformed lines and non-finite values are passed over."""
    line = texts.select(F.explode(F.split(column, "\n")).alias("_l")).select(F.trim(F.regexp_replace("_l", r"^\s+|\s+$", "")).alias("_l"))
    fit = line.where("_l <> '' and not startswith(_l, '#')").where(F.col("_l").rlike(LINE))
    part = lambda i: F.regexp_extract("_l", LINE, i)
    value = F.expr("try_cast(_v as double)")
    told = fit.select(part(1).alias("name"), part(3).alias("_t"), part(4).alias("_v")).withColumn("value", value)
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    clean = lambda v: F.replace(F.replace(F.replace(v, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))
    names, values = F.regexp_extract_all("_t", F.lit(LABEL), 1), F.transform(F.regexp_extract_all("_t", F.lit(LABEL), 2), clean)
    return told.where(finite).select("name", F.map_from_arrays(names, values).alias("labels"), "value")


def scalar(samples: DataFrame, name: str) -> DataFrame:
    """One row (value) of the unlabelled sample of a name; null if there is none."""
    return samples.where((F.col("name") == name) & (F.size("labels") == 0)).agg(F.max("value").alias("value"))


def labelled(samples: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """(labels, value) of the samples of a name that have all these labels, summed over any others."""
    found = samples.where(F.col("name") == name).select(*[F.element_at("labels", x).alias(x) for x in labels], "value")
    for x in labels:
        found = found.where(F.col(x).isNotNull())
    return found.groupBy(*labels).agg(F.sum("value").alias("value"))
