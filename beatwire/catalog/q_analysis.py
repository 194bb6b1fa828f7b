"""Trends, correlation, coverage, splits and quality figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatwire.catalog.q_classify import CLASSIFIED_SQL, classified
from beatwire.catalog.q_articles import LANGS_SQL, ROUTE_SQL, route_language
from beatwire.catalog.registry import query, table
from beatwire.catalog.views import ARTICLES_SQL, articles
from beatwire.dims import TAX6
from beatwire.operators import correlate as co
from beatwire.operators import states as mergeable
from beatwire.operators import trend as tr
from beatwire.operators.split import split_exact, split_sizes
from beatwire.session import work_dir
from beatwire.sources.tables import read_baseline

# --- trends -------------------------------------------------------------------


def _gap_filled_sql(source: str, date: str, cats: list[str], grain: str,
                    name: str, agg: str = "CAST(sum({c}) AS BIGINT)", prefix: str = "") -> str:
    """CTEs ending in ``name`` (label, categories...), periods without rows as 0."""
    if grain == "month":
        label, end = "month_end", f"last_day({date})"
        start, step, back = "date_trunc('month', {0})", "INTERVAL 1 MONTH", "last_day({0})"
    else:
        # the Sunday that closes an ISO week
        label, end = "week_end", f"CAST(date_trunc('week', {date}) + INTERVAL 6 DAY AS DATE)"
        start, step, back = "{0}", "INTERVAL 7 DAY", "{0}"
    sums = ", ".join(f"{agg.format(c=c)} AS {c}" for c in cats)
    fill = ", ".join(f"coalesce(s.{c}, 0) AS {c}" for c in cats)
    return f"""{name}_sums AS (SELECT {end} AS {label}, {sums} FROM {source}
  WHERE {date} IS NOT NULL GROUP BY 1),
{name}_cal AS (SELECT CAST({back.format('d')} AS DATE) AS {label} FROM (
  SELECT CAST(unnest(generate_series({start.format(f'min({label})')}::TIMESTAMP,
         {start.format(f'max({label})')}::TIMESTAMP, {step})) AS DATE) AS d FROM {name}_sums)),
{name} AS (SELECT c.{label}, {fill} FROM {name}_cal c LEFT JOIN {name}_sums s USING ({label}))"""


def _dated(label: str, cats: list[str], name: str) -> str:
    return (f"SELECT strftime({label}, '%Y-%m-%d') AS {label}, {', '.join(cats)} FROM {name}")


def _text_date(df, label):
    return df.withColumn(label, F.date_format(label, "yyyy-MM-dd"))


_STRICT = f"{CLASSIFIED_SQL}, dated AS (SELECT *, CAST(date AS DATE) AS d FROM classified)"
_COERCED = (f"{CLASSIFIED_SQL}, dated AS (SELECT *, TRY_CAST(date_raw AS DATE) AS d "
            "FROM classified)")


@query("trend_monthly", f"WITH {_STRICT}, {_gap_filled_sql('dated', 'd', TAX6, 'month', 'm')} "
       + _dated("month_end", TAX6, "m"))
def trend_monthly(spark, sf_dir):
    """Articles, scored and labelled, summed by month, empty months included."""
    return _text_date(tr.trend(classified(spark, sf_dir), TAX6), "month_end")


@query("trend_monthly_coerced",
       f"WITH {_COERCED}, {_gap_filled_sql('dated', 'd', TAX6, 'month', 'm')} "
       + _dated("month_end", TAX6, "m"))
def trend_monthly_coerced(spark, sf_dir):
    return _text_date(tr.trend(classified(spark, sf_dir), TAX6, "date_raw", strict=False),
                      "month_end")


@query("trend_weekly", f"WITH {_STRICT}, {_gap_filled_sql('dated', 'd', TAX6, 'week', 'm')} "
       + _dated("week_end", TAX6, "m"))
def trend_weekly(spark, sf_dir):
    return _text_date(tr.trend(classified(spark, sf_dir), TAX6, grain="week"), "week_end")


# --- shipments against orders: two series that overlap but for their ends --------

CATS = ["c1", "c2", "c3"]


def shipments(spark, sf_dir):
    """Monthly lines per return flag."""
    flags = dict(zip(CATS, "ANR"))
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"),
        *[F.when(F.col("l_returnflag") == v, 1).otherwise(0).alias(c) for c, v in flags.items()])
    return tr.trend(df.withColumn("date", F.date_format("date", "yyyy-MM-dd")), CATS)


def orders_baseline(spark, sf_dir):
    """Daily order counts of three priorities."""
    df = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("date"), "o_orderpriority")
    names = {"c1": "1-URGENT", "c2": "2-HIGH", "c3": "5-LOW"}
    return df.groupBy("date").agg(*[
        F.count_if(F.col("o_orderpriority") == v).alias(c) for c, v in names.items()])


SHIPMENTS_SQL = """ship AS (SELECT CAST(l_shipdate AS DATE) AS d,
  CAST(l_returnflag = 'A' AS INT) AS c1, CAST(l_returnflag = 'N' AS INT) AS c2,
  CAST(l_returnflag = 'R' AS INT) AS c3 FROM lineitem), """ + _gap_filled_sql(
      "ship", "d", CATS, "month", "trend")
BASELINE_SQL = """daily AS (SELECT CAST(o_orderdate AS DATE) AS d,
  count(*) FILTER (o_orderpriority = '1-URGENT') AS c1,
  count(*) FILTER (o_orderpriority = '2-HIGH') AS c2,
  count(*) FILTER (o_orderpriority = '5-LOW') AS c3 FROM orders GROUP BY 1), """ + _gap_filled_sql(
      "daily", "d", CATS, "month", "base")


def _long_sql(source: str, key: str, name: str, value: str) -> str:
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT {key}, '{c}' AS category, CAST({c} AS DOUBLE) AS {value} FROM {source}"
        for c in CATS) + ")"


PAIRS_SQL = (f"{SHIPMENTS_SQL}, {BASELINE_SQL}, "
             f"{_long_sql('trend', 'month_end', 'tl', 'predicted')}, "
             f"{_long_sql('base', 'month_end', 'bl', 'official')}, "
             "pairs AS (SELECT month_end, category, predicted, official "
             "FROM tl JOIN bl USING (month_end, category))")


@query("scan_baseline", f"WITH {BASELINE_SQL} SELECT strftime(d, '%Y-%m-%d') AS date, "
       "c1, c2, c3 FROM daily")
def scan_baseline(spark, sf_dir):
    """Statistics written as CSV and read back with a parsed date."""
    path = work_dir(spark, "baseline")
    orders_baseline(spark, sf_dir).write.csv(path, header=True)
    df = read_baseline(spark, path, CATS)
    return df.select(F.date_format("date", "yyyy-MM-dd").alias("date"),
                     *[F.col(c).cast("bigint").alias(c) for c in CATS])


@query("align_months", f"WITH {PAIRS_SQL} SELECT strftime(month_end, '%Y-%m-%d') AS month_end, "
       "category, predicted, official FROM pairs")
def align_months(spark, sf_dir):
    pairs = co.align_months(shipments(spark, sf_dir), orders_baseline(spark, sf_dir))
    return _text_date(pairs, "month_end")


def _positional_sql(trend: str) -> str:
    """Statistics cut to the common months, or raw when there are none; paired by place.

    The file of raw rows begins with the newest day.
    """
    return f"""lim AS (SELECT greatest(t0, b0) AS lo, least(t1, b1) AS hi FROM
  (SELECT min(month_end) AS t0, max(month_end) AS t1 FROM {trend}),
  (SELECT min(month_end) AS b0, max(month_end) AS b1 FROM base)),
off AS (SELECT date_diff('day', DATE '1970-01-01', month_end) AS place, c1, c2, c3
    FROM base, lim WHERE month_end BETWEEN lo AND hi
  UNION ALL SELECT -date_diff('day', DATE '1970-01-01', d), c1, c2, c3 FROM daily, lim WHERE lo > hi),
offn AS (SELECT row_number() OVER (ORDER BY place) AS pos, c1, c2, c3 FROM off),
tn AS (SELECT row_number() OVER (ORDER BY month_end) AS pos, c1, c2, c3 FROM {trend}),
{_long_sql('tn', 'pos', 'tl', 'predicted')}, {_long_sql('offn', 'pos', 'bl', 'official')}
SELECT pos, category, predicted, official FROM tl JOIN bl USING (pos, category)"""


def _article_trend(spark, sf_dir):
    """Article trend under the names of the statistics; it shares no month with them."""
    df = tr.trend(classified(spark, sf_dir), ["theft", "accident", "non_crime"])
    return df.toDF("month_end", *CATS)


@query("align_positional", f"""WITH {_STRICT},
{_gap_filled_sql('dated', 'd', ['theft', 'accident', 'non_crime'], 'month', 'm')},
news AS (SELECT month_end, theft AS c1, accident AS c2, non_crime AS c3 FROM m), {BASELINE_SQL},
{_positional_sql('news')}""")
def align_positional(spark, sf_dir):
    """No common month: the first rows of a statistics file that begins with the newest day."""
    path = work_dir(spark, "newest-first")
    # a file in no order of its dates but the opposite one, read back in the order of its lines
    orders_baseline(spark, sf_dir).orderBy(F.desc("date")).write.csv(path, header=True)
    return co.align_months(_article_trend(spark, sf_dir), read_baseline(spark, path, CATS),
                           "positional", position="row_number")


@query("align_positional_overlap", f"WITH {SHIPMENTS_SQL}, {BASELINE_SQL}, "
       + _positional_sql("trend"))
def align_positional_overlap(spark, sf_dir):
    """Common months exist: statistics are cut to them, then paired by place."""
    return co.align_months(shipments(spark, sf_dir), orders_baseline(spark, sf_dir),
                           "positional")


_R_SQL = ("CASE WHEN count(*) > 1 AND stddev_pop(predicted) > 0 AND stddev_pop(official) > 0 "
          "THEN round(covar_pop(predicted, official) / "
          "(stddev_pop(predicted) * stddev_pop(official)), 6) END")


@query("correlation", f"WITH {PAIRS_SQL}, more AS (SELECT * FROM pairs UNION ALL "
       "SELECT month_end, 'flat' AS category, 1.0 AS predicted, official FROM pairs "
       "WHERE category = 'c1') "
       f"SELECT category, count(*) AS n, {_R_SQL} AS r FROM more GROUP BY 1")
def correlation(spark, sf_dir):
    """Pearson r per category; a constant series has none."""
    pairs = co.align_months(shipments(spark, sf_dir), orders_baseline(spark, sf_dir))
    flat = pairs.where("category = 'c1'").withColumns(
        {"category": F.lit("flat"), "predicted": F.lit(1.0)})
    return co.correlate(pairs.unionByName(flat)).select("category", "n", F.round("r", 6).alias("r"))


# The t distribution by numerical quadrature: p = 1 - 2 * integral of the density
# from 0 to t, substituting t = sqrt(v) tan(u), density cos(u)^(v-1), Simpson's rule.
_QUADRATURE = """steps AS (SELECT i, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4
  ELSE 2 END AS wt FROM range(0, 2001) AS g(i)),
area AS (SELECT category, n, r,
  sum(wt * cos(asin(abs(r)) * i / 2000) ** (n - 3)) * asin(abs(r)) AS part,
  sum(wt * cos(pi() / 2 * i / 2000) ** (n - 3)) * pi() / 2 AS whole
  FROM rs, steps GROUP BY 1, 2, 3)"""


@query("correlation_pvalue", f"""WITH {PAIRS_SQL}, rs AS (
  SELECT category, count(*) AS n, covar_pop(predicted, official) /
    (stddev_pop(predicted) * stddev_pop(official)) AS r FROM pairs GROUP BY 1),
{_QUADRATURE}
SELECT category, round(1 - part / whole, 6) AS p_value, 1 - part / whole < 0.05 AS significant
FROM area""")
def correlation_pvalue(spark, sf_dir):
    pairs = co.align_months(shipments(spark, sf_dir), orders_baseline(spark, sf_dir))
    return co.correlate(pairs).select(
        "category", F.round("p_value", 6).alias("p_value"), "significant")


@query("month_coverage", f"""WITH {SHIPMENTS_SQL}, {BASELINE_SQL},
t AS (SELECT count(*) AS n, min(month_end) AS a, max(month_end) AS b FROM trend),
o AS (SELECT count(*) AS n, min(month_end) AS a, max(month_end) AS b FROM base)
SELECT t.n AS predicted_months, o.n AS official_months,
  strftime(greatest(t.a, o.a), '%Y-%m-%d') AS overlap_start,
  strftime(least(t.b, o.b), '%Y-%m-%d') AS overlap_end,
  date_diff('month', greatest(t.a, o.a), least(t.b, o.b)) + 1 AS overlap_months FROM t, o""")
def month_coverage(spark, sf_dir):
    df = co.month_coverage(shipments(spark, sf_dir), orders_baseline(spark, sf_dir))
    return _text_date(_text_date(df, "overlap_start"), "overlap_end")


# --- split -----------------------------------------------------------------------

_SPLIT_SQL = """placed AS (SELECT *, row_number() OVER (
    ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM articles),
parts AS (SELECT *, CASE WHEN rn <= floor(0.8::DOUBLE * (SELECT count(*) FROM articles))
  THEN 'train' ELSE 'test' END AS part FROM placed)"""


@query("train_test_split", f"WITH {ARTICLES_SQL}, {_SPLIT_SQL} SELECT doc_id, part FROM parts")
def train_test_split(spark, sf_dir):
    return split_exact(articles(spark, sf_dir).select("doc_id"), "doc_id")


@query("split_sizes", f"WITH {LANGS_SQL}, {_SPLIT_SQL}, "
       f"routed AS (SELECT doc_id, {ROUTE_SQL} AS route FROM langs) "
       "SELECT route, part, count(*) AS n FROM parts JOIN routed USING (doc_id) GROUP BY 1, 2")
def sizes(spark, sf_dir):
    """Parts of either route, by the language of the title."""
    return split_sizes(split_exact(route_language(spark, sf_dir), "doc_id"))


# --- states of days, merged ------------------------------------------------------------

FIRST_DAY, LAST_DAY = "2024-03-15", "2025-06-30"


def _appended(spark, purpose, batches):
    """The states of every batch, appended to one table and read back."""
    path = work_dir(spark, purpose)
    for states in batches:
        states.write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("overview_range", f"WITH {CLASSIFIED_SQL} SELECT count(*) AS n_articles, "
       f"count(DISTINCT source) AS n_sources, CAST(sum({' + '.join(TAX6)}) AS BIGINT) AS n_labels "
       f"FROM classified WHERE date BETWEEN '{FIRST_DAY}' AND '{LAST_DAY}'")
def overview_range(spark, sf_dir):
    """Some months' overview from the states of days, which came in two batches."""
    df = classified(spark, sf_dir)
    states = _appended(spark, "day-states", [
        mergeable.overview_states(df.where(F.col("doc_id") % 2 == half), "date", TAX6) for half in (0, 1)])
    return mergeable.overview_of(states, FIRST_DAY, LAST_DAY)


@query("moments_range", """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_x,
  round(avg(user_id), 6) AS mean_y, round(covar_pop(value, user_id), 5) AS covariance,
  round(corr(value, user_id), 6) AS r
FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY event_type""")
def moments_range(spark, sf_dir):
    """Correlation over some days from the co-moments of days, which came in three batches."""
    df = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    states = _appended(spark, "moment-states", [
        mergeable.moment_states(df.where(F.col("event_id") % 3 == part), "day", ["event_type"], "value", "user_id")
        for part in range(3)])
    moments = mergeable.merge_moments(states, ["event_type"], "2024-01-05", "2024-01-20")
    return mergeable.correlation_of(moments).select(
        "event_type", "n", F.round("mean_x", 6).alias("mean_x"), F.round("mean_y", 6).alias("mean_y"),
        F.round(F.col("c_xy") / F.col("n"), 5).alias("covariance"), F.round("r", 6).alias("r"))
