"""Derived readings over *displayed* chart rows.

Inputs are the top-k category rows (≤ 8) and trend rows (≤ 24), so every
window here runs over a bounded frame.  Outputs are registry rows with the
operation and source columns of each derived number, and facts: what holds of
which subject, with its numbers and the registry keys that prove them.
Insights are the facts put into words by a join with their templates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.functions import vocab as V
from proofsheet.operators.metrics import RESULTS_SCHEMA, exact_sum, registry_round, sum_parts

FACTS_SCHEMA = ("section int, ordinal int, verb string, subject string, object string, measure string, "
                "numbers array<double>, refs array<string>")

#: Title and text of a fact; {s} subject, {o} object, {m} measure, {0}… its numbers.  Names stand in «…», so that
#: their digits are not taken for claims.
TEMPLATES = (
    ("rows", "Scope of the analysis", "The analysis covers {0} records."),
    ("score", "Quality of the data", "Completeness, repetition and types give a quality score of {0}."),
    ("missing", "Missing values", "{0} cells are missing."),
    ("duplicates", "Duplicate records", "{0} rows are repeated."),
    ("completeness", "Complete share", "{0}% of the cells are filled."),
    ("invalid", "Invalid values", "{0} values are invalid for their column."),
    ("outliers", "Outlier values", "{0} outliers were found among the measures."),
    ("leads", "Category leader", "«{s}» leads in «{m}» with {0}."),
    ("follows", "Category runner-up", "«{s}» is second in «{m}» with {0}."),
    ("lead margin", "Margin of the category leader", "«{s}» is ahead of «{o}» in «{m}» by {0}."),
    ("trails", "Lowest category shown", "«{s}» is last of the categories shown in «{m}» with {0}."),
    ("gap", "Gap between categories", "Between «{s}» and «{o}» lies {0} of «{m}»."),
    ("share", "Share of the first category", "«{s}» has {0}% of «{m}» among the categories shown."),
    ("second highest", "Highest category of the second measure", "«{s}» is highest in «{m}» with {0}."),
    ("second lowest", "Lowest category of the second measure", "«{s}» is lowest in «{m}» with {0}."),
    ("peak", "Peak period", "«{s}» has the highest «{m}»: {0}."),
    ("weakest", "Lowest period", "«{s}» has the lowest «{m}»: {0}."),
    ("change", "Change over the periods", "«{m}» changed by {0} from «{s}» to «{o}»."),
    ("average", "Trend average", "The mean of «{m}» over the periods shown is {0}."),
    ("change rate", "Rate of change", "«{m}» changed by {0}% from «{s}» to «{o}»."),
    ("above average", "Trend periods above average", "{0} periods are above the mean of «{m}»."),
    ("distance from peak", "Distance from the peak", "The last period «{s}» is {0} below the peak of «{m}» in «{o}»."),
    ("extent", "Extent of values", "«{m}» lies between {0} and {2}, {1} on average."),
    ("spread", "Spread of values", "The highest and the lowest «{m}» differ by {0}."),
    ("relative spread", "Spread against the average", "The spread of «{m}» is {0}% of its average."),
    ("kpi", "Indicator: {s}", "«{s}» is {0} within the data analysed."),
    ("point", "{o}: {s} — {m}", "«{s}» has {0} of «{m}»."),
    ("registered", "Verified result {s}", "The verified operation «{o}» gave {0}."),
)

#: Sections of facts in the order in which they become insights.
SCOPE, CATEGORY, TREND, RANGE, KPI, POINT, REGISTERED = range(7)


def _rows(one: DataFrame, entries: list[tuple[str, str, str, list[str], str]]) -> DataFrame:
    structs = [F.struct(F.lit(key).alias("key"), registry_round(F.col(c).cast("double")).alias("value"),
                        F.lit(op).alias("operation"), F.array(*[F.lit(s) for s in src]).cast("array<string>").alias("source_columns"),
                        F.lit(q).alias("query"))
               for c, key, op, src, q in entries]
    return one.select(F.explode(F.array(*structs)).alias("r")).select("r.*").where(F.col("value").isNotNull())


def category_readings(top: DataFrame, dimension: str, measure: str) -> DataFrame:
    """Registry rows of the lead margin, the gap and the top share over
    the displayed categories."""
    v = F.coalesce(F.col("value_0"), F.lit(0.0))
    aggs = [
        F.min_by(v, F.col("rank")).alias("top_value"),
        F.max(F.when(F.col("rank") == 1, v)).alias("second_value"),
        F.max_by(v, F.col("rank")).alias("bottom_value"),
        exact_sum(v).alias("total"),
        F.count(F.lit(1)).alias("n"),
    ]
    one = top.agg(*aggs).select(
        "*",
        F.when(F.col("n") > 1, F.col("top_value") - F.col("second_value")).alias("lead_margin"),
        F.when(F.col("n") > 1, F.col("top_value") - F.col("bottom_value")).alias("gap"),
        F.when((F.col("total") > 0) & (F.col("top_value") >= 0), F.col("top_value") / F.col("total") * 100).alias("top_share"),
    )
    src = [dimension, measure]
    return _rows(one, [
        ("lead_margin", "category.primary.lead_margin", "leader_runner_up_gap", src, "leader - runner-up"),
        ("gap", "category.primary.gap", "top_bottom_gap", src, "top - bottom"),
        ("top_share", "category.primary.top_share", "top_category_share", src, "top / displayed total * 100"),
    ])


def trend_readings(trend: DataFrame, time_label: str, measure: str) -> DataFrame:
    """W9–W13 + A33 over the displayed periods (ascending ``ordinal``)."""
    v = F.coalesce(F.col("value_0"), F.lit(0.0))
    base = trend.select("ordinal", "period", v.alias("v"))
    avg_w = Window.partitionBy()  # ≤ 24 rows
    part, rest = sum_parts(F.col("v"))
    dsum = F.sum(part).over(avg_w).cast("double") + F.sum(rest).over(avg_w)
    withavg = base.withColumn("avg", dsum / F.count(F.lit(1)).over(avg_w))
    one = withavg.agg(
        F.min_by("v", "ordinal").alias("first"), F.max_by("v", "ordinal").alias("last"),
        F.max("v").alias("peak"), F.max("avg").alias("average"),
        F.count_if(F.col("v") > F.col("avg")).alias("above"),
    ).select(
        "*", (F.col("last") - F.col("first")).alias("change"),
        F.when(F.col("first") != 0, (F.col("last") - F.col("first")) / F.abs(F.col("first")) * 100).alias("change_rate"),
        (F.col("peak") - F.col("last")).alias("distance_from_peak"),
    )
    src = [time_label, measure]
    return _rows(one, [
        ("change", "trend.primary.change", "period_change", src, "last period - first period"),
        ("average", "trend.primary.average", "period_average", src, "mean of displayed periods"),
        ("change_rate", "trend.primary.change_rate", "period_change_rate", src, "(last - first) / abs(first) * 100"),
        ("above", "trend.primary.periods_above_average", "periods_above_average", src, "count(period value > displayed average)"),
        ("distance_from_peak", "trend.primary.distance_from_peak", "last_period_distance_from_peak", src, "peak - last period"),
    ])


def trend_extremes(trend: DataFrame) -> DataFrame:
    """Peak and weakest period (first on ties)."""
    v = F.coalesce(F.col("value_0"), F.lit(0.0))
    return trend.agg(
        F.max_by("period", F.struct(v, -F.col("ordinal"))).alias("peak_period"),
        F.max(v).alias("peak_value"),
        F.min_by("period", F.struct(v, F.col("ordinal"))).alias("low_period"),
        F.min(v).alias("low_value"),
    )


def range_readings(rng: DataFrame, measure: str) -> DataFrame:
    """spread = max − min; relative spread = spread / |avg| · 100."""
    mn, av, mx = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("min_value", "avg_value", "max_value"))
    one = rng.select((mx - mn).alias("spread"),
                     F.when(av != 0, (mx - mn) / F.abs(av) * 100).alias("relative_spread"))
    return _rows(one, [
        ("spread", "distribution.primary.spread", "range_spread", [measure], "maximum - minimum"),
        ("relative_spread", "distribution.primary.relative_spread", "relative_range_spread", [measure], "spread / abs(average) * 100"),
    ])


INSIGHT_GROUPS = (
    ("performance", ("leader", "top", "peak", "change", "trend", "growth", "highest", "lowest")),
    ("segments", ("category", "share", "segment", "gap")),
    ("quality", ("quality", "missing", "duplicate", "invalid", "outlier", "complete")),
)


def insight_group(title):
    """First keyword group whose word appears in the title."""
    from proofsheet.functions.expr import any_of
    low = F.lower(title)
    expr = F.lit("other")
    for name, words in reversed(INSIGHT_GROUPS):
        expr = F.when(any_of([low.contains(w) for w in words]), F.lit(name)).otherwise(expr)
    return expr


def _facts(one: DataFrame, section: int, entries: list[tuple]) -> DataFrame:
    """Facts of a one-row frame; an entry is (verb, subject, object, measure,
    numbers, refs), all Columns but verb and measure.  A fact with a null
    number or subject column named by it does not hold and is left out."""
    def text(c):
        return F.lit(None).cast("string") if c is None else c.cast("string")
    structs = [F.struct(F.lit(section).alias("section"), F.lit(i).alias("ordinal"), F.lit(verb).alias("verb"), text(subject).alias("subject"),
                        text(obj).alias("object"), F.lit(measure).cast("string").alias("measure"),
                        F.array(*[registry_round(n.cast("double")) for n in numbers]).alias("numbers"), F.array(*refs).alias("refs"))
               for i, (verb, subject, obj, measure, numbers, refs) in enumerate(entries)]
    facts = one.select(F.explode(F.array(*structs)).alias("f")).select("f.*")
    return facts.where(~F.exists("numbers", lambda n: n.isNull()))


def _ref(prefix: str, index) -> F.Column:
    return F.concat(F.lit(prefix), index.cast("string"))


def scope_facts(results: DataFrame) -> DataFrame:
    """The readings of size and quality, from the registry."""
    keys = {"rows.total": "rows", "quality.score": "score", "quality.missing": "missing", "quality.duplicates": "duplicates",
            "quality.completeness": "completeness", "quality.invalid": "invalid", "quality.outliers": "outliers"}
    one = results.where(F.col("key").isin(list(keys))).agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(v) for k, v in keys.items()])
    return _facts(one, SCOPE, [(v, None, None, None, [F.col(v)], [F.lit(k)]) for k, v in keys.items()])


def category_facts(top: DataFrame, measures: list[str]) -> DataFrame:
    """W5–W8 over the displayed categories (``category_topk``): leader,
    runner-up and margin, last category and gap, share of the leader, the
    second measure's highest and lowest category (first on ties)."""
    def at(v):
        return F.struct("category", "rank", v.alias("v"))
    v = F.coalesce(F.col("value_0"), F.lit(0.0))
    aggs = [F.min_by(at(v), F.col("rank")).alias("a"), F.max(F.when(F.col("rank") == 1, at(v))).alias("b"),
            F.max_by(at(v), F.col("rank")).alias("z"), exact_sum(v).alias("total")]
    if len(measures) > 1:
        w = F.coalesce(F.col("value_1"), F.lit(0.0))
        aggs += [F.max_by(at(w), F.struct(w, -F.col("rank"))).alias("hi"), F.min_by(at(w), F.struct(w, F.col("rank"))).alias("lo")]
    one = top.agg(*aggs)
    a, b, z = F.col("a.v"), F.col("b.v"), F.col("z.v")
    first, second, last = (_ref("chart.category.0.", F.col(f"{x}.rank")) for x in "abz")
    m = measures[0]
    several = F.col("b").isNotNull()
    entries = [("leads", F.col("a.category"), None, m, [a], [first]),
               ("follows", F.col("b.category"), None, m, [b], [second]),
               ("lead margin", F.col("a.category"), F.col("b.category"), m, [a - b], [F.lit("category.primary.lead_margin"), first, second]),
               ("trails", F.col("z.category"), None, m, [F.when(several, z)], [last]),
               ("gap", F.col("a.category"), F.col("z.category"), m, [F.when(several, a - z)], [F.lit("category.primary.gap"), first, last]),
               ("share", F.col("a.category"), None, m, [F.when((F.col("total") > 0) & (a >= 0), a / F.col("total") * 100)],
                [F.lit("category.primary.top_share"), first])]
    if len(measures) > 1:
        entries += [(f"second {word}", F.col(f"{x}.category"), None, measures[1], [F.col(f"{x}.v")], [_ref("chart.category.1.", F.col(f"{x}.rank"))])
                    for word, x in (("highest", "hi"), ("lowest", "lo"))]
    return _facts(one, CATEGORY, entries)


def trend_facts(trend: DataFrame, measure: str) -> DataFrame:
    """W9–W13, A33 over the displayed periods: peak and weakest period (first
    on ties), change between first and last, mean, periods above it, distance
    of the last from the peak."""
    v = F.coalesce(F.col("value_0"), F.lit(0.0))
    point = F.struct("period", "ordinal", v.alias("v"))
    one = trend.agg(F.min_by(point, "ordinal").alias("a"), F.max_by(point, "ordinal").alias("z"),
                    F.max_by(point, F.struct(v, -F.col("ordinal"))).alias("hi"), F.min_by(point, F.struct(v, F.col("ordinal"))).alias("lo"),
                    (exact_sum(v) / F.count(F.lit(1))).alias("mean"), F.collect_list(v).alias("all"))   # at most TREND_PERIODS values
    first, last, peak, weak = (_ref("chart.trend.0.", F.col(f"{x}.ordinal")) for x in ("a", "z", "hi", "lo"))
    change = F.col("z.v") - F.col("a.v")
    above = F.when(F.col("mean").isNotNull(), F.size(F.filter("all", lambda x: x > F.col("mean"))))
    key = "trend.primary."
    return _facts(one, TREND, [
        ("peak", F.col("hi.period"), None, measure, [F.col("hi.v")], [peak]),
        ("weakest", F.col("lo.period"), None, measure, [F.col("lo.v")], [weak]),
        ("change", F.col("a.period"), F.col("z.period"), measure, [change], [F.lit(key + "change"), first, last]),
        ("average", None, None, measure, [F.col("mean")], [F.lit(key + "average")]),
        ("change rate", F.col("a.period"), F.col("z.period"), measure, [F.when(F.col("a.v") != 0, change / F.abs(F.col("a.v")) * 100)],
         [F.lit(key + "change_rate"), first, last]),
        ("above average", None, None, measure, [above], [F.lit(key + "periods_above_average"), F.lit(key + "average")]),
        ("distance from peak", F.col("z.period"), F.col("hi.period"), measure, [F.col("hi.v") - F.col("z.v")],
         [F.lit(key + "distance_from_peak"), peak, last])])


def range_facts(rng: DataFrame, measure: str) -> DataFrame:
    """Extent, spread and relative spread of a measure."""
    low, mean, high = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("min_value", "avg_value", "max_value"))
    refs = [F.lit(f"dist.{measure}.{x}") for x in ("min", "avg", "max")]
    key = "distribution.primary."
    return _facts(rng, RANGE, [
        ("extent", None, None, measure, [low, mean, high], refs),
        ("spread", None, None, measure, [high - low], [F.lit(key + "spread"), refs[0], refs[2]]),
        ("relative spread", None, None, measure, [F.when(mean != 0, (high - low) / F.abs(mean) * 100)],
         [F.lit(key + "relative_spread"), F.lit(key + "spread"), refs[1]])])


def reading_facts(kpis: DataFrame, points: DataFrame, results: DataFrame) -> DataFrame:
    """What fills the list up: every KPI (``ordinal, label,
    result_ref``), every chart point (``chart_id, ordinal, label, value,
    series, result_ref``), every registry row, in this order."""
    none = F.lit(None).cast("string")
    value = F.array(F.coalesce("value", F.lit(0.0)))
    k = kpis.join(results.select(F.col("key").alias("result_ref"), "value"), "result_ref").select(
        F.lit(KPI).alias("section"), "ordinal", F.lit("kpi").alias("verb"), F.col("label").alias("subject"), none.alias("object"),
        none.alias("measure"), value.alias("numbers"), F.array("result_ref").alias("refs"))
    p = points.select(F.lit(POINT).alias("section"), "ordinal", F.lit("point").alias("verb"), F.col("label").alias("subject"),
                      F.col("chart_id").alias("object"), F.col("series").alias("measure"),
                      F.array(registry_round(F.coalesce("value", F.lit(0.0)))).alias("numbers"), F.array("result_ref").alias("refs"))
    r = results.select(F.lit(REGISTERED).alias("section"), F.lit(0).alias("ordinal"), F.lit("registered").alias("verb"), F.col("key").alias("subject"),
                       F.col("operation").alias("object"), none.alias("measure"), value.alias("numbers"), F.array("key").alias("refs"))
    return k.unionByName(p).unionByName(r)


def number_text(n):
    """A number as the texts show it: at most two decimals."""
    return F.regexp_replace(F.format_string("%.2f", n), r"\.00$", "")


def render(facts: DataFrame) -> DataFrame:
    """Facts with ``title`` and ``text``, by a join with the templates.  The
    numbers are put in first, names last, so that no name is read as a
    placeholder of another."""
    words = facts.sparkSession.createDataFrame(list(TEMPLATES), "verb string, __title string, __text string")
    out = facts.join(F.broadcast(words), "verb")
    def filled(c):
        for i in range(3):
            c = F.replace(c, F.lit("{%d}" % i), F.coalesce(number_text(F.get("numbers", F.lit(i))), F.lit("")))
        # split at the placeholders of names: the text between them stays as it is
        pieces = F.split(c, r"(?=\{[som]\})|(?<=\{[som]\})")
        named = F.transform(pieces, lambda x: F.when(x == "{s}", F.coalesce("subject", F.lit(""))).when(x == "{o}", F.coalesce("object", F.lit("")))
                            .when(x == "{m}", F.coalesce("measure", F.lit(""))).otherwise(x))
        return F.concat_ws("", named)
    return out.select(*facts.columns, filled(F.col("__title")).alias("title"), filled(F.col("__text")).alias("text"))


def complete_insights(facts: DataFrame, limit: int = V.MAX_INSIGHTS) -> DataFrame:
    """The facts in words, in the order of their sections, a title once
    (its first fact), the first ``limit``: ``ordinal, title, text,
    result_refs, group``."""
    order = [F.col("section"), F.col("ordinal"), F.col("object").asc_nulls_first(), F.col("measure").asc_nulls_first(), F.col("subject").asc_nulls_first()]
    once = render(facts).withColumn("__r", F.row_number().over(Window.partitionBy("title").orderBy(*order))).where("__r = 1")
    top = once.orderBy(*order).limit(limit)
    return top.withColumn("__n", F.row_number().over(Window.orderBy(*order)) - 1).select(
        F.col("__n").alias("ordinal"), "title", "text", F.col("refs").alias("result_refs"), insight_group(F.col("title")).alias("group"))


def fallback_answer(question: str, insights: DataFrame, summary: str) -> DataFrame:
    """Q11: without a cached dataset, the first insight sharing a word of
    more than 3 letters with the question, else the summary."""
    words = sorted({w for w in question.lower().split() if len(w) > 3})
    if not words:
        return insights.sparkSession.createDataFrame([(summary,)], "answer string")
    qwords = F.array(*[F.lit(w) for w in words])
    text_words = F.filter(F.split(F.lower(F.concat_ws(" ", "title", "text")), r"\s+"), lambda w: F.length(w) > 3)
    hit = insights.where(F.arrays_overlap(text_words, qwords)).orderBy("ordinal").limit(1) \
        .select(F.concat_ws(": ", "title", "text").alias("answer"))
    fallback = insights.sparkSession.createDataFrame([(summary,)], "answer string")
    return hit.unionByName(fallback).limit(1)
