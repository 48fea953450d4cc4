"""Further queries: planning variants, uneven segments, encodings, axes of bags, look-ups, records and attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from serigraph.functions import encoding, symbols
from serigraph.operators import alignment, bags, explain, moving, patterns, ridge, sparse_importance, words
from serigraph.plans.builder import BagBuilder
from serigraph.plans.planner import Config, config_table, grouped, plan
from serigraph.queries import (
    COARSE, EVENTS, GRID, LINE_ITEMS, ONE, QUERIES, SCALES, SHOWN, VECTORS, _BAG, _COVERED, _FEATURES, _IMPORTANCE, _SHOWN, _VOCABULARY, _importance, _shown, _table, events, line_items, query, sql_words, vectors,
)
from serigraph.sources import panel as panels
from serigraph.sources.storage import checkpoint

UNEVEN = Config(10, 2, 4, 3)
KINDS = ("click", "error", "purchase", "signup", "view")


def short_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events by type: many series are too short for a window."""
    signal = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")) - 1
    return panels.long_panel(_table(spark, sf_dir, "events"), F.col("user_id"), F.col("value"), ["ts", "event_id"], signal)


SHORT_EVENTS = f"""select user_id as ts_id, list_position({list(KINDS)}, event_type) - 1 as signal_id, value,
    row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as pos from events"""
TALL = [Config(16, 1, 4), Config(8, 2, 2)]


# --- planning and checks ---------------------------------------------------------------------------------------------


def _lengths(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    row = panels.length_profile(vectors(spark, sf_dir)).first()
    return row["min_length"], row["max_length"]


_STRIDES = {
    "linear": "l", "quadratic": "1",
    "linear_logarithmic": "case when m > w and d < (m - 1) / w - 1 then case when ln(m) >= (room + 1) / m then 1 else ceil(room / (m * ln(m) - 1)) end end",
}


def _planned(complexity: str, slopes: bool = False) -> str:
    """CTEs planned (w, d, l, stride, and a, b with slopes) of a plan, in order by n."""
    more = ", a as (select unnest([2, 3])::int as a), b as (select unnest([0, 1, 2, 3])::int as b)" if slopes else ""
    order, source = ("w, d, l, a, b", "w, d, l, a, b, m where l <= w and w * d <= longest and (l > 1 or b > 1)") if slopes else ("w, d, l", "w, d, l, m where l <= w and w * d <= longest")
    scales = SCALES.replace("range(1, 4)", "range(0, 4)") if slopes else SCALES
    return f"""{scales}{more}, c as (select {order}, shortest::double as m, -w + d * w + shortest::double * w - d * w * w as room from {source}),
        s as (select *, {_STRIDES[complexity]} as stride from c), planned as (select *, (row_number() over (order by {order}) - 1)::int as n from s where stride is not null)"""


_CONFIG = "n as conf_idx, w as window_size, d as dilation, l as word_length, stride::int as stride"


@query(f"with {_planned('linear')} select {_CONFIG}, 3 as alphabet_size from planned")
def plan_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_table(spark, plan(*_lengths(spark, sf_dir), complexity="linear"))


@query(f"with {_planned('linear_logarithmic')} select {_CONFIG}, 3 as alphabet_size from planned")
def plan_logarithmic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_table(spark, plan(*_lengths(spark, sf_dir), complexity="linear_logarithmic"))


def _plan_with_slopes(spark: SparkSession, sf_dir: str, complexity: str) -> list[Config]:
    return plan(*_lengths(spark, sf_dir), alphabets=range(2, 4), slope_alphabets=range(4), complexity=complexity)


@query(f"with {_planned('quadratic', True)} select {_CONFIG}, a as alphabet_size, b as slope_alphabet_size from planned")
def plan_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_table(spark, _plan_with_slopes(spark, sf_dir, "quadratic"), slopes=True)


@query(f"with {_planned('linear', True)} select {_CONFIG}, a as alphabet_size, b as slope_alphabet_size from planned")
def plan_slopes_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_table(spark, _plan_with_slopes(spark, sf_dir, "linear"), slopes=True)


@query(f"with {_planned('linear_logarithmic', True)} select {_CONFIG}, a as alphabet_size, b as slope_alphabet_size from planned")
def plan_slopes_logarithmic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_table(spark, _plan_with_slopes(spark, sf_dir, "linear_logarithmic"), slopes=True)


def _groups(spark: SparkSession, configs: list[Config], *fields: str) -> DataFrame:
    rows = [(*key, len(cs), [c.window_size for c in cs], [c.dilation for c in cs], [c.stride for c in cs]) for key, cs in grouped(configs, *fields).items()]
    return spark.createDataFrame(rows, ", ".join(f"{f} int" for f in fields) + ", n int, window_sizes array<int>, dilations array<int>, strides array<int>")


_LISTS = "count(*)::int as n, list(w order by planned.n) as window_sizes, list(d order by planned.n) as dilations, list(stride::int order by planned.n) as strides"


@query(f"with {_planned('quadratic')} select 3 as alphabet_size, l as word_length, stride::int as stride, {_LISTS} from planned group by l, stride")
def plan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, plan(*_lengths(spark, sf_dir)), "alphabet_size", "word_length", "stride")


@query(f"with {_planned('linear')} select 3 as alphabet_size, l as word_length, {_LISTS} from planned group by l")
def plan_groups_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, plan(*_lengths(spark, sf_dir), complexity="linear"), "alphabet_size", "word_length")


@query(f"with {_planned('linear_logarithmic', True)} select a as alphabet_size, b as slope_alphabet_size, l as word_length, {_LISTS} from planned group by a, b, l")
def plan_groups_of_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, _plan_with_slopes(spark, sf_dir, "linear_logarithmic"), "alphabet_size", "slope_alphabet_size", "word_length")


@query("""with p as (select o_orderkey, (o_orderkey % 13)::int as w, (o_custkey % 12 + 1)::int as l from orders)
    select o_orderkey, w, l, w between 2 and 9 as alphabet, w between 2 and 9 and l between 2 and 9 and w * l <= 9 as alphabets, w % l = 0 as divisible, w < l as shorter, w >= l as segmentable, w = 0 as empty from p""")
def parameter_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the window size and word length that each order's numbers make."""
    w, l = F.col("w"), F.col("l")  # noqa: E741
    pairs = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 13).cast("int").alias("w"), (F.col("o_custkey") % 12 + 1).cast("int").alias("l"))
    return pairs.select(
        "o_orderkey", "w", "l", symbols.valid_alphabet(w).alias("alphabet"), symbols.valid_alphabets(w, l).alias("alphabets"), symbols.divisible(w, l).alias("divisible"), (~symbols.segmentable(w, l)).alias("shorter"),
        symbols.segmentable(w, l).alias("segmentable"), symbols.is_empty(F.array_repeat(F.lit(0), w)).alias("empty"),
    )


@query(f"with p as ({SHORT_EVENTS}), n as (select ts_id, signal_id::int as signal_id, count(*) as length from p group by all) select *, length >= 15 as fits from n")
def eligible_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = short_events(spark, sf_dir).groupBy(*panels.KEYS).agg(F.count("*").alias("length"))
    return lengths.withColumn("fits", symbols.fits(F.col("length"), 8, 2))


# --- moving statistics, segments and scores --------------------------------------------------------------------------


@query(f"""with p as ({EVENTS}), m as (select *, count(*) over f as n, sum(value) over f as total, covar_pop(value, pos::double) over f as cov from p window f as (partition by ts_id order by pos rows between 4 preceding and current row))
    select ts_id, pos, round(case when n = 5 then total end, 6) as sum, round(case when n = 5 then cov end, 6) as cov, [pos, pos + 4, pos + 8] as starts from m""")
def moving_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = events(spark, sf_dir)
    value, w = F.col("value"), moving.signal_window(panel)
    return panel.select(
        "ts_id", "pos", F.round(moving.move_sum(value, w, 5, complete=True), 6).alias("sum"), F.round(moving.move_cov(value, F.col("pos").cast("double"), w, 5), 6).alias("cov"),
        alignment.segment_starts(F.col("pos"), 3, 2, 2).alias("starts"),
    )


@query(f"with p as ({LINE_ITEMS}) select ts_id, signal_id::int as signal_id, sum(value::decimal(18, 6))::double as total from p group by all")
def exact_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moving.exact_sums(line_items(spark, sf_dir), panels.KEYS, "value")


@query(f"""with p as ({EVENTS}), l as (select ts_id, list(value order by pos) as v, count(*) as n from p group by all), c as (select *, unnest(range(0, (n - 19) // 3 + 1)) as win_idx from l where n >= 19),
    x as (select *, v[win_idx * 3 + 1:win_idx * 3 + 19:2] as x from c), b as (select *, [0, 2, 5, 7, 10] as b, list_avg(x) as mu, list_aggregate(x, 'stddev_pop') as sd, list_max(x) = list_min(x) as flat from x)
    select ts_id, win_idx, list_transform(range(0, 4), lambda j: round(case when flat then 0.0 else (list_avg(x[b[j + 1] + 1:b[j + 2]]) - mu) / sd end, 6)) as means from b""")
def paa_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = words.segment_means(events(spark, sf_dir), UNEVEN)
    # SQL's round keeps the sign of what it rounds to 0, Spark's doesn't
    rounded = lambda m: F.when((F.round(m, 6) == 0) & (m < 0), F.lit(-0.0)).otherwise(F.round(m, 6) + 0.0)
    return means.select("ts_id", "win_idx", F.transform("means", rounded).alias("means"))


@query("""with p as (select user_id as ts_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, case when event_id % 3 <> 0 then value end as value from events),
    l as (select ts_id, list(value order by pos) as v, count(*) as n from p group by all), c as (select *, unnest(range(0, (n - 15) // 3 + 1)) as win_idx from l where n >= 15),
    x as (select *, v[win_idx * 3 + 1:win_idx * 3 + 15:2] as x from c), b as (select *, list_avg(x) as mu, list_aggregate(x, 'stddev_pop') as sd, list_max(x) = list_min(x) as flat from x)
    select ts_id, win_idx, list_transform(range(0, 4), lambda j: round(case when list_avg(x[j * 2 + 1:j * 2 + 2]) is null then null when flat then 0.0 else (list_avg(x[j * 2 + 1:j * 2 + 2]) - mu) / sd end, 6) + 0.0) as means from b""")
def paa_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the points is missing and keeps its place."""
    value = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    panel = panels.placed_panel(_table(spark, sf_dir, "events"), F.col("user_id"), value, ["ts", "event_id"])
    means = words.present_means(panel, Config(8, 2, 4, 3))
    return means.select("ts_id", "win_idx", F.transform("means", lambda m: F.round(m, 6) + 0.0).alias("means"))


@query(f"""with p as ({EVENTS}), l as (select ts_id, list(value order by pos) as v, count(*) as n, max(value) = min(value) as constant from p group by all), c as (select *, unnest(range(0, (n - 19) // 3 + 1)) as win_idx from l where n >= 19),
    x as (select *, v[win_idx * 3 + 1:win_idx * 3 + 19:2] as x from c), b as (select *, [0, 2, 5, 7, 10] as b, {symbols.breakpoints(3)}::double[] as bins, list_avg(x) as mu, list_aggregate(x, 'stddev_pop') as sd, list_max(x) = list_min(x) as flat from x),
    z as (select *, list_transform(range(0, 4), lambda j: case when flat then 0.0 else (list_avg(x[b[j + 1] + 1:b[j + 2]]) - mu) / sd end) as z from b)
    select ts_id, win_idx, case when constant then 0 else list_sum(list_transform(range(0, 4), lambda j: len(list_filter(bins, lambda t: t <= z[j + 1])) * (3 ** (3 - j))::bigint)) end::bigint as word from z""")
def uneven_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of windows that are no multiple of the word length."""
    return words.classic_words(events(spark, sf_dir), UNEVEN).select("ts_id", "win_idx", "word")


@query(f"""with p as ({SHORT_EVENTS}), n as (select *, count(*) over (partition by ts_id, signal_id) as n from p), b as (select *, unnest(range(0, 5)) as j from n where n >= 5)
    select ts_id, signal_id::int as signal_id, j::int as j, round(avg(value), 6) as mean from b where pos >= j * n // 5 and pos < (j + 1) * n // 5 group by all""")
def paa_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.whole_means(short_events(spark, sf_dir), 5).withColumn("mean", F.round("mean", 6))


@query(f"""with p as ({EVENTS}), s as (select *, avg(value) over w as mu, stddev_pop(value) over w as sd, max(value) over w = min(value) over w as flat from p window w as (partition by ts_id))
    select ts_id, pos, round(case when flat then 0.0 else (value - mu) / sd end, 6) as z, round(value, 6) as back from s""")
def standard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = patterns.standardised(events(spark, sf_dir))
    stats = panel.groupBy(*panels.KEYS).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return panel.join(stats, panels.KEYS).select("ts_id", "pos", F.round("z", 6).alias("z"), F.round(symbols.unscored(F.col("z"), F.col("mean"), F.col("std")), 6).alias("back"))


# --- the stable form: a constant signal has the symbol of score 0 ----------------------------------------------------

STEADY = "select ts_id, signal_id, pos, case when ts_id % 3 = 0 then 7.0 else value end as value from ({}) p"


def _steady(panel: DataFrame) -> DataFrame:
    return panel.withColumn("value", F.when(F.col("ts_id") % 3 == 0, F.lit(7.0)).otherwise(F.col("value")))


def _middle(sql: str) -> str:
    return sql.replace("case when constant then 0 else", "case when false then 0 else")


@query(f"with {_middle(sql_words(STEADY.format(EVENTS), [ONE, COARSE]))}, {_BAG} select ts_id, signal_id::int as signal_id, conf_idx, word, cnt from bag")
def stable_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.bag(_steady(events(spark, sf_dir)), [ONE, COARSE], constant_is_middle=True)


@query(f"with {_middle(sql_words(STEADY.format(EVENTS), [ONE]))} select ts_id, signal_id::int as signal_id, word, count(*) as cnt from windows group by all")
def stable_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.counted(words.words(_steady(events(spark, sf_dir)), ONE, constant_is_middle=True))


@query(f"""with {_middle(sql_words(STEADY.format(EVENTS), [ONE, COARSE], 0.3))}, bag as (select ts_id, signal_id, conf_idx, word, count(*) as cnt from windows group by all having count(*) > 1), {_VOCABULARY}, {_FEATURES}
    select ts_id, feature_idx, cnt, cnt * case conf_idx when 1 then 0.5 else 1.0 end::double as weight from features join vocabulary using (feature_idx)""")
def stable_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _steady(events(spark, sf_dir))
    builder = BagBuilder([ONE, COARSE], least_ratio=0.3, weights={1: 0.5}, steps=(lambda bag: bag.where("cnt > 1"),), constant_is_middle=True)
    return builder.fit(panel).transform(panel)


@query(f"with {sql_words(VECTORS, GRID)}, {_BAG}, {_VOCABULARY}, {_FEATURES} select ts_id, feature_idx, cnt from features")
def planned_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = vectors(spark, sf_dir)
    return BagBuilder().fit(panel).transform(panel)


# --- bags: axes, fields, maps, sums of bags, sinks -------------------------------------------------------------------


@query(f"with {sql_words(LINE_ITEMS, [ONE, COARSE])} select ts_id, conf_idx, word, count(*) as cnt from windows group by all")
def bag_over_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.summed_over(bags.bag(line_items(spark, sf_dir), [ONE, COARSE]), "signal_id")


@query(f"with {sql_words(LINE_ITEMS, [ONE, COARSE])} select ts_id, signal_id::int as signal_id, conf_idx, count(*) as cnt from windows group by all")
def bag_over_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.summed_over(bags.bag(line_items(spark, sf_dir), [ONE, COARSE]), "word")


@query(f"""with {sql_words(LINE_ITEMS, [ONE, COARSE])} select ts_id, signal_id::int as signal_id, w::int as window_size, l::int as word_length, a::int as alphabet_size, d::int as dilation, s::int as stride, word, count(*) as cnt
    from windows join config using (conf_idx) group by all""")
def bag_of_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.described(bags.bag(line_items(spark, sf_dir), [ONE, COARSE]), [ONE, COARSE])


@query(f"with {sql_words(LINE_ITEMS, [ONE, COARSE])} select ts_id, signal_id::int as signal_id, conf_idx, word, (count(*) * max(2 - conf_idx))::bigint as cnt from windows group by all")
def merged_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = line_items(spark, sf_dir)
    return bags.merged([bags.bag(panel, [ONE, COARSE]), bags.bag(panel, [ONE])])


@query(f"with {sql_words(EVENTS, [ONE])} select ts_id, word, count(*) as cnt from windows group by all")
def bag_from_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    bag = bags.bag(events(spark, sf_dir), [ONE])
    maps = bag.groupBy("ts_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "cnt"))).alias("counts"))
    return bags.from_maps(maps, F.col("counts"), "ts_id")


_TALL = f"with {sql_words(SHORT_EVENTS, TALL)}, {_BAG}, {_VOCABULARY}, {_FEATURES}, series as (select distinct ts_id from panel)"


def _tall(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    panel = short_events(spark, sf_dir)
    bag = checkpoint(bags.bag(panel, TALL))
    known = checkpoint(bags.vocabulary(bag))
    return panel, known, bags.features(bag, known)


@query(f"""{_TALL}, totals as (select ts_id, signal_id, conf_idx, word, cnt from bag) select ts_id, coalesce(list(feature_idx order by feature_idx) filter (feature_idx is not null), []) as indices,
    coalesce(list(cnt::double order by feature_idx) filter (feature_idx is not null), []) as values from series left join features using (ts_id) group by ts_id""")
def sparse_features_of_every_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, known, features = _tall(spark, sf_dir)
    return bags.sparse_rows(features, known.count(), panel).drop("size")


@query(f"""{_TALL} select s.ts_id, list(coalesce(f.cnt, 0)::double order by v.feature_idx) as values from (select ts_id, feature_idx from series, vocabulary) v join series s using (ts_id)
    left join features f on f.ts_id = s.ts_id and f.feature_idx = v.feature_idx group by s.ts_id""")
def dense_features_of_every_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, known, features = _tall(spark, sf_dir)
    return bags.dense_rows(features, known.count(), panel)


@query(f"{_TALL} select ts_id, feature_idx, cnt from features")
def features_from_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, known, features = _tall(spark, sf_dir)
    return bags.from_sparse(bags.sparse_rows(features, known.count(), panel))


@query(f"with {sql_words(LINE_ITEMS, [ONE, COARSE])} select distinct ts_id, conf_idx, signal_id::bigint as signal_id, word from windows")
def unflattened_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = bags.flattened(bags.bag(line_items(spark, sf_dir), [ONE, COARSE]), [ONE, COARSE])
    width = F.when(F.col("conf_idx") == 0, F.lit(ONE.n_words)).otherwise(F.lit(COARSE.n_words)).cast("long")
    signal, word = encoding.unflattened(F.col("flat_idx"), width)
    return flat.select("ts_id", "conf_idx", signal.alias("signal_id"), word.alias("word"))


@query(f"{_TALL} select ts_id, feature_idx, cnt::double as value from features")
def features_from_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as ML vectors and back."""
    panel, known, features = _tall(spark, sf_dir)
    return bags.from_vectors(bags.sparse_vectors(bags.sparse_rows(features, known.count(), panel)))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as series, each with a shape at a place of its own that tells its class, vec_id % 3: a rise, a fall or a peak."""
    k, at = F.col("ts_id") % 3, 8 + F.col("ts_id") % 24
    i = F.col("pos") - at
    shape = F.when(k == 0, i).when(k == 1, 31 - i).otherwise(F.least(i, 31 - i) * 2)
    return vectors(spark, sf_dir).withColumn("value", F.when((i >= 0) & (i < 32), shape.cast("double")).otherwise(F.col("value")))


def _planted_model(spark: SparkSession, sf_dir: str) -> tuple[ridge.RidgeModel, DataFrame]:
    """A ridge model of four in five series, and the features of the rest."""
    panel = planted(spark, sf_dir)
    model = BagBuilder(SHOWN).fit(panel.where("ts_id % 5 <> 0"))
    rows = bags.sparse_rows(model.transform(panel), model.width, panel).withColumn("values", F.transform("values", F.asinh)).withColumn("label", (F.col("ts_id") % 3).cast("int"))
    return ridge.fit(rows.where("ts_id % 5 <> 0"), model.width), rows.where("ts_id % 5 = 0")


@query("select vec_id as ts_id, (vec_id % 3)::int as prediction from embeddings where vec_id % 5 = 0")
def ridge_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of series that the model has not seen; the SQL has the class planted."""
    model, unseen = _planted_model(spark, sf_dir)
    return model.transform(unseen)


def classifier_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how many series are held out, and the share of them whose planted class the ridge model predicts."""
    model, unseen = _planted_model(spark, sf_dir)
    found = model.transform(unseen)
    return found.agg(F.count("*").alias("held_out"), F.avg((F.col("prediction") == F.col("ts_id") % 3).cast("int")).alias("accuracy"))


QUERIES["classifier_accuracy"] = classifier_accuracy  # learning is beyond SQL


# --- encodings -------------------------------------------------------------------------------------------------------

_PAIR = "[[0, 4, 3], [1, 5, 7], [2, 6, 8]]"


@query(f"""{_SHOWN}, s as (select feature_idx, word, signal_id, l, a, list_transform(range(0, l), lambda i: ((word // (a ** (l - 1 - i))::bigint) % a)::int) as x from vocabulary join config using (conf_idx))
    select feature_idx, list_sum(list_transform(range(0, l), lambda i: ({_PAIR})[x[i + 1] + 1][x[l - i] + 1] * (10 ** (l - 1 - i))::bigint))::bigint as pairs, list_aggregate(list_transform(x, lambda v: chr(v + 97)), 'string_agg', '') as letters,
        (70000 + list_sum(list_transform(range(0, l), lambda i: x[i + 1] * (10 ** (l - 1 - i))::bigint)))::bigint as prepended, word // 9 as row, word % 9 as col, word // 27 as r3, (word // 3) % 9 as c3, word % 3 as d3, (a ** l)::bigint - 1 as greatest,
        [(x[1] + x[2]) // 2, (x[3] + x[4]) // 2]::int[] as halves, word as digits from s""")
def more_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = explain.receptive_fields(_shown(spark, sf_dir)[2], SHOWN)
    x, word = F.col("symbols"), F.col("word")
    row, column = encoding.unflattened(word, 9)
    r3, c3, d3 = encoding.unflattened(word, 9, 3)
    decimal = encoding.decimal_of(x)
    return fields.select(
        "feature_idx", encoding.pairs_decimal(x, F.reverse(x)).alias("pairs"), encoding.letters_of(F.transform(x, lambda s: s + 97)).alias("letters"), encoding.prepended(decimal, F.lit(7), F.col("word_length")).alias("prepended"),
        row.alias("row"), column.alias("col"), r3.alias("r3"), c3.alias("c3"), d3.alias("d3"), encoding.greatest_word(F.col("alphabet_size"), F.col("word_length")).alias("greatest"), encoding.halved_word(x).alias("halves"),
        encoding.digits_rebased(decimal, 10, 3).alias("digits"),
    )


@query("""with n as (select event_id, (event_id * 46116860184273 + event_id) % 4611686018427387904 as word from events)
    select event_id, word, list_transform(range(0, 31), lambda i: ((word >> (2 * (30 - i))::int) % 4)::int) as symbols, word // 1000003 as row, word % 1000003 as col from n""")
def long_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and indices beyond 2**53, that doubles do not hold, one made of each event's number."""
    word = (F.col("event_id").cast("decimal(19,0)") * F.lit(46116860184274).cast("decimal(14,0)") % F.lit(1 << 62).cast("decimal(19,0)")).cast("long")  # the product passes a long
    row, column = encoding.unflattened(F.col("word"), 1_000_003)
    return _table(spark, sf_dir, "events").select("event_id", word.alias("word")).select("event_id", "word", encoding.symbols_of(F.col("word"), 4, 31).alias("symbols"), row.alias("row"), column.alias("col"))


@query("""select event_id, case event_id % 6 when 0 then 1 when 1 then 0 when 2 then 1 when 3 then -1 when 4 then 2
    else (value - 50 >= -0.4307273521948292)::int + (value - 50 >= 0.4307273521948291)::int end as symbol from events""")
def symbols_of_odd_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' values less 50 as scores, many replaced by such as lie on a breakpoint, are infinite or are NaN."""
    odd = F.array(*map(F.lit, (0.0, -9.0, -0.4307273521948292, float("nan"), float("inf"))), F.col("value") - 50)
    scores = F.get(odd, (F.col("event_id") % 6).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", symbols.symbol(scores, 3).alias("symbol"))


@query(f"{_SHOWN} select feature_idx, list_transform(range(0, w), lambda k: (k * d)::int) as plot_pos, w * d as width from vocabulary join config using (conf_idx)")
def receptive_field_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the points of each receptive field are drawn."""
    fields = explain.receptive_fields(_shown(spark, sf_dir)[2], SHOWN)
    return fields.select("feature_idx", "plot_pos", (F.col("window_size") * F.col("dilation")).alias("width"))


# --- look-ups and positions ------------------------------------------------------------------------------------------

_ASKED = [(0, 0, 0, 5), (1, 1, 0, 40), (2, 0, 0, 999), (3, 0, 0, 13), (4, 0, 0, 5)]


@query(f"""{_SHOWN}, asked(query_idx, conf_idx, signal_id, word) as (values {", ".join(f"({a}, {b}, {c}, {d}::bigint)" for a, b, c, d in _ASKED)})
    select query_idx, conf_idx, signal_id, word, ts_id, win_idx from asked left join windows using (conf_idx, signal_id, word)""")
def word_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(_ASKED, "query_idx int, conf_idx int, signal_id int, word long")
    return alignment.lookup(_shown(spark, sf_dir)[1], asked)


@query(f"""{_SHOWN} select ts_id, conf_idx, win_idx, list_transform(range(0, w // l), lambda k: win_idx * s + 2 * (w // l) * d + k * d) as third,
    list_transform(range(0, l), lambda j: list_transform(range(0, w // l), lambda k: win_idx * s + j * (w // l) * d + k * d)) as segments from windows join config using (conf_idx) where conf_idx = 1""")
def window_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = _shown(spark, sf_dir)[1].where("conf_idx = 1")
    at, config = F.col("win_idx"), SHOWN[1]
    return windows.select("ts_id", "conf_idx", "win_idx", alignment.segment_positions(at, 2, config).alias("third"), alignment.window_positions(at, config).alias("segments"))


# --- records, classes, ranks and attribution -------------------------------------------------------------------------


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ts_id"), F.col("label").alias("y_true"), ((F.col("label") + F.col("vec_id") % 2) % 10).cast("int").alias("y_pred"))


_LABELS = "labelled as (select vec_id as ts_id, label as y_true, ((label + vec_id % 2) % 10)::int as y_pred from embeddings)"


@query(f"""{_SHOWN}, {_COVERED}, {_LABELS} select ts_id, feature_idx, conf_idx, win_idx, k::int as k, pos, pos as raw_pos, value, cnt, y_true, y_pred
    from covered join panel using (ts_id, signal_id, pos) join features using (ts_id, feature_idx) join labelled using (ts_id)""")
def receptive_field_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, windows, known, features = _shown(spark, sf_dir)
    points = alignment.with_values(alignment.covered(alignment.occurrences(windows, known), SHOWN), panel)
    return explain.records(points, features, _labels(spark, sf_dir)).drop("signal_id")


@query(f"""{_SHOWN}, {_LABELS}, classes as (select unnest(range(0, 10)) as class_id) select ts_id, feature_idx, ((ts_id * 31 + feature_idx * 17 + class_id * 7) % 101 - 50)::double as f
    from labelled join classes on class_id = y_pred, vocabulary""")
def importance_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _importance(spark, sf_dir, _shown(spark, sf_dir)[2].count()).drop("f").withColumn("class_id", F.explode(F.sequence(F.lit(0), F.lit(9))))
    importance = rows.withColumn("f", ((F.col("ts_id") * 31 + F.col("feature_idx") * 17 + F.col("class_id") * 7) % 101 - 50).cast("double"))
    return explain.toward_prediction(importance, _labels(spark, sf_dir))


@query(f"{_SHOWN}, {_IMPORTANCE}, {_LABELS} select ts_id, feature_idx, case when y_pred % 2 = 0 then -f else f end as f from importance join labelled using (ts_id)")
def importance_of_two_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    importance = _importance(spark, sf_dir, _shown(spark, sf_dir)[2].count())
    return explain.toward_prediction(importance, _labels(spark, sf_dir).withColumn("y_pred", F.col("y_pred") % 2), binary=True)


_LACKING = "lacking as (select i.*, w from importance i join vocabulary using (feature_idx) join config using (conf_idx) where not exists (from features x where x.ts_id = i.ts_id and x.feature_idx = i.feature_idx)), normed as (select ts_id, feature_idx, f, f * sum(f) over (partition by ts_id) / nullif(sum(f * w) over (partition by ts_id), 0) as fn from lacking)"


@query(f"{_SHOWN}, {_IMPORTANCE}, {_LACKING} select ts_id, signal_id::int as signal_id, (row_number() over (partition by ts_id, signal_id order by abs(fn) desc nulls last, feature_idx))::int as place, feature_idx from normed join vocabulary using (feature_idx)")
def absent_by_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, known, features = _shown(spark, sf_dir)
    return explain.by_signal(explain.not_contained(_importance(spark, sf_dir, known.count()), features, known, SHOWN), known, F.col("fn"))


@query(f"{_SHOWN}, {_IMPORTANCE}, {_LACKING} select ts_id, signal_id::int as signal_id, (row_number() over (partition by ts_id, signal_id order by abs(fn) desc nulls last, feature_idx))::int as place, feature_idx from importance left join normed using (ts_id, feature_idx) join vocabulary using (feature_idx)")
def all_by_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, known, features = _shown(spark, sf_dir)
    importance = _importance(spark, sf_dir, known.count())
    normed = explain.not_contained(importance, features, known, SHOWN).select("ts_id", "feature_idx", "fn")
    return explain.by_signal(importance.join(normed, ["ts_id", "feature_idx"], "left"), known, F.col("fn"))


@query(f"""{_SHOWN}, {_COVERED}, {_IMPORTANCE}, n as (select distinct ts_id, pos, feature_idx from covered), raw as (select ts_id, pos, sum(f) as s from n join importance using (ts_id, feature_idx) group by all), whole as (select ts_id, sum(f) as whole from importance group by ts_id)
    select ts_id, pos, case when whole = 0 or raw.s is null then 0.0 else raw.s end as s from panel left join raw using (ts_id, pos) left join whole using (ts_id)""")
def plain_saliency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word once for a point, sums as they are."""
    panel, windows, known, _ = _shown(spark, sf_dir)
    return explain.saliency(panel, alignment.occurrences(windows, known), _importance(spark, sf_dir, known.count()), SHOWN, False, False).select("ts_id", "pos", "s")


@query(f"{_SHOWN}, {_IMPORTANCE} select feature_idx, conf_idx, signal_id::int as signal_id, word, sum(abs(f)) as feature_importance from vocabulary join importance using (feature_idx) where ts_id in (1, 2, 3) group by all")
def mapping_importance_of_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the series asked for: the feature of the operator, not a cut of the data."""
    known = _shown(spark, sf_dir)[2]
    return explain.mapping_importance(known, _importance(spark, sf_dir, known.count()), [1, 2, 3])


@query(f"""{_SHOWN}, means as (select feature_idx, sum(cnt) / (select count(*) from embeddings) as mean from features group by all)
    select e.vec_id as ts_id, m.feature_idx, round((m.feature_idx % 7 - 3) * (coalesce(cnt, 0) - mean), 6) + 0.0 as f from embeddings e cross join means m left join features x on x.ts_id = e.vec_id and x.feature_idx = m.feature_idx""")
def linear_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, _, known, features = _shown(spark, sf_dir)
    coefficients = known.select("feature_idx", (F.col("feature_idx") % 7 - 3).cast("double").alias("coefficient"))
    found = explain.linear_attribution(features, coefficients, panel)
    return found.withColumn("f", F.round("f", 6) + 0.0)


_ATTRIBUTED = """means as (select feature_idx, sum(cnt) / (select count(*) from embeddings) as mean from features group by all),
    attributed as (select e.vec_id as ts_id, m.feature_idx, (m.feature_idx % 7 - 3)::double * (coalesce(cnt, 0) - mean) as f, cnt from embeddings e cross join means m left join features x on x.ts_id = e.vec_id and x.feature_idx = m.feature_idx)"""


def _attributed(spark: SparkSession, sf_dir: str) -> tuple[sparse_importance.SparseImportance, DataFrame]:
    """A linear attribution by cells, and the vocabulary."""
    panel, _, known, features = _shown(spark, sf_dir)
    coefficients = known.select("feature_idx", (F.col("feature_idx") % 7 - 3).cast("double").alias("coefficient"))
    return sparse_importance.linear(features, coefficients, panel), known


@query(f"""{_SHOWN}, {_ATTRIBUTED}, ranked as (select *, rank() over (partition by ts_id order by abs(f) desc) + (count(*) over (partition by ts_id, abs(f)) - 1) / 2 as avg_rank from attributed)
    select feature_idx, round(sum(abs(f)), 6) as f_sum, round(avg(avg_rank), 6) as mean_rank from ranked group by feature_idx""")
def attribution_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks over all series and features from the cells of counts alone."""
    found = _attributed(spark, sf_dir)[0].global_importance()
    return found.select("feature_idx", F.round("f_sum", 6).alias("f_sum"), F.round("mean_rank", 6).alias("mean_rank"))


@query(f"{_SHOWN}, {_ATTRIBUTED} select ts_id, round(sum(f), 6) + 0.0 as total from attributed group by ts_id")
def attribution_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(spark, sf_dir)[0].totals().select("ts_id", (F.round("total", 6) + 0.0).alias("total"))


@query(f"""{_SHOWN}, {_ATTRIBUTED} select ts_id, round(sum(f), 6) + 0.0 as absent, round(sum(f * w), 6) + 0.0 as weighted from attributed join vocabulary using (feature_idx) join config using (conf_idx) where cnt is null group by ts_id""")
def attribution_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two sums that the importance of absent features is scaled by in each series."""
    importance, known = _attributed(spark, sf_dir)
    return importance.absent_scales(known, SHOWN).select("ts_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("absent", "weighted")])


@query(f"""{_SHOWN}, {_IMPORTANCE}, ranked as (select *, rank() over (partition by ts_id order by abs(f) desc) + (count(*) over (partition by ts_id, abs(f)) - 1) / 2 as avg_rank from importance)
    select feature_idx, sum(abs(f)) as f_sum, avg(avg_rank) as mean_rank from ranked group by feature_idx order by mean_rank, feature_idx limit 10""")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.top_features(_importance(spark, sf_dir, _shown(spark, sf_dir)[2].count()), 10)


@query(f"""{_SHOWN}, {_COVERED}, pts as (select feature_idx, ts_id, signal_id, win_idx, k, value from covered join panel using (ts_id, signal_id, pos)), n as (select *, avg(value) over w as mu, stddev_pop(value) over w as sd from pts window w as (partition by feature_idx, ts_id, signal_id, win_idx))
    select feature_idx, ts_id, win_idx, k::int as k, round((value - mu) / (sd + 1e-6), 5) as z from n""")
def normalised_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, windows, known, _ = _shown(spark, sf_dir)
    points = alignment.with_values(alignment.covered(alignment.occurrences(windows, known), SHOWN), panel)
    return patterns.normalised(points).select("feature_idx", "ts_id", "win_idx", "k", F.round("z", 5).alias("z"))


@query(f"""{_SHOWN}, s as (select feature_idx, w // l as r, list_transform(range(0, l), lambda i: ((word // (a ** (l - 1 - i))::bigint) % a)::double) as x from vocabulary join config using (conf_idx)), m as (select *, list_avg(x) as mu, list_aggregate(x, 'stddev_pop') as sd from s)
    select feature_idx, list_transform(range(0, len(x) * r), lambda i: round(case when sd = 0 then 0.0 else (x[i // r + 1] - mu) / sd end, 6)) as curve from m""")
def word_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = patterns.word_curve(explain.receptive_fields(_shown(spark, sf_dir)[2], SHOWN))
    return curves.select("feature_idx", F.transform("curve", lambda v: F.round(v, 6) + 0.0).alias("curve"))
