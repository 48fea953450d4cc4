"""Queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from serigraph.functions import encoding, symbols
from serigraph.operators import alignment, bags, explain, moving, patterns, words
from serigraph.plans.planner import Config, config_table, plan
from serigraph.sources import panel as panels
from serigraph.sources.storage import checkpoint

ONE, COARSE = Config(8, 2, 4), Config(8, 1, 4, 2, 4)
GRID = plan(64, 64)
SHOWN = [Config(8, 1, 4, 4), Config(16, 2, 4, 4)]
GROUPS = [[0, 1], [2], [2, 0]]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Register a query by its name, with SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- panels: users' events, suppliers' line items by return flag, embeddings -----------------------------------------


def events(spark: SparkSession, sf_dir: str, masked: bool = False) -> DataFrame:
    value = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value")) if masked else F.col("value")
    return panels.long_panel(_table(spark, sf_dir, "events"), F.col("user_id"), value, ["ts", "event_id"])


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = F.array_position(F.array(*map(F.lit, "ANR")), F.col("l_returnflag")) - 1
    return panels.long_panel(_table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), F.col("l_quantity"), ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], signal)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.panel_of_arrays(_table(spark, sf_dir, "embeddings"), F.col("vec_id"), F.col("embedding"))


EVENTS = "select user_id as ts_id, 0 as signal_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, value from events"
LINE_ITEMS = """select l_suppkey as ts_id, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as signal_id, l_quantity as value,
    row_number() over (partition by l_suppkey, l_returnflag order by l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 as pos from lineitem"""
VECTORS = "select vec_id as ts_id, 0 as signal_id, unnest(range(len(embedding))) as pos, unnest(embedding)::double as value from embeddings"


def sql_words(panel: str, configs: list[Config], least_ratio: float = 0.0) -> str:
    """CTEs panel, config and windows (ts_id, signal_id, conf_idx, win_idx, word)."""
    rows = ", ".join(f"({i}, {c.window_size}, {c.dilation}, {c.word_length}, {c.stride}, {c.alphabet_size}, {symbols.breakpoints(c.alphabet_size)}::double[])" for i, c in enumerate(configs))
    return f"""
        panel as ({panel}),
        config(conf_idx, w, d, l, s, a, bins) as (values {rows}),
        signals as (select ts_id, signal_id, list(value order by pos) as v, count(*) as n from panel group by ts_id, signal_id),
        cut as (select *, unnest(range(0, (n - (w - 1) * d - 1) // s + 1)) as win_idx from signals join config on (w - 1) * d + 1 <= n),
        points as (select *, list_slice(v, win_idx * s + 1, win_idx * s + (w - 1) * d + 1, d) as x, list_aggregate(v, 'stddev_pop') as g, list_max(v) = list_min(v) as constant from cut),
        stats as (select *, list_avg(x) as mu, list_aggregate(x, 'stddev_pop') as sd, list_max(x) = list_min(x) as flat from points),
        scored as (select *, list_transform(range(0, l), lambda j: case when constant or flat or sd / g < {least_ratio}::double then 0.0
            else (list_avg(x[j * (w // l) + 1:(j + 1) * (w // l)]) - mu) / sd end) as z from stats),
        windows as (select ts_id, signal_id, conf_idx::int as conf_idx, win_idx, case when constant then 0 else
            list_sum(list_transform(range(0, l), lambda j: len(list_filter(bins, lambda b: b <= z[j + 1])) * (a ** (l - 1 - j))::bigint)) end::bigint as word from scored)"""


_BAG = "bag as (select ts_id, signal_id, conf_idx, word, count(*) as cnt from windows group by all)"
_VOCABULARY = "vocabulary as (select row_number() over (order by conf_idx, signal_id, word) - 1 as feature_idx, conf_idx, signal_id, word from (select distinct conf_idx, signal_id, word from bag))"
_FEATURES = "features as (select ts_id, feature_idx, cnt from bag join vocabulary using (conf_idx, signal_id, word))"
_SHOWN = f"with {sql_words(VECTORS, SHOWN)}, {_BAG}, {_VOCABULARY}, {_FEATURES}"
_IMPORTANCE = "importance as (select ts_id, feature_idx, ((ts_id * 31 + feature_idx * 17 + label * 7) % 101 - 50)::double as f from (select vec_id as ts_id, label from embeddings), vocabulary)"
_COVERED = "occ as (select feature_idx, ts_id, signal_id, conf_idx, win_idx from windows join vocabulary using (conf_idx, signal_id, word)), covered as (select *, win_idx * s + k * d as pos from (select occ.*, s, d, unnest(range(0, w)) as k from occ join config using (conf_idx)))"
_POINTS = "pts as (select feature_idx, ts_id, signal_id, win_idx, k, pos, value from covered join panel using (ts_id, signal_id, pos))"


# --- sources ---------------------------------------------------------------------------------------------------------


@query("""select ts_id, signal_id::int as signal_id, raw_pos, row_number() over (partition by ts_id order by raw_pos) - 1 as pos, value from (
    select user_id as ts_id, 0 as signal_id, row_number() over (partition by user_id order by ts, event_id) - 1 as raw_pos, event_id, value from events) where event_id % 11 <> 0""")
def panel_without_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, masked=True)


@query(f"""with p as ({LINE_ITEMS}), l as (select ts_id, signal_id, count(*) as n from p group by all)
    select count(*) as n_signals, min(n) as min_length, max(n) as max_length, (max(signal_id) + 1)::int as signals_per_series from l""")
def length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.length_profile(line_items(spark, sf_dir))


@query(f"with p as ({EVENTS}) select ts_id, signal_id::int as signal_id, (pos % 3)::int as residue, pos // 3 as pos, pos as raw_pos, value from p")
def dilated_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.dilated(events(spark, sf_dir), 3).select(*panels.KEYS, "residue", "pos", "raw_pos", "value")


@query(f"with p as ({EVENTS}) select ts_id, signal_id::int as signal_id, list(value order by pos) as values from p group by all")
def array_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.array_panel(events(spark, sf_dir))


# --- planning --------------------------------------------------------------------------------------------------------


#: Window sizes, dilations and word lengths of a plan, from the lengths of the series.
SCALES = """m as (select min(len(embedding)) as shortest, max(len(embedding)) as longest from embeddings),
    w as (select (2 ** i)::int as w from range(2, 31) t(i), m where 2 ** i <= longest), d as (select (2 ** i)::int as d from range(0, 31) t(i), m where 2 ** i <= log2(longest)),
    l as (select (2 ** i)::int as l from range(1, 4) t(i))"""


@query(f"""with {SCALES}
    select (row_number() over (order by w, d, l) - 1)::int as conf_idx, w as window_size, d as dilation, l as word_length, 1 as stride, 3 as alphabet_size
    from w, d, l, m where l <= w and w * d <= longest""")
def planned_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = panels.length_profile(vectors(spark, sf_dir)).first()
    return config_table(spark, plan(lengths["min_length"], lengths["max_length"]))


# --- moving statistics and segment means -----------------------------------------------------------------------------


@query(f"""with p as ({EVENTS}), m as (select *, count(*) over f as n, avg(value) over f as mean, sum(value) over f as total, var_pop(value) over f as vp, first_value(value) over f as head,
        covar_pop(value, pos::double) over f as cov, var_pop(pos::double) over f as vx from p window f as (partition by ts_id order by pos rows between 4 preceding and current row))
    select ts_id, pos, round(case when n = 5 then value - head end, 6) as diff, round(mean, 6) as mean, round(total, 6) as sum, round(case when n = 5 then vp * 5 / 4 end, 6) as var,
        round(case when n = 5 then sqrt(vp * 5 / 4) end, 6) as std, round(case when n = 5 then cov / vx end, 6) as slope from m""")
def moving_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = moving.moving_statistics(events(spark, sf_dir), 5, ddof=1)
    return out.select("ts_id", "pos", *[F.round(c, 6).alias(c) for c in ("diff", "mean", "sum", "var", "std", "slope")])


@query(f"""with p as ({EVENTS}), l as (select ts_id, list(value order by pos) as v, count(*) as n from p group by all), c as (select *, unnest(range(0, (n - 15) // 3 + 1)) as win_idx from l where n >= 15)
    select ts_id, win_idx, list_transform(range(0, 4), lambda j: round(list_avg(v[win_idx * 3 + j * 4 + 1:win_idx * 3 + j * 4 + 3:2]), 6)) as means from c""")
def segment_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = words.segment_means(events(spark, sf_dir), Config(8, 2, 4, 3), normalise=False)
    return means.select("ts_id", "win_idx", F.transform("means", lambda m: F.round(m, 6)).alias("means"))


# --- words and bags --------------------------------------------------------------------------------------------------


@query(f"with {sql_words(EVENTS, [ONE])} select ts_id, signal_id::int as signal_id, word, count(*) as cnt from windows group by all")
def sax_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.counted(words.words(events(spark, sf_dir), ONE))


@query(f"with {sql_words(LINE_ITEMS, [COARSE], 0.5)} select ts_id, signal_id::int as signal_id, win_idx, word from windows")
def word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.words(line_items(spark, sf_dir), COARSE, least_ratio=0.5)


@query(f"with {sql_words(VECTORS, GRID)}, {_BAG} select ts_id, signal_id::int as signal_id, conf_idx, word, cnt from bag")
def bag_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.bag(vectors(spark, sf_dir), GRID)


@query(f"""with {sql_words(LINE_ITEMS, [ONE, COARSE])}, {_BAG}, total as (select ts_id, signal_id, conf_idx, count(*) as n from windows group by all)
    select ts_id, signal_id::int as signal_id, conf_idx, word, cnt, cnt / n as freq from bag join total using (ts_id, signal_id, conf_idx)""")
def bag_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = line_items(spark, sf_dir)
    return bags.frequencies(bags.bag(panel, [ONE, COARSE]), panel, [ONE, COARSE])


@query(f"with {sql_words(LINE_ITEMS, [ONE, COARSE])} select signal_id::int as signal_id, conf_idx, word, count(*) as cnt from windows group by all")
def bag_over_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.summed_over(bags.bag(line_items(spark, sf_dir), [ONE, COARSE]), "ts_id")


@query(f"""with {sql_words(LINE_ITEMS, [COARSE])}, g(signal_id, of) as (values (0, 0), (1, 0), (2, 1), (2, 2), (0, 2))
    select ts_id, of::int as signal_id, conf_idx, word, count(*) as cnt from windows join g using (signal_id) group by all""")
def bag_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.signal_groups(bags.bag(line_items(spark, sf_dir), [COARSE]), GROUPS)


@query(f"""with {sql_words(EVENTS, [ONE, COARSE])} select ts_id, signal_id::int as signal_id, floor(log2(w))::int as log_window, floor(log2(d))::int as log_dilation, word, count(*) as cnt
    from windows join config using (conf_idx) group by all""")
def bag_by_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.described(bags.bag(events(spark, sf_dir), [ONE, COARSE]), [ONE, COARSE], short=True)


@query(f"with {sql_words(LINE_ITEMS, [ONE, COARSE])} select ts_id, conf_idx, (signal_id * a ** l + word)::bigint as flat_idx, count(*) as cnt from windows join config using (conf_idx) group by all")
def flat_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.flattened(bags.bag(line_items(spark, sf_dir), [ONE, COARSE]), [ONE, COARSE])


@query(f"with {sql_words(LINE_ITEMS, [ONE, COARSE])}, {_BAG}, {_VOCABULARY} select feature_idx, conf_idx, signal_id::int as signal_id, word from vocabulary")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.vocabulary(bags.bag(line_items(spark, sf_dir), [ONE, COARSE]))


def _shown(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """panel, windows, vocabulary and features of the configurations that the explanations use."""
    panel = vectors(spark, sf_dir)
    windows = checkpoint(words.grid_words(panel, SHOWN))  # read by the vocabulary and by what follows
    bag = bags.counted(windows)
    known = checkpoint(bags.vocabulary(bag))
    return panel, windows, known, bags.features(bag, known)


@query(f"{_SHOWN} select ts_id, list(feature_idx order by feature_idx) as indices, list(cnt::double order by feature_idx) as values from features group by ts_id")
def sparse_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, known, features = _shown(spark, sf_dir)
    return bags.sparse_rows(features, known.count()).drop("size")


@query(f"""{_SHOWN}, r as (select ts_id, feature_idx, cnt, len(cell) as c from (select *, [1] as cell from features))
    select v.vec_id as ts_id, list(coalesce(r.cnt, 0)::double order by v.feature_idx) as values from (select vec_id, feature_idx from embeddings, vocabulary) v
    left join r on r.ts_id = v.vec_id and r.feature_idx = v.feature_idx group by all""")
def dense_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, known, features = _shown(spark, sf_dir)
    return bags.dense_rows(features, known.count())


# --- encodings -------------------------------------------------------------------------------------------------------


@query(f"""{_SHOWN} select feature_idx, symbols, list_aggregate(symbols, 'string_agg', '') as text, list_aggregate(symbols, 'string_agg', '')::bigint as decimal, word as rebased, list_transform(symbols, lambda s: s // 2) as halved,
    len(list_aggregate(symbols, 'string_agg', '')::bigint::varchar)::int as digits from (select feature_idx, word, list_transform(range(0, l), lambda i: ((word // (a ** (l - 1 - i))::bigint) % a)::int) as symbols from vocabulary join config using (conf_idx))""")
def word_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, known, _ = _shown(spark, sf_dir)
    fields = explain.receptive_fields(known, SHOWN)
    decimal = encoding.decimal_of(F.col("symbols"))
    rebased = encoding.rebased(decimal, 3)
    return fields.select("feature_idx", "symbols", encoding.digits_text(F.col("symbols")).alias("text"), decimal.alias("decimal"), rebased.alias("rebased"), encoding.halved_symbols(F.col("symbols")).alias("halved"), encoding.digit_count(decimal).alias("digits"))


# --- alignment -------------------------------------------------------------------------------------------------------


@query(f"""{_SHOWN} select ts_id, signal_id::int as signal_id, conf_idx, word, win_idx // 4 as block, count(*)::int as n, list((win_idx % 4)::int order by win_idx) as offsets
    from windows group by ts_id, signal_id, conf_idx, word, win_idx // 4""")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.inverted_index(_shown(spark, sf_dir)[1], span=4)


@query(f"{_SHOWN} select ts_id, signal_id::int as signal_id, conf_idx, word, win_idx from windows")
def windows_of_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.indexed_windows(alignment.inverted_index(_shown(spark, sf_dir)[1], span=4), span=4)


@query(f"{_SHOWN}, {_COVERED} select ts_id, pos, count(*) as windows, count(distinct feature_idx) as features from covered group by all")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, windows, known, _ = _shown(spark, sf_dir)
    covered = alignment.covered(alignment.occurrences(windows, known), SHOWN)
    return covered.groupBy("ts_id", "pos").agg(F.count("*").alias("windows"), F.countDistinct("feature_idx").alias("features"))


# --- explanation -----------------------------------------------------------------------------------------------------


def _importance(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    """A stand-in for importance of the predicted class, a row for each series and feature."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ts_id"), "label", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("feature_idx"))
    f = ((F.col("ts_id") * 31 + F.col("feature_idx") * 17 + F.col("label") * 7) % 101 - 50).cast("double")  # whole numbers add up exactly in any order
    return rows.select("ts_id", "feature_idx", f.alias("f"))


@query(f"""{_SHOWN}, {_IMPORTANCE}, {_COVERED}, n as (select ts_id, pos, feature_idx, count(*) as n from covered group by all), raw as (select ts_id, pos, sum(f * n) as s from n join importance using (ts_id, feature_idx) group by all),
    sums as (select ts_id, sum(s) as total from raw group by ts_id), held as (select ts_id, sum(f) as held from features join importance using (ts_id, feature_idx) group by ts_id), whole as (select ts_id, sum(f) as whole from importance group by ts_id)
    select ts_id, pos, case when whole = 0 or raw.s is null then 0.0 else raw.s * held / nullif(total, 0) end + 0.0 as s from panel left join raw using (ts_id, pos) left join sums using (ts_id) left join held using (ts_id) left join whole using (ts_id)""")
def saliency(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, windows, known, _ = _shown(spark, sf_dir)
    found = explain.saliency(panel, alignment.occurrences(windows, known), _importance(spark, sf_dir, known.count()), SHOWN)
    return found.select("ts_id", "pos", (F.col("s") + 0.0).alias("s"))


@query(f"""{_SHOWN}, {_IMPORTANCE}, lacking as (select i.*, w from importance i join vocabulary using (feature_idx) join config using (conf_idx) where not exists (from features x where x.ts_id = i.ts_id and x.feature_idx = i.feature_idx))
    select ts_id, feature_idx, f, f * sum(f) over (partition by ts_id) / nullif(sum(f * w) over (partition by ts_id), 0) as fn from lacking""")
def not_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, known, features = _shown(spark, sf_dir)
    return explain.not_contained(_importance(spark, sf_dir, known.count()), features, known, SHOWN)


_RANKED = "ranked as (select *, row_number() over (partition by ts_id order by abs(f) desc, feature_idx) as place, rank() over (partition by ts_id order by abs(f) desc) + (count(*) over (partition by ts_id, abs(f)) - 1) / 2 as avg_rank from importance)"


@query(f"{_SHOWN}, {_IMPORTANCE}, {_RANKED} select ts_id, feature_idx, f, place::int as place, avg_rank from ranked")
def ranked_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.ranked(_importance(spark, sf_dir, _shown(spark, sf_dir)[2].count()))


@query(f"{_SHOWN}, {_IMPORTANCE}, {_RANKED} select feature_idx, sum(abs(f)) as f_sum, avg(avg_rank) as mean_rank from ranked group by feature_idx")
def global_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.global_importance(_importance(spark, sf_dir, _shown(spark, sf_dir)[2].count()))


@query(f"{_SHOWN}, {_IMPORTANCE} select ts_id, signal_id::int as signal_id, feature_idx, (row_number() over (partition by ts_id, signal_id order by abs(f) desc, feature_idx))::int as place from importance join vocabulary using (feature_idx) join features using (ts_id, feature_idx)")
def contained_by_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, known, features = _shown(spark, sf_dir)
    held = _importance(spark, sf_dir, known.count()).join(features, ["ts_id", "feature_idx"])
    return explain.by_signal(held, known, F.col("f"))


@query(f"{_SHOWN}, {_IMPORTANCE} select feature_idx, conf_idx, signal_id::int as signal_id, word, sum(abs(f)) as feature_importance from vocabulary join importance using (feature_idx) group by all")
def mapping_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _shown(spark, sf_dir)[2]
    return explain.mapping_importance(known, _importance(spark, sf_dir, known.count()))


# --- patterns --------------------------------------------------------------------------------------------------------


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of every occurrence of every feature."""
    panel, windows, known, _ = _shown(spark, sf_dir)
    return alignment.with_values(alignment.covered(alignment.occurrences(windows, known), SHOWN), panel)


@query(f"""{_SHOWN}, {_COVERED}, {_POINTS}, spans as (select feature_idx, ts_id, signal_id, win_idx, min(pos) as a, max(pos) as b from pts group by all)
    select feature_idx, floor(quantile_cont(a, 0.5))::bigint as median_start, min(a) as least_pos, max(b) as greatest_pos from spans group by feature_idx""")
def pattern_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.place_summary(_points(spark, sf_dir))


@query(f"{_SHOWN}, {_COVERED}, {_POINTS} select feature_idx, k::int as k, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.75), 6) as q75 from pts group by all")
def pattern_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.shape_summary(_points(spark, sf_dir))
    return found.select("feature_idx", "k", *[F.round(c, 6).alias(c) for c in ("mean", "median", "q25", "q75")])


@query(f"""{_SHOWN}, {_COVERED}, {_POINTS}, x as (select feature_idx, ts_id, signal_id, win_idx, list(value order by k) as v from pts group by all),
    dist as (select a.feature_idx, a.ts_id, a.signal_id, a.win_idx, sum(list_distance(a.v, b.v)) as distance from x a join x b using (feature_idx) group by all)
    select feature_idx, ts_id, signal_id::int as signal_id, win_idx, round(distance, 4) as distance from dist qualify row_number() over (partition by feature_idx order by distance, ts_id, signal_id, win_idx) = 1""")
def pattern_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checkpoint(patterns.medoids_of(words.grid_words(vectors(spark, sf_dir), SHOWN, with_points=True), bags.FEATURE))
    known = bags.vocabulary(found)  # every word has a medoid
    return found.join(known, bags.FEATURE).select("feature_idx", "ts_id", "signal_id", "win_idx", F.round("distance", 4).alias("distance"))


@query(f"{_SHOWN} select feature_idx, label as y_pred, count(*) as n_series, sum(cnt)::bigint as cnt from features join embeddings on ts_id = vec_id group by all")
def patterns_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ts_id"), F.col("label").alias("y_pred"))
    return patterns.by_label(_shown(spark, sf_dir)[3], labels)


from serigraph import detail_queries  # noqa: E402, F401  (it adds to QUERIES and ORACLES)
