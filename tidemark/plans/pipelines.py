"""Composites of the operators: normalised inputs, fold-wise residual models, benchmark ladders, reports' frames.

Folds are few and known from the start; what runs per fold is one plan over the fold's
rows, and only sufficient statistics of the features' size reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import attribution, fundamentals, linear, metrics, parsing, pooling
from tidemark.operators.universe import average_rank
from tidemark.session import materialise

# Where normalised columns come from, the first present one counts.
MARKET_CAP_COLUMNS = ("snapshot_market_cap_usd", "hist_market_cap", "snapshot_log_market_cap", "hist_log_market_cap")
QA_COUNT_COLUMNS = ("num_pairs", "num_questions", "num_qa_turns")
CALL_COLUMNS = {"event_date": "call_date", "car_horizon": "pead_target", "sue_eps": "SUE_EPS", "sue_rev": "SUE_REV", "pre_event_return_5d": "pre_event_return", "volatility_20d": "volatility"}


def call_level(features: DataFrame) -> DataFrame:
    """One row per call under the names the residual models use. Missing columns are an error; of a call's rows the greatest counts; what is no number is null."""
    cap = next((c for c in MARKET_CAP_COLUMNS if c in features.columns), None)
    count = next((c for c in QA_COUNT_COLUMNS if c in features.columns), None)
    missing = [c for c in ("call_id", "ticker", *CALL_COLUMNS) if c not in features.columns] + ["market cap"] * (cap is None) + ["count of pairs"] * (count is None)
    if missing:
        raise ValueError(f"missing columns: {missing}")
    names = CALL_COLUMNS | {cap: "market_cap", count: "qa_count"}
    cols = [F.col(s).try_cast("date" if t == "call_date" else "double").alias(t) for s, t in names.items()]
    one = features.where("call_id is not null").groupBy("call_id").agg(F.max(F.struct("ticker", *cols)).alias("x"))
    return one.select("call_id", "x.*")


def pair_level(pairs: DataFrame) -> DataFrame:
    """(call_id, pair_id, pair_index, question_text, answer_text): ``pair_id`` is call::index; null texts are empty, a null index 0."""
    index = F.coalesce(F.col("pair_index").try_cast("int"), F.lit(0))
    return pairs.select("call_id", F.concat_ws("::", F.col("call_id").cast("string"), index.cast("string")).alias("pair_id"), index.alias("pair_index"), F.coalesce("question_text", F.lit("")).alias("question_text"), F.coalesce("answer_text", F.lit("")).alias("answer_text"))


def call_fields_in_pairs(pairs: DataFrame, calls: DataFrame, columns: list[str], keys: tuple[str, ...] = ("call_id",)) -> DataFrame:
    """Pairs with their call's fields, by call and fold where both have one; pairs without a call are left out."""
    on = [k for k in (*keys, "fold") if k in pairs.columns and k in calls.columns]
    return pairs.join(calls.select(*on, *[c for c in columns if c not in on]), on)


# ---- models by fold -------------------------------------------------------------------


def one_hot(train: DataFrame, frame: DataFrame, column: str, most: int = 64) -> tuple[DataFrame, list[str]]:
    """``frame`` with a 0/1 column per category of the training rows (the ``most`` frequent ones); unknown ones are 0 everywhere."""
    top = [r[0] for r in train.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(most).collect()]
    names = [f"{column}={i}" for i in range(len(top))]
    return frame.withColumns({n: (F.col(column).eqNullSafe(F.lit(v))).cast("double") for n, v in zip(names, top)}), names


def meta_ridge(train: DataFrame, frame: DataFrame, target: str, columns: tuple[str, ...] = ("baseline_pred", "mean_pair_residual", "max_pair_residual")) -> DataFrame:
    """``frame`` with final_pred of a ridge over the baseline and the pooled residuals."""
    missing = [c for c in columns if c not in train.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return frame.withColumn("final_pred", linear.Ridge(linear.available(train, list(columns)) or list(columns)).fit(train, target).predict())


def residual_fold(calls: DataFrame, pairs: DataFrame, features: list[str], pair_features: list[str], target: str, method: str = "simple") -> DataFrame:
    """One fold: ``calls`` and ``pairs`` have a ``split``; returns the calls with baseline_pred, mean and max pair residual and final_pred.

    The baseline ridge and the pair model are fitted on the train split alone. The pair model, a ridge
    over pair and call features on the call's residual, stands in the slot of a text model (``latent.score_batches``).
    """
    framed, _ = linear.residual_targets(calls.where("split = 'train'"), calls, features, target)
    rows = call_fields_in_pairs(pairs, framed, ["split", "residual_target", *[f for f in features if f in framed.columns]])
    train = rows.where("split = 'train' and residual_target is not null")
    use = linear.available(train, [*pair_features, *[f for f in features if f in rows.columns]])
    scored = rows.withColumn("pair_residual_pred", linear.Ridge(use).fit(train, "residual_target").predict() if use else F.lit(0.0))
    pooled = pooling.residual_pool(scored, ["call_id"])
    out = pooling.attach(framed, pooled, ["mean_pair_residual", "max_pair_residual"])
    if method == "simple":
        return linear.final_prediction(out)
    return meta_ridge(out.where("split = 'train'"), out, target)


def fold_metrics(predicted: DataFrame, target: str, by: list[str]) -> DataFrame:
    """(by..., rows, sign_accuracy, rmse, mae): of the final predictions."""
    d = F.col(target) - F.col("final_pred")
    p = predicted.where(F.col(target).isNotNull() & F.col("final_pred").isNotNull())
    return p.groupBy(*by).agg(F.count("*").alias("rows"), F.avg(((F.col("final_pred") >= 0) == (F.col(target) > 0)).cast("int")).alias("sign_accuracy"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"))


def mean_metrics(by_fold: DataFrame, skip: tuple[str, ...] = ("fold", "split")) -> DataFrame:
    """One row: the mean over folds of every numeric column, nulls left out; ``folds`` counts them."""
    numeric = [c for c, k in by_fold.dtypes if c not in skip and k in ("double", "float", "int", "bigint")]
    return by_fold.agg(F.count_distinct("fold").alias("folds"), *[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in numeric])


def residual_pipeline(calls: DataFrame, pairs: DataFrame, folds: DataFrame, features: list[str], pair_features: list[str], target: str, method: str = "simple") -> DataFrame:
    """(fold, split, call_id, target, baseline_pred, mean_pair_residual, final_pred) of all folds.

    ``folds`` is (fold, split, call_id) of ``splits.rolling_splits``; its fold numbers, as many as the history allows, are looped over.
    """
    out = None
    for n in sorted(r["fold"] for r in folds.select("fold").distinct().collect()):
        fold = materialise(calls.join(folds.where(F.col("fold") == n).select("call_id", "split"), "call_id"), "fold")
        p = residual_fold(fold, pairs, features, pair_features, target, method).select(F.lit(n).alias("fold"), "split", "call_id", F.col(target).alias("target"), "baseline_pred", "mean_pair_residual", "final_pred")
        out = p if out is None else out.unionByName(p)
    return out if out is not None else calls.select(F.lit(0).alias("fold"), F.lit("").alias("split"), "call_id", F.col(target).alias("target"), *[F.lit(0.0).alias(c) for c in ("baseline_pred", "mean_pair_residual", "final_pred")]).limit(0)


def benchmark_ladder(calls: DataFrame, folds: DataFrame, rungs: dict[str, list[str]], target: str, label: str) -> DataFrame:
    """(fold, benchmark, call_id, y, target, score, probability): out-of-fold test scores of every rung.

    A rung is a list of features; its ridge is fitted on the fold's train split and calibrated on its val split. A rung
    whose features have no value in the train split is left out of that fold.
    """
    out = None
    for n in sorted(r["fold"] for r in folds.select("fold").distinct().collect()):
        fold = materialise(calls.join(folds.where(F.col("fold") == n).select("call_id", "split"), "call_id"), "fold")
        train = fold.where("split = 'train'")
        for name, features in rungs.items():
            use = linear.available(train, features)
            if not use:
                continue
            scored = fold.withColumn("score", linear.Ridge(use).fit(train, target).predict())
            fit = linear.Calibrator().fit(scored.where("split = 'val'"), "score", label)
            p = scored.where("split = 'test'").select(F.lit(n).alias("fold"), F.lit(name).alias("benchmark"), "call_id", F.col(label).cast("int").alias("y"), F.col(target).alias("target"), "score", fit.predict().alias("probability"))
            out = p if out is None else out.unionByName(p)
    return out if out is not None else calls.select(F.lit(0).alias("fold"), F.lit("").alias("benchmark"), "call_id", F.col(label).cast("int").alias("y"), F.col(target).alias("target"), F.lit(0.0).alias("score"), F.lit(0.0).alias("probability")).limit(0)


def benchmark_table(scores: DataFrame) -> DataFrame:
    """(benchmark, rows, auroc, auprc, accuracy, spearman): over the out-of-fold rows of each rung."""
    area = metrics.roc_pr(scores, "y", "probability", ["benchmark"]).select("benchmark", "rows", "auroc", "auprc")
    hit = scores.where("y is not null and probability is not null").groupBy("benchmark").agg(F.avg(((F.col("probability") >= 0.5).cast("int") == F.col("y")).cast("int")).alias("accuracy"))
    r = average_rank(average_rank(scores.select("benchmark", "score", "target").where("score is not null and target is not null"), "score", "a", ["benchmark"]), "target", "b", ["benchmark"])
    return area.join(hit, "benchmark", "left").join(r.groupBy("benchmark").agg(F.corr("a", "b").alias("spearman")), "benchmark", "left")


def deltas(table: DataFrame, base: str, columns: list[str], name: str = "benchmark") -> DataFrame:
    """``table`` with delta_<column>_vs_base, the difference to the base's one row; null where there is none."""
    b = table.where(F.col(name) == base).agg(*[F.first(c).alias(f"__{c}") for c in columns])
    return table.crossJoin(F.broadcast(b)).select(*table.columns, *[(F.col(c) - F.col(f"__{c}")).alias(f"delta_{c}_vs_base") for c in columns])


# ---- datasets --------------------------------------------------------------------------


def market_caps(shares: DataFrame, closes: DataFrame) -> DataFrame:
    """(call_id, ticker, event_date, shares, close, hist_market_cap, hist_log_market_cap, hist_market_cap_percentile).

    ``shares`` and ``closes`` hold the values known at each call; the product is null where one is missing, the percentile is its average rank as a share.
    """
    j = shares.select("call_id", "ticker", "event_date", "shares").join(closes.select("call_id", "close"), "call_id", "left")
    j = j.withColumn("hist_market_cap", F.col("shares") * F.col("close")).withColumn("hist_log_market_cap", F.when(F.col("hist_market_cap") > 0, F.ln("hist_market_cap")))
    return average_rank(j, "hist_market_cap", "hist_market_cap_percentile", share=True)


def parse_by_source(records: DataFrame, key: str, text: str, segments: str, layout: Column) -> tuple[DataFrame, DataFrame]:
    """(turns, audit) by each record's layout: structured (the colon parser where that finds no analyst), sections, else colon."""
    marked = records.withColumn("__layout", F.coalesce(layout, F.lit("colon")))
    first, _ = parsing.parse_records(marked.where("__layout = 'structured'"), key, text, segments)
    sections = parsing.parse_sections(marked.where("__layout = 'sections'"), key, text).withColumn("parser_type", F.lit("sections"))
    colon = parsing.parse_colon(marked.where("__layout not in ('structured', 'sections')"), key, text).withColumn("parser_type", F.lit("colon"))
    cols = [key, "turn_id", "speaker", "speaker_role", "section", "text", "parser_type"]
    number = lambda d: d.withColumn("turn_id", (F.col("idx") - F.min("idx").over(parsing.Window.partitionBy(key)) + 1).cast("int"))
    turns = first.select(*cols).unionByName(number(sections).select(*cols)).unionByName(number(colon).select(*cols))
    stats = turns.groupBy(key).agg(F.first("parser_type").alias("parser_type"), F.count("*").alias("parsed_turns"), F.count_if(F.col("speaker_role") == "analyst").alias("parsed_analyst_turns"))
    n = F.coalesce("parsed_analyst_turns", F.lit(0))
    return turns, records.select(key).join(stats, key, "left").select(key, F.coalesce("parser_type", F.lit("none")).alias("parser_type"), F.coalesce("parsed_turns", F.lit(0)).alias("parsed_turns"), n.alias("parsed_analyst_turns"), (n > 0).alias("parsed_ok"))


def model_ready(questions: DataFrame, study: DataFrame, split: DataFrame) -> DataFrame:
    """(call_id, event_date, text, num_questions, car_horizon, label, split): calls with question text and a return window."""
    return questions.where("text <> ''").join(study.where("has_window").select("call_id", "event_date", "car_horizon", "label"), "call_id").join(split.select("call_id", "split"), "call_id", "left")


def call_sequences(pairs: DataFrame, columns: list[str], stats: dict[str, tuple[float, float]]) -> DataFrame:
    """(call_id, features): each call's pairs in order as rows of z-scores, with the training rows' mean and spread of each column."""
    z = F.array(*[((F.col(c).cast("double") - stats[c][0]) / stats[c][1]) for c in columns])
    return pairs.groupBy("call_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pair_index", z.alias("z")))), lambda x: x["z"]).alias("features"))


def text_features(pairs: DataFrame) -> DataFrame:
    """Per call mean and maximum of lengths and turns, and the rates of the roles that answer."""
    sizes = [f(c).alias(f"pair_{n}_{k}") for c, n in (("question_char_len", "question_chars"), ("answer_char_len", "answer_chars"), ("num_answer_turns", "answer_turns")) for f, k in ((F.avg, "mean"), (F.max, "max"))]
    rates = [F.avg(F.col(c).cast("int")).alias(n) for c, n in (("answer_has_management_role", "management_answer_rate"), ("answer_has_mixed_roles", "mixed_answer_rate"), ("answer_is_analyst_only", "analyst_only_answer_rate"), ("answer_contains_question_mark", "answer_question_mark_rate"))]
    return pairs.groupBy("call_id").agg(*sizes, *rates)


# ---- explanations ------------------------------------------------------------------------


def integrated_gradients(tokens: Column, scorer: attribution.Additive) -> Column:
    """Attributions of an additive scorer from the empty baseline: its gradient is constant along the way, so each token's is its own size."""
    w = scorer.weights(tokens)
    return F.transform(w, lambda x: F.abs(x))


def explain(rows: DataFrame, key: str, methods: dict[str, Callable[[DataFrame], DataFrame]], scorer, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(measures, curves) of several ways to score tokens: (key, method, comprehensiveness, sufficiency, deletion_auc) and (key, method, fraction_removed, score)."""
    measures = curves = None
    for name, scores in methods.items():
        r = scores(rows)
        c = attribution.deletion_curve(r, key, scorer)
        m = attribution.faithfulness(r, scorer, k).select(key, "comprehensiveness", "sufficiency").join(attribution.curve_area(c, key).withColumnRenamed("auc", "deletion_auc"), key).withColumn("method", F.lit(name))
        c = c.withColumn("method", F.lit(name))
        measures, curves = (m, c) if measures is None else (measures.unionByName(m), curves.unionByName(c))
    return measures, curves


def method_means(measures: DataFrame) -> DataFrame:
    """(method, rows, comprehensiveness, sufficiency, deletion_auc): means over rows."""
    return measures.groupBy("method").agg(F.count("*").alias("rows"), *[F.avg(c).alias(c) for c in ("comprehensiveness", "sufficiency", "deletion_auc")])


def mean_curves(curves: DataFrame) -> DataFrame:
    """(method, fraction_removed, score): the plotted mean deletion curve."""
    return curves.groupBy("method", "fraction_removed").agg(F.avg("score").alias("score"))


# ---- runs ---------------------------------------------------------------------------------


def collect_results(spark, root: str) -> DataFrame:
    """(run, config, val, test): the JSON texts of every run's folder below ``root``; a run without test results is left out."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root).select("value", F.split("_metadata.file_path", "/").alias("p"))
    named = files.select(F.element_at("p", -2).alias("run"), F.element_at("p", -1).alias("file"), "value")
    pick = lambda n: F.max(F.when(F.col("file") == n, F.col("value")))
    return named.groupBy("run").agg(pick("config.json").alias("config"), pick("val_metrics.json").alias("val"), pick("test_metrics.json").alias("test")).where("test is not null")


def comparison(tables: dict[str, DataFrame]) -> DataFrame:
    """Several benchmarks' rows in one table, with ``source``; columns one lacks are null."""
    out = None
    for name, t in tables.items():
        t = t.withColumn("source", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def growth(fundamentals_rows: DataFrame, value: str, by: str = "ticker", at: str = "event_date") -> DataFrame:
    """Adds <value>_growth: against the row before of the same ticker, as a share of its size (``fundamentals.safe_ratio``)."""
    before = F.lag(value).over(parsing.Window.partitionBy(by).orderBy(at, "call_id"))
    return fundamentals_rows.withColumn(f"{value}_growth", fundamentals.safe_ratio(F.col(value) - before, before))
