"""Queries that score, threshold, combine and evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import paths, ratios
from loomwork.functions.vectors import micro
from loomwork.operators import adapter, ensemble, lookups, metrics, prototypes, scoring, sweep
from loomwork.plans.tables import SHOTS, TARGETS, figures_sql, micro_sql, scores_sql, table, targets, unit_sql, vectors
from loomwork.storage import checkpointed, stored

K = (1, 3, 5)
#: The class whose rows don't count in top-k accuracy.
EXCLUDED = 5
BETA, ALPHA = 5.5, 1.0
GRID_SCALE, GRID_STEPS = (6.0, 3.0), (3, 3)


def _split(spark: SparkSession, sf_dir: str, view: str) -> tuple[DataFrame, DataFrame]:
    """Reference items (a few of each class) and all others."""
    items = vectors(spark, sf_dir, view)
    shots = prototypes.few_shot(items, "label", "vec_id", SHOTS)
    return shots, prototypes.others(items, shots, ["vec_id"])


def _scored(spark: SparkSession, sf_dir: str, view: str = "all") -> DataFrame:
    """(vec_id, label, vec, scores) of the items that aren't references."""
    shots, rest = _split(spark, sf_dir, view)
    return scoring.class_scores(rest, prototypes.centroids(shots, "label"))


def _pairs(spark: SparkSession, sf_dir: str, view: str = "all") -> DataFrame:
    """(vec_id, label, cls, sim) of the target classes, restricted to the class and the one it is confused with."""
    long = scoring.long_scores(_scored(spark, sf_dir, view), "vec_id", "label")
    return long.where((F.col("cls") < TARGETS) & ((F.col("label") == F.col("cls")) | (F.col("label") == F.col("cls") + TARGETS)))


def _positive():
    return F.col("label") == F.col("cls")


def cosine_scores(spark, sf_dir):
    return scoring.long_scores(_scored(spark, sf_dir), "vec_id", "label").select("vec_id", "label", "cls", micro(F.col("sim")).alias("sim_micro"))


def zero_shot_argmax(spark, sf_dir):
    return _scored(spark, sf_dir).select("vec_id", "label", scoring.best_class().alias("pred"))


def softmax_probs(spark, sf_dir):
    return scoring.with_softmax(_scored(spark, sf_dir)).select("vec_id", F.inline("probs")).select("vec_id", "cls", micro(F.col("prob")).alias("prob_micro"))


def topk_accuracy(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumn("top", scoring.top_classes(max(K))).select("label", "top")
    # one pass: all k from the longest list
    kept = scored.where(F.col("label") != EXCLUDED).select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.array_contains(F.slice("top", 1, k), F.col("label")).alias("hit")) for k in K])))
    found = kept.groupBy("k").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    return found.withColumn("accuracy", F.coalesce(F.try_divide(F.lit(100.0) * F.col("hits"), F.col("n")), F.lit(0.0)))


def _matrix(spark, sf_dir):
    return metrics.confusion_matrix(zero_shot_argmax(spark, sf_dir), "label", "pred")


def _all_classes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("cls")).distinct()


def ovr_confusion(spark, sf_dir):
    return metrics.with_figures(metrics.one_vs_rest(_matrix(spark, sf_dir), _all_classes(spark, sf_dir)))


def confusion_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


def macro_f1_eps(spark, sf_dir):
    counts = metrics.one_vs_rest(_matrix(spark, sf_dir), _all_classes(spark, sf_dir))
    return metrics.macro_f1_percent(counts).select(micro(F.col("macro_f1")).alias("macro_f1_micro"))


def classification_report(spark, sf_dir):
    report = metrics.classification_report(_matrix(spark, sf_dir), _all_classes(spark, sf_dir))
    return report.select("name", *[micro(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


def class_metrics(spark, sf_dir):
    """Each class's figures and their average."""
    figures = metrics.with_figures(metrics.one_vs_rest(_matrix(spark, sf_dir), _all_classes(spark, sf_dir))).withColumn("accuracy", ratios.accuracy())
    columns = ["precision", "recall", "f1", "accuracy"]
    return metrics.with_average(figures, "cls", columns).select("cls", *[micro(F.col(c)).alias(c) for c in columns])


def binary_confusion(spark, sf_dir):
    """Each target class against its confuser by the larger similarity; a row for each figure."""
    scored = _scored(spark, sf_dir).select("vec_id", "label", F.map_from_entries("scores").alias("s"))
    asked = scored.withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(TARGETS - 1)))).where((F.col("label") == F.col("cls")) | (F.col("label") == F.col("cls") + TARGETS))
    counts = metrics.binary_counts(asked, ["cls"], _positive(), F.element_at("s", F.col("cls")) >= F.element_at("s", F.col("cls") + TARGETS))
    figures = metrics.with_figures(counts)
    return metrics.key_values(figures, "cls", ["tp", "fp", "fn", "tn", "precision", "recall", "f1"])


def threshold_curve(spark, sf_dir):
    return sweep.fixed_sweep(_pairs(spark, sf_dir), ["cls"], _positive())


def threshold_sweep_best(spark, sf_dir):
    return sweep.best_point(threshold_curve(spark, sf_dir), ["cls"])


def threshold_summary(spark, sf_dir):
    """The best points and their average, as the summary table shows them."""
    best = threshold_sweep_best(spark, sf_dir)
    report = metrics.with_average(best, "cls", ["threshold", "f1", "precision", "recall"])
    return report.select("cls", *[micro(F.col(c)).alias(c) for c in ("threshold", "f1", "precision", "recall")])


def _rounded_best(best: DataFrame) -> DataFrame:
    return best.select("cls", *[micro(F.col(c)).alias(c) for c in ("threshold", "f1", "precision", "recall")])


def linspace_sweep_best(spark, sf_dir):
    curve = sweep.range_sweep(_pairs(spark, sf_dir), ["cls"], _positive())
    return _rounded_best(sweep.best_or_zero(curve, ["cls"], targets(spark)))


def overlap_sweep_best(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("sim", F.col("sim") * 100.0)
    return _rounded_best(sweep.best_or_zero(sweep.overlap_sweep(rows, ["cls"], _positive()), ["cls"], targets(spark)))


def _passes(spark, sf_dir, view, rows):
    """One model's files, scored by its own best thresholds."""
    thresholds = sweep.best_point(sweep.fixed_sweep(rows, ["cls"], _positive()), ["cls"])
    named = rows.withColumns({"name": F.concat(F.lit("v"), F.col("vec_id").cast("string")), "path": F.concat(F.lit(f"{view}/v"), F.col("vec_id").cast("string"))})
    return ensemble.passes(named, thresholds, "cls", "name", ["label"], view)


def _union(spark, sf_dir):
    # stored, as thresholds are found from the scores and then compared with them
    one, two = (_passes(spark, sf_dir, v, stored(_pairs(spark, sf_dir, v))) for v in ("en", "cn"))
    return ensemble.union_of(one, two, ["cls", "label", "name"])


def union_ensemble_metrics(spark, sf_dir):
    return ensemble.union_metrics(_union(spark, sf_dir), "cls", _positive())


def union_sample_counts(spark, sf_dir):
    return ensemble.union_counts(_union(spark, sf_dir).where(_positive()), "cls")


def union_export(spark, sf_dir):
    kept = _union(spark, sf_dir).where(_positive() & F.col("either"))
    return kept.select("cls", "name", micro(F.col("en_sim")).alias("en_sim"), micro(F.col("cn_sim")).alias("cn_sim"), "en_pass", "cn_pass", "source_path")


def union_marks(spark, sf_dir):
    """Every file of either model with what the two say of it, as their report shows it."""
    marked = [paths.pass_mark(F.col(f"{m}_sim"), F.lit(0.5)).alias(f"{m}_mark") for m in ("en", "cn")]
    shown = [F.coalesce(micro(F.col(f"{m}_sim")).cast("string"), F.lit("N/A")).alias(f"{m}_text") for m in ("en", "cn")]
    one, two = (_pairs(spark, sf_dir, v).select("cls", "label", "vec_id", F.col("sim").alias(f"{v}_sim")) for v in ("en", "cn"))
    # the second model hasn't seen every seventh file
    return one.join(two.where(F.col("vec_id") % 7 != 0), ["cls", "label", "vec_id"], "full_outer").select("cls", "vec_id", *marked, *shown)


def or_predictions(spark, sf_dir):
    limit = F.lit(0.5)
    return ensemble.or_predictions(_pairs(spark, sf_dir, "en"), _pairs(spark, sf_dir, "cn"), ["vec_id", "label", "cls"], (limit, limit))


def cascade_filter(spark, sf_dir):
    """Documents of at least 500 characters pass the cheap test; the costly one is their label (quality good and not toxic)."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))

    def verdict(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id").join(labels, "doc_id").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("yes"))

    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return ensemble.cascade(docs, "doc_id", F.col("n_chars") >= 500, verdict).select("doc_id", "first", "final")


def cascade_counts(spark, sf_dir):
    """The cascade's counts over all documents, in one row."""
    return ensemble.cascade_counts(cascade_filter(spark, sf_dir), [])


def fewshot_sample(spark, sf_dir):
    return prototypes.few_shot(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", SHOTS)


def prototype_centroid(spark, sf_dir):
    shots, _ = _split(spark, sf_dir, "all")
    return prototypes.centroids(shots, "label").select("cls", F.posexplode("vec").alias("i", "x")).select("cls", "i", micro(F.col("x")).alias("x_micro"))


def cache_key_means(spark, sf_dir):
    """Cache keys of items that are seen twice, by either encoder: the mean of both vectors, a unit vector again."""
    seen = [vectors(spark, sf_dir, v).withColumn("epoch", F.lit(i)) for i, v in enumerate(("en", "cn"))]
    keys = prototypes.cache_keys(seen[0].unionByName(seen[1]), "vec_id", "label")
    return keys.select("key_id", "label", F.posexplode("vec").alias("i", "x")).select("key_id", "label", "i", micro(F.col("x")).alias("x_micro"))


def looked_up(spark, sf_dir):
    """The reference items with their vectors' first component, each of which has to be there."""
    features = vectors(spark, sf_dir).select("vec_id", F.get("vec", F.lit(0)).alias("x"))
    return lookups.complete_lookup(fewshot_sample(spark, sf_dir), features, "vec_id", ["x"]).select("vec_id", "label", micro(F.col("x")).alias("x_micro"))


def image_text_mean(spark, sf_dir):
    both = vectors(spark, sf_dir, "en").withColumnRenamed("vec", "a").join(vectors(spark, sf_dir, "cn").select("vec_id", F.col("vec").alias("b")), "vec_id")
    return prototypes.pair_mean(both, "label", "a", "b").select("cls", F.posexplode("vec").alias("i", "x")).select("cls", "i", micro(F.col("x")).alias("x_micro"))


def outlier_trim(spark, sf_dir):
    return prototypes.trimmed(vectors(spark, sf_dir), "label").select("vec_id", "label", "kept")


def trimmed_prototype(spark, sf_dir):
    """The mean of each class's items without the farthest 5 %."""
    means = prototypes.trimmed_mean(vectors(spark, sf_dir), "label")
    return means.select("cls", F.posexplode("vec").alias("i", "x")).select("cls", "i", micro(F.col("x")).alias("x_micro"))


def _with_cache(spark, sf_dir):
    shots, rest = _split(spark, sf_dir, "all")
    scored = scoring.class_scores(rest, prototypes.centroids(shots, "label"))
    return scoring.with_affinities(scored, shots.select(F.col("vec_id").alias("key_id"), "vec", "label")).drop("vec")


def cache_logits(spark, sf_dir):
    cached = scoring.cache_logits(F.transform("scores", lambda s: s["cls"]), F.lit(BETA))
    rows = _with_cache(spark, sf_dir).withColumn("cached", cached)
    return rows.select("vec_id", F.inline(scoring.combined_logits(F.lit(ALPHA), F.col("cached")))).select("vec_id", "cls", micro(F.col("sim")).alias("logit_micro"))


def grid_search(spark, sf_dir):
    """The best beta and alpha by the mean of the target classes' best F1 over their overlap; affinities are computed once."""
    grid = sweep.hyper_grid(spark, GRID_SCALE, GRID_STEPS)
    # cache logits depend on beta alone; they are stored for the target classes, and every alpha is a sum over them
    rows = _with_cache(spark, sf_dir).withColumn("scores", F.filter("scores", lambda s: s["cls"] < TARGETS))
    rows = rows.crossJoin(F.broadcast(grid.select("bi", "beta").distinct()))
    rows = rows.withColumn("cached", scoring.cache_logits(F.transform("scores", lambda s: s["cls"]), F.col("beta")))
    rows = checkpointed(rows.select("bi", "label", "scores", "cached")).crossJoin(F.broadcast(grid.select("ai", "alpha").distinct()))
    logits = rows.select("bi", "ai", "label", F.inline(scoring.combined_logits(F.col("alpha"), F.col("cached"))))
    by = ["bi", "ai", "cls"]
    groups = grid.select("bi", "ai").crossJoin(F.broadcast(targets(spark)))
    best = sweep.best_or_zero(sweep.overlap_sweep(logits, by, _positive()), by, groups)
    means = best.groupBy("bi", "ai").agg((F.sum(micro(F.col("f1"))) / F.lit(float(TARGETS))).alias("f1"))
    return sweep.best_setting(means).select("bi", "ai", F.floor(F.col("f1") + 0.5).alias("f1_micro"))


#: A rate that moves the few keys of the tables within a few epochs.
TRAINING = adapter.Training(alpha=ALPHA, beta=BETA, rate=0.02, epochs=4, steps=4)


def adapter_epochs(spark, sf_dir):
    """The epochs of an adapter that is trained on the reference items and scored on the others: (epoch, loss, f1, best), in whole millionths."""
    shots, rest = _split(spark, sf_dir, "all")
    shots, rest = checkpointed(shots), checkpointed(rest)
    protos, classes = checkpointed(prototypes.centroids(shots, "label")), targets(spark)

    def score(model: adapter.Adapter) -> float:
        return adapter.mean_best_f1(rest, protos, model.as_table(spark), TRAINING, classes)

    cache = shots.select(F.col("vec_id").alias("key_id"), "vec", "label")
    _, history = adapter.train_adapter(shots, "vec_id", cache, protos, score, TRAINING)
    epochs = spark.createDataFrame([(h["epoch"], h["loss"], h["f1"]) for h in history], "epoch int, loss double, f1 double")
    best = epochs.agg(F.max_by("epoch", F.struct("f1", -F.col("epoch"))).alias("_best"))
    return epochs.crossJoin(F.broadcast(best)).select("epoch", micro(F.col("loss")).alias("loss_micro"), micro(F.col("f1")).alias("f1_micro"), (F.col("epoch") == F.col("_best")).alias("best"))


def kmeans_prototype(spark, sf_dir):
    near, _ = prototypes.clustered_prototype(vectors(spark, sf_dir), "vec_id", SHOTS)
    return near.select("vec_id", "label", micro(F.col("distance")).alias("distance_micro"))


def silhouette(spark, sf_dir):
    return prototypes.silhouettes(vectors(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        cosine_scores, zero_shot_argmax, softmax_probs, topk_accuracy, ovr_confusion, confusion_matrix, macro_f1_eps, classification_report, class_metrics,
        binary_confusion, threshold_curve, threshold_sweep_best, threshold_summary, linspace_sweep_best, overlap_sweep_best, union_ensemble_metrics,
        union_sample_counts, union_export, union_marks, or_predictions, cascade_filter, cascade_counts, fewshot_sample, prototype_centroid, cache_key_means, looked_up, image_text_mean, outlier_trim, trimmed_prototype,
        cache_logits, grid_search, adapter_epochs, kmeans_prototype, silhouette,
    )
}

_S = scores_sql("all")
_ARGMAX = f"{_S}, a as (select vec_id, label, cls as pred from (select *, row_number() over (partition by vec_id order by sim desc, cls) as k from s_all) where k = 1)"
_OVR = f"""{_ARGMAX}, cl as (select distinct label as cls from embeddings),
c as (select cls, count(*) filter (where label = cls and pred = cls) as tp, count(*) filter (where label <> cls and pred = cls) as fp, count(*) filter (where label = cls and pred <> cls) as fn,
  count(*) filter (where label <> cls and pred <> cls) as tn from cl cross join a group by cls)"""


def _pairs_sql(view: str) -> str:
    return f"{scores_sql(view)}, q_{view} as (select vec_id, label, cls, sim, label = cls as y from s_{view} where cls < {TARGETS} and label in (cls, cls + {TARGETS}))"


def _fixed_sql(view: str) -> str:
    """CTE t_: every threshold against every score; CTE b_: the best of each class."""
    return f"""{_pairs_sql(view)},
n_{view} as (select cls, i, i / 1000.0::double as threshold, count(*) filter (where sim >= i / 1000.0::double and y) as tp, count(*) filter (where sim >= i / 1000.0::double and not y) as fp,
  count(*) filter (where sim < i / 1000.0::double and not y) as tn, count(*) filter (where sim < i / 1000.0::double and y) as fn from q_{view} cross join range(0, 1001) g(i) group by cls, i),
t_{view} as (select *, {figures_sql()} from n_{view}),
b_{view} as (select * from (select *, row_number() over (partition by cls order by f1 desc, threshold) as k from t_{view}) where k = 1)"""


def _spaced_sql(rows: str, by: str, ranges: str) -> str:
    """Best of each group over linspace thresholds; rows (by, sim, y), ranges (by, lo, hi, n)."""
    on = " and ".join(f"r.{c} = g.{c}" for c in by.split(", "))
    groups = ", ".join(f"g.{c}" for c in by.split(", "))
    return f"""
ranges as ({ranges}),
g as (select {by}, i, case when i = 0 then lo when i = n - 1 then hi else lo + i * ((hi - lo) / (n - 1)) end as threshold from ranges, range(0, n::bigint) t(i) where n > 0),
n as (select {groups}, threshold, count(*) filter (where sim >= threshold and y) as tp, count(*) filter (where sim >= threshold and not y) as fp, count(*) filter (where sim < threshold and y) as fn
  from g join {rows} r on {on} group by {groups}, threshold),
t as (select *, {figures_sql(False)} from n),
b as (select * from (select *, row_number() over (partition by {by} order by f1 desc, threshold) as k from t where f1 > 0) where k = 1)"""


def _overlap_ranges(rows: str, by: str) -> str:
    return f"""select {by}, lo, hi, greatest(trunc((hi - lo) * 10)::bigint, 0) as n from (select {by}, greatest(min(sim) filter (where y), min(sim) filter (where not y)) as lo,
  least(max(sim) filter (where y), max(sim) filter (where not y)) as hi from {rows} group by {by} having count(*) filter (where y) > 0 and count(*) filter (where not y) > 0)"""


_BEST = ", ".join(f"{micro_sql(f'coalesce({c}, 0)')} as {c}" for c in ("threshold", "f1", "precision", "recall"))
_TARGETS_SQL = f"(select i::int as cls from range(0, {TARGETS}) t(i))"


def _passes_sql(view: str) -> str:
    return f"{_fixed_sql(view)}, h_{view} as (select q.cls, q.label, 'v' || vec_id as name, sim as {view}_sim, sim >= threshold as {view}_pass, '{view}/v' || vec_id as {view}_path from q_{view} q join b_{view} b using (cls))"


_UNION = f"""{_passes_sql("en")}, {_passes_sql("cn")},
un as (select cls, label, name, en_sim, cn_sim, coalesce(en_pass, false) as en_pass, coalesce(cn_pass, false) as cn_pass, coalesce(en_path, cn_path) as source_path from h_en full join h_cn using (cls, label, name))"""

_CACHE = f"""{_S},
k as (select s.vec_id, r.label as cls, list_sum(list_transform(list_zip(s.v, r.v), lambda q: q[1] * q[2])) as a, r.vec_id as key_id from (select * from i_all anti join r_all using (vec_id)) s cross join r_all r)"""

_TRIM = """mm as (select label, list(m order by j) as m from (select label, j, sum(floor(v[j] * 1e6)::bigint)::double / 1e6 / count(*)::double as m from i_all, range(1, 65) t(j) group by label, j) group by label),
far as (select vec_id, i.label, 1 - list_sum(list_transform(list_zip(v, m), lambda q: q[1] * q[2])) as d from i_all i join mm using (label)),
edge as (select label, quantile_cont(d, 0.95) as e from far group by label)"""

ORACLES = {
    "cosine_scores": f"with {_S} select vec_id, label, cls, {micro_sql('sim')} as sim_micro from s_all",
    "zero_shot_argmax": f"with {_ARGMAX} select * from a",
    "softmax_probs": f"with {_S}, e as (select vec_id, cls, exp((sim - max(sim) over (partition by vec_id)) * 100) as e from s_all) select vec_id, cls, {micro_sql('e / sum(e) over (partition by vec_id)')} as prob_micro from e",
    "topk_accuracy": f"""with {_S}, o as (select label, cls, row_number() over (partition by vec_id order by sim desc, cls) as r from s_all where label <> {EXCLUDED}),
n as (select k::int as k, count(*) filter (where r = 1) as n, count(*) filter (where r <= k and label = cls) as hits from o cross join (select unnest([{", ".join(map(str, K))}]) as k) group by k)
select k, n, hits, 100.0::double * hits / n as accuracy from n""",
    "ovr_confusion": f"with {_OVR} select *, {figures_sql()} from c",
    "confusion_matrix": f"with {_ARGMAX} select label as target, pred, count(*) as n from a group by all",
    "macro_f1_eps": f"""with {_OVR}, p as (select tp / (tp + fp + 1e-6) as p, tp / (tp + fn + 1e-6) as r from c) select {micro_sql("avg(2 * p * r / (p + r + 1e-6)) * 100")} as macro_f1_micro from p""",
    "classification_report": f"""with {_OVR}, g as (select cls::varchar as name, {figures_sql()}, tp + fn as support, tp from c),
w as (select sum(tp)::double / sum(support) as acc, sum(support)::bigint as support, {", ".join(f"avg({c}) as m_{c}, sum({c} * support) / sum(support) as w_{c}" for c in ("precision", "recall", "f1"))} from g),
x as (select name, precision, recall, f1, support from g union all select 'accuracy', acc, acc, acc, support from w union all select 'macro avg', m_precision, m_recall, m_f1, support from w
  union all select 'weighted avg', w_precision, w_recall, w_f1, support from w)
select name, {", ".join(f"{micro_sql(c)} as {c}" for c in ("precision", "recall", "f1"))}, support from x""",
    "class_metrics": f"""with {_OVR}, g as (select cls::varchar as cls, {figures_sql()}, (tp + tn)::double / (tp + fp + fn + tn) as accuracy from c),
x as (select * from g union all select 'Average', avg(precision), avg(recall), avg(f1), avg(accuracy) from g)
select cls, {", ".join(f"{micro_sql(c)} as {c}" for c in ("precision", "recall", "f1", "accuracy"))} from x""",
    "binary_confusion": f"""with {_S}, z as (select a.vec_id, a.label, a.cls, a.label = a.cls as y, a.sim >= b.sim as p from s_all a join s_all b on a.vec_id = b.vec_id and b.cls = a.cls + {TARGETS} where a.cls < {TARGETS} and a.label in (a.cls, a.cls + {TARGETS})),
c as (select cls, count(*) filter (where y and p) as tp, count(*) filter (where not y and p) as fp, count(*) filter (where y and not p) as fn, count(*) filter (where not y and not p) as tn from z group by cls),
f as (select cls, tp::double as tp, fp::double as fp, fn::double as fn, tn::double as tn, {figures_sql()} from c)
unpivot f on tp, fp, fn, tn, precision, recall, f1 into name metric value value""",
    "threshold_curve": f"with {_fixed_sql('all')} select cls, i, threshold, tp, fp, tn, fn, precision, recall, f1 from t_all",
    "threshold_sweep_best": f"with {_fixed_sql('all')} select cls, i, threshold, tp, fp, tn, fn, precision, recall, f1 from b_all",
    "threshold_summary": f"""with {_fixed_sql("all")}, x as (select cls::varchar as cls, threshold, f1, precision, recall from b_all union all select 'Average', avg(threshold), avg(f1), avg(precision), avg(recall) from b_all)
select cls, {", ".join(f"{micro_sql(c)} as {c}" for c in ("threshold", "f1", "precision", "recall"))} from x""",
    "linspace_sweep_best": f"with {_pairs_sql('all')}, {_spaced_sql('q_all', 'cls', 'select cls, min(sim) as lo, max(sim) as hi, 200 as n from q_all group by cls')} select cls, {_BEST} from {_TARGETS_SQL} left join b using (cls)",
    "overlap_sweep_best": f"with {_pairs_sql('all')}, x as (select cls, sim * 100 as sim, y from q_all), {_spaced_sql('x', 'cls', _overlap_ranges('x', 'cls'))} select cls, {_BEST} from {_TARGETS_SQL} left join b using (cls)",
    "union_ensemble_metrics": f"""with {_UNION}, c as (select cls, count(*) filter (where label = cls and (en_pass or cn_pass)) as tp, count(*) filter (where label <> cls and (en_pass or cn_pass)) as fp,
  count(*) filter (where label = cls and not (en_pass or cn_pass)) as fn from un group by cls) select *, {figures_sql()} from c""",
    "union_sample_counts": f"""with {_UNION} select cls, count(en_sim) as en_total, count(cn_sim) as cn_total, count(*) filter (where en_pass) as en_correct, count(*) filter (where cn_pass) as cn_correct,
  count(*) filter (where en_pass and cn_pass) as both, count(*) filter (where en_pass or cn_pass) as union_total from un where label = cls group by cls""",
    "union_export": f"with {_UNION} select cls, name, {micro_sql('en_sim')} as en_sim, {micro_sql('cn_sim')} as cn_sim, en_pass, cn_pass, source_path from un where label = cls and (en_pass or cn_pass)",
    "union_marks": f"""with {_pairs_sql('en')}, {_pairs_sql('cn')} select cls, vec_id, case when a.sim >= 0.5 then 'yes' else 'no' end as en_mark, coalesce({micro_sql('a.sim')}::varchar, 'N/A') as en_text,
  case when b.sim >= 0.5 then 'yes' else 'no' end as cn_mark, coalesce({micro_sql('b.sim')}::varchar, 'N/A') as cn_text from q_en a full join (select * from q_cn where vec_id % 7 <> 0) b using (cls, vec_id)""",
    "or_predictions": f"with {_pairs_sql('en')}, {_pairs_sql('cn')} select vec_id, a.label, cls, case when a.sim >= 0.5 or b.sim >= 0.5 then 0 else 1 end::int as pred from q_en a join q_cn b using (vec_id, cls)",
    "cascade_filter": """with l as (select doc_id, max(quality) as q, max(toxic) as t from labels group by doc_id)
select doc_id, n_chars >= 500 as "first", n_chars >= 500 and coalesce(q = 1 and t = 0, false) as "final" from documents left join l using (doc_id)""",
    "cascade_counts": """with l as (select doc_id, max(quality) as q, max(toxic) as t from labels group by doc_id),
c as (select n_chars >= 500 as a, n_chars >= 500 and coalesce(q = 1 and t = 0, false) as b from documents left join l using (doc_id))
select count(*) as seen, count(*) filter (where a) as "first", count(*) filter (where b) as confirmed, count(*) filter (where a and not b) as demoted from c""",
    "fewshot_sample": f"select vec_id, label from (select *, row_number() over (partition by label order by md5('shots:' || vec_id), vec_id) as k from embeddings) where k <= {SHOTS}",
    "prototype_centroid": f"with {_S} select cls, (j - 1)::int as i, {micro_sql('pv[j]')} as x_micro from p_all, range(1, 65) t(j)",
    "image_text_mean": f"""with {scores_sql("en")}, {scores_sql("cn")}, h as (select a.label as cls, list_transform(list_zip(a.v, b.v), lambda q: (q[1] + q[2]) / 2) as v from i_en a join i_cn b using (vec_id))
select cls, (j - 1)::int as i, {micro_sql("sum(floor(v[j] * 1e6)::bigint)::double / 1e6 / count(*)::double")} as x_micro from h, range(1, 33) t(j) group by cls, j""",
    "cache_key_means": f"""with {scores_sql("en")}, {scores_sql("cn")}, b as (select vec_id, v from i_en union all select vec_id, v from i_cn),
m as (select vec_id, list(m order by j) as m from (select vec_id, j, sum(floor(v[j] * 1e6)::bigint)::double / 1e6 / count(*)::double as m from b, range(1, 33) t(j) group by vec_id, j) group by vec_id),
u as (select vec_id, {unit_sql("m")} as v from m) select u.vec_id as key_id, label, (j - 1)::int as i, {micro_sql("u.v[j]")} as x_micro from u join i_en using (vec_id), range(1, 33) t(j)""",
    "looked_up": f"with {_S} select vec_id, label, {micro_sql('v[1]')} as x_micro from r_all",
    "trimmed_prototype": f"""with {_S}, {_TRIM}, kept as (select i.label, v from i_all i join far using (vec_id) join edge on edge.label = i.label where d <= e + 1e-12)
select label as cls, (j - 1)::int as i, {micro_sql("sum(floor(v[j] * 1e6)::bigint)::double / 1e6 / count(*)::double")} as x_micro from kept, range(1, 65) t(j) group by label, j""",
    "outlier_trim": f"with {_S}, {_TRIM} select vec_id, label, d <= e + 1e-12 as kept from far join edge using (label)",
    "cache_logits": f"""with {_CACHE}, c as (select vec_id, cls, list_sum(list(exp(-({BETA}::double - {BETA}::double * a)) order by key_id)) * 10 as c from k group by vec_id, cls)
select vec_id, cls, {micro_sql(f"(sim * 100 + {ALPHA}::double * coalesce(c, 0))")} as logit_micro from s_all left join c using (vec_id, cls)""",
    "grid_search": f"""with {_CACHE}, gr as (select b as bi, a as ai, b * {GRID_SCALE[0]}::double / {GRID_STEPS[0]} + 0.01::double as beta, a * {GRID_SCALE[1]}::double / {GRID_STEPS[1]} + 0.01::double as alpha from range(0, {GRID_STEPS[0]}) x(b), range(0, {GRID_STEPS[1]}) y(a)),
be as (select distinct bi, beta from gr),
c as (select bi, vec_id, cls, list_sum(list(exp(-(beta - beta * a)) order by key_id)) * 10 as c from k cross join be where cls < {TARGETS} group by bi, vec_id, cls),
x as (select gr.bi, ai, s.cls, label = s.cls as y, sim * 100 + alpha * coalesce(c, 0) as sim from s_all s cross join gr left join c on c.bi = gr.bi and c.vec_id = s.vec_id and c.cls = s.cls where s.cls < {TARGETS}),
{_spaced_sql("x", "bi, ai, cls", _overlap_ranges("x", "bi, ai, cls"))},
mean as (select bi, ai, sum({micro_sql("coalesce(f1, 0)")})::double / {TARGETS}::double as f1 from (select bi, ai, cls from gr cross join {_TARGETS_SQL}) left join b using (bi, ai, cls) group by bi, ai)
select bi::int as bi, ai::int as ai, floor(f1 + 0.5)::bigint as f1_micro from mean order by f1 desc, bi, ai limit 1""",
}
