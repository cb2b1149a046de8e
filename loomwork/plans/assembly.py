"""Queries that draw, allot and assemble training samples, and audit the result. Classes are the documents' languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import paths
from loomwork.operators import balance, sampling
from loomwork.plans.tables import FILES_SQL, TARGETS, files, table

#: Size of a balanced subset and of a mix of cross, simple and hard negatives.
SUBSET, MIX = 120, 100
# fixed values: exact question templates by class
TEMPLATES = {"Is this an image of an en?": "en", "Is this an image of a fr?": "fr", "Is this an image of a de?": "de", "Is this an image of a es?": "es"}
#: Order of the classes where the first that is found wins.
ORDER = ["en", "fr", "de", "es"]


def _items(spark, sf_dir) -> DataFrame:
    """(cls, path)"""
    return files(spark, sf_dir).select(F.col("label").alias("cls"), "path")


def _sizes(items: DataFrame) -> DataFrame:
    return items.groupBy("cls").agg(F.count("*").alias("n"))


def positives_nested(spark, sf_dir):
    """Every file with its question and a yes, through the nested form and flat again."""
    asked = F.concat(F.lit("Does this image contain a "), F.col("cls"), F.lit("?"))
    sample = sampling.conversation(F.md5(F.concat_ws("|", "path", asked)), F.col("path"), asked, F.lit("Yes"), F.col("cls"))
    rows = _items(spark, sf_dir).select(F.inline(F.array(sample)))
    return rows.select("id", "image", rows["conversations"][0]["value"].alias("question"), rows["conversations"][1]["value"].alias("answer"), F.coalesce("metadata.true_source_category", F.lit("unknown_source")).alias("source"))


def cross_negatives(spark, sf_dir):
    items = _items(spark, sf_dir)
    return sampling.cross_negatives(items, sampling.cross_quotas(_sizes(items)), "path")


def cross_negatives_topup(spark, sf_dir):
    items = _items(spark, sf_dir)
    sizes = _sizes(items)
    return sampling.top_up(items, sampling.cross_quotas(sizes), sizes, "path")


def simple_negatives(spark, sf_dir):
    """Pages as easy negatives, dealt out to the classes in order, each page once; late classes come short."""
    requests = _sizes(_items(spark, sf_dir)).select("cls", F.expr("n div 4").alias("quota"), F.col("cls").alias("turn"))
    pool = table(spark, sf_dir, "pages").select("page_id")
    return sampling.dealt(requests, pool, [], "page_id", "simple").select("cls", "page_id")


def shuffled_simple_negatives(spark, sf_dir):
    """The same with the classes' requests served in a random order."""
    requests = _sizes(_items(spark, sf_dir)).select("cls", F.expr("n div 4").alias("quota")).withColumn("turn", sampling.draw("serve", "cls"))
    pool = table(spark, sf_dir, "pages").select("page_id")
    return sampling.dealt(requests, pool, [], "page_id", "simple").select("cls", "page_id")


def hard_negatives(spark, sf_dir):
    """Vectors of the class that a target is confused with, half as many as the target has."""
    items = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    quotas = items.where(F.col("label") < TARGETS).groupBy("label").agg(F.count("*").alias("n")).select(F.col("label").alias("cls"), F.expr("n div 2").alias("quota"))
    pool = items.where(F.col("label") >= TARGETS).withColumn("cls", F.col("label") - TARGETS).join(F.broadcast(quotas), "cls")
    return sampling.pick_per_group(pool, ["cls"], "vec_id", "quota", "hard").select("cls", "vec_id")


def balanced_positives(spark, sf_dir):
    items = _items(spark, sf_dir)
    # as a column, so that ranks are counted in two steps: the smallest class may be large too
    least = F.lit(balance.smallest_class(_sizes(items)))
    return sampling.pick_per_group(items.withColumn("_least", least), ["cls"], "path", "_least", "balance").drop("_least")


def unique_cross_negatives(spark, sf_dir):
    """Cross negatives in which no file is used twice: requests for a source are served in a random order from what is left."""
    items = _items(spark, sf_dir)
    requests = sampling.cross_quotas(_sizes(items), 4).withColumn("turn", sampling.draw("turns", "target", "source"))
    return sampling.dealt(requests, items.withColumnRenamed("cls", "source"), ["source"], "path", "unique").select("target", "source", "path")


def _subset(spark, sf_dir):
    return sampling.balanced_subset(cross_negatives(spark, sf_dir).withColumn("id", F.concat_ws("|", "target", "path")), ["target", "source"], "id", SUBSET, "subset")


def balanced_subset(spark, sf_dir):
    return _subset(spark, sf_dir).select("target", "source", "path")


def mixed_dataset(spark, sf_dir):
    """Cross, simple and hard negatives by ratio, shuffled: their part, key and place."""
    cross, simple, hard = sampling.ratio_counts(MIX)
    parts = [
        (unique_cross_negatives(spark, sf_dir).select(F.lit("cross").alias("part"), F.col("path").alias("key")), cross),
        (simple_negatives(spark, sf_dir).select(F.lit("simple").alias("part"), F.col("page_id").cast("string").alias("key")), simple),
        (hard_negatives(spark, sf_dir).select(F.lit("hard").alias("part"), F.col("vec_id").cast("string").alias("key")), hard),
    ]
    drawn = [df.orderBy(sampling.draw("mix", "key"), "key").limit(n) for df, n in parts]
    mixed = drawn[0].unionByName(drawn[1]).unionByName(drawn[2])
    return sampling.ranked_by_draw(mixed.withColumn("id", F.concat_ws("|", "part", "key")).withColumn("one", F.lit(1)), ["one"], "mix", "id", "place").select("part", "key", F.col("place").cast("long").alias("place"))


def _classes(spark, sf_dir):
    return _sizes(_items(spark, sf_dir)).select("cls")


def balance_check(spark, sf_dir):
    return balance.question_balance(_subset(spark, sf_dir), "target", _classes(spark, sf_dir))


def source_balance_check(spark, sf_dir):
    return balance.source_balance(_subset(spark, sf_dir), "target", "source", _classes(spark, sf_dir))


def negative_distribution(spark, sf_dir):
    return balance.distribution(cross_negatives(spark, sf_dir), "source", "target")


def repeated_negatives(spark, sf_dir):
    """Pairs of a class and a file that the top-up with replacement drew more than once."""
    return balance.repeated(cross_negatives_topup(spark, sf_dir), ["target", "path"])


def question_category(spark, sf_dir):
    """What questions are about, by template, by the first class name found, and by what follows a phrase."""
    asked = F.array(F.concat(F.lit("Is this an image of "), F.when(F.col("cls") == "en", "an ").otherwise("a "), F.col("cls"), F.lit("?")), F.concat(F.lit("Does this image contain a "), F.col("cls"), F.lit("?")), F.col("path"))
    rows = _items(spark, sf_dir).select("path", F.posexplode(asked).alias("form", "q"))
    return rows.select("path", "form", paths.question_category(F.col("q"), TEMPLATES, ORDER).alias("category"), paths.asked_after(F.col("q")).alias("asked"))


def conversation_pairs(spark, sf_dir):
    """Each user turn with the assistant turn that follows it; joined by conversation and turn, so a long conversation is no single task."""
    turns = table(spark, sf_dir, "conversations")
    users = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return users.join(answers, ["conv_id", "turn"]).select("conv_id", "turn", "question", "answer", paths.says_yes(F.col("answer")).alias("says_yes"))


def distinct_paths(spark, sf_dir):
    """One file for each path, whatever its case."""
    folded = _items(spark, sf_dir).withColumn("path", F.regexp_replace("path", "_[0-9]+", ""))
    return sampling.distinct_paths(folded).select("path")


QUERIES = {
    f.__name__: f
    for f in (
        positives_nested, cross_negatives, cross_negatives_topup, simple_negatives, shuffled_simple_negatives, hard_negatives, balanced_positives, unique_cross_negatives,
        balanced_subset, mixed_dataset, balance_check, source_balance_check, negative_distribution, repeated_negatives, question_category, conversation_pairs, distinct_paths,
    )
}

_ITEMS = f"{FILES_SQL}, it as (select label as cls, path from f), sz as (select cls, count(*) as n from it group by cls)"


def _quotas(divisor: int = 1) -> str:
    return f"""{_ITEMS}, pr as (select t.cls as target, s.cls as source, t.n // {divisor} as need, s.n as n, count(*) over (partition by t.cls) as k, row_number() over (partition by t.cls order by s.cls) as i
  from sz t join sz s on t.cls <> s.cls), qu as (select target, source, n, need // k + (i <= need % k)::int as quota from pr)"""


_CROSS = f"{_quotas()}, cr as (select target, source, path from (select target, source, path, quota, row_number() over (partition by target, source order by md5('cross:' || target || ':' || path), path) as r from it join qu on it.cls = qu.source) where r <= quota)"
_TOPUP = f"""{_quotas()}, pl as (select cls as source, path, row_number() over (partition by cls order by md5('topup:' || path), path) as place from it),
ask as (select target, source, n, unnest(range(1, quota - n + 1))::int as copy from qu where quota > n),
spot as (select target, source, copy, (('0x' || substr(md5('topup:' || target || ':' || source || ':' || copy), 1, 8))::bigint % n) + 1 as place from ask),
tu as (select target, source, path, copy from spot join pl using (source, place))"""
_UNIQUE = f"""{_quotas(4)}, rq as (select *, sum(quota) over (partition by source order by md5('turns:' || target || ':' || source) rows between unbounded preceding and current row) as hi from qu),
ra as (select cls as source, path, row_number() over (partition by cls order by md5('unique:' || path), path) as r from it),
uc as (select target, source, path from rq join ra using (source) where r > hi - quota and r <= hi)"""
_SIMPLE = """sr as (select cls, n // 4 as quota, sum(n // 4) over (order by cls rows between unbounded preceding and current row) as hi from sz),
sp as (select page_id, row_number() over (order by md5('simple:' || page_id), page_id) as r from pages),
si as (select cls, page_id from sr join sp on r > hi - quota and r <= hi)"""
_HARD = f"""hq as (select label as cls, count(*) // 2 as quota from embeddings where label < {TARGETS} group by label),
ha as (select cls, vec_id from (select cls, vec_id, quota, row_number() over (partition by cls order by md5('hard:' || vec_id), vec_id) as r from embeddings e join hq on e.label = hq.cls + {TARGETS}) where r <= quota)"""
_SUBSET = f"""{_CROSS}, g as (select target, source, count(*) as n from cr group by all), gq as (select target, source, {SUBSET} // count(*) over () + (row_number() over (order by md5('subset:' || target || ':' || source)) <= {SUBSET} % count(*) over ())::int as quota from g),
su as (select target, source, path from (select *, row_number() over (partition by target, source order by md5('subset:' || target || '|' || path), target || '|' || path) as r from cr) join gq using (target, source) where r <= quota or (select count(*) from cr) <= {SUBSET})"""

_CROSS_N, _SIMPLE_N, _HARD_N = sampling.ratio_counts(MIX)
ORACLES = {
    "positives_nested": f"with {_ITEMS} select md5(path || '|' || 'Does this image contain a ' || cls || '?') as id, path as image, 'Does this image contain a ' || cls || '?' as question, 'Yes' as answer, cls as source from it",
    "cross_negatives": f"with {_CROSS} select * from cr",
    "cross_negatives_topup": f"with {_TOPUP} select * from tu",
    "simple_negatives": f"with {_ITEMS}, {_SIMPLE} select * from si",
    "shuffled_simple_negatives": f"with {_ITEMS}, {_SIMPLE.replace('order by cls', 'order by md5($$serve:$$ || cls)')} select * from si",
    "hard_negatives": f"with {_HARD} select * from ha",
    "balanced_positives": f"with {_ITEMS} select cls, path from (select *, row_number() over (partition by cls order by md5('balance:' || path), path) as r from it) where r <= (select min(n) from sz)",
    "unique_cross_negatives": f"with {_UNIQUE} select * from uc",
    "balanced_subset": f"with {_SUBSET} select * from su",
    "mixed_dataset": f"""with {_UNIQUE}, {_SIMPLE}, {_HARD}, mx as (
  (select 'cross' as part, path as key from uc order by md5('mix:' || path), path limit {_CROSS_N}) union all
  (select 'simple', page_id::varchar from si order by md5('mix:' || page_id), page_id::varchar limit {_SIMPLE_N}) union all
  (select 'hard', vec_id::varchar from ha order by md5('mix:' || vec_id), vec_id::varchar limit {_HARD_N}))
select part, key, row_number() over (order by md5('mix:' || part || '|' || key), part || '|' || key) as place from mx""",
    "balance_check": f"""with {_SUBSET}, c as (select cls, count(target) as n from sz left join su on target = cls group by cls)
select sum(n)::bigint as total, sum(n) = 0 or bool_and(abs(n - (select count(*) from su) / (select count(*) from sz)::double) <= 1.001) as balanced from c""",
    "source_balance_check": f"""with {_SUBSET}, sp as (select t.cls as question, s.cls as src, (select count(*) from su where target = t.cls and source = s.cls) as n from sz t cross join sz s),
fa as (select question, sum(n)::bigint as total, sum(n) filter (where question = src) as own, count(*) filter (where question <> src) as k, min(n) filter (where question <> src) as low, max(n) filter (where question <> src) as high from sp group by question)
select question, total, own = 0 and high - total / k::double <= 1.001 and total / k::double - low <= 1.001 as balanced from fa""",
    "negative_distribution": f"with {_CROSS} select source, target, count(*) as n from cr group by grouping sets ((source, target), (target))",
    "repeated_negatives": f"with {_TOPUP} select target, path, count(*) as n from tu group by target, path having count(*) > 1",
    "question_category": f"""with {_ITEMS}, q as (select path, 0 as form, 'Is this an image of ' || case when cls = 'en' then 'an ' else 'a ' end || cls || '?' as q from it union all select path, 1, 'Does this image contain a ' || cls || '?' from it union all select path, 2, path from it)
select path, form, case {" ".join(f"when q = '{t}' then '{c}'" for t, c in TEMPLATES.items())} {" ".join(f"when contains(lower(q), '{c}') then '{c}'" for c in ORDER)} else 'unknown' end as category,
  case when contains(q, 'contain a ') then rtrim(split_part(q, 'contain a ', 2), '?') end as asked from q""",
    "conversation_pairs": "select u.conv_id, u.turn, u.text as question, a.text as answer, contains(lower(a.text), 'yes') as says_yes from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'",
    "distinct_paths": f"with {_ITEMS} select min(p) as path from (select regexp_replace(path, '_[0-9]+', '', 'g') as p from it) group by lower(p)",
}
