"""Tables of a directory, and the stand-ins for images, encoders and class folders that the queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.vectors import doubles, unit

SHOTS = 16
#: Classes 0 ... 4 are asked for; class i + 5 is the one that class i is confused with.
TARGETS = 5
#: Encoders: first component and number of components. The two halves are two models that see the same items.
VIEWS = {"all": (1, 64), "en": (1, 32), "cn": (33, 32)}
# fixed values: file endings given to documents
ENDINGS = ("jpg", "png", "jpeg", "PNG", "gif", "txt", "webp", "bmp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents. A table in fewer parts than there are cores is dealt out first, or a few tasks would cut all its texts into
    words; a larger one is read as it is, without a shuffle."""
    rows = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def vectors(spark: SparkSession, sf_dir: str, view: str = "all") -> DataFrame:
    """(vec_id, label, vec): unit vectors of one encoder."""
    first, n = VIEWS[view]
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", unit(doubles(F.slice("embedding", first, n))).alias("vec"))


def targets(spark: SparkSession) -> DataFrame:
    """(cls) of the classes that are asked for."""
    return spark.range(TARGETS).select(F.col("id").cast("int").alias("cls"))


def hex_digit(text: Column, place: int = 1) -> Column:
    """The value of one hexadecimal digit of a text's md5."""
    return F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(text), place, 1)) - 1


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, label, name, size, doc_id, content): every document as a file in the folder of its class (its language)."""
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), hex_digit(F.col("doc_id").cast("string")) % len(ENDINGS) + 1)
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), ending)
    docs = texts(spark, sf_dir).withColumn("name", name)
    return docs.select(F.concat(F.lit("corpus/"), "lang", F.lit("/"), "name").alias("path"), F.col("lang").alias("label"), "name", F.col("n_chars").alias("size"), "doc_id", F.col("text").alias("content"))


# ---- the same in SQL


def unit_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"


def scores_sql(view: str) -> str:
    """CTEs i_ (items), r_ (references), p_ (prototypes) and s_ (scores of the rest) of a view."""
    first, n = VIEWS[view]
    return f"""
d_{view} as (select vec_id, label, list_transform(embedding[{first}:{first + n - 1}], lambda x: x::double) as w from embeddings),
i_{view} as (select vec_id, label, {unit_sql("w")} as v from d_{view}),
r_{view} as (select * from (select *, row_number() over (partition by label order by md5('shots:' || vec_id), vec_id) as k from i_{view}) where k <= {SHOTS}),
u_{view} as (select label, {unit_sql("v")} as v from r_{view}),
m_{view} as (select cls, list(m order by j) as m from (select label as cls, j, sum(floor(v[j] * 1e6)::bigint)::double / 1e6 / count(*)::double as m from u_{view}, range(1, {n + 1}) t(j) group by label, j) group by cls),
p_{view} as (select cls, {unit_sql("m")} as pv from m_{view}),
s_{view} as (select vec_id, label, cls, list_sum(list_transform(list_zip(v, pv), lambda q: q[1] * q[2])) as sim from (select * from i_{view} anti join r_{view} using (vec_id)) cross join p_{view})"""


FILES_SQL = f"""
f as (select 'corpus/' || lang || '/' || name as path, lang as label, name, n_chars as size, doc_id, text as content from
  (select *, source || '_' || doc_id || '.' || ([{", ".join(f"'{e}'" for e in ENDINGS)}])[(instr('0123456789abcdef', substr(md5(doc_id::varchar), 1, 1)) - 1) % {len(ENDINGS)} + 1] as name from documents))"""


def micro_sql(x: str) -> str:
    return f"floor({x} * 1e6 + 0.5)::bigint"


def figures_sql(guarded: bool = True) -> str:
    """precision, recall, f1 from tp, fp, fn in nested selects' order."""
    p, r = "tp::double / nullif(tp + fp, 0)", "tp::double / nullif(tp + fn, 0)"
    if guarded:
        p, r = f"coalesce({p}, 0)", f"coalesce({r}, 0)"
    f = f"(2 * ({p}) * ({r})) / nullif(({p}) + ({r}), 0)"
    return f"{p} as precision, {r} as recall, {f'coalesce({f}, 0)' if guarded else f} as f1"
