"""Queries that find duplicates and leaks, and plan deletions and renames."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from loomwork.functions import paths
from loomwork.functions.grids import packed_bits
from loomwork.operators import dedup, sampling
from loomwork.operators.contamination import contained
from loomwork.plans.tables import ENDINGS, FILES_SQL, files, table, texts
from loomwork.sources.images import class_index as index_of
from loomwork.sources.images import first_listed as listed_of
from loomwork.sources.images import mapped
from loomwork.sources.images import paired_folders as pairs_of
from loomwork.sources.images import unmapped_folders as unmapped_of
from loomwork.sources.ingest import feature_table, ingest
from loomwork.sources.sinks import rename_manifest as manifest
from loomwork.storage import checkpointed, shared_folder

#: The beginning of the names of the files (by source) that all others are compared with.
REFERENCE = "src1"
DISTANCE = 5
FOLDER_MAP = [("en", "src1"), ("fr", "src2"), ("de", "nowhere"), ("xx", "src3")]
#: Each hash compares the counts of words in 64 pairs of buckets; the buckets come from two hexadecimal digits of the words' md5.
HASHES = {"phash": 1, "dhash": 3, "whash": 5}


def _candidates(spark, sf_dir):
    return files(spark, sf_dir).where(~F.col("name").startswith(REFERENCE))


def _reference(spark, sf_dir):
    return files(spark, sf_dir).where(F.col("name").startswith(REFERENCE))


def exact_dup_delete(spark, sf_dir):
    """Files outside the reference folder whose content it has."""
    content = F.md5(F.col("content"))
    found = dedup.content_duplicates(_candidates(spark, sf_dir).withColumn("md5", content), _reference(spark, sf_dir).withColumn("md5", content), "md5", "path", "doc_id")
    return dedup.delete_manifest(found, "path", "same content", F.col("matched"))


def exact_dup_keep(spark, sf_dir):
    content = F.md5(F.col("content"))
    return dedup.content_keepers(_candidates(spark, sf_dir).withColumn("md5", content), _reference(spark, sf_dir).withColumn("md5", content), "md5").select("path", "md5")


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, leads): for each hash and each of its 64 bits, how many more words bucket i holds than bucket i + 64; equal keys of a batch are one row."""
    for batch in batches:
        keys, words = batch.column(0).dictionary_encode("encode"), batch.column(1)
        rows = keys.indices.to_numpy(zero_copy_only=False)[pc.list_parent_indices(words).to_numpy(zero_copy_only=False)]
        coded = words.flatten().dictionary_encode()
        # a word's buckets come from the first 24 bits of its md5
        m = np.array([int.from_bytes(md5(w.encode()).digest()[:3], "big") for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        leads = np.zeros((len(keys.dictionary), len(HASHES), 64), np.int32)
        for i, place in enumerate(HASHES.values()):
            found = np.bincount(rows * 128 + (m >> (16 - 4 * (place - 1)) & 127), minlength=128 * len(leads)).reshape(-1, 2, 64)
            leads[:, i] = found[:, 0] - found[:, 1]
        width = leads[0].size if len(leads) else 0
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(leads) + 1, dtype=np.int32) * width), pa.array(leads.ravel()))
        yield pa.RecordBatch.from_arrays([keys.dictionary, lists], ["key", "leads"])


def perceptual_hashes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, phash, dhash, whash): for each hash, bit i says that bucket i holds more words than bucket i + 64.

    Words are counted in the task that reads their text, so that one short array a text is shuffled and none of its words. Rows of one key
    count as one text; a key without words has no row.
    """
    words = rows.select(key, F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("_words")).where(F.size("_words") > 0)
    leads = words.mapInArrow(_leads, StructType([StructField(key, rows.schema[key].dataType), StructField("_leads", ArrayType(IntegerType()))]))
    grouped = leads.groupBy(key).agg(F.collect_list("_leads").alias("_l"))
    several = F.aggregate("_l", F.array_repeat(F.lit(0).cast("long"), 64 * len(HASHES)), lambda total, x: F.zip_with(total, x, lambda a, b: a + b))
    ahead = F.when(F.size("_l") == 1, F.transform(F.get("_l", F.lit(0)), lambda x: x > 0)).otherwise(F.transform(several, lambda x: x > 0))
    return grouped.select(key, *[packed_bits(F.slice(ahead, 64 * i + 1, 64)).alias(h) for i, h in enumerate(HASHES)])


def _hashed(spark, sf_dir):
    """Stored, as both sides of a join are made of them."""
    rows = files(spark, sf_dir)
    return checkpointed(rows.drop("content").join(perceptual_hashes(rows, "doc_id", "content"), "doc_id"))


def perceptual_hash(spark, sf_dir):
    return perceptual_hashes(files(spark, sf_dir), "doc_id", "content")


def hamming_semi_join(spark, sf_dir):
    """Files of the other folders within the distance of a file of the reference folder."""
    rows = _hashed(spark, sf_dir)
    found = dedup.near_leaks(rows.where(~F.col("name").startswith(REFERENCE)), rows.where(F.col("name").startswith(REFERENCE)), DISTANCE, "dhash", "path", "doc_id")
    return found.select("path", "matched")


def greedy_near_dup(spark, sf_dir):
    """Every file with the representative it is a near duplicate of (null: it is one), larger files first."""
    return dedup.greedy_clusters(_hashed(spark, sf_dir), "doc_id", list(HASHES), [-F.col("size")], DISTANCE)


def contamination(spark, sf_dir):
    """Pairs of a document and a benchmark item that it contains."""
    return contained(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


def ext_filter_manifest(spark, sf_dir):
    """Images that aren't of a kept format, and the names they would be converted to."""
    rows = files(spark, sf_dir).where(paths.other_image(F.col("path")) | paths.ending(F.col("path")).isin(*paths.CONVERTED_ENDINGS))
    return manifest(rows, "path", paths.with_ending(F.col("path")))


def rename_manifest(spark, sf_dir):
    """Files of each folder numbered anew in a random order."""
    named = sampling.sequential_names(files(spark, sf_dir).drop("content"), "label", "name", paths.ending(F.col("name")), sampling.draw("rename", "name"))
    return manifest(named, "path", F.concat(F.lit("corpus/"), F.col("label"), F.lit("/"), F.col("new_name")))


def merge_rename(spark, sf_dir):
    """Files of each folder go on after its largest number (of sources named like files: src + number + .jpg), in order of names."""
    rows = files(spark, sf_dir).drop("content")
    index = paths.numbered(F.concat(F.regexp_extract("name", "^([a-z]+[0-9]+)_", 1), F.lit(".jpg")), F.lit("src"))
    most = rows.groupBy("label").agg(F.coalesce(F.max(index), F.lit(0)).alias("last"))
    named = sampling.sequential_names(rows.join(F.broadcast(most), "label"), "label", "name", F.lit("jpg"), F.col("name"), "last")
    return named.select("path", "new_name")


def class_index(spark, sf_dir):
    return index_of(table(spark, sf_dir, "documents"), "source")


def _folder_map(spark):
    """Folders and the folders that they go to; some of either side don't exist."""
    return spark.createDataFrame(FOLDER_MAP, "folder string, target string")


def mapped_classes(spark, sf_dir):
    """How many files the targets of a class map have, which stands for its folders: one language against all others."""
    classes = spark.createDataFrame([("positive", "en"), *[("rest", x) for x in ("fr", "de", "es")]], "target string, folder string")
    return mapped(files(spark, sf_dir).select("label"), classes).groupBy("target").agg(F.count("*").alias("files"))


def paired_folders(spark, sf_dir):
    """The pairs of the folder map whose both sides have files: languages on the left, sources on the right."""
    return pairs_of(_folder_map(spark), files(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("source").alias("label")))


def unmapped_folders(spark, sf_dir):
    return unmapped_of(files(spark, sf_dir), _folder_map(spark))


def first_listed(spark, sf_dir):
    """Every file with the first class in whose list it stands: long files are listed under "long", those of some folders under the folder too."""
    rows = files(spark, sf_dir)
    long = rows.where(F.col("size") >= 2000).select(F.lit(0).alias("turn"), F.lit("long").alias("category"), F.col("path").alias("listed"))
    own = rows.where(F.col("label").isin("en", "fr")).select(F.lit(1).alias("turn"), F.col("label").alias("category"), F.col("path").alias("listed"))
    return listed_of(rows.select("path", paths.easy_negative(F.col("path"), "_1").alias("easy")), long.unionByName(own))


def relabelled(spark, sf_dir):
    """Files by the labels that count, all others together, with the question of each."""
    label = paths.relabelled(F.col("label"), ["en", "de"])
    question = paths.class_question(F.col("label"), {"en": "Is it English?", "de": "Is it German?", "others": "Is it anything else?"})
    return files(spark, sf_dir).select(label.alias("label")).groupBy("label").agg(F.count("*").alias("files")).withColumn("question", question)


def url_files(spark, sf_dir):
    """Base name, ending and folder of the pages' addresses, and whether they look like pages."""
    bare = F.regexp_replace("url", r"[?#].*$", "")
    rows = table(spark, sf_dir, "pages").select("page_id", bare.alias("p"))
    return rows.select("page_id", paths.basename(F.col("p")).alias("name"), paths.ending(F.col("p")).alias("ending"), paths.folder(F.col("p")).alias("folder"), paths.is_image(F.col("p"), ("html", "htm")).alias("is_page"))


def ingested_contents(spark, sf_dir):
    """The different contents of the documents, as a stream of their files brings them into a feature table."""
    source = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(source).schema
    base = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    # as a pattern, which may be one file or a folder of them
    ingest(spark, f"{source}*", schema, f"{base}/table", f"{base}/checkpoint", F.col("text"), "doc_id")
    return feature_table(spark, f"{base}/table", schema).select("content_hash", F.length("text").cast("long").alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        exact_dup_delete, exact_dup_keep, perceptual_hash, hamming_semi_join, greedy_near_dup, contamination, ext_filter_manifest, rename_manifest,
        merge_rename, ingested_contents, class_index, mapped_classes, paired_folders, unmapped_folders, first_listed, relabelled, url_files,
    )
}

_REF = "(select content, arg_max(path, doc_id) as matched from f where name like 'src1%' and content is not null group by content)"
_BUCKETS = ", ".join(f"((instr('0123456789abcdef', substr(m, {p}, 1)) - 1) * 16 + instr('0123456789abcdef', substr(m, {p + 1}, 1)) - 1) % 128 as {h}" for h, p in HASHES.items())
_BITS = "\n".join(
    f", {h} as (select doc_id, bit_or(case when a > z then v else 0 end) as {h} from (select doc_id, {h} % 64 as b, count(*) filter (where {h} < 64) as a, count(*) filter (where {h} >= 64) as z from k group by all) "
    f"join pw using (b) group by doc_id)"
    for h in HASHES
)
_HASHED = f"""{FILES_SQL}, w as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) as w from f),
md as (select doc_id, md5(w) as m from w), k as (select doc_id, {_BUCKETS} from md),
pw as (select i as b, case when i = 63 then (-9223372036854775808)::bigint else (2::hugeint ** i)::bigint end as v from range(0, 64) t(i)){_BITS},
hashed as (select f.*, phash, dhash, whash from f join phash using (doc_id) join dhash using (doc_id) join whash using (doc_id))"""

ORACLES = {
    "ingested_contents": "select distinct md5(text) as content_hash, length(text)::bigint as chars from documents where text is not null",
    "exact_dup_delete": f"with {FILES_SQL} select path, 'same content' as reason, matched as duplicate_of from f join {_REF} r using (content) where name not like 'src1%'",
    "exact_dup_keep": f"with {FILES_SQL} select path, md5(content) as md5 from f where name not like 'src1%' and (content is null or content not in (select content from f where name like 'src1%' and content is not null))",
    "perceptual_hash": f"with {_HASHED} select doc_id, phash, dhash, whash from hashed",
    "hamming_semi_join": f"""with {_HASHED}, fi as (select dhash, min(doc_id) as first, arg_max(path, doc_id) as p from hashed where name like 'src1%' group by dhash)
select path, arg_min(p, first) as matched from hashed h join fi on bit_count(xor(h.dhash, fi.dhash)) <= {DISTANCE} where name not like 'src1%' group by path""",
    "contamination": "select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text)",
    "ext_filter_manifest": f"""with {FILES_SQL}, e as (select path, lower(regexp_extract(name, '\\.([^.]+)$', 1)) as e from f),
m as (select path as old_path, regexp_replace(path, '\\.[^./]+$', '.jpg') as new_path from e where e in ('png', 'bmp', 'gif', 'tiff', 'webp'))
select *, count(*) over (partition by new_path) > 1 as collides from m""",
    "rename_manifest": f"""with {FILES_SQL}, m as (select path as old_path, 'corpus/' || label || '/' || label || row_number() over (partition by label order by md5('rename:' || name), name) || '.' || lower(regexp_extract(name, '\\.([^.]+)$', 1)) as new_path from f)
select *, count(*) over (partition by new_path) > 1 as collides from m""",
    "merge_rename": f"""with {FILES_SQL}, l as (select label, max(regexp_extract(name, '^src([0-9]+)_', 1)::int) as last from f group by label)
select path, label || (row_number() over (partition by label order by name) + last) || '.jpg' as new_name from f join l using (label)""",
    "mapped_classes": f"with {FILES_SQL} select case when label = 'en' then 'positive' else 'rest' end as target, count(*) as files from f group by target",
    "paired_folders": f"""with {FILES_SQL} select * from (values {", ".join(map(str, FOLDER_MAP))}) m(folder, target) where folder in (select label from f) and target in (select source from documents)""",
    "unmapped_folders": f"with {FILES_SQL} select label, count(*) as files from f where label not in ({', '.join(repr(a) for a, _ in FOLDER_MAP)}) group by label",
    "first_listed": f"""with {FILES_SQL} select path, contains(path, '_1') as easy, case when size >= 2000 then 'long' when label in ('en', 'fr') then label end as category from f""",
    "relabelled": f"""with {FILES_SQL}, r as (select case when label in ('en', 'de') then label else 'others' end as label from f)
select label, count(*) as files, case label when 'en' then 'Is it English?' when 'de' then 'Is it German?' else 'Is it anything else?' end as question from r group by label""",
    "class_index": "select source, (row_number() over (order by source) - 1)::int as idx from (select distinct source from documents where source is not null)",
    "url_files": r"""with p as (select page_id, regexp_replace(url, '[?#].*$', '') as p from pages), e as (select *, regexp_extract(p, '([^/]*)$', 1) as name from p)
select page_id, name, lower(regexp_extract(name, '\.([^.]+)$', 1)) as ending, regexp_extract(p, '([^/]+)/[^/]+$', 1) as folder, lower(regexp_extract(name, '\.([^.]+)$', 1)) in ('html', 'htm') as is_page from e""",
}
