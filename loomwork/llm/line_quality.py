"""Quality rules over documents and over the lines that a host repeats across documents, in DataFrame functions only.

Base rules look at one text each. The cross-document rule hashes normalised lines (lower case, white space squeezed), counts
for each host the documents that hold a line, and takes a line as boilerplate if more than `min_docs` documents of its host hold
it, however large the host is. Such lines are removed, and a document that keeps less than `least_kept` of its words
is depleted and rejected.

Each line counts once for a document before anything is shuffled, and counts are pre-aggregated, so a line that very many
documents hold is no hot key; texts are never shuffled, only hashes and counts.

Defined cases: a null text has no words, lines or symbols; a very long text is cut where its row is, in time in proportion to it but for the sort
of its windows; a null source is a host of its own; a row is a document, so repeated
rows count as often as they stand and each gets a row; null doc_ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import checkpointed

_BLANKS = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
#: Up to so many words, place and hash of a window share 64 bits and sort as plain numbers; in longer texts either has 64 bits of its own. At this
#: length 53 bits are left to the hash, so that two different windows of a text meet no likelier (2^-34) than in a text of 45,000 words with all 64.
_PACKED_WORDS = 1 << 10


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text that isn't null."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_repeated_window_words(docs: DataFrame, words: str, out: str) -> DataFrame:
    """`docs` with how many of the words (a column) stand in 3-word windows that are found twice or more in the same text.

    Windows are sorted by hash with their places, so that equal ones are neighbours. What lambdas look up is a column of
    its own each time; an expression in its place would be computed anew for every element.
    """
    w, n, bits = F.col(words), F.size(words), F.length(F.bin(F.size(words).cast("long")))
    few = (n >= 3) & (n <= _PACKED_WORDS)

    def window(x: Column, i: Column) -> Column:
        return F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))

    docs = docs.withColumn("_bits", bits)
    bits = F.col("_bits")
    packed = F.transform(w, lambda x, i: F.call_function("shiftleft", window(x, i), bits).bitwiseOR(i.cast("long")))
    pairs = F.transform(w, lambda x, i: F.struct(window(x, i).alias("h"), i.cast("long").alias("i")))
    docs = docs.withColumn("_packed", F.when(few, F.sort_array(F.slice(packed, 1, n - 2)))).withColumn("_pairs", F.when(n > _PACKED_WORDS, F.sort_array(F.slice(pairs, 1, n - 2))))

    def again(column: str, head) -> Column:
        at = F.col(column)
        return F.filter(at, lambda x, k: F.coalesce(head(x) == head(F.get(at, k - 1)), F.lit(False)) | F.coalesce(head(x) == head(F.get(at, k + 1)), F.lit(False)))

    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    short = F.transform(again("_packed", lambda x: F.call_function("shiftrightunsigned", x, bits)), lambda x: x.bitwiseAND(mask))
    places = F.coalesce(F.when(few, short), F.transform(again("_pairs", lambda x: x["h"]), lambda x: x["i"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))
    return docs.withColumn(out, F.when(n < 3, 0).otherwise(covered).cast("long")).drop("_bits", "_packed", "_pairs")


def with_line_words(docs: DataFrame, text: str, out: str) -> DataFrame:
    """`docs` with the words of each line that has any: the text is cut into lines, and each line into words, once."""
    lines = F.transform(F.split(text, "\n"), words_of)
    return docs.withColumn(out, F.filter(lines, lambda w: F.size(w) > 0))


def _line_key(words: Column, host: Column) -> Column:
    return F.xxhash64(host, F.lower(F.array_join(words, " ")))


def line_frequency_quality(docs: DataFrame, min_docs: int = 10, least_kept: float = 0.5) -> DataFrame:
    """One row per document with the base figures, base_failed, the words in frequent lines, and kept."""
    text, host = F.coalesce("text", F.lit("")), F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    docs = docs.select("doc_id", F.col("source"), text.alias("text"))
    keys = F.transform("_line_words", lambda w: _line_key(w, host))
    keyed = with_line_words(docs, "text", "_line_words").select("doc_id", F.xxhash64("text").alias("_t"), F.array_distinct(keys).alias("_keys"))
    lines = checkpointed(keyed.select("doc_id", "_t", F.explode("_keys").alias("_key")))
    often = lines.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > min_docs).select("_key")
    # the frequent keys of a document; repeated rows of it have the same ones
    struck = lines.join(often, "_key", "left_semi").groupBy(F.col("doc_id").alias("_d"), F.col("_t").alias("_s")).agg(F.collect_set("_key").alias("_often"))

    cut = docs.withColumn("_cut", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    cut = cut.withColumn("_line_words", F.transform("_cut", words_of)).withColumn("_words", F.flatten("_line_words"))
    counted = with_repeated_window_words(cut, "_words", "n_repeat_words")
    figures = counted.select(
        "doc_id",
        F.xxhash64("text").alias("_t"),
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("text", _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_cut") - F.size(F.array_distinct("_cut"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.transform("_line_words", lambda w: F.struct(_line_key(w, host).alias("k"), F.size(w).alias("n"))).alias("_lines"),
    )
    joined = figures.join(struck, figures["doc_id"].eqNullSafe(struck["_d"]) & (figures["_t"] == struck["_s"]), "left")
    frequent = F.aggregate("_lines", F.lit(0).cast("long"), lambda a, x: a + F.when(F.array_contains("_often", x["k"]), x["n"]).otherwise(0))
    out = joined.withColumn("n_frequent_words", F.when(F.col("_often").isNull(), 0).otherwise(frequent).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_frequent_words") < least_kept * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_frequent_words")


#: The same in DuckDB; lines are compared by their text there.
ORACLE_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, source is null as hn, coalesce(source, '') as h from documents),
w as (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
g as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w)),
rep as (select r, i from (select r, i, count(*) over (partition by r, g) as c from g) where c > 1),
cov as (select r, count(distinct i + k) as n from rep, (select unnest([0, 1, 2]) as k) group by r),
l0 as (select r, h, hn, unnest(string_split(t, chr(10))) as line from d),
l as (select r, h, hn, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) as norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n from l0 where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select r, count(*) - count(distinct line) as n from l group by r),
often as (select h, hn, norm from l group by h, hn, norm having count(distinct r) > 10),
freq as (select r, sum(n) as n from l semi join often using (h, hn, norm) group by r),
f as (select d.r, doc_id, len(ws)::bigint as n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::bigint as word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words, coalesce(freq.n, 0)::bigint as n_frequent_words
  from d join w using (r) left join dup using (r) left join cov using (r) left join freq using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not (n_words - n_frequent_words < 0.5 * n_words) as kept, n_frequent_words from f
"""
