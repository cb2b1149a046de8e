"""Secret scanning in DataFrame functions only: fixed patterns, and the entropy of sliding windows over candidate strings.

Every character that a fixed pattern's span covers is shifted into a private range, where later steps still know it but don't take it
for a plain one; characters of allow-listed stretches (eight or more equal ones, placeholder words) go to another such range. So one text
holds all that was found, no step looks up spans, and the work grows with the text's length however many spans there are.

Candidates are the runs of 20 or more plain characters of keys and tokens that are left. A window of 20 characters slides over
a candidate. Its Shannon entropy follows from S = sum of f(count) over its characters, f(c) = c log2 c, as H = log2(20) - S / 20;
the counts of all characters are carried along, one digit each, and change by one for the character that enters and the one that leaves.
The limit depends on the candidate's character class: hexadecimal (3.0 bits), or letters with digits (3.7 bits). One without letters or
without digits is none, and UUIDs, paths and words joined by signs are none either. A span runs from the first to the end of the
last window over the limit.

All spans are in code points, end exclusive. Defined cases: a null or empty text has no spans; a text's rows are independent, so repeated rows,
any order and an empty table need nothing special; very long texts, candidates and many spans take time in proportion (a task holds a
few dozen bytes for each character of a candidate); other columns are ignored (`redact` keeps them).
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import set_aside

WINDOW = 20
#: Private characters for those in spans and in allow-listed stretches; a text's own ones are taken out while it is scanned.
_SPAN, _ALLOWED = 0xE000, 0xE100
_PRIVATE, _NEUTRAL = "[\ue000-\ue1ff]", "\ufffd"
_ASCII = "".join(map(chr, range(32, 127)))


def _shifted(to: int) -> str:
    return "".join(chr(to + ord(c)) for c in _ASCII)


def _also_in_span(ranges: str) -> str:
    """A character class that also takes these characters where a span covers them."""
    return "[" + ranges + "".join(c if c == "-" else chr(_SPAN + ord(c)) for c in ranges) + "]"


#: The fixed patterns, in the order in which kinds are listed: kind, pattern, group, least length of that group.
PATTERNS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "".join(map(_also_in_span, "AKIA")) + _also_in_span("A-Z0-9") + "{16,}", 0, 20),
    ("hex", _also_in_span("0-9a-f") + "{24,}", 0, 24),
]
#: A cheap test for texts that can match a pattern at all; it looks at the text before anything is shifted.
_MAY_MATCH = {"assign": r"(?i)passw|secret|token|api_?key", "access": "AKIA", "hex": "[0-9a-f]{24}"}
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: Stretches that are cleared wherever they stand: one repeated character, placeholders.
STRETCHES = r"([A-Za-z0-9+/_=-])\1{7,}|(?i:example|placeholder|changeme)"
#: Candidates that are no secrets: UUIDs; those whose parts between signs are all words or short numbers.
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
SIGNS, WORD_PART = "[+/_=-]+", "^(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})?$"
_HEX_BITS, _MIXED_BITS = 3.0, 3.7
#: Running sums are taken inside blocks of so many numbers and over the blocks.
_BLOCK = 256


def _with_ends(docs: DataFrame, numbers: str, out: str) -> DataFrame:
    """`docs` with the running sums of a column of integers; null where it is null or empty.

    An array that grows by one element at each step is copied each time, so it may only grow to a block. Arrays are zipped rather
    than looked up by place: an expression that stands for an array inside a lambda would be computed anew for every element.
    """

    def running(x: Column, start: Column, last: bool) -> Column:
        """The sums after each number, or (not last) before each."""
        begin = F.struct(start.alias("p"), F.array().cast("array<int>").alias("a"))
        return F.aggregate(x, begin, lambda acc, n: F.struct((acc["p"] + n).alias("p"), F.concat(acc["a"], F.array(acc["p"] + n if last else acc["p"])).alias("a")), lambda acc: acc["a"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _BLOCK).cast("int")), lambda b: F.slice(numbers, b * _BLOCK + 1, _BLOCK))
    docs = docs.withColumn("_blocks", F.when(F.size(numbers) > 0, blocks))
    before = running(F.transform("_blocks", lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n)), F.lit(0), False)
    return docs.withColumn(out, F.flatten(F.zip_with("_blocks", before, lambda x, start: running(x, start, True)))).drop("_blocks")


def _with_matches(docs: DataFrame, pattern: str, group: int = 0, may: Column | None = None) -> DataFrame:
    """`docs` with the matches of a pattern in `_text`: `_hits`, array<struct<m: match, g: group, e: its end>>, and the `_gaps` around them; null where there are none."""
    t = F.col("_text")
    matches = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    docs = docs.withColumn("_m", matches if may is None else F.when(may, matches))
    some = F.size("_m") > 0
    docs = docs.withColumn("_gaps", F.when(some, F.split(t, pattern)))
    docs = docs.withColumn("_n", F.when(some, F.zip_with(F.slice("_gaps", F.lit(1), F.size("_m")), "_m", lambda gap, m: F.length(gap) + F.length(m))))
    docs = _with_ends(docs, "_n", "_ends")
    groups = F.regexp_extract_all(t, F.lit(pattern), F.lit(group)) if group else F.col("_m")
    hits = F.zip_with(F.zip_with("_m", groups, lambda m, g: F.struct(m.alias("m"), g.alias("g"))), "_ends", lambda x, e: F.struct(x["m"].alias("m"), x["g"].alias("g"), e.alias("e")))
    return docs.withColumn("_hits", F.when(some, hits)).drop("_m", "_n", "_ends")


def _rejoined(new: Column) -> Column:
    """`_text` with `new`, an array, in place of the matches."""
    joined = F.array_join(F.zip_with("_gaps", new, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), "")
    return F.when(F.col("_gaps").isNotNull(), joined).otherwise(F.col("_text"))


def _in_range(m: Column, to: int) -> Column:
    return F.translate(m, _ASCII, _shifted(to))


def _spans(kept: Column, order: int, kind: str) -> Column:
    """The kept ones (struct s, e; others null) as spans of a kind."""
    spans = F.transform(F.filter(kept, lambda x: x.isNotNull()), lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(kind).alias("k")))
    return F.coalesce(spans, F.array().cast("array<struct<s:int,o:int,e:int,k:string>>"))


def _windows(events: Column, most: Column) -> Column:
    """struct<first:int, last:int>: the first and last character (from 1) of the windows whose S is at most `most`; 0 if there is none.

    An event is a character and how its count changes, one that leaves before the one that enters.
    """
    f = F.array(*[F.lit(0.0)] + [F.lit(c * log2(c)) for c in range(1, WINDOW + 1)])

    def step(acc: Column, x: Column) -> Column:
        had = F.ascii(F.substring(acc["counts"], F.ascii(x["c"]), F.lit(1))) - ord("0")
        s = acc["s"] + F.get(f, had + x["d"]) - F.get(f, had)
        at = acc["i"] + F.when(x["d"] > 0, 1).otherwise(0)
        over = (x["d"] > 0) & (at >= WINDOW) & (s <= most)
        counts = F.overlay(acc["counts"], F.char(had + x["d"] + ord("0")), F.ascii(x["c"]), F.lit(1))
        return F.struct(s.alias("s"), at.alias("i"), counts.alias("counts"), F.when((acc["first"] == 0) & over, at - WINDOW + 1).otherwise(acc["first"]).alias("first"), F.when(over, at).otherwise(acc["last"]).alias("last"))

    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i"), F.lit("0" * 127).alias("counts"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    return F.aggregate(events, start, step)


def _events(characters: Column) -> Column:
    def of(c: Column, i: Column) -> Column:
        enters = F.struct(c.alias("c"), F.lit(1).alias("d"))
        leaves = F.struct(F.get(characters, i - WINDOW).alias("c"), F.lit(-1).alias("d"))
        return F.when(i >= WINDOW, F.array(leaves, enters)).otherwise(F.array(enters))

    return F.flatten(F.transform(characters, of))


def _suppressed(candidate: Column) -> Column:
    plain = F.forall(F.split(candidate, SIGNS), lambda part: part.rlike(WORD_PART))
    return ~(candidate.rlike("[0-9]") & candidate.rlike("[A-Za-z]")) | candidate.rlike(UUID) | plain


def with_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `secrets`: array<struct<s:int, o:int, e:int, k:string>>, all spans by start, then kind as listed (entropy last);
    and `_text`: the scanned text with the characters of spans and stretches shifted."""
    t = F.coalesce(text, F.lit(""))
    docs = docs.withColumn("_plain", F.when(t.rlike(_PRIVATE), F.regexp_replace(t, _PRIVATE, _NEUTRAL)).otherwise(t)).withColumn("_text", F.col("_plain"))
    parts = []
    for order, (kind, pattern, group, least) in enumerate(PATTERNS):
        docs = _with_matches(docs, pattern, group, F.col("_plain").rlike(_MAY_MATCH[kind]))

        def long(x: Column, least: int = least) -> Column:
            return F.length(x["g"]) >= least

        kept = F.transform("_hits", lambda x: F.when(long(x), F.struct((x["e"] - F.length(x["m"])).alias("s"), x["e"].alias("e"))))
        new = F.transform("_hits", lambda x: F.when(long(x), _in_range(x["m"], _SPAN)).otherwise(x["m"]))
        docs = docs.withColumn(f"_{kind}", _spans(kept, order, kind)).withColumn("_text", _rejoined(new))
        parts.append(f"_{kind}")
    docs = _with_matches(docs, STRETCHES, may=F.col("_plain").rlike(CANDIDATE))
    docs = docs.withColumn("_text", _rejoined(F.transform("_hits", lambda x: _in_range(x["m"], _ALLOWED))))

    docs = _with_matches(docs, CANDIDATE)
    limit = {kind: (log2(WINDOW) - bits) * WINDOW + 1e-9 for kind, bits in (("hex", _HEX_BITS), ("mixed", _MIXED_BITS))}

    def opened(m: Column) -> Column:
        return F.when(~_suppressed(m), F.struct(F.split(m, "").alias("c"), F.when(m.rlike("^[0-9A-Fa-f]+$"), limit["hex"]).otherwise(limit["mixed"]).alias("most")))

    def each(make) -> Column:
        return F.transform("_hits", lambda x: F.struct(x["m"].alias("m"), x["e"].alias("e"), make(x).alias("x")))

    docs = docs.withColumn("_hits", each(lambda x: opened(x["m"])))
    docs = docs.withColumn("_hits", each(lambda x: F.when(x["x"].isNotNull(), F.struct(_events(x["x"]["c"]).alias("events"), x["x"]["most"].alias("most")))))
    docs = docs.withColumn("_hits", each(lambda x: F.when(x["x"].isNotNull(), _windows(x["x"]["events"], x["x"]["most"]))))

    def over(x: Column) -> Column:
        return F.coalesce(x["x"]["first"] > 0, F.lit(False))

    def found(x: Column) -> Column:
        begin = x["e"] - F.length(x["m"])
        return F.when(over(x), F.struct((begin + x["x"]["first"] - 1).alias("s"), (begin + x["x"]["last"]).alias("e")))

    def marked(x: Column) -> Column:
        m, first, last = x["m"], x["x"]["first"], x["x"]["last"]
        inner = _in_range(F.substring(m, first, last - first + 1), _SPAN)
        return F.when(over(x), F.concat(F.substring(m, F.lit(1), first - 1), inner, F.substring(m, last + 1, F.length(m)))).otherwise(m)

    docs = docs.withColumn("_entropy", _spans(F.transform("_hits", found), len(PATTERNS), "entropy"))
    docs = docs.withColumn("_text", _rejoined(F.transform("_hits", marked)))
    docs = docs.withColumn("secrets", F.sort_array(F.concat(*parts, "_entropy")))
    return docs.drop("_plain", "_gaps", "_hits", "_entropy", *parts)


def _settled(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with a column as a generator's output: a later filter on it isn't pushed down, where it would repeat all that the column stands for."""
    return docs.withColumn("_settled", F.explode(F.array(name))).withColumn(name, F.col("_settled")).drop("_settled")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the fixed kinds, the digest of their spans, and all spans as text."""
    found = _settled(with_secrets(docs.select("doc_id", "text")), "secrets")

    def number(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda x: x["k"] == kind)).cast("long").alias(f"n_{kind}")

    base = _listed(F.filter("secrets", lambda x: x["k"] != "entropy"))
    return found.select("doc_id", *[number(k) for k, *_ in PATTERNS], F.sha2(base, 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """`docs` with every span in `text` replaced by `mask`; spans that meet become one. Texts without spans stay as they are."""
    docs, restore = set_aside(docs, (text,))
    found = with_secrets(docs, text)
    t, own = F.col(text), f"{_PRIVATE[:-1]}{_NEUTRAL}]"
    # what was taken out of the text comes back in its order; no span holds any of it
    found = found.withColumn("_own", F.when(t.rlike(own), F.regexp_extract_all(t, F.lit(own), F.lit(0))).otherwise(F.array().cast("array<string>")))

    def masked(part: Column) -> Column:
        return F.translate(F.regexp_replace(part, f"[{_shifted(_SPAN)[0]}-{_shifted(_SPAN)[-1]}]+", mask.replace("\\", "\\\\").replace("$", "\\$")), _shifted(_ALLOWED), _ASCII)

    parts = F.zip_with(F.split("_text", _NEUTRAL), "_own", lambda part, x: F.concat(masked(part), F.coalesce(x, F.lit(""))))
    found = found.withColumn(text, F.when(F.size("secrets") > 0, F.array_join(parts, "")).otherwise(t))
    return restore(_settled(found, text))
