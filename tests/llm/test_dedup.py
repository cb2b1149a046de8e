"""Near-duplicate and substring operators against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np

from loomwork.llm import anchors, jaccard_forest, prefix_trees, shared, suffix_arrays
from loomwork.llm.shared import checkpointed, linked_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    links = [0] * len(rows)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                label[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], (min(ids) if ids else None) if sets[i] else rows[i][0], links[i]) for i in members]
    return sorted(out, key=repr)


def test_jaccard_classes(corpora):
    for df, rows in corpora:
        assert rows_of(jaccard_forest.jaccard_classes(df), "doc_id", "class_id", "n_links") == brute_classes(rows)


def test_planted_pairs_just_above_the_threshold_are_linked(spark):
    """Texts of 60 to 300 words with a copy in which so many words are changed that 0.8 to 0.95 of the shingles are shared."""
    draw, rows, near = random.Random(21), [], []
    for i in range(250):
        words = [f"v{draw.randrange(20_000)}" for _ in range(draw.randrange(60, 300))]
        copy = list(words)
        for _ in range(draw.randrange(1, 1 + len(words) // 40 + 1)):
            copy[draw.randrange(len(copy))] = f"new{draw.randrange(10**6)}"
        a, b = (set(zip(*(w[k:] for k in range(5)), strict=False)) for w in (words, copy))
        if 0.8 <= len(a & b) / len(a | b) < 0.96:
            near.append((2 * i, 2 * i + 1, len(a & b) / len(a | b)))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    got = {r["doc_id"]: r for r in jaccard_forest.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 120 and sum(s < 0.85 for _, _, s in near) > 25
    assert [(a, b, s) for a, b, s in near if got[a]["class_id"] != got[b]["class_id"]] == []
    assert sum(r["class_id"] != r["doc_id"] for r in got.values()) == sum(1 for a in range(0, 500, 2) if got[a]["class_id"] == got[a + 1]["class_id"])


def test_jaccard_keeps_one_of_each(corpora, none):
    for df, rows in corpora:
        kept = jaccard_forest.one_of_each(df)
        assert kept.columns == df.columns
        assert Counter(r[0] for r in kept.select("doc_id").collect()) == Counter({i: 1 for i, c, _ in brute_classes(rows) if i == c})
    assert jaccard_forest.jaccard_classes(none).count() == 0


def test_jaccard_keeps_texts_that_share_a_doc_id_or_have_none(spark):
    first, second, third, fourth = (" ".join(f"{c}{i}" for i in range(60)) for c in "abcd")
    near = first.replace("a59", "z")
    rows = [(None, first), (None, second), (None, second), (1, near), (7, third), (7, fourth), (7, fourth), (None, ""), (None, None)]
    kept = jaccard_forest.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([(1, near), (None, second), (7, third), (7, fourth), (None, ""), (None, None)])


def test_forest_depth_shortens_until_the_recall_is_reached():
    assert jaccard_forest.forest_depth(32, 8, 0.8, 0.9999) == 6
    assert jaccard_forest.forest_depth(32, 8, 0.95, 0.99) == 8
    assert jaccard_forest.forest_depth(1, 8, 0.5, 0.99) == 1


def test_jaccard_in_many_chunks(odd, texts, monkeypatch):
    monkeypatch.setattr(jaccard_forest, "CHUNK_CONTENTS", 1)
    assert rows_of(jaccard_forest.jaccard_classes(odd), "doc_id", "class_id", "n_links") == brute_classes(texts)


def test_a_chain_of_half_alike_texts_forms_no_block(spark, monkeypatch):
    """Each text is alike to 0.5 to 19 others (80 of 160 shingles); among them are three pairs of near copies."""
    draw = np.random.default_rng(5)
    common = [[f"c{i}_{j}" for j in range(84)] for i in range(10)]
    rows = [(20 * i + k, " ".join(common[i] + [f"o{i}_{k}_{j}" for j in range(40)])) for i in range(10) for k in range(20)]
    rows += [(1000 + i, rows[i][1].replace(rows[i][1].split()[int(draw.integers(95, 115))], "changed")) for i in (3, 77, 150)]
    monkeypatch.setattr(jaccard_forest, "CHUNK_CONTENTS", 2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard_forest.jaccard_classes(df), "doc_id", "class_id", "n_links") == brute_classes(rows)
    contents = jaccard_forest._forest_keys(df.selectExpr("doc_id", "1L as h1", "2L as h2", "text"), 32, 6).selectExpr("doc_id as cid", "keys", "signature")
    keys = contents.selectExpr("cid", "explode(keys) as key")
    met = keys.alias("x").join(keys.alias("y"), "key").where("x.cid < y.cid").selectExpr("x.cid as a", "y.cid as b").distinct().count()
    linked = {(min(e), max(e)) for e in jaccard_forest._likely_links(contents, jaccard_forest.least_agreement(192, 0.8)).collect() if e[0] != e[1]}
    assert met > 500 and {(3, 1003), (77, 1077), (150, 1150)} <= linked and len(linked) < 20


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100), (101, 102), (103, 102), (None, 5)] + [(200, 201 + i) for i in range(50)]
    got = dict(linked_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 41)} | {100: 100} | {i: 101 for i in (101, 102, 103)} | {200 + i: 200 for i in range(51)}


def test_stars_take_no_step_and_texts_without_large_blocks_one_search_for_components(spark, monkeypatch):
    stored_tables, searches = [], []
    monkeypatch.setattr(shared, "checkpointed", lambda df: stored_tables.append(1) or checkpointed(df))
    stars = [(10 * i + k, 10 * i) for i in range(1, 5) for k in range(1, 9)] + [(7, 7)]
    assert dict(linked_components(spark.createDataFrame(stars, "a long, b long")).collect()) == {7: 7} | {10 * i + k: 10 * i for i in range(1, 5) for k in range(9)}
    assert len(stored_tables) == 1
    monkeypatch.setattr(jaccard_forest, "linked_components", lambda edges: searches.append(1) or linked_components(edges))
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*words[:150], f"new{i}", *words[150:]])) for i in range(4)] + [(9, "some other text altogether")]
    assert rows_of(jaccard_forest.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "class_id", "n_links") == brute_classes(rows)
    assert len(searches) == 1


def brute_bytes(rows, window):
    data = [(t or "").encode() for _, t in rows]
    often = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for (doc_id, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - window + 1):
            if often[d[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc_id, len(d), int(gone.sum()), spans, sha(bytes(b for b, g in zip(d, gone, strict=True) if not g))))
    return sorted(out, key=repr)


BYTES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix_arrays(corpora, none):
    for df, rows in corpora:
        assert rows_of(suffix_arrays.suffix_array_digests(df), *BYTES) == brute_bytes(rows, 400)
    assert suffix_arrays.suffix_array_digests(none).count() == 0


def test_suffix_arrays_with_a_short_window(odd, texts):
    assert rows_of(suffix_arrays.suffix_array_digests(odd, 60), *BYTES) == brute_bytes(texts, 60)


def test_suffix_array_of_random_strings():
    draw = np.random.default_rng(3)
    for n, letters in ((1, 2), (2, 2), (50, 2), (300, 3), (2000, 200), (1500, 2)):
        text = np.concatenate([draw.integers(1, letters + 1, n), [0]]).astype(np.uint16)
        want = sorted(range(n + 1), key=lambda i: text[i:].tolist())
        assert suffix_arrays.suffix_array(text, n + 1).tolist() == want


def real_contexts(small, n=60):
    """Stretches of real text, some of which share parts, as a shard holds them."""
    import pyarrow.parquet as pq

    joined = " ".join(t for t in pq.read_table(f"{small}/documents.parquet")["text"].to_pylist() if t).encode()
    draw = np.random.default_rng(9)
    starts = draw.integers(0, 60_000, n)
    return [np.frombuffer(joined[a : a + int(draw.integers(450, 2000))], np.uint8) for a in starts]


def test_shards_by_array_and_by_hash(small, monkeypatch):
    """Both ways that a shard is solved mark the windows that plain counting finds twice."""
    contexts = real_contexts(small)
    often = Counter(c[i : i + 400].tobytes() for c in contexts for i in range(len(c) - 399))
    want = [[2 if often[c[i : i + 400].tobytes()] > 1 else 1 for i in range(len(c) - 399)] for c in contexts]
    assert any(2 in w for w in want) and any(1 in w for w in want)
    solve, places = suffix_arrays.repeat_counts(400), np.ones(len(contexts), int)
    assert [m.tolist() for m in solve(contexts, places, places)] == want
    monkeypatch.setattr(suffix_arrays, "SORTED_CONTEXTS", 0)
    monkeypatch.setattr(anchors, "BATCH_BYTES", 0)
    assert [m.tolist() for m in solve(contexts, places, places)] == want


def test_real_text_is_sorted_by_recursion_as_by_doubling(small, monkeypatch):
    strings = [np.concatenate([np.concatenate([c.astype(np.uint16) + 2, [1]]) for c in real_contexts(small, n)] + [np.zeros(1)]).astype(np.uint16) for n in (3, 60)]
    calls, real = [], suffix_arrays._doubled
    monkeypatch.setattr(suffix_arrays, "_doubled", lambda *a: calls.append(1) or real(*a))
    short, doubled = (suffix_arrays.suffix_array(x, len(x)) for x in strings)
    assert short.tolist() == sorted(range(len(strings[0])), key=lambda i: strings[0][i:].astype(">u2").tobytes())
    assert len(calls) == 1  # the longer one has more names than are induced
    monkeypatch.setattr(suffix_arrays, "INDUCED_ALPHABET", 1 << 30)
    assert np.array_equal(suffix_arrays.suffix_array(strings[1], len(strings[1])), doubled) and len(calls) == 1


def test_more_very_frequent_grams_than_are_told(odd, texts, monkeypatch):
    """The limit of what is very frequent rises until the k-grams are few enough; the rest stays with the tasks."""
    plain = anchors.contents(odd)

    def covered(limit):
        _, runs = anchors.repeated_runs(plain, prefix_trees.scheme_of(50), prefix_trees.least_documents(50), True, limit)
        return {(r["h1"], r["h2"]): {s["start"] + i for s in r["runs"] for i in range(s["n"])} for r in runs.collect()}

    want = covered(anchors.TASK_CONTEXTS)
    monkeypatch.setattr(anchors, "HOT_GRAMS", 3)
    assert covered(1) == want


def brute_words(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    order = [2**63 - 1 if i is None else i for i, _ in rows]
    least = {}
    for o, w in zip(order, words, strict=True):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, o), o)
    out = []
    for (doc_id, _), o, w in zip(rows, order, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < o:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((doc_id, len(w), sum(gone), sha(" ".join(kept).encode())))
    return sorted(out, key=repr)


WORDS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_prefix_trees(corpora, none):
    for df, rows in corpora:
        assert rows_of(prefix_trees.substring_digests(df), *WORDS) == brute_words(rows, 50)
    assert prefix_trees.substring_digests(none).count() == 0


def test_prefix_trees_of_very_frequent_prefixes(odd, texts):
    """With the windows of frequent k-grams grouped one by one."""
    plain = anchors.contents(odd)
    for scheme, solve, across in ((prefix_trees.scheme_of(50), prefix_trees.least_documents(50), True), (anchors.Scheme(False, 400, 48), suffix_arrays.repeat_counts(400), False)):
        def covered(limit):
            _, runs = anchors.repeated_runs(plain, scheme, solve, across, limit)
            return {(r["h1"], r["h2"]): {s["start"] + i for s in r["runs"] for i in range(s["n"])} for r in runs.collect()}

        assert covered(0) == covered(anchors.TASK_CONTEXTS)


def test_texts_without_repeats(odd, texts, none):
    kept = prefix_trees.without_repeats(odd)
    assert kept.columns == odd.columns and dict(kept.dtypes) == dict(odd.dtypes)
    want = Counter(s for (i, n, gone, s) in brute_words(texts, 50) if not (n and gone == n))
    assert Counter(sha(" ".join(WORD.findall(r["text"] or "")).encode()) for r in kept.collect()) == want
    assert prefix_trees.without_repeats(none).count() == 0


def test_texts_are_cut_once(odd):
    plan = prefix_trees.without_repeats(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # not for the filter and again for the result
