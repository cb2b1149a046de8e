"""Periodic runs, mixing of sources and phrases."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from loomwork.llm import mixing, periodic_runs, phrases
from tests.llm.conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- periodic runs


def plain_runs(words):
    """Every maximal stretch with each period, straight from the definition."""
    found = {}
    n = len(words)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)  # smaller periods come first
            i = j
    return sorted((a, b - a, p) for (a, b), p in found.items())


def looped(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_digest(doc_id, text):
    words = looped(doc_id, text)
    runs = plain_runs(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(kept))


def periodic_texts():
    draw = random.Random(5)
    texts = []
    for size in (2, 3, 40):
        for _ in range(120):
            words = []
            while len(words) < draw.choice((5, 40, 160)):
                piece = [f"w{draw.randrange(size)}" for _ in range(draw.randrange(1, 9))]
                words += piece * draw.choice((1, 1, 4, 5, 9))
            texts.append(" ".join(words))
    return [(100 + i, t) for i, t in enumerate(texts)] + [(900, "a " * 5), (901, "a " * 6), (902, "a b " * 4), (903, "a b a b a b a"), (904, "x " + "a " * 3000 + "y"), (905, ("p q r " * 500 + "s ") * 5), (7, None), (None, "a " * 90)]


def test_runs_equal_brute_force(spark, docs, texts):
    made = periodic_texts() + texts
    got = periodic_runs.run_digests(frame(spark, made).unionByName(docs, allowMissingColumns=True)).collect()
    want = [plain_digest(i, t) for i, t in made + [(r["doc_id"], r["text"]) for r in docs.collect()]]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(r["n_runs"] for r in got) > 500


def test_runs_of_nothing(spark, none):
    assert periodic_runs.run_digests(none).count() == 0


def test_runs_in_small_blocks(monkeypatch):
    """The same runs when few grid points are probed at once, and in a long periodic text without a step for each grid point."""
    for _, text in periodic_texts()[:200]:
        words = np.array([int(zlib.crc32(w.encode())) for w in (text or "").split()])
        with monkeypatch.context() as m:
            m.setattr(periodic_runs, "PROBES", 32)
            got = periodic_runs.word_runs(words, np.array([0, len(words)]))
        assert [tuple(r[1:]) for r in got.tolist()] == plain_runs(words.tolist())
    long = np.tile(np.arange(7), 100_000)
    assert periodic_runs.word_runs(long, np.array([0, len(long)])).tolist() == [[0, 0, 700_000, 7]]


def test_equal_hashes_of_different_words(spark, monkeypatch):
    """Runs are of words: with hashes that only tell lengths apart, texts are done again with numbers."""
    import pyarrow as pa

    real = periodic_runs.word_hashes

    def short(data, offsets):
        _, starts, ends, first = real(data, offsets)
        return (ends - starts).astype(np.uint64), starts, ends, first

    monkeypatch.setattr(periodic_runs, "word_hashes", short)
    got = periodic_runs._found(pa.array(["a b c d e f g h", "a a a a a a b", None]), 4, 6).to_pylist()
    assert [[tuple(x.values()) for x in r["runs"]] for r in got] == [[], [(0, 6, 1)], []]
    assert [r["collapsed"] for r in got] == ["a b c d e f g h", "a b", ""]


def test_fewer_than_four_periods_are_refused(docs):
    with pytest.raises(ValueError):
        periodic_runs.with_runs(docs, exponent=3)


# ---- mixing


def as_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, taken int, budget string")


def mixed_rows():
    """A hot source, one that is all copies of one row, tiny ones, none, empty texts, a very long text, ids that are missing or stand twice."""
    draw = random.Random(3)
    rows = [(i, "w " * draw.randrange(0, 60), "hot" if i % 3 else f"s{i % 7}", 1, 1, "x") for i in range(600)]
    rows += [(None, "same words here", "copies", 1, 1, "x")] * 90 + [(5, "a b", None, 1, 1, "x"), (5, "a b c", None, 1, 1, "x"), (None, None, "void", 1, 1, "x"), (9, "", "void", 1, 1, "x")]
    return rows + [(1000, "long " * 200_000, "s1", 1, 1, "x"), (1001, "one", "Ä", 1, 1, "x"), (1002, "one two", "é", 1, 1, "x"), (1003, "x " * 40, "\U0001f600", 1, 1, "x"), (1004, "x", "￮", 1, 1, "x")]


def level_of(sizes, weights, total):
    """Targets by sharing the excess again and again."""
    aim = {s: 0.0 for s in sizes}
    left, open_ = total, set(sizes)
    while left > 1e-9 and open_:
        w = sum(weights[s] for s in open_)
        for s in open_:
            aim[s] += left * weights[s] / w
        left = sum(max(0, aim[s] - 3 * sizes[s]) for s in sizes)
        for s in sizes:
            if aim[s] >= 3 * sizes[s]:
                aim[s] = 3 * sizes[s]
                open_.discard(s)
    return aim


@pytest.mark.parametrize("which", ["made", "table"])
def test_mix_follows_targets(spark, docs, which):
    from collections import defaultdict

    table = as_table(spark, mixed_rows()) if which == "made" else docs
    rows = table.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    aim = level_of(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(ordered)}, sum(sizes.values()))
    got = mixing.mix_to_weights(table).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r["doc_id"]), len(WORD.findall(r["text"] or ""))) for r in rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(aim[r["source"]], rel=1e-9, abs=1e-9) and r["taken"] in {k * r["size"] for k in range(4)}
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - aim[s]) <= largest[s]
    if which == "table":
        for s in sizes:
            assert abs(taken[s] - aim[s]) <= max(0.5 * largest[s], 1e-9)
        again = mixing.mix_to_weights(table.repartition(5, "text")).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_equals_sql(spark, docs):
    for table in (docs, as_table(spark, mixed_rows())):
        con = duckdb.connect()
        documents = table.toArrow()  # noqa: F841
        want = con.execute(f"select * from ({mixing.ORACLE_SQL})").fetchall()
        assert sorted(map(tuple, mixing.mixture(table).collect()), key=repr) == sorted(want, key=repr)


def test_budgets_are_nested(spark):
    rows = mixing.mix_to_weights(as_table(spark, [r for r in mixed_rows() if r[2] != "copies"]), budgets=(0.1, 0.5, 1.0, 4.0)).where("doc_id is not null").collect()
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["size"], r["source"]), []).append((r["budget"], r["taken"]))
    for taken in by.values():
        counts = [t for _, t in sorted(taken)]
        assert counts == sorted(counts) and len(counts) == 4
    assert all(r["taken"] == 3 * r["size"] for r in rows if r["budget"] == 4.0)


def test_mix_of_nothing(spark, none):
    assert mixing.mixture(none).count() == 0


def test_boundary_goes_down_to_one_row(spark):
    """Draws that agree in all but their last bits: every level is gone through."""
    rows = [(i, "s", 1, 7, 7, i) for i in range(100)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long, _d0 long, _d1 long, _d2 long")
    aims = spark.createDataFrame([("s", 100, 1.0, 130.0)], "source string, source_size long, budget double, target double")
    got = mixing.mix(sizes, aims).collect()
    assert {r["doc_id"]: r["taken"] for r in got} == {i: 2 if i < 30 else 1 for i in range(100)}


# ---- phrases


def plain_collocations(rows, min_count=30, longest=4, best=2000):
    from collections import Counter, defaultdict

    counts, totals = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, of in counts.items():
        often = {p: n for p, n in of.items() if n >= min_count}
        scored = []
        for p, a in often.items():
            if len(p) == 1:
                continue
            if any(len(q) > len(p) and 100 * n >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, n in often.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (often[p[:c]] + often[p[c:]]), c, often[p[:c]], often[p[c:]]) for c in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def spoken(spark, rows):
    return spark.createDataFrame([(x, t, 1, "n", 2) for x, t in rows], "lang string, text string, n int, phrase string, k int")


def phrase_rows():
    draw = random.Random(8)
    vocabulary = ["the", "of", "New", "york", "City", "É", "é", "ﬀ", "a b", "x'y", "in", "at"]
    rows = [(draw.choice(("en", "en", "en", "de", None, "")), draw.choice(" \t\n.,") .join(" ".join(draw.choice(vocabulary) for _ in range(draw.randrange(1, 9))) for _ in range(12))) for _ in range(150)]
    rows += [("en", "es es es " * 40), ("es", "en en en " * 40)]  # names of languages as words
    rows += [("en", "new york city hall " * 60), ("en", "word! word? word; word: " * 40), ("en", None), ("fr", ""), ("en", " \n "), ("de", "aa aa aa aa aa aa " * 30), ("en", "z" * 5000 + " once more, " + "z" * 5000)]
    return rows + [("en", "copied line of words here\r\n" * 2)] * 40


def test_phrases_equal_brute_force(spark):
    """Also with a table too small to tell frequent phrases apart, which may only cost time."""
    rows = phrase_rows()
    want = plain_collocations(rows)
    for table_bits in (phrases.TABLE_BITS, 1024):
        assert sorted(map(tuple, phrases.collocations(spoken(spark, rows), table_bits=table_bits).collect())) == want
    assert len(want) > 30


def test_phrases_equal_sql(spark, docs):
    for table in (docs, spoken(spark, phrase_rows())):
        con = duckdb.connect()
        documents = table.toArrow()  # noqa: F841
        assert sorted(map(tuple, phrases.collocations(table).collect())) == sorted(con.execute(f"select * from ({phrases.ORACLE_SQL})").fetchall())


def test_ranks_stop_at_the_limit(spark):
    rows = [("en", f"w{i} v{i}") for i in range(40) for _ in range(30 + i % 3)]
    got = sorted(map(tuple, phrases.collocations(spoken(spark, rows), best=7).collect()))
    assert got == plain_collocations(rows, best=7) and len(got) == 7


def test_scores_beyond_64_bits(spark):
    big = 9 * 10**15
    levels = spark.createDataFrame([([1], 3 * big), ([2], 2 * big), ([1, 2], big)], "words array<long>, n long")
    assert [tuple(r) for r in phrases.scored_phrases(levels).collect()] == [([1, 2], big, 3 * big, 2 * big, 400_000)]


def test_words_that_share_a_hash_are_counted_again(spark, monkeypatch):
    """Where two words share a hash under a seed, the next one is taken."""
    words = "h long, lang string, word string, n long"
    assert phrases._share_hashes(spark.createDataFrame([(7, "en", "a", 2), (7, "de", "a", 1), (8, "en", "b", 1)], words))
    assert not phrases._share_hashes(spark.createDataFrame([(7, "en", "a", 2), (8, "de", "a", 1)], words))
    rows, found = phrase_rows(), iter([True, True, False])
    monkeypatch.setattr(phrases, "_share_hashes", lambda words: next(found))
    assert sorted(map(tuple, phrases.collocations(spoken(spark, rows)).collect())) == plain_collocations(rows)


def test_phrases_that_share_a_key(monkeypatch):
    """Places are joined by key, then by their words, so phrases with one key are still counted apart."""
    monkeypatch.setattr(phrases, "_turned", lambda hashes, word: hashes & np.uint64(1))
    words = phrases.Words(np.frombuffer(b"a b a b c d c d a b", np.uint8), np.array([0, 19]), np.zeros(1, np.uint64))
    at, n = words.counted(words.whole(2), 2)
    assert sorted(zip(at.tolist(), n.tolist(), strict=True)) == [(0, 3), (1, 1), (3, 1), (4, 2), (5, 1), (7, 1)]


def test_phrases_of_long_runs(spark):
    """A frequent passage longer than a run may be is cut: phrases over its cuts are counted once."""
    passage = [f"w{i % 150}" for i in range(3 * phrases.RUN_PLACES + 7)]
    cut = phrases.RUN_PLACES
    texts = [passage, passage[: cut + 3], passage[: cut + 4], passage[: 2 * cut + 2], ["x"] * 700]
    rows = [("en", f"{i} " + " ".join(x)) for x in texts for i in range(20)]
    for longest in (3, 4, 6):
        levels, words, _ = phrases.frequent_phrases(spoken(spark, rows), 30, longest)
        spelled = {r["h"]: r["word"] for r in words.collect()}
        got = {" ".join(spelled[h] for h in r["words"]): r["n"] for r in levels.collect()}
        want = {}
        for _, text in rows:
            own = text.split()
            for k in range(1, longest + 1):
                for i in range(len(own) - k + 1):
                    want[" ".join(own[i : i + k])] = want.get(" ".join(own[i : i + k]), 0) + 1
        assert got == {p: n for p, n in want.items() if n >= 30}


def test_copies_in_more_tasks_make_no_more_phrases(spark, monkeypatch):
    """Copies of a passage meet as runs, wherever they stand, before phrases of 3 words and more are counted; those of 4 don't read the texts again."""
    passage = " ".join(f"w{i}" for i in range(50))
    rows = spoken(spark, [("en", passage)] * 40)
    kept, real = [], phrases.stored
    monkeypatch.setattr(phrases, "stored", lambda df: kept.append((df, real(df))) or kept[-1][1])
    made = []
    for parts in (1, 20):
        kept.clear()
        levels = phrases.frequent_phrases(rows.repartition(parts), 30, 4)[0]
        assert sorted(r["n"] for r in levels.collect()) == [40] * (50 + 49 + 48 + 47)
        readers = [df._jdf.queryExecution().optimizedPlan().toString() for df, _ in kept]
        assert sum("(lang#" in plan for plan in readers) == 3  # words, pairs and runs
        made.append([t.count() for _, t in kept if t.columns == ["run", "n"]])
    assert made == [[1], [1]]


def test_phrases_of_nothing(spark, none):
    assert phrases.collocations(none).count() == 0
