"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandframe.llm import ann, balance, bytenet, common, components, debruijn, decontaminate, lines, minhash, queries, ring, secrets, suffix, winnow
from strandframe.llm import text as tx

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(n=60, seed=3):
    rng = random.Random(seed)
    words = ["The", "cat", "sat", "on", "É", "mat,", "über", "alles", "x1", "Of"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(n // 3)]
    rows = []
    for i in range(n):
        t = rng.choice(base)
        if rng.random() < 0.5:
            w = t.split()
            w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
        rows.append((i, t, "en", f"s{rng.randint(0, 3)}"))
    rows += [(n, None, None, None), (n + 1, "", "en", "s1"), (n + 2, " \t\n", "en", None), (n, base[0], "en", "s0"), (n, base[0], "en", "s0"), (None, base[1], "en", "s2"), (n + 3, " ".join(rng.choice(words) for _ in range(4000)), "en", "s0")]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows]


DOCS = make_docs()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).withColumns({"rid": F.lit(1), "size": F.lit(2), "shard": F.lit("x"), "node": F.lit(3)}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# 1
def test_decontaminate(spark, docs, empty):
    items = [(1, "the CAT sat on"), (2, " ".join(fold(DOCS[5][1]).split()[:12])), (3, None), (4, ""), (None, "über"), (1, "the CAT sat on"), (5, "!?")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {}
    for i, t in items:
        w = word.findall(fold(t))
        for j in range(max(1, len(w) - 9) if w else 0):
            phrases.setdefault(tuple(w[j : j + 10]), set()).update([str(i)] if i is not None else [])
    want = Counter()
    for i, t, *_ in DOCS:
        w, hit, found = word.findall(fold(t)), set(), set()
        for j in range(len(w)):
            for p, of in phrases.items():
                if tuple(w[j : j + len(p)]) == p:
                    hit |= set(range(j, j + len(p)))
                    found |= of
        want[(i, len(w), len(hit), tuple(sorted(found)))] += 1
    n_hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["first"])
    for block in (2_000_000, 3):
        got = decontaminate.decontaminate(docs, bench, ["doc_id"], block_words=block)
        assert Counter((r[0], r[1], r[2], tuple(r[3])) for r in got.select("doc_id", "n_words", n_hit, "items").collect()) == want
    assert decontaminate.decontaminate(empty, bench, ["doc_id"]).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0), ["doc_id"]).filter("size(spans) > 0").count() == 0


def test_fm_index():
    rng = np.random.default_rng(1)
    text = np.concatenate([[0], rng.integers(0, 4, 400), [0]])
    index = decontaminate.FMIndex(text, 3)
    for n in (1, 2, 5):
        some = rng.integers(1, 4, (20, n))
        lo, hi = index.search(some)
        for p, a, b in zip(some, lo, hi, strict=True):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# 2
def brute_components(width, num, den):
    sets = []
    for _, t, *_ in DOCS:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    least = {}
    for x, (i, *_) in zip(label, DOCS, strict=True):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return Counter((d[0], len(s), least.get(x)) for d, s, x in zip(DOCS, sets, label, strict=True))


@pytest.mark.parametrize("limits", [{}, {"group_rows": 2, "group_shingles": 60}, {"piece_rows": 2, "piece_shingles": 60}])
def test_near_duplicates(docs, empty, limits):
    got = minhash.label_components(docs, 4, **limits)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute_components(4, 80, 100)
    assert set(docs.columns) <= set(got.columns)
    assert minhash.label_components(empty, 4).count() == 0


def test_estimate_follows_similarity():
    rng = np.random.default_rng(2)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (900, 50, 50))
    one, two = (minhash.signature(minhash.minima(np.concatenate([common, x]))) for x in (a, b))
    assert minhash.estimate(minhash.different(one, two[None])[0]) == pytest.approx(0.9, abs=0.12)


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 40) if i % 9] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    label = {x: x for ab in links for x in ab}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: y for x, y in label.items() if any(x in ab and ab[0] != ab[1] for ab in links)}


# 3
REPORTED = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")


def covered_by_repeats(raw, length):
    """For each text, which bytes a string of that length covers that starts anywhere else."""
    seen = Counter(t[p : p + length] for t in raw for p in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out.append(gone)
    return out


def brute_substrings(rows, length, report):
    raw = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (i, _), t, gone, again in zip(rows, raw, covered_by_repeats(raw, length), covered_by_repeats(raw, report), strict=True):
        runs = sum(1 for j in range(len(t)) if gone[j] and not (j and gone[j - 1]))
        want[(i, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest(), sum(again))] += 1
    return want


@pytest.mark.parametrize("block", [20_000, 2])
def test_substrings(docs, empty, block):
    got = suffix.dedup_substrings(docs, length=40, report=24, keep=REPORTED, block=block)
    assert rows_of(got, *got.columns) == brute_substrings([(i, t) for i, t, *_ in DOCS], 40, 24)
    assert suffix.dedup_substrings(empty, length=40).count() == 0


@pytest.mark.parametrize("block", [20_000, 2])
def test_substrings_that_overlap_themselves(spark, block):
    rng = random.Random(21)
    some = lambda n: "".join(rng.choice("ab") for _ in range(n))
    rows = list(enumerate([*(some(rng.randint(0, 90)) for _ in range(40)), "a" * 70, "a" * 23, "ab" * 50, "abc" * 9, some(300) * 3]))
    got = suffix.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), length=15, report=9, core=4, keep=REPORTED, block=block)
    assert rows_of(got, *got.columns) == brute_substrings(rows, 15, 9)


def test_hot_contexts_stay_where_they_are(spark, monkeypatch):
    """A context with most of the occurrences: no task gets all of them, and the result is the same."""
    monkeypatch.setattr(suffix, "HOT_CONTEXT", 300)
    docs = [("own %d begin " % i + "na " * 150 + "own %d end" % i) if i < 30 else "one of two, " * 3 + "%d" % (i // 2) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(8)
    got = suffix.dedup_substrings(df, length=40, report=24, keep=REPORTED)
    assert rows_of(got, *got.columns) == brute_substrings(list(enumerate(docs)), 40, 24)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for least, apart in ((300, True), (10**9, False)):
            monkeypatch.setattr(suffix, "HOT_CONTEXT", least)
            found, distinct, _ = suffix._contexts(common.with_rid(df.withColumn("text", F.col("text").cast("binary"))), 24, 12, 40, 20_000)
            rows = suffix._equal_contexts(found.repartition(8), distinct)
            hottest, total = found.groupBy("m", "s1", "s2").agg(F.count("*").alias("k")).filter("k > 1").agg(F.max("k"), F.sum("k")).first()
            assert hottest > 0.5 * total and rows.count() == total
            assert (rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < hottest) == apart
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(23)
    monkeypatch.setattr(suffix.tx, "PIECE", 500)
    monkeypatch.setattr(winnow, "MOST", 256)
    some = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 7))) for _ in range(n))
    passage = some(60)
    rows = list(enumerate([some(700) + " " + passage + " " + some(300), some(20), some(500) + " " + passage, some(2000), passage + some(1000)[3:]]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in df.select(F.col("doc_id").alias("rid"), F.col("text").cast("binary").alias("text")).toArrow().to_batches()]
    place = [(r, p) for b in suffix._anchors(24, 12, 12, 40, True)(iter(got)) for r, p in zip(b.column("rid").to_pylist(), b.column("place").to_pylist(), strict=True)]
    assert len(place) == len(set(place)) > 200  # no anchor twice where pieces meet
    words = [t.encode().split() for _, t in rows]
    one = np.concatenate([tx.words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), tx.BYTE_VALUES)[0] for _, t in rows])
    assert len(one) == sum(map(len, words)) and len(np.unique(one)) == len({w for x in words for w in x})


def test_text_over_a_piece(spark):
    rng = random.Random(29)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    long = " ".join(rng.choice(words) for _ in range(330_000))
    assert len(long) > 2 * tx.PIECE
    a = long.index(" ", tx.PIECE - 900) + 1
    passage = long[a : a + 1800]  # over the end of a piece
    rows = [(1, long), (2, "own begin " + passage + " own end"), (3, "something else")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix.dedup_substrings(df).collect()}
    assert 1800 <= got[2]["n_removed"] <= 1804 and got[1]["n_removed"] == got[2]["n_removed"] and got[3]["n_removed"] == 0
    spans = {r["doc_id"]: r["n_removed"] for r in debruijn.dedup_spans(df).collect()}
    assert spans == {1: 0, 2: len(passage.split()) - (not passage.endswith(" ") and long[a + 1800] != " "), 3: 0}


def test_maximal_repeats(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcd") for _ in range(90))
    texts = ["".join(rng.choice("abcd") for _ in range(50)) + passage + "".join(rng.choice("abcd") for _ in range(50)) for _ in range(4)]
    got = suffix.repeat_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=40).collect()
    assert got and {r["doc_id"] for r in got if r["n_bytes"] >= 50} == {0, 1, 2, 3}
    for r in got:
        assert hashlib.sha256(texts[r["doc_id"]][r["begin"] : r["begin"] + r["n_bytes"]].encode()).hexdigest() == r["repeat"]


def test_maximal_repeats_by_brute_force():
    rng = np.random.default_rng(12)
    for _ in range(60):
        length, core = int(rng.integers(4, 12)), 3
        side, rows = length - core, set()
        for _ in range(25):
            before, after = (int(x) for x in rng.integers(0, side + 1, 2))
            if before + after >= side:
                rows.add((bytes(rng.integers(0, 2, before).tolist()) + b"abc" + bytes(rng.integers(0, 2, after).tolist()), before))
        rows = sorted(rows)
        classes = {}
        for i, (t, b) in enumerate(rows):
            for e in range(b + 1):
                for d in range(len(t) - b - core + 1):
                    if e + core + d >= length:
                        ends = (t[b - e - 1] if e < b else -1 - i, t[b + core + d] if b + core + d < len(t) else -1 - i)
                        classes.setdefault((e, core + d, t[b - e : b + core + d]), []).append((i, *ends))
        want = {(e, r, frozenset(i for i, _, _ in x)) for (e, r, _), x in classes.items() if len({a for _, a, _ in x}) > 1 and len({a for _, _, a in x}) > 1}
        before = np.array([b for _, b in rows])
        got = suffix.Block(np.zeros(len(rows), np.int64), [t for t, _ in rows], before, length, core).maximal_repeats()
        assert len(got) == len(want) and {(e, r, frozenset(x.tolist())) for e, r, x in got} == want


@pytest.mark.parametrize("block", [20_000, 1])
def test_repeat_groups(spark, block):
    rng = random.Random(11)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    # A and B share 3 more bytes before the passage than C does; A and C share 3 more after it than B does
    sets, texts = [(some(6), some(36), some(8)) for _ in range(10)], []
    for near, core, far in sets:
        texts += [some(30) + "x" + near + core + far + "u" + some(30), some(30) + "y" + near + core + far[:5] + "v" + some(30), some(30) + "z" + near[3:] + core + far + "w" + some(30)]
    texts += [texts[3], DOCS[-1][1][:3000], DOCS[5][1], DOCS[6][1], DOCS[7][1]]
    length, seen = 40, {}
    for i, t in enumerate(texts):
        raw = t.encode()
        for p in range(len(raw) - length + 1):
            seen.setdefault(raw[p : p + length], []).append((i, p))
    got = suffix.repeat_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=length, block=block).collect()
    groups, covered, want = {}, set(), set()
    for r in got:
        groups.setdefault(r["repeat"], []).append((r["doc_id"], r["begin"]))
        covered |= {(r["doc_id"], r["begin"] + x) for x in range(r["n_bytes"])}
        assert hashlib.sha256(texts[r["doc_id"]].encode()[r["begin"] : r["begin"] + r["n_bytes"]]).hexdigest() == r["repeat"]
    for places in seen.values():
        if len(places) > 1:
            want |= {(i, p + x) for i, p in places for x in range(length)}
    assert covered == want
    # every occurrence of each repeat
    for r in got:
        t = texts[r["doc_id"]].encode()[r["begin"] : r["begin"] + r["n_bytes"]]
        every = [(i, p) for i, p in seen[t[:length]] if texts[i].encode()[p : p + len(t)] == t]
        assert sorted(groups[r["repeat"]]) == sorted(every) and len(every) > 1
    # both subgroups, wherever one minimizer is in all of their windows
    both = 0
    for i, (near, core, far) in enumerate(sets):
        name = lambda t: [d - 3 * i for d, _ in sorted(groups.get(hashlib.sha256(t.encode()).hexdigest(), []))]  # noqa: B023, E731
        both += [name(near + core + far[:5]), name(near[3:] + core + far), name(near[3:] + core + far[:5])] == [[0, 1], [0, 2], [0, 1, 2]]
    assert both >= 2


def test_prefix_intervals():
    assert sorted(suffix.prefix_intervals(np.array([-1, 2, 3, 0, 1]))) == [(0, 0, 5), (1, 3, 5), (2, 0, 3), (3, 1, 3)]


@pytest.mark.parametrize("members", [3, 500_000])
def test_reach_of_intervals(monkeypatch, members):
    monkeypatch.setattr(suffix, "MEMBERS", members)
    rng = np.random.default_rng(4)
    for _ in range(60):
        least, core, rows = int(rng.integers(4, 10)), 3, set()
        length = least + int(rng.integers(0, 5))
        for _ in range(30):
            before, after = int(rng.integers(0, least - core + 1)), int(rng.integers(0, length - core + 1))
            if before + core + after >= least:
                rows.add((int(rng.integers(0, 3)), bytes(rng.integers(0, 2, before).tolist()) + b"abc" + bytes(rng.integers(0, 2, after).tolist()), before))
        rows = sorted(rows)
        block = suffix.Block(np.array([g for g, _, _ in rows]), [t for _, t, _ in rows], np.array([b for _, _, b in rows]), least, core)
        for n, (low, high) in zip((least, length), block.reach(least, length), strict=True):
            for i, (g, t, b) in enumerate(rows):
                best = (-1, -1)
                for j, (g2, t2, b2) in enumerate(rows):
                    if i != j and g == g2:
                        e = d = 0
                        while e < min(b, b2) and t[b - e - 1] == t2[b2 - e - 1]:
                            e += 1
                        while b + d < len(t) and b2 + d < len(t2) and t[b + d] == t2[b2 + d]:
                            d += 1
                        if e + d >= n:
                            best = (max(best[0], e), max(best[1], d))
                assert (low[i], high[i]) == best


# 4
def test_lines(spark, empty):
    rows = [(i, f"own {i}\n shared line \n\nrare" if i % 2 else "shared line\nrare" + "x" * (i % 3), None if i == 4 else f"s{i % 6}", i) for i in range(12)] + [(99, None, "s1", 0), (98, "", None, 0), (3, "shared line", "s9", 0), (3, "shared line", "s9", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, line long")
    sites = {}
    for _, t, s, _ in rows:
        for x in (t or "").split("\n"):
            if x.strip(" ") and s is not None:
                sites.setdefault(x.strip(" "), set()).add(s)
    bad = {x for x, s in sites.items() if len(s) >= 4}
    assert bad
    want = Counter()
    for i, t, _, _ in rows:
        each = t.split("\n") if t is not None else []
        left = [x for x in each if x.strip(" ") not in bad]
        want[(i, "\n".join(left) if t is not None else None, len(each), len(each) - len(left))] += 1
    got = lines.drop_boilerplate(df, "source", sites=4)
    assert rows_of(got, "doc_id", "text", "n_lines", "n_removed") == want and "line" in got.columns
    assert lines.drop_boilerplate(empty, "source").count() == 0


# 5
def test_secrets(spark, empty):
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    value, check = zlib.crc32(body.encode()), ""
    while value or len(check) < 6:
        check, value = secrets.BASE62[value % 62] + check, value // 62
    texts = [None, "", "é PASSWORD = 'hunter22' token:abc secret:x1y2z3secret=qqqqqq", "AKIA" + "B" * 16 + " AKIAB", "f" * 30 + "é" + "0" * 23, "x" * 13 + "deadbeef" * 3 + "g", f"ghp_{body}{check} ghp_{body}00000Z", "card 4111 1111 1111 1111, card 4111 1111 1111 1112", "apİkey api_key:abcdef12", "ſecret=abcdefg"]
    got = secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in secrets.ACCESS.finditer(t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in secrets.HEX.finditer(t) if len(m[0]) >= 24]
        assert [(s["first"], secrets.KINDS.index(s["kind"]), s["end"]) for s in r["secrets"] if s["kind"] in secrets.KINDS[:3]] == sorted(want)
    kinds = [[s["kind"] for s in r["secrets"]] for r in got]
    assert kinds[6] == ["github"] and kinds[7] == ["card"] and kinds[3] == ["access"] and kinds[9] == []
    assert secrets.scan_secrets(empty, ["doc_id"]).count() == 0


# 6
def test_nearest(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 16)).astype(np.float32)
    v[50:120] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (450, [0.0] * 16), (500, [float("nan")] * 16), (550, [1.0] * 3), (600, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 400, 50))
    hit = 0
    d = v.astype(np.float64)
    norms = np.sqrt((d * d).sum(1))
    for q, found in got.items():
        score = (d * d[q]).sum(1) / (norms * norms[q])
        score[q] = -9
        best = np.lexsort([np.arange(400), -score])[:5]
        found.sort()
        assert [x[0] for x in found] == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(score[i], abs=1e-12) for _, i, s in found)
        hit += len({i for _, i, _ in found} & set(best.tolist()))
    assert hit >= 0.9 * 5 * len(got)
    assert [i for _, i, _ in sorted(got[50])] == [51, 52, 53, 54, 55]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(df.filter("vec_id < 3"), F.col("vec_id") == 0).count() == 2


@pytest.mark.parametrize("levels", [4, 1])
def test_nearest_in_tight_groups(spark, monkeypatch, levels):
    monkeypatch.setattr(ann, "LEVELS", levels)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(3000, 32))
    v[:1000] = v[0] + 1e-4 * rng.normal(size=(1000, 32))  # a third, distinct and near-equal
    v[1000:1300] = np.round(v[1000] * 1000) * np.arange(1, 301)[:, None]  # exact multiples
    order = rng.permutation(3000)
    df = spark.createDataFrame([(i, v[j].tolist()) for i, j in enumerate(order)], "vec_id long, embedding array<double>").repartition(3)
    place = np.argsort(order)
    asked = [int(i) for j in (*range(0, 1000, 25), 1100) for i in [place[j]]]
    found = {}
    for r in ann.nearest(df, F.col("vec_id").isin(asked), k=5, block=32).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found.pop(int(place[1100])) == sorted(set(place[1000:1300].tolist()) - {int(place[1100])})[:5]
    d = v[order] / np.linalg.norm(v[order], axis=1, keepdims=True)
    recall = []
    for q, got in found.items():
        far = ((d - d[q]) ** 2).sum(1)
        far[q] = 9
        recall.append(len(set(got) & set(np.argsort(far)[:5].tolist())) / 5)
    assert len(recall) == 40 and np.mean(recall) >= 0.97 and min(recall) >= 0.6


def test_hilbert_curve_is_one_path():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = ann.hilbert_keys(cells, 3)
    assert sorted(key) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# 7
def test_ring(spark, docs, empty):
    got = ring.assign(docs, F.col("doc_id"), 7, virtual=8, lots=3)
    rows = got.collect()
    assert len(rows) == len(DOCS) and set(docs.columns) <= set(got.columns)
    per = Counter(r["shard"] for r in rows)
    assert set(per) == set(range(7)) and max(per.values()) - min(per.values()) <= 1
    for s, n in per.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    assert ring.assign(empty, F.col("doc_id"), 7).count() == 0
    hot = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("doc_id"))
    assert Counter(r["shard"] for r in ring.assign(hot, F.col("doc_id"), 5).collect()) == Counter(dict.fromkeys(range(5), 200))


def test_ring_moves_little():
    points = ring.arcs(24, 64)
    counts = {a: 10 + a % 7 for a in range(len(points))}
    total = sum(counts.values())
    moves = ring.walk(counts, points, [total // 24 + (s < total % 24) for s in range(24)])
    assert sum(hi - lo for _, lo, hi, _, _ in moves) == total
    assert sum(hi - lo for a, lo, hi, s, _ in moves if points[a][1] == s) > 0.8 * total


# 8
def brute_targets(sizes, share, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * level >= most * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in free}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_mixing(spark, docs, empty):
    got = [r.asDict() for r in balance.mix(docs).collect()]
    sizes = Counter()
    for _, t, _, s, _ in DOCS:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(dict(sizes), 1.5, [5, 2, 1], 2)
    taken = Counter()
    for r in got:
        assert r["copies"] in (0, 1, 2) and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["copies"] * r["size"]
    assert len(got) == len(DOCS)
    largest = {s: max(r["size"] for r in got if r["source"] == s) for s in want}
    for s, n in want.items():  # whole copies: off by at most half of the largest document
        assert abs(taken[s] - n) <= largest[s] / 2
    assert balance.mix(empty).count() == 0
    again = Counter((r["doc_id"], r["copies"]) for r in balance.mix(docs).collect())
    assert again == Counter((r["doc_id"], r["copies"]) for r in got)


def brute_rates(sizes, sources, wanted, most):
    """The rates of least entropy by plain Newton steps with halving, on all documents and the full Hessian."""
    names = sorted(wanted)
    uniform = sum(wanted[s] / sum(n for n, o in zip(sizes, sources) if o == s) for s in sources)
    design = np.array([[n if o == s else 0 for s in names] + [1] for n, o in zip(sizes, sources)], float) / [*[np.mean(sizes)] * len(names), 1]
    goal = np.array([wanted[s] / np.mean(sizes) for s in names] + [uniform])
    dual = lambda w: most * np.logaddexp(0, design @ w - np.log(most - 1)).sum() - goal @ w
    w = np.zeros(len(goal))
    for _ in range(200):
        rate = most / (1 + np.exp(-(design @ w - np.log(most - 1))))
        g = design.T @ rate - goal
        step = -np.linalg.lstsq(design.T @ (design * (rate * (1 - rate / most))[:, None]), g, rcond=None)[0]
        t = 1.0
        while dual(w + t * step) > dual(w) + 1e-4 * t * (g @ step) and t > 1e-6 and abs(g).max() > 1e-6:
            t /= 2
        w = w + t * step
    return rate


@pytest.mark.parametrize("most", [2.0, 3.0])
def test_rates_by_brute_force(spark, most):
    rng = random.Random(31)
    docs = [(s, rng.choice([1, 2, 5, 9, 30, 200]) + rng.randrange(3)) for s in "abc" for _ in range(40)]
    size = Counter()
    for s, n in docs:
        size[s] += n
    wanted = {"a": 0.4 * size["a"], "b": 0.9 * most * size["b"], "c": 1.1 * size["c"]}
    units = spark.createDataFrame([(s, n, k) for (s, n), k in Counter(docs).items()] + [("full", 7, 3), ("none", 4, 4), (None, 0, 5)], "source string, size long, n long")
    table = spark.createDataFrame([*wanted.items(), ("full", 21 * most), ("none", 0.0), (None, 0.0)], "source string, target double")
    lam, mu = balance.multipliers(units, table, most)
    lam = {r["source"]: r["lam"] for r in lam.collect()}
    assert set(lam) == {"a", "b", "c"}
    got = np.array([most / (1 + np.exp(-(-np.log(most - 1) + lam[s] * n + mu))) for s, n in docs])
    want = brute_rates([n for _, n in docs], [s for s, _ in docs], wanted, most)
    assert got == pytest.approx(want, abs=1e-6) and len(np.unique(got.round(6))) > 20  # rates depend on the documents
    for s, n in wanted.items():
        assert sum(r * m for r, (o, m) in zip(got, docs) if o == s) == pytest.approx(n, rel=1e-8)
    one_size = spark.createDataFrame([("a", 10, 5), ("b", 10, 2)], "source string, size long, n long")
    alone, mu = balance.multipliers(one_size, spark.createDataFrame([("a", 25.0), ("b", 30.0)], "source string, target double"), 2.0)
    assert {r["source"]: 2 / (1 + np.exp(-(r["lam"] * 10 + mu))) for r in alone.collect()} == {"a": pytest.approx(0.5), "b": pytest.approx(1.5)}


def test_rounding_follows_rates(spark):
    rng = random.Random(37)
    rows = [(i, "w " * rng.choice([1, 3, 10, 400]), rng.choice(["x", "y", "z", None])) for i in range(700)]
    got = balance.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), lot=40).collect()
    due, taken = Counter(), Counter()
    for r in got:
        assert 0 <= r["rate"] <= 2 and r["copies"] in (0, 1, 2)
        due[r["source"]] += r["rate"] * r["size"]
        taken[r["source"]] += r["copies"] * r["size"]
        due["target", r["source"]] = r["target"]
    for s in ("x", "y", "z", None):
        assert due[s] == pytest.approx(due["target", s], rel=1e-6) and abs(taken[s] - due[s]) <= 0.01 * due[s] + 20


# 9
def test_quality(spark, empty):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["la", "vie", "est", "belle"] if i % 2 else ["$$$", "%%#", "!!", "la"]) for _ in range(rng.randint(5, 400)))) for i in range(300)]
    docs = spark.createDataFrame([*rows, (300, None), (301, "")], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([*((i, i % 2, 0) for i in range(300)), (300, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in bytenet.score_quality(docs, labels, ["doc_id"]).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i % 2 == 1) for i in held]) > 0.95
    assert 0 <= got[300] == got[301] <= 1
    assert bytenet.score_quality(empty, labels.limit(0), ["doc_id"]).count() == 0


def test_sample_is_taken_of_usable_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(bytenet.Net, "train", lambda net, texts, labels: seen.append((texts, labels)) or net)
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, quality int")
    free = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5]
    some = free[::100]  # few labels have a text
    docs = spark.createDataFrame([(i, "ab" * 10) for i in some], "doc_id long, text string")
    bytenet.train_quality(docs, labels, rows=12)
    assert len(seen[-1][0]) == 12
    # long texts: a window
    docs = spark.createDataFrame([(i, f"{i:04}" * 50) for i in some], "doc_id long, text string")
    bytenet.train_quality(docs, labels, rows=12, most=100)
    assert len(seen[-1][0]) == 12 and {len(t) for t in seen[-1][0]} == {100}
    texts = {i: (f"{i:04}" * 50).encode() for i in some}
    assert all(any(t in x and i % 2 == q for i, x in texts.items()) for t, q in zip(*seen[-1], strict=True))
    with pytest.raises(ValueError, match="no labelled text"):
        bytenet.train_quality(docs, labels.filter("doc_id < 0"))
    bytenet.train_quality(docs.limit(0), labels)
    assert seen[-1] == ([], [])


def test_network_covers_whole_texts():
    net = bytenet.Net()
    rng = np.random.default_rng(0)
    texts = [rng.integers(1, 255, n).astype(np.uint8) for n in (1, 4, 255, 256, 257, 2000)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = net.scores(np.concatenate(texts), offsets)
    for i, t in enumerate(texts):
        assert net.scores(t, np.array([0, len(t)]))[0] == pytest.approx(together[i], abs=1e-6)
        padded = np.concatenate([t, np.zeros(bytenet.WIDTH - 1, np.uint8)])
        outputs = sum(net.filters[o][padded[o : o + len(t)]] for o in range(bytenet.WIDTH))
        top = np.array([outputs[a : a + 2 * bytenet.BLOCK].max(0) for a in range(0, len(t), bytenet.BLOCK)])
        chunk = np.maximum(top + net.bias, 0)
        assert net.features(t, np.array([0, len(t)]))[0] == pytest.approx(np.concatenate([chunk.max(0), chunk.mean(0)]), abs=1e-4)


def test_long_texts_go_in_pieces(monkeypatch):
    net, rng = bytenet.Net(), np.random.default_rng(3)
    for n in (1025, 1500, 2048, 3001, 3071, 3075):
        text = rng.integers(1, 255, n).astype(np.uint8)
        whole = net.features(text, np.array([0, n]))
        monkeypatch.setattr(bytenet, "GROUP_BYTES", 1024)
        assert net.features(text, np.array([0, n]))[0] == pytest.approx(whole[0], abs=1e-5)
        monkeypatch.undo()


# 10
def test_spans(docs, empty):
    window, first = 6, {}
    split = [(i, (t or "").encode().split()) for i, t, *_ in DOCS]
    for i, w in split:
        for p in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[p : p + window])
                first[k] = min(i, first.get(k, i))
    want = Counter()
    for i, w in split:
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        want[(i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())] += 1
    got = debruijn.dedup_spans(docs, window=window, core=3)
    assert rows_of(got, *got.columns) == want
    assert debruijn.dedup_spans(empty).count() == 0


def test_compaction_stops_at_branches(spark):
    # coordinates are single letters; an edge is a pair of them
    texts = {1: "abcdefg", 2: "xbcdey", 3: "abcdefg"}
    rows = [(ord(t[i]), ord(t[i + 1]), 0, d * 10, d, i) for d, t in texts.items() for i in range(len(t) - 1)]
    got = debruijn.compacted(spark.createDataFrame(rows, "u long, v long, e int, rid long, doc_id long, first int"))
    # b and e have two edges in or out; a and c, d are inner or ends
    assert sorted(map(tuple, got.collect())) == [(20, 1, 3), (30, 0, 1), (30, 1, 3), (30, 4, 2)]


def test_spans_of_longer_windows(spark):
    rng = random.Random(31)
    some = lambda n: [rng.choice("abc") for _ in range(n)]
    rows = [(rng.randint(0, 25), " ".join(some(rng.randint(0, 60)))) for _ in range(40)]
    first = {}
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - 4):
            first[tuple(w[p : p + 5])] = min(i, first.get(tuple(w[p : p + 5]), i))
    want = Counter()
    for i, t in rows:
        w = t.split()
        gone = {p + x for p in range(len(w) - 4) if first[tuple(w[p : p + 5])] < i for x in range(5)}
        want[(i, len(w), len(gone))] += 1
    got = debruijn.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string"), window=5, core=2)
    assert rows_of(got, "doc_id", "n_words", "n_removed") == want


# row ids
def _digest(spark, name, folder):
    f = {"pipeline": lambda: corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)}.get(name, lambda: queries.QUERIES[name](spark, folder))
    return f()


@pytest.mark.parametrize("name", ["op2_near_dedup", "op3_substring_dedup", "op7_sharding", "op8_mixing", "op10_span_dedup", "pipeline"])
def test_splits_that_change_between_jobs(spark, tmp_path, monkeypatch, name):
    """Executors come and go, and with them the number of tasks that a scan has: rows keep their ids."""
    spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 400").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    want = rows_of(_digest(spark, name, str(tmp_path)), "*")
    sizes, key, true_stash = iter([1, 4] * 500), "spark.sql.leafNodeDefaultParallelism", common.stash

    def changing(df):
        spark.conf.set(key, str(next(sizes)))
        return true_stash(df)

    for module in (common, minhash, suffix, debruijn, balance, components):
        monkeypatch.setattr(module, "stash", changing)
    try:
        spark.conf.set(key, "4")
        df = _digest(spark, name, str(tmp_path))
        spark.conf.set(key, "1")
        assert rows_of(df, "*") == want and sum(want.values()) >= 200
    finally:
        spark.conf.unset(key)


# queries and pipeline
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    from tests.compare import assert_same

    assert_same(queries.QUERIES[name](spark, FOLDER), queries.ORACLES[name], FOLDER)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept, columns = docs, docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, FOLDER).persist()
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in kept.select("doc_id").collect()}, name
        if i < 4:
            assert out.columns == columns
        if name in ("quality", "near_dedup", "decontamination"):
            assert 0.5 * kept.count() < len(ids) == out.count()
        kept = out
    per = Counter(r["shard"] for r in kept.select("shard").collect())
    assert max(per.values()) - min(per.values()) <= 1
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(r["doc_id"] for r in kept.collect())


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_clashing_columns(spark, stage):
    names = ["score", "spans", "n_words", "items", "first", "copies", "copy", "size", "target", "source_size", "rid", "__rid", "n_shingles", "component_id", "node", "root", "label", "a.b", "__text"]
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 60").withColumns({f"{n}": F.concat(F.lit(n), F.col("doc_id")) for n in names})
    more = spark.createDataFrame([(900, None, "en", None, None), (901, "", "en", "s", 0), (None, "one more text", "en", "s", 13), (5, "a text", "en", "s", 6)], rows.select("doc_id", "text", "lang", "source", "n_chars").schema)
    rows = rows.unionByName(more, allowMissingColumns=True)
    out = corpus_pipeline.STAGES[stage][1](spark, rows, FOLDER)
    assert out.columns[: len(rows.columns)] == rows.columns
    got = out.select(*[F.col(f"`{c}`") for c in rows.columns]).collect()
    assert len(got) > 30 and set(map(tuple, got)) <= set(map(tuple, rows.collect()))


def test_stages_take_empty_tables(spark, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0
