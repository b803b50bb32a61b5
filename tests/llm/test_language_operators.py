"""Language models, collocations and token alignment against brute force on small and whole tables."""

import bisect
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.llm import alignment, collocations, langid, queries

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string"


# 11
def symbols(text):
    """A text as the model sees it, character by character."""
    out = []
    for s in map(int, langid._alphabet()[0][[ord(c) for c in text.lower()]]):
        if s != langid.BREAK or not out or out[-1] != langid.BREAK:
            out.append(s)
    return out


class Brute:
    """Interpolated Kneser-Ney over tuples of symbols, by its definition."""

    def __init__(self, texts):
        counts = Counter()
        for t in texts:
            s = [0] * (langid.ORDER - 1) + symbols(t)
            counts.update(tuple(s[i : i + langid.ORDER]) for i in range(len(s) - langid.ORDER + 1))
        self.level = {langid.ORDER: counts}
        for n in range(langid.ORDER - 1, 0, -1):
            self.level[n] = Counter(g[1:] for g in self.level[n + 1])
        self.discount, self.total, self.types = {}, {}, {}
        for n, c in self.level.items():
            once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
            self.discount[n] = max(once / (once + 2 * twice) if once + twice else 0.0, 0.1)
            self.total[n], self.types[n] = Counter(), Counter()
            for g, x in c.items():
                self.total[n][g[:-1]] += x
                self.types[n][g[:-1]] += 1

    def p(self, gram):
        n = len(gram)
        if not n:
            return 1 / langid.SYMBOLS
        h = gram[:-1]
        if not self.total[n][h]:
            return self.p(gram[1:])
        d = self.discount[n]
        return (max(self.level[n][gram] - d, 0) + d * self.types[n][h] * self.p(gram[1:])) / self.total[n][h]

    def entropy(self, text):
        s = [0] * (langid.ORDER - 1) + symbols(text)
        return -sum(math.log(self.p(tuple(s[i : i + langid.ORDER]))) for i in range(len(s) - langid.ORDER + 1)) / max(len(s) - langid.ORDER + 1, 1)


TEXTS = {"en": ["The cat sat on the mat, the dog did not.", "A thing of beauty is a joy for ever", "there then that those"], "de": ["Der Hund und die Katze; überall!", "Schöne Grüße aus dem Schwarzwald"], "ru": ["Кошка сидела на окне", "собака спит"]}
PROBES = ["the hat", "Die Hunde", "окно 7", "ΑΒΓ", "", "...", "漢字 the", "a", "x" * 50, "The\n\ncat  sat"]


def test_models_by_definition(spark):
    known = spark.createDataFrame([(t, k) for k, ts in TEXTS.items() for t in ts], "text string, lang string").repartition(3)
    names, models = sorted(TEXTS), langid._load(langid.train(known), sorted(TEXTS))
    for name, model in zip(names, models, strict=True):
        brute = Brute(TEXTS[name])
        for text in [*PROBES, *TEXTS[name]]:
            found = [g for _, _, g, _ in langid.grams([text])][0]
            assert -model.log_probability(found).sum() / max(len(found), 1) == pytest.approx(brute.entropy(text), rel=1e-5)


def test_models_in_blocks(spark):
    rows = [(i, t, k) for i, (t, k) in enumerate([(t, k) for k, ts in TEXTS.items() for t in ts] + [(p, None) for p in PROBES] + [(None, "en"), ("the the", "en")])]
    df = spark.createDataFrame(rows, SCHEMA)
    # capitals that fold to two characters, and pieces cut within a text
    learn = F.col("doc_id") < 7
    got = [{r["doc_id"]: (r["lang_pred"], round(r["score"], 9), r["rejected"], r["n_symbols"]) for r in langid.identify(df, learn, ["doc_id"], F.col("doc_id") % 3 == 1, most).collect()} for most in (langid.BLOCK_ENTRIES, 1)]
    assert got[0] == got[1] and set(got[0]) == {r[0] for r in rows}
    brute = {k: Brute([t for i, (t, own) in enumerate((t, k) for k, ts in TEXTS.items() for t in ts) if own == k and i % 3 != 1]) for k in TEXTS}
    for i, t, _ in rows:
        letters = any(c.isalpha() for c in t or "")
        want = min(sorted(k for k in brute if brute[k].level[1]), key=lambda k: brute[k].entropy(t)) if letters else "und"
        assert got[0][i][0] == want and 0 <= got[0][i][1] <= 1 and (letters or got[0][i][1] == 0 and got[0][i][2])
    assert langid.identify(df.limit(0), learn).count() == 0
    nothing = langid.identify(df, F.lit(False), ["doc_id"]).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abcİ ,.é\n") for _ in range(5000))
    whole = [g for _, _, g, _ in langid.grams([text])]
    monkeypatch.setattr(langid, "PIECE", 97)
    parts = [g for _, _, g, _ in langid.grams([text])]
    assert len(whole) == 1 and len(parts) > 40 and (np.concatenate(parts) == whole[0]).all()


def test_op11(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = queries.QUERIES["op11_language_id"](spark, FOLDER)
    assert got.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    right = Counter()
    for r in got.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        right[r["held_out"], r["lang_pred"] == docs.pop(r["doc_id"])["lang"]] += 1
    assert not docs and right[True, True] > 300 and right[True, False] <= 0.01 * right[True, True]


# 12
def brute_collocations(rows, least, share, most):
    """Counting every phrase of every piece in plain Python, with exact integers."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else "\0" if c in ".,;:!?\n\x0b\x0c\r" else c for c in text or "")
        for piece in folded.split("\0"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cands.items():
            if any(len(q) == 3 and len(p) == 2 and (q[:2] == p or q[1:] == p) and 100 * x >= share * a for q, x in cands.items()):
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:most], 1)]
    return Counter(out)


def phrase_rows():
    rng = random.Random(12)
    words = ["The", "of", "in", "New", "York", "é,", "x.y", "a\tb", "!", "ÄB", " z"]
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choices(words, [9, 7, 5, 4, 4, 2, 2, 2, 2, 1, 1], k=rng.randint(0, 60)))) for _ in range(120)]
    return [*rows, ("en", None), ("en", ""), (None, "\n\n"), ("fr", "one"), ("en", "w" * 5000 + " New York " * 3), *[("de", "a b c a b c")] * 12]


@pytest.mark.parametrize("options", [{}, {"full": 40, "burst": 3, "partition_bytes": 500}, {"full": 7, "burst": 1, "partition_bytes": 50}])
def test_collocations(spark, options):
    rows = phrase_rows()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rank long, lang string, text string").repartition(3)
    for least, share, most in ((10, 50, 2000), (3, 80, 7)):
        got = collocations.collocations(df, F.col("lang"), least, share, most, **options)
        assert Counter(map(tuple, got.collect())) == brute_collocations(rows, least, share, most)
    assert collocations.collocations(df.limit(0), F.col("lang")).count() == 0


def test_trie_spills_whole_subtrees():
    rng = np.random.default_rng(2)
    trie, want = collocations.Trie(burst=4), Counter()
    b = collocations.ID_BITS
    for _ in range(20):
        w = rng.zipf(1.5, (200, 3)) % 90 + 1
        keys, n = np.unique((w[:, 0].astype(np.int64) << 2 * b) | (w[:, 1].astype(np.int64) << b) | w[:, 2], return_counts=True)
        want.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
        trie.add(keys, n)
    assert trie.split and trie.entries == len(want)
    first, counts = trie.take(len(want) // 2)
    assert trie.entries <= len(want) // 2 and not {k >> 2 * b for k in first.tolist()} & set(trie.root)
    rest, more = trie.take(0)
    assert trie.entries == 0 and dict(zip(first.tolist() + rest.tolist(), counts.tolist() + more.tolist(), strict=True)) == dict(want)


def test_products_past_64_bits(spark):
    """a * a * 10^6 and l * r pass 64 bits; the division is exact."""
    a, left, right = 3_000_000_019, 4_000_000_007, 5_000_000_029
    df = spark.createDataFrame([("en", "", 0, 10**10), ("en", "x", 1, left), ("en", "y", 1, right), ("en", "x y", 2, a)], "lang string, phrase string, words int, a long")
    real = collocations.phrase_counts
    try:
        collocations.phrase_counts = lambda *_, **__: df
        assert tuple(collocations.collocations(df, F.col("lang")).first()) == ("en", 1, "x y", a, left, right, 10**10, 1000000 * a * a // (left * right))
    finally:
        collocations.phrase_counts = real


# 13
def brute_alignment(texts):
    made = alignment.load(f"{alignment.FOLDER}/{alignment.A_FILE}", f"{alignment.FOLDER}/{alignment.B_FILE}")
    docs = []
    for t in texts:
        a, b = made.a.encode(" " + (t or ""), add_special_tokens=False).ids, made.b.encode(t or "")
        sides = [[of[i] for i in ids] for ids, of in ((a, made.a_bytes), (b, made.b_bytes))]
        if not t or any(b"".join(x) != (" " + t).encode() for x in sides):
            docs.append(None)
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in sides]
        cut = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cut]
        for side, (ids, at) in enumerate(zip((a, b), ends, strict=True)):
            for i, e in zip(ids, at, strict=True):
                groups[bisect.bisect_left(cut, e)][side].append(i)
        begins = [[0, *e[:-1]] for e in ends]
        overlaps = [(i, j, min(ends[0][i], ends[1][j]) - max(begins[0][i], begins[1][j])) for i in range(len(a)) for j in range(len(b)) if min(ends[0][i], ends[1][j]) > max(begins[0][i], begins[1][j])] if len(a) < 300 else None
        docs.append((len(a), len(b), groups, Counter((x, y) for p, q in groups for x in p for y in q), overlaps))
    count = Counter(k for d in docs if d for k in d[3])
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        shown = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in d[2])
        out.append((d[0], d[1], len(d[2]), sum(d[3].values()), sum(n for k, n in d[3].items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in d[3].items()), hashlib.sha256(shown.encode()).hexdigest()))
    return out, docs


def awkward_texts():
    rng = random.Random(13)
    parts = ["the", "The", "Über", "naïve", "x²", "漢字かな", "🙂🏽", "don't", "3.14", "e.g.", "a.b", "¿qué?", "<|endoftext|>", "<s>", "<0x41>", "...", "!?", "Ωμέγα.", "слово,", " ", " ", "\x1c", "ﬁ", "é."]
    gaps = [" ", " ", " ", "  ", "\n", " \n", "\t", "", "   ", "\r\n"]
    texts = ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    texts += [None, "", " ", "  ", "a", " a", "a ", ".", " .", "a.", "\n", "\0", "a \0b. c", "x\0.", "▁", "a ▁ b", "a▁b", "aaaa" * 400, " " * 100, "Ä" * 333, "w. " * 200, texts[0], texts[0]]
    return texts


@pytest.mark.parametrize("limits", [{}, {"PIECE": 40, "MOST_CHARS": 60, "LONGEST": 4, "BLOCK": 16, "TOGETHER": 32}])
def test_alignment(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(alignment, k, v)
    texts = awkward_texts()
    want, docs = brute_alignment(texts)
    made = alignment.load(f"{alignment.FOLDER}/{alignment.A_FILE}", f"{alignment.FOLDER}/{alignment.B_FILE}")
    assert made.cuts and sum(x[0] > 0 for x in want) > 100 and sum(x[0] == 0 for x in want) > 3
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    batch = table.selectExpr("doc_id as __row", "text").toArrow().combine_chunks().to_batches()
    out = list(alignment._aligned(f"{alignment.FOLDER}/{alignment.A_FILE}", f"{alignment.FOLDER}/{alignment.B_FILE}", ["__row"])(iter(batch)))
    rows = [r for b in out for r in b.to_pylist()]
    for r, w, d in zip(rows, want, docs, strict=True):
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == (*w[:4], w[6]), texts[r["__row"]]
        assert dict(zip(zip(r["a"], r["b"], strict=True), r["links"], strict=True)) == (dict(d[3]) if d else {})
    if not limits:
        for head in (alignment.HEAD, 30, 0):
            got = {r[0]: tuple(r)[1:] for r in alignment.align(table, ["doc_id"], head=head).collect()}
            assert got == dict(enumerate(want))
        for r in alignment.token_links(table, ["doc_id"]).collect():
            d = docs[r["doc_id"]]
            assert [(list(g["a"]), list(g["b"])) for g in r["groups"]] == ([(list(p), list(q)) for p, q in d[2]] if d else [])
            if d and d[4] is not None:
                assert [tuple(o) for o in r["overlaps"]] == d[4]
        pairs = {r["doc_id"]: {(p["a"], p["b"]): p["links"] for p in r["pairs"]} for r in alignment.align(table, ["doc_id"], pairs=True).collect()}
        assert pairs == {i: dict(d[3]) if d else {} for i, d in enumerate(docs)}


def test_row_products():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n, k, m = (int(x) for x in rng.integers(1, 9, 3))
        x, y = (rng.integers(0, 3, s) * (rng.random(s) < 0.4) for s in ((n, k), (k, m)))
        a, b = (alignment.Csr.of(*np.nonzero(z), z[np.nonzero(z)], z.shape) for z in (x, y))
        got = alignment.product(a, b)
        dense = np.zeros((n, m), np.int64)
        dense[got.rows(), got.columns] = got.values
        assert (dense == x @ y).all()
        turned = a.transposed()
        dense = np.zeros((k, n), np.int64)
        dense[turned.rows(), turned.columns] = turned.values
        assert (dense == x.T).all()


def test_op13(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op13_token_alignment"](spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("doc_id", "bigint"), *[(c, "bigint") for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", "string")]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == dict(zip([r["doc_id"] for r in rows], brute_alignment([r["text"] for r in rows])[0], strict=True))
