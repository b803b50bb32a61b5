"""Hostile input: words that hashes of a kind can't tell apart, nested headers, mixed widths, clashing names, very long texts and words."""

import hashlib
import json
from base64 import urlsafe_b64encode
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandframe.llm import alignment, ann, balance, bytenet, collocations, debruijn, decontaminate, langid, lines, minhash, queries, secrets, suffix
from strandframe.llm import text as tx


def thue_morse(n):
    """A string of n (a power of two) letters and its complement: equal modulo 2**64 under every polynomial from 1,024 on."""
    bits = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return bits, bits.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents for the queries: pairs that differ in one Thue-Morse word, and pairs that don't."""
    path = tmp_path_factory.mktemp("hostile")
    rows = []
    for n in (1024, 2048, 4096):
        one, other = thue_morse(n)
        head, tail = (" ".join(f"{x}{n}w{i}" for i in range(6)) for x in "pq")
        rows += [f"{head} {one} {tail}", f"{head} {other} {tail}"]
        rows += [" ".join([one] * 4), " ".join([other] * 4)]
    rows += [rows[0], rows[0].upper()]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_words_are_told_apart(folder):
    for n in (1024, 2048, 4096):
        for values in (tx.BYTE_VALUES, tx.FOLDED_VALUES):
            data = " ".join(thue_morse(n)).encode()
            hashes, _ = tx.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), values)
            assert len(hashes) == 2 and hashes[0] != hashes[1]


def test_op2_links_equal_words_only(spark, folder):
    path, rows = folder
    got = {r["doc_id"]: r["component_id"] for r in queries.QUERIES["op2_near_dedup"](spark, path).collect()}
    copies = {len(rows) - 2: 0, len(rows) - 1: 0}
    assert got == {i: copies.get(i, i) for i in range(len(rows))}


def test_op10_removes_equal_words_only(spark, folder):
    path, rows = folder
    got = {r["doc_id"]: r["n_removed"] for r in queries.QUERIES["op10_span_dedup"](spark, path).collect()}
    assert got == {i: 13 if i == len(rows) - 2 else 0 for i in range(len(rows))}


def test_op3_removes_equal_bytes_only(spark, folder):
    path, rows = folder
    seen = Counter(t.encode()[p : p + 400] for t in rows for p in range(len(t.encode()) - 399))
    for r in queries.QUERIES["op3_substring_dedup"](spark, path).collect():
        raw = rows[r["doc_id"]].encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 399):
            if seen[raw[p : p + 400]] > 1:
                gone[p : p + 400] = True
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        assert (r["n_removed"], r["kept_sha256"]) == (int(gone.sum()), hashlib.sha256(kept).hexdigest())


def test_confirmation_compares_words():
    texts = [b"A b c d e", b"a B c d", b"", None, b"x y", b"X  Y", "Ä b c d".encode(), "ä b c d".encode()]
    got = [set(x.tolist()) for x in minhash.exact_sets(texts, 4)]
    assert [len(x) for x in got] == [2, 1, 0, 0, 1, 1, 1, 1]
    assert got[1] < got[0] and got[4] == got[5] and not got[6] & got[7]
    many = [b" ".join(str((i * 7919 + j) % 70001).encode() for j in range(40)) for i in range(4000)]  # too many words to pack five at once
    for t, s in zip(many[:50], minhash.exact_sets(many, 5), strict=False):
        w = t.split()
        assert len(s) == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})


def test_nested_header(spark):
    code = lambda x: urlsafe_b64encode(x.encode()).decode().rstrip("=")
    deep = code('{"alg":' + "[" * 200_000 + "]" * 200_000 + "}")
    good = code(json.dumps({"alg": "HS256"}))
    body = code(json.dumps({"sub": "1"}))
    rows = [(1, f"{deep}.{body}.sig"), (2, f"{good}.{body}.sig"), (3, "x")]
    got = {r["doc_id"]: [s["kind"] for s in r["secrets"]] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got == {1: [], 2: ["jwt"], 3: []}


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(0, [1.0, 2.0])] + [(i, rng.normal(size=8).tolist()) for i in range(1, 101)] + [(i, rng.normal(size=3).tolist()) for i in range(101, 131)] + [(200, [1e-300, 3e-300]), (201, [0.0] * 8), (202, None)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=5).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {0, 50, 100, 200} and [x[1] for x in found[0]] == [200]
    by_id = {i: np.array(v) for i, v in rows if v}
    for q in (50, 100):
        score = {i: v @ by_id[q] / np.linalg.norm(v) / np.linalg.norm(by_id[q]) for i, v in by_id.items() if len(v) == 8 and v.any() and i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:5]
        assert [x[1] for x in sorted(found[q])] == best and [x[2] for x in sorted(found[q])] == pytest.approx([score[i] for i in best], rel=1e-14)


NAMES = "rid spans items n_words __text text_ secrets score line n_lines n_removed size rate copies target lang_pred rejected n_a pairs a b links kept kept_sha256 n_shingles first component_id".split()


@pytest.fixture(scope="module")
def clashing(spark):
    word, passage = "w" * 150_000, " ".join(f"k{i}" for i in range(12))
    rows = [(1, None, "en", "s"), (2, "", "en", None), (3, f"{passage} {word} {passage}", "en", "s"), (3, f"{passage} {word} {passage}", "en", "s"), (4, " ".join(f"v{i % 977}" for i in range(60_000)), "de", "t"), (None, passage, None, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({n: F.lit(f"kept {n}") for n in NAMES})


def whole(df, new, docs):
    """Every document comes out once, the new columns are there once, and all others as they were."""
    assert len(set(df.columns)) == len(df.columns) and set(df.columns) == set(docs.columns) | set(new)
    kept = [c for c in docs.columns if c not in new and c != "text"]
    assert Counter(map(tuple, df.select(kept).collect())) == Counter(map(tuple, docs.select(kept).collect()))
    return df.collect()


def test_clashing_names_and_long_words(spark, clashing):
    every = clashing.columns
    bench = spark.createDataFrame([(7, "k0 k1 k2 k3 k4 k5 k6 k7 k8 k9"), (8, None)], "item_id long, text string").withColumn("n_words", F.lit(1))
    got = whole(decontaminate.decontaminate(clashing, bench, every), ["n_words", "spans", "items"], clashing)
    assert sorted(len(r["spans"]) for r in got) == [0, 0, 0, 1, 2, 2]
    whole(secrets.scan_secrets(clashing, every), ["secrets"], clashing)
    whole(lines.drop_boilerplate(clashing, "source"), ["n_lines", "n_removed"], clashing)
    whole(bytenet.score_quality(clashing, spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, quality int"), every, bytenet.Net()), ["score"], clashing)
    whole(balance.mix(clashing), ["size", "source_size", "target", "rate", "copies"], clashing)
    got = whole(minhash.label_components(clashing, 5), ["n_shingles", "component_id", "first"], clashing)
    assert sum(r["first"] for r in got) == 5
    got = whole(langid.identify(clashing, F.lit(True)), ["lang_pred", "score", "rejected", "cross_entropy", "n_symbols"], clashing)
    assert {r["lang_pred"] for r in got if not r["text"]} == {"und"}
    got = whole(alignment.align(clashing), ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"], clashing.drop("a", "b", "links", "pairs"))
    assert [r["n_groups"] == 0 for r in got] == [not r["text"] for r in got]
    assert {r["n_removed"] for r in debruijn.dedup_spans(clashing).collect()} == {0}
    assert sorted(r["n_removed"] > 150_000 for r in suffix.dedup_substrings(clashing).collect()) == [False] * 3 + [True] * 3  # the last one repeats itself
    assert collocations.collocations(clashing, F.col("lang")).count() > 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[1:4], ids=lambda s: s[0])
def test_stages_take_long_texts_and_repeated_rows(spark, clashing, stage, tmp_path):
    for name, rows, schema in (("labels", [(3, 1)], "doc_id long, quality int"), ("benchmark", [(7, "k0 k1 k2 k3 k4 k5 k6 k7 k8 k9")], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = stage[1](spark, clashing, str(tmp_path)).collect()
    ids = Counter(r["doc_id"] for r in got)
    if stage[0] == "near_dedup":
        assert ids == {1: 1, 2: 1, 3: 1, 4: 1, None: 1}
    elif stage[0] == "decontamination":
        assert ids == {1: 1, 2: 1, 4: 1}
    else:
        assert set(ids) <= {3, 4, None} and max(ids.values()) <= 4
