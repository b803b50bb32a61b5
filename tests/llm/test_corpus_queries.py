"""The registered queries over a whole small folder, held against brute force where they have no SQL."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandframe.llm import queries, secrets
from tests.llm.test_operators import brute_substrings, brute_targets

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def table(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def result(spark, name, types, folder=FOLDER):
    df = queries.QUERIES[name](spark, folder)
    assert df.dtypes == types
    return df.collect()


def test_op3(spark, table):
    got = result(spark, "op3_substring_dedup", [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")])
    assert Counter(map(tuple, got)) == Counter({r[:5]: n for r, n in brute_substrings([(i, r["text"]) for i, r in table.items()], 400, 400).items()})


def test_op5(spark):
    folder = "/root/testdata/sf0.01"  # the smaller one has no secrets
    table = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = result(spark, "op5_secret_scan", [("doc_id", "bigint"), ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")], folder)
    assert len(got) == len(table)
    rules = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    some = 0
    for r in got:
        text = table[r["doc_id"]]["text"] or ""
        base = sorted((m.start(), k, m.end(), name) for k, (name, p, counts) in enumerate(rules) for m in p.finditer(text) if counts(m))
        listed = [f"{name}:{a}:{b}" for a, _, b, name in base]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[3] == k for x in base) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert [x for x in spans if x.split(":")[0] in ("assign", "access", "hex")] == listed and all(x.split(":")[0] in secrets.KINDS for x in spans)
        some += len(base)
    assert some > 5


def test_op6(spark):
    got = defaultdict(list)
    for r in result(spark, "op6_nearest", [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]):
        got[r["query_id"]].append(tuple(r)[1:])
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert set(got) == set(ids[ids % 50 == 0].tolist())
    hit = 0
    for q, found in got.items():
        score = v @ v[ids == q][0]
        best = [i for i in np.lexsort([ids, -score]) if ids[i] != q][:5]
        assert [x[0] for x in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(score[ids == i][0], abs=1e-12) for _, i, s in found)
        hit += len({i for _, i, _ in found} & set(ids[best].tolist()))
    assert hit >= 0.9 * 5 * len(got)


def test_op7(spark, table):
    got = result(spark, "op7_sharding", [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")])
    raw = {i: (r["text"] or "").encode() for i, r in table.items()}
    assert Counter(tuple(r)[:4] for r in got) == Counter((i, len(t) + 8, zlib.crc32(t), "rows") for i, t in raw.items())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(24)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op8(spark, table):
    got = result(spark, "op8_mixing", [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")])
    size = {i: len(WORD.findall(r["text"] or "")) for i, r in table.items()}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for i, r in table.items():
        sizes[r["source"]] += size[i]
        largest[r["source"]] = max(largest[r["source"]], size[i])
    want = brute_targets(dict(sizes), 1.5, [5, 2, 1], 2)
    assert Counter(r["doc_id"] for r in got) == Counter(list(table))
    for r in got:
        s = table[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - n) <= largest[s] / 2 for s, n in want.items())
    assert Counter(map(tuple, got)) == Counter(map(tuple, queries.QUERIES["op8_mixing"](spark, FOLDER).collect()))


def test_op9(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in result(spark, "op9_quality", [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")], folder)}
    assert set(got) == {r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r["doc_id"] in got]
    held = [got[i]["predicted"] == q for i, q in labels if got[i]["held_out"]]
    print(len(held), np.mean(held))
    assert len(held) > 30 and np.mean(held) > 0.9
