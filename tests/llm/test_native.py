"""Exact dedup, mixing, sharding, secret scan."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from avsync.llm import exact_dedup, mixing, secret_scan, sharding


def test_exact_dedup(odd, odd_rows):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(odd).collect()}
    groups = defaultdict(list)
    for i, t, *_ in odd_rows:
        groups[t or ""].append(i)
    assert len(got) == len(odd_rows)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_with_a_full_filter(odd, odd_rows):
    """A filter so small that every row is a suspect changes nothing."""
    wide = exact_dedup.exact_dedup(odd).collect()
    narrow = exact_dedup.exact_dedup(odd, most_bits=exact_dedup.BLOCK_BITS, bits_per_row=1).collect()
    assert sorted(map(tuple, wide)) == sorted(map(tuple, narrow))


def test_exact_dedup_ties(spark, none):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None), (None, "")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(rows).collect()
    assert sorted((r["group_size"], r["kept"]) for r in got) == [(2, False), (2, True), (3, False), (3, False), (3, True)]
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.unique_rows(none).columns == none.columns


def water(sizes, weights=(5.0, 2.0, 1.0), most=3):
    """Targets by filling one source at a time."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def test_mixing(odd, odd_rows, none):
    got = {r["doc_id"]: r for r in mixing.mix_plan(odd).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in odd_rows}
    source = {r[0]: r[3] for r in odd_rows}
    sizes = Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    target = water(sizes)
    taken = Counter()
    for i, r in got.items():
        assert r["size"] == size[i] and r["source_size"] == sizes[source[i]]
        assert r["target"] == pytest.approx(target[source[i]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[source[i]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * max(n for i, n in size.items() if source[i] == s)
    assert {r["doc_id"]: r["copies"] for r in mixing.mix_plan(odd.repartition(5)).collect()} == {i: r["copies"] for i, r in got.items()}
    mixed = Counter(r["doc_id"] for r in mixing.mix(odd).collect())
    assert mixed == Counter({i: r["copies"] for i, r in got.items() if r["copies"]})
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix_plan(none).count() == 0


def test_sharding(odd, odd_rows, none):
    rows = sharding.shard_documents(odd, shards=4).collect()
    assert len(rows) == len(odd_rows)
    texts = {r[0]: (r[1] or "") for r in odd_rows}
    held = defaultdict(list)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        assert r["law"] == "rows" and r["grown_shard"] is None
        held[r["shard"]].append(r["slot"])
    assert {len(v) for v in held.values()} <= {len(rows) // 4, -(-len(rows) // 4)}
    assert all(sorted(v) == list(range(len(v))) for v in held.values())
    shard = {r["doc_id"]: r["shard"] for r in rows}
    groups = defaultdict(set)
    for i, t in texts.items():
        groups[t].add(shard[i])
    assert all(len(s) == 1 for s in groups.values())
    assert sharding.shard_documents(none).count() == 0


def test_sharding_of_a_group_too_large(spark):
    """Half of all rows are one group: it fills some shards, and sizes stay even."""
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 100, "same").otherwise(F.concat(F.lit("t"), (F.col("id") / 2).cast("int"))).alias("text"))
    got = sharding.shard_documents(rows, shards=8).collect()
    counts = Counter(r["shard"] for r in got)
    assert set(counts.values()) == {25}
    pure = Counter(r["shard"] for r in got if r["doc_id"] < 100)
    assert len(pure) < 8 and max(pure.values()) >= 24  # dealt at random, each shard would hold about 12


def test_secrets(spark, none):
    key = "AKIA" + "Q3M7" * 4
    texts = [
        f"some words {key} and more", "password=9f86d081884c7d659a more words", 'set token = "0a4d55a8d778e5022fab701977c5d840bbc486d0"### now', None, "",
        "mail someone.42@mail1.example.com today", "call +1 (555) 555-0100 or 10.20.30.40 now", "card 4041894974608795 here", f"again {key}", f"again {key}",
        "secret: 7c211433f02071597741e6ff5a8ea34789abbf43", "words abcdefgh12 words",
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts * 3)], "doc_id long, text string, value int")
    got = secret_scan.scan_secrets(df).collect()
    hash_of = lambda v: hashlib.sha256(v.encode()).hexdigest()
    secret = {(r["doc_id"] % len(texts), r["value_sha256"]) for r in got if r["secret"]}
    want = {(0, hash_of(key)), (1, hash_of("9f86d081884c7d659a")), (2, hash_of("0a4d55a8d778e5022fab701977c5d840bbc486d0")), (8, hash_of(key)), (9, hash_of(key)), (10, hash_of("7c211433f02071597741e6ff5a8ea34789abbf43"))}
    assert want <= secret and not {5, 6, 7} & {i for i, _ in secret}
    assert secret_scan.scan_secrets(none).count() == 0


def test_secrets_without_digits(spark):
    """Short and letters-only values beside a credential's name, and key headers, are findings."""
    texts = {
        0: ["password=CorrectHorseBattery now", "CorrectHorseBattery"],
        1: ["the secret: qWzXpLmNkTrVbYsD here", "qWzXpLmNkTrVbYsD"],
        2: ["pwd=abc", "abc"],
        3: ["api_key = XyZ", "XyZ"],
        4: ["my password is hunter ok", "hunter"],
        5: ["x -----BEGIN RSA PRIVATE KEY----- MIIE", "-----BEGIN RSA PRIVATE KEY-----"],
        6: ["-----BEGIN PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"],
        7: ['{"user":"bob","password":"CorrectHorse","n":1}', "CorrectHorse"],
        8: ["Bearer QwErTy", "QwErTy"],
        9: ["password=!!!!", "!!!!"],
    }
    plain = ["no names of any kind BEGIN here", "password=", "password =", None, "tokens"]
    rows = [(i, t) for i, (t, _) in texts.items()] + [(100 + i, t) for i, t in enumerate(plain)]
    got = {(r["doc_id"], r["value"]) for r in secret_scan.findings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, v) for i, (_, v) in texts.items()} <= got and not any(i >= 100 for i, _ in got)
    # the forest keeps random letters and headers, and removes the words of a sentence
    key = "9f86d081884c7d659a2feaa0c55ad015"
    more = [(200 + i, f"password={key[i:]}{key[:i]} the token count of author words") for i in range(12)]
    got = secret_scan.scan_secrets(spark.createDataFrame([*rows, (10, "token=aBcDXyZwQrStUvKk"), *more], "doc_id long, text string")).collect()
    secret = {(r["doc_id"], r["value_sha256"]) for r in got if r["secret"]}
    hash_of = lambda v: hashlib.sha256(v.encode()).hexdigest()
    assert {(i, hash_of(texts[i][1])) for i in (1, 5, 6)} <= secret
    assert not {hash_of("count"), hash_of("words")} & {v for _, v in secret}


def test_secrets_with_an_at_sign(spark):
    """A value with @ is a certain false finding only as an address without a credential's name."""
    secrets = ["DB_PASSWORD=p@ssw0rd1234XYZ", "postgres://admin:S3cr3tPassw0rd@db/x", "token=f3A9@kQ27xZ81mW4bT6v", "password=someone.42@mail1.example.com"]
    rows = [(i, t) for i, t in enumerate(secrets)] + [(10, "mail someone.42@mail1.example.com today"), (11, "amqp://bob:CorrectHorse@host/x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = secret_scan.described(secret_scan.findings(df), secret_scan.dictionary(df))
    label = {r["doc_id"]: r["label"] for r in found.withColumn("label", secret_scan.sure_label()).collect()}
    assert label[10] == 0.0 and label[1] == label[2] == 1.0 and label[0] is None and label[3] != 0.0 and 11 in label
    key = "9f86d081884c7d659a2feaa0c55ad015"
    more = [(20 + i, f"password={key[i:]}{key[:i]} mail a.{i}77@mail{i}.example.com or call +1555555010{i}") for i in range(10)]
    got = secret_scan.scan_secrets(spark.createDataFrame([*rows, *more], "doc_id long, text string")).collect()
    assert {0, 1, 2} <= {r["doc_id"] for r in got if r["secret"]} and 10 not in {r["doc_id"] for r in got if r["secret"]}


def test_secrets_of_one_class(spark):
    """Without a sure secret in the corpus, addresses and numbers are not taken for secrets."""
    texts = ["mail someone.42@mail1.example.com today", "call +1 (555) 555-0100 or 10.20.30.40 now", "pwd=abc", "words abcdefgh12 words"]
    got = secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) >= 4 and not any(r["secret"] or r["probability"] for r in got)
    only = spark.createDataFrame([(1, "password=9f86d081884c7d659a2feaa0c55ad015")], "doc_id long, text string")
    assert [(r["secret"], r["probability"]) for r in secret_scan.scan_secrets(only).collect()] == [(True, 1.0)]


def test_mixing_of_repeated_and_missing_ids(spark):
    """Rows that share an id, or have none, come as often as the plan says, not by pairs."""
    rows = [(None, f"w{i} " * 5, "a") for i in range(40)] + [(7, "same words here", "b")] * 30 + [(i, f"v{i} " * 9, None) for i in range(100, 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan = mixing.mix_plan(df).collect()
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    got = mixed.collect()
    assert len(got) == sum(r["copies"] for r in plan)
    wanted, taken = Counter(), Counter(r["doc_id"] for r in got)
    for r in plan:
        wanted[r["doc_id"]] += r["copies"]
    assert taken == +wanted and max(Counter(r["text"] for r in got if r["doc_id"] is None).values()) <= 3
