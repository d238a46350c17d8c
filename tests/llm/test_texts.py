"""N-gram join, decontamination, token output, separator scan, against plain loops."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from avsync.llm import decontamination as deco
from avsync.llm import ngram_join, separator_scan, token_output
from avsync.llm.common import OddTable, components, odd_between, odd_bitmap, only_in
from avsync.session import new_dir


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(sets):
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * len(sets[a] | sets[b]):
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def test_ngram_join(odd, odd_rows, none):
    sets = {r[0]: shingle_set(r[1]) for r in odd_rows}
    want = plain_components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(odd).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}
    assert {r["doc_id"] for r in ngram_join.one_of_each(odd).collect()} == {i for i in sets if want[i] == i}
    assert ngram_join.near_duplicates(none).count() == 0


def test_ngram_join_borders(spark):
    """Chains of texts whose neighbours are just above or just below the threshold, and rows of one id."""
    rng = random.Random(9)
    texts = {}
    words = [f"w{k}" for k in range(60)]
    for k in range(40):
        texts[k] = " ".join(words)
        words = list(words)
        at = rng.randrange(len(words))
        words[at] = f"x{k}"
        if k % 3 == 0:
            words = words[rng.randint(1, 4) :] + [f"y{k}_{j}" for j in range(rng.randint(0, 5))]
    sets = {i: shingle_set(t) for i, t in texts.items()}
    df = spark.createDataFrame([*texts.items(), (3, texts[3]), (None, texts[4]), (None, None)], "doc_id long, text string")
    got = defaultdict(set)
    for r in ngram_join.near_duplicates(df).collect():
        got[r["doc_id"]].add(r["component_id"])
    want = plain_components(sets)
    assert {i: got[i] for i in texts} == {i: {c} for i, c in want.items()}
    assert 1 < len(set(want.values())) < len(texts)


def test_one_of_each_row(spark):
    """One row stays of equal or linked texts, whatever their ids."""
    base = [f"w{k}" for k in range(60)]
    near = " ".join([*base[:-1], "x"])
    rows = [(5, " ".join(base)), (5, " ".join(base)), (None, " ".join(base)), (9, near), (None, "only here without an id"), (None, "only here without an id")]
    rows += [(3, "one text of id three"), (3, "quite another text of the id"), (1, ""), (1, None), (2, None), (None, None), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stay = ngram_join.one_of_each(df)
    assert stay.columns == df.columns
    got = [(r["doc_id"], (r["text"] or "").strip()) for r in stay.collect()]
    want = [(5, " ".join(base)), (None, "only here without an id"), (3, "one text of id three"), (3, "quite another text of the id"), (1, ""), (2, ""), (None, "")]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_ngram_join_without_leaders(spark):
    """The tree alone finds every link."""
    rng = random.Random(2)
    base = [f"w{k}" for k in range(50)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(50)] = f"v{rng.randrange(30)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components({i: shingle_set(t) for i, t in rows})
    classes, links, found = ngram_join.link_classes(df, rounds=0)
    name = {r["node"]: r["component"] for r in found.collect()}
    assert {r["doc_id"]: name.get(r["set"], r["set"]) for r in classes.collect()} == want


def test_ngram_join_texts_of_one_id(spark):
    """Each text of a repeated id has its links, and a row without id links its neighbours."""
    a, c, e = ([f"{k}{j}" for j in range(60)] for k in "ace")
    near = lambda w: " ".join([*w[:-1], "x"])
    further = " ".join(["y", "z", "u", *e[3:]])
    rows = [(1, " ".join(a)), (1, " ".join(c)), (2, near(a)), (3, near(c)), (7, " ".join(["q", *e[1:]])), (None, " ".join(e)), (8, further), (None, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.near_duplicates(df).collect())
    ends = [("1", 56, "1"), ("1", 56, "1"), ("2", 56, "1"), ("3", 56, "1"), ("7", 56, "7"), ("None", 56, "7"), ("8", 56, "7"), ("None", 0, "None"), ("4", 0, "4")]
    assert got == sorted(ends)


def test_word_hashes(monkeypatch):
    """A word has one hash wherever it stands, and others have others, across borders of slices too."""
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcé日") for _ in range(rng.randint(1, 9))) for _ in range(400)] + ["a" * 300, "b" * 300]
    words = [rng.choice(pool) for _ in range(5000)]
    raw = "".join(w + rng.choice([" ", "\t", "\n \r", "\x0b\x0c"]) for w in words).encode()
    whole = ngram_join.word_hashes(raw)
    pairs = set(zip(words, whole.tolist(), strict=True))
    assert len(pairs) == len(set(words)) == len(set(whole.tolist()))
    monkeypatch.setattr(ngram_join, "SLICE", 100)
    ngram_join._powers.cache_clear()
    assert (ngram_join.word_hashes(raw) == whole).all()
    ngram_join._powers.cache_clear()
    assert len(ngram_join.word_hashes(b"")) == len(ngram_join.word_hashes(b" \n")) == 0
    x = np.array([3, 1, 3, 2], np.uint64)
    assert ngram_join.distinct(x).tolist() == [1, 2, 3]


def test_corner_vectors_bound():
    rng = np.random.default_rng(3)
    for n in (1, 40, 300, 3000):
        both = rng.integers(0, 1 << 62, n).astype(np.uint64)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 1 << 62, n // 9).astype(np.uint64)])) for _ in range(2))
        whole = [ngram_join.as_vector(ngram_join.count_vector(s), ngram_join.groups_of(len(s))) for s in (x, y)]
        folded = [ngram_join.as_vector(ngram_join.corner_vector(ngram_join.count_vector(s), len(s)), ngram_join.corner_groups(len(s))) for s in (x, y)]
        sums = []
        for v, w in (whole, folded):
            g = min(len(v), len(w))
            sums.append(int(np.minimum(ngram_join.fold(v, g), ngram_join.fold(w, g)).sum()))
        assert len(np.intersect1d(x, y)) <= sums[0] <= sums[1]


def test_odd_bitmaps_bound():
    """Bitmaps never differ in more bits than sets in members, and tell sets apart that share half of their members."""
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 1 << 62, n).astype(np.uint64)
    for n in (1, 40, 300, 3000, 40000):
        for own, other in ((n // 9, n // 9), (0, n // 3), (n // 2, n // 2)):
            both = draw(n)
            x, y = np.unique(np.concatenate([both, draw(own)])), np.unique(np.concatenate([both, draw(other)]))
            unshared, total = len(np.setxor1d(x, y)), len(x) + len(y)
            bits = odd_between(odd_bitmap(x), odd_bitmap(y))
            assert bits <= unshared
            table = OddTable([odd_bitmap(s) for s in (x, y)])
            assert table.apart(table, 0, np.array([0, 1])).tolist() == [0, bits]
            linked = ngram_join.DEN * len(np.intersect1d(x, y)) >= ngram_join.NUM * len(np.union1d(x, y))
            assert linked == (unshared <= ngram_join.allowed(total))
            if n >= 300 and own == n // 2:
                assert bits > ngram_join.allowed(total)


def test_ngram_join_pairs_below_threshold(spark):
    """Texts with a long common passage, too short to link them: the tree does not give all their pairs."""
    base = " ".join(f"b{k}" for k in range(150))
    rows = [(i, " ".join([base, *(f"v{i}x{k}" for k in range(50))])) for i in range(200)]
    rows += [(900 + i, f"{rows[i][1]} y") for i in range(3)]
    points = []
    for i, t in rows:
        s = ngram_join.shingles(t)
        points.append((i, len(s), ngram_join.corner_vector(ngram_join.count_vector(s), len(s)), odd_bitmap(s)))
    points = spark.createDataFrame(points, "set long, n long, corner binary, odd binary")
    cells = spark.createDataFrame([(7, i, i) for i, _ in rows], "token long, set long, label long")
    pairs = {tuple(r) for r in ngram_join._tree_pairs(cells, points).collect()}
    assert {(i, 900 + i) for i in range(3)} <= pairs and len(pairs) < len(rows)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 900 for i, _ in rows}


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(50)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == up


def test_fm_index():
    rng = random.Random(1)
    for trial in range(60):
        letters = rng.randint(1, 6)
        pieces = [np.array([rng.randint(1, letters + 1) for _ in range(rng.choice([0, 1, 3, 10, 60]))], np.int32) for _ in range(rng.randint(1, 8))]
        pieces += [pieces[0].copy()] * (3 if trial % 3 == 0 else 0)
        phrases = deco.Phrases([])
        k = rng.randint(1, 20)
        phrases.letters, phrases.lengths, phrases.table = letters + 2, np.array([rng.randint(1, 5) for _ in range(k)]), np.zeros((k, 5), np.int64)
        for i in range(k):
            phrases.table[i, 5 - phrases.lengths[i] :] = [rng.randint(1, letters + 1) for _ in range(phrases.lengths[i])]
        found = sorted(zip(*(x.tolist() for x in deco.search_shard(pieces, phrases)), strict=True))
        want = []
        for a, p in enumerate(pieces):
            for i in range(k):
                n = phrases.lengths[i]
                want += [(a, b, i) for b in range(len(p) - n + 1) if (p[b : b + n] == phrases.table[i, 5 - n :]).all()]
        assert found == sorted(want)


def plain_contamination(text, items):
    words = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    hit, names = set(), set()
    for name, item in items:
        w = [x.decode() for x in deco.item_words(item)]
        for v in [w[i : i + 10] for i in range(max(1, len(w) - 9))] if w else []:
            for p in range(len(words) - len(v) + 1):
                if words[p : p + len(v)] == v:
                    hit.update(range(p, p + len(v)))
                    names.add(str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("options", [{}, {"block_items": 2, "shard_words": 64}])
def test_contamination(spark, odd, odd_rows, none, options):
    base = odd_rows[5][1].split()
    items = [(1, " ".join(base[20:40])), (2, "One, two; three"), (30, "x y"), (4, None), (5, ""), (6, " ".join(base[30:45]).upper()), (6, "no such words in any text at all here now ok"), (7, "same " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in deco.contamination(odd, bench, **options).collect()}
    assert got == {r[0]: plain_contamination(r[1], items) for r in odd_rows}
    assert sum(r[-1] for r in got.values()) > 5
    clean = deco.remove_spans(odd, bench, **options)
    assert clean.schema.names == odd.schema.names
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[0] is None and texts[4] == "four" and texts[26] == odd_rows[26][1]
    left = {r["doc_id"] for r in deco.remove_spans(odd, bench, drop_emptied=True, **options).collect()}
    assert 1 in left and 19 not in left  # the text of one repeated word is all passage
    assert deco.contamination(none, bench).count() == 0
    assert deco.contamination(odd, bench.filter("false")).filter("contaminated").count() == 0


def whole_ids(text):
    return token_output.WordEncoder.at(token_output.default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_give_the_ids_of_whole_texts():
    rng = random.Random(3)
    alphabet = ["a", "B", "1", "9", ",", ".", "'s", "'T", "!", "é", "É", "é", "…", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", " ", "\t", "\n", " ", "\x1c", "\x85", "ß", "İ", "日", "̀", "'", "-", "_", "$", "ﬁ", "Ω", "К", "😀", "‍"]
    encoder = token_output.WordEncoder.at(token_output.default_tokenizer())
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == whole_ids(text)


def test_token_store(spark, odd, odd_rows, none):
    path = new_dir(spark, "store")
    token_output.write_store(odd, path, pack_bytes=2000)
    got = sorted(token_output.read_store(spark, path).collect())
    at = 0
    for (i, text, *_), r in zip(odd_rows, got, strict=True):
        ids = [*whole_ids(text), 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (i, at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_output.fetch(spark, path, 5) == [got[5]["ids"]] and token_output.fetch(spark, path, 999) == []
    assert spark.read.parquet(f"{path}/packs").filter("size(doc_ids) > 1").count() > 0
    assert token_output.token_output(none).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (0, None)], "doc_id long, text string")
    assert sorted((r["start"], r["n_tokens"]) for r in token_output.token_output(twice).collect()) == [(0, 2), (2, 1), (3, 3), (6, 3)]


def test_separator_scan(spark, odd, odd_rows, none):
    path = new_dir(spark, "flat")
    separator_scan.write_flat(odd, path, block_tokens=100)
    stored = spark.read.parquet(path)
    assert stored.count() > 50
    encoder = token_output.WordEncoder.at(token_output.default_tokenizer(), literal=True)
    length = {r[0]: len(encoder.encode([r[1]])[0]) // 4 + 1 for r in odd_rows}
    for chunk in (1, 3, 1024):
        counts = separator_scan.count_tokens(stored, chunk=chunk)
        names = stored.select("file_no", "first", F.posexplode("names").alias("i", "doc_id")).select("file_no", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
        got = counts.join(names, ["file_no", "ordinal"]).collect()
        assert {r["doc_id"]: r["n_tokens"] for r in got} == length and len(got) == len(odd_rows)
        by_file = defaultdict(list)
        for r in got:
            by_file[r["file_no"]].append((r["ordinal"], r["start"], r["n_tokens"]))
        for rows in by_file.values():
            rows.sort()
            assert all(a[1] + a[2] == b[1] for a, b in zip(rows, rows[1:], strict=False)) and rows[0][:2] == (0, 0)
    assert separator_scan.token_counts(none, new_dir(spark, "flat")).count() == 0
    marked = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    assert separator_scan.token_counts(marked, new_dir(spark, "flat")).count() == 1


def test_letters_pass_the_splitting_by():
    encoder = token_output.WordEncoder(token_output.default_tokenizer())
    asked = []
    library = encoder._library
    encoder._library = lambda words: asked.extend(words) or library(words)
    texts = ["Forananatea été,*** zuß. ÀÉÎ-Þÿ, été it's they'll' a'b abc123, naïve×÷x cafe\u0301 İSTANBUL ab<|endoftext|>c d<e f|g &&& ... x.y"]
    texts += [f"{chr(c)}q{chr(c)}, q{chr(c)}'s {chr(c)}.{chr(c)}" for c in range(1, 0x250)]
    got = encoder.encode(texts)
    whole = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == whole
    assert not {b"forananatea", "été".encode(), "zuß".encode(), "été,***".encode()}.intersection(asked)


def test_one_of_each_leaves_little_behind(odd, tmp_path, monkeypatch):
    monkeypatch.setattr("avsync.session.shared_dir", lambda spark: f"file://{tmp_path}")
    stay = ngram_join.one_of_each(odd)
    assert {p.name.split("-")[0] for p in (tmp_path / "avsync").iterdir()} == {"rows", "named", "stay"}
    assert stay.count() == len({r["doc_id"] for r in stay.collect()}) > 0


def test_only_in_with_a_full_filter(spark):
    rows = spark.range(4000).withColumn("text", F.lit("x"))
    ids = rows.select(F.col("id").alias("k")).filter("k % 3 = 0")
    for bits in (32_768, 1 << 26):  # in the small one many keys share a bit
        got = only_in(rows, "id", ids, rows.select("id").filter("id % 3 > 0"), bits)
        assert got.columns == ["id", "text"] and sorted(r["id"] for r in got.collect()) == list(range(0, 4000, 3))
    assert only_in(rows, "id", ids.limit(0), rows.select("id")).count() == 0
    assert only_in(rows, "id", rows.select("id"), ids.limit(0)).count() == 4000
