"""The operators in Spark: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import arc_warc, bag_minhash, bloom_lookup, licenses, mixing, packing, quality, reply_trees, token_files, units, vp_tree
from corpusloom.llm import common
from corpusloom.llm.common import shared_path

DOCS = "doc_id long, text string, _part int, score double, label string"
ODD = [(3, "Released under the MIT License.", 9, 1.0, "x"), (1, None, 9, None, None), (2, "", 9, None, "y"), (None, "nobody's text", 1, 2.0, "z"), (5, "long " * 30_000, 9, 1.0, "x"), (7, "same text here for all", 1, 1.0, "x"), (7, "same text here for all", 1, 1.0, "x"), (8, "same text here for all", 1, 1.0, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    return units.UnitEncoder(units.default_tokenizer()).tokenizer


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_licenses(spark, odd, none):
    rows = {r.doc_id: r for r in licenses.license_report(licenses.scan_licenses(odd)).collect()}
    assert (rows[3].n_base, rows[3].first_word, rows[3].base_labels, rows[3].labels) == (1, 3, "mit", "mit,mit-notice")
    assert rows[1].n_words == rows[2].n_words == 0 and rows[1].first_word is None and rows[1].labels == "" and rows[1].score == 0.0
    assert rows[5].n_words == 30_000 and None in rows
    assert licenses.license_report(licenses.scan_licenses(none)).count() == 0


def test_packing(spark, odd, none, tokenizer):
    rows = packing.pack_documents(odd).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    wanted = [(key, [*ids_of(tokenizer, text), 1]) for key, text, *_ in ODD]
    assert sum(r.length for r in rows) == sum(len(x) for _, x in wanted)
    for key, ids in wanted:
        own = {(r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == key}
        assert {(s, n, crc(ids[s : s + n])) for s, n, _ in own} == own
        assert {r.doc_tokens for r in rows if r.doc_id == key} == {len(ids)}
    assert packing.pack_documents(none).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(none, capacity=0)


def test_packing_of_all_documents(spark, tokenizer):
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    rows = packing.pack_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d in docs:
        ids, at = [*ids_of(tokenizer, d["text"]), 1], 0
        for r in sorted(by.pop(d["doc_id"]), key=lambda r: r.start):
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, crc(ids[at : at + r.length]), len(ids))
            at += r.length
        assert at == len(ids)
    assert not by and sum(r.length for r in rows) / (2048 * len({r.sequence_id for r in rows})) > 0.9


def test_token_files(spark, odd, none, tokenizer):
    back = token_files.corpus_to_token_files(odd, shared_path(spark, "ids"), partition_bytes=50_000, segment_ids=50).orderBy("start").collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (key, text, *_) in zip(back, order, strict=True):
        ids = [*ids_of(tokenizer, text), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, at, len(ids), crc(ids))
        at += len(ids)
    assert token_files.corpus_to_token_files(none, shared_path(spark, "ids")).count() == 0


def test_fingerprints(spark, odd, none):
    rows = bloom_lookup.fingerprint_versions(odd).collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in order]
    wanted = sorted((str(r[0]), hashlib.sha256(bloom_lookup.edit(t, n).encode()).hexdigest(), len(t)) for r, t, n in zip(order, texts, [*texts[1:], texts[0]]))
    assert sorted((str(r.doc_id), r.edited_sha256, r.n_chars) for r in rows) == wanted
    assert len({r.fingerprint for r in rows if r.doc_id in (7, 8)}) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert bloom_lookup.fingerprint_versions(none).count() == 0


def test_fingerprints_over_parts(spark, monkeypatch):
    monkeypatch.setattr(bloom_lookup, "ordered_parts", lambda df, key, text: common.ordered_parts(df, key, text, 2000))
    rows = [(i * 3 % 101, f"text number {i} " * (i % 9 + 1)) for i in range(101)]
    texts = [t for _, t in sorted(rows)]
    wanted = {i: hashlib.sha256(bloom_lookup.edit(t, n).encode()).hexdigest() for i, (t, n) in enumerate(zip(texts, [*texts[1:], texts[0]]))}
    found = bloom_lookup.fingerprint_versions(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.edited_sha256 for r in found} == wanted and len(found) == 101


def test_parts_ascend_and_split_a_repeated_key(spark):
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text {i} " * 20) for i in range(900)]
    parted, order = common.ordered_parts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 4000)
    found = sorted((r._key, r._tie, r._part) for r in parted.collect())
    assert [p for *_, p in found] == sorted(p for *_, p in found) and order.parts > 20
    counts = Counter(p for *_, p in found)
    assert max(counts.values()) < 120 and len({p for k, _, p in found if k == 5}) > 4


def families():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for size in (2, 3, 40, 1):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(size):
            own = list(base)
            for i in rng.sample(range(120), rng.randint(0, 3)):
                own[i] = f"x{rng.randint(0, 99)}"
            rows.append((n, " ".join(own)))
            n += 1
    shared = [rng.choice(words) for _ in range(60)]
    rows += [(n + k, " ".join(shared + [f"k{k}v{j}" for j in range(40)])) for k in range(20)]
    n += 20
    rows += [(n + k, "three words only") for k in range(30)] + [(n + 30, "..."), (n + 31, "..."), (n + 32, "Three, WORDS only!")]
    return rows


def brute_classes(rows, least=0.8):
    """Classes by plain multisets of word tuples, all pairs; texts without words by their bytes."""

    def shingles(text):
        words = re.findall("[0-9a-z\u0080-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter({(text,): 1} if text else {})

    sets = [shingles(t) for _, t in rows]
    weight = [x.total() for x in sets]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if min(weight[i], weight[j]) >= least * max(weight[i], weight[j]) > 0:
                both = (sets[i] & sets[j]).total()
                if both >= least * (weight[i] + weight[j] - both):
                    x, y = sorted((root(i), root(j)), key=lambda k: rows[k][0])
                    label[y] = x
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


@pytest.mark.parametrize("block", [4096, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(bag_minhash, "BLOCK", block)
    rows = families() + [(900, "--- ***"), (901, "--- ***"), (902, "--- **")]
    found = bag_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.class_id for r in found} == brute_classes(rows)
    for r in found:
        assert r.is_first == (r.doc_id == r.class_id) and (r.similarity is None) == (r.link_id is None) and (r.similarity is None or 0.8 <= r.similarity <= 1)
        assert r.class_id == r.doc_id or r.copy_of != r.doc_id or r.link_id is not None


def test_near_duplicates_of_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: r.class_id for r in bag_minhash.near_duplicates(docs).collect()} == brute_classes(rows)


@pytest.mark.parametrize("least, block", [(0.8, 4096), (0.6, 4096), (0.6, 5)])
def test_prefixes_lose_no_pair(spark, monkeypatch, least, block):
    monkeypatch.setattr(bag_minhash, "BLOCK", block)
    rng = random.Random(6)
    sets = {}
    for i in range(90):
        base = list(sets[rng.randrange(i)].elements()) if i and rng.random() < 0.7 else [rng.randrange(200) for _ in range(rng.randint(1, 40))]
        sets[i] = Counter(x if rng.random() < 0.9 else rng.randrange(200) for x in base)
    node = lambda i: (i, i * 7)
    rows = spark.createDataFrame([(node(i), k, c) for i, s in sets.items() for k, c in s.items()], "node struct<doc_id:long,text_hash:long>, key long, count long")
    labels = spark.createDataFrame([(node(i), i // 2, i % 3, s.total()) for i, s in sets.items()], "node struct<doc_id:long,text_hash:long>, own long, block long, n long")
    found = {tuple(sorted((r.node.doc_id, r.centre.doc_id))) for r in bag_minhash.prefix_pairs(rows, labels, least).collect()}
    wanted = {(j, i) for i in sets for j in range(i) if i // 2 != j // 2 and (sets[i] & sets[j]).total() >= least * (sets[i] | sets[j]).total()}
    assert wanted and wanted <= found


def test_near_duplicates_of_odd_rows(spark, odd, none):
    found = bag_minhash.near_duplicates(odd)
    got = sorted((r.doc_id, r.class_id) for r in found.where("doc_id IS NOT NULL").collect())
    assert got == [(1, 1), (2, 2), (3, 3), (5, 5), (7, 7), (7, 7), (8, 7)]
    kept = bag_minhash.keep_first(odd, found)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "7", "None"]
    assert bag_minhash.near_duplicates(none).count() == 0 and bag_minhash.keep_first(none, bag_minhash.near_duplicates(none)).count() == 0


def test_one_id_with_several_texts(spark):
    rows = [(1, "a first text of some words", "x", 2), (1, "another text that isn't like it", "y", 1), (2, "a first text of some words", "z", 1), (3, "another text that isn't like it", "y", 5), (1, "a first text of some words", "w", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _nth string, _nd_id int")
    found = bag_minhash.near_duplicates(df)
    assert sorted((r.doc_id, r.class_id, r.is_first) for r in found.collect()) == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False)]
    assert sorted(map(tuple, bag_minhash.keep_first(df, found).collect())) == [(1, "a first text of some words", "w", 9), (1, "another text that isn't like it", "y", 1)]


def test_classifier(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, ("good fine words go here " if i % 2 else "JUNK!! SPAM!! ") * 5) for i in range(400)], "doc_id long, text string")
    model = quality.fit(docs, labels)
    rows = quality.score_documents(docs, model).join(labels, "doc_id").withColumn("out", quality.held_out()).collect()
    assert all((r.score >= 0.5) == (r.quality == 1) for r in rows) and {r.out for r in rows} == {True, False}
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    scores = quality.score_documents(odd, model).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    assert quality.score_documents(none, model).count() == 0
    assert {r.score for r in quality.score_documents(docs.limit(3), quality.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_training_rows(spark):
    a, b = [i for i in range(0, 60, 2) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, 0), (a, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)] + [(a, "a smaller text"), (b, None), (None, "x"), (59, "long " * 1000)], "doc_id long, text string")
    rows = quality.training_rows(docs, labels)
    assert {i for i, *_ in rows} == {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert [r for r in rows if r[0] in (a, b)] == [(a, "a smaller text", 0), (a, "a smaller text", 1), (b, "", 0)]
    few = quality.training_rows(docs, labels, max_rows=20, max_bytes=60)
    assert 0 < len(few) < 20 and sum(len(t.encode()) for _, t in {(i, t) for i, t, _ in few}) <= 60
    assert quality.training_rows(docs, labels.limit(0)) == [] == quality.training_rows(docs.limit(0), labels)


def ranked(scores, truth):
    """Chance that a good document gets a higher score than a bad one, by counting."""
    good, bad = ([s for s, y in zip(scores, truth) if y == k] for k in (1, 0))
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = quality.score_documents(docs, model).join(labels, "doc_id").where(quality.held_out()).join(docs.select("doc_id", "text"), "doc_id").collect()
    scores, truth = [r.score for r in rows], [r.quality for r in rows]
    assert len(rows) > 100 and ranked(scores, truth) > 0.95 and sum((s >= 0.5) == (y == 1) for s, y in zip(scores, truth)) / len(rows) > 0.95
    # each score is the softmax of the mean over the plain list of the document's features
    for r in rows[:20]:
        data = r.text.encode()
        _, bucket = quality.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        z = model.weights[bucket].astype(float).mean(axis=0) + model.bias
        assert r.score == pytest.approx(1 / (1 + math.exp(z[0] - z[1])), abs=1e-6)


def test_classifier_names(spark, odd):
    model = quality.train([], [])
    with pytest.raises(ValueError):
        quality.score_documents(odd.withColumnRenamed("score", "Score"), model, keep=True)
    assert quality.score_documents(odd, model, keep=True, score_col="p").columns == [*odd.columns, "p"]


def test_archives(spark):
    big, other = "x" * 200, "y" * 150
    pages = [(5, "http://a", big), (2, "http://b c", big), (2, "http://b c", big), (9, None, "small"), (10, "u", "small"), (11, "u", None), (None, "n", big), (12, "é", other)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int").repartition(3)
    rows = arc_warc.archive_pages(df, shared_path(spark, "w")).collect()
    assert len(rows) == len(pages)
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in rows if r.payload_bytes == 200)
    assert kinds == [("2", "response", None), ("2", "revisit", 2), ("5", "revisit", 2), ("None", "revisit", 2)]
    assert all(r.record_type == "response" for r in rows if r.payload_bytes != 200)
    assert {r.payload_digest for r in rows if r.page_id == 11} == {hashlib.sha256(b"").hexdigest()}
    again = arc_warc.archive_pages(df, shared_path(spark, "w")).collect()
    assert len({r.record_id for r in rows + again}) == 2 * len(pages)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert arc_warc.archive_pages(empty, shared_path(spark, "w")).count() == 0


def test_reply_trees(spark):
    nodes = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "</s>\\[INST] a", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 3, "odd ] role", None, 2.0), (2, 7, 99, None, "<s>", None), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    paths = reply_trees.reply_paths(df, top_k=2)
    made = reply_trees.format_paths(df, paths)
    got = {(r.tree, r.leaf): ([(t.role, t.text) for t in r.turns], r.learned, r["rank"]) for r in made.select("tree", "leaf", "rank", reply_trees.read_turns(F.col("formatted")).alias("turns"), reply_trees.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()}
    assert got == {
        (1, 4): ([("user", "q"), ("assistant", "b"), ("odd ] role", "")], "b", 1),
        (1, 2): ([("user", "q"), ("assistant", "</s>\\[INST] a")], "</s>\\[INST] a", 2),
        (2, 7): ([("", "<s>")], "", 1),
    }


def test_reply_trees_long_chain_and_escapes(spark):
    rng = random.Random(5)
    signs = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE:", "\\", "<", "[", "/s>", " ", "é", "\n"]
    rows = [(4, i, rng.choice(["user", "assistant", "system", "tool"]), "".join(rng.choice(signs) for _ in range(rng.randint(0, 6)))) for i in range(70)]
    df = reply_trees.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id", "turn", "role", "text")
    made = reply_trees.format_paths(df, reply_trees.reply_paths(df))
    row = reply_trees.conversation_report(made).first()
    said = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
    learned = "".join(t for _, _, r, t in rows if r == "assistant")
    assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == (70, hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert reply_trees.conversation_report(reply_trees.format_paths(df.limit(0), reply_trees.reply_paths(df.limit(0)))).count() == 0


def test_reply_trees_equal_brute_force(spark):
    rng = random.Random(9)
    nodes = []
    for tree in (None, 0, -(1 << 63), 7):
        for i in range(60):
            nodes.append((tree, i, rng.choice([None, rng.randrange(i)]) if i > 50 else rng.randrange(i) if i else None, rng.choice(["user", "assistant"]), f"t{tree} {i}", rng.choice([None, 0.0, 1.0, 2.0]), "x"))
        nodes.append((tree, 100, 999, "user", "parent isn't there", 1.0, "x"))
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double, leaf string")
    wanted = {}
    for tree in {n[0] for n in nodes}:
        own = {n[1]: n for n in nodes if n[0] == tree}
        paths = []
        for leaf in set(own) - {n[2] for n in own.values()}:
            path = [leaf]
            while own[path[0]][2] in own:
                path.insert(0, own[path[0]][2])
            paths.append((-sum(own[i][5] or 0.0 for i in path) / len(path), leaf, path))
        for k, (_, leaf, path) in enumerate(sorted(paths)[:3]):
            wanted[tree, leaf] = (k + 1, [(own[i][3], own[i][4]) for i in path])
    made = reply_trees.format_paths(df, reply_trees.reply_paths(df, top_k=3))
    assert {(r.tree, r.leaf): (r["rank"], [(t.role, t.text) for t in r.turns]) for r in made.select("tree", "leaf", "rank", reply_trees.read_turns(F.col("formatted")).alias("turns")).collect()} == wanted


def test_chains_keep_a_null_id(spark):
    rows = [(None, 0, "user", "hi", 1), (None, 1, "assistant", None, 1), (-(1 << 63), 0, None, "x", 1), (5, None, "user", "a", 1), (5, 1, "assistant", "b" * 50_000, 1)]
    df = reply_trees.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int"), "conv_id", "turn", "role", "text")
    report = {r.conv_id: (r.n_turns, r.loss_chars) for r in reply_trees.conversation_report(reply_trees.format_paths(df, reply_trees.reply_paths(df))).collect()}
    assert report == {None: (2, 0), -(1 << 63): (1, 0), 5: (2, 50_000)}


def brute_mix(rows, weights, fraction, epochs):
    """Level by level, giving out the budget until nothing moves; then prefixes by plain sorting."""
    tokens = {}
    for key, a, b, n in rows:
        tokens[a, b] = tokens.get((a, b), 0) + n

    def fill(budget, caps, w):
        out, open_ = dict.fromkeys(caps, 0.0), {k for k in caps if w[k] > 0}
        while open_ and budget > 1e-9:
            total = sum(w[k] for k in open_)
            full = {k for k in open_ if out[k] + budget * w[k] / total >= caps[k]}
            if not full:
                for k in open_:
                    out[k] += budget * w[k] / total
                break
            for k in full:
                budget -= caps[k] - out[k]
                out[k] = caps[k]
            open_ -= full
            if open_:
                for k in open_:
                    out[k], budget = 0.0, budget + out[k]
        return out

    top = {}
    for (a, _), n in tokens.items():
        top[a] = top.get(a, 0) + n * epochs
    first = fill(math.floor(sum(tokens.values()) * fraction), top, {a: weights[0].get(a, 1.0) for a in top})
    times, crossing, given_out = {}, [], 0
    for a in top:
        leaves = {b: tokens[a, b] * epochs for x, b in tokens if x == a}
        for b, given in fill(first[a], leaves, {b: weights[1].get(b, 1.0) for b in leaves}).items():
            given_out += math.floor(given + 1e-6)
            full, rest = divmod(math.floor(given + 1e-6), tokens[a, b])
            own = sorted((int(hashlib.md5(f"7|{full}|{k}".encode()).hexdigest()[:15], 16), k, n) for k, x, y, n in rows if (x, y) == (a, b))
            run, over = 0, False
            for _, k, n in own:
                if not over and run + n > rest and full < epochs and weights[0].get(a, 1.0) > 0 and weights[1].get(b, 1.0) > 0:
                    crossing.append([n, a, b, k, rest - run, False])
                over = over or run + n > rest
                run += n
                times[k] = full + (0 if over else 1)

    def redistribute(own, pool):
        for c in sorted((c for c in own if not c[5]), key=lambda c: c[:3]):
            if pool < c[0]:
                break
            pool, c[5] = pool - c[0], True

    def left(own):
        return sum(c[4] - c[0] * c[5] for c in own)

    for a in top:
        own = [c for c in crossing if c[1] == a]
        redistribute(own, left(own))
    redistribute(crossing, left(crossing) + math.floor(sum(tokens.values()) * fraction) - given_out)
    for c in crossing:
        times[c[3]] += c[5]
    return sorted((k, e) for k, t in times.items() for e in range(t))


@pytest.mark.parametrize("fraction, epochs", [(0.3, 1), (0.9, 1), (1.4, 3)])
def test_mixing_equals_brute_force(spark, fraction, epochs):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice("xyz"), rng.randint(1, 60)) for i in range(400)] + [(1000, "c", "x", 50)]
    weights = ({"a": 3.0, "c": 5.0}, {"x": 2.0})
    df = spark.createDataFrame(rows, "doc_id long, one string, two string, n long")
    found = mixing.mix_sources(df, {"one": F.col("one"), "two": F.col("two")}, weights, fraction, epochs, 7, tokens=F.col("n"))
    assert sorted((r.doc_id, r.epoch) for r in found.collect()) == brute_mix(rows, weights, fraction, epochs)


def test_mixing_odd_rows(spark, odd, none):
    levels = {"label": F.col("label"), "more": F.lit("m")}
    found = mixing.mix_sources(odd, levels, ({}, {}), 1.0, 1)
    assert found.columns == [*odd.columns, "epoch"] and found.where("doc_id = 2").count() == 1
    assert mixing.mix_sources(none, levels, ({}, {}), 1.0, 1).count() == 0
    named = odd.withColumnRenamed("score", "Epoch")
    with pytest.raises(ValueError):
        mixing.mix_sources(named, levels, ({}, {}))
    assert mixing.mix_sources(named, levels, ({}, {}), 1.0, 1, epoch_col="e").columns == [*named.columns, "e"]


@pytest.mark.parametrize("leaves", [10_000, 2])
def test_mixing_with_zero_weights(spark, monkeypatch, leaves):
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", leaves)
    rows = [(i, "abc"[i % 3], "xy"[i % 2], 10) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, one string, two string, n long")
    levels = {"one": F.col("one"), "two": F.col("two")}
    found = mixing.mix_sources(df, levels, ({"a": 0.0}, {"x": 0.0}), 0.3, 1, tokens=F.col("n")).collect()
    assert len(found) == 180 and {r.one for r in found} == {"b", "c"} and {r.two for r in found} == {"y"}
    assert mixing.mix_sources(df, levels, ({None: 0.0}, {}), 0.3, 1, tokens=F.col("n")).count() == 0
    all_ = mixing.mix_sources(df, levels, ({"a": 0.0}, {}), 1.0, 1, tokens=F.col("n")).collect()
    assert len(all_) == 400 and "a" not in {r.one for r in all_}


@pytest.mark.parametrize("fraction, epochs", [(0.5, 3), (0.6, 1)])
def test_mixture_of_documents_meets_its_target(spark, fraction, epochs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("n", mixing.word_tokens(F.col("text")))
    found = mixing.mix_sources(docs, mixing.production_levels(), mixing.WEIGHTS, fraction, epochs, tokens=F.col("n")).collect()
    sizes = [r.n for r in docs.collect()]
    assert 0 <= sum(sizes) * fraction - sum(r.n for r in found) < max(sizes)


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5)).astype(np.float32).astype(float)
    x[10] = x[11]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (600, [0.0] * 5), (700, [1.0, None, 0.0, 0.0, 0.0]), (800, [float("nan")] * 5), (900, [1.0, 2.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = vp_tree.nearest(df, df.where("vec_id % 100 = 0"), k=3, leaf_rows=90, block_rows=2).collect()
    wanted = []
    for i in range(0, 400, 100):
        d = vp_tree.distances(x[[i]], x)[0]
        d[i] = np.inf
        wanted += [(i, k + 1, int(j), d[j]) for k, j in enumerate(np.lexsort((np.arange(400), d))[:3])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == wanted
    assert vp_tree.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_over_many_shards(spark):
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(1200, 6)) + 8 * rng.integers(0, 4, (1200, 1))).astype(np.float32).astype(float)
    x[300:600] = x[299]  # a leaf of copies, larger than a shard
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, leaf string")
    options = {"leaf_rows": 60, "shard_bytes": 50 * 48}
    index = vp_tree.build_index(df, **options)
    assert len(index.shards) > 8 and max(index.shards.values()) > 3
    found = {}
    for r in vp_tree.nearest(df, df.where("vec_id % 50 = 0"), k=7, **options).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for i in range(0, 1200, 50):
        d = vp_tree.distances(x[[i]], x)[0]
        d[i] = np.inf
        assert [found[i][k] for k in range(1, 8)] == [(int(j), d[j]) for j in np.lexsort((np.arange(1200), d))[:7]]
    approximate = vp_tree.nearest(df, df.where("vec_id % 50 = 0"), k=7, factor=0.8, **options).collect()
    assert np.mean([(r.vec_id, r.score) in found[r.query_id].values() for r in approximate]) > 0.9


# -- the pipeline, stage by stage -------------------------------------------------


FOLDER = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, Score double, epoch int, _nth string, class_id long, SCORE_ string"


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"some words of text number {i} in a row " * (i % 4 + 1), "en", f"src{i % 3}", None, 0.5, i, None, i, "s") for i in range(30)]
    rows += [(None, None, None, None, None, None, None, None, None, None), (7, "", None, "src1", 0, None, None, None, None, None), rows[3], (40, "long " * 50_000, "de", None, None, 1.0, 1, "x", 1, "s")]
    return spark.createDataFrame(rows, CLASHING)


@pytest.mark.parametrize("stage", range(3))
def test_stages_keep_columns_and_stand_odd_rows(spark, pipeline, clashing, stage):
    _, f = pipeline.STAGES[stage]
    found = f(spark, clashing, FOLDER)
    assert found.columns == clashing.columns
    rows = {str(tuple(r)[:4]) for r in clashing.collect()}
    kept = [str(tuple(r)[:4]) for r in found.collect()]
    assert kept and set(kept) <= rows
    if stage == 1:
        assert len(kept) == len(set(kept)) and str((None,) * 4) in kept
    assert f(spark, clashing.limit(0), FOLDER).count() == 0


def test_last_stage_stands_odd_rows(spark, pipeline, clashing):
    rows = pipeline.pack(spark, clashing, FOLDER).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in clashing.collect()} and pipeline.pack(spark, clashing.limit(0), FOLDER).count() == 0


def test_stages_have_docstrings(pipeline):
    assert all(f.__doc__ for _, f in pipeline.STAGES)


def test_pipeline_equals_brute_force(spark, pipeline):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = "/root/testdata/sf0.001"
    good = pipeline.keep_quality(spark, docs, folder)
    assert good.columns == docs.columns and good.count() < docs.count()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    classes = brute_classes(rows)
    unique = sorted(i for i, c in classes.items() if i == c)
    kept = pipeline.drop_near_duplicates(spark, good, folder)
    assert sorted(r.doc_id for r in kept.collect()) == unique
    mixed = pipeline.mix_to_weights(spark, kept, folder)
    tokens = {r.doc_id: r.n for r in kept.select("doc_id", mixing.word_tokens(F.col("text")).alias("n")).collect()}
    chosen = [r.doc_id for r in mixed.collect()]
    assert len(set(chosen)) == len(chosen) and set(chosen) <= set(unique)
    assert 0.4 < sum(tokens[i] for i in chosen) / sum(tokens.values()) <= 0.6
    whole = pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in whole} == set(chosen)
