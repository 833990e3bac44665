"""Units, range coder, packing, licenses, sketches, archives, trees: without Spark, against plain versions."""

import io
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import arc_warc, bag_minhash, bloom_lookup, licenses, packing, quality, range_coder, units, vp_tree
from corpusloom.llm.common import string_buffers


@pytest.fixture(scope="module")
def encoder():
    return units.UnitEncoder(units.default_tokenizer())


def plain_ids(encoder, texts):
    return [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_units_equal_the_tokenizer(encoder):
    rng = random.Random(1)
    parts = list("ab'st \n\t.,!12éß ") + [" ", "€", "日", "'s", "\r", "\x1c", "́", " ", " ", "　", "<|endoftext|>"]
    texts = ["", " ", "\n", "\nfoo", "a \n b", "don't we'll", "x" * 5000] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(5000)]
    ids, sizes = encoder.encode(*string_buffers(pa.array(texts)))
    wanted = plain_ids(encoder, texts)
    assert sizes.tolist() == [len(x) for x in wanted]
    assert ids.tolist() == [i for x in wanted for i in x]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=8))
def test_units_on_any_text(encoder, texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    ids, sizes = encoder.encode(*string_buffers(pa.array(texts, pa.string())))
    assert [ids[e - n : e].tolist() for e, n in zip(np.cumsum(sizes), sizes)] == plain_ids(encoder, texts)


def test_units_store_is_bounded():
    small = units.UnitEncoder(units.default_tokenizer(), max_units=50)
    texts = [f"word{i} other{i}" for i in range(400)]
    for t in texts:
        ids, _ = small.encode(*string_buffers(pa.array([t])))
        assert ids.tolist() == plain_ids(small, [t])[0]
    assert small.count < 100


def test_units_of_equal_hash_are_told_apart(encoder, monkeypatch):
    x, y = "a", "b"
    for _ in range(10):  # words that sums of powers modulo 2 ** 64 can't tell apart
        x, y = x + y, y + x
    texts = [x, y, f"{x} {y}"]
    ids, sizes = encoder.encode(*string_buffers(pa.array(texts)))
    assert [ids[e - n : e].tolist() for e, n in zip(np.cumsum(sizes), sizes)] == plain_ids(encoder, texts)
    starts = np.array([0, len(x)])
    assert len(set(units.hash_spans(np.frombuffer((x + y).encode(), np.uint8), starts, starts + len(x)).tolist())) == 2
    # even if every hash is the same, bytes decide
    monkeypatch.setattr(units, "hash_spans", lambda raw, starts, ends: np.full(len(starts), 7, np.uint64))
    small = units.UnitEncoder(units.default_tokenizer())
    for texts in (["one two three one", "two, 2 one"], ["four one", ""]):
        ids, sizes = small.encode(*string_buffers(pa.array(texts)))
        assert [ids[e - n : e].tolist() for e, n in zip(np.cumsum(sizes), sizes)] == plain_ids(small, texts)


def test_added_tokens_are_the_tokenizers(encoder):
    texts = ["x <|endoftext|> y", "plain", "<|endoftext|><|endoftext|>", "<|endoftext", "|>", "a<|endoftext|<|endoftext|>b"]
    ids, sizes = encoder.encode(*string_buffers(pa.array(texts)))
    found = [ids[e - n : e].tolist() for e, n in zip(np.cumsum(sizes), sizes)]
    assert found == plain_ids(encoder, texts) and found[0] == [87, 220, 50256, 331]


class Counting:
    """A tokenizer that counts the texts it gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


@pytest.mark.parametrize("form", ["w{}\n", "Wé{}.\n", " wé{}$$$", "{},", " {}"])
def test_new_units_share_a_text(form):
    own = units.UnitEncoder(units.default_tokenizer())
    own.tokenizer = Counting(own.tokenizer)
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = ["".join(form.format(str(i).translate(letters) if "w" in form.lower() else i) for i in range(3000))]
    ids, _ = own.encode(*string_buffers(pa.array(texts)))
    assert [ids.tolist()] == plain_ids(units.UnitEncoder(units.default_tokenizer()), texts)
    assert own.count >= 3000 and own.tokenizer.texts <= own.count // 50


def test_added_tokens_may_not_arise_from_joining(tmp_path):
    tokenizer = units.Tokenizer.from_file(units.default_tokenizer())
    tokenizer.add_tokens(["b\nc", "d e", "$ f"])
    tokenizer.save(str(tmp_path / "more.json"))
    for texts in (["b", "c"], ["d e", "x d", " e"], ["é$", "g f", " f"], ["b\nc", "b", "c"]):
        own = units.UnitEncoder(str(tmp_path / "more.json"))
        ids, sizes = own.encode(*string_buffers(pa.array(texts)))
        assert [ids[e - n : e].tolist() for e, n in zip(np.cumsum(sizes), sizes)] == plain_ids(own, texts)


def test_units_of_one_hash_and_eight_bytes_are_told_apart(monkeypatch):
    monkeypatch.setattr(units, "hash_spans", lambda raw, starts, ends: np.full(len(starts), 7, np.uint64))
    own = units.UnitEncoder(units.default_tokenizer())
    texts = ["abcdefghijklmnopqrs", "abcdefghijklmnopqrt", "abcdefghXjklmnopqrs", "abcdefgh", "abcdefghijklmnopqrs"]
    texts += ["b" * 300 + "c" * 300, "b" * 301 + "c" * 299, "b" * 300 + "c" * 300]
    ids, sizes = own.encode(*string_buffers(pa.array(texts)))
    assert [ids[e - n : e].tolist() for e, n in zip(np.cumsum(sizes), sizes)] == plain_ids(own, texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=600), min_size=1, max_size=12))
def test_span_hashes_depend_on_content_alone(spans):
    edges = np.cumsum([0, *map(len, spans)])
    hashes = units.hash_spans(np.frombuffer(b"".join(spans), np.uint8), edges[:-1], edges[1:])
    alone = [units.hash_spans(np.frombuffer(s, np.uint8), np.array([0]), np.array([len(s)]))[0] for s in spans]
    assert hashes.tolist() == alone and len(set(alone)) == len(set(spans))


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 1000, 70_000])
@pytest.mark.parametrize("most", [1, 3, 50_000])
def test_range_coder_round_trip(n, most):
    ids = np.random.default_rng(n).integers(0, most, n)
    data = range_coder.MAGIC + range_coder.encode_segment(np.array([7]), np.array([n]), ids)
    ((keys, sizes, back),) = range_coder.decode_segments(io.BytesIO(data))
    assert keys.tolist() == [7] and sizes.tolist() == [n] and np.array_equal(back, ids)


def test_range_coder_learns_and_tells_damage():
    ids = np.tile(np.arange(100), 4000)  # blocks of 512, each of which learns anew
    data = range_coder.encode_segment(np.array([1]), np.array([len(ids)]), ids)
    assert len(data) * 8 / len(ids) < 2  # order 0 alone needs log2(100) bits
    broken = bytearray(range_coder.MAGIC + data)
    broken[-200] ^= 1
    with pytest.raises(ValueError):
        list(range_coder.decode_segments(io.BytesIO(bytes(broken))))
    with pytest.raises(ValueError):
        list(range_coder.decode_segments(io.BytesIO(b"nonsense" + data)))


@pytest.mark.parametrize(("n", "most", "crc"), [(3000, 50, 1131047759), (70000, 40000, 184142642), (9000, 3, 1621556488)])
def test_range_coder_bytes_stay(n, most, crc):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(min(1, 8 / most), n), rng.integers(0, most, n))
    ids[n // 2 :: 3] = ids[: len(ids[n // 2 :: 3])]
    data = range_coder.encode_segment(np.array([7]), np.array([n]), ids)
    assert zlib.crc32(data[-range_coder._HEAD.unpack_from(data)[-1] :]) == crc  # the coded words, the last part


def test_empty_segment():
    data = range_coder.MAGIC + range_coder.encode_segment(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    ((keys, sizes, back),) = range_coder.decode_segments(io.BytesIO(data))
    assert len(keys) == len(sizes) == len(back) == 0


def test_stored_blocks_where_ids_are_too_many(monkeypatch):
    monkeypatch.setattr(range_coder, "_MOST_FLOOR_BITS", 17)
    monkeypatch.setattr(range_coder, "_FLOOR_BITS", 4)
    ids = np.random.default_rng(3).permutation(70_000)
    data = range_coder.MAGIC + range_coder.encode_segment(np.array([7, 8]), np.array([1, 69_999]), ids)
    ((keys, sizes, back),) = range_coder.decode_segments(io.BytesIO(data))
    assert keys.tolist() == [7, 8] and np.array_equal(back, ids)
    broken = bytearray(data)
    broken[-200] ^= 1
    with pytest.raises(ValueError):
        list(range_coder.decode_segments(io.BytesIO(bytes(broken))))


def test_range_coder_blocks_adapt_alone():
    rng = np.random.default_rng(5)
    ids = np.concatenate([rng.choice(rng.integers(0, 40_000, 20), range_coder.BLOCK) for _ in range(200)])  # each block has ids of its own
    data = range_coder.encode_segment(np.array([1]), np.array([len(ids)]), ids)
    assert len(data) * 8 / len(ids) < 0.9 * np.log2(len(np.unique(ids)))  # what the floor alone needs


def placed_rows(bins, sizes):
    rows = [x for i, n in enumerate(sizes) for x in bins.add(i, n)] + bins.finish()
    for i, n in enumerate(sizes):
        at = 0
        for _, start, length, _, _ in sorted(r for r in rows if r[0] == i):
            assert start == at and 0 < length <= bins.capacity
            at += length
        assert at == n
    filled = {}
    for _, _, length, sequence, offset in rows:
        filled.setdefault(sequence, []).append((offset, length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= bins.capacity
    return rows, filled


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=60), st.integers(1, 3))
def test_bins_cover_each_id_once(sizes, most):
    placed_rows(packing.Bins(64, 2, least_gap=1, open_gaps=most), sizes)


def test_bins_hold_a_fixed_count_and_little_padding():
    sizes = np.random.default_rng(0).geometric(1 / 700, 4000).tolist()
    rows, filled = placed_rows(packing.Bins(2048, 3), sizes)
    assert 1 - sum(sizes) / (2048 * len(filled)) < 0.005 and len(rows) < 1.6 * len(sizes)
    rows, filled = placed_rows(packing.Bins(2048, 3, open_gaps=10**9), [600] * 30)  # class 3
    assert sorted(map(len, filled.values())) == [3] * 10
    assert placed_rows(packing.Bins(1), [3, 1])[1].keys() == {0, 1, 2, 3}


def test_license_templates():
    automaton = licenses.Automaton([
        licenses.Template("x", 'use <<beginOptional>>this <<beginOptional>>fine<<endOptional>><<endOptional>> tool by <<var;name="who";max=2>> freely'),
        licenses.Template("n", 'version <<var;name="v";match="[0-9]+";max=2>> only'),
    ])
    for text in ("Use this fine tool by John Doe freely", "use tool by freely!", "USE this tool, by X: freely"):
        assert automaton.accepts_whole(text) == ["x"], text
    for text in ("use fine tool by freely", "use tool by a b c freely", "use tool by", "use tool by freely now", ""):
        assert automaton.accepts_whole(text) == [], text
    words = licenses.words_of(b"a version 2 0 only version x only use tool by freely")
    assert [(k, i, j) for k, i, j in automaton.find(words)] == [(1, 1, 5), (0, 8, 12)]
    for bad in ("<<beginOptional>>a", "a<<endOptional>>", "<<what>>", "<<beginOptional>>a<<endOptional>>", '<<var;name="x">> a'):
        with pytest.raises(ValueError):
            licenses.Automaton([licenses.Template("b", bad)])
    for label in ("mit-text", "bsd-text", "mpl-2.0-notice", "cc0", "zlib-text"):
        own = next(t for t in licenses.TEMPLATES if t.label == label)
        assert label in licenses.Automaton(licenses.TEMPLATES).accepts_whole(licenses._MARK.sub("", own.text)), label
    full = next(t for t in licenses.TEMPLATES if t.label == "mit-text")
    assert licenses.Automaton([full]).accepts_whole(licenses._MARK.sub("", full.text)) == ["mit-text"]


def test_templates_of_a_folder(tmp_path):
    (tmp_path / "own.template.txt").write_text('use it <<beginOptional>>well<<endOptional>> <<var;name="who";max=1>> please')
    (tmp_path / "readme.md").write_text("<<what>>")
    (own,) = licenses.read_templates(str(tmp_path))
    assert own.label == "own" and licenses.Automaton([own]).accepts_whole("Use it, well: Ann, please!") == ["own"]
    (tmp_path / "bad.template.txt").write_text("a <<what>>")
    with pytest.raises(ValueError):
        licenses.read_templates(str(tmp_path))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("a b c d"), max_size=40), st.lists(st.sampled_from("a b c d e"), max_size=40))
def test_sketches_recover_differences(a, b):
    texts = ["\n".join(x).encode() for x in (a, b)]
    doc, digest = bloom_lookup.paragraph_digests(texts)
    ((more, less),) = bloom_lookup.differences(doc, digest, np.array([0]), np.array([1]), 6)
    x, y = set(digest[doc == 0].tolist()), set(digest[doc == 1].tolist())
    assert set(more.tolist()) == x - y and set(less.tolist()) == y - x


def test_sketch_of_equal_texts_and_edits():
    keys, texts = [1, 2, 3], ["one two three\n" * 30, "", "x"]
    rows = bloom_lookup._compare(keys, texts, texts[0]).to_pylist()
    again = bloom_lookup._compare([9], [texts[0]], "").to_pylist()
    assert rows[0]["fingerprint"] == again[0]["fingerprint"]
    assert rows[1]["near_edited"] == 1.0 and rows[1]["near_next"] == 0.0
    assert bloom_lookup.edit("abcdefgh", "XYZ") == "abcdefXY" and bloom_lookup.edit("abcdefgh", "X") == "abcdefX" and bloom_lookup.edit("abc", "X") == "abc"
    doc, digest = bloom_lookup.paragraph_digests([b"", b"a\nb\n\na", b"", "".join(map(chr, range(0x4E00, 0x4F90))).encode()])
    assert np.bincount(doc, minlength=4)[:3].tolist() == [0, 3, 0] and len(set(digest.tolist())) == len(digest) and (doc == 3).sum() > 1


def likeness_of(a, b):
    """Jaccard similarity of paragraphs as plain multisets."""
    x, y = (Counter(split_paragraphs(t)) for t in (a, b))
    both, all_ = (x & y).total(), (x | y).total()
    return both / all_ if all_ else 1.0


def split_paragraphs(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends = bloom_lookup.paragraphs(raw, np.zeros(1, np.int64)) if len(raw) else ((), ())
    return [text.encode()[s:e] for s, e in zip(starts, ends)]


def test_likeness_equals_brute_force():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["\n"]
    texts = ["", "one line"] + [" ".join(rng.choice(words) for _ in range(rng.randint(0, 400))) for _ in range(40)]
    texts += [texts[-1], " first " + texts[-1]]
    for row, text, after in zip(bloom_lookup._compare(list(range(len(texts))), texts, texts[0]).to_pylist(), texts, [*texts[1:], texts[0]]):
        assert row["near_next"] == pytest.approx(likeness_of(text, after)) and row["near_edited"] == pytest.approx(likeness_of(text, bloom_lookup.edit(text, after)))


def test_a_word_in_front_changes_one_paragraph():
    rng = random.Random(4)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho", "tau", "xi", "zeta"]) + str(rng.randint(0, 99)) for _ in range(400))
    assert likeness_of(text, "word " + text) > 0.9 and b"".join(x + b" " for x in split_paragraphs(text)).split() == text.encode().split()


@pytest.mark.parametrize("version", [1, 2])
def test_arc_to_warc(version):
    records = [arc_warc.ArcRecord("http://a/x y", "1.2.3.4", "20080430204825", "text/html", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello", "200", "-"), arc_warc.ArcRecord("dns:x", "1.2.3.4", "20080430204826", "text/dns", b"plain\n\nbody")]
    data = arc_warc.arc_version_block("f.arc", version, "20080430204825") + b"".join(arc_warc.arc_record(r, version, "f.arc", 0) for r in records)
    back = list(arc_warc.read_arc(io.BytesIO(data)))
    assert [(r.url, r.body) for r in back] == [("http://a/x%20y", records[0].body), ("dns:x", records[1].body)]
    warc = b"".join((arc_warc.to_warc(back[0], "f#0"), arc_warc.to_warc(back[0], "f#1", "f#0"), arc_warc.to_warc(back[1], "f#2")))
    (f0, b0), (f1, b1), (f2, _) = arc_warc.read_warc(io.BytesIO(warc))
    assert f0["warc-date"] == "2008-04-30T20:48:25Z" and f0["warc-type"] == "response" and b0.endswith(b"hello")
    assert f1["warc-type"] == "revisit" and f1["warc-refers-to"] == f0["warc-record-id"] and b1.endswith(b"\r\n\r\n") and f1["warc-payload-digest"] == f0["warc-payload-digest"]
    assert f2["warc-type"] == "resource"
    for damaged in (data[:-5], b"http://x 1 2 3 4\n"):
        with pytest.raises(arc_warc.ArcError):
            list(arc_warc.read_arc(io.BytesIO(damaged), strict=True))
        assert isinstance(list(arc_warc.read_arc(io.BytesIO(damaged)))[-1], arc_warc.ArcFault)


def test_arc_faults_are_told_and_passed_over():
    good = lambda u, date="20080430204825": arc_warc.arc_record(arc_warc.ArcRecord(u, "1.2.3.4", date, "text/html", b"body of it"), 1, "f", 0)
    data = arc_warc.arc_version_block("f.arc", 1, "20080430204825") + good("http://a/") + b"rubbish without a length\nand more of it 7\n" + good("http://b/", "200804302048") + good("http://c/", "20081399") + good("http://d/", "20080430")
    found = list(arc_warc.read_arc(io.BytesIO(data)))
    assert [(f.url, f.date) for f in found if isinstance(f, arc_warc.ArcRecord)] == [("http://a/", "20080430204825"), ("http://b/", "20080430204800"), ("http://d/", "20080430000000")]
    faults = [f for f in found if isinstance(f, arc_warc.ArcFault)]
    assert len(faults) == 2 and data[faults[0].offset :].startswith(b"rubbish") and data[faults[1].offset :].startswith(b"http://c/") and "date" in faults[1].reason


def test_arc_heads_and_names():
    for head in (b"HTTP/1.0 200 OK\nA: b\n\n", b"HTTP/1.0 200 OK\r\n\r\n", b"HTTP/1.0 200 OK\n\r\n"):
        assert arc_warc.split_http(head + b"x\n\ny") == (head, b"x\n\ny")
    assert arc_warc.split_http(b"HTTP/1.0 200") == (b"", b"HTTP/1.0 200")
    names = {arc_warc.target_name(x) for x in ("file:///a/p.arc.gz", "file:///b/p.arc.gz", "file:///a/p.arc")}
    assert len(names) == 3 and all(".warc" in x for x in names)
    assert len({arc_warc.record_id(arc_warc.record_name(f, n, d)) for f in "ab" for n in (0, 1) for d in ("x", "y")}) == 8


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    gaps = []
    for _ in range(25):
        base = list(rng.choice(words, 300))
        other = list(base)
        for i in rng.integers(0, 300, rng.integers(1, 30)):
            other[i] = f"zz{rng.integers(0, 50)}"
        again = ["the cat sat on a mat"] * int(rng.integers(0, 40))
        column = pa.array([" ".join(base + again), " ".join(other + again[: len(again) // 2])])
        doc, key, count = bag_minhash.shingles(*string_buffers(column))
        s = bag_minhash.signatures(doc, key, count, 2, 2000)
        gaps.append((s[0] == s[1]).mean() - bag_minhash.overlap(*bag_minhash._multisets(column, 5)))
    assert abs(np.mean(gaps)) < 0.01 and np.max(np.abs(gaps)) < 0.05


def test_shingles_of_short_and_empty_texts():
    doc, key, count = bag_minhash.shingles(*string_buffers(pa.array(["", "a b", "A, b!", "a b c d e", "x x x x x x x", None])))
    assert doc.tolist() == [1, 2, 3, 4] and count.tolist() == [1, 1, 1, 3] and key[0] == key[1] != key[2]


def test_vp_tree_equals_brute_force():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    x[100:200] = x[:100]  # ties
    ids = rng.permutation(3000)
    tree, rows = vp_tree.VpTree(x), np.arange(200)
    d = vp_tree.distances(x[rows], x)
    d[rows, rows] = np.inf
    best = np.array([np.lexsort((ids, r))[:10] for r in d])
    for factor, least in ((1.0, 1.0), (0.7, 0.9)):
        name, score = tree.search(x[rows], ids[rows], ids, 10, factor)
        recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(name, ids[best])])
        assert recall >= least
        if factor == 1.0:
            assert np.array_equal(name, ids[best]) and np.array_equal(score, np.take_along_axis(d, best, axis=1))


def test_classifier_learns():
    rng = random.Random(0)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30)) for _ in range(60)]
    bad = [" ".join([rng.choice(["one", "two", "six"])] * 30) for _ in range(60)]
    model = quality.train(good + bad, [1] * 60 + [0] * 60)
    texts = [t.encode() for t in ["alpha delta beta", "two two two two two", ""]]
    z = quality.Scorer(model).logits(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert z[0, 1] > z[0, 0] and z[1, 1] < z[1, 0] and np.array_equal(z[2], model.bias)
    doc, bucket = quality.features(np.frombuffer(texts[1], np.uint8), np.array([0, len(texts[1])]))
    slow = model.weights[bucket].astype(float).mean(axis=0) + model.bias
    assert np.allclose(slow, z[1])
    assert quality.train([], []).classes == (0, 1)


def test_distances_of_large_vectors():
    x = np.array([[1e200, 0.0], [0.0, 1e200], [1.0, 1.0], [1.7e308, -1.7e308], [-1.7e308, 1.7e308]])
    d = vp_tree.distances(x, x)
    assert d[0, 1] == pytest.approx(2**0.5 * 1e200) and d[0, 0] == 0 and d[3, 4] == np.inf
    name, score = vp_tree.VpTree(x, leaf=1).search(x[[0]], np.array([0]), np.arange(5), 10)
    assert name[0, :4].tolist() == [2, 1, 3, 4] and (name[0, 4:] == np.iinfo(np.int64).max).all()


@pytest.mark.parametrize("copies", [0, 300])
def test_routes_bound_distances(copies):
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(size=(500, 4)), np.tile(rng.normal(size=(1, 4)), (copies, 1))))
    routes = vp_tree.Routes(x[::2], 12)
    leaf = routes.leaf(x)
    known = {int(k): routes.ranges(int(k), x[leaf == k]) for k in np.unique(leaf)}
    assert len(known) > 6
    q = rng.normal(size=(30, 4))
    gaps, d = routes.gaps(q, known), vp_tree.distances(q, x)
    for k in known:
        assert (gaps[:, k] <= d[:, leaf == k].min(axis=1) + 1e-9).all()
