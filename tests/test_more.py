"""Readers, sinks, personal data, models and drivers on small fixtures, against plain versions."""

import gzip
import io
import json
import lzma
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import storage
from corpusloom.functions import checkdigits
from corpusloom.functions import text as T
from corpusloom.operators import crawl, dedup, filters, language, numbering, pii, profile, projections, sampling, search
from corpusloom.plans import pipelines
from corpusloom.sources import corpora, ranges, readers, sinks


# -- storage, order, percentiles ---------------------------------------------------------


def test_storage_is_cleared(spark, tmp_path):
    df = storage.materialize(spark.range(5), "x")
    path = df._written
    assert sinks.exists(spark, path)
    storage.discard(df, spark.range(3))
    assert not sinks.exists(spark, path)


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class sparkContext:
            master = "yarn"

        class conf:
            get = staticmethod(lambda key, default: None)

    with pytest.raises(RuntimeError):
        storage.shared_root(Cluster)


def test_numbers_and_totals_in_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 9)) for i in rng.sample(range(10_000), 700)] + [(None, 4)]
    df = spark.createDataFrame(rows, "k long, n long").repartition(6)
    found = sorted((r.row_id, r.k, r.n) for r in numbering.number_rows(df, "k", parts=5).collect())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert found == [(i, *r) for i, r in enumerate(order)]
    at = 0
    totals = {r.k: r.before for r in numbering.running_total(df, "n", "k", parts=5).collect()}
    for k, n in order:
        assert totals[k] == at
        at += n
    assert numbering.number_rows(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 40 + [7.0], list(range(1001)), []])
def test_percentiles_equal_numpy(spark, values):
    rows = [(float(v), g) for v in values for g in ("a", None)] + [(None, "a")]
    df = spark.createDataFrame(rows, "v double, g string").repartition(3)
    for group in (None, "g"):
        found = profile.percentiles(df, "v", {"p": 0.3, "q": 0.625, "r": 1.0}, group).collect()
        assert len(found) == (0 if not values else 1 if group is None else 2)
        for r in found:
            assert [r.p, r.q, r.r] == pytest.approx(np.quantile(values if group else values + values, [0.3, 0.625, 1.0]).tolist())


# -- readers and sinks ----------------------------------------------------------------------


def test_ranges_hold_each_line_once(tmp_path):
    data = "first\nsecond é line\n\nfourth 日本語\nno end".encode()
    path = tmp_path / "x.txt"
    path.write_bytes(data)
    for chunks in range(1, len(data) + 3):
        step, found = -(-len(data) // chunks), []
        for k in range(chunks):
            found += [line for _, line in ranges.range_lines(str(path), k * step, min(len(data), (k + 1) * step))]
        assert found == data.split(b"\n")


def test_text_of_any_compression(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt.xz").write_bytes(lzma.compress("één\ntwee\n".encode()))
    (tmp_path / "b.txt.gz").write_bytes(gzip.compress(b"one\n\nthree"))
    (tmp_path / "c.txt").write_bytes(b"plain\r\n")
    files = readers.open_paths(str(tmp_path / "*"))
    rows = readers.read_any_text(spark, files).orderBy("file", "line").collect()
    assert [r.value for r in rows] == ["één", "twee", "one", "", "three", "plain\r"]
    monkeypatch.setattr("sys.stdin", io.StringIO("x\ny\n"))
    assert [r.value for r in readers.read_any_text(spark, ["-"]).orderBy("line").collect()] == ["x", "y"]
    assert readers.open_paths(["http://a/b", str(tmp_path / "c.*")], lambda u: "/local" + u[7:])[0] == "/locala/b"
    with pytest.raises(ValueError):
        readers.open_paths("https://a/b")


def test_wet_records(tmp_path, spark):
    head = "WARC/1.0\r\nWARC-Type: {}\r\nWARC-Target-URI: http://h/{}\r\nContent-Length: {}\r\n\r\n"
    bodies = ["Title\nline one\nWARC/1.0\nline two\n", "T\nüber\n"]
    text = head.format("warcinfo", 0, 4) + "info\r\n\r\n" + "".join(head.format("conversion", i, len(b.encode())) + b + "\r\n\r\n" for i, b in enumerate(bodies))
    found = list(readers.parse_wet(text.splitlines(keepends=True), "s"))
    assert [(r[0], r[6], r[7]) for r in found] == [("http://h/0", "Title", "line one\nWARC/1.0\nline two"), ("http://h/1", "T", "über")]
    (tmp_path / "s.warc.wet.gz").write_bytes(gzip.compress(text.encode()))
    assert readers.read_wet(spark, str(tmp_path), 1).count() == 2


def test_downloads_are_told_and_tried_again(spark, tmp_path):
    rows = spark.createDataFrame([(i, bytes([i]) * (i + 1)) for i in range(20)], "page_id long, data binary")
    places = storage.materialize(sinks.write_records(rows, f"file://{tmp_path}/r", "page_id", "data"), "places")
    got = readers.download_ranges(places, f"file://{tmp_path}/r/")
    assert {r.page_id: bytes(r.compressed_warc) for r in got.collect()} == {i: bytes([i]) * (i + 1) for i in range(20)}
    broken = readers.download_again(places.withColumn("warc_filename", F.lit("no.bin")), f"file://{tmp_path}/r/")
    assert readers.failures(broken).count() == 20 and {r.outcome: r.n for r in readers.failure_report(broken).collect()} == {"FileNotFoundError": 20}
    mended = readers.download_again(broken.drop("warc_filename").join(places.select("page_id", "warc_filename"), "page_id"), f"file://{tmp_path}/r/")
    assert readers.failures(mended).count() == 0


def test_seeds_of_both_kinds(spark, tmp_path):
    df = spark.createDataFrame([("http://b",), ("http://a",)], "link string")
    df.write.parquet(f"{tmp_path}/s.parquet")
    df.write.option("header", True).csv(f"{tmp_path}/s")
    for path in (f"{tmp_path}/s.parquet", f"{tmp_path}/s"):
        seeds = readers.read_seeds(spark, path)
        assert readers.seed_of(seeds, 1) == "http://b"
        with pytest.raises(KeyError):
            readers.seed_of(seeds, 2)


def test_dumps_and_segments(spark):
    page = '<a href="/CC-MAIN-2019-09">x</a> CC-MAIN-2019-04 CC-MAIN-2019-09'
    assert corpora.list_dumps(page) == ["2019-09", "2019-04"]
    fetched = []
    rows = corpora.segments(spark, ["2019-09"], lambda u: fetched.append(u) or gzip.compress(b"a/1.gz\na/2.gz\n")).collect()
    assert [tuple(r) for r in rows] == [("2019-09", "a/1.gz"), ("2019-09", "a/2.gz")] and "2019-09/wet.paths.gz" in fetched[0]


def test_names_of_rolled_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "i long, t string")
    names = sinks.write_rolled(df, f"file://{tmp_path}/p_???.json", "t", "1K")
    assert len(names) == 5 and all(re.fullmatch(r"p_00\d\.json", n.rsplit("/", 1)[1]) for n in names)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == [f"p_{i:03d}.json" for i in range(5)]
    with pytest.raises(ValueError):
        sinks.write_rolled(df, f"{tmp_path}/p.json", "t")
    assert [sinks.parse_size(x) for x in ("4G", "10K", "1.5M", 17)] == [4 << 30, 10 << 10, 3 << 19, 17]


def test_a_merge_checks_every_row(spark, tmp_path):
    spark.createDataFrame([(1, 7), (2, 8)], "x long, seed_id long").write.parquet(f"{tmp_path}/a")
    assert sinks.merge_seed(spark, [f"{tmp_path}/a"] * 2, "seed_id", 7).count() == 2
    with pytest.raises(KeyError):
        sinks.split_by(spark.range(2), ["nothing"], f"{tmp_path}/b")


def test_clauses_and_steps(spark):
    assert pipelines.clause_sql("{a b} = '{x}' AND {c} > 1") == "`a b` = '{x}' AND `c` > 1"
    df = spark.createDataFrame([(1, "{x}"), (2, "y")], "n long, t string")
    assert [r.n for r in pipelines.run_chain(df, [["where", "{t} = '{x}'"]]).collect()] == [1]
    assert projections.drop_keys(df, "n", "t").count() == 0 and pipelines.run_pipes(df, lambda x: None, lambda x: x) is None
    with pytest.raises(ValueError):
        pipelines.run_chain(df, [["what"]])
    known = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "n long, name string")
    assert projections.lookup(df.where("n = 1"), known, "n", {"name": "who"}).first().who == "a"
    with pytest.raises(Exception, match="has 2 rows"):
        projections.lookup(df, known, "n", {"name": "who"}).collect()
    assert projections.deepest(["seed", "intermediate_depth_2", "intermediate_depth_10"]) == "intermediate_depth_10"


def test_helpers_of_drivers(spark, tmp_path):
    assert pipelines.map_array(spark, lambda x: x * 2, [3, 1, 2], 2) == [6, 2, 4]
    with pytest.raises(Exception, match="ZeroDivision|division"):
        pipelines.map_array(spark, lambda x: 1 // x, [1, 0])
    assert pipelines.worker_count(-1, spark) == spark.sparkContext.defaultParallelism and pipelines.worker_count(2, spark) == 2
    with pytest.raises(ValueError):
        pipelines.worker_count(10_000, spark)
    for n in ("b.json.gz", "a.json.gz", "c.txt"):
        (tmp_path / n).touch()
    assert pipelines.expand_files([str(tmp_path), "x"]) == [str(tmp_path / "a.json.gz"), str(tmp_path / "b.json.gz"), "x"]
    assert [crawl.task_slice(list("abcdefg"), k, 3) for k in range(3)] == [list("abc"), list("def"), ["g"]]
    seen = profile.observed(spark.createDataFrame([("abc",), (None,)], "text string"), "o")
    seen[0].collect()
    assert seen[1].get == {"rows": 2, "characters": 3}
    with pytest.raises(ValueError):
        sampling.SamplingArguments("what").chance(F.lit(1))


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([(1, "en"), (2, "fr")], "n long, lang string").write.parquet(f"{tmp_path}/d.parquet")
    assert pipelines.main([f"{tmp_path}/d.parquet", "where", "{lang} = 'en'", "--", "select", "n", "lang"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"value": "1\ten"}


# -- text ----------------------------------------------------------------------------------------


def test_codecs_round_trip(spark):
    df = spark.createDataFrame([("AAAEAA==",), ("",), ("//8=",)], "b string")
    assert [r[0] for r in df.select(T.line_ids(F.col("b"))).collect()] == [[0, 4], [], [65535]]
    key = spark.range(1).select(T.digest_key(F.lit("sha1:ABCDEFGHIJ")), T.digest_key(F.lit("md5:x"))).first()
    import base64

    assert key[0] == base64.b32decode("ABCDEFGH").hex().upper()[:8] and key[1] is None


def test_tokens_and_pieces(spark):
    import public_tokenizers
    import sentencepiece

    df = spark.createDataFrame([("Hello, world (it's 1,000.5) ok.\nNext!", "en"), (None, "en")], "t string, l string")
    found = df.select(T.tokenise(F.col("t")).alias("t")).collect()
    assert found[0].t == "Hello , world ( it 's 1,000.5 ) ok .\nNext !" and found[1].t is None
    assert spark.range(1).select(T.tokenise(F.lit("l'eau, ok."), "fr")).first()[0] == "l' eau , ok ."
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = df.select(T.subword_pieces(F.col("t"), {"en": path}, F.col("l")).alias("p"), T.subword_pieces(F.col("t"), {"fr": path}, F.col("l")).alias("q")).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert pieces[0].p == " ".join(model.encode("Hello, world (it's 1,000.5) ok.\nNext!", out_type=str)) and pieces[0].q.startswith("Hello") and pieces[1].p is None


def test_verdict_of_one_text(spark):
    found = filters.verdict(spark, "zzz qqq", "en")
    assert found["number_words"] == 2 and found["discard_reason"] == "words_few" and "stopwords" in found["failed"]
    assert filters.verdict(spark, "zzz qqq", "en", filters.Cutoffs(words_least=1, stop_least=0.0))["discard_reason"] is None
    assert filters.metrics(spark.createDataFrame([(None, "xx"), ("", None)], "text string, lang string")).count() == 2


# -- personal data ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "lang, text, wanted",
    [
        ("en", "phone number: +34 983 453 999", "phone number: <PHONE_NUMBER>"),
        ("en", "ph. +34983453999", "ph. <PHONE_NUMBER>"),
        ("en", "phone number: +99 983 453 999", None),
        ("en", "number: +34983453999", None),
        ("en", "phonograph +34983453999", None),
        ("en", "SSN: 536-90-4399", "SSN: <GOV_ID>"),
        ("en", "SSN: 536 90 4399", "SSN: <GOV_ID>"),
        ("en", "not: 666-90-4399", None),
        ("en", "not: 536-90 4399", None),
        ("zh", "045-4123456", "<PHONE_NUMBER>"),
        ("zh", "70045-4123456", None),
        ("zh", "+8613812345678,138123456789", "<PHONE_NUMBER>,138123456789"),
        ("zh", "广东省深圳市南山大道12弄35号", "<STREET_ADDRESS>"),
        ("zh", "深圳市南山大道", None),
        ("zh", "癌症", "<DISEASE>"),
    ],
)
def test_patterns(lang, text, wanted):
    assert pii.substitute(text, pii.resolve(lang, {"en": "us", "zh": "cn"}[lang]), "<{name}>") == (wanted or text)


def test_numbers_of_the_administration():
    assert checkdigits.ssn("078051120") and not any(checkdigits.ssn(x) for x in ("000121234", "900121234", "123001234", "123120000", "12312000"))


def test_context_is_bounded_and_folds_blanks():
    near = pii.Context(("ip",), "word", 8, 8)
    text = "x " * 100_000 + "ip" + " " * 500 + "1.2.3.4" + " y" * 100_000
    at = text.index("1.2.3.4")
    assert near.near(text, at, at + 7) and not near.near("ip " + "z" * 9 + " 1.2.3.4", 13, 20)


def test_manager_and_units(spark, tmp_path):
    df = spark.createDataFrame([(1, "Mail a@b.com now.\nAnd c@d.org. Or x@y.net!", "en"), (2, None, "en"), (3, "nothing", "es")], "doc_id long, text string, lang string")
    own = pii.Manager("en", types=("EMAIL_ADDRESS",))
    assert {r.doc_id: r.text for r in own(df).collect()} == {1: "Mail <EMAIL_ADDRESS> now.\nAnd <EMAIL_ADDRESS>. Or <EMAIL_ADDRESS>!", 2: None, 3: "nothing"}
    assert {r.type: r.n for r in own.statistics(df).collect()} == {"EMAIL_ADDRESS": 3, "calls": 3} and own.tasks()[0]["type"] == "EMAIL_ADDRESS"
    for split in ("block", "line", "sentence"):
        assert pii.process_units(df, own, split).where("doc_id = 1").first().text == "Mail <EMAIL_ADDRESS> now.\nAnd <EMAIL_ADDRESS>. Or <EMAIL_ADDRESS>!"
        assert "".join(r.text for r in pii.units(df, split).where("doc_id = 1").orderBy("index").collect()) == "Mail a@b.com now.\nAnd c@d.org. Or x@y.net!"
    found = pii.process_units(df, pii.Manager("en", types=("EMAIL_ADDRESS",), mode="extract"), "line").orderBy("index", "pos").collect()
    assert [(r["index"], r.pos, r.value) for r in found] == [(1, 5, "a@b.com"), (2, 4, "c@d.org"), (2, 16, "x@y.net")]
    full = pii.Manager("en", types=("EMAIL_ADDRESS",), mode="full", template=None)(df).where("doc_id = 1").first()
    assert len(full.entities) == 3 and full.text.startswith("Mail a@b.com")
    pii.write_ndjson(df, pii.Manager("en", types=("EMAIL_ADDRESS",), mode="extract"), f"{tmp_path}/n")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/n").collect()]
    assert len(lines) == 3 and all(set(x) == {"type", "name", "value", "pos", "line", "doc_id"} for x in lines)
    for bad in (lambda: pii.Manager(mode="what"), lambda: pii.units(df, "word"), lambda: pii.find_pii(F.col("text"), types=("WHAT",))):
        with pytest.raises(ValueError):
            bad()


def test_detectors_of_the_rows_language(spark):
    dni = "12345678Z"
    df = spark.createDataFrame([(1, f"DNI {dni}", "es"), (2, f"DNI {dni}", "en"), (3, f"DNI {dni}", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.t for r in df.select("doc_id", pii.mask_pii(F.col("text"), F.col("lang"), "any").alias("t")).collect()} == {1: "DNI <GOV_ID>", 2: f"DNI {dni}", 3: f"DNI {dni}"}


class Twice(pii.Finder):
    type, name = "GOV_ID", "doubled word"

    def candidates(self, text):
        return ((m.start(), m[0]) for m in re.finditer(r"\b(\w+) \1\b", text))


def test_finders(tmp_path):
    assert pii.extract("so so it it", [Twice()]) == [{"type": "GOV_ID", "name": "doubled word", "value": v, "pos": p, "country": None} for p, v in ((0, "so so"), (6, "it it"))]
    words = pii.Function(lambda t: ["ab", "ab", ""], "GOV_ID", "ab", context=pii.Context(("near",), "string", 20, 0))
    assert words.find("near ab and ab") == [(5, "ab"), (12, "ab")] and words.find("ab") == []
    path = tmp_path / "tasks.json"
    path.write_text(json.dumps([{"pii": "GOV_ID", "lang": "en", "task": r"\d{4}", "valid": "even"}]))
    own = pii.read_tasks(str(path), {"even": lambda v: int(v) % 2 == 0})
    assert [v for _, v in own[0].find("1233 1234")] == ["1234"]
    with pytest.raises(ValueError):
        pii.read_tasks(str(path))


def test_entity_json(spark):
    row = spark.createDataFrame([(("GOV_ID", None, "v", 3, None),)], f"e {pii.ENTITY[6:-1]}").select(pii.entity_json(F.col("e"))).first()[0]
    assert json.loads(row) == {"type": "GOV_ID", "value": "v", "pos": 3}


# -- lines, windows, clusters ----------------------------------------------------------------------------


def test_repeated_windows_equal_brute_force(spark):
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = letters(20)
    rows = [(i, letters(rng.randint(0, 60)) + (shared[: rng.choice([11, 12, 20])] if i % 2 else "") + letters(rng.randint(0, 30))) for i in range(40)] + [(90, None), (91, "ab" * 40)]
    found = sorted((r.doc_id, r.begin, r.end) for r in dedup.repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), width=12).collect())
    count = Counter(t[i : i + 12] for _, t in rows if t for i in range(len(t) - 11))
    wanted = []
    for k, t in rows:
        spans: list = []
        for i in range(len(t or "") - 11):
            if count[t[i : i + 12]] > 1:
                if spans and i - spans[-1][2] <= 12:
                    spans[-1][1:] = [i + 12, i]
                else:
                    spans.append([i, i + 12, i])
        wanted += [(k, a, b) for a, b, _ in spans]
    assert found == sorted(wanted) and wanted


def test_hot_lines(spark):
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))  # noqa: E731 - digits are all alike in a line's key
    rows = [(i, f"\nown {name(i)}\n" + ("shared\n" if i % 2 else "") + f"OWN {name(i)}") for i in range(3000)]
    found = dedup.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in found} == {i: f"own {name(i)}" for i in range(3000)}


def test_first_copies_and_frequent_lines(spark):
    rows = [(1, " a \n\nb", "x"), (2, "a\nc\na", "x"), (3, "a", "code"), (4, "b\na", "x"), (5, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept, twice = dedup.first_copies(df, spare=F.col("source") == "code")
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "a\nb", 2: "c", 3: "a", 4: "", 5: ""}
    assert {r.line: r.n for r in twice.collect()} == {"a": 4, "b": 2}
    kept, skipped = dedup.keep_one_of_frequent(df, least=3, share=0.0, apply=F.col("source") != "code")
    assert {r.line: r.n for r in skipped.collect()} == {"a": 4} and {r.doc_id: r.text for r in kept.collect()} == {1: "a\n\nb", 2: "c", 3: "a", 4: "b", 5: ""}


def test_clusters_with_equal_hashes(spark):
    h = spark.createDataFrame([(1, 5), (2, 5), (3, 7), (4, 9)], "doc_id long, h long")
    pairs = spark.createDataFrame([(7, 9, 1)], "a long, b long, distance int")
    of = lambda **o: {r.doc_id: r.cluster for r in dedup.hash_clusters(pairs, h, **o).collect()}
    assert of() == {1: None, 2: None, 3: 7, 4: 7} and of(include_exact=True) == {1: 5, 2: 5, 3: 7, 4: 7}


# -- crawl -----------------------------------------------------------------------------------------------------


def test_archives_to_html(spark):
    def record(kind, block):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n" + "<p>é</p>".encode("latin-1")
    zipped = b"HTTP/1.1 200 OK\nContent-Encoding: gzip\n\n" + gzip.compress(b'<meta charset="utf-8"><p>\xc3\xa9</p>')
    rows = [(1, record("request", b"GET") + record("response", http), "text/html"), (2, gzip.compress(record("response", zipped)), "text/html"), (3, record("response", http)[:-30], "text/html"), (4, b"%PDF", "application/pdf"), (5, None, "text/html"), (6, record("request", b"x"), "text/html")]
    df = spark.createDataFrame([(*r, "http://a.org/x", "a.org") for r in rows], "page_id long, compressed_warc binary, content_mime_detected string, url string, domain string")
    found = {r.page_id: (r.html_str, r.html_error, r.pdf_url) for r in crawl.preprocess_pages(df).collect()}
    assert found[1][0] == "<p>é</p>" and found[2][0].endswith("<p>é</p>") and "cut off" in found[3][1] and found[6][1] == "no response"
    assert found[4] == (None, None, "http://a.org/x") and found[5] == (None, None, None)


def test_html_to_text(spark):
    page = "<html><head><title>A &amp; B</title></head><body><h1>Head</h1><script>x()</script><p>one <b>two</b><br>three</p><footer>f</footer></body></html>"
    rows = spark.createDataFrame([(page,), (None,), ("",)], "h string").select(crawl.html_text(F.col("h")).alias("p")).select("p.*").collect()
    assert (rows[0].text, rows[0].title, rows[0].error) == ("Head\none two\nthree", "A & B", 0) and rows[1].text is None and rows[2].text == ""


# -- models ---------------------------------------------------------------------------------------------------


TEXTS = [("the cat sat on the mat", "en"), ("the dog sat on the cat\nthe end", "en"), ("le chat est sur le lit", "fr"), ("the the the", "en"), ("", "en"), (None, "fr")]


def brute_kn(sentences, d=0.75):
    c3 = Counter()
    for w in sentences:
        w = ["<s>", "<s>", *w, "</s>"]
        c3.update(zip(w, w[1:], w[2:]))
    c2 = Counter((v, w) for _, v, w in c3)
    c1 = Counter(w for _, w in c2)

    def p1(w):
        total, kinds = sum(c1.values()), len(c1)
        return max(c1[w] - d, 0) / total + kinds * d / total / (kinds + 1)

    def p2(v, w):
        total, kinds = sum(n for (a, _), n in c2.items() if a == v), sum(a == v for a, _ in c2)
        return p1(w) if not total else max(c2[v, w] - d, 0) / total + kinds * d / total * p1(w)

    def p3(u, v, w):
        total, kinds = sum(n for (a, b, _), n in c3.items() if (a, b) == (u, v)), sum((a, b) == (u, v) for a, b, _ in c3)
        return p2(v, w) if not total else max(c3[u, v, w] - d, 0) / total + kinds * d / total * p2(v, w)

    vocabulary = {*c1, None}
    assert sum(p3("the", "cat", w) for w in vocabulary) == pytest.approx(1)
    return p3


def test_trigrams_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(TEXTS)], "doc_id long, text string, lang string")
    words = lambda t: (t or "").replace("\n", "").split()  # noqa: E731 - line ends are control characters, and go
    p3 = brute_kn([words(t) for t, k in TEXTS if k == "en" and words(t)])
    model = language.train_trigrams(df)
    other = spark.createDataFrame([(0, "the cat ran", "en"), (1, "sat on a mat", "en"), (2, "x", "xx"), (3, None, "en")], "doc_id long, text string, lang string")
    for docs, texts in ((df, TEXTS), (other, [(r.text, r.lang) for r in other.collect()])):
        found = {r.doc_id: r.perplexity for r in language.trigram_perplexity(docs, model).collect()}
        for i, (t, k) in enumerate(texts):
            w = ["<s>", "<s>", *words(t), "</s>"]
            if k != "en" or len(w) == 3:
                assert k == "fr" or found[i] is None
                continue
            logp = sum(math.log10(p3(*w[j - 2 : j + 1])) for j in range(2, len(w)))
            assert found[i] == pytest.approx(round(10 ** (-logp / (len(w) - 2)), 1))
    lines = language.sentence_perplexity(df, model).where("doc_id = 1").orderBy("pos").collect()
    assert [r.sentence for r in lines] == ["the dog sat on the cat", "the end"] and all(r.perplexity > 0 for r in lines)
    assert {r.sentence for r in language.mine_sentences(df, model, 1e9).collect()} == {"the cat sat on the mat", "the dog sat on the cat", "the end", "le chat est sur le lit", "the the the"}


def test_identifier_is_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train_identifier(docs.where("doc_id % 2 = 0"))
    rows = language.identify_with(docs.where("doc_id % 2 = 1"), model).collect()
    assert sum(r.pred_lang == r.lang for r in rows) / len(rows) > 0.93
    top = language.identify_with(docs.limit(5), model, top=2).first().pred_langs
    assert len(top) == 2 and sum(top.values()) <= 1.01
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "ab")], "doc_id long, text string")
    assert {r.pred_score for r in language.identify_with(odd, model).collect()} == {0.25}
    notes = language.annotate_languages(docs.limit(3), model).collect()
    assert all(len(r.on_lines) >= 1 for r in notes) and language.disagreement(spark.createDataFrame([("a", "b"), ("a", "a")], "lang string, pred_lang string")).first().differ == 1


def test_projection_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) + 3
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>").repartition(4)
    found = sorted((r.vec_id, r.pc1, r.pc2) for r in language.project(rows).collect())
    _, _, axes = np.linalg.svd(x - x.mean(axis=0))
    for k in (0, 1):
        axis = axes[k] * np.sign(axes[k][np.abs(axes[k]).argmax()])
        z = (x - x.mean(axis=0)) @ axis
        assert [r[k + 1] for r in found] == pytest.approx(((z - z.min()) / (z.max() - z.min()) * 255).tolist(), abs=2e-3)


def test_index_is_stored_and_deleted(spark, tmp_path):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alphabet"), (3, "gamma")], "doc_id long, text string")
    path = f"file://{tmp_path}/i"
    search.save_index(df, path)
    index = search.load_index(spark, path)
    assert [(r.doc_id, r.score) for r in search.search_index(index, "alpha").collect()] == [(r.doc_id, r.score) for r in search.bm25(df, "alpha").collect()]
    search.delete_index(spark, path)
    assert not (tmp_path / "i").exists()


def test_mix_by_ratio_counts(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(300)] + [(1000, None)], "id long, s string")
    found = Counter(r.s for r in sampling.mix_by_ratio(df, "id", "s", {"a": 0.1, "b": 0.0}).collect())
    assert found == {"a": 10, "c": 100}


def test_discriminating_histogram_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert filters.outlier_histogram(df, "v").count() == 0 and profile.automatic_bins(spark.createDataFrame([(1.0,), (2.0,)], "v double"), "v").first().n == 2
