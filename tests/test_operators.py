import gzip

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import checkdigits as check
from corpusloom.functions import text as T
from corpusloom.operators import dedup, filters, language, pii, profile, sampling
from corpusloom.operators.components import components
from corpusloom.plans import pipelines
from corpusloom.sources import readers, sinks
from corpusloom.streaming import jobs


def one(spark, column, *values):
    return spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()


def test_text_functions(spark):
    assert one(spark, T.replace_unicode_punct, "１—…「a」")[0][0] == '" - ..."a"'
    assert one(spark, T.normalize, "  Été 12 „x“ ")[0][0] == 'ete 00 "x"'
    assert one(spark, T.strip_accents, "Ångström ñ é")[0][0] == "Angstrom n e"
    assert one(spark, T.normalize_for_dedup, " HELLO, １2\t")[0][0] == "hello, 00"
    assert one(spark, lambda c: T.ngrams(T.split_words(c), 2), "a b c", "a")[0][0] == ["a b", "b c"]
    assert one(spark, lambda c: T.ngrams(T.split_words(c), 2), "a")[0][0] == []
    assert one(spark, T.sentences, "A b. C d! E")[0][0] == ["A b. ", "C d! ", "E"]
    assert spark.range(1).select(T.line_ids_base64(F.array(F.lit(0), F.lit(4)))).first()[0] == "AAAEAA=="
    assert one(spark, T.drop_bad_words, "see http://x.com now\nwww.a\nok")[0][0] == "see now\nok"
    assert one(spark, lambda c: T.drop_long_words(c, 3), "abcd abc\tab")[0][0] == "abc\tab"
    row = one(spark, lambda c: F.struct(T.surt(c).alias("s"), T.registered_domain(T.url_host(c)).alias("d")), "https://www.News.example.co.uk/A?b=1")[0][0]
    assert (row.s, row.d) == ("uk,co,example,news)/a?b=1", "example.co.uk")
    assert one(spark, lambda c: T.spacing_for_tokens(c, "fr"), "1 000 (x ) « y »")[0][0] == '1,000  (x)  "y"'


@pytest.mark.parametrize(
    "rule, good, bad",
    [
        (check.credit_card, "4111111111111111", "4111111111111112"),
        (check.bitcoin, "1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2", "1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN3"),
        (check.bitcoin, "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdp"),
        (check.dni, "12345678Z", "12345678A"),
        (check.nie, "X1234567L", "X1234567A"),
        (check.ccc, "12341234161234567890", "12341234171234567890"),
        (check.nif, "501964843", "501964844"),
        (check.cpf, "39053344705", "39053344706"),
        (check.abn, "83914571673", "83914571674"),
        (check.tfn, "123456782", "123456783"),
        (check.sin, "123456782", "123456783"),
        (check.aadhaar, "234123412346", "234123412347"),
        (check.resident_card, "11010519491231002X", "110105194912310021"),
        (check.curp, "BOXW310820HNERXN09", "BOXW310820HNERXN08"),
        (check.citizen_card, "000000000ZZ4", "000000000ZZ5"),
    ],
)
def test_check_digits(rule, good, bad):
    assert rule(good) and not rule(bad)


def test_pii_modes(spark):
    text = "Mail me at jane.doe@example.com or the IP is 10.0.0.1; card 4111 1111 1111 1111, version 310.1.1.1"
    row = one(spark, lambda c: F.struct(pii.mask_pii(c).alias("r"), pii.mask_pii(c, mode="tag").alias("t"), pii.find_pii(c).alias("e")), text)[0][0]
    assert row.r == "Mail me at <EMAIL_ADDRESS> or the IP is <IP_ADDRESS>; card <CREDIT_CARD>, version 310.1.1.1"
    assert "<EMAIL_ADDRESS:jane.doe@example.com>" in row.t
    assert [(e.type, text[e.pos : e.pos + len(e.value)] == e.value) for e in row.e] == [("CREDIT_CARD", True), ("IP_ADDRESS", True), ("EMAIL_ADDRESS", True)]
    assert one(spark, pii.mask_pii, None)[0][0] is None
    assert one(spark, pii.mask_pii, "10.0.0.1 without the word")[0][0] == "10.0.0.1 without the word"


def test_pii_context_and_tasks(tmp_path):
    near = pii.Context(("ip",), "word", 16, 16)
    assert near.near("the   IP\n\n10.0.0.1", 10, 18) and not near.near("ship 10.0.0.1", 5, 13)
    for bad in ((), ("",)):
        with pytest.raises(ValueError):
            pii.Context(bad)
    with pytest.raises(ValueError):
        pii.resolve("en", types=["NOPE"])
    file = tmp_path / "tasks.json"
    file.write_text('[{"pii": "AGE", "task": "\\\\d+ years", "lang": "en"}]')
    assert pii.extract("I am 33 years old", pii.read_tasks(str(file)))[0]["value"] == "33 years"
    assert pii.substitute("a12345678Zb 12345678Z", pii.resolve("es", "es", ["GOV_ID"]), "<{name}>") == "a<GOV_ID>b <GOV_ID>"


def test_line_dedup(spark):
    docs = spark.createDataFrame([(1, "_a\nb\nb\nc"), (2, "_A\nd"), (3, "_a")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.nlines, r.line_ids, r.original_nlines) for r in dedup.drop_shared_lines(docs).collect()}
    assert got == {1: ("b\nc", 2, [1, 3], 4), 2: ("d", 1, [1], 2)}
    kept = {r.doc_id: r.text for r in dedup.keep_first_lines(docs, keep_empty=True).collect()}
    assert kept == {1: "_a\nb\nc", 2: "d", 3: ""}


def test_simhash_and_clusters(spark):
    base = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, base), (2, base + " tail"), (3, " ".join(f"z{i}" for i in range(200))), (4, "short")], "doc_id long, text string")
    got = {r.doc_id: r.cluster for r in pipelines.near_dedup(docs).collect()}
    assert got[1] == got[2] is not None and got[3] is None and got[4] is None


def test_simhash_pairs_of_all_documents(spark, tmp_path):
    from corpusloom.queries import QUERIES

    base = [f"w{i}" for i in range(120)]
    edit = lambda *at: " ".join(f"x{i}" if i in at else w for i, w in enumerate(base))
    texts = [edit(), edit(), edit(), edit(119), edit(0), edit(1), edit(60), edit(30, 90), "short", "also short", " ".join(f"z{i}" for i in range(90))]
    rows = [(1000 - 7 * i, t) for i, t in enumerate(texts * 2)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = {i: t.split() for i, t in rows}
    h = {i: dedup._simhash([" ".join(w[k : k + 6]) for k in range(max(0, len(w) - 6))]) for i, w in words.items()}
    apart = lambda a, b: bin((h[a] ^ h[b]) & (2**64 - 1)).count("1")
    wanted = {(a, b): apart(a, b) for a in h for b in h if a < b and apart(a, b) <= 4}
    got = [tuple(r) for r in QUERIES["d17_simhash_pairs"](spark, str(tmp_path)).select("id_a", "id_b", "distance").collect()]
    member = {i: i for i in h} | {b: a for a, b, n in got if n == 0}
    near = {(a, b): n for a, b, n in got if n}
    expand = {}
    for a in h:
        for b in h:
            x, y = sorted((member[a], member[b]))
            if a < b and (x == y or (x, y) in near):
                expand[a, b] = near.get((x, y), 0)
    assert expand == wanted and {0} < set(wanted.values()) and len(got) == len(set(got)) < len(wanted)


def test_repeated_windows(spark):
    shared = "0123456789" * 6
    docs = spark.createDataFrame([(1, "ab" + shared), (2, shared + "xyz"), (3, "nothing")], "doc_id long, text string")
    spans = {(r.doc_id, r.begin, r.end) for r in dedup.repeated_windows(docs).collect()}
    assert spans == {(1, 2, 62), (2, 0, 60)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[i] for i in (100, 101, 102)} == {100} and got[200] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_histogram_and_chart(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.0, 0.1, 0.1, 0.4, 0.4, 1.0, 1.0)], "v double")
    assert {r.bin: r.n for r in profile.histogram(df, "v", 0.0, 1.0, 10).collect()} == {0: 2, 1: 2, 4: 2, 9: 2}
    assert [r.n for r in profile.histogram(df, "v", 0.0, 1.0, 10, cumulative=True).orderBy("bin").collect()] == [2, 4, 6, 8]
    assert profile.bar_chart([(0, 4), (1, 2)], [0.0, 0.5], 4).count("*") == 6


def test_wet(spark, tmp_path):
    record = "WARC/1.0\r\nWARC-Type: {}\r\nWARC-Target-URI: http://a.example/{}\r\nWARC-Date: d\r\nWARC-Block-Digest: sha1:x\r\n\r\n{}"
    text = record.format("warcinfo", 0, "info\r\n\r\n") + record.format("conversion", 1, "Title\nline one\nline two\n\n\n") + record.format("conversion", 2, "T\nx\n\n")
    (tmp_path / "a.wet.gz").write_bytes(gzip.compress(text.encode()))
    rows = readers.read_wet(spark, str(tmp_path), 5).collect()
    assert [(r.url, r.title, r.raw_content, r.nlines, r.source_domain) for r in rows] == [("http://a.example/1", "Title", "line one\nline two", 2, "a.example")]


def test_json_lines_and_splits(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"text": "a", "lang": "en"}\nbad\n{"text": "b", "lang": ""}\n')
    df = readers.read_jsonl(spark, str(tmp_path / "x.json"), "text string, lang string").cache()
    assert df.where("_corrupt_record IS NOT NULL").count() == 1
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "x.json"), "text string, lang string", strict=True).collect()
    sinks.split_by(df.drop("_corrupt_record"), ["lang"], str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).select("lang", "text").collect() == [("en", "a")]
    with pytest.raises(KeyError):
        sinks.split_by(df, ["nope"], str(tmp_path / "no"))
    assert sinks.parse_size("4K") == 4096


def test_filters_verdict(spark):
    rows = [(1, "hello " * 50, "en"), (2, "one two", "en"), (3, None, "xx")]
    got = {r.doc_id: r.discard_reason for r in filters.filter_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1] == "word_repetition" and got[2] == "words_few" and got[3] == "words_few"


def test_stop_words_of_the_cutoffs(spark):
    assert {k: len(filters.STOPWORDS[k].split()) for k in ("en", "fr")} == {"en": 301, "fr": 365}
    text = "because they never found another way home, the old farmer and several neighbours stayed overnight"
    ratio = one(spark, lambda x: filters.listed_ratio(x, F.lit("en"), filters.STOPWORDS), text)[0][0]
    assert ratio >= filters.CUTOFFS["en"].stop_least
    assert one(spark, lambda x: filters.listed_ratio(x, F.lit("en"), filters.STOPWORDS), "alpha beta gamma")[0][0] == 0


def test_flagged_words_language_and_perplexity_discard(spark):
    few = "because they never found another way home, the old farmer and several neighbours stayed overnight until it was the morning"
    es = " ".join(w for w in filters.STOPWORDS["es"].split() if len(w) > 5 and w.isalpha())[:400]
    rows = [(1, few, "en", 10.0), (2, few + " porn", "en", 10.0), (3, few, "es", 10.0), (4, few, "en", 1501.0), (5, es + " la casa de los y el", "es", 10.0), (6, few, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity double")
    got = {r.doc_id: (r.discard_reason, r.flagged_ratio, r.lang_score) for r in pipelines.verdicts(docs).collect()}
    assert [got[i][0] for i in (1, 2, 4, 6)] == [None, "flagged", "perplexity", None]
    assert got[2][1] > 0.01 and got[3][2] == 0.0 and got[3][0] is not None and got[5][2] is None
    kept = {r.doc_id for r in pipelines.filter_corpus(docs).collect()}
    assert {1, 6} <= kept and not kept & {2, 3, 4}


def test_language_and_sampling(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "la casa de los y el", "es")], "doc_id long, text string, lang string")
    assert [r.pred_lang for r in language.identify(docs).orderBy("doc_id").collect()] == ["en", "es"]
    assert language.identify(docs, top=2).where("doc_id = 1").first().pred_langs["en"] == 1.0
    chance = spark.createDataFrame([(5.0,), (10.0,), (20.0,)], "p double").select(sampling.stepwise(F.col("p"), (10.0, 20.0, 30.0), 1.0).alias("c"))
    assert [round(r.c, 3) for r in chance.collect()] == [0.1, 0.1, 0.1]
    masked = docs.select(sampling.mask_tokens(F.sequence(F.lit(1), F.lit(500)), F.col("doc_id"), 0, 1000).alias("m")).first().m
    assert 40 < sum(x != -100 for x in masked.labels) < 120


def test_stream_dedup(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 01:00:00"), (3, "b", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "doc_id long, text string, t string").select("doc_id", "text", F.to_timestamp("t").alias("t")).write.parquet(str(tmp_path / "in"))
    stream = jobs.dedup_stream(jobs.documents_stream(spark, str(tmp_path / "in"), "doc_id long, text string, t timestamp"), "t")
    q = stream.writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.text for r in spark.sql("SELECT text FROM deduped").collect()) == ["a", "b"]


def test_chain(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, "c")], "id long, text string")
    assert [r.value for r in pipelines.run_chain(df, [["where", "{id} = 1"], ["select", "id", "text", "no"]]).collect()] == ["1\ta N3WL1N3 b\t"]
