"""What must hold of operators as tables grow: bounded tasks, driver and workers, and odd rows that large tables have."""

import pytest
from pyspark.sql import functions as F

from corpusloom import queries
from corpusloom.operators import crawl, dedup, pii


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hash_keys_are_never_broadcast(spark):
    hashes = spark.createDataFrame([(i, i * 1103515245 % (1 << 62)) for i in range(50)] + [(99, 1103515245 ^ 3)], "doc_id long, h long")
    pairs = dedup.hamming_pairs(hashes)
    assert "Broadcast" not in plan(pairs)
    assert {(r.a, r.b, r.distance) for r in pairs.collect()} >= {(min(1103515245, 1103515245 ^ 3), max(1103515245, 1103515245 ^ 3), 2)}


@pytest.mark.parametrize("split", ["line", "sentence", "block"])
def test_texts_without_units_stay(spark, split):
    rows = [(1, "write to a.b@c.org\nnow"), (2, ""), (3, None)]
    found = pii.process_units(spark.createDataFrame(rows, "doc_id long, text string"), pii.Manager("en", types=("EMAIL_ADDRESS",)), split)
    assert sorted((r.doc_id, r.text) for r in found.collect()) == [(1, "write to <EMAIL_ADDRESS>\nnow"), (2, ""), (3, None)]


def test_pages_of_one_address(spark, tmp_path):
    import duckdb

    rows = [(k, f"http://h{k % 2}.org/p{k // 4}?a=1&b", "x" * (150 + 20 * k)) for k in range(9)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("s13_directory_tags", "s14_tagged_corpus"):
        found, wanted = queries.QUERIES[name](spark, str(tmp_path)), con.sql(queries.ORACLES[name])
        assert sorted(tuple(r[c] for c in wanted.columns) for r in found.collect()) == sorted(wanted.fetchall())


def test_seed_join_by_equal_prefixes(spark):
    index = [(k, "d.org" if k % 3 else "e.org", f"org,d)/{k % 7}/{k}") for k in range(300)] + [(300, None, "org,d)/"), (301, "d.org", None), (302, "d.org", "org,d)/1/1")]
    seeds = [(0, "d.org", "org,d)/1"), (1, "d.org", "org,d)/1"), (2, "d.org", ""), (3, "e.org", "org,d)/2/"), (4, None, "org"), (5, "d.org", None), (6, "f.org", "o")]
    found = crawl.seed_join(spark.createDataFrame(index, "page_id long, domain string, surt string"), spark.createDataFrame(seeds, "seed_id long, domain string, surt string"))
    wanted = sorted((p, s) for p, d, k in index for s, e, x in seeds if d is not None and d == e and k is not None and x is not None and k.startswith(x))
    assert found.columns == ["page_id", "domain", "surt", "seed_key", "seed_id"]
    assert sorted((r.page_id, r.seed_id) for r in found.collect()) == wanted
    assert "StartsWith" not in plan(found) and "NestedLoop" not in plan(found)
    none = crawl.seed_join(spark.createDataFrame(index, "page_id long, domain string, surt string"), spark.createDataFrame([], "seed_id long, domain string, surt string"))
    assert none.columns == found.columns and none.count() == 0


@pytest.mark.parametrize("seed", [42, None])
def test_pages_are_sampled_by_ids_alone(spark, seed):
    rows = [(k, "a" if k % 5 else "b", f"text {k} " * 3) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "doc_id").cast("binary")) if seed else F.lit("")
    found = dedup.first_of_groups(docs, "source", "doc_id", order, 20)
    wanted = docs.withColumn("_o", order).collect()
    for source in "ab":
        first = sorted((r._o, r.doc_id) for r in wanted if r.source == source)[:20]
        assert sorted(r.doc_id for r in found.where(F.col("source") == source).collect()) == sorted(k for _, k in first)
    assert "Window" not in plan(found) and all(r.text == f"text {r.doc_id} " * 3 for r in found.collect())


def test_grams_are_counted_in_linear_time(spark):
    import time

    from corpusloom.operators import language

    long = "añ\U0001f600b\x00c " * 60_000  # by place in the text, each gram cost a walk from its start
    rows = [("x", long), ("x", "ab"), ("y", "abab"), (None, "abab"), ("y", None)]
    began = time.time()
    model = language.train_identifier(spark.createDataFrame(rows, "lang string, text string")).collect()
    assert time.time() - began < 60
    p = {(r.lang, r.gram): r.logp for r in model}
    assert {g for lang, g in p if lang == "x"} - {None} == {(long + long)[i : i + 3] for i in range(7)}
    assert {g for lang, g in p if lang == "y"} == {None, "aba", "bab"} and p["y", "aba"] == p["y", "bab"]


def test_mining_finds_languages_once(spark):
    from corpusloom.plans import pipelines

    docs = spark.createDataFrame([(k, f"the cat of {chr(97 + k) * 3} and the dog of {chr(97 + k) * 5} is in the house\n" * 6) for k in range(26)], "doc_id long, text string")
    found = pipelines.mine(docs, pipelines.Mining(least_chars=10))
    assert "array_sort" not in plan(found) and found.count() == 26


def test_places_are_moved_as_hashes(spark):
    from corpusloom.operators import language

    docs = spark.createDataFrame([(1, "en", "the cat sat"), (2, "en", ""), (3, "en", None), (4, None, "the cat"), (5, "fr", "the")], "doc_id long, lang string, text string")
    found = language._grams(docs, "lang", "text")
    assert [t for t in found.dtypes if t[0] in ("hu", "hv", "hw")] == [("hu", "bigint"), ("hv", "bigint"), ("hw", "bigint")]
    rows = found.collect()
    assert sorted((r.doc_id, r.w) for r in rows) == sorted([(1, "the"), (1, "cat"), (1, "sat"), (1, "</s>"), (5, "the"), (5, "</s>")])
    one = {r.w: r for r in rows if r.doc_id == 1}
    assert one["cat"].hv == one["the"].hw == one["sat"].hu and one["</s>"].hu == one["cat"].hw
    assert one["the"].hw != next(r.hw for r in rows if r.doc_id == 5 and r.w == "the")
    model = language.train_trigrams(docs)
    own = language.trigram_logp(docs, model, ["doc_id"])
    assert plan(own).count("MapInArrow") == 1 and {r.doc_id: r.places for r in own.collect()} == {1: 4, 5: 2}


def test_few_rows_are_objects_at_once(spark):
    from corpusloom.functions.arrow import sliced

    docs = spark.range(1000).coalesce(1).selectExpr("id", "CASE WHEN id % 7 > 0 THEN concat('t', id) END AS t")
    seen = sliced("n int, t array<string>", lambda ids, t: [None if x is None else (len(ids), [x]) for x in t], 300)
    rows = docs.select("id", seen("id", "t").alias("s")).collect()
    assert {r.s.n for r in rows if r.s} == {300, 100} and all((r.s is None) == (r.id % 7 == 0) and (r.s is None or r.s.t == [f"t{r.id}"]) for r in rows)


def test_windows_are_no_objects(spark):
    import random

    text = "".join(random.Random(5).choices("abcdefghijklmnop", k=400))
    docs = spark.createDataFrame([(1, text), (2, "x" * 30 + text[100:200] + "y" * 30), (3, "none of it"), (4, None)], "doc_id long, text string")
    found = dedup.repeated_windows(docs)
    assert {(r.doc_id, r.begin, r.end) for r in found.collect()} == {(1, 100, 200), (2, 30, 130)}
