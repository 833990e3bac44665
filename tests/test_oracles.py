"""Every registered query of the library against DuckDB, on the smallest tables."""

import glob
import os
import re

import duckdb
import pytest

from corpusloom.operators import pii
from corpusloom.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def normal(value):
    if isinstance(value, float):
        return repr(round(value, 6))
    return [normal(x) for x in value] if isinstance(value, list | tuple) else str(value)


EMAIL = re.compile(r"[\w.=-]+@[\w.-]+\.\w{2,3}")


def squeezed(text):
    return re.sub(r"\W|_", "", text)


#: What holds for the rows of queries that SQL can't express, given the documents' texts by id.
WITHOUT_SQL = {
    "f10_spacing": lambda rows, texts: all(squeezed(r.en) == squeezed(texts[r.doc_id]) for r in rows) and len(rows) == len(texts),
    "f12_subwords": lambda rows, texts: all(len(r.pieces) >= len(texts[r.doc_id].split()) for r in rows) and len(rows) == len(texts),
    "q09_all_checks": lambda rows, texts: {r.doc_id for r in rows} == set(texts),
    "q12_all_checks": lambda rows, texts: sum(r.n for r in rows) == len(texts) and abs(sum(r.share for r in rows) - 1) < 1e-9,
    "i01_mask_pii": lambda rows, texts: {r.doc_id for r in rows} == set(texts) and not any(EMAIL.search(r.text) for r in rows),
    "i03_entities": lambda rows, texts: all(texts[r.doc_id][r.pos : r.pos + len(r.value)] == r.value for r in rows),
    "i13_tasks": lambda rows, texts: len(rows) == len(pii.DETECTORS),
    "i31_anonymise": lambda rows, texts: {r.doc_id for r in rows} == set(texts) and all((r.n > 0) == (r.text != texts[r.doc_id]) for r in rows),
    "c12_html_text": lambda rows, texts: all(r.error == 0 and "<p" not in r.text and "track(" not in r.text for r in rows),
    "c15_annotate_languages": lambda rows, texts: all([x.n_chars for x in r.on_lines] == [len(x) for x in texts[r.doc_id].split("\n")] for r in rows),
    "m02_language_by_lines": lambda rows, texts: all(0 <= r.pred_score <= 1 for r in rows),
    "m07_sentence_perplexity": lambda rows, texts: all(r.perplexity >= 1 and texts[r.doc_id].split("\n")[r.pos] == r.sentence for r in rows),
    "m13_mine_sentences": lambda rows, texts: all(0 < r.perplexity < 1000 and r.sentence in texts[r.doc_id] for r in rows),
    "m16_projection": lambda rows, texts: all(min(r[k] for r in rows) == 0 and max(r[k] for r in rows) == 255 for k in ("pc1", "pc2")),
    "a13_mask_tokens": lambda rows, texts: all(len(r.ids) == len(r.labels) for r in rows) and 0.1 < sum(x != -100 for r in rows for x in r.labels) / sum(len(r.labels) for r in rows) < 0.2,
    "o05_mine": lambda rows, texts: all(r.bucket in ("head", "middle", "tail", "all") and r.language_score >= 0.5 and r.nlines > 0 for r in rows),
    "o09_filter_corpus": lambda rows, texts: {r.doc_id for r in rows} < set(texts) and all(len(r.text) <= len(texts[r.doc_id]) for r in rows),
    "o11_clean_site": lambda rows, texts: len({r.text.replace(" ", "") for r in rows}) == len(rows) and all(len(r.text) > 32 for r in rows),
}


def test_no_query_goes_unproved():
    assert set(QUERIES) - set(ORACLES) == set(WITHOUT_SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect(config={"memory_limit": "8GB", "temp_directory": "", "max_temp_directory_size": "0GB"})
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    rows = found.collect()
    if name not in ORACLES:
        texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
        assert rows and WITHOUT_SQL[name](rows, texts)
        return
    wanted = duck.sql(ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    at = [wanted.columns.index(c) for c in columns]
    assert sorted(str([normal(r[c]) for c in columns]) for r in rows) == sorted(str([normal(r[i]) for i in at]) for r in wanted.fetchall())
