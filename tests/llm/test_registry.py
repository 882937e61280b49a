"""Every registered query on the smallest tables: against its SQL where there is one, else against brute force or its contract."""

import zlib

import pytest

from tests.llm.test_documents import brute_classes, brute_scores, check_pieces
from tests.llm.test_vectors_and_pages import brute_links
from verdance.llm import packing, registry

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    rows = duck.execute(f"SELECT {', '.join(names)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in df.select(*names).collect())


def test_toxicity_query(spark, duck, texts):
    out = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, DIR).collect()}
    assert set(out) == {i for i, _, _ in texts}
    assert all(r.held_out == (crc(i) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in out.items())


def test_scoring_query(spark, texts):
    held = [crc(i) == 1 for i, _, _ in texts]
    out = {r.doc_id: r for r in QUERIES["op5_lm_scoring"](spark, DIR).collect()}
    for (i, _, _), h, (tokens, known, base) in zip(texts, held, brute_scores(texts, held), strict=True):
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known) == (h, tokens, known) and abs(r.base_score - base) < 1e-6 * abs(base)


def test_vector_query(spark, duck):
    rows = duck.execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op6_vector_dedup"](spark, DIR).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute_links(rows).items()}


def test_packing_query(spark, texts):
    check_pieces(QUERIES["op7_packing"](spark, DIR).collect(), {i: t for i, t, _ in texts})


def test_near_dedup_query(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op9_near_dedup"](spark, DIR).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute_classes(texts).items()}


def test_near_dedup_of_a_larger_table(spark, duck):
    larger = DIR.replace("0.001", "0.01")
    rows = duck.execute(f"SELECT doc_id, text, source FROM read_parquet('{larger}/documents.parquet') ORDER BY doc_id").fetchall()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op9_near_dedup"](spark, larger).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute_classes(rows).items()}


def test_both_encoders_agree_on_every_text_of_a_table(spark):
    fast, exact = packing.Encoder(*packing.vocabulary_paths()), packing.Encoder(packing.vocabulary_paths()[0])
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text is not null").select("text").collect():
        assert fast(r.text).tolist() == exact(r.text).tolist()
