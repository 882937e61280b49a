"""The pipeline's stages, one after the other, against brute force on what each one gets."""

from collections import Counter

import numpy as np

import corpus_pipeline
from tests.llm.test_documents import DOCS, brute_classes, brute_lines, check_pieces
from verdance.llm import mixing


def corpus():
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for k in range(160):
        text = [f"w{j}" for j in rng.integers(0, 300, int(rng.integers(8, 60)))]
        toxic = k % 8 == 0
        if toxic:
            text[3:3] = ["vileone", "viletwo"]
        body = " ".join(text[:20]) + "\nshared footer of all sites\n" + " ".join(text[20:])
        rows.append((k, body, f"s{k % 12}"))
        labels.append((k, int(toxic)))
    rows += [(1000 + k, rows[k][1] + " end", "s1") for k in range(1, 40)] + [(2000, "", "s2"), (2001, None, None), (2002, "a lone text", None)]
    return rows, labels


def test_each_stage_equals_brute_force(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        given = [(r.doc_id, r.text, r.source) for r in now.collect()]
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        got = now.collect()
        seen[name] = got
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
        if name == "toxicity":
            gone = {g[0] for g in given} - {r.doc_id for r in got}
            assert gone == {i for i, t, _ in rows if t and "vile" in t}
        elif name == "line dedup":
            want = brute_lines(given)
            assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text or "") for r in got)
            assert any("shared footer" in (t or "") for _, t, _ in given) and not any("shared footer" in (r.text or "") for r in got)
        elif name == "MinHash near-dedup":
            assert {r.doc_id for r in got} == {i for i, (_, c) in brute_classes(given).items() if i == c}
        elif name == "mixing sources":
            taken = {r.doc_id: r for r in mixing.mix(spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in given], DOCS)).collect()}
            assert Counter(r.doc_id for r in got) == Counter({i: int(r.taken / r.size + 0.5) for i, r in taken.items() if r.size and r.taken / r.size >= 0.5})
        else:
            check = {}
            for i, t, _ in given:
                check.setdefault(i, t)
            once = {}
            for r in got:
                once.setdefault((r.doc_id, r.start), []).append(r)
            times = Counter(i for i, _, _ in given)
            assert all(len(v) == times[i] for (i, _), v in once.items())
            single = [r for r in got if times[r.doc_id] == 1]
            assert sum(r.length for r in got) >= sum(r.length for r in single) > 0
            assert {r.doc_id for r in got} == set(check)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == len(seen["packing"])


def test_pieces_of_unrepeated_documents(spark):
    rows, _ = corpus()
    texts = {i: t for i, t, _ in rows}
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)
    check_pieces(corpus_pipeline.STAGES[-1][1](spark, docs, "").collect(), texts)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
