"""The pipeline against a brute-force version over the smallest documents."""

import hashlib
from collections import defaultdict

import corpus_pipeline
from tests.llm.test_operators import classes, contaminated, library, shingles, similar

SF = "/root/testdata/sf0.001"


def by_hand(docs, items):
    docs = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t)}
    seen = defaultdict(list)
    for i, t in docs.items():
        ls = t.split("\n")
        for p in range(len(ls) - 2):
            seen[tuple(ls[p : p + 3])].append((i, p))
    cleaned = {}
    for i, t in docs.items():
        ls = t.split("\n")
        gone = {p + d for p in range(len(ls) - 2) if min(seen[tuple(ls[p : p + 3])]) < (i, p) for d in range(3)}
        cleaned[i] = "\n".join(x for p, x in enumerate(ls) if p not in gone)
    ids = sorted(cleaned)
    sets = [shingles(cleaned[i]) for i in ids]
    least = {}
    for i, c in zip(ids, classes(len(ids), lambda a, b: similar(sets[a], sets[b])), strict=True):
        least.setdefault(c, i)
    return {i: cleaned[i] for i in least.values() if not any(contaminated(cleaned[i], t) for t in items)}


def test_pipeline(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    enc = library()
    want = {}
    for i, t in by_hand(docs, items).items():
        ids = enc.encode_ordinary(t)
        want[i] = len(ids), hashlib.sha256(t.encode()).hexdigest(), ids
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256, r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want)
    assert got == want and 100 < len(got) < len(docs)


def test_odd_documents_pass_through(spark, tmp_path):
    # nulls in every column, shared ids, repeated rows, clashing extra columns, texts longer than a block
    from tests.llm.texts import SCHEMA, rows

    long = "\n".join(f"line {k} of a long text with words {k * 7919 % 1009}" for k in range(4000))
    data = rows() + [(5000, long, None, None, None, None, None, None), (None, long[:3000], "en", "s", 1, "x", 1, None), (None, None, None, None, None, None, None, None)]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, data[3][1][:200]), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in got]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and 5000 in ids and ids.count(None) >= 1
    assert data[3][0] not in ids and not {3, 4, 5} & set(ids)
    whole = {hashlib.sha256(t.encode()).hexdigest(): i for i, t, *_ in data if t}
    assert whole[next(r.decoded_sha256 for r in got if r.doc_id == 5000)] == 5000
    assert all(len(r.ids) == r.n_tokens for r in got)


def test_stages_keep_the_columns_of_documents_and_bear_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
