from collections import Counter

import corpus_pipeline
import __spark_entry__

from .conftest import WORD, SCHEMA, odd_texts, rows_of
from rasterloom.llm import jaccard, mixing, packing, resampling, secrets

SF = "/root/testdata/sf0.001"


def test_stages_agree_with_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    at, ids = docs, lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, at, SF))
        if name != "best-fit packing":
            assert out.columns == docs.columns
        seen.append((at, out))
        at = out
    keep = {r.doc_id for r in resampling.resample(docs, labels).where("kept").collect()}
    assert ids(seen[0][1]) == sorted(keep)
    classes = {r.doc_id: r.class_id for r in jaccard.link(seen[1][0]).collect()}
    assert ids(seen[1][1]) == sorted(i for i, c in classes.items() if i == c)
    assert ids(seen[2][1]) == ids(seen[2][0])
    left = secrets.scan(seen[2][1]).agg({"n_assign": "sum", "n_hex": "sum", "n_access": "sum"}).first()
    assert set(left) == {0}
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(seen[3][0]).collect()}
    assert ids(seen[3][1]) == sorted(i for i, (n, size) in taken.items() for _ in range(-(-n // size) if size else 0))
    got = Counter()
    for r in seen[3][1].collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    assert got == Counter({i: n for i, (n, _) in taken.items() if n})
    want = packing.pieces(seen[4][0]).count()
    assert seen[4][1].count() == want


def test_entry_lists_every_query():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names


def odd_rows(spark, folder):
    """Rows without an id, repeated rows, null, blank, long and equal texts, and columns with the names used inside."""
    texts = odd_texts()
    plain = "the river was old and the house by the river was green and quiet in the evening light of autumn "
    rows = rows_of(texts + [plain + str(i) for i in range(12)])
    again = [rows[20], rows[20], rows[21]]
    nameless = [(None, *r[1:]) for r in rows[15:19]] + [(None, None, "en", None, 0, *"rbktsz"), (None, *rows[16][1:])]
    docs = spark.createDataFrame(rows + again + nameless, SCHEMA)
    docs = docs.selectExpr("*", "1 as taken", "2 as at", "3 as n", "4 as part", "5 as kept", "6 as gumbel", "7 as log_weight", "8 as component", "9 as __id")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(1, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_pipeline_keeps_odd_rows_and_words(spark, tmp_path):
    docs = odd_rows(spark, tmp_path)
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    total = at.count()
    sizes = lambda d: sorted(len(WORD.findall(r.text or "")) for r in d.select("text").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialise(stage(spark, at, str(tmp_path)))
        assert out.columns == docs.columns, name
        if name == "quality classifier":
            share = resampling.keep_share(spark.read.parquet(f"{tmp_path}/labels.parquet"))
            assert out.count() >= round(share * total) and out.where("doc_id is null").count() >= 1
        elif name == "n-gram Jaccard join":
            assert out.where("doc_id is null").count() == at.where("doc_id is null").count()
            assert out.where("doc_id is not null").count() == out.where("doc_id is not null").select("doc_id").distinct().count()
        elif name == "secret scans":
            assert out.count() == at.count() and out.where("text like '%24be64439e3e%'").count() == 0
        else:
            assert sum(sizes(out)) == sum(r.taken for r in mixing.mix(at).collect())
        at = out
    pieces = packing.pack(at).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in at.collect()} and sum(r.piece == 0 for r in pieces) == at.count()


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
