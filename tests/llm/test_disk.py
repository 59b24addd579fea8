"""What the stages leave on disk."""

import random

import pyarrow.parquet as pq

from rasterloom.llm import mixing


def test_the_mix_packs_its_copy_of_the_texts(spark, monkeypatch):
    """The pipeline's mixing stage: the table of whole rows is the largest that it writes."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=400)), f"s{i % 3}") for i in range(60)]
    docs, written, write = spark.createDataFrame(rows, "doc_id long, text string, source string"), [], mixing.materialise
    monkeypatch.setattr(mixing, "materialise", lambda *a: written.append(write(*a)) or written[-1])
    got = mixing.materialise_mix(docs).collect()
    assert {r.doc_id for r in got} <= set(range(60)) and {r.text for r in got} & {t for _, t, _ in rows}
    whole = [t for t in written if "row" in t.columns]
    files = [f.removeprefix("file://") for t in whole for f in t.inputFiles()]
    codecs = {pq.ParquetFile(f).metadata.row_group(0).column(1).compression for f in files}
    assert len(whole) == 1 and codecs == {"ZSTD"}
