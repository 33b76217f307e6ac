"""What the Jaccard join holds on disk."""

import random
from pathlib import Path

from helixlake.llm import jaccard_join
from helixlake.storage import release


def test_shuffles_of_the_parts_come_one_range_after_the_other(spark, monkeypatch):
    """All parts grouped and sorted at once take more than twice their table."""
    rng = random.Random(5)
    docs = [(k, " ".join(str(rng.randrange(10**6)) for _ in range(400))) for k in range(1500)]
    docs += [(k + 10_000, docs[k][1] + " end") for k in range(300)]
    folders = [Path(str(d)) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: sum(f.stat().st_size for d in folders for f in d.rglob("shuffle_*.data"))
    table, most, at_first = [], [], []
    given = jaccard_join.written

    def watched(df, tag):
        out, at = given(df, tag)
        if tag == "shingle-parts":
            table.append(sum(f.stat().st_size for f in Path(at.removeprefix("file:")).rglob("*.parquet")))
            release(spark)
            at_first.append(shuffled())
        if tag == "shingle-regions":
            most.append(shuffled() - at_first[0])
        return out, at

    monkeypatch.setattr(jaccard_join, "written", watched)
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_documents(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80, 100).collect()}
    assert got == {k: k % 10_000 for k, _ in docs}
    assert max(most) < 1.2 * table[0], (most, table)
