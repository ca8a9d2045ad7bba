"""The strict selection and its SQL on p-values that all round to 0."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from clonoscope.plans import catalogue


def test_tiny_p_values_are_told_apart(spark, tmp_path):
    """60 patterns with p-values below 5e-11, of which those with the larger fold change have the larger ones."""
    words = [f"{chr(65 + j // 8)}X{chr(65 + j % 8)}" for j in range(60)]
    held = lambda i: [w for j, w in enumerate(words) if (i < 40 + 2 * j if i < 200 else i - 200 < j)]
    texts = [" ".join(held(i)) for i in range(400)]
    pq.write_table(pa.table({"doc_id": range(400), "text": texts, "lang": ["en"] * 400, "source": ["s"] * 400, "n_chars": [len(t) for t in texts]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": range(400), "quality": [int(i < 200) for i in range(400)], "toxic": [0] * 400}), tmp_path / "labels.parquet")
    con = duckdb.connect()
    pq.write_table(pa.table({"item_id": [1], "text": ["AXA"]}), tmp_path / "benchmark.parquet")
    for name in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    ours = {r["kmer"] for r in catalogue.QUERIES["pattern_select_strict"](spark, str(tmp_path)).collect()}
    theirs = {r[1] for r in con.execute(catalogue.SQL["pattern_select_strict"]).fetchall()}
    assert len(ours) == 50
    assert ours == theirs
