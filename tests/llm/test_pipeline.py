import corpus_pipeline
from tests.llm.helpers import frame
from tests.llm.test_operators import DATA, brute_components, toxic_data

from leadlens.llm import queries


def test_stages(spark, tmp_path, monkeypatch):
    docs, labels = toxic_data(200)
    docs += [(1000 + i, t, *rest) for i, t, *rest in DATA]
    docs.append((2000, "contact a@b.co about it", *DATA[0][2:]))
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept, str(tmp_path)).write.parquet(str(tmp_path / name))
        kept = out[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert kept.columns == frame(spark, docs).columns
    ids = lambda n: {r.doc_id for r in out[n].collect()}
    assert ids("toxicity") == {i for i, *_ in docs if not (i < 200 and i % 5 == 0)}
    left = [d for d in docs if d[0] in ids("toxicity")]
    assert ids("near_dedup") == {i for i, (_, _, kept) in brute_components(left, 5, 80).items() if kept}
    assert ids("suffix_dedup") == ids("personal_data") == ids("near_dedup") == ids("packing")
    assert out["personal_data"].where("doc_id = 2000").first().text == "contact [EMAIL] about it"
    assert sorted(map(tuple, (r[:5] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()))) == sorted(map(tuple, (r[:5] for r in out["packing"].collect())))


def test_registered():
    names = list(queries.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))


def test_stages_on_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, repeated ids, and columns whose names the stages use inside; then no rows at all."""
    odd = "doc_id long, text string, _first int, row string, text_ string, th long, _null boolean, first long, n_chars long, at timestamp_ntz"
    same, long = "one text that is long enough to be a passage of over fifty bytes", "word " * 4000
    data = [(i, x, 7, "r", "t", 1, True, 2, len(x or ""), None) for i, x in ((1, same), (1, same), (2, "two a@b.co words here"), (2, "another text of the same id"), (3, None), (4, ""), (None, same), (None, None), (5, long))]
    spark.createDataFrame([(1, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(data, odd)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).collect()
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and (name == "packing" or empty.columns == docs.columns)
        if name != "packing":
            assert all((r["_first"], r.row, r.text_, r.th, r["_null"], r["first"], r["at"]) == (7, "r", "t", 1, True, 2, None) for r in out)
            assert sum(r.doc_id is None for r in out) == 2
        if name in ("suffix_dedup", "personal_data"):
            assert len(out) == len(data) and sum(r.text is None for r in out) == 2
        if name == "near_dedup":
            assert sorted(r.doc_id for r in out if r.doc_id) == [1, 2, 3, 4, 5]
        if name == "packing":
            assert len({(r.sequence_id, r.offset) for r in out}) == len(out) >= len(data)
