"""Small tables of the mixing solver reach the executors without Python workers."""

from wavekin.llm import mixing


def test_the_solver_makes_no_python_tables(spark, edge_docs, no_docs, monkeypatch):
    want = sorted(map(str, mixing.mix_sources(edge_docs).collect()))
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    assert sorted(map(str, mixing.mix_sources(edge_docs).collect())) == want
    assert len(want) == edge_docs.count()
    monkeypatch.undo()
    assert mixing.mix_sources(no_docs).collect() == []
