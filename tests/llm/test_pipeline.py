"""The pipeline against its stages by hand, and that nothing else needs this package."""

import subprocess
import sys

import corpus_pipeline
from tests.conftest import DATA, ROOT
from tests.llm.test_operators import brute_hits, similar_components
from tidewrack.llm import langid, mixing


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    dictionaries = langid.fit(docs)
    classify = langid.classifier(dictionaries)
    rows = [r for r in docs.collect() if (found := classify(r["text"]))[0] != "und" and found[1] >= langid.NARROW]
    rows.sort(key=lambda r: r["doc_id"])
    roots, _ = similar_components([r["text"] for r in rows])
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]

    def clean(text):
        n, hit, _ = brute_hits(text, items)
        return not (hit and 20 * hit >= n)

    rows = [r for r in rows if clean(r["text"])]
    taken = {r["doc_id"]: r["repeats"] for r in mixing.mix(spark.createDataFrame(rows, docs.schema)).collect()}
    want = sorted(i for i, n in taken.items() for _ in range(n))
    got = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in got) == want
    assert len({(r["shard"], r["slot"]) for r in got}) == len(got)


def test_stage_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)


def test_odd_tables(spark, tmp_path):
    """Nulls, ties, repeats, clashing names, a very long text, empty tables: every stage has its rows."""
    from pyspark.sql import functions as F

    prose = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("lang = 'en' and length(text) > 400").orderBy("doc_id").limit(6).collect()]
    rows = [(1, prose[0], "en", "s", 1), (2, prose[0], "en", None, 1), (None, prose[1], "en", "t", None), (None, prose[1], "en", "t", None), (4, None, None, None, None), (5, "", "en", "s", 0), (6, " \n", "en", "s", 0), (7, " ".join(prose[2:4] * 60), "fr", "s", 9), (7, prose[4], None, "u", 9), (8, prose[5], "en", "", 9)]
    rows += [(i, prose[i % 6], "en", "s", 1) for i in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(3) for c in ("k_id", "x_id", "w_id", "fp", "root", "key", "size", "id", "_hash")})
    bench = spark.createDataFrame([(1, None), (None, "..."), (2, "x")], "item_id long, text string")
    for name, own, items in (("odd", docs, bench), ("none", docs.limit(0), bench.limit(0))):
        own.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}/odd").collect()
    assert {7, 8} <= {r["doc_id"] for r in got} <= {1, 7, 8, 20, 21, 25} and len({(r["shard"], r["slot"]) for r in got}) == len(got)
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0


def test_no_shared_folder():
    """On a cluster without a shared folder nothing is written to a local one."""
    from types import SimpleNamespace

    import pytest

    from tidewrack.llm import scratch

    session = lambda **conf: SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: conf.get(k.split(".")[1], default)))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            scratch.folder(session(master=master))
    assert scratch.folder(session(master="local[4]")).startswith("file:///tmp/") and scratch.folder(session(master="yarn", checkpoint="hdfs:///x")) == "hdfs:///x"


def test_library_stands_alone():
    """With this package and the pipeline gone, the rest imports and registers its queries."""
    code = "import sys\nclass Gone:\n  def find_spec(self, name, *a):\n    if name.startswith('tidewrack.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name=name)\nsys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\nq = e.queries()\nassert q and not any(k.startswith('op') or k == 'pipeline' for k in q) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
