import ast
import pathlib

import pyarrow as pa

from labarr.llm import common, queries, secrets


def test_sample_is_bounded_and_the_same_however_rows_are_spread(spark):
    df = spark.range(20_000)
    picks = [{r["id"] for r in common.sampled(d, 20_000, 500, "id").collect()} for d in (df, df.repartition(7))]
    assert picks[0] == picks[1] and 400 < len(picks[0]) < 600
    assert common.sampled(df, 20_000, 30_000, "id").count() == 20_000


def test_tables_go_to_the_shared_folder(spark):
    folder = common.shared_dir(spark)
    df = common.materialize(spark.range(5), "five")
    assert df.count() == 5 and folder in df.inputFiles()[0] and spark.conf.get("spark.checkpoint.dir") == folder


def test_tables_can_be_dropped(spark):
    path = common.materialize(spark.range(5), "gone").inputFiles()[0].removeprefix("file://")
    assert pathlib.Path(path).exists() and common.drop_tables(spark) >= 1
    assert not pathlib.Path(path).exists() and common.drop_tables(spark) == 0


def test_batches_are_cut_by_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (5, 100, 1, 1, 200, 0)] + [None]})
    assert [b.num_rows for b in common.row_slices(iter([batch]), "text", 50)] == [1, 1, 2, 1, 2]
    assert list(common.row_slices(iter([batch.slice(0, 0)]), "text")) == []


def test_words_fold_like_ascii(spark):
    from pyspark.sql import functions as F

    texts = ["ABC É", "Kelvin İt", "ß ſ ẞ", "ΑΣ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, got in zip(texts, [r[0] for r in df.select(common.ascii_lower(F.col("t"))).collect()], strict=True):
        plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        assert [w for w in got.split() if w.isascii()] == [w for w in plain.split() if w.isascii()]


def test_native_operators_run_no_python(spark, docs):
    for df in (secrets.scan(docs([(1, "token=abcdefgh1")])), queries.op1_chat(spark, "/root/testdata/sf0.001")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_no_operator_swallows_import_errors_or_uses_local_checkpoints():
    root = pathlib.Path(common.__file__).parent
    for p in [*root.glob("*.py"), root.parent.parent / "corpus_pipeline.py"]:
        tree = ast.parse(p.read_text())
        caught = [ast.unparse(h.type) for h in ast.walk(tree) if isinstance(h, ast.ExceptHandler) and h.type]
        assert not any("ImportError" in c or "ModuleNotFound" in c for c in caught), p
        assert "localCheckpoint" not in p.read_text()
