import json

from pyspark.sql import functions as F

from millrace.operators import logs
from millrace.sources import tables

METRICS = "step long, phase string, loss double, accuracy double, learning_rate double"


def metric_table(spark):
    return spark.createDataFrame(
        [(1, "train", 2.5, 0.25, 0.0004), (2, "val", float("nan"), 0.5, None)], METRICS
    )


def test_append_keeps_columns_apart(spark, tmp_path):
    path = str(tmp_path / "log")
    table = metric_table(spark)
    tables.append_metrics(table.where("phase = 'train'"), path)
    tables.append_metrics(table.where("phase = 'val'").drop("learning_rate"), path)
    got = {r.step: r for r in tables.read_metrics(spark, path).collect()}
    assert got[1].learning_rate == 0.0004 and got[1].grad_norm is None
    assert got[2].accuracy == 0.5 and got[2].learning_rate is None


def test_truncate(spark):
    table = metric_table(spark)
    assert logs.truncate_for_resume(table, 1).count() == 1
    assert logs.truncate_for_resume(table, 0).count() == 2


def test_points(spark):
    points = logs.metrics_long(metric_table(spark).where("step = 1"))
    assert sorted((r.tag, r.value, r.step) for r in points.collect()) == [
        ("train/accuracy", 0.25, 1), ("train/learning_rate", 0.0004, 1), ("train/loss", 2.5, 1),
    ]
    assert logs.metrics_long(metric_table(spark), purge_step=2).where("step = 2").count() == 0
    bare = metric_table(spark).withColumn("phase", F.lit(""))
    assert logs.metrics_long(bare, ("loss",)).first().tag == "loss"


def test_lines(spark):
    lines = {r.step: r.line for r in logs.metric_lines(metric_table(spark), "pretrain").collect()}
    assert lines[1] == (
        "[PRETRAIN:TRAIN] Step 1 | loss: 2.50000 | accuracy: 0.25000 | learning_rate: 0.00040"
    )
    assert lines[2] == "[PRETRAIN:VAL] Step 2 | loss: nan | accuracy: 0.50000"


def test_fan_out_reaches_every_sink(spark):
    seen = []
    logs.fan_out(metric_table(spark), [lambda df: seen.append(df.count())] * 3)
    assert seen == [2, 2, 2]


def result_tables(spark, rows):
    prompts = [(s, i, *p) for s, listed, _ in rows for i, p in enumerate(listed)]
    metrics = [(s, m, m, m) for s, _, m in rows]
    return (
        spark.createDataFrame(
            prompts, "step string, prompt_id int, input string, output string, diversity double"
        ),
        spark.createDataFrame(
            metrics,
            "step string, avg_diversity double, avg_lexical_validity double, self_bleu double",
        ),
    )


def test_results_by_step(spark):
    old = result_tables(spark, [("100", [("p", "o1", 0.5), ("p", "later", 0.1)], 0.1), ("20", [], 0.2)])
    new = result_tables(spark, [("100", [("p", "new", 0.7)], 0.9), ("3", [("q", "x", 0.3)], 0.4)])
    prompts, metrics = (logs.upsert_results(a, b) for a, b in zip(old, new))
    series = [(r.step, r.self_bleu) for r in logs.metric_series(metrics).collect()]
    assert series == [(3, 0.4), (20, 0.2), (100, 0.9)]
    rows = logs.prompt_history(prompts, metrics, "p").collect()
    history = {r.step: (r.found, r.output, r.diversity) for r in rows}
    assert history == {3: (False, None, None), 20: (False, None, None), 100: (True, "new", 0.7)}
    assert logs.prompt_history(*old, "p").where("step = 100").first().output == "o1"


def test_stored_results(spark, tmp_path):
    prompt = {"input": "p", "output": "o", "diversity": 0.5, "lexical_validity": 1.0}
    summary = {"avg_diversity": 0.5, "avg_lexical_validity": 1.0, "self_bleu": 0.25}
    stored = {"20": {"prompts": [prompt, prompt], "metrics": summary}, "100": {"prompts": [], "metrics": summary}}
    (tmp_path / "results.json").write_text(json.dumps(stored, indent=4))
    prompts, metrics = tables.read_results(spark, str(tmp_path / "results.json"))
    assert sorted(tuple(r) for r in prompts.collect()) == [(20, i, "p", "o", 0.5, 1.0) for i in (0, 1)]
    assert sorted(tuple(r) for r in metrics.collect()) == [(20, 0.5, 1.0, 0.25), (100, 0.5, 1.0, 0.25)]
    assert logs.prompt_history(prompts, metrics, "p").count() == 2


def test_latest_checkpoint(spark, tmp_path):
    names = {
        "pretrain": ["epoch0_step900.pth", "epoch1_step5.pth", "epoch1_step40.pth", "x_epoch9_step9.pth"],
        "finetune": ["notes.txt"],
        "other": ["epoch2_step1.pth.bak", "epoch1_step99.pth"],
    }
    for task, files in names.items():
        (tmp_path / task).mkdir()
        for name in files:
            (tmp_path / task / name).write_bytes(b"x")
    files = logs.list_checkpoints(spark, str(tmp_path), [*names, "absent"])
    got = {r.task: r.file for r in logs.latest_checkpoint(files).collect()}
    assert got == {"pretrain": "epoch1_step40.pth", "finetune": None, "other": "epoch2_step1.pth.bak"}
