"""The command line end to end, on small CSV files."""

import base64
import random

from nodeglass.__main__ import REPORTS, main
from nodeglass.streaming.ingest import Sink


def csv_inputs(folder):
    rng = random.Random(11)
    token = lambda n: base64.b64encode(f"SN-{1000 + n % 38}".encode()).decode()
    nodes = [f"{n},Node/2.0 (Linux) {token(n)},{n >= 35}" for n in range(40)]
    logs = []
    for i in range(600):
        node = rng.randrange(40)
        code, ms, load = (429, rng.randint(220, 260), 0.95) if node >= 35 else (200, rng.randint(80, 150), 0.3)
        logs.append(f"{i},{node},OPERATIONAL,{code},{ms},{load if i < 5000 else ''},")
    files = {
        "registry": ["node_uuid,user_agent,is_infected"] + nodes,
        "logs": ["log_id,node_id,json_status,http_response_code,response_time_ms,load_val,L_V1"] + logs,
        "config": ["version,time_start,active_column", "1,0,load_val", "2,5000,L_V1"],
    }
    for name, lines in files.items():
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return {name: str(folder / f"{name}.csv") for name in files}


def test_train_seed_report_ingest_reset(spark, tmp_path, capsys):
    files, at = csv_inputs(tmp_path), lambda name: str(tmp_path / name)
    base = ["--registry", files["registry"], "--logs", files["logs"]]
    main(["train", *base, "--models", at("models"), "--trees", "20", "--rounds", "3"])
    assert "AUC 1.0" in capsys.readouterr().out
    main(["seed", *base, "--config", files["config"], "--root", at("root"), "--models", at("models")])
    assert "'nodes': 40, 'logs': 600" in capsys.readouterr().out
    for name in REPORTS:
        main(["report", name, "--root", at("root"), "--out", at(f"report-{name}")])
        assert spark.read.csv(at(f"report-{name}"), header=True).count() > 0
    spark.read.parquet(at("root/logs")).drop("log_id", "id_folder").write.parquet(at("in"))
    main(["ingest", "--input", at("in"), "--root", at("root"), "--sink", at("sink"), "--checkpoint", at("ck"),
          "--models", at("models"), "--first-id", "600"])
    sink = Sink(at("sink"))
    assert sorted(r["log_id"] for r in sink.read(spark, "logs").collect()) == list(range(600, 1200))
    assert sink.read(spark, "anomalies").count() > 0
    main(["reset", "--registry", files["registry"], "--config", files["config"], "--root", at("root")])
    assert "(40, 2)" in capsys.readouterr().out
