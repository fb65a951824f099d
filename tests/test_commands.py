import json

import pytest

from signalspark.__main__ import arguments, main
from signalspark.sources import logs
from signalspark.streaming.detect import read_log, write_batch


def test_commands(spark, tmp_path):
    spark.createDataFrame([(1, "https://a.com/", "<html><title>A title</title></html>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    main(["extract", "--pages", str(tmp_path / "pages"), "--out", str(tmp_path / "signals")])
    assert spark.read.parquet(str(tmp_path / "signals")).first()["signals"]["meta_title"]["value"] == "A title"

    (tmp_path / "seed.json").write_text(json.dumps([{"slug": "a", "name": "A", "segment": "s", "homepage_url": "https://a.com"}]))
    event = {"detected_at": "2024-01-01", "slug": "a", "signal": "headline", "summary": "x"}
    (tmp_path / "events.ndjson").write_text("\n".join(map(json.dumps, [event, event | {"signal": "subhead"}, event | {"record": "retraction", "retracted_at": "2024-01-02", "reason": "wrong"}])) + '\n{"cut')
    (tmp_path / "runs.ndjson").write_text(json.dumps({"run": "r", "results": [{"slug": "a", "kind": "home", "at": "2024-01-01", "status": "ok", "yield": "3/15"}]}) + "\n")
    main(["build", "--seed", str(tmp_path / "seed.json"), "--events", str(tmp_path / "events.ndjson"), "--runs", str(tmp_path / "runs.ndjson"), "--out", str(tmp_path / "api")])
    read = lambda name: json.loads((tmp_path / "api" / f"{name}.json").read_text())
    assert [r["signal"] for r in read("changes")] == ["subhead"] and read("retractions")[0]["reason"] == "wrong" and read("fetches")[0]["found"] == 3

    log = str(tmp_path / "log")
    write_batch(spark.createDataFrame([event], logs.EVENT), log)
    given = ["retract", "--events", log, "--slug", "a", "--signal", "headline", "--detected-at", "2024-01-01", "--reason", "wrong", "--at", "2024-01-03"]
    main([*given, "--dry-run"])
    assert read_log(spark, log).count() == 1
    main(given)
    main(given)
    assert read_log(spark, log).count() == 2
    with pytest.raises(SystemExit):
        arguments(["extract"])
