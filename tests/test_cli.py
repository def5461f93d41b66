import json

import pytest

from quire import cli, services
from quire.errors import EngineError, ValidationError
from quire.operators import models, providers

from .fixtures import epub, pdf


def test_commands(spark, tmp_path):
    (tmp_path / "sources").mkdir()
    (tmp_path / "sources" / "Book One.epub").write_bytes(epub(["<h1>A</h1><p>x</p>", "<h1>B</h1><p>y</p>"]))
    (tmp_path / "sources" / "bad.pdf").write_bytes(b"nothing")
    run = lambda *a: cli.run(spark, ["--root", str(tmp_path), *a])
    out = run("extract", "--all")
    assert out["documents"] == {"book-one": {"units": 2, "images": 0}} and [f["code"] for f in out["failures"]] == ["malformed-source"]
    (tmp_path / "one.pdf").write_bytes(pdf(["Chapter 1", "Hi."]))
    assert run("extract", "--input", str(tmp_path / "one.pdf"), "--document", "paper")["documents"] == {"paper": {"units": 1, "images": 0}}
    report = json.load(open(tmp_path / "documents/paper/reports/extraction.json"))
    assert report["unitCount"] == 1 and report["source"]["format"] == "pdf" and report["warnings"] == []
    for bad in (["extract"], ["extract", "--all", "--input", "x"]):
        with pytest.raises(ValidationError):
            run(*bad)
    assert run("show", "--document", "book-one", "--unit", "unit-002")["title"] == "B"
    with pytest.raises(EngineError):
        run("show", "--document", "book-one", "--unit", "unit-009")
    assert "index.html" in run("build", "--document", "book-one", "--format", "html")["files"]
    assert run("translate", "--document", "book-one", "--to", "fr", "--dry-run")["units"] == 2
    out = run("translate", "--document", "book-one", "--to", "fr", "--no-cache", "--report", "out.md")
    assert out["translated"] == 2 and out["exit"] == 0 and (tmp_path / "documents/book-one-fr/out.md").exists()
    assert run("delete", "--document", "book-one", "--parts", "1") == {"removed": ["A"], "remaining": 1}
    with pytest.raises(EngineError):
        run("build", "--document", "nope", "--format", "html")


def test_benchmark(spark, tmp_path):
    units = spark.createDataFrame([("unit-001", 1, "A", "chapters/001-a.md", "# A\n\nx"), ("unit-002", 2, "B", "chapters/002-b.md", "y")], "unit_id string, pos int, title string, path string, markdown string")
    rows, summary = services.benchmark(spark, units, ["glm-5.3", "gpt-6-luna"], "fr")
    assert [(r.model, r.units, r.failed) for r in summary.orderBy("model_order").collect()] == [("gpt-6-luna", 2, 0), ("glm-5.3", 2, 0)]
    services.save_benchmark(rows, summary, str(tmp_path))
    assert (tmp_path / "benchmark.md").read_text().count("`glm-5.3`") == 3
    old = services.load_benchmark(spark, str(tmp_path))
    assert {(r.model, r.unit_id, r.markdown, r.path) for r in old.collect()} == {(m, f"unit-00{k}", t, f"benchmark-output/{m}/{f}") for m in ("glm-5.3", "gpt-6-luna") for k, t, f in ((1, "# A\n\nx", "001-a.md"), (2, "y", "002-b.md"))}
    assert all((tmp_path / r.path).read_text() == r.markdown for r in old.collect()) and "- [A](benchmark-output/glm-5.3/001-a.md)" in (tmp_path / "benchmark.md").read_text()
    again, _ = services.benchmark(spark, units.where("pos = 1"), ["glm-5.3"], "fr", previous=old.select(*[c for c in rows.columns if c != "model_order"]))
    assert sorted((r.model, r.unit_id) for r in again.collect()) == [("glm-5.3", "unit-001"), ("gpt-6-luna", "unit-001"), ("gpt-6-luna", "unit-002")]
    # a run of one model leaves the other's answers
    services.save_benchmark(again.where("model = 'glm-5.3'"), summary, str(tmp_path))
    assert sorted((r.model, r.unit_id) for r in services.load_benchmark(spark, str(tmp_path)).collect()) == [("glm-5.3", "unit-001"), ("gpt-6-luna", "unit-001"), ("gpt-6-luna", "unit-002")]
    assert not (tmp_path / "benchmark-output/glm-5.3/002-b.md").exists() and (tmp_path / "benchmark-output/gpt-6-luna/002-b.md").exists()
    assert services.load_benchmark(spark, str(tmp_path / "none")) is None and services.asset_type("a.PNG") == "image/png" and services.asset_type("a.svg") is None


def test_gateway():
    with pytest.raises(EngineError):
        providers.credentials({})
    env, sent = {providers.KEY: "k", providers.URL: "https://gateway.example/v1/"}, []
    answers = {
        "openai": {"output": [{"content": [{"text": "hi"}]}], "usage": {"input_tokens": 5, "input_tokens_details": {"cached_tokens": 2}, "output_tokens": 1}},
        "openai-compatible": {"choices": [{"message": {"content": "hi"}, "finish_reason": "length"}], "usage": {"prompt_tokens": 5, "completion_tokens": 1}},
        "google": {"candidates": [{"content": {"parts": [{"text": "hi"}]}, "finishReason": "STOP"}], "usageMetadata": {"promptTokenCount": 5, "candidatesTokenCount": 1}},
    }
    for model, url, no_cache, reason in (("gpt-6-luna", "/responses", 3, "stop"), ("glm-5.3", "/chat/completions", 5, "length"), ("gemini-3-flash", "/models/gemini-3-flash:generateContent", 5, "stop")):
        entry = models.find(model)
        got = providers.runner(env, lambda u, h, b: sent.append((u, h, b)) or answers[entry["protocol"]])(entry, "s", "u", "m")  # noqa: B023
        assert (got["text"], got["no_cache"], got["finish_reason"]) == ("hi", no_cache, reason) and sent[-1][0] == "https://gateway.example/v1" + url
    assert sent[1][2]["reasoningEffort"] == "low"
    with pytest.raises(ValidationError):
        providers.request({"protocol": "anthropic", "model": "x", "max_output_tokens": 1}, providers.credentials(env), "s", "u")
