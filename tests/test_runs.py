"""Runs of outside calls: what is kept when a run dies, what stops it, the command line."""

from __future__ import annotations

import http.server
import json
import os
import subprocess
import sys
import threading
import uuid
from pathlib import Path

import pytest
from foliospark import __main__ as command
from foliospark.plans import jobs
from foliospark.sources import providers, sinks

PAGE = "<html lang=en><body><h1>A heading for the page</h1><p>Some words in a paragraph.</p><footer>Page 1</footer></body></html>"
REQUEST = "pdf_name string, page int, anchor string, width int"


def recording(folder: str, kill_at: int = 0, paid: tuple[int, ...] = ()):
    """A provider that leaves a file named after each page asked for; it ends its process at the kill_at-th call while
    there is no file `spared`, and has a price for the pages of `paid`."""

    def open_provider():
        stub, at = providers.Stub(), Path(folder)

        def answer(request: dict) -> dict:
            (at / f"{request['page']}-{uuid.uuid4().hex}").write_text("")
            if kill_at and len(list(at.iterdir())) >= kill_at and not (at / "spared").exists():
                os._exit(1)
            return stub(request) | ({"cost": 0.5} if request["page"] in paid else {})

        return answer

    return open_provider


def asked(folder: Path) -> list[int]:
    return sorted(int(p.name.split("-")[0]) for p in folder.iterdir() if "-" in p.name)


def test_a_killed_run_keeps_its_batches(spark, tmp_path):
    calls, out, batch = tmp_path / "calls", f"{tmp_path}/answers", 4
    calls.mkdir()
    rows = spark.createDataFrame([("d", k, "a", 800) for k in range(1, 31)], REQUEST)
    run = lambda: jobs.generate(rows, [], "T", out, recording(str(calls), kill_at=18), partitions=2, at_once=1, batch=batch)
    with pytest.raises(Exception):  # noqa: B017  a dead worker, in local mode, ends the query
        run()
    before = asked(calls)
    kept = {r.page for r in spark.read.parquet(out).select("page").collect()}
    assert len(before) - len(kept) <= batch and len(kept) >= 12 and len(before) == len(set(before))
    (calls / "spared").write_text("")
    good, bad = run()
    assert good.count() == 30 and bad.count() == 0
    twice = [p for p in set(asked(calls)) if asked(calls).count(p) > 1]
    assert len(twice) <= batch and not kept & set(twice)


def test_a_price_stops_the_run(spark, tmp_path):
    calls, out = tmp_path / "calls", f"{tmp_path}/answers"
    calls.mkdir()
    rows = spark.createDataFrame([("d", k, "a", 800) for k in range(1, 41)], REQUEST)
    with pytest.raises(providers.CostIncurred, match=r"cost 0\.5"):
        jobs.generate(rows, [], "T", out, recording(str(calls), paid=tuple(range(1, 41))), partitions=1, at_once=1, batch=8)
    assert len(asked(calls)) == 1  # the first call had a price
    said = {r.error: r.n for r in spark.read.parquet(out).groupBy("error").agg({"*": "count"}).toDF("error", "n").collect()}
    assert said == {"a call cost 0.5": 1, providers.NOT_ASKED: 7}  # of the batch under way; others weren't begun
    good, bad = jobs.generate(rows, [], "T", out, recording(str(calls)), partitions=3)
    assert good.count() == 40 and bad.count() == 0 and len(asked(calls)) == 41


CLUSTER = """
import sys
sys.path.insert(0, {root!r})
from foliospark.session import get_session
from foliospark.plans import jobs
from foliospark.sources import providers
from tests.test_runs import REQUEST, recording
spark = get_session(2, "failures", **{{"spark.master": "local[2,4]", "spark.task.maxFailures": "4", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1"}})
rows = spark.createDataFrame([("d", k, "a", 800) for k in range(1, 21)], REQUEST)
try:
    jobs.generate(rows, [], "T", {out!r}, recording({calls!r}, paid=(5,)), partitions=1, at_once=1, batch=20)
except providers.CostIncurred as e:
    print("stopped:", e)
print("kept", spark.read.parquet({out!r}).where("error is null").count(), "of", spark.read.parquet({out!r}).count())
"""


def test_a_price_is_paid_once_where_tasks_are_repeated(tmp_path):
    """In a session that repeats failed tasks, one call has a price and what was answered before it is kept."""
    calls, root = tmp_path / "calls", str(Path(__file__).parent.parent)
    calls.mkdir()
    code = CLUSTER.format(root=root, out=f"{tmp_path}/answers", calls=str(calls))
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": root}).stdout
    assert "stopped: a call cost 0.5" in said
    pages = asked(calls)
    assert pages.count(5) == 1 and len(pages) == len(set(pages)) and f"kept {len(pages) - 1} of 20" in said


def test_flag_of_strangers_and_lost_drivers(spark):
    with providers.RunFlag(spark) as run:
        assert run.flag.up()
        providers.Flag(run.flag.host, run.flag.port, "guess").stop("no")
        assert run.flag.up() and not providers.Flag(run.flag.host, run.flag.port, "guess").up()
        run.flag.stop("said\nso")
        assert not run.flag.up() and run.why == "said so"
    assert not run.flag.up()


def test_run_all_from_the_command_line(spark, tmp_path, monkeypatch):
    """Against a service that does what the prompt says: HTML for who asks for HTML, else YAML."""

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"][0]["text"]
            text = f"```html\n{PAGE}\n```" if "HTML" in prompt else providers.Stub()({"text": "A page."})["content"]
            body = json.dumps({"choices": [{"message": {"content": text}}], "usage": {"total_tokens": 7, "cost": 0}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setattr(command, "get_session", lambda *_: spark)
    monkeypatch.setattr(providers.Policy, "staggered", False)
    url = ["--url", f"http://127.0.0.1:{server.server_port}/", "--model", "m"]
    try:
        spark.createDataFrame([("d", k, "a", 800) for k in range(1, 5)], REQUEST).write.parquet(f"{tmp_path}/requests")
        for _ in range(2):
            command.main(["run-all", f"{tmp_path}/requests", f"{tmp_path}/all", *url])
        at = tmp_path / "all"
        assert spark.read.parquet(f"{at}/images").where("error is null").count() == 4
        assert spark.read.parquet(f"{at}/images").where("height = 1131 and width = 800").count() == 4
        assert spark.read.text(f"{at}/tests").count() > 8
        sidecars = spark.read.json(f"{at}/sidecars")
        assert sidecars.count() == 4 and {(r.page, r.source, r.width, r.height) for r in sidecars.collect()} == {(k, "d.pdf", 800, 1131) for k in range(1, 5)}
        command.main(["generate", f"{tmp_path}/requests", f"{tmp_path}/yaml", *url])
        assert spark.read.text(f"{tmp_path}/yaml/pages", wholetext=True).where("value like '%A page.%'").count() == 4
        (tmp_path / "template").write_text("Say it in HTML.")
        command.main(["generate", f"{tmp_path}/requests", f"{tmp_path}/html", *url, "--kind", "html", "--template", f"{tmp_path}/template"])
        assert spark.read.text(f"{tmp_path}/html/pages", wholetext=True).where("value like '%heading%'").count() == 4
        command.main(["generate", f"{tmp_path}/requests", f"{tmp_path}/none", *url, "--kind", "html", "--template", "/dev/null"])
        assert spark.read.option("sep", "\t").csv(f"{tmp_path}/none/failed").count() == 4
    finally:
        server.shutdown()


def test_paths(spark, tmp_path):
    assert not sinks.exists(spark, f"{tmp_path}/none") and sinks.exists(spark, str(tmp_path))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("no parquet")
    rows = spark.createDataFrame([("d", 1, "a", 800)], REQUEST)
    with pytest.raises(Exception):  # noqa: B017  what can't be read isn't taken for nothing
        jobs.generate(rows, [], "T", f"{tmp_path}/broken")
