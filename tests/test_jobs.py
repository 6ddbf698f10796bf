"""Whole jobs over small folders."""

from __future__ import annotations

import http.server
import json
import random
import threading
import time
import zlib

import pytest
from foliospark.functions.geometry import png_size
from foliospark.functions.yamlio import valid_page
from foliospark.operators import progress
from foliospark.plans import jobs
from foliospark.schemas import schema
from foliospark.sources import pdf, providers, readers, render
from foliospark.streaming import jobs as streams
from pyspark.sql import functions as F

PAGE = "<html lang=en><body><h1>A heading for the page</h1><p>Some words in a paragraph.</p><footer>Page 1</footer></body></html>"


def test_folder_jobs(spark, tmp_path):
    at = str(tmp_path)
    for d in ("html", "img", "ocr"):
        (tmp_path / d).mkdir()
    for n in (1, 2):
        (tmp_path / "html" / f"doc_page_{n}.html").write_text(PAGE)
        (tmp_path / "ocr" / f"doc_page_{n}.txt").write_text("A heading for the page\nSome words in a paragraph." if n == 1 else "\n")
    (tmp_path / "img" / "doc_page_1.png").write_bytes(b"x")
    counts = {r.type: r["count"] for r in jobs.make_tests(spark, f"{at}/html", f"{at}/tests").collect()}
    assert counts["text_absence"] == 2 and counts["text_presence"] == 4
    done = jobs.evaluate_texts(spark, f"{at}/tests", f"{at}/ocr")
    assert done.where("page = 1 and not passed").count() == 0 and done.where("page = 2 and passed").count() == 1
    jobs.html_to_yaml(spark, f"{at}/html", f"{at}/y")
    (tmp_path / "yaml").mkdir()
    for r in spark.read.text(f"{at}/y", wholetext=True).collect():
        (tmp_path / "yaml" / f"{r.stem}.yaml").write_text(r.value)
    assert jobs.prepare_sft(spark, f"{at}/sft", "T", f"{at}/img", f"{at}/html", f"{at}/yaml") == 2
    assert jobs.prepare_rl(spark, f"{at}/tests", f"{at}/img", f"{at}/rl", "T") == 1
    jobs.yaml_to_html(spark, f"{at}/yaml", f"{at}/back")
    assert "<p>Some words in a paragraph.</p>" in spark.read.text(f"{at}/back", wholetext=True).first().value
    assert jobs.translate(spark, f"{at}/yaml", f"{at}/tr").count() == 0 and readers.read_lines(spark, f"{at}/tr").where("value like '%A heading%'").count() == 2


def counting(folder: str):
    """A provider that leaves a file for each call."""

    def open_provider():
        import uuid
        from pathlib import Path

        stub = providers.Stub()

        def answer(request: dict) -> dict:
            (Path(folder) / uuid.uuid4().hex).write_text("")
            if request["page"] == 3:
                raise ValueError("no")
            return stub(request)

        return answer

    return open_provider


def test_generate_asks_once_and_resumes(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    asked = spark.createDataFrame([("d", k, "a" if k % 2 else None, 800) for k in range(1, 11)], "pdf_name string, page int, anchor string, width int")
    run = lambda: jobs.generate(asked, [asked.where("page = 1")], "T", f"{tmp_path}/answers", counting(str(calls)), at_once=3)
    good, bad = run()
    assert sorted(r.page for r in good.collect()) == [2, 4, 5, 6, 7, 8, 9, 10] and [r.error for r in bad.collect()] == ["no"]
    assert good.where(valid_page(F.col("yaml"))).count() == 8 and len(list(calls.iterdir())) == 9
    good, bad = run()
    assert good.count() == 8 and bad.count() == 1 and len(list(calls.iterdir())) == 10  # only the failed one again
    good, bad = jobs.generate(asked, [], "T", f"{tmp_path}/html", kind="html")
    assert good.count() == 0 and {r.error for r in bad.collect()} == {"no page in the answer"}


def test_run_all(spark, tmp_path):
    asked = spark.createDataFrame([("d", k, "a", 800) for k in (1, 2)], "pdf_name string, page int, anchor string, width int")
    said = lambda: lambda r: {"content": f"```html\n{PAGE}\n```"}
    for _ in range(2):
        steps = {r.step: r.rows for r in jobs.run_all(spark, asked, "T", str(tmp_path), said).collect()}
        assert steps["pages"] == 2 and steps["failed"] == 0 and steps["images"] == 2 and steps["tests"] > 4
    assert spark.read.parquet(f"{tmp_path}/images").count() == 2  # the second run made none
    jobs.with_sidecar(spark.createDataFrame([("d_page_1", "x: 1", 1, "d.pdf")], "stem string, yaml string, page int, source string"), f"{tmp_path}/y")
    assert spark.read.json(f"{tmp_path}/y/sidecars").first().asDict() == {"page": 1, "source": "d.pdf", "stem": "d_page_1"}


def test_providers():
    slept: list[float] = []
    policy = providers.Policy(tries=3, seconds=0.2, base=2, sleep=slept.append)
    answers = iter([(429, ""), (200, '{"error": "busy"}'), (200, '{"choices": [{"message": {"reasoning": "r", "content": "c"}}], "usage": {"total_tokens": 3}}')])
    got = providers.call(lambda r: providers.completion_of(*next(answers)), {}, policy, random.Random(1))
    assert got["answer"] == "rc" and got["attempts"] == 3 and got["total_tokens"] == 3 and len(slept) == 2
    assert providers.call(lambda r: providers.completion_of(404, "gone"), {}, policy, random.Random(1))["error"].startswith("status 404")
    late = providers.call(lambda r: time.sleep(1), {}, providers.Policy(tries=2, seconds=0.05, hung=1, sleep=slept.append), random.Random(1))
    assert late["attempts"] == 2 and late["error"] == "too many calls hang"
    with pytest.raises(providers.CostIncurred):
        providers.call(lambda r: {"cost": 0.1}, {}, policy, random.Random(1))
    assert [providers.stagger(k, random.Random(0)) // 2 for k in (0, 1, 2, 99)] == [0, 1, 2, 15]


def test_endpoint():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = asked["messages"][0]["content"][0]["text"]
            body = b"" if text == "bad" else json.dumps({"choices": [{"message": {"content": text.upper()}}]}).encode()
            self.send_response(503 if text == "bad" else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        ask = providers.Endpoint(f"http://127.0.0.1:{server.server_port}/", "m", "t")
        assert ask({"prompt": "hi", "image_png": b"x"})["content"] == "HI"
        with pytest.raises(providers.Temporary):
            ask({"prompt": "bad"})
    finally:
        server.shutdown()
    with pytest.raises(ConnectionError):
        providers.Endpoint("http://127.0.0.1:1/", "m")({})


def simple_pdf(pages: int) -> bytes:
    body = b"q 100 0 0 50 10 20 cm /Im1 Do Q BT 72 700 Td (Hello \\(you\\)) Tj 0 -20 Td (again) Tj ET"
    packed = zlib.compress(body)
    parts = [b"%PDF-1.4\n", b"1 0 obj <</Type /Pages /Count %d>> endobj\n" % pages]
    for k in range(pages):
        parts.append(b"%d 0 obj <</Type /Page /MediaBox [0 0 600 800] /Contents %d 0 R>> endobj\n" % (2 * k + 2, 2 * k + 3))
        parts.append(b"%d 0 obj <</Filter /FlateDecode>> stream\n" % (2 * k + 3) + packed + b"\nendstream endobj\n")
    return b"".join(parts)


def test_pdf_engine(spark, tmp_path):
    (tmp_path / "HC").mkdir()
    (tmp_path / "HC" / "a.pdf").write_bytes(simple_pdf(3))
    (tmp_path / "HC" / "b.pdf").write_bytes(b"no pdf")
    counts = jobs.count_pages(spark, str(tmp_path))
    assert {tuple(r) for r in counts.collect()} == {("HC", "a", 3, None), ("HC", "b", None, "not a PDF file")}
    files = readers.read_files(spark, str(tmp_path)).where("stem = 'a'")
    page = pdf.page_layouts(files).where("page = 2").first()
    assert [(t.text, t.x, t.y) for t in page.text_elements] == [("Hello (you)", 72, 700), ("again", 72, 680)]
    assert page.mediabox.y1 == 800 and tuple(page.image_elements[0].bbox) == (10, 20, 110, 70)
    image = pdf.page_images(files, 400).first()
    assert (image.width, image.height) == (300, 400)
    size = spark.createDataFrame([(image.png,)], "png binary").select(png_size(F.col("png")).alias("s")).first().s
    assert tuple(size) == (300, 400)
    done = spark.createDataFrame([("a", 1)], "pdf_name string, page int")
    log = spark.createDataFrame([(0, "[2024-01-01 10:00:00] === YAML SESSION START ==="), (1, "[2024-01-01 10:02:00] [DONE ] a page 1 | 5 chars 2.0s")], "line_no long, line string")
    total = {r.folder: r for r in jobs.coverage_report(counts.where("error is null"), done, progress.parse_log(log)).collect()}["TOTAL"]
    assert (total.total, total.done, total.remaining, total.per_minute) == (3, 1, 2, 0.5) and abs(total.hours_left - 4 / 60) < 1e-9


def test_rendering(spark):
    rows = [("a", "<p>", 300, 200), ("b", "", None, None)]
    out = {r.stem: r for r in render.render_pages(spark.createDataFrame(rows, "stem string, html string, width int, height int")).collect()}
    assert out["a"].error is None and out["a"].content[:4] == b"\x89PNG" and out["b"].error == "empty page" and out["b"].width == 1288


def test_streams(spark, tmp_path):
    at = str(tmp_path)
    rows = "pdf_name string, page int, natural_text string"
    expected = spark.createDataFrame([("a", 2), ("b", 1)], "pdf_name string, n_pages int")
    for batch in ([("a", 1, "One."), ("b", 1, "B")], [("a", 2, "Two."), ("a", 1, "One.")]):
        spark.createDataFrame(batch, rows).write.mode("append").parquet(f"{at}/in")
        stream = streams.stream_parquet(spark, f"{at}/in", schema(rows))
        streams.stream_documents(stream, expected, f"{at}/out", f"{at}/checkpoint")
    got = {(r.pdf_name, r.text) for r in spark.read.parquet(f"{at}/out/documents").collect()}
    assert got == {("b", "B"), ("a", "One.\n\nTwo.")}
