"""Command line: python -m foliospark JOB ..."""

from __future__ import annotations

import argparse
import functools
from pathlib import Path

from .plans import jobs
from .session import get_session
from .sources import providers

#: What is asked for a page where no template is given.
TEMPLATES = {"yaml": "Read the page and answer in YAML.", "html": "Rebuild the page as one HTML document and answer with it alone, in a fenced html block."}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="foliospark")
    sub = p.add_subparsers(dest="job", required=True)
    for name, takes in {
        "make-tests": ("html", "out"), "evaluate": ("tests", "texts"), "sft": ("images", "out", "--html", "--yaml"), "rl": ("tests", "images", "out"),
        "html-to-yaml": ("html", "out"), "yaml-to-html": ("yaml", "out"), "translate": ("yaml", "out"), "linearize": ("results", "out"), "log": ("log",),
        "count-pages": ("pdfs", "out"), "sample": ("counts", "target", "out"), "balance": ("counts", "cap", "out"), "coverage": ("counts", "done", "--log"),
        "generate": ("requests", "out", "--url", "--model", "--token", "--template", "--kind", "--batch"), "run-all": ("requests", "out", "--url", "--model", "--token", "--template", "--batch"), "render": ("html", "out"),
    }.items():
        job = sub.add_parser(name)
        for x in takes:
            job.add_argument(x)
    a = p.parse_args(args)
    spark = get_session("*")
    if a.job == "make-tests":
        jobs.make_tests(spark, a.html, a.out).show()
    elif a.job == "evaluate":
        done = jobs.evaluate_texts(spark, a.tests, a.texts)
        jobs.evaluate.by_type(done).show()
        jobs.evaluate.failures(done).select("id", "type", "error").show(truncate=False)
    elif a.job == "sft":
        print(jobs.prepare_sft(spark, a.out, TEMPLATES["yaml"], a.images, a.html, a.yaml), "examples")
    elif a.job == "rl":
        print(jobs.prepare_rl(spark, a.tests, a.images, a.out, TEMPLATES["yaml"]), "examples")
    elif a.job == "html-to-yaml":
        jobs.html_to_yaml(spark, a.html, a.out)
    elif a.job == "yaml-to-html":
        jobs.yaml_to_html(spark, a.yaml, a.out)
    elif a.job == "translate":
        jobs.translate(spark, a.yaml, a.out).show(truncate=False)
    elif a.job == "linearize":
        jobs.linearize(spark, a.results, a.out)
    elif a.job == "count-pages":
        jobs.count_pages(spark, a.pdfs).write.parquet(a.out)
    elif a.job == "sample":
        jobs.sample_documents(spark.read.parquet(a.counts), int(a.target)).write.parquet(a.out)
    elif a.job == "balance":
        counts = spark.read.parquet(a.counts)
        caps = {r[0]: int(a.cap) for r in counts.select("folder").distinct().collect()}
        jobs.sampling.balanced(counts, caps, "folder", "pdf_name").write.parquet(a.out)
    elif a.job == "coverage":
        log = jobs.progress.parse_log(jobs.readers.read_log(spark, a.log)) if a.log else None
        jobs.coverage_report(spark.read.parquet(a.counts), spark.read.parquet(a.done), log).show(truncate=False)
    elif a.job in ("generate", "run-all"):
        requests = spark.read.parquet(a.requests)
        source = functools.partial(providers.Endpoint, a.url, a.model, a.token or "") if a.url else providers.Stub
        kind = "html" if a.job == "run-all" else a.kind or "yaml"
        template = Path(a.template).read_text() if a.template else TEMPLATES[kind]
        policy, batch = providers.Policy(staggered=bool(a.url)), int(a.batch or 64)
        if a.job == "generate":
            good, bad = jobs.generate(requests, [], template, f"{a.out}/answers", source, policy, kind, batch=batch)
            jobs.keep_pages(good, bad, a.out, kind)
            print(good.count(), "pages,", bad.count(), "failed")
        else:
            jobs.run_all(spark, requests, template, a.out, source, policy=policy, batch=batch).show()
    elif a.job == "render":
        pages = jobs.readers.read_html(spark, a.html).selectExpr("stem", "html", "cast(null as int) width", "cast(null as int) height")
        jobs.render.render_manifest(jobs.render.render_pages(pages), a.out).groupBy("error").count().show()
    else:
        jobs.log_report(spark, a.log).show(truncate=False)


if __name__ == "__main__":
    main()
