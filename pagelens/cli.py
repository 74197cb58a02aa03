"""Command line: extract one file, batch a folder, learn site templates."""

from __future__ import annotations

import argparse
import os
import sys


#: Passes that --no-<name> turns off.
SWITCHES = ("front_matter", "tables", "similarity", "prune", "micro", "link_blocks", "rules", "detectors")


def main(argv: list[str] | None = None) -> int:
    """Exit codes: 0 done, 1 some pages had no text (batch), 2 nothing to read, 3 thin input with --fail-on-thin."""
    ap = argparse.ArgumentParser(prog="pagelens")
    sub = ap.add_subparsers(dest="what", required=True)
    one = sub.add_parser("extract")
    one.add_argument("file")
    one.add_argument("--url")
    one.add_argument("--chunks", action="store_true")
    one.add_argument("--json-meta", action="store_true", help="front matter, counts and warnings as JSON on the error stream")
    one.add_argument("--explain", action="store_true", help="each block with its scores and reason on the error stream")
    one.add_argument("--fail-on-thin", action="store_true")
    many = sub.add_parser("batch")
    many.add_argument("folder")
    many.add_argument("-o", "--out", required=True)
    many.add_argument("--no-learn", action="store_true")
    many.add_argument("--chrome-model", help="templates saved before, used in place of learning")
    many.add_argument("--save-chrome", help="where to save the templates that were learned")
    learn = sub.add_parser("learn")
    learn.add_argument("folder")
    learn.add_argument("-o", "--out", required=True)
    learn.add_argument("--min-pages", type=int, default=3)
    for p in (one, many):
        p.add_argument("--priority", choices=("coverage", "balanced", "precision"), default="balanced")
        p.add_argument("--table-format", choices=("markdown", "linear"), default="markdown")
        p.add_argument("--links", action="store_true")
        p.add_argument("--rules", help="a YAML file, or a folder of them, with more rules")
        p.add_argument("--disable", action="append", default=[], help="a rule, a rule's prefix or a detector to leave out")
        p.add_argument("--detect", action="append", default=[], choices=("pager", "related", "micro"), help="a detector that is off unless named")
        for name in SWITCHES:
            p.add_argument(f"--no-{name.replace('_', '-')}", dest=f"no_{name}", action="store_true")
    a = ap.parse_args(argv)
    settings = {} if a.what == "learn" else {"table_format": a.table_format, "links": a.links, **{k: False for k in SWITCHES if getattr(a, f"no_{k}")}}
    if a.what != "learn":
        from .operators.detectors import load_rules

        settings |= {"disabled": tuple(a.disable), "extra": tuple(a.detect), "extra_rules": load_rules(a.rules) if a.rules else ()}
    if a.what == "extract":
        from .config import Config
        from .operators.chunks import chunk
        from .operators.extract import extract

        if not os.path.exists(a.file):
            print("no such file", file=sys.stderr)
            return 2
        import json

        from .sources import decode_bytes

        with open(a.file, "rb") as f:
            x = extract(decode_bytes(f.read()), a.url, Config.of(a.priority, **settings))
        if a.json_meta:
            print(json.dumps({k: x[k] for k in ("title", "root", "n_blocks", "n_kept", "tokens", "warnings")} | {"front_matter": json.loads(x["front_matter"] or "{}")}, ensure_ascii=False), file=sys.stderr)
        if a.explain:
            for b in x["blocks"]:
                print(json.dumps(b, ensure_ascii=False), file=sys.stderr)
        if a.chunks:
            for c in chunk(x["body"], x["title"]):
                print(json.dumps(c | {"url": a.url}, ensure_ascii=False))
        else:
            print(x["markdown"])
        return 3 if a.fail_on_thin and len(x["body"].split()) < 40 else 0
    from pyspark.sql import SparkSession

    from . import sources
    from .operators import extract, template

    spark = SparkSession.builder.appName("pagelens").getOrCreate()
    pages = sources.read_html_dir(spark, a.folder)
    if pages.isEmpty():
        return 2
    numbered = pages.withColumnRenamed("page_id", "name").selectExpr("xxhash64(name) as page_id", "name", "url", "html")
    if a.what == "learn":
        if numbered.count() < 2:
            print("templates need two pages at least", file=sys.stderr)
            return 2
        template.save(template.mine(numbered, least_pages=a.min_pages), a.out)
        return 0
    found = template.load(spark, a.chrome_model) if a.chrome_model else None if a.no_learn else template.mine(numbered)
    if a.save_chrome and found is not None:
        template.save(found, a.save_chrome)
    out = extract.extract_pages(pages, a.priority, templates=found, **settings)
    sources.write_markdown(out, f"{a.out}/markdown")
    sources.write_chunks(out, f"{a.out}/chunks")
    report = sources.summary(out)
    report.write.mode("overwrite").json(f"{a.out}/summary")
    return 1 if report.filter("n_chunks = 0").count() else 0


if __name__ == "__main__":
    sys.exit(main())
