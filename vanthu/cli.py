"""python -m vanthu.cli FOLDER compile|lint|status|load|upload [--store FOLDER] [--limit N] [--all] [--out FOLDER] [--files GLOB]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from vanthu.api import Engine
from vanthu.sources.files import write_pages
from vanthu.sources.store import Store


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="vanthu")
    p.add_argument("folder", help="the folder of tables, or of corpus files for load")
    p.add_argument("command", choices=["compile", "lint", "status", "load", "upload"])
    p.add_argument("--store", help="the folder of a store; its tables are read and changed")
    p.add_argument("--limit", type=int, help="compile so many documents")
    p.add_argument("--all", action="store_true", help="compile documents that have a page again")
    p.add_argument("--out", help="write the compiled pages there")
    p.add_argument("--files", help="the files to upload")
    got = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("vanthu").getOrCreate()
    engine = Engine(spark, got.folder, store=Store(spark, got.store) if got.store else None)
    if got.command == "compile" and got.store:
        print(f"compiled: {engine.compile_stored(limit=got.limit, again=got.all)}")
    elif got.command == "compile":
        pages = engine.compile_wiki()
        write_pages(pages, got.out) if got.out else pages.show()
    elif got.command == "load":
        print(f"loaded: {engine.load(got.folder)}")
    elif got.command == "upload":
        engine.upload(got.files).show(50, truncate=False)
    elif got.command == "lint":
        (engine.lint_stored() if got.store else engine.lint_wiki()).show(50, truncate=False)
    else:
        engine.wiki_status().show(50, truncate=False)


if __name__ == "__main__":
    main()
