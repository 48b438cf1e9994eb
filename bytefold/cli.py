"""Command line: read inputs, then print or save sources, listings, JSON or renames."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bytefold", description="Sources, listings and tables of compiled code.")
    p.add_argument("inputs", nargs="+", help="class files, archives, dex files or directories")
    p.add_argument("-o", "--output-dir", help="save sources here instead of printing them")
    p.add_argument("--filter", action="append", default=[], metavar="PATTERN", help="only classes like p.C or p.*")
    p.add_argument("--rename-shorter-than", type=int, default=0, metavar="N", help="give shorter names aliases")
    p.add_argument("--renames", action="append", default=[], metavar="PATH", help="read a rename map")
    p.add_argument("--save-renames", metavar="PATH", help="write all renames and comments as a map")
    p.add_argument("--escape-unicode", action=argparse.BooleanOptionalAction, default=True, help="print characters beyond ASCII as escapes")
    p.add_argument("--hex", action="store_true", help="print integers in hexadecimal")
    p.add_argument("--no-imports", action="store_true", help="print classes by their whole names")
    p.add_argument("--no-debug-info", action="store_true", help="do not use the names of locals")
    p.add_argument("--print-lines", action="store_true", help="print line numbers as comments")
    p.add_argument("-v", "--verbose", action="store_true", help="tell progress on standard error")
    what = p.add_mutually_exclusive_group()
    what.add_argument("--json", action="store_true", help="print JSON, one class a line")
    what.add_argument("--disasm", action="store_true", help="print listings")
    return p


def main(args: list[str] | None = None) -> int:
    """0, or 1 if nothing but errors came out."""
    from pyspark.sql import SparkSession

    from .engine import Engine, percent

    given = parser().parse_args(args)
    options = {"class_filter": given.filter, "rename_shorter_than": given.rename_shorter_than, "escape_unicode": given.escape_unicode, "integer_format": "hex" if given.hex else "decimal"}
    engine = Engine(SparkSession.builder.getOrCreate(), **options, use_imports=not given.no_imports, debug_names=not given.no_debug_info, line_numbers=given.print_lines)
    if given.verbose:
        engine.on_log(lambda message: print(message, file=sys.stderr))
        engine.on_progress(lambda done, total, name: print(f"{percent(done, total):3d} % {name}", file=sys.stderr))
    for path in given.inputs:
        engine.add_path(path)
    for path in given.renames:
        engine.load_map(path)
    if given.save_renames:
        engine.save_map(given.save_renames)
    if given.output_dir:
        engine.save(given.output_dir)
    elif given.json or given.disasm:
        rows = engine.to_json().select("json") if given.json else engine.listings.select("listing").filter("listing is not null")
        for row in rows.toLocalIterator():
            print(row[0])
    else:
        for row in engine.sources.filter("error is null").orderBy("class_name").select("text").toLocalIterator():
            print(row[0])
    bad = engine.errors.limit(100).collect()
    for row in bad:
        print(f"{row['stage']}: {row['message']}", file=sys.stderr)
    return int(bool(bad) and engine.classes.isEmpty())


if __name__ == "__main__":
    sys.exit(main())
