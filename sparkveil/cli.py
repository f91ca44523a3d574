"""Command line: detect, report and redact one text."""

from __future__ import annotations

import argparse
import sys

from . import __version__
from .operators.detectors import BY_NAME


def parse_detectors(names: str | None):
    """None keeps the defaults; ``none`` or ``empty`` is no detector; names replace the defaults."""
    if names is None:
        return None
    out = []
    for name in filter(None, (x.strip() for x in names.split(","))):
        if name.lower() in ("none", "empty"):
            continue
        if name.lower() not in BY_NAME:
            raise ValueError(f"unknown detector '{name}'; known are national_id, mobile, iban, email, bank_card, none")
        out.append(BY_NAME[name.lower()])
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkveil", description="Detect, report and redact personal data in a text.")
    top.add_argument("-V", "--version", action="version", version=f"%(prog)s {__version__}")
    sub = top.add_subparsers(dest="command", required=True, metavar="<command>")
    for name, text in (("detect", "types and offsets as JSON"), ("report", "a value-free summary as JSON"), ("redact", "the text with placeholders")):
        p = sub.add_parser(name, help=text)
        p.add_argument("input", nargs="?", default="-", help="file, or - for standard input")
        p.add_argument("-o", "--output", default="-", help="file, or - for standard output")
        p.add_argument("-d", "--detectors", default=None, help="names between commas; they replace the defaults")
        if name == "redact":
            p.add_argument("-c", "--conflict-policy", default="reject", choices=("reject", "longest", "priority"))
            p.add_argument("-p", "--type-priority", default=None, help="types between commas, highest first")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        from pyspark.sql import SparkSession

        from .operators import redaction
        from .operators.detectors import detect
        from .sources.files import dumps, read_text, write_text

        detectors, text = parse_detectors(args.detectors), read_text(args.input)
        priority = [x.strip() for x in args.type_priority.split(",") if x.strip()] if getattr(args, "type_priority", None) else None
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
        spark.sparkContext.setLogLevel("OFF")
        df = spark.createDataFrame([(text,)], "text string")
        if args.command == "detect":
            out = dumps([{"type": x["type"], "start": x["start"], "end": x["end"]} for x in detect(df, "text", detectors).first()["detections"]])
        elif args.command == "report":
            out = dumps(redaction.report_column(df, "text", detectors).first()["report"].asDict())
        else:
            row = redaction.redact(df, "text", detectors, args.conflict_policy, priority, on_error="record").first()
            if row["error"]:
                raise ValueError(row["error"])
            out = row["redacted"]
        write_text(out, args.output, args.input)
    except Exception as e:
        what = "the input is not UTF-8" if isinstance(e, UnicodeDecodeError) else str(e).splitlines()[0] if str(e) else type(e).__name__
        print(f"error: {what}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
