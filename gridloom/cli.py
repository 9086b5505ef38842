"""Command line: python -m gridloom.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
import time
from dataclasses import fields

from gridloom import api
from gridloom.operators import layout


def _writer(p: argparse.ArgumentParser) -> None:
    p.add_argument("-b", "--block", type=int, default=512)
    p.add_argument("-c", "--codec", default="deflate")
    p.add_argument("--level", type=int, default=6)
    p.add_argument("--quality", type=int, default=75)
    p.add_argument("--fresh", action="store_true", help="make overviews anew even where the input has them")
    p.add_argument("-r", "--resampling", default="average")
    p.add_argument("-o", "--overviews", type=lambda s: [int(v) for v in s.split(",")], default=None)
    p.add_argument("--no-overviews", dest="overviews", action="store_const", const=[])
    p.add_argument("--no-mask-from-alpha", dest="mask_from_alpha", action="store_false")
    p.add_argument("--black-rgb-transparent", dest="black_rgb", action="store_true")


def _footprint(p: argparse.ArgumentParser) -> None:
    for f in fields(api.FootprintOptions):
        name = "--" + f.name.replace("_", "-")
        if f.name == "window":
            p.add_argument(name, type=lambda s: tuple(int(v) for v in s.split(",")), default=None)
        elif isinstance(f.default, bool):
            p.add_argument(name, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            p.add_argument(name, type=type(f.default) if f.default is not None else float if f.name == "height" else str, default=f.default)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridloom")
    sub = top.add_subparsers(dest="command", required=True)
    for name, outputs in (("info", 0), ("validate", 0), ("footprint", 0), ("cog", 1), ("crop", 1), ("band", 1)):
        p = sub.add_parser(name, aliases=["translate"] if name == "cog" else [])
        p.add_argument("input")
        if outputs:
            p.add_argument("output")
            _writer(p)
    sub.choices["info"].add_argument("--text", action="store_true")
    p = sub.choices["cog"]
    p.add_argument("--json", action="store_true")
    p = sub.choices["crop"]
    p.add_argument("--srcwin", type=int, nargs=4)
    p.add_argument("--projwin", type=float, nargs=4)
    sub.choices["band"].add_argument("-B", "--bands", type=int, action="append", required=True)
    _footprint(sub.choices["footprint"])
    for name in ("batch", "footprint-batch"):
        p = sub.add_parser(name)
        p.add_argument("input")
        p.add_argument("output")
        p.add_argument("--overwrite", action="store_true")
        (_writer if name == "batch" else _footprint)(p)
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    pick = lambda kind: kind(**{f.name: getattr(a, f.name) for f in fields(kind) if hasattr(a, f.name) and f.name != "bands"})
    if a.command == "info":
        found = api.info(a.input)
        print(layout.info_report(found) if a.text else json.dumps(found, indent=1))
    elif a.command == "validate":
        found = api.validate(a.input)
        print(layout.validation_report(a.input, found))
        return int(any(level == "error" for level, _ in found))
    elif a.command == "footprint":
        print(api.footprint(a.input, pick(api.FootprintOptions))["body"])
    elif a.command in ("cog", "translate"):
        began, error = time.time(), None
        try:
            api.convert(a.input, a.output, pick(api.Options))
        except Exception as e:
            if not a.json:
                raise
            error = str(e)
        if a.json:
            print(json.dumps({"input": a.input, "output": a.output, "seconds": time.time() - began, "success": error is None} | ({"error": error} if error else {})))
        return int(error is not None)
    elif a.command == "crop":
        api.crop(a.input, a.output, pixels=a.srcwin and tuple(a.srcwin), coordinates=a.projwin and tuple(a.projwin), options=pick(api.Options))
    elif a.command == "band":
        api.select_bands(a.input, a.output, a.bands, pick(api.Options))
    else:
        import os

        from gridloom.session import get_spark

        spark = get_spark("batch")
        paths = spark.createDataFrame([(os.path.join(a.input, n),) for n in sorted(os.listdir(a.input))], "path string")
        kind = "cog" if a.command == "batch" else "footprint"
        done = api.batch(spark, paths, a.output, kind, pick(api.Options if kind == "cog" else api.FootprintOptions), a.overwrite).collect()
        for r in done:
            print(r.status, r.path, r.error or "")
        return int(any(r.status in ("failed", "collision") for r in done))
    return 0


if __name__ == "__main__":
    sys.exit(main())
