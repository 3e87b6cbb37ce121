"""``spark-submit``-able job: ``python -m gridmill --help``."""

from __future__ import annotations

import argparse
import datetime as dt
from importlib import import_module

from gridmill.plans.climate import (
    COLUMNS,
    DISCOVERY,
    LAYOUTS,
    MODES,
    MONTHLY_FILES,
    run,
    summarize_folder,
)
from gridmill.session import session
from gridmill.sources.files import DECODE_BY, RANGE_BYTES
from gridmill.sources.isolation import Limits


def _years(text: str) -> range:
    first, _, last = text.partition("-")
    return range(int(first), int(last or first) + 1)


def _named(name: str):
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gridmill")
    parser.add_argument("source", help="folder of message files, or of YYYY.csv files")
    parser.add_argument("target", help="folder for the results")
    parser.add_argument("--decoder", help="module:function; without it the source holds CSV files")
    parser.add_argument("--decode-by", choices=DECODE_BY, default="content")
    parser.add_argument("--glob", default="*.grib")
    parser.add_argument("--mode", choices=MODES, default="time")
    parser.add_argument("--variable", action="append", dest="variables", help="repeatable")
    parser.add_argument("--chosen", action="append", help="repeatable; variables of the summary")
    parser.add_argument("--nan-policy", choices=("skip", "propagate"), default="skip")
    parser.add_argument("--naming", choices=("prefix", "suffix"), default="prefix")
    parser.add_argument("--years", type=_years, help="first-last, the years of the summary")
    parser.add_argument("--legacy-first-step", action="store_true")
    parser.add_argument("--stride", type=int, help="variables per time step in position mode")
    parser.add_argument("--same-year", choices=("last", "merge"), help="default: merge by time")
    parser.add_argument("--columns", choices=COLUMNS, default="all")
    parser.add_argument("--layout", choices=LAYOUTS, default="wide")
    parser.add_argument("--monthly-files", choices=MONTHLY_FILES, default="folders")
    parser.add_argument("--at", type=dt.datetime.fromisoformat, help="day and hour of a table of values")
    parser.add_argument("--range-bytes", type=int, default=RANGE_BYTES)
    parser.add_argument("--exclude-prefix", default="summary_data", help="CSV files to leave out")
    parser.add_argument("--key", action="append", dest="keys", type=int, default=[],
                        help="repeatable; field of the description behind the name, from 1")
    parser.add_argument("--discovery", choices=DISCOVERY, default="first_repeat")
    parser.add_argument("--check-steps", action="store_true", help="list the time steps that files lack")
    parser.add_argument("--publish", action="store_true", help="results in a folder of the run, whole or not there")
    parser.add_argument("--message-seconds", type=float, default=600.0, help="time for one message, 0: any")
    parser.add_argument("--file-seconds", type=float, default=0.0, help="time for one file, 0: any")
    parser.add_argument("--in-worker", action="store_true", help="no process of its own for the decoder")
    parser.add_argument("--index", help="folder of the message index; the decoder gets single messages")
    parser.add_argument("--indexer", help="module:function, (offset, length, description) of a file's messages")
    options = parser.parse_args(arguments)
    shared = dict(
        chosen=options.chosen,
        nan_policy=options.nan_policy,
        naming=options.naming,
        years=options.years,
        layout=options.layout,
    )

    spark = session()
    if options.decoder is None:
        outcome = summarize_folder(
            spark, options.source, options.target, options.variables,
            exclude_prefix=options.exclude_prefix, **shared
        )
    else:
        outcome = run(
            spark,
            options.source,
            options.target,
            _named(options.decoder),
            variables=options.variables,
            mode=options.mode,
            glob=options.glob,
            decode_by=options.decode_by,
            legacy_first_step=options.legacy_first_step,
            stride=options.stride,
            same_year=options.same_year,
            columns=options.columns,
            monthly_files=options.monthly_files,
            at=options.at,
            range_bytes=options.range_bytes,
            keys=options.keys,
            discovery=options.discovery,
            check_steps=options.check_steps,
            publish=options.publish,
            limits=None if options.in_worker
            else Limits(options.message_seconds or None, options.file_seconds or None),
            index=options.index,
            indexer=options.indexer and _named(options.indexer),
            **shared,
        )
    for variable in outcome.lacking:
        print(f"no data for variable: {variable}")
    outcome.release()


if __name__ == "__main__":
    main()
