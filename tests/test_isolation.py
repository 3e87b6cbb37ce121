"""Decoders that crash, hang or never end cost their own file and nothing else."""

import os
import signal
import sys
import time

import numpy as np
import pytest
from pyspark import cloudpickle

from gridmill.plans import run
from gridmill.sources import Limits, decode_files, scan_files, split_decoded
from gridmill.sources.isolation import Failure, isolated
from helpers import rows

# Workers get what is defined here by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINE = "1:a:surface:from 200001010000|{}"


def decode_text(text):
    for line in text.splitlines():
        if line == "exit":
            os._exit(3)
        if line == "killed":
            os.kill(os.getpid(), signal.SIGKILL)
        if line == "hang":
            time.sleep(600)
        if line == "endless":
            while True:
                yield "1:a:surface:from 200001010000", [1.0]
        description, value = line.split("|")
        yield description, [float(value)]


def content_decoder(content):
    yield from decode_text(bytes(content).decode())


def path_decoder(path):
    with open(path) as file:
        yield from decode_text(file.read())


def range_decoder(path, start, end):
    with open(path) as file:
        for i, message in enumerate(decode_text(file.read())):
            if not start:
                yield i, *message


FILES = {
    "good1.txt": [LINE.format(1), LINE.format(3)],
    "exit.txt": [LINE.format(5), "exit"],
    "good2.txt": [LINE.format(7)],
    "killed.txt": ["killed"],
    "hang.txt": [LINE.format(9), "hang"],
    "raises.txt": ["junk"],
    "good3.txt": [LINE.format(11)] * 5,
}
REASONS = {
    "exit.txt": "DecoderCrash: process ended with exit code 3",
    "killed.txt": "DecoderCrash: process ended by SIGKILL",
    "hang.txt": "DecoderTimeout: no message for 1 s",
    "raises.txt": "ValueError: not enough values to unpack (expected 2, got 1)",
}


@pytest.fixture
def folder(tmp_path):
    for name, lines in FILES.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    return str(tmp_path)


@pytest.mark.parametrize("by", ["content", "path", "range"])
def test_each_bad_file_is_one_row(spark, folder, by):
    decoder = {"content": content_decoder, "path": path_decoder, "range": range_decoder}[by]
    files = scan_files(spark, folder, "*.txt")
    decoded = decode_files(files, decoder, by, limits=Limits(1.0))
    good, bad = split_decoded(decoded, files, by)
    assert {r["file"].rsplit("/", 1)[1]: r["error"] for r in bad.collect()} == REASONS and bad.count() == 4
    found = sorted((r["file"].rsplit("/", 1)[1], r["grid_mean"]) for r in good.collect())
    assert found == [("good1.txt", 1.0), ("good1.txt", 3.0), ("good2.txt", 7.0)] + [("good3.txt", 11.0)] * 5


def test_whole_job_goes_on(spark, folder, tmp_path):
    target = str(tmp_path / "out")
    outcome = run(spark, folder, target, content_decoder, glob="*.txt", limits=Limits(1.0))
    assert {r["file"].rsplit("/", 1)[1] for r in outcome.bad_files.collect()} == set(REASONS)
    values = [r["value"] for r in outcome.monthly.where("month = 1").collect()]
    assert values == [(1 + 3 + 7 + 5 * 11) / 8]
    outcome.release()


def test_time_for_a_file(spark, tmp_path):
    (tmp_path / "endless.txt").write_text("endless\n")
    (tmp_path / "good.txt").write_text(LINE.format(2) + "\n")
    files = scan_files(spark, str(tmp_path), "*.txt")
    decoded = decode_files(files, path_decoder, "path", limits=Limits(5.0, 0.5))
    good, bad = split_decoded(decoded, files, "path")
    assert [r["error"] for r in bad.collect()] == ["DecoderTimeout: file took over 0.5 s"]
    assert [r["grid_mean"] for r in good.collect()] == [2.0]


def test_grids_and_same_rows_as_in_the_worker(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"{i}.txt").write_text("".join(LINE.format(i * 100 + k) + "\n" for k in range(i)) or "junk")
    files = scan_files(spark, str(tmp_path), "*.txt")
    for keep in (False, True):
        here = decode_files(files, content_decoder, keep_values=keep)
        there = decode_files(files, content_decoder, keep_values=keep, limits=Limits())
        assert rows(here) == rows(there) and there.count() > 100


def test_large_parts_and_order():
    def work(file, met):
        for i in range(3):
            met()
            yield file, i, np.full(400_000, file + i)
        if file == 1:
            os._exit(0)

    got = list(isolated(work, 3, Limits()))
    parts = [(p[0], p[1], int(p[2].sum())) for p in got if not isinstance(p, Failure)]
    assert parts == [(f, i, 400_000 * (f + i)) for f in range(3) for i in range(3)]
    # Even an exit that looks fine is none before the end of the file.
    assert [(p.file, p.reason) for p in got if isinstance(p, Failure)] == [
        (1, "DecoderCrash: process ended with exit code 0")
    ]


def test_no_child_is_left(monkeypatch):
    def work(file, met):
        while True:
            met()
            yield file

    pids = []
    real = os.fork

    def fork():
        pids.append(real())
        return pids[-1]

    monkeypatch.setattr(os, "fork", fork)
    parts = isolated(work, 2, Limits())
    assert [next(parts) for _ in range(5)] == [0] * 5
    parts.close()
    with pytest.raises(ProcessLookupError):
        os.kill(pids[0], 0)
    assert list(isolated(work, 0, Limits())) == []
