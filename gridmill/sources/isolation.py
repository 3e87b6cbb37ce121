"""A decoder in a process of its own, so that a crash or an endless loop costs one file.

A codec of binary grids is native code: where it fails it may end its process, which no ``except``
sees, and the same file would end each retry of the task and with it the job. Here the Python
worker forks a child that decodes one file after the other. The child shares the worker's memory,
so the bytes of a file are not copied; what it decodes comes back through a pipe. If the child ends
or falls silent, its file is reported and a new child goes on with the next file.
"""

from __future__ import annotations

import ctypes
import mmap
import os
import pickle
import select
import signal
import struct
import time
import warnings
from collections.abc import Callable, Iterator
from typing import Any

#: Length of a frame, its kind, and the number of its file.
_HEAD = "<QcI"
_HEAD_BYTES = struct.calcsize(_HEAD)
_DATA, _DONE = b"d", b"e"
_READ_BYTES = 1 << 20
#: Seconds between looks at a child that sends nothing.
_GLANCE = 0.05
_DEATH_SIGNAL = 1


class Limits:
    """Seconds that a decoder may take for one message, and for one file (None: any)."""

    def __init__(self, message_seconds: float | None = 600.0, file_seconds: float | None = None):
        self.message_seconds, self.file_seconds = message_seconds, file_seconds


class Failure:
    """A file that did not come to its end, and why."""

    def __init__(self, file: int, reason: str):
        self.file, self.reason = file, reason


def _ended(status: int) -> str:
    if os.WIFSIGNALED(status):
        number = os.WTERMSIG(status)
        try:
            return f"DecoderCrash: process ended by {signal.Signals(number).name}"
        except ValueError:
            return f"DecoderCrash: process ended by signal {number}"
    return f"DecoderCrash: process ended with exit code {os.WEXITSTATUS(status)}"


class _Child:
    """One forked process that works on the files from ``first`` on."""

    def __init__(self, work: Callable[[int, Callable[[], None]], Iterator[Any]], first: int, count: int):
        # Messages of the file in hand, and its number, where the parent can see them.
        self.shared = mmap.mmap(-1, 16)
        self.shared[:] = struct.pack("<QQ", 0, first)
        self.pipe, out = os.pipe()
        parent = os.getpid()
        with warnings.catch_warnings():
            # The threads of the worker's libraries stay behind; the child doesn't use them.
            warnings.simplefilter("ignore", DeprecationWarning)
            self.pid = os.fork()
        if self.pid:
            os.close(out)
            return
        code = 70
        try:
            os.close(self.pipe)
            _die_with(parent)
            self._decode(work, first, count, out)
            code = 0
        except BrokenPipeError:
            pass
        finally:
            # Nothing of the worker's own ending may run here.
            os._exit(code)

    def _decode(self, work, first: int, count: int, out: int) -> None:
        for file in range(first, count):
            messages = 0
            self.shared[:] = struct.pack("<QQ", 0, file)

            def met() -> None:
                nonlocal messages
                messages += 1
                self.shared[:8] = struct.pack("<Q", messages)

            for part in work(file, met):
                data = pickle.dumps(part, protocol=5)
                _write(out, struct.pack(_HEAD, len(data), _DATA, file) + data)
            _write(out, struct.pack(_HEAD, 0, _DONE, file))

    def progress(self) -> tuple[int, int]:
        return struct.unpack("<QQ", self.shared[:])

    def kill(self) -> int:
        """End the process, if it still runs; its status."""
        if self.pid:
            os.kill(self.pid, signal.SIGKILL)
        return self.wait()

    def wait(self) -> int:
        if self.pid:
            _, self.status = os.waitpid(self.pid, 0)
            self.pid = 0
            os.close(self.pipe)
            self.shared.close()
        return self.status


def _write(out: int, data: bytes) -> None:
    view = memoryview(data)
    while view:
        view = view[os.write(out, view) :]


def _die_with(parent: int) -> None:
    """The child of a worker that is killed must not go on alone (Linux; elsewhere it ends when it
    next writes)."""
    try:
        ctypes.CDLL(None).prctl(_DEATH_SIGNAL, signal.SIGKILL)
    except (AttributeError, OSError):
        return
    if os.getppid() != parent:
        os._exit(70)


def isolated(
    work: Callable[[int, Callable[[], None]], Iterator[Any]], count: int, limits: Limits
) -> Iterator[Any]:
    """What ``work(file, met)`` yields for the files 0 to ``count - 1``, each in turn, and a
    ``Failure`` for each file whose process ended or took too long. ``work`` calls ``met()`` for
    each message; what it yields must pickle, and what it raises is its own affair.
    """
    first = 0
    while first < count:
        child = _Child(work, first, count)
        try:
            stopped = yield from _follow(child, first, limits)
        finally:
            status = child.kill()
        file, reason = stopped
        if file >= count:
            return
        yield Failure(file, reason or _ended(status))
        first = file + 1


def _follow(child: _Child, first: int, limits: Limits):
    """Pass on what a child sends. Returns the file at which it stopped with the reason (None: it
    ended by itself)."""
    held, done = bytearray(), first
    seen, since = child.progress(), time.monotonic()
    opened, begun = seen[1], since
    while True:
        ready, _, _ = select.select([child.pipe], [], [], _GLANCE)
        if ready:
            data = os.read(child.pipe, _READ_BYTES)
            if not data:
                child.wait()
                return done, None
            held += data
            while len(held) >= _HEAD_BYTES:
                size, kind, file = struct.unpack_from(_HEAD, held)
                if len(held) < _HEAD_BYTES + size:
                    break
                frame = bytes(held[_HEAD_BYTES : _HEAD_BYTES + size])
                del held[: _HEAD_BYTES + size]
                if kind == _DONE:
                    done = file + 1
                    continue
                passed_on = time.monotonic()
                yield pickle.loads(frame)
                # The time that the reader takes is not the decoder's.
                begun += time.monotonic() - passed_on
            since = time.monotonic()
        now, state = time.monotonic(), child.progress()
        if state != seen:
            seen, since = state, now
        if state[1] != opened:
            opened, begun = state[1], now
        if limits.message_seconds is not None and now - since > limits.message_seconds:
            return done, f"DecoderTimeout: no message for {limits.message_seconds:g} s"
        if limits.file_seconds is not None and now - begun > limits.file_seconds:
            return done, f"DecoderTimeout: file took over {limits.file_seconds:g} s"
