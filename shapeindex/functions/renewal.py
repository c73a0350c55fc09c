"""Python's parser keeps every name it has ever read (interned for the life of the process, some 150 bytes a snippet). A worker lives as
long as its executor, so a worker that parses all day grows without end; only the end of a process gives the names back.

``renewed`` lets a worker parse a bounded amount of text itself and has the rest parsed by child processes of its own, one after
another, each of which ends after the same amount."""
from __future__ import annotations

import os
import pickle
import struct
import traceback
import warnings

import pyarrow as pa

RENEW_BYTES = 8 << 20  # source text that one process parses
_taken = 0  # by this process, over all its tasks
_LENGTH = struct.Struct("<q")
_DONE, _FAILED = 0, -1


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as stream:
        return stream.read_next_batch()


def _read(f) -> bytes | None:
    head = f.read(_LENGTH.size)
    if len(head) < _LENGTH.size:
        return None
    size = _LENGTH.unpack(head)[0]
    data = f.read(abs(size))
    return None if len(data) < abs(size) else data


def _serve(run, asked, given) -> None:
    """The child's life: a batch in, its results out, each with its length before it; it ends when the parent has closed the pipe."""
    while (data := _read(asked)) is not None:
        try:
            for out in run(_unpack(data)):
                answer = _pack(out)
                given.write(_LENGTH.pack(len(answer)) + answer)
            given.write(_LENGTH.pack(_DONE))
        except BaseException:
            answer = pickle.dumps(traceback.format_exc())
            given.write(_LENGTH.pack(_FAILED) + _LENGTH.pack(len(answer)) + answer)
        given.flush()


class _Child:
    def __init__(self, run) -> None:
        (ask_out, ask_in), (give_out, give_in) = os.pipe(), os.pipe()
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", DeprecationWarning)  # of threads, which the child does not use
            self.pid = os.fork()
        if not self.pid:
            try:
                os.close(ask_in)
                os.close(give_out)
                with os.fdopen(ask_out, "rb") as asked, os.fdopen(give_in, "wb") as given:
                    _serve(run, asked, given)
            finally:
                os._exit(0)  # never back into the worker's own loop
        os.close(ask_out)
        os.close(give_in)
        self.asked, self.given = os.fdopen(ask_in, "wb"), os.fdopen(give_out, "rb")

    def run(self, batch: pa.RecordBatch):
        data = _pack(batch)
        self.asked.write(_LENGTH.pack(len(data)) + data)
        self.asked.flush()
        while True:
            head = self.given.read(_LENGTH.size)
            if len(head) < _LENGTH.size:
                raise RuntimeError("a process that parses texts ended before it was done")
            size = _LENGTH.unpack(head)[0]
            if size == _DONE:
                return
            if size == _FAILED:
                raise RuntimeError(pickle.loads(_read(self.given)))
            yield _unpack(self.given.read(size))

    def close(self) -> None:
        for f in (self.given, self.asked):
            try:
                f.close()
            except OSError:  # the child has ended
                pass
        os.waitpid(self.pid, 0)


def renewed(run, batches, size, limit: int | None = None):
    """``run(batch)`` of every batch, in order; ``size(batch)`` is its bytes of text. No process parses much more than ``limit``."""
    global _taken
    limit = RENEW_BYTES if limit is None else limit
    child, taken = None, 0
    try:
        for batch in batches:
            n = size(batch)
            if child is None and _taken < limit:
                _taken += n
                yield from run(batch)
                continue
            if child is None:
                child, taken = _Child(run), 0
            yield from child.run(batch)
            taken += n
            if taken >= limit:
                child.close()
                child = None
    finally:
        if child is not None:
            child.close()
