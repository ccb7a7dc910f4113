"""Running plug-ins over batches of rows, in the worker or in a child process that can be killed.

A plug-in is called with one row's arguments; one that has ``many`` is called
with a list of them and gives a list of results.  A row on which it raises has
no result (None) and harms no other: after an error in ``many`` the batch is
done row by row.  With a time limit the plug-in lives in a child process of
the worker.  A row that takes longer, or ends the process, loses its result;
the child is killed and the next row gets a new one, so nothing is left running.
"""

from __future__ import annotations

import multiprocessing
import os
import signal
import time
from collections.abc import Callable


class InWorker:
    """A plug-in in the worker's own process."""

    def __init__(self, make: Callable[[], Callable]):
        self.model = make()

    def many(self, rows: list[tuple]) -> list | None:
        """Results of all rows by the plug-in's ``many``; None where it has none or fails."""
        together = getattr(self.model, "many", None)
        if together is None:
            return None
        try:
            out = list(together(rows))
        except Exception:  # found again row by row
            return None
        return out if len(out) == len(rows) else None

    def one(self, row: tuple):
        try:
            return self.model(*row)
        except Exception:  # isolation of rows is the contract
            return None


def _serve(make: Callable[[], Callable], link, parent: int) -> None:
    """The child: answers requests until the worker is gone."""
    signal.signal(signal.SIGTERM, signal.SIG_DFL)
    served = InWorker(make)
    while True:
        while not link.poll(2):
            if os.getppid() != parent:
                os._exit(0)
        try:
            kind, given = link.recv()
        except (EOFError, OSError):
            os._exit(0)
        link.send(getattr(served, kind)(given))


class InChild:
    """A plug-in in a child process; each row has ``seconds``."""

    def __init__(self, make: Callable[[], Callable], seconds: float):
        self.make, self.seconds = make, seconds
        self.process = self.link = None

    def _ask(self, kind: str, given, seconds: float):
        """The answer, or None if there is none in time."""
        if self.process is None:
            context = multiprocessing.get_context("fork")
            self.link, theirs = context.Pipe()
            self.process = context.Process(target=_serve, args=(self.make, theirs, os.getpid()), daemon=True)
            self.process.start()
            theirs.close()
        try:
            self.link.send((kind, given))
            if self.link.poll(seconds):
                return self.link.recv()
        except (EOFError, OSError):  # the plug-in ended its process
            pass
        self.close()
        return None

    def many(self, rows: list[tuple]) -> list | None:
        return self._ask("many", rows, self.seconds * len(rows))

    def one(self, row: tuple):
        return self._ask("one", row, self.seconds)

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.link.close()
            self.process = self.link = None


def results(runner: InWorker | InChild, rows: list[tuple | None]) -> list:
    """A result for each row; None for a None, and where the plug-in fails or takes too long."""
    given = [r for r in rows if r is not None]
    got = runner.many(given) if given else []
    if got is None:
        got = [runner.one(r) for r in given]
    answers = iter(got)
    return [None if r is None else next(answers) for r in rows]


#: Runners of this worker by kind, name and limit; those not used for a while are closed.
_LIVE: dict[tuple, list] = {}
IDLE = 600.0


def runner(key: tuple, make: Callable[[], Callable], seconds: float | None) -> InWorker | InChild:
    """The worker's runner of a plug-in, made once for a key."""
    now, key = time.monotonic(), (*key, seconds)
    for other in [k for k, (at, r) in _LIVE.items() if k != key and now - at > IDLE and isinstance(r, InChild)]:
        _LIVE.pop(other)[1].close()
    held = _LIVE.get(key)
    if held is None:
        held = _LIVE[key] = [now, InWorker(make) if seconds is None else InChild(make, seconds)]
    held[0] = now
    return held[1]
