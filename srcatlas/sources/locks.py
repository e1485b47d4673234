"""Who may write a project's index, and how another process asks the writer to do so.

The writer holds an advisory lock on a file in the index folder, which the system frees
when the process ends. Who finds a project locked leaves a request file at the project's
root; the writer flushes, then deletes it. Both work on local trees.
"""

from __future__ import annotations

import fcntl
import os
import time
from typing import IO

from srcatlas.sources.listing import INDEX_FOLDER

REQUEST = ".srcatlas.flush"
TIMEOUT, POLL = 30.0, 0.1  # seconds


def take(base: str) -> IO | None:
    """The lock of the project at `base`, held until it is closed; None if another process has it, or if it can't be written."""
    try:
        os.makedirs(os.path.join(base, INDEX_FOLDER), exist_ok=True)
        held = open(os.path.join(base, INDEX_FOLDER, "lock"), "a")
    except OSError:
        return None
    try:
        fcntl.flock(held, fcntl.LOCK_EX | fcntl.LOCK_NB)
    except OSError:
        held.close()
        return None
    return held


def ask(base: str, timeout: float = TIMEOUT, poll: float = POLL) -> bool:
    """Ask the writer of a project to flush it; whether it did so in time. A request without an answer is taken back."""
    path = os.path.join(base, REQUEST)
    with open(path, "w"):
        pass
    end = time.monotonic() + timeout
    while os.path.exists(path):
        if time.monotonic() >= end:
            answer(base)
            return False
        time.sleep(poll)
    return True


def asked(base: str) -> bool:
    return os.path.exists(os.path.join(base, REQUEST))


def answer(base: str) -> None:
    try:
        os.remove(os.path.join(base, REQUEST))
    except FileNotFoundError:
        pass
