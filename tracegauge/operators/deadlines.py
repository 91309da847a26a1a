"""Python calls within a time, for the stages whose calls may hang or raise."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable


#: Calls of a process that haven't returned in time and still run; beyond that many, further ones fail at once.
MOST_STUCK = 64
STUCK = "too_many_timeouts"


class Job:
    def __init__(self, call: Callable[[], object]):
        self.call, self.begun, self.late, self.result, self.error = call, 0.0, False, None, None
        self.thread: threading.Thread | None = None
        self.started, self.done = threading.Event(), threading.Event()


class Workers:
    """Threads that answer jobs, each within a time from its own start. One that is late is given up: another takes its place, and as
    threads are daemons, a call that never returns holds nothing up. Threads of such calls stay; their number in a process is bounded."""

    stuck: list[threading.Thread] = []

    def __init__(self, threads: int):
        self.jobs: queue.SimpleQueue = queue.SimpleQueue()
        for _ in range(threads):
            self.hire()

    def hire(self) -> None:
        threading.Thread(target=self.work, daemon=True).start()

    def work(self) -> None:
        while (job := self.jobs.get()) is not None:
            job.begun, job.thread = time.monotonic(), threading.current_thread()
            job.started.set()
            try:
                job.result = job.call()
            except Exception as e:  # any failure of a client is a result
                job.error = type(e).__name__
            job.done.set()
            if job.late:  # its place is taken
                return

    def submit(self, call: Callable[[], object]) -> Job:
        job = Job(call)
        Workers.stuck = [t for t in Workers.stuck if t.is_alive()]
        if len(Workers.stuck) >= MOST_STUCK:
            job.error = STUCK
            job.started.set()
            job.done.set()
        else:
            self.jobs.put(job)
        return job

    def outcome(self, job: Job, limit: float) -> tuple[object, str | None]:
        """(result, error): the error is `timeout`, or the name of what the call raised."""
        job.started.wait()
        if not job.done.wait(max(0.0, job.begun + limit - time.monotonic())):
            job.late = True
            Workers.stuck.append(job.thread)
            self.hire()
            return None, "timeout"
        return job.result, job.error

    def close(self, threads: int) -> None:
        for _ in range(threads):
            self.jobs.put(None)
