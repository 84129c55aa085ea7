"""Progress of streams: what came in, how far it is, and how it ended."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Register with ``spark.streams.addListener``; ``state`` is by query id."""

    def __init__(self):
        self.state: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.state[str(event.id)] = {"running": True, "batches": 0, "rows": 0, "error": None}

    def onQueryProgress(self, event) -> None:
        s = self.state.setdefault(str(event.progress.id), {"running": True, "batches": 0, "rows": 0, "error": None})
        s["batches"], s["rows"] = s["batches"] + 1, s["rows"] + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        s = self.state.setdefault(str(event.id), {"batches": 0, "rows": 0})
        s["running"], s["error"] = False, event.exception
