"""Request loop: one JSON object a line in, one out. One request runs at a time; cancel and close overtake it.

{"id": 1, "command": "query", "name": ..., "sf": ...}   a registered query's rows (at most `limit`)
{"id": 2, "command": "load", "path": ...}               a stored matrix, kept until the least recently used make room
{"id": 3, "command": "describe", "path": ...}           its header facts
{"command": "info"}  {"command": "cancel", "id": 1}  {"command": "reload"}  {"command": "close"}
"""

from __future__ import annotations

import json
import queue
import threading
from collections import OrderedDict

from pyspark.sql import SparkSession

from tracklake import __version__
from tracklake.plans import catalog, programs

KEPT = 8


class Service:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.matrices: OrderedDict[str, programs.Matrix] = OrderedDict()
        self.cancelled: set = set()

    def matrix(self, path: str) -> programs.Matrix:
        if path in self.matrices:
            self.matrices.move_to_end(path)
        else:
            found = programs.load_matrix(self.spark, path)
            found.rows.persist()
            self.matrices[path] = found
            while len(self.matrices) > KEPT:
                self.matrices.popitem(last=False)[1].rows.unpersist()
        return self.matrices[path]

    def forget(self) -> None:
        while self.matrices:
            self.matrices.popitem()[1].rows.unpersist()

    def answer(self, request: dict) -> dict:
        """The result of one request; errors come back as text."""
        number = request.get("id")
        if number is not None and number in self.cancelled:
            return {"id": number, "error": "cancelled"}
        self.spark.sparkContext.setJobGroup(f"request-{number}", str(request.get("command")), interruptOnCancel=True)
        try:
            match request.get("command"):
                case "query":
                    rows = catalog.QUERIES[request["name"]](self.spark, request["sf"]).limit(int(request.get("limit", 1000)))
                    result = [r.asDict(recursive=True) for r in rows.collect()]
                case "load":
                    result = {"rows": self.matrix(request["path"]).rows.count()}
                case "describe":
                    result = programs.describe(self.matrix(request["path"]))
                case "info":
                    result = {"version": __version__, "queries": sorted(catalog.QUERIES), "loaded": list(self.matrices)}
                case "reload":
                    self.forget()
                    result = True
                case other:
                    raise ValueError(f"unknown command {other!r}")
            return {"id": number, "result": result}
        except Exception as e:
            return {"id": number, "error": "cancelled" if number in self.cancelled else f"{type(e).__name__}: {e}".splitlines()[0]}

    def cancel(self, number) -> None:
        self.cancelled.add(number)
        self.spark.sparkContext.cancelJobGroup(f"request-{number}")


def serve(spark: SparkSession, lines, write) -> None:
    """Reads requests from `lines` in a thread, so that cancel reaches a running one; writes answers in order of arrival."""
    service, waiting = Service(spark), queue.Queue()

    def read():
        for line in lines:
            if not line.strip():
                continue
            try:
                request = json.loads(line)
                if not isinstance(request, dict):
                    raise ValueError("a request is an object")
            except ValueError as e:
                waiting.put({"broken": str(e)})
                continue
            if request.get("command") == "cancel":
                write(json.dumps({"cancel": request.get("id")}))
                service.cancel(request.get("id"))
            elif request.get("command") == "close":
                break
            else:
                waiting.put(request)
        waiting.put(None)

    threading.Thread(target=read, daemon=True).start()
    while (request := waiting.get()) is not None:
        write(json.dumps({"error": request["broken"]} if "broken" in request else service.answer(request), default=str))
    service.forget()
