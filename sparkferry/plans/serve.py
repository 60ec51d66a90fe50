"""Metrics and health of a process that runs syncs, over HTTP, for what scrapes and probes it."""

from __future__ import annotations

import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer


def serve(port: int, metrics: Callable[[], str], ready: Callable[[], bool] = lambda: True, host: str = "") -> ThreadingHTTPServer:
    """Answers /metrics with the text of `metrics`, /healthz with 200, and /readyz with 200 or 503 by `ready`, from a thread of its
    own, until the returned server is shut down. Port 0 takes a free one (`server_port`)."""

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, body = {"/metrics": lambda: (200, metrics()), "/healthz": lambda: (200, "ok"), "/readyz": lambda: (200, "ok") if ready() else (503, "not ready")}.get(self.path, lambda: (404, "nothing here"))()
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain; version=0.0.4; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
