"""Log records as text or JSON lines, without secrets."""

from __future__ import annotations

import json
import logging
import re
from datetime import UTC, datetime

#: What follows these names in urls, options and messages is never written.
SECRETS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey")
_NAMED = re.compile(rf"(?i)((?:{'|'.join(SECRETS)})[\"']?\s*[=:]\s*)(\"[^\"]*\"|'[^']*'|[^\s&;,)]+)")
_IN_URL = re.compile(r"(://[^/\s:@]*:)[^@\s/]+(@)")
_PLAIN = set(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


def redacted(text: str, words: tuple[str, ...] = ()) -> str:
    """text with passwords of urls, values of secret names, and the given words (passwords known to the run) blotted out."""
    for w in sorted(filter(None, words), key=len, reverse=True):
        text = text.replace(w, "***")
    return _IN_URL.sub(r"\1***\2", _NAMED.sub(r"\1***", text))


class Lines(logging.Formatter):
    """A line for each record: its time, level, logger, message and further fields."""

    def __init__(self, as_json: bool = False, words: tuple[str, ...] = ()):
        super().__init__()
        self.as_json, self.words = as_json, words

    def format(self, record: logging.LogRecord) -> str:
        more = {k: v for k, v in vars(record).items() if k not in _PLAIN and v is not None}
        row = {"timestamp": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "msg": record.getMessage(), **more}
        if record.exc_info:
            row["error"] = self.formatException(record.exc_info)
        hidden = {k: "***" if k.lower() in SECRETS else redacted(v, self.words) if isinstance(v, str) else v for k, v in row.items()}
        if self.as_json:
            return json.dumps(hidden, default=str, ensure_ascii=False)
        head = " ".join(str(hidden.pop(k)) for k in ("timestamp", "level", "logger", "msg"))
        return " ".join([head, *(f"{k}={v}" for k, v in hidden.items())])


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"sparkferry.{name}")


def configure(debug: bool = False, as_json: bool = False, words: tuple[str, ...] = (), stream=None) -> logging.Logger:
    """Sends the library's records to a stream (standard error if None), instead of where they went before. words: what must never be written."""
    top, handler = logging.getLogger("sparkferry"), logging.StreamHandler(stream)
    handler.setFormatter(Lines(as_json, words))
    top.handlers[:] = [handler]
    top.setLevel(logging.DEBUG if debug else logging.INFO)
    top.propagate = False
    return top
