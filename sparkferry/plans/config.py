"""Settings of a run, from the environment or given."""

from __future__ import annotations

import json
import os
import ssl
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields, replace

DIALECTS = ("mysql", "postgres", "sqlite")
#: Directions: a source and a destination dialect.
DIRECTIONS = {("mysql", "mysql"), ("mysql", "postgres"), ("postgres", "mysql"), ("postgres", "postgres"), ("sqlite", "mysql"), ("sqlite", "postgres"), ("sqlite", "sqlite")}


@dataclass(frozen=True)
class Config:
    source: str = "mysql"
    destination: str = "postgres"
    strategy: str = "drop_create"
    workers: int = 8
    batch_size: int = 1000
    table_timeout: float = 300.0
    retries: int = 3
    retry_interval: float = 5.0
    pool: int = 20
    skip_failed_tables: bool = False
    validate: bool = True
    compat: bool = False
    #: What becomes of rows with a value that the destination can't hold: `fail`, `quarantine` (a table of their own) or `null`.
    unfit: str = "fail"
    #: Columns, by comma, that tell which of several source rows of a key is the newest; without them it is an arbitrary one, always the same.
    newest: str = ""
    #: A file with types of one's own, see TypeMap.load.
    type_map: str = ""

    def __post_init__(self):
        if (self.source, self.destination) not in DIRECTIONS:
            raise ValueError(f"no direction {self.source}-to-{self.destination}")
        if self.strategy not in ("drop_create", "alter", "none"):
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if self.unfit not in ("fail", "quarantine", "null"):
            raise ValueError(f"unknown treatment {self.unfit!r} of unfit rows")
        for name, least in (("workers", 1), ("batch_size", 1), ("pool", 1), ("retries", 0), ("retry_interval", 0), ("table_timeout", 0)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be {least} or more")

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, **given) -> Config:
        """From SYNC_DIRECTION and upper-case names of the settings; what is given wins."""
        env = os.environ if env is None else env
        read = {}
        if direction := env.get("SYNC_DIRECTION"):
            read["source"], _, read["destination"] = direction.lower().partition("-to-")
        for f in fields(cls):
            if (text := env.get({"strategy": "SCHEMA_SYNC_STRATEGY"}.get(f.name, f.name.upper()))) not in (None, ""):
                read[f.name] = {"int": int, "float": float, "bool": lambda t: t.strip().lower() in ("1", "true", "t", "yes", "on")}.get(f.type, str)(text)
        return cls(**(read | {k: v for k, v in given.items() if v is not None}))

    def with_(self, **changes) -> Config:
        return replace(self, **changes)


def credentials(env: Mapping[str, str], label: str, secrets=()) -> tuple[str, str]:
    """User and password: from LABEL_USER and LABEL_PASSWORD, else from the first of the secret lookups (label -> pair or None) that knows them."""
    user, password = env.get(f"{label}_USER"), env.get(f"{label}_PASSWORD")
    if user and password:
        return user, password
    for lookup in secrets:
        if found := lookup(label):
            return found
    raise ValueError(f"no credentials for {label}")


def vault(address: str, token: str, paths: Mapping[str, str], user_key: str = "username", password_key: str = "password", ca: str | None = None, verify: bool = True, timeout: float = 10.0) -> Callable[[str], tuple[str, str] | None]:
    """A lookup for `credentials`: labels to secrets of a Vault KV (version 2) engine at `secret/`, by token.

    A label without a path is not known (None). A secret that is absent, unreadable, or has no password raises ValueError, which never
    holds the token or a password. A secret without a user gives an empty one.
    """
    context = ssl.create_default_context(cafile=ca)
    if not verify:
        context.check_hostname, context.verify_mode = False, ssl.CERT_NONE

    def lookup(label: str) -> tuple[str, str] | None:
        if not (where := paths.get(label)):
            return None
        asked = urllib.request.Request(f"{address.rstrip('/')}/v1/secret/data/{urllib.parse.quote(where.strip('/'))}", headers={"X-Vault-Token": token})
        try:
            with urllib.request.urlopen(asked, timeout=timeout, context=context if address.startswith("https") else None) as got:
                data = json.load(got)["data"]["data"]
        except urllib.error.HTTPError as e:
            raise ValueError(f"secret {where!r} " + ("is not there" if e.code == 404 else f"can't be read: status {e.code}")) from None
        except (OSError, KeyError, TypeError, ValueError) as e:
            raise ValueError(f"secret {where!r} can't be read: {type(e).__name__}") from None
        password = data.get(password_key) if isinstance(data, dict) else None
        if not isinstance(password, str) or not password:
            raise ValueError(f"secret {where!r} has no text {password_key!r}")
        user = data.get(user_key)
        return user if isinstance(user, str) else "", password

    return lookup


def jdbc_url(dialect: str, host: str, port: int, database: str, ssl: str = "disable") -> str:
    if dialect == "mysql":
        return f"jdbc:mysql://{host}:{port}/{database}?useSSL={'false' if ssl == 'disable' else 'true'}&rewriteBatchedStatements=true"
    if dialect == "postgres":
        return f"jdbc:postgresql://{host}:{port}/{database}?sslmode={ssl}&reWriteBatchedInserts=true"
    if dialect == "sqlite":
        return f"jdbc:sqlite:{database}"
    raise ValueError(f"unknown dialect {dialect!r}")
