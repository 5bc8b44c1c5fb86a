"""What a server needs to answer requests: checked requests, envelopes, sessions, pages, statistics and event streams.

No server is started here; each method takes plain values and returns a dict that is ready for JSON.  The state of sessions
is small and lives in the driver; documents stay a table.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.profile import page

# fixed values: limits of a request, turns that a session keeps and shows, and its life in seconds
MOST_QUERY, MOST_TOP_K, STRATEGIES = 2000, 20, ("rrf", "weighted", "simple")
KEPT_TURNS, SHOWN_TURNS, SHOWN_CHARS, LIFE = 20, 3, 300, 3600
# fixed values: codes of an envelope
OK, BAD_REQUEST, NO_DOCUMENT, NO_SESSION, FAILED = 0, 1001, 3001, 3002, 4001


class BadRequest(ValueError):
    """A request outside its limits."""


class NoDocument(KeyError):
    """No such document."""


class NoSession(KeyError):
    """No such session, or its time is over."""


@dataclass(frozen=True)
class Ask:
    """A checked question."""

    query: str
    top_k: int = 8
    fusion_strategy: str = "rrf"
    session_id: str | None = None
    run_evaluation: bool = True
    run_review: bool = True
    agent_mode: bool = False
    where_filter: dict | None = None

    def __post_init__(self):
        if not isinstance(self.query, str) or not 1 <= len(self.query) <= MOST_QUERY:
            raise BadRequest(f"query needs 1 to {MOST_QUERY} characters")
        if isinstance(self.top_k, bool) or not isinstance(self.top_k, int) or not 1 <= self.top_k <= MOST_TOP_K:
            raise BadRequest(f"top_k must be 1 to {MOST_TOP_K}")
        if self.fusion_strategy not in STRATEGIES:
            raise BadRequest(f"fusion_strategy must be one of {', '.join(STRATEGIES)}")


@dataclass
class Session:
    created_at: float
    last_active: float
    turns: list[dict] = field(default_factory=list)


class Sessions:
    """Sessions that end after ``life`` seconds without use; exactly ``life`` is still alive."""

    def __init__(self, life: float = LIFE, clock: Callable[[], float] = time.time):
        self.life, self.clock, self.held, self.lock = life, clock, {}, threading.RLock()

    def _alive(self, key: str) -> Session | None:
        got = self.held.get(key)
        if got and self.clock() - got.last_active > self.life:
            got = self.held.pop(key, None) and None
        return got

    def create(self) -> dict:
        key, now = uuid.uuid4().hex, self.clock()
        self.held[key] = Session(now, now)
        return {"session_id": key, "created_at": now}

    def info(self, key: str) -> dict:
        if (got := self._alive(key)) is None:
            raise NoSession(key)
        return {"session_id": key, "created_at": got.created_at, "last_active": got.last_active, "turn_count": len(got.turns), "turns": list(got.turns)}

    def delete(self, key: str) -> dict:
        with self.lock:
            if self._alive(key) is None:
                raise NoSession(key)
            del self.held[key]
        return {"session_id": key, "deleted": True}

    def append(self, key: str, query: str, answer: str, trace: list | None = None) -> None:
        """Starts the session where it is missing or over; only the last turns stay."""
        with self.lock:
            now = self.clock()
            got = self._alive(key) or self.held.setdefault(key, Session(now, now))
            got.last_active = now
            got.turns = [*got.turns, {"query": query, "answer": answer, "timestamp": now, "trace": trace}][-KEPT_TURNS:]

    def context(self, key: str | None) -> str:
        got = self._alive(key) if key else None
        return "\n".join(f"Q: {t['query']}\nA: {t['answer'][:SHOWN_CHARS]}" for t in got.turns[-SHOWN_TURNS:]) if got else ""

    def n_active(self) -> int:
        return sum(self._alive(k) is not None for k in list(self.held))


class Service:
    """``answer(ask, context)`` gives a dict with an answer, ``stream(ask, context)`` its parts as events; ``documents`` is
    a rollup with one row a document, ordered by ``order``."""

    def __init__(self, answer: Callable[[Ask, str], dict], documents: DataFrame, key: str = "doc_id", order: str = "first_seen", stream: Callable[[Ask, str], Iterator[dict]] | None = None, sessions: Sessions | None = None, clock: Callable[[], float] = time.time):
        self.answer, self.stream, self.documents, self.key, self.order = answer, stream or self._in_one, documents, key, order
        self.sessions, self.clock = sessions or Sessions(clock=clock), clock
        self.n_ok = self.n_failed = 0
        self.seconds = 0.0

    def _in_one(self, ask: Ask, context: str) -> Iterator[dict]:
        yield {"event": "status", "stage": "generating"}
        got = self.answer(ask, context)
        yield {"event": "token", "text": got["answer"]}
        yield {"event": "done", "result": got}

    def envelope(self, make: Callable[[], object], request_id: str | None = None) -> dict:
        """Code 0 and data, or the code of a failure and a message."""
        code, message, data = OK, "success", None
        try:
            data = make()
        except BadRequest as e:
            code, message = BAD_REQUEST, str(e)
        except (NoDocument, NoSession) as e:
            code, message = NO_DOCUMENT if isinstance(e, NoDocument) else NO_SESSION, f"{e.args[0]} not found"
        except Exception as e:  # a failure is an answer, too
            code, message = FAILED, str(e)
        return {"code": code, "message": message, "data": data, "request_id": request_id, "timestamp": time.strftime("%Y-%m-%d %H:%M:%S", time.localtime(self.clock()))}

    def _count(self, began: float, ok: bool) -> None:
        with self.sessions.lock:
            self.seconds += self.clock() - began
            self.n_ok, self.n_failed = self.n_ok + ok, self.n_failed + (not ok)

    def ask(self, request: dict, request_id: str | None = None) -> dict:
        def run():
            ask, began, ok = checked(request), self.clock(), False
            try:
                got = self.answer(ask, self.sessions.context(ask.session_id))
                ok = True
            finally:
                self._count(began, ok)
            if ask.session_id:
                self.sessions.append(ask.session_id, ask.query, got["answer"], got.get("trace"))
            return got | {"session_id": ask.session_id}

        return self.envelope(run, request_id)

    def ask_stream(self, request: dict, request_id: str | None = None) -> Iterator[str]:
        """Server-sent events: status, token, then done or error; a turn is kept once it is done."""
        ask, began, ok = checked(request), self.clock(), False
        try:
            for event in self.stream(ask, self.sessions.context(ask.session_id)):
                if event["event"] == "done":
                    ok = True
                    if ask.session_id:
                        self.sessions.append(ask.session_id, ask.query, event["result"]["answer"])
                    event = {"event": "done", "data": event["result"] | {"session_id": ask.session_id}}
                yield f"data: {json.dumps(event | {'request_id': request_id}, ensure_ascii=False)}\n\n"
        except Exception as e:  # ends the stream, but not the server
            yield f"data: {json.dumps({'event': 'error', 'message': str(e), 'request_id': request_id}, ensure_ascii=False)}\n\n"
        finally:
            self._count(began, ok)

    def list_documents(self, number: int = 1, size: int = 20, request_id: str | None = None) -> dict:
        def run():
            try:
                wanted = page(self.documents, [self.order, self.key], number, size)
            except ValueError as e:
                raise BadRequest(str(e)) from e
            n = self.documents.count()
            return {"items": [r.asDict() for r in wanted.collect()], "page_info": {"page": number, "page_size": size, "total": n, "total_pages": -(-n // size)}}

        return self.envelope(run, request_id)

    def get_document(self, key, request_id: str | None = None) -> dict:
        def run():
            if (got := self.documents.where(F.col(self.key) == key).first()) is None:
                raise NoDocument(key)
            return got.asDict()

        return self.envelope(run, request_id)

    def create_session(self, request_id: str | None = None) -> dict:
        return self.envelope(self.sessions.create, request_id)

    def get_session(self, key: str, request_id: str | None = None) -> dict:
        return self.envelope(lambda: self.sessions.info(key), request_id)

    def delete_session(self, key: str, request_id: str | None = None) -> dict:
        return self.envelope(lambda: self.sessions.delete(key), request_id)

    def stats(self, request_id: str | None = None) -> dict:
        n = self.n_ok + self.n_failed
        return self.envelope(lambda: {"total_calls": n, "success_count": self.n_ok, "failure_count": self.n_failed, "success_rate": round(self.n_ok / n, 4) if n else 0.0, "avg_latency_seconds": round(self.seconds / n, 4) if n else 0.0, "active_sessions": self.sessions.n_active()}, request_id)

    def health(self, checks: dict[str, Callable[[], bool]] | None = None) -> dict:
        """ok, degraded where some checks fail, down where all do."""
        def holds(check) -> bool:
            try:
                return bool(check())
            except Exception:  # a check that fails is a check that doesn't hold
                return False

        got = {name: holds(c) for name, c in (checks or {}).items()}
        state = "ok" if all(got.values()) else "degraded" if any(got.values()) else "down"
        return self.envelope(lambda: {"status": state, "checks": got})


def checked(request: dict) -> Ask:
    unknown = sorted(set(request) - set(Ask.__dataclass_fields__))
    if unknown or "query" not in request:
        raise BadRequest(f"unknown: {', '.join(unknown)}" if unknown else "query is missing")
    return Ask(**request)
