"""A store behind HTTP: the read side of the SPARQL protocol and of the graph store protocol.

``respond`` answers one request without a socket; ``serve`` puts it behind the standard library's threaded
server. Answers are streamed: the first piece is computed before the status is sent, so that a query that
fails is an error and not half a document.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import chain
from urllib.parse import parse_qs, urlsplit

from .operators.store import SnapshotStore
from .operators.terms import DEFAULT_GRAPH
from .plans.parser import SparqlError, Unsupported, parse_query
from .sources import results

#: Requests with longer bodies are refused; a parameter of ``serve``.
LARGEST_BODY = 16 << 20

#: The path of queries; the graphs are one step below.
SPARQL, GRAPH = "/sparql", "/sparql/graph"

log = logging.getLogger(__name__)


@dataclass
class Reply:
    status: int
    kind: str = "text/plain; charset=utf-8"
    pieces: Iterator[str] = field(default_factory=lambda: iter(()))

    def text(self) -> str:
        return "".join(self.pieces)


class BadRequest(ValueError):
    """The request lacks what it needs."""


def _said(status: int, text: str) -> Reply:
    return Reply(status, pieces=iter([text + "\n"]))


def _started(kind: str, pieces: Iterator[str]) -> Reply:
    """The first two pieces are made now: the head and, with it, the start of the job."""
    first = [x for x in (next(pieces, None), next(pieces, None)) if x is not None]
    return Reply(200, kind, chain(first, pieces))


def _only(fields: dict, name: str) -> str:
    found = [x for x in fields.get(name, []) if x.strip()]
    if len(found) != 1:
        raise BadRequest(f"exactly one value is needed for '{name}'")
    return found[0]


def answer(store: SnapshotStore, text: str) -> Reply:
    """SELECT and ASK as JSON, CONSTRUCT and DESCRIBE as Turtle."""
    form = parse_query(text).form
    df = store.sparql(text)
    if form == "select":
        return _started(results.JSON_TYPE, results.json_text(df))
    if form == "ask":
        return Reply(200, results.JSON_TYPE, iter([results.json_boolean(df.first().answer)]))
    return _started(results.TURTLE_TYPE, results.turtle_text(df))


def _query(store: SnapshotStore, method: str, fields: dict, kind: str, body: bytes) -> Reply:
    if method == "GET":
        return answer(store, _only(fields, "query"))
    if method != "POST":
        return _said(405, "GET or POST is needed")
    text = body.decode("utf-8")
    if kind == "application/x-www-form-urlencoded":
        return answer(store, _only(parse_qs(text, keep_blank_values=True), "query"))
    if kind not in ("application/sparql-query", "application/sparql-update"):
        return _said(400, f"the content type {kind or 'of nothing'} is not understood")
    if not text.strip():
        raise BadRequest("the body is empty")
    return answer(store, text) if kind == "application/sparql-query" else _said(501, "updates are not offered here")


def _graph(store: SnapshotStore, method: str, fields: dict) -> Reply:
    """A graph as Turtle; without a name, the triples of all graphs."""
    if method != "GET":
        return _said(501, "graphs cannot be changed here")
    name = None
    if "graph" in fields:
        name = f"<{_only(fields, 'graph')}>"
    elif "default" in fields:
        name = DEFAULT_GRAPH
    return _started(results.TURTLE_TYPE, results.turtle_text(store.load_graph(name)))


def respond(store: SnapshotStore, method: str, target: str, kind: str = "", body: bytes = b"") -> Reply:
    """The reply to a request: 400 what cannot be read, 501 what is not offered, 500 what failed, without details."""
    at = urlsplit(target)
    fields, kind = parse_qs(at.query, keep_blank_values=True), kind.split(";")[0].strip().lower()
    try:
        if at.path == SPARQL:
            return _query(store, method, fields, kind, body)
        if at.path == GRAPH:
            return _graph(store, method, fields)
        return _said(404, "there is nothing here")
    except (BadRequest, SparqlError, UnicodeDecodeError) as e:
        return _said(400, str(e))
    except Unsupported as e:
        return _said(501, str(e))
    except Exception:
        log.exception("%s %s failed", method, at.path)
        return _said(500, "the request failed")


def make_server(store: SnapshotStore, host: str = "127.0.0.1", port: int = 0, largest_body: int = LARGEST_BODY) -> ThreadingHTTPServer:
    """A server that is not yet running; port 0 takes a free one, found in ``server_address``."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def handle_any(self) -> None:
            size = self.headers.get("Content-Length", "0")
            if not size.isdigit() or int(size) > largest_body:
                self.close_connection = True
                return self.send(_said(413 if size.isdigit() else 400, "the body is too long or of no stated length"))
            self.send(respond(store, self.command, self.path, self.headers.get("Content-Type", ""), self.rfile.read(int(size))))

        do_GET = do_POST = do_PUT = do_DELETE = handle_any

        def send(self, reply: Reply) -> None:
            self.send_response(reply.status)
            self.send_header("Content-Type", reply.kind)
            self.send_header("Transfer-Encoding", "chunked")
            self.end_headers()
            for piece in reply.pieces:
                if piece:
                    data = piece.encode("utf-8")
                    self.wfile.write(b"%x\r\n%s\r\n" % (len(data), data))
            self.wfile.write(b"0\r\n\r\n")

        def log_message(self, form: str, *args) -> None:
            log.info(form, *args)

    return ThreadingHTTPServer((host, port), Handler)


def serve(store: SnapshotStore, host: str = "127.0.0.1", port: int = 8080) -> None:
    """Answers requests until it is stopped."""
    with make_server(store, host, port) as server:
        server.serve_forever()
