"""The command interface over HTTP with server-sent events, over standard input, and as a prompt.

POST /command takes one JSON command; POST /stream takes {"query": ...} and
answers with the events started, chunk (one an answer) and done, or error.
``python -m hornbeam.server [--http PORT | --stdio | --repl]``.
"""

from __future__ import annotations

import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import IO

from .facade import Database

#: Bytes of a request that are taken at most.
MOST_BODY = 64 << 20


def _text(value) -> str:
    return json.dumps(value, ensure_ascii=False, default=str)


def make_server(db: Database, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server of one database; commands run one after the other."""
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *_):
            pass

        def _answer(self, code: int, body: str) -> None:
            data = body.encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _request(self) -> dict | None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BODY:
                self._answer(413, _text({"type": "error", "code": "TooLarge", "message": f"more than {MOST_BODY} bytes"}))
                return None
            try:
                found = json.loads(self.rfile.read(size) or b"{}")
                if not isinstance(found, dict):
                    raise ValueError("a command is an object")
                return found
            except ValueError as error:
                self._answer(400, _text({"type": "error", "code": "BadRequest", "message": str(error)}))
                return None

        def do_GET(self):
            self._answer(*((200, _text({"type": "success", "data": "ok"})) if self.path == "/health" else (404, _text({"type": "error", "code": "NotFound", "message": self.path}))))

        def do_POST(self):
            request = self._request()
            if request is None:
                return
            if self.path == "/command":
                with lock:
                    answer = db.handle(request)
                self._answer(200 if answer["type"] == "success" else 422, _text(answer))
            elif self.path == "/stream":
                self.send_response(200)
                self.send_header("Content-Type", "text/event-stream; charset=utf-8")
                self.send_header("Connection", "close")
                self.end_headers()
                self.close_connection = True

                def event(name: str, data) -> None:
                    self.wfile.write(f"event: {name}\ndata: {_text(data)}\n\n".encode())
                    self.wfile.flush()

                n = 0
                try:
                    with lock:
                        event("started", {"query": request["query"]})
                        for row in db.stream(request["query"]):
                            event("chunk", row)
                            n += 1
                    event("done", {"answers": n})
                except (ValueError, KeyError, TypeError) as error:
                    event("error", {"code": type(error).__name__, "message": str(error)})
            else:
                self._answer(404, _text({"type": "error", "code": "NotFound", "message": self.path}))

    return ThreadingHTTPServer((host, port), Handler)


def serve_lines(db: Database, given: IO[str], out: IO[str]) -> None:
    """One JSON command a line in, one JSON answer a line out."""
    for line in given:
        if line.strip():
            try:
                answer = db.handle(json.loads(line))
            except ValueError as error:
                answer = {"type": "error", "code": "BadRequest", "message": str(error)}
            print(_text(answer), file=out, flush=True)


def repl(db: Database, given: IO[str], out: IO[str]) -> None:
    """``? goals.`` asks, ``.name {json}`` is a command, ``.quit`` ends, anything else is a rule."""
    for line in given:
        text = line.strip()
        if not text:
            continue
        if text == ".quit":
            break
        if text.startswith("?"):
            answer = db.handle({"command": "query", "query": text})
            if answer["type"] == "success":
                for row in answer["data"]:
                    print(", ".join(f"{k} = {v}" for k, v in row.items()) or "true", file=out)
                print(f"{len(answer['data'])} answers" if answer["data"] else "false", file=out, flush=True)
                continue
        elif text.startswith("."):
            name, _, rest = text[1:].partition(" ")
            try:
                answer = db.handle({"command": name, **json.loads(rest or "{}")})
            except ValueError as error:
                answer = {"type": "error", "code": "BadRequest", "message": str(error)}
        else:
            answer = db.handle({"command": "add_rules", "text": text})
        print(_text(answer), file=out, flush=True)


def main(args: list[str]) -> None:
    from pyspark.sql import SparkSession

    db = Database(SparkSession.builder.getOrCreate())
    if args[:1] == ["--http"]:
        make_server(db, int(args[1])).serve_forever()
    elif args[:1] == ["--repl"]:
        repl(db, sys.stdin, sys.stdout)
    else:
        serve_lines(db, sys.stdin, sys.stdout)


if __name__ == "__main__":
    main(sys.argv[1:])
