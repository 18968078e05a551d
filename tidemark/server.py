"""Replay evaluations over HTTP, for the machine itself only: GET / and /api/scenarios, POST /api/replay."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from .operators.cdc import STRATEGIES
from .plans import lab

MOST_BYTES = 16384
PAGE = """<!doctype html><meta charset="utf-8"><title>Replay</title><h1>Replay</h1>
<form id="f">Scenario <select name="name"></select> Policy <select name="strategy"></select>
Checkpoint <input name="checkpoint" type="number" value="0"> Interruption <input name="interruption" type="number" value="0"><button>Run</button></form><pre id="out"></pre>
<script>
const form = document.getElementById('f'), out = document.getElementById('out');
fetch('/api/scenarios').then(r => r.json()).then(d => {
  for (const [field, items] of [['name', d.scenarios], ['strategy', d.strategies]])
    for (const item of items) form.elements[field].add(new Option(item, item));
});
form.onsubmit = async event => {
  event.preventDefault();
  const body = Object.fromEntries([...new FormData(form)].map(([k, v]) => [k, ['checkpoint', 'interruption'].includes(k) ? Number(v) : v]));
  const reply = await fetch('/api/replay', {method: 'POST', body: JSON.stringify(body)});
  out.textContent = JSON.stringify(await reply.json(), null, 2);
};
</script>"""


def bound(spark: SparkSession, port: int) -> ThreadingHTTPServer:
    """A server on the loopback address; port 0 takes a free one."""

    class Replay(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def reply(self, status: int, value, kind: str = "application/json") -> None:
            body = value.encode() if isinstance(value, str) else json.dumps(value, allow_nan=False).encode()
            self.send_response(status)
            for name, text in (("Content-Type", kind), ("Content-Length", str(len(body))), ("Cache-Control", "no-store"), ("X-Content-Type-Options", "nosniff")):
                self.send_header(name, text)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            if self.path == "/":
                return self.reply(200, PAGE, "text/html; charset=utf-8")
            if self.path == "/api/scenarios":
                return self.reply(200, {"scenarios": lab.SCENARIOS, "strategies": STRATEGIES})
            return self.reply(404, {"error": "not found"})

        def do_POST(self):
            if self.path != "/api/replay":
                return self.reply(404, {"error": "not found"})
            try:
                size = int(self.headers.get("Content-Length", 0))
                if not 1 <= size <= MOST_BYTES:
                    raise ValueError(f"request body must be 1..{MOST_BYTES} bytes")
                asked = json.loads(self.rfile.read(size))
                if not isinstance(asked, dict):
                    raise ValueError("options must be a JSON object")
                found = lab.evaluate(spark, **asked)
            except (ValueError, TypeError, KeyError) as e:
                return self.reply(400, {"schema_version": "3.0", "error": str(e)})
            return self.reply(200, found)

    return ThreadingHTTPServer(("127.0.0.1", port), Replay)


def serve(spark: SparkSession, port: int) -> None:
    with bound(spark, port) as server:
        print(f"listening on http://127.0.0.1:{server.server_port}", flush=True)
        try:
            server.serve_forever()
        except KeyboardInterrupt:
            pass
