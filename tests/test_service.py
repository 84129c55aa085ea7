import io
import json

from pyspark.sql import functions as F

from lodestrand.functions import config_text
from lodestrand.plans.service import Service


class FakeEngine:
    def retrieve(self, kind, text, detail):
        return f"{kind}|{text}|{detail}"

    def expand(self, handle):
        return f"expanded {handle}"

    def status(self, counts=True):
        return json.dumps({"counts": counts})


def test_http_routes():
    s = Service(FakeEngine(), lambda: FakeEngine())
    assert s.http("GET", "/context?task=fix+it%21&detail=full")[::2] == (200, "task|fix it!|full")
    assert s.http("GET", "/context/symbol?name=f&detail=standard")[2] == "symbol|f|compact"
    assert s.http("GET", "/context/expand?handle=expand:file:a")[2] == "expanded expand:file:a"
    assert s.http("GET", "/context")[0] == 400 and s.http("GET", "/nothing")[0] == 404 and s.http("GET", "/reindex")[0] == 404
    assert s.http("POST", "/reindex")[0] == 200 and json.loads(s.http("GET", "/stats")[2])["counts"] and not json.loads(s.http("GET", "/health")[2])["counts"]


def test_rpc_over_streams():
    s = Service(FakeEngine())
    ask = lambda method, **params: json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    framed = ask("tools/call", name="get_file", arguments={"path": "é.c"}).encode()
    source = io.BytesIO(ask("initialize").encode() + b"\n" + b"Content-Length: %d\r\n\r\n%s" % (len(framed), framed) + b"\n" + b'{"method":"notifications/initialized"}\n')
    sink = io.BytesIO()
    s.serve_streams(source, sink)
    assert sink.getvalue().count(b"Content-Length") == 2 and "file|é.c|compact" in json.loads(sink.getvalue().split(b"\r\n\r\n")[-1])["result"]["content"][0]["text"]
    code = lambda text: s.rpc(text)["error"]["code"]
    assert code("{") == -32700 and code("[]") == -32600 and code(ask("zzz")) == -32601 and code(ask("tools/call", name="get_file")) == -32602 and code(ask("tools/call", name="no")) == -32601
    assert len(s.rpc(ask("tools/list"))["result"]["tools"]) == 6


def test_config_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    block = lambda t: one(config_text.with_marked_block(F.lit(t), "# <<", "# >>", "a $1 \\b"))
    assert block("x") == "x\n# <<\na $1 \\b\n# >>\n"
    assert block("x\n# <<\nold\n# >>\ny") == "x\n# <<\na $1 \\b\n# >>\ny"
    toml = "a = 1\n[t.own]\nb = 2\n\nc = 3\n[t.owned]\nd = 4\n"
    assert one(config_text.without_toml_table(F.lit(toml), "[t.own]")) == "a = 1\n[t.owned]\nd = 4\n"
    assert one(config_text.without_toml_table(F.lit("[t.own]\nb = 2"), "[t.own]")) == ""
    assert [one(config_text.wants_client(F.lit(c), "beta")) for c in ("", "all", "Alpha, BETA", "alpha")] == [True, True, True, False]
