"""The data sources against a server of this process."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from graniteleaf.operators import ratelimit
from graniteleaf.sources import web


@pytest.fixture(scope="module")
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, self.headers.get("Authorization")))
            body = {"/bad": "an error page", "/v1/models": json.dumps({"data": [{"id": "m2"}, {"id": "m1"}, {"id": "m2"}]}), "/odd/models": "[1]"}.get(self.path, f'<div class="eli-subdivision" id="art_{self.path[1:]}">é</div>')
            self.send_response(404 if self.path == "/gone" else 200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_pages_are_read_in_partitions_and_filters_spare_addresses(spark, server, tmp_path):
    web.register(spark)
    base, asked = server
    (tmp_path / "p.html").write_text('<p class="eli-subdivision">file</p>')
    urls = [f"{base}/{i}" for i in range(10)] + [f"file://{tmp_path}/p.html"]
    pages = spark.read.format("pages").option("urls", "\n".join(urls)).option("per_partition", 4).load()
    assert pages.rdd.getNumPartitions() == 3
    got = dict(pages.collect())
    assert set(got) == set(urls) and "é" in got[f"{base}/3"]
    del asked[:]
    assert pages.where((F.col("url") == f"{base}/7") & F.col("html").contains("art_7")).count() == 1
    assert pages.where(F.col("url").isin(f"{base}/1", f"{base}/2", "nowhere")).count() == 2
    assert sorted({p for p, _ in asked}) == ["/1", "/2", "/7"]
    assert spark.read.format("pages").load().count() == 0


@pytest.mark.parametrize("path", ["bad", "gone"])
def test_a_page_that_is_none_fails(spark, server, path):
    web.register(spark)
    pages = spark.read.format("pages").option("urls", f"{server[0]}/1\n{server[0]}/{path}")
    with pytest.raises(Exception, match="no eli-subdivision|404"):
        pages.load().collect()
    if path == "bad":
        assert pages.option("mark", "").load().count() == 2


def test_models_of_providers(spark, server):
    web.register(spark)
    base, asked = server
    models = spark.read.format("models").option("providers", "groq,openai,gemini,nobody").option("base_groq", f"{base}/v1").option("base_openai", f"{base}/odd").option("base_gemini", "http://127.0.0.1:9").option("timeout", "5").load()
    assert sorted(map(tuple, models.collect())) == [("groq", "m1"), ("groq", "m2")]
    del asked[:]
    assert ratelimit.listed_models(models, "groq") == ["m1", "m2"] and ratelimit.listed_models(models, "gemini") == []
    assert {p for p, _ in asked} == {"/v1/models"}
