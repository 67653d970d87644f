import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from pixelmill.operators import network
from pixelmill.sources.client import StacClient
from pixelmill.sources.config import Stac

SMALL = network.Shape(3, 4, (4, 8))


def test_parameter_count():
    assert network.parameters(network.Shape()) == 31_066_312
    weights = network.initial(SMALL)
    trained = sum(w.size for own in weights.values() for k, w in enumerate(own) if len(own) == 2 or k % 5 < 3)
    assert trained == network.parameters(SMALL)


def test_forward_shape_and_errors():
    weights = network.initial(SMALL)
    x = np.random.default_rng(0).normal(size=(2, 3, 8, 12)).astype(np.float32)
    assert network.forward(x, weights, SMALL).shape == (2, 4, 8, 12)
    assert network.classes(x, weights, SMALL).max() < 4
    for bad in (x[0], x[:, :2], x[..., :10]):
        with pytest.raises(ValueError):
            network.forward(bad, weights, SMALL)
    for args in ((0, 4, (4,)), (3, 1, (4,)), (3, 4, ()), (3, 4, (0,))):
        with pytest.raises(ValueError):
            network.Shape(*args)


def test_convolutions_equal_loops():
    r = np.random.default_rng(1)
    x, w = r.normal(size=(1, 2, 4, 4)), r.normal(size=(3, 2, 3, 3))
    padded = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    want = np.array([[[(padded[0, :, i : i + 3, j : j + 3] * w[o]).sum() for j in range(4)] for i in range(4)] for o in range(3)])
    assert np.allclose(network._conv3(x, w)[0], want)
    u, b = r.normal(size=(3, 2, 2, 2)), r.normal(size=3)
    got = network._up(x, u, b)[0]
    for o in range(3):
        for i in range(8):
            for j in range(8):
                assert np.isclose(got[o, i, j], (x[0, :, i // 2, j // 2] * u[o, :, i % 2, j % 2]).sum() + b[o])


def test_client_pages_and_retries(spark):
    asked = []

    class Catalogue(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body)
            if len(asked) == 1:
                self.send_response(503)
                self.send_header("Retry-After", "7")
                self.end_headers()
                return
            page = body.get("page", 0)
            item = {"id": f"i{page}", "bbox": [0, 0, 1, 1], "properties": {"datetime": "2021-01-05T10:00:00Z", "eo:cloud_cover": 3.0, "grid:code": "MGRS-30STG"}, "assets": {"B02": {"href": "u"}}}
            links = [] if page else [{"rel": "next", "method": "POST", "href": f"http://127.0.0.1:{server.server_port}/search", "body": body | {"page": 1}}]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"features": [item], "links": links}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Catalogue)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    waits = []
    client = StacClient(Stac(f"http://127.0.0.1:{server.server_port}", "c"), waits.append)
    rows = client.search(spark, (0, 0, 1, 1), "2021-01-01", "2021-12-31", 10.0, grid_code="MGRS-30STG").orderBy("id").collect()
    server.shutdown()
    assert [r.id for r in rows] == ["i0", "i1"] and rows[0].properties["grid:code"] == "MGRS-30STG" and rows[0].datetime.month == 1
    assert 7 <= waits[0] <= 8 and asked[1]["query"] == {"eo:cloud_cover": {"lt": 10.0}, "grid:code": {"eq": "MGRS-30STG"}}
