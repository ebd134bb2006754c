"""Flow is accumulated once for keypoints and the pond sites below them."""

from oracle import SF

from rillwork.operators import terrain
from rillwork.plans import catalog, site  # noqa: F401 - site adds its queries


def test_pond_layer(spark, monkeypatch):
    calls, plain = [], terrain.accumulate
    monkeypatch.setattr(terrain, "accumulate", lambda *a, **k: calls.append(1) or plain(*a, **k))
    assert catalog.QUERIES["q80_pond_layer"](spark, SF).count() > 0
    assert len(calls) == 1
