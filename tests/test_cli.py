"""Exit codes and report of the command line."""

import json

from stationlake.__main__ import main


def test_audit(spark, tmp_path, capsys):
    doc = tmp_path / "s.json"
    good = [{"station_id": str(i), "lat": 48.0 + i / 500, "lon": 2.0 + (i % 5) / 500, "capacity": 10 + i % 7} for i in range(30)]
    doc.write_text(json.dumps({"data": {"stations": good}}))
    assert main(["audit", str(doc), "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["n_stations"] == 30
    doc.write_text(json.dumps({"data": {"stations": [*good, {"station_id": "far", "lat": -20.0, "lon": 120.0, "capacity": 9}]}}))
    assert main(["audit", str(doc), "--out", str(tmp_path / "csv")], spark) == 1
    assert "flagged" in capsys.readouterr().out and list((tmp_path / "csv").glob("*.csv"))
    assert main(["audit", str(tmp_path / "none.json")], spark) == 2
    (tmp_path / "empty.json").write_text("{}")
    assert main(["audit", str(tmp_path / "empty.json")], spark) == 2
