"""A run of the command line over written logs, and the workbook reader."""

import datetime as dt
import io
import json
import zipfile

from flowtally import __main__ as cli
from flowtally.sources import workbook


def test_command_line(spark, tmp_path, monkeypatch):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    start = dt.datetime(2019, 1, 1)
    lines = []
    for q in range(96 * 31 + 1):  # with the closing midnight
        t = start + dt.timedelta(minutes=15 * q)
        lines.append(t.strftime("%A %d %B %Y %H:%M"))
        for site in (1, 2, 3):
            level = 10 * site + (t.hour if site < 3 else 24 - t.hour)
            lines.append(f"Int {site}  1={level}  2={'NA' if q % 50 == 0 else level}")
    (raw / "Jan2019.txt").write_text("\n".join(lines))
    detectors = tmp_path / "detectors.csv"
    detectors.write_text("site_id,channel_id,approach,operational\n" + "".join(f"{s},{c},{a},true\n" for s in (1, 2, 3) for c, a in ((1, "south"), (2, "north"))))
    monkeypatch.setattr(cli, "session", lambda: spark)
    cli.main(["all", "--raw", str(raw), "--detectors", str(detectors), "--out", out])
    m = {r.site: r for r in spark.read.parquet(f"{out}/tables/site_monthly").collect()}
    assert len(m) == 3 and m[1].year_month == "2019-01" and m[1].source_observations == 96 * 31 and m[1].temporal_coverage == 1.0
    assert m[1].mean_volume == 2 * (10 + 11.5)  # missing detectors are scaled up
    n = {r.site: r for r in spark.read.parquet(f"{out}/tables/graph_nodes").collect()}
    assert n[1].community == n[2].community != n[3].community and n[1].dtw_cluster == n[2].dtw_cluster != n[3].dtw_cluster and n[3].degree == 0
    assert spark.read.parquet(f"{out}/channel_quality").where("site = 1 AND channel = 2").first().invalid == 60
    audit = spark.read.parquet(f"{out}/tables/source_quality").first()
    assert (audit.source_file, audit.source_month, audit.expected, audit.timestamps, audit.records, audit.normalized_records) == ("Jan2019.txt", "2019-01", 96 * 31, 96 * 31 + 1, 3 * (96 * 31 + 1), 3 * (96 * 31 + 1))
    assert spark.read.parquet(f"{out}/source_files").first().sha256 and {r.site: r.records for r in spark.read.parquet(f"{out}/inventory").collect()} == dict.fromkeys((1, 2, 3), 96 * 31 + 1)
    got = json.loads("".join(r.value for r in spark.read.text(f"{out}/report/report.json").collect()))["datasets"]
    assert len(got) == 20 and got["headline"][0]["trusted_site_months"] == 3 and [r["source_status"] for r in got["city_monthly"]] == ["Complete"]
    about = json.loads("".join(r.value for r in spark.read.text(f"{out}/report/about.json").collect()))["datasets"]
    assert {k: len(v) for k, v in about.items()} == {"checks": 1, "insights": 1, "summary": 1} and about["summary"][0]["site_months"] == 3
    assert spark.read.parquet(f"{out}/report/summary").first().operational_invalid_rate > 0 and spark.read.parquet(f"{out}/tables/graph_metadata").first().nodes == 3
    read = lambda n: json.loads("".join(r.value for r in spark.read.text(f"{out}/report/{n}.json").collect()))
    shown, short, developer = read("manifest"), read("short"), read("developer")
    assert len(shown["charts"]) == 17 and len(shown["cards"]) == 7 and len(shown["tables"]) == 3 and set(shown["datasets"]) <= set(got)
    for c in shown["charts"]:
        named = [*c["encodings"].values(), *c["tooltip"], *c.get("wide", [])]
        assert all(x["field"] in got[c["dataset"]][0] for x in named if got[c["dataset"]]), c
    assert {c["id"]: c["encodings"]["y"]["format"] for c in shown["charts"] if c["id"] in ("changes", "months")} == {"changes": "percent", "months": "number"}
    assert {c["id"]: c["encodings"]["x"]["type"] for c in shown["charts"] if c["id"] in ("months", "groups", "links")} == {"months": "temporal", "groups": "nominal", "links": "quantitative"}
    assert len(short["charts"]) == 3 == len(short["tables"]) and len(short["datasets"]) == 8 and short["datasets"]["headline"] == got["headline"]
    assert {d["id"]: d["count"] for d in developer["datasets"]} == {k: len(v) for k, v in got.items()} and {"name": "dtw_window", "value": 3} in developer["rules"]
    assert next(f for d in developer["datasets"] if d["id"] == "site_summary" for f in d["fields"] if f["field"] == "site")["known"] == 3 and developer["checks"]["monthly_repeats"] == 0
    before = spark.read.parquet(f"{out}/fact").count()
    cli.main(["ingest", "--raw", str(raw), "--detectors", str(detectors), "--out", out])
    assert spark.read.parquet(f"{out}/fact").count() == before == 3 * (96 * 31 + 1)


def test_metadata_to_ingest(spark, tmp_path, monkeypatch):
    """From logs, boxes and overrides alone: ingest takes the detectors that metadata wrote."""
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    (raw / "May2020.txt").write_text("".join(f"Friday 01 May 2020 {q // 4:02d}:{q % 4 * 15:02d}\nInt 5 1=4 2=6 3=8\nInt 6 7=9\n" for q in range(96)) + "Friday 01 May 2020 23:59\nInt 6 7=9\n" * 10)
    (tmp_path / "boxes.csv").write_text("site,x,y\n5,690,600\n5,690,610\n5,100,347\n8,690,600\n")
    (tmp_path / "own.csv").write_text("site,channel,approach,verification,source_note\n6,7,east,manual,seen on site\n")
    settings = tmp_path / "settings.json"
    settings.write_text('{"operational_readings": 50}')
    monkeypatch.setattr(cli, "session", lambda: spark)
    common = ["--raw", str(raw), "--out", out, "--settings", str(settings)]
    cli.main(["metadata", *common, "--boxes", str(tmp_path / "boxes.csv"), "--overrides", str(tmp_path / "own.csv")])
    d = {(r.site, r.channel): r for r in spark.read.parquet(f"{out}/detectors").collect()}
    assert {k: r.approach for k, r in d.items()} == {(5, 1): "south", (5, 2): "south", (5, 3): "west", (6, 7): "east"}
    assert (d[6, 7].verification, d[6, 7].source_note, d[5, 1].verification) == ("manual", "seen on site", "diagram")
    assert {r.site: (r.has_raw_data, r.has_registry_name, r.has_diagram) for r in spark.read.parquet(f"{out}/inventory").collect()} == {5: (True, False, True), 6: (True, False, False), 8: (False, False, True)}
    cli.main(["ingest", *common])
    f = {r.site_id: r for r in spark.read.parquet(f"{out}/fact").where("hour(ts) = 3").collect()}
    assert (f[5].volume_normalized, f[5].south_volume, f[5].west_volume, f[6].east_volume) == (18.0, 10.0, 8.0, 9.0)


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="a" sheetId="1" r:id="r1"/><sheet name="b" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t> First </t></si><si><r><t>Sec</t></r><r><t>ond</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1"><v>9</v></c></row></sheetData></worksheet>')
        rows = ['<row r="1"><c r="A1" t="str"><v>id</v></c></row>', '<row r="2"><c r="A2"><v>5</v></c><c r="B2" t="s"><v>0</v></c><c r="C2"><v>77</v></c></row>', '<row r="3"><c r="A3"><v>5</v></c><c r="B3" t="s"><v>1</v></c></row>', '<row r="4"><c r="B4" t="s"><v>1</v></c></row>', '<row r="5"><c r="A5" t="inlineStr"><is><t>6</t></is></c><c r="B5" t="s"><v>1</v></c></row>', '<row r="6"><c r="A6" t="str"><v>none</v></c></row>', '<row r="7"><c r="A7"><v>7</v></c></row>']
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData>{''.join(rows)}</sheetData></worksheet>")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b SCATS list.xlsx").write_bytes(out.getvalue())
    (tmp_path / "~$scats.xlsx").write_bytes(b"lock")
    got = sorted(map(tuple, workbook.read_registry(spark, str(tmp_path)).collect()))
    assert [x[:3] for x in got] == [(5, "First", 77), (6, "Second", None), (7, "", None)]
