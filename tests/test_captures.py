import os
import random
import struct

import pytest
from captures import ALL, DS, EXT, HT, RATES, VENDOR_A, element, frame, pcap, pcapng

from framewright.operators import decode, prep
from framewright.plans import workflow
from framewright.sources import pcap as source

MAC = "02:00:00:00:00:01"


def read(spark, folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, data in files.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    return source.read_packets(spark, f"file://{folder}", "d", "*.pcap*")


@pytest.mark.parametrize("make", [pcap, lambda f: pcap(f, ">"), lambda f: pcap(f, "<", True), lambda f: pcap(f, ">", True), pcapng])
def test_formats_agree(spark, tmp_path, make):
    rows = read(spark, str(tmp_path), {"dev one.pcap": make([frame(MAC, ALL), frame(MAC, [DS], subtype=8)])}).orderBy("packet").collect()
    assert [r.label for r in rows] == ["dev one"] * 2
    assert rows[0].ts_text == "1000.500000" and rows[1].ts_text == "1001.500001"
    assert (rows[0].mac, rows[0].freq, rows[0].fc_subtype, rows[0].seq_ctrl) == (MAC, 2437, 4, 33)
    assert [e.id for e in rows[0].ies] == [0, 1, 3, 45, 127, 221, 221, 255]
    assert bytes(rows[0].fcs) == b"\x01\x02\x03\x04"


def test_damaged_input(spark, tmp_path):
    whole = pcap([frame(MAC, ALL)])
    rows = read(spark, str(tmp_path), {"a.pcap": whole + b"\0" * 9, "b.pcap": b"not a capture", "c.pcap": pcap([b"\0\0\x0c\0" + b"\0" * 8 + b"short"]), "d.pcap": pcap([frame(MAC, [b"\x2d\xff\x01"])])}).collect()
    by = {r.label: r for r in rows}
    assert set(by) == {"a", "c", "d"} and by["c"].bad and not by["a"].bad
    assert [(e.id, e.len, bytes(e.info)) for e in by["d"].ies] == [(45, 255, b"\x01\x01\x02\x03\x04")]


def test_hex_table(spark, tmp_path):
    packets = read(spark, str(tmp_path), {"x.pcap": pcap([frame(MAC, [element(0, b""), *ALL, element(45, b"\x01")]), frame(MAC, [DS], subtype=8), frame(MAC, [], freq=5180)])})
    rows = decode.hex_table(source.probe_requests(packets)).orderBy("packet").collect()
    assert len(rows) == 2
    first = rows[0].asDict()
    assert (first["Channel"], first["DS Channel"], first["SSID"]) == ("6", "6", "net")
    assert first["Vendor Specific Tags"] == "0050f208;001018"
    assert first["HT Capabilities"].startswith("2d401bff") and first["HE Capabilities"] == "0102"
    assert first["Supported Rates"] == "02040b16" and first["Extended Supported Rates"] == ""
    assert rows[1]["Channel"] == "5180"


def test_binary_table(spark, tmp_path):
    packets = read(spark, str(tmp_path), {"x.pcap": pcap([frame(MAC, [*ALL, element(3, b"\x0b")])])})
    row = decode.binary_table(packets).first().asDict()
    assert len(row) == 32  # path, packet and the 30 columns
    assert row["dsss_parameter"] == "00001011"  # the last instance
    a, b = (f"{int(x, 16):0{4 * len(x)}b}" for x in ("0050f208", "001018"))
    assert row["vst"] == a + "11011101" + "00000011" + b
    assert row["e_id_vst"] == "11011101" and row["len_vst"] == "00000011"
    assert row["frame_check_seq"] == "00000001000000100000001100000100" and row["vht_cap"] == ""


def test_dissected_table(spark, tmp_path):
    packets = read(spark, str(tmp_path), {"x.pcap": pcap([frame(MAC, ALL), frame(MAC, [], freq=5180)])})
    table = decode.dissected_table(packets).orderBy("packet")
    assert len(table.columns) == 2 + 152
    first, bare = (r.asDict() for r in table.collect())
    assert (first["Channel"], bare["Channel"], first["SN"]) == (6, 554, 33 / 16)
    assert [first[f"Supported Rates {i}"] for i in range(1, 6)] == [1.0, 2.0, 5.5, 11.0, None]
    # 0x402d: bits 0, 2, 3, 5 and 14
    assert (first["LDPC_Coding_Capability"], first["Supported_Channel_Width"], first["SM_Power_Save"], first["Short_GI_20Mhz"], first["Forty_Mhz_Intolerant"]) == ("1", "0", "3", "1", "1")
    assert first["Max_A_MPDU_Length_Exponent"] == "3" and first["RX_MSC_Bitmask"] == "255"
    assert first["Extended_Channel_Switching"] == "1" and first["BSS_Transition"] == "1" and first["Interworking"] == "1"
    assert first["U_APSD_Coexistence"] is None and bare["PSMP"] is None and bare["DS Channel"] is None


def test_folders_and_merging(spark, tmp_path):
    for device, files in {"a": {"1.pcap": pcap([frame(MAC, ALL)]), "2.PCAP": pcap([frame(MAC, [])])}, "b": {"1.pcap": pcap([]), "2.pcapng": pcapng([])}, "c": {"1.pcap": b"????"}}.items():
        os.makedirs(tmp_path / device)
        for name, data in files.items():
            (tmp_path / device / name).write_bytes(data)
    rows = {r.device: r for r in source.capture_folders(spark, f"file://{tmp_path}").collect()}
    assert rows["a"].mergeable and len(rows["a"].files) == 2 and not rows["b"].mergeable and "c" not in rows
    merged = source.merge_folders(spark, f"file://{tmp_path}", f"file://{tmp_path}/out").collect()
    assert [(r.device, r.bytes) for r in merged] == [("a", os.path.getsize(tmp_path / "out" / "a.pcap"))]
    assert len(list(source.records((tmp_path / "out" / "a.pcap").read_bytes()))) == 2
    one, two = pcap([frame(MAC, ALL)]), pcap([frame(MAC, [])])
    assert len(list(source.records(source.merge_captures([one, two])))) == 2
    with pytest.raises(ValueError):
        source.merge_captures([one, pcap([], ">")])


def test_workflow(spark, tmp_path):
    for i in range(6):
        frames = [frame(f"02:00:00:00:{i:02x}:{j:02x}", [RATES, element(3, bytes([1 + j % 3])), HT if i % 2 else element(45, bytes([i] * 26)), EXT, element(221, bytes([0, 80, 242, i]))]) for j in range(8)]
        (tmp_path / f"dev{i}.pcap").write_bytes(pcap([*frames, frame(MAC, [DS], subtype=8)]))
    tables = workflow.parse_captures(spark, {"sample": f"file://{tmp_path}"})
    assert {n: t.count() for n, t in tables.items()} == {"hex": 48, "binary": 48, "dissected": 48}
    assert sorted(r.row_id for r in tables["hex"].select("row_id").collect()) == list(range(48))
    shaped = workflow.preprocess(tables["binary"])
    lengths = {len(r.concatenated) for r in shaped["binary_u"].collect()}
    assert len(lengths) == 1 and lengths.pop() > 1336
    hexes = tables["hex"].withColumnRenamed("Label", "label")
    ready = workflow.balance(shaped["binary_u"], hexes, 10)
    assert {r["count"] for r in ready["binary_u"].groupBy("label").count().collect()} == {10}
    joined = ready["binary_u"].join(ready["hex"].select("row_id", F_label(ready["hex"])), "row_id")
    assert joined.filter("label <> other").count() == 0 and joined.count() == 60


def test_cycle(spark, tmp_path):
    rng = random.Random(1)
    base = {f"d{i}": "".join(rng.choice("01") for _ in range(32)) for i in range(6)}
    rows = [(i, d, "".join(c if rng.random() > 0.1 else rng.choice("01U") for c in base[d])) for i, d in enumerate(list(base) * 10)]
    u = spark.createDataFrame(rows, "row_id long, label string, concatenated string")
    hexes = spark.createDataFrame([(i, d, f"{i:04x}", "00ff", f"{i:06x}") for i, d, _ in rows], "row_id long, label string, `HT Capabilities` string, `Extended Capabilities` string, `Vendor Specific Tags` string")
    out = workflow.run_cycle({"binary_u": u, "binary_0": prep.zero_twin(u), "hex": hexes}, 0, n_test=2, n_val=2, pairs_per_label=12, rounds=2, bits=(2,), per_size=3)
    assert out.models["boost"].count() == 2 and out.models["positions_2"].count() == 2
    assert set(out.curves) == {"boost_2", "boost_weighted_2", "positions_2", "sums_2", "sums_3"}
    areas = {r.method: r.auc_resampled for r in workflow.compare_auc({k: v for k, v in out.curves.items() if k.startswith("sums")}).collect()}
    assert set(areas) == {"sums_2", "sums_3"} and all(0 <= a <= 1 for a in areas.values())
    assert out.tests["positions_2_groups"].count() == 1
    assert {"sums_2_groups", "sums_2_dbscan", "sums_3_groups", "sums_3_dbscan"} <= set(out.tests) and out.grids["sums_3"].count() == 4
    assert out.tests["sums_3_dbscan"].filter("noise_ratio between 0 and 1").count() == 1
    small = workflow.Cycle(out.roles, taus={"sums_2": out.taus["sums_2"]})
    assert workflow.save_cycle(small, f"file://{tmp_path}", 0) == ["roles", "taus/sums_2"] and workflow.save_cycle(small, f"file://{tmp_path}", 0) == []
    again = workflow.load_cycle(spark, f"file://{tmp_path}", 0, {"taus": ["sums_2", "sums_3"]})
    assert again.roles.count() == out.roles.count() and list(again.taus) == ["sums_2"]
    labels = [r.value for r in spark.read.text(f"file://{tmp_path}/cycle=0/labels").collect()]
    assert len(labels) == 6 and sum(x.startswith("TEST") for x in labels) == 2


def test_configured(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "d1.pcap").write_bytes(pcap([frame(MAC, ALL), frame(MAC, [DS])]))
    (tmp_path / "c.ini").write_text(f"[home]\nraw_path = file://{tmp_path}/raw\nhex_path = file://{tmp_path}/hex\nbinary_path = file://{tmp_path}/binary\n")
    workflow.parse_configured(spark, str(tmp_path / "c.ini"))
    assert spark.read.parquet(f"file://{tmp_path}/hex").count() == 2 and spark.read.parquet(f"file://{tmp_path}/binary").count() == 2


def test_cut_and_simple_records():
    whole = pcap([frame(MAC, ALL), frame(MAC, ALL)])
    assert [link for link, _, _ in source.records(whole[:-5])] == [127, source.CUT]
    with pytest.raises(ValueError, match="cut off"):
        source.dissect(source.CUT, b"")
    data = frame(MAC, ALL)
    body = struct.pack("<I", len(data)) + data + b"\0" * (-len(data) % 4)
    simple = struct.pack("<II", 3, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    old = struct.pack("<HHIIII", 0, 0, 0, 7, len(data), len(data)) + data + b"\0" * (-len(data) % 4)
    obsolete = struct.pack("<II", 2, len(old) + 12) + old + struct.pack("<I", len(old) + 12)
    found = list(source.records(pcapng([]) + simple + obsolete))
    assert [(link, f) for link, _, f in found] == [(127, data)] * 2 and float(found[1][1]) == 7e-6
    assert [link for link, _, _ in source.records((pcapng([]) + simple)[:-3])] == [source.CUT]


def F_label(df):
    return df["label"].alias("other")


def test_vendor_only(spark, tmp_path):
    row = decode.binary_table(read(spark, str(tmp_path), {"x.pcap": pcap([frame(MAC, [VENDOR_A])])})).first()
    assert row.vst == f"{0x0050F208:032b}"
