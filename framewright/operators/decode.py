"""Packets to the three tables: hex (14 columns), binary (30) and dissected (152)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.bits import bit_text, bytes_to_hex, freq_to_channel, frequency_to_channel, hex_to_binary, pad_array

# Information element numbers and the column names of the tables.
SSID, RATES, DS, HT, EXT_RATES, EXT_CAP, VHT, VENDOR, EXTENSION = 0, 1, 3, 45, 50, 127, 191, 221, 255
HE_EXTENSION = 35
ELEMENT_NAMES = {0: "ssid", 1: "supported rates", 3: "dsss parameters", 45: "ht capabilities", 50: "extended supported rates", 127: "extended capabilities", 189: "cgr group address", 191: "vht capabilities", 221: "vendor specific tags", 255: "extended tags"}
HEX_COLUMNS = ["Timestamp", "MAC Address", "Channel", "DS Channel", "HT Capabilities", "Extended Capabilities", "Vendor Specific Tags", "SSID", "Supported Rates", "Extended Supported Rates", "VHT Capabilities", "HE Capabilities", "Length", "Label"]
#: name of the payload column, suffix of its id and length columns, element number
BINARY_ELEMENTS = [("ssid", "ssid", SSID), ("supported_rates", "sup_rates", RATES), ("ext_sup_rates", "ext_sup_rates", EXT_RATES), ("dsss_parameter", "dsss", DS), ("ht_cap", "ht_cap", HT), ("vht_cap", "vht_cap", VHT), ("ext_cap", "ext_cap", EXT_CAP), ("vst", "vst", VENDOR), ("ext_tags", "ext_tags", EXTENSION)]
#: The HT capability element as little-endian groups of bytes, fields from the high bit down with their widths.
HT_GROUPS = [
    (2, [
        ("L_SIG_TXOP_Protection", 1), ("Forty_Mhz_Intolerant", 1), ("PSMP", 1), ("DSSS_CCK", 1), ("Max_A_MSDU", 1), ("Delayed_BlockAck", 1),
        ("Rx_STBC", 2), ("Tx_STBC", 1), ("Short_GI_40Mhz", 1), ("Short_GI_20Mhz", 1), ("Green_Field", 1), ("SM_Power_Save", 2),
        ("Supported_Channel_Width", 1), ("LDPC_Coding_Capability", 1),
    ]),
    (1, [
        ("res1", 3), ("Min_MPDCU_Start_Spacing", 3), ("Max_A_MPDU_Length_Exponent", 2),
    ]),
    (16, [
        ("res2", 27), ("TX_Unequal_Modulation", 1), ("TX_Max_Spatial_Streams", 2), ("TX_RX_MCS_Set_Not_Equal", 1), ("TX_MCS_Set_Defined", 1), ("res3",
        6), ("RX_Highest_Supported_Data_Rate", 10), ("res4", 3), ("RX_MSC_Bitmask", 77),
    ]),
    (2, [
        ("res5", 4), ("RD_Responder", 1), ("HTC_HT_Support", 1), ("MCS_Feedback", 2), ("res6", 5), ("PCO_Transition_Time", 2), ("PCO", 1),
    ]),
    (4, [
        ("res7", 3), ("Channel_Estimation_Capability", 2), ("CSI_max_n_Rows_Beamformer_Supported", 2),
        ("Compressed_Steering_n_Beamformer_Antennas_Supported", 2), ("Noncompressed_Steering_n_Beamformer_Antennas_Supported", 2),
        ("CSI_n_Beamformer_Antennas_Supported", 2), ("Minimal_Grouping", 2), ("Explicit_Compressed_Beamforming_Feedback", 2),
        ("Explicit_Noncompressed_Beamforming_Feedback", 2), ("Explicit_Transmit_Beamforming_CSI_Feedback", 2), ("Explicit_Compressed_Steering", 1),
        ("Explicit_Noncompressed_Steering", 1), ("Explicit_CSI_Transmit_Beamforming", 1), ("Calibration", 2), ("Implicit_Trasmit_Beamforming", 1),
        ("Transmit_NDP", 1), ("Receive_NDP", 1), ("Transmit_Staggered_Sounding", 1), ("Receive_Staggered_Sounding", 1),
        ("Implicit_Transmit_Beamforming_Receiving", 1),
    ]),
]
#: Extended capability bits in order; a name that repeats is one field of several bits.
EXTENDED_CAPABILITIES = [
    "20_40_BSS_Coexistence_Management_Support", "Reserved_1", "Extended_Channel_Switching", "Reserved_2", "PSMP_Capability", "Reserved_3",
    "SPSMP_Support", "Event", "Diagnostics", "Multicast_Diagnostic", "Location_Tracking", "FMS", "Proxy_Arp_Service",
    "Collocated_Interference_Reporting", "Civic_Location", "Geospatial_Location", "TFS", "WNM_Sleep_Mode", "TIM_Broadcast", "BSS_Transition",
    "QoS_Traffic_Capability", "AC_Station_Count", "Multiple_BSSID", "Timing_Measurement", "Channel_Usage", "SSID_List", "DMS", "UTC_Timing",
    "TPU_Buffer_STA_Support", "TDLS_Peer_PSM", "TDLS_Channel_Switching", "Interworking", "QoS_Map", "EBR", "SSPN_Interface", "Reserved_4",
    "MSGCF_Capability", "TDLS_Support", "TDLS_Prohibited", "TDLS_Channel_Switching_Prohibited", "Reject_Unadmitted_Frame",
    "Service_Interval_Granularity", "Service_Interval_Granularity", "Service_Interval_Granularity", "Identifier_Location", "U_APSD_Coexistence",
    "WNM_Notification", "QAB_Capability", "UTF_8_SSID", "QMF_Activated", "QMF_ReconfigurationActivated", "Robust_AV_Streaming", "Advanced_GCR",
    "Mesh_GCR", "SCS", "QLoad_Report", "Alternate_EDCA", "Unprotected_TXOP", "Protected_RXOP", "Reserved_5", "Protected_QLoad_Report",
    "TDLS_Wide_Bandwidth", "Operating_Mode_Notification", "Max_Number_Of_MSDUs_In_A_MPDU", "Max_Number_Of_MSDUs_In_A_MPDU",
    "Channel_Schedule_Management", "Geodatabase_Inband_Enabling_Signal", "Network_Channel_Control", "White_Space_Map", "Channel_Availability_Query",
    "FTM_Responder", "FTM_Initiator", "Reserved_6", "ESM_Capability", "Future_Channel_Guidance",
]


def _of(number: int) -> Column:
    return F.filter("ies", lambda e: e["id"] == number)


def _first(number: int) -> Column:
    """The first element of a kind, or null."""
    return F.get(_of(number), F.lit(0))["info"]


def _first_filled(number: int) -> Column:
    return F.get(F.filter(_of(number), lambda e: F.octet_length(e["info"]) > 0), F.lit(0))["info"]


def _byte(info: Column, at: int = 1) -> Column:
    return F.conv(F.hex(F.substring(info, at, 1)), 16, 10).cast("int")


def element_name(number: Column) -> Column:
    """The name of an element number; others are ``unknown``."""
    names = F.create_map(*(F.lit(x) for pair in ELEMENT_NAMES.items() for x in pair))
    return F.coalesce(F.element_at(names, number), F.lit("unknown"))


def hex_table(packets: DataFrame) -> DataFrame:
    """Hex view; feed it probe requests. The first filled instance of an element wins, vendor tags are joined by ``;``."""
    vendor = F.filter(_of(VENDOR), lambda e: F.octet_length(e["info"]) > 0)
    he = F.filter(_of(EXTENSION), lambda e: (F.octet_length(e["info"]) > 1) & (F.hex(F.substring(e["info"], 1, 1)) == f"{HE_EXTENSION:02X}"))
    he = F.get(he, F.lit(0))["info"]
    values = [
        F.col("ts_text"), F.coalesce("mac", F.lit("")), F.coalesce(freq_to_channel(F.col("freq").cast("string")), F.lit("")),
        F.coalesce(_byte(_first_filled(DS)).cast("string"), F.lit("")), bytes_to_hex(_first_filled(HT)), bytes_to_hex(_first_filled(EXT_CAP)),
        F.array_join(F.transform(vendor, lambda e: bytes_to_hex(e["info"])), ";"), F.coalesce(F.make_valid_utf8(_first_filled(SSID).cast("string")), F.lit("")),
        bytes_to_hex(_first_filled(RATES)), bytes_to_hex(_first_filled(EXT_RATES)), bytes_to_hex(_first_filled(VHT)),
        F.coalesce(bytes_to_hex(F.substring(he, 2, 1 << 16)), F.lit("")), F.col("length").cast("string"), F.col("label"),
    ]
    return packets.select("path", "packet", *(v.alias(n) for v, n in zip(values, HEX_COLUMNS, strict=True)))


def binary_table(packets: DataFrame) -> DataFrame:
    """Binary view. The last instance of an element wins; later vendor tags are appended with id and length."""
    bits8 = lambda number: F.lpad(F.conv(number.cast("string"), 10, 2), 8, "0")
    lasts = packets.withColumns({f"__l{n}": F.get(F.reverse(_of(n)), F.lit(0)) for _, _, n in BINARY_ELEMENTS})
    joined = F.aggregate(_of(VENDOR), F.lit(""), lambda s, e: F.when(F.length(s) > 0, F.concat(s, bits8(e["id"]), bits8(e["len"]), bit_text(e["info"]))).otherwise(bit_text(e["info"])))
    columns = [F.coalesce("mac", F.lit("None")).alias("mac")]
    for name, suffix, number in BINARY_ELEMENTS:
        last = F.col(f"__l{number}")
        payload = joined if number == VENDOR else bit_text(last["info"])
        columns += [F.coalesce(bits8(last["id"]), F.lit("")).alias(f"e_id_{suffix}"), F.coalesce(bits8(last["len"]), F.lit("")).alias(f"len_{suffix}"), F.coalesce(payload, F.lit("")).alias(name)]
    return lasts.select("path", "packet", *columns, bit_text(F.col("fcs")).alias("frame_check_seq"), "label")


def ht_bits(info: Column) -> Column:
    """The bits of an HT capability element, each little-endian group high byte first; null if it is too short."""
    bits, parts, start = bit_text(info), [], 0
    for size, _ in HT_GROUPS:
        parts += [F.substring(bits, 8 * (start + size - 1 - i) + 1, 8) for i in range(size)]
        start += size
    return F.when(F.octet_length(info) >= start, F.concat(*parts))


def ht_fields(bits: Column) -> list[Column]:
    """The 53 HT capability fields, from :func:`ht_bits`, as whole numbers in text."""
    out, at = [], 1
    for name, width in (f for _, fields in HT_GROUPS for f in fields):
        part = F.substring(bits, at, width)
        out.append((F.conv(part, 2, 10) if width < 63 else _wide(part, width)).alias(name))
        at += width
    return out


def _wide(bits: Column, width: int) -> Column:
    """A number of more than 63 bits as decimal text."""
    high = F.conv(F.substring(bits, 1, width - 32), 2, 10).cast("decimal(38,0)")
    low = F.conv(F.substring(bits, width - 31, 32), 2, 10).cast("decimal(38,0)")
    return (high * F.lit(1 << 32).cast("decimal(10,0)") + low).cast("string")


def extended_bits(info: Column) -> Column:
    """The bits of an extended capability element, least significant first."""
    return hex_to_binary(bytes_to_hex(info))


def extended_fields(bits: Column) -> list[Column]:
    """The first 72 extended capability fields as bit text; absent tail bits read 0, absent fields are null."""
    where: dict[str, list[int]] = {}
    for at, name in enumerate(EXTENDED_CAPABILITIES):
        where.setdefault(name, []).append(at)
    out = []
    for name, at in list(where.items())[:72]:
        bit = [F.when(F.length(bits) > i, F.substring(bits, i + 1, 1)).otherwise("0") for i in at] if len(at) > 1 else [F.substring(bits, at[0] + 1, 1)]
        out.append(F.when(F.length(bits) > at[0], F.concat(*bit)).alias(name))
    return out


def rates(info: Column) -> Column:
    """Eight rates in Mb/s, nulls at the end."""
    values = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(info), F.lit(1))), lambda i: F.conv(F.hex(F.substring(info, i, F.lit(1))), 16, 10).cast("int") / 2.0)
    return pad_array(F.when(F.octet_length(info) > 0, values), 8)


def dissected_table(packets: DataFrame) -> DataFrame:
    """All 152 dissected columns; the first instance of an element counts."""
    # the elements and their bits first, so that no field takes an element apart again
    firsts = packets.withColumns({f"__e{n}": _first(n) for n in (SSID, RATES, DS, HT, EXT_RATES, EXT_CAP, VHT, VENDOR, EXTENSION)})
    shaped = firsts.withColumns({"__ht": ht_bits(F.col(f"__e{HT}")), "__ext": extended_bits(F.col(f"__e{EXT_CAP}")), "__r": rates(F.col(f"__e{RATES}")), "__x": rates(F.col(f"__e{EXT_RATES}"))})
    text = lambda number: F.when(F.col(f"__e{number}").isNotNull(), bytes_to_hex(F.col(f"__e{number}")))
    head = [
        F.col("ts").alias("Timestamp"), F.col("mac").alias("MAC Address"), frequency_to_channel(F.col("freq")).alias("Channel"), _byte(F.col(f"__e{DS}")).alias("DS Channel"),
        F.coalesce(F.col("seq_ctrl") / 16.0, F.lit(0.0)).alias("SN"), text(VENDOR).alias("Vendor Specific Tags"), F.try_validate_utf8(F.col(f"__e{SSID}").cast("string")).alias("SSID"),
        text(VHT).alias("VHT Capabilities"), text(EXTENSION).alias("HE Capabilities"), F.col("length").alias("Length"), F.col("label").alias("Label"),
    ]
    each = [F.get(c, F.lit(i)).alias(f"{name} {i + 1}") for c, name in (("__r", "Supported Rates"), ("__x", "Extended Supported Rates")) for i in range(8)]
    return shaped.select("path", "packet", *head, *each, *ht_fields(F.col("__ht")), *extended_fields(F.col("__ext")))
